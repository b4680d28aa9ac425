"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

Speculate and verify: greedy longest match proposes the tokens of each new word; a
sequence is the word's true encoding exactly when every adjacent pair is
compatible (no merge across the seam would have happened earlier than the merges
that built its two sides), which is tested for all pairs at once with numpy; only
words with an incompatible pair are merged exactly. Words already met by the task
come from a bounded cache.

A null and an empty text both give the empty list; every row gives a row; special
tokens are ordinary text.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_batches

CACHE_WORDS = 400_000
NONE = np.int64(1 << 40)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The split of text into words before merging; fixed by the public vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        as_bytes = lambda s: bytes(map(alphabet.__getitem__, s))
        self.vocab = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        self.vocab.pop(b"<|endoftext|>", None)
        size = max(model["vocab"].values()) + 1
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.rank = np.full(size, -1, dtype=np.int64)  # order of the merge that makes the token; -1: a byte
        pairs = []
        for order, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = self.vocab[as_bytes(a)], self.vocab[as_bytes(b)]
            z = self.vocab[as_bytes(a + b)]
            self.left[z], self.right[z], self.rank[z] = x, y, order
            pairs.append((x * size + y, order, z))
        self.size = size
        codes = np.array(sorted(pairs), dtype=np.int64)
        self.code, self.order, self.made = codes[:, 0], codes[:, 1], codes[:, 2]
        self.merge = {c: (o, z) for c, o, z in pairs}
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for word in self.vocab:
            head = word[:2]
            self.longest[head] = max(len(word), self.longest.get(head, 1))
        self.split = regex.compile(WORD_PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _orders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.order[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the seam of each pair survives merging, all pairs in step.

        Walk back in time from the later of the two sides' last merges: whenever the
        two tokens that touch the seam could merge before the moment looked at, the
        seam would not have survived.
        """
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NONE)
        strict = np.zeros(len(a), dtype=bool)  # at an equal order the right side's merge comes later
        while len(live):
            order = self._orders(x, y)
            bad = (order < limit) | ((order == limit) & ~strict & (order < NONE))
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            keep = ~bad & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry
            limit = np.where(undo_left, rx, ry)
            strict = undo_left
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            live, x, y, limit, strict = live[keep], x[keep], y[keep], limit[keep], strict[keep]
        return ok

    def _greedy(self, word: bytes) -> list[int]:
        out, i, n, vocab, longest = [], 0, len(word), self.vocab, self.longest
        while i < n:
            for size in range(min(longest.get(word[i : i + 2], 1), n - i), 0, -1):
                token = vocab.get(word[i : i + size])
                if token is not None:
                    out.append(token)
                    i += size
                    break
        return out

    def _exact(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Merge in rank order, all words of the batch in step: each round every
        word performs its lowest-ranked merge at all its places, left to right."""
        out: list[tuple[int, ...]] = [()] * len(words)
        single = np.array(self.single, dtype=np.int64)
        tok = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        order = np.full(len(tok), NONE)
        same = owner[:-1] == owner[1:]
        order[:-1][same] = self._orders(tok[:-1][same], tok[1:][same])
        while len(tok):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(order, first)
            sizes = np.diff(np.r_[first, len(tok)])
            done = least == NONE
            if done.any():
                for i, n in zip(first[done], sizes[done]):
                    out[owner[i]] = tuple(tok[i : i + n].tolist())
                keep = ~np.repeat(done, sizes)
                tok, owner, order = tok[keep], owner[keep], order[keep]
                if not len(tok):
                    break
                least, sizes = least[~done], sizes[~done]
            hit = np.flatnonzero(order == np.repeat(least, sizes))
            # of touching places of one word only every second from the left of a run merges
            run = np.r_[True, np.diff(hit) != 1]
            start = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            hit = hit[(hit - start) % 2 == 0]
            code = tok[hit] * self.size + tok[hit + 1]
            tok[hit] = self.made[np.searchsorted(self.code, code)]
            gone = np.zeros(len(tok), dtype=bool)
            gone[hit + 1] = True
            shift = np.cumsum(gone)
            hit = hit - shift[hit]
            tok, owner, order = tok[~gone], owner[~gone], order[~gone]
            for at in (hit, hit - 1):
                at = at[at >= 0]
                order[at] = NONE
                inside = at[at < len(tok) - 1]
                inside = inside[owner[inside] == owner[inside + 1]]
                order[inside] = self._orders(tok[inside], tok[inside + 1])
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposal = [self._greedy(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(proposal), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposal])
        failing = set()
        if len(flat) > 1:
            same = owner[:-1] == owner[1:]
            codes, inverse = np.unique(flat[:-1][same] * self.size + flat[1:][same], return_inverse=True)
            ok = self.compatible(codes // self.size, codes % self.size)[inverse]
            failing = set(owner[:-1][same][~ok].tolist())
        self.cache.update((w, tuple(p)) for i, (w, p) in enumerate(zip(words, proposal)) if i not in failing)
        bad = sorted(failing)
        self.proposed, self.failed = len(words), len(bad)
        if bad:
            self.cache.update(zip((words[i] for i in bad), self._exact([raw[i] for i in bad])))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split.findall(t) if t else [] for t in texts]
        new = set(chain.from_iterable(words))
        fresh = new - self.cache.keys()
        if fresh:
            if len(self.cache) + len(fresh) > CACHE_WORDS:
                self.cache.clear()
                fresh = new
            self.learn(list(fresh))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, w))) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row of ``documents``; ``vocabulary`` is a path every executor can read."""
    kind = dict(documents.dtypes)[key]

    def make():
        enc = encoder(vocabulary)
        return lambda cols: {key: cols[key], "ids": enc.encode_batch(cols[text])}

    return map_batches(documents.select(key, text), make, f"{key} {kind}, ids array<int>")
