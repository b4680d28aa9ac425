"""Problem 8: held-out test items standing inside corpus documents.

Size-partitioned MinHash containment search. Items are partitioned by length into
octaves; for the octave [B, 2B) every document is cut into windows of 2B word
shingles at a stride of B, so that the size of a window is within a constant factor of
the item's and containment turns into a Jaccard similarity that MinHash can see,
however long the document. Window minima of all octaves are built from the same
minima of 16-shingle blocks. A (window, item) pair that agrees in ``MIN_AGREE`` of
``HASHES`` minima is a candidate; candidates are verified by exact containment of
the item's shingles in one place and by the share of the item's words that stand
there in order.

Shingles have three words (characters in Chinese and kana), not five: the problem
asks for passages in which single words are changed, and half an item with every
eighth word changed keeps few five-word shingles. Every shingle of an item is searched
for; in the containment it weighs the less the more different items have it (one
over their number), so a stock opening weighs next to nothing beside an item's own
words, while items that are variants of each other are all found. Minima are
taken over each item's rarest shingles (``RARE`` of them at least).

The items are a small table (``MAX_ITEMS`` at most); their index is built once and goes to
the executors as one broadcast. Documents are never shuffled. Null, empty and blank texts
contain nothing. Items under ``SHINGLE`` words have no shingle and are never reported. Every
id of a re-issued item is reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import map_batches

SHINGLE = 3
HASHES = 64
MIN_AGREE = 2
BLOCK = 16
RARE = 0.6
MIN_CONTAINMENT = 0.25
MIN_WORDS = 0.5
MAX_GAP = 120  # words of foreign text (one long sentence) allowed between two parts of one leak
MAX_ITEMS = 200_000

CJK = "\u3040-ヿ㐀-䶿一-鿿"
WORDS = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
IGNORED = re.compile("[\u00ad\u0307\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")


def words_of(text: str) -> list[str]:
    """Words without case, spacing, punctuation and character form."""
    if not text.isascii():
        text = IGNORED.sub("", unicodedata.normalize("NFKC", text)).replace("İ", "i").replace("ı", "i")
        return WORDS.findall(IGNORED.sub("", text.casefold()))
    return WORDS.findall(text.lower())


class _WordHash(dict):
    def __reduce__(self):  # a broadcast index starts with an empty cache
        return (_WordHash, ())

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _shingles(h: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit code of each run of three word hashes."""
    with np.errstate(over="ignore"):
        m = np.uint64(0x9E3779B97F4A7C15)
        x = (h[:-2] * m ^ h[1:-1]) * m ^ h[2:]
        x = x * m
        return x ^ (x >> np.uint64(31))


def _common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one machine integer per row."""
    at: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class LeakIndex:
    def __init__(self, items: list[tuple[int, str]], seed: int = 7):
        ids: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for ident, text in items:
            if text and ident is not None:
                ids[tuple(words_of(text))].append(ident)
        self.hash = _WordHash()
        self.words, self.ids, shingles = [], [], []
        for words, group in ids.items():
            if len(words) >= SHINGLE:
                h = np.array([self.hash[w] for w in words], dtype=np.uint64)
                self.words.append(h.tolist())
                self.ids.append(sorted(set(group)))
                shingles.append(_shingles(h))
        shared = Counter(s for x in shingles for s in set(x.tolist()))
        self.own: list[dict[int, int]] = []  # shingle -> place in the item
        self.weight: list[dict[int, float]] = []  # place -> one over the number of items that have its shingle
        for x in shingles:
            self.own.append({s: i for i, s in reversed(list(enumerate(x.tolist())))})
            self.weight.append({i: 1 / shared[s] for s, i in self.own[-1].items()})
        self.total = [sum(w.values()) for w in self.weight]
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
        keys = [self._searched(own, shared) for own in self.own]
        octave: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(self.own):
            if own:
                octave[max(BLOCK, 1 << (len(self.words[i]).bit_length() - 1))].append(i)
        self.octaves = []
        for size, members in sorted(octave.items()):
            tables = []
            for m, a in zip(self.mul, self.add):
                least = np.minimum.reduceat(self._permute(np.concatenate([keys[i] for i in members]), m, a), np.cumsum([0, *(len(keys[i]) for i in members[:-1])]))
                order = np.argsort(least, kind="stable")
                tables.append((least[order], np.array(members)[order]))
            self.octaves.append((size, tables))

    @staticmethod
    def _searched(own: dict[int, int], shared: Counter) -> np.ndarray:
        """The rarest shingles of an item, at least ``RARE`` of them, with all that are as rare.

        What is left out cannot hold half an item by itself, so no leak escapes the search;
        verification counts all shingles.
        """
        keys = np.array(list(own), dtype=np.uint64)
        often = np.array([shared[s] for s in own])
        if not len(keys):
            return keys
        limit = np.sort(often)[int(np.ceil(RARE * len(often))) - 1]
        return keys[often <= limit]

    @staticmethod
    def _permute(shingles: np.ndarray, mul: np.uint32, add: np.uint32) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (shingles >> np.uint64(32)).astype(np.uint32) * mul + add
            return x ^ (x >> np.uint32(15))

    def candidates(self, shingles: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs; ``sizes`` has the number of shingles of each row."""
        rows = np.flatnonzero(sizes)
        if not len(rows):
            return []
        starts = np.r_[0, np.cumsum(sizes[rows])[:-1]]
        blocks = -(-sizes[rows] // BLOCK)
        within = np.arange(blocks.sum()) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
        block_at = np.repeat(starts, blocks) + within * BLOCK
        block_row = np.repeat(np.arange(len(rows)), blocks)
        plans = []
        for size, tables in self.octaves:
            per = size // BLOCK
            head = np.flatnonzero(within % per == 0)
            row = block_row[head]
            joined = np.r_[row[1:] == row[:-1], False]
            plans.append((head, row, joined, tables, []))
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            with np.errstate(over="ignore"):
                x = high * self.mul[k] + self.add[k]
                x ^= x >> np.uint32(15)
            least = np.minimum.reduceat(x, block_at)
            for head, _, joined, tables, hits in plans:
                low = np.minimum.reduceat(least, head)
                low[:-1] = np.where(joined[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
                values, members = tables[k]
                at = np.searchsorted(values, low)
                window = np.arange(len(low))
                while True:  # an item value may belong to several items
                    ok = at < len(values)
                    ok[ok] = values[at[ok]] == low[window[ok]]
                    if not ok.any():
                        break
                    window, at = window[ok], at[ok]
                    hits.append(window * len(self.words) + members[at])
                    at = at + 1
        found = set()
        for _, row, _, _, hits in plans:
            if hits:
                code, agree = np.unique(np.concatenate(hits), return_counts=True)
                code = code[agree >= MIN_AGREE]
                found.update(zip(rows[row[code // len(self.words)]].tolist(), (code % len(self.words)).tolist()))
        return sorted(found)

    def verify(self, words: list[int], shingles: list[int], item: int) -> tuple[float, float, int, int] | None:
        """Best place of the item: containment, share of words in order, first and last word."""
        own, want, weight = self.own[item], self.words[item], self.weight[item]
        anchors = [(p, own[s]) for p, s in enumerate(shingles) if s in own]
        best = None
        run: list[tuple[int, int]] = []

        def close():
            nonlocal best
            if not run:
                return
            containment = sum(weight[q] for q in {q for _, q in run}) / self.total[item]
            if containment < MIN_CONTAINMENT:
                return
            lo, hi = run[0][0], run[-1][0] + SHINGLE
            qlo, qhi = min(q for _, q in run), max(q for _, q in run) + SHINGLE
            while lo and qlo and words[lo - 1] == want[qlo - 1]:
                lo, qlo = lo - 1, qlo - 1
            while hi < len(words) and qhi < len(want) and words[hi] == want[qhi]:
                hi, qhi = hi + 1, qhi + 1
            share = _common_in_order(want, words[lo:hi]) / len(want)
            if share >= MIN_WORDS and (best is None or share > best[1]):
                best = (containment, share, lo, hi)

        for p, q in anchors:
            # another place: too far on, or the item starts again
            if run and (p - run[-1][0] > MAX_GAP + SHINGLE or (q < run[-1][1] - len(want) // 2 and p - run[0][0] > len(want) // 2)):
                close()
                run = []
            run.append((p, q))
        close()
        return best

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, float, int, int]]:
        get = self.hash.__getitem__
        words = [list(map(get, words_of(t))) if t else [] for t in texts]
        words = [w if len(w) >= SHINGLE else [] for w in words]
        flat = np.array([h for w in words for h in w], dtype=np.uint64)
        if len(flat) < SHINGLE or not self.octaves:
            return []
        counts = np.array([len(w) for w in words])
        at = np.r_[0, np.cumsum(counts)[:-1]]
        all_shingles = _shingles(flat)
        keep = np.ones(len(flat), dtype=bool)
        for back in range(1, SHINGLE):
            keep[(at + counts - back)[counts > 0]] = False
        sizes = np.maximum(counts - SHINGLE + 1, 0)
        out = []
        for row, item in self.candidates(all_shingles[keep[: len(all_shingles)]], sizes):
            own = all_shingles[at[row] : at[row] + sizes[row]].tolist()
            if best := self.verify(words[row], own, item):
                out.extend((row, ident, *best) for ident in self.ids[item])
        return out


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, containment, word_share, first_word, last_word) of every leak.

    ``items`` is refused beyond ``MAX_ITEMS`` rows, the bound on what each task holds.
    """
    rows = items.select("item_id", "text").distinct().limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} test items; index them in several calls")
    pairs = sorted((r.item_id, r.text) for r in rows if r.item_id is not None and r.text is not None)
    names = ("doc_id", "item_id", "containment", "word_share", "first_word", "last_word")
    spread = documents.sparkSession.sparkContext.broadcast(LeakIndex(pairs))

    def make():
        index = spread.value

        def step(cols):
            found = index.search(cols["text"])
            return dict(zip(names, zip(*((cols["doc_id"][r[0]], *r[1:]) for r in found)))) if found else {n: [] for n in names}

        return step

    schema = "doc_id bigint, item_id bigint, containment double, word_share double, first_word int, last_word int"
    return map_batches(documents.select("doc_id", "text").where("text is not null"), make, schema).distinct()
