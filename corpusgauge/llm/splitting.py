"""Problem 1: cut oversized items at natural boundaries, with overlap.

An item is oversized when it has more than ``max_tokens`` tokens or more than
``max_chars`` code points. Its boundaries (paragraph, line, sentence, clause, word)
each carry a penalty; dynamic programming over the boundary positions minimises the
sum of cut penalties and squared size imbalance, subject to both limits with the
overlap counted in. Boundaries weaker than a sentence are offered only inside
stretches that stronger ones leave too long; a single token longer than the
limit is cut between code points.

The overlap is ``overlap`` whole tokens, but at most a quarter of ``max_chars``: before very long tokens it is
fewer. Behind a cut inside a token it is ``overlap`` code points of that token.

Nulls and empty texts are never oversized. Repeated rows give one result. Headings
are carried over; a null heading list becomes an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MAX_TOKENS = 500
MAX_CHARS = 4000
OVERLAP = 30

WS = r"\p{White_Space}"
TOKEN = regex.compile(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]")
PARAGRAPH = regex.compile(r"\n[ \t\r]*\n\s*|\n(?=#{1,6} |\\(?:sub)*section|=+ )")
LINE = regex.compile(r"\n")
SENTENCE = regex.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”」』）]*|।\s*|؟\s*")
CLAUSE = regex.compile(r"[,;:،؛]\s+|[，；：、]")
WORD = regex.compile(r"\s+")
FORCED_STEP = 40
#: Cost of a cut at each kind of boundary; an ideal piece has imbalance cost 0.
PENALTY = {"paragraph": 0.0, "line": 0.3, "sentence": 0.6, "clause": 2.0, "word": 4.0, "forced": 9.0}
HEADING = regex.compile(r"^(?:#{1,6} +(.+?)#*|=+ *(.+?) *=+|\\(?:sub)*section\{(.+?)\}|<h[1-6][^>]*>(.+?)</h[1-6]>)\s*$", regex.M | regex.I)


def _boundaries(text: str, starts: list[int], max_tokens: int, max_chars: int) -> tuple[list[int], list[str]]:
    """Cut positions with their kind; position p cuts before text[p]."""
    kinds: dict[int, str] = {}
    for name, pattern in (("paragraph", PARAGRAPH), ("line", LINE), ("sentence", SENTENCE)):
        for m in pattern.finditer(text):
            kinds.setdefault(m.end(), name)
    spans = starts + [len(text)]

    def long_gaps(limit_t: int, limit_c: int) -> list[tuple[int, int]]:
        cuts = sorted({0, len(text), *kinds})
        return [
            (a, b)
            for a, b in zip(cuts, cuts[1:])
            if b - a > limit_c or bisect_left(spans, b) - bisect_left(spans, a) > limit_t
        ]

    for name, pattern in (("clause", CLAUSE), ("word", WORD)):
        for a, b in long_gaps(max_tokens // 5, max_chars // 5):
            for m in pattern.finditer(text, a, b):
                kinds.setdefault(m.end(), name)
    for a, b in long_gaps(max_tokens // 5, max_chars // 5):
        inside = starts[bisect_left(starts, a + 1) : bisect_left(starts, b)]
        for p in inside[FORCED_STEP - 1 :: FORCED_STEP]:
            kinds.setdefault(p, "forced")
    for a, b in long_gaps(max_tokens, max_chars // 5):
        for p in range(a + max_chars // 5, b, max_chars // 5):
            kinds.setdefault(p, "forced")
    kinds.pop(0, None)
    kinds.pop(len(text), None)
    at = sorted(kinds)
    return at, [kinds[p] for p in at]


def split_text(
    text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, end, tokens, kind of the cut at the end), overlap included."""
    starts, ends = [], []
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    if len(starts) <= max_tokens and len(text) <= max_chars:
        return [(0, len(text), len(starts), "end")]
    cuts, kinds = _boundaries(text, starts, max_tokens, max_chars)
    pos = np.array([0, *cuts, len(text)])
    first = np.searchsorted(np.array(ends), pos, side="right")  # tokens that end at or before
    past = np.searchsorted(np.array(starts), pos, side="left")  # tokens that start before
    begin = np.empty(len(pos), dtype=np.int64)  # where a piece after this cut starts
    for i, p in enumerate(pos):
        k = max(0, int(first[i]) - overlap)
        at = starts[k] if k < first[i] else int(p)
        own = bisect_right(starts, int(p) - 1) - 1
        if own >= 0 and p < ends[own]:  # inside a token
            at = max(starts[own], int(p) - overlap)
        begin[i] = 0 if i == 0 else max(at, int(p) - max_chars // 4)
    begin_tok = np.searchsorted(np.array(ends), begin, side="right")
    n = max(-(-len(starts) // max(1, max_tokens - overlap)), -(-len(text) // (max_chars - 0)))
    ideal_t, ideal_c = max(len(starts) / n, 1e-9), len(text) / n
    cost = np.full(len(pos), np.inf)
    back = np.zeros(len(pos), dtype=np.int64)
    cost[0] = 0
    penalty = [0.0, *(PENALTY[k] for k in kinds), 0.0]
    low = 0
    for j in range(1, len(pos)):
        while low < j - 1 and (past[j] - begin_tok[low] > max_tokens or pos[j] - begin[low] > max_chars):
            low += 1
        span = slice(low, j)
        size = np.maximum((past[j] - past[span]) / ideal_t, (pos[j] - pos[span]) / ideal_c)
        fits = (past[j] - begin_tok[span] <= max_tokens) & (pos[j] - begin[span] <= max_chars)
        total = np.where(fits, cost[span] + (1 - size) ** 2 + 0.05, np.inf)
        k = int(np.argmin(total))
        if not np.isfinite(total[k]):
            raise ValueError(f"no cut keeps a piece within {max_tokens} tokens and {max_chars} code points")
        cost[j], back[j] = total[k] + penalty[j], low + k
    pieces, j = [], len(pos) - 1
    while j > 0:
        i = int(back[j])
        kind = "end" if j == len(pos) - 1 else kinds[j - 1]
        pieces.append((int(begin[i]), int(pos[j]), int(past[j] - begin_tok[i]), kind))
        j = i
    return pieces[::-1]


def count_tokens(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def _headings_at(text: str, pieces: list, given: list[str] | None) -> list[list[str]]:
    found = [(m.start(), next(g for g in m.groups() if g).strip()) for m in HEADING.finditer(text)]
    at = [p for p, _ in found]
    out = []
    for start, *_ in pieces:
        k = bisect_right(at, start)
        own = [found[k - 1][1]] if k else []
        out.append([h for h in (given or []) if h] + [h for h in own if h not in (given or [])])
    return out


PIECES = (
    "item_type string, item_id string, piece int, start int, end int, token_count int, "
    "overlap_chars int, cut string, headings array<string>, content string"
)


def split_oversized(
    items: DataFrame, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of every oversized item of (item_type, item_id, content[, headings]).

    A text of at most ``max_tokens`` code points cannot exceed either limit, so the
    JVM drops those rows before any reaches Python.
    """
    if not 0 <= overlap < max_tokens // 2:
        raise ValueError("overlap must be under half of max_tokens")
    headings = "headings" if "headings" in items.columns else F.lit(None).cast("array<string>").alias("headings")
    big = items.where(F.length("content") > min(max_tokens, max_chars)).select("item_type", "item_id", "content", headings)

    def make():
        def step(cols):
            out = {k: [] for k in ("item_type", "item_id", "piece", "start", "end", "token_count", "overlap_chars", "cut", "headings", "content")}
            for kind, ident, text, heads in zip(cols["item_type"], cols["item_id"], cols["content"], cols["headings"]):
                if len(text) <= max_chars and count_tokens(text) <= max_tokens:
                    continue
                pieces = split_text(text, max_tokens, max_chars, overlap)
                reached = 0
                for i, ((a, b, n, cut), hs) in enumerate(zip(pieces, _headings_at(text, pieces, heads))):
                    row = (kind, ident, i, a, b, n, max(0, reached - a), cut, hs, text[a:b])
                    for k, v in zip(out, row):
                        out[k].append(v)
                    reached = b
            return out

        return step

    return map_batches(big, make, PIECES)
