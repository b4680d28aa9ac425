"""Problem 6, method named: equivalence-class template deduction over the pages of a host.

1. Tokens (tags, words, signs) that occur equally often on the same pages of a host form an equivalence class: one
   grouping of (host, token) on an order-free fingerprint of the occurrence vector, so a host's pages need not meet in a task.
2. A class is valid if its tokens keep their order, instance after instance, on ``MIN_ORDERED`` of its pages.
3. A class lies in a gap of another one if all its occurrences on a page do; the gap most of its pages agree on nests it there.
4. What stands between the tokens of valid classes on a page are its slots.

A class needs two tokens, ``MIN_SUPPORT`` pages and ``MIN_SHARE`` of its host's pages; so a host has at most
1 / ``MIN_SHARE`` times as many such tokens as a page has on average, which bounds what is gathered for a host. Repeated rows of a
page count once. Null and empty contents are no pages.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches

TOKEN = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|[^\W_]+(?:-\w+)*|[^\w\s]")
MIN_SUPPORT = 3
MIN_SHARE = 0.05
MIN_ORDERED = 0.95
MIN_NESTED = 0.9


def pages_of(documents: DataFrame) -> DataFrame:
    """(host, page, content), each page once; the host is the page's source."""
    rows = documents.select(F.col("source.source_id").alias("host"), F.col("id").alias("page"), "content").where("host is not null and page is not null and content <> ''")
    return rows.dropDuplicates(["host", "page"])


def classes(pages: DataFrame, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, class_id, support, tokens): tokens of equal occurrence vectors, in order of their mean first place."""
    names = ("host", "token", "count", "place", "page")

    def make():
        def step(cols):
            rows = []
            for host, page, text in zip(cols["host"], cols["page"], cols["content"]):
                seen: dict[str, list[int]] = {}
                for i, m in enumerate(TOKEN.finditer(text)):
                    seen.setdefault(m.group(), [0, i])[0] += 1
                total = sum(n for n, _ in seen.values())
                rows.extend((host, token, n, i / total, page) for token, (n, i) in seen.items())
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    tokens = map_batches(pages, make, "host string, token string, count int, place double, page string", rows=200)
    by_token = tokens.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.sum(F.xxhash64("page", "count").cast("decimal(20,0)")).cast("string").alias("vector"), F.avg("place").alias("place")
    )
    size = pages.groupBy("host").agg(F.count("*").alias("pages"))
    shared = by_token.where(F.col("support") >= min_support).join(size, "host").where(F.col("support") >= min_share * F.col("pages"))
    grouped = shared.groupBy("host", "vector", "support").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t"))
    return grouped.where(F.size("t") > 1).select("host", F.concat_ws(":", "vector", "support").alias("class_id"), "support", F.col("t.token").alias("tokens"))


def _located(text: str, groups: list[tuple[str, list[str]]]) -> dict[str, list[tuple[int, int, int]]]:
    """Of each class that is ordered on the page, its tokens as (start, end, number in the class)."""
    owner = {t: (ident, k) for ident, tokens in groups for k, t in enumerate(tokens)}
    places: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for m in TOKEN.finditer(text):
        if m.group() in owner:
            ident, k = owner[m.group()]
            places[ident].append((m.start(), m.end(), k))
    size = {ident: len(tokens) for ident, tokens in groups}
    return {ident: p for ident, p in places.items() if len(p) % size[ident] == 0 and all(k == i % size[ident] for i, (_, _, k) in enumerate(p))}


def _gap(inner: list[tuple[int, int, int]], outer: list[tuple[int, int, int]], size: int) -> tuple[int, int] | None:
    """(gap, width) of the one gap of the outer class, whatever its instance, that holds all of the inner class."""
    gaps, width, at = set(), 0, 0
    for start, end, _ in inner:
        while at < len(outer) and outer[at][1] <= start:
            at += 1
        if not at or at == len(outer) or outer[at][0] < end or outer[at][2] == 0:
            return None  # outside of an instance
        gaps.add(outer[at][2])
        width = max(width, outer[at][0] - outer[at - 1][1])
    return (gaps.pop(), width) if len(gaps) == 1 and size > 1 else None


def _with_classes(pages: DataFrame, found: DataFrame) -> DataFrame:
    per_host = found.groupBy("host").agg(F.collect_list(F.to_json(F.struct("class_id", "tokens"))).alias("classes"))
    return pages.join(per_host, "host")


def _groups(rows: list[str], cache: dict) -> list[tuple[str, list[str]]]:
    import json

    key = tuple(rows)
    if key not in cache:
        cache.clear()
        cache[key] = [(r["class_id"], r["tokens"]) for r in map(json.loads, sorted(rows))]
    return cache[key]


def templates(documents: DataFrame, min_support: int = MIN_SUPPORT, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, class_id, support, tokens, parent, gap): the valid classes; ``parent`` and ``gap`` tell in which gap of which class one lies, null at the top."""
    pages = pages_of(documents)
    found = classes(pages, min_support, min_share)
    names = ("host", "class_id", "parent", "gap")

    def make():
        cache: dict = {}

        def step(cols):
            rows = []
            for host, text, listed in zip(cols["host"], cols["content"], cols["classes"]):
                groups = _groups(listed, cache)
                size = {ident: len(tokens) for ident, tokens in groups}
                located = _located(text, groups)
                for ident, inner in located.items():
                    around = [(g[1], other, g[0]) for other, outer in located.items() if other != ident and outer[0][0] < inner[0][0] and outer[-1][1] > inner[-1][1] and (g := _gap(inner, outer, size[other]))]
                    _, parent, gap = min(around) if around else (0, None, None)
                    rows.append((host, ident, parent, gap))
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    seen = map_batches(_with_classes(pages, found), make, "host string, class_id string, parent string, gap int", rows=200)
    votes = seen.groupBy("host", "class_id", "parent", "gap").agg(F.count("*").alias("n"))
    own = Window.partitionBy("host", "class_id")
    best = votes.withColumn("ordered", F.sum("n").over(own)).withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "parent", "gap"))).where("place = 1")
    valid = found.join(best, ["host", "class_id"]).where(F.col("ordered") >= MIN_ORDERED * F.col("support"))
    kept = valid.select("host", F.col("class_id").alias("parent"), F.lit(True).alias("known"))
    nested = (F.col("n") >= MIN_NESTED * F.col("ordered")) & F.coalesce("known", F.lit(False))
    return valid.join(kept, ["host", "parent"], "left").select("host", "class_id", "support", "tokens", F.when(nested, F.col("parent")).alias("parent"), F.when(nested, F.col("gap")).alias("gap"))


def slots(documents: DataFrame, valid: DataFrame) -> DataFrame:
    """(host, page, slot, after, content): the text between two neighbouring template tokens of a page, numbered in order; ``after`` is the token before it."""
    names = ("host", "page", "slot", "after", "content")

    def make():
        cache: dict = {}

        def step(cols):
            rows = []
            for host, page, text, listed in zip(cols["host"], cols["page"], cols["content"], cols["classes"]):
                marks = sorted((a, b) for p in _located(text, _groups(listed, cache)).values() for a, b, _ in p)
                at, before, n = 0, "", 0
                for a, b in [*marks, (len(text), len(text))] if marks else ():
                    if between := text[at:a].strip():
                        rows.append((host, page, n, before, between))
                        n += 1
                    at, before = b, text[a:b]
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    return map_batches(_with_classes(pages_of(documents), valid), make, "host string, page string, slot int, after string, content string", rows=200)
