"""Problem 5: near-duplicate chunks over a collection too large for all pairs.

Similarity is the Jaccard coefficient of the distinct 9-code-point substrings of the
stored text. Equal texts collapse into one class first, so copies cost nothing
further. Each class gets

* a parity sketch of ``SKETCH_BITS`` bits: bit i is the parity of the number of its substrings
  that hash to i. The exclusive-or of two sketches is the sketch of the symmetric
  difference, so its bit count never exceeds that difference: two classes at
  or above the threshold t always differ in at most (1-t)/(1+t) (|A|+|B|) bits;
* one-permutation MinHash minima (densified) in ``BANDS`` bands of ``ROWS``.

Classes that share a band form a block; blocks of one are dropped before any sketch
moves. Comparison is tiled: a block of more than ``TILE`` classes is cut by a hash into parts, every
pair of parts is a unit of work of its own (no block is ranked or held in one task, and a
class is copied at most ``SPLITS`` times until a part would pass ``PART`` classes), a unit is sorted by
set size and cut into tiles, and tile pairs, then row pairs, whose sizes differ beyond the radius are
skipped; the rest is compared by numpy exclusive-or and bit counts. Survivors are verified
on the substring sets. The sketch test loses nothing; the blocks lose a pair of
similarity exactly 0.70 with probability 0.0003, under 0.00001 at 0.75.

Comparing all tile pairs of the collection instead of blocks would be quadratic; the
method named is used within blocks for that reason. Null texts and texts under
``MIN_CHARS`` take no part. A class is known by 128 bits of a cryptographic hash of its text;
blocks carry 64-bit numbers, and texts that agree in these alone are told apart and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

WIDTH = 9
THRESHOLD = 0.70
MIN_CHARS = 150
BANDS, ROWS = 64, 6
SKETCH_BITS = 1024
TILE = 1024
SPLITS, PART = 32, 1 << 18
COPIES = 1000  # equal chunks paired in one piece of work


def substring_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the substrings of ``width`` code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


class Signer:
    """Sizes, sketches and band keys of a batch of texts."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.bins = bands * rows
        rng = np.random.default_rng(11)
        self.probes = [rng.permutation(self.bins) for _ in range(200)]

    def sign(self, texts: list[str]) -> tuple[list[int], list[bytes], np.ndarray]:
        sets = [substring_hashes(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        bit = row * self.bits + (flat & np.uint64(self.bits - 1)).astype(np.int64)
        parity = (np.bincount(bit, minlength=len(sets) * self.bits) & 1).astype(np.uint8)
        sketches = np.packbits(parity.reshape(len(sets), self.bits), axis=1)
        code = row * self.bins + (((flat >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        least = np.zeros(len(sets) * self.bins, dtype=np.uint64)
        full = np.zeros(len(sets) * self.bins, dtype=bool)
        least[code[first]], full[code[first]] = flat[first], True
        least, full = least.reshape(len(sets), -1), full.reshape(len(sets), -1)
        r, b = np.nonzero(~full)
        with np.errstate(over="ignore"):
            for turn, probe in enumerate(self.probes):  # an empty bin borrows from the first full one it probes
                if not len(r):
                    break
                hit = full[r, probe[b]]
                lent = least[r[hit], probe[b[hit]]]
                least[r[hit], b[hit]] = lent * np.uint64(2 * turn + 3)
                r, b = r[~hit], b[~hit]
            least = least.reshape(len(sets), self.bands, self.rows)
            key = np.arange(self.bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
            for k in range(self.rows):
                key = (key ^ least[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
        return sizes.tolist(), [s.tobytes() for s in sketches], key.view(np.int64)


def _classes(chunks: DataFrame, min_chars: int) -> DataFrame:
    """(class_id, number, text) of every eligible row; rows of a class repeat."""
    text = F.col("normalized_content")
    return chunks.where(F.length(text) >= min_chars).select(_class_id(text).alias("class_id"), _number(text).alias("number"), text.alias("text"))


def _class_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _number(text: Column) -> Column:
    return F.xxhash64(text)


def _compare(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows (broadcast against each other) can be at or above the threshold."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return differ <= (1 - threshold) / (1 + threshold) * (sa + sb) + 1e-9


def compare_blocks(table: pa.Table, threshold: float, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole groups sorted by (block, left tile, right tile, size).

    Small groups are compared diagonal by diagonal for all groups at once, large ones
    tile against tile.
    """
    ids = table["number"].to_numpy()
    size = table["size"].to_numpy().astype(np.int64)
    side = table["tile"].to_numpy()
    words = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
    group = [table[n].to_numpy() for n in ("block", "left", "right")]
    start = np.flatnonzero(np.r_[True, np.any([g[1:] != g[:-1] for g in group], axis=0)])
    length = np.diff(np.r_[start, len(ids)])
    left, right = [], []
    small = length <= tile
    number = np.repeat(np.where(small, np.arange(len(start)), -1), length)
    cross = np.repeat(group[1][start] != group[2][start], length)
    for d in range(1, int(length[small].max(initial=1))):
        i = np.flatnonzero((number[d:] == number[:-d]) & (number[d:] >= 0))
        if not len(i):
            break
        j = i + d
        near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        near &= ~cross[i] | (side[i] != side[j])
        i, j = i[near], j[near]
        ok = _compare(words[i], size[i], words[j], size[j], threshold)
        left.append(i[ok])
        right.append(j[ok])
    for s, n in zip(start[~small], length[~small]):
        apart = group[1][s] != group[2][s]
        for x in range(s, s + n, tile):
            xe = min(x + tile, s + n)
            for y in range(x, s + n, tile):
                ye = min(y + tile, s + n)
                low, high = size[x:xe], size[y:ye]
                if low.max() < threshold * high.min():
                    break  # this tile's counts and those of all later ones differ beyond the radius
                ok = _compare(words[x:xe, None], low[:, None], words[None, y:ye], high[None, :], threshold)
                ok &= np.minimum(low[:, None], high[None, :]) >= threshold * np.maximum(low[:, None], high[None, :])
                if apart:
                    ok &= side[x:xe, None] != side[None, y:ye]
                i, j = np.nonzero(ok)
                keep = i + x < j + y
                left.append(i[keep] + x)
                right.append(j[keep] + y)
    if not left:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    pairs = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    return pairs[0], pairs[1]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def candidate_pairs(chunks: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, tile: int = TILE) -> DataFrame:
    """(class_a, class_b), numbers of classes: a superset of the pairs of unlike numbers at or above the threshold."""
    classes = _classes(chunks, min_chars).select("number", "text")

    def make():
        signer = Signer()
        seen: set[int] = set()

        def step(cols):
            keep = []
            for i, c in enumerate(cols["number"]):  # copies in one task are signed once
                if c not in seen:
                    if len(seen) < 2_000_000:
                        seen.add(c)
                    keep.append(i)
            if not keep:
                return {"number": [], "size": [], "sketch": [], "bands": []}
            size, sketch, bands = signer.sign([cols["text"][i] for i in keep])
            return {"number": [cols["number"][i] for i in keep], "size": size, "sketch": sketch, "bands": list(bands)}

        return step

    signed = map_batches(classes, make, "number bigint, size int, sketch binary, bands array<bigint>", rows=1000)
    # one exchange by block serves the counts and the rows; rows only stream past, none is ranked or gathered
    # (stated not-null tests keep the two uses alike; else the planner infers one more for the join and the exchange is made twice)
    banded = signed.select("number", F.explode("bands").alias("block")).where("number is not null and block is not null").repartition("block")
    several = banded.groupBy("block").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")).where("low < high").select("block", "n")
    parts = F.least(F.ceil(F.col("n") / tile), F.greatest(F.lit(SPLITS), F.ceil(F.col("n") / PART))).cast("int")
    met = banded.join(several.hint("shuffle_hash"), "block").select("block", "number", parts.alias("parts")).distinct()  # copies signed in several tasks
    shared = met.withColumn("tile", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int"))
    # every part meets every other once: the pair (left, right) is a unit of work
    placed = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", "number", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right")
    )
    sketches = signed.groupBy("number").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    work = (
        placed.join(sketches, "number")
        .repartition("block", "left", "right")
        .sortWithinPartitions("block", "left", "right", "size", "number")
        .select("block", "left", "right", "tile", "number", "size", "sketch")
    )
    names = ["block", "left", "right"]
    out = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            a, b = compare_blocks(pa.Table.from_batches(held), threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(n).to_numpy() for n in names]
            last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # where the batch's last group begins
            if held and (cut or any(held[-1].column(n)[-1].as_py() != k[0].item() for n, k in zip(names, key))):
                if cut:
                    held.append(batch.slice(0, cut))
                yield flush()
                held = [batch.slice(cut)]
            else:
                if cut:
                    held = [batch.slice(0, cut)]
                    yield flush()
                    held = [batch.slice(cut)]
                else:
                    held.append(batch)
        if held:
            yield flush()

    return work.mapInArrow(run, "class_a bigint, class_b bigint").distinct()


def similar_classes(chunks: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(class_a, class_b, similarity), a < b, of all pairs of different texts at or above the threshold."""
    # the texts of a number: one, but for chance agreements; gathered by number, they meet the pairs without another exchange
    texts = _classes(chunks, min_chars).groupBy("number").agg(F.collect_set(F.struct("class_id", "text")).alias("t"))
    alike = texts.where("size(t) > 1").select(F.col("number").alias("class_a"), F.col("number").alias("class_b"))
    pairs = candidate_pairs(chunks, threshold, min_chars).unionByName(alike)
    side = lambda n: texts.select(F.col("number").alias(f"class_{n}"), F.explode("t").alias("t")).select(f"class_{n}", F.col("t.class_id").alias(f"id_{n}"), F.col("t.text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "class_a").join(side("b"), "class_b").where("class_a <> class_b or id_a < id_b")

    def make():
        def step(cols):
            out = {"class_a": [], "class_b": [], "similarity": []}
            sets: dict[str, np.ndarray] = {}
            for a, b, x, y in zip(cols["id_a"], cols["id_b"], cols["text_a"], cols["text_b"]):
                for ident, text in ((a, x), (b, y)):
                    if ident not in sets:
                        sets[ident] = substring_hashes(text)
                s = jaccard(sets[a], sets[b])
                if s >= threshold:
                    out["class_a"].append(min(a, b))
                    out["class_b"].append(max(a, b))
                    out["similarity"].append(s)
            return out

        return step

    return map_batches(both.select("id_a", "id_b", "text_a", "text_b"), make, "class_a string, class_b string, similarity double")


def members(chunks: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(chunk_id, class_id), each once."""
    text = F.col("normalized_content")
    return chunks.where(F.length(text) >= min_chars).select(F.col("id").alias("chunk_id"), _class_id(text).alias("class_id")).distinct()


def equal_chunks(inside: DataFrame, copies: int = COPIES) -> DataFrame:
    """(x, y) of equal chunks, x < y: members of a class are cut by a hash into parts of about ``copies``, and each pair of parts is joined by itself.

    The result has every pair, as p5_found asks; ``groups`` is the form that does not grow with the square of a class.
    """
    several = inside.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id", F.ceil(F.col("n") / copies).cast("int").alias("parts"))
    placed = inside.join(several, "class_id").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = placed.select("class_id", F.col("part").alias("i"), F.col("other").alias("j"), F.col("chunk_id").alias("x"))
    b = placed.select("class_id", F.col("other").alias("i"), F.col("part").alias("j"), F.col("chunk_id").alias("y"))
    return a.join(b, ["class_id", "i", "j"]).where("x < y").select("x", "y")


def similar_chunks(chunks: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(chunk_id_a, chunk_id_b, similarity), a < b, copies expanded."""
    inside = members(chunks, min_chars)
    a = inside.select(F.col("chunk_id").alias("x"), F.col("class_id").alias("class_a"))
    b = inside.select(F.col("chunk_id").alias("y"), F.col("class_id").alias("class_b"))
    equal = equal_chunks(inside).select("x", "y", F.lit(1.0).alias("similarity"))
    near = similar_classes(chunks, threshold, min_chars).join(a, "class_a").join(b, "class_b").select("x", "y", "similarity")
    return (
        equal.unionByName(near.where("x <> y"))
        .select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"), "similarity")
        .groupBy("chunk_id_a", "chunk_id_b")
        .agg(F.max("similarity").alias("similarity"))
    )


def groups(chunks: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a chunk of a group: (chunk_id, class_id, group_id, links, similarity).

    A group is a connected component of classes, or a class of several equal chunks; ``links``
    counts the class's similar other classes, ``similarity`` is the least in its group (1.0 for equal
    texts alone). Copies are never expanded into pairs.
    """
    from ..operators.graph import connected_components
    from ..session import cut

    inside = members(chunks, min_chars)
    pairs = cut(similar_classes(chunks, threshold, min_chars))  # read three times below
    comp = connected_components(pairs, "class_a", "class_b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    least = pairs.join(comp.withColumnRenamed("class_id", "class_a"), "class_a").groupBy("group_id").agg(F.min("similarity").alias("similarity"))
    ends = pairs.select(F.col("class_a").alias("class_id")).unionByName(pairs.select(F.col("class_b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    copies = inside.groupBy("class_id").agg(F.count("*").alias("copies"))
    grouped = comp.join(least, "group_id").join(ends, "class_id")
    known = copies.join(grouped, "class_id", "left").where("group_id is not null or copies > 1")
    one = known.select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.round(F.coalesce("similarity", F.lit(1.0)), 6).alias("similarity"))
    return inside.join(one, "class_id").select("chunk_id", "class_id", "group_id", "links", "similarity")
