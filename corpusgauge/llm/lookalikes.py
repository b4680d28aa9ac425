"""Problem 3: one consistent form for visually identical text.

1. Characters that show nothing are deleted (zero-width and word-joining marks, soft
   hyphens, byte order marks, direction marks); a joiner stays inside emoji sequences,
   where it decides what is seen. Elsewhere joiners count as invisible in every script.
2. Compatibility normalization of letters, digits and ligatures (full and half width,
   presentation forms, radicals), one kind of single space, one plain hyphen, LF line
   ends, then canonical composition. Raised and circled characters, ellipses, quotation
   marks and dashes are visible differences and stay.
3. A token with letters that look like another script's becomes a lattice of the
   look-alikes of each place; Viterbi picks the path with the best sum of character
   bigram scores, counted over the whole corpus, and script consistency within the
   token and with the document.

A null content stays null, an empty one empty. Repeated rows give one result.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Letters of the same shape; fixed values, Latin first.
SAME_SHAPE = (
    "aа cсϲ dԁ eе gɡ hһ iі jјϳ oоοօ pр qԛ sѕ vνѵ wԝ xх yу lӏ AАΑ BВΒ CСϹ EЕΕ GԌ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ "
    "WԜ XХΧ YΥҮ ZΖ ГΓ ПΠ ФΦ"
).split()
GROUP = {c: g for g in SAME_SHAPE for c in g}
SPACES = re.compile("[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
HYPHENS = re.compile("[‐‑]")
IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
JOINERS = re.compile("[\u200c\u200d]")
SUSPECT = re.compile("[ɡͰ-ԯհ-և]")  # scripts with letters shaped like others' 
TOKEN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
WIDE = re.compile(
    "[ſⅠ-ⅿ⺀-\u2fdf\u3131-\u318e豈-\ufaffﬀ-ﷹﹰ-ﻼ０-９Ａ-Ｚａ-ｚ"
    "ｦ-ﾟﾡ-ￜ\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f]"
)
VISIBLE_FORMS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<noBreak>", "<vertical>")
COPIES = 1000  # documents of one visible text joined in one piece of work
LIMIT = 0x530  # Latin, Greek and Cyrillic lie below


def _joiner(m: re.Match) -> str:
    text, at = m.string, m.start()
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if not before or not after:
        return ""
    kinds = unicodedata.category(before), unicodedata.category(after)
    if kinds[1] == "So" and kinds[0] in ("So", "Sk"):
        return m.group()
    return ""


def _compatible(m: re.Match) -> str:
    form = unicodedata.decomposition(m.group())
    if form.startswith(VISIBLE_FORMS) or m.group() == "\u017f":
        return m.group()
    return unicodedata.normalize("NFKC", m.group())


def plain_form(text: str) -> str:
    """Steps 1 and 2."""
    if text.isascii():
        return text.replace("\r\n", "\n") if "\r" in text else text
    text = IGNORABLE.sub("", text)
    if JOINERS.search(text):
        text = JOINERS.sub(_joiner, text)
    text = WIDE.sub(_compatible, text)
    text = HYPHENS.sub("-", SPACES.sub(" ", text)).replace("\r\n", "\n")
    return unicodedata.normalize("NFC", text)


def _script(c: str) -> int:
    code = ord(c)
    if code < 0x250:
        return 0
    return 1 if 0x370 <= code < 0x400 else 2 if 0x400 <= code < LIMIT else 3


class Restorer:
    """Step 3 with bigram counts {(code, code): n} of the corpus."""

    def __init__(self, bigrams: dict[tuple[int, int], int], switch: float = 8.0, prior: float = 1.5):
        after: Counter = Counter()
        for (a, _), n in bigrams.items():
            after[a] += n
        self.log = {k: math.log(n + 1) - math.log(after[k[0]] + 200) for k, n in bigrams.items()}
        self.none = {a: -math.log(n + 200) for a, n in after.items()}
        self.floor = -math.log(200)
        self.switch, self.prior = switch, prior
        self.cache: dict[tuple[int, str], str] = {}

    def _score(self, a: str, b: str) -> float:
        x, y = ord(a), ord(b)
        value = self.log.get((x, y))
        value = self.none.get(x, self.floor) if value is None else value
        return value - (self.switch if _script(a) != _script(b) else 0.0)

    def token(self, word: str, main: int) -> str:
        known = self.cache.get((main, word))
        if known is not None:
            return known
        letters = unicodedata.normalize("NFD", word)
        best: dict[str, tuple[float, str]] = {}
        for c in letters:
            if unicodedata.combining(c):
                best = {k: (s, path + c) for k, (s, path) in best.items()}
                continue
            step = {}
            for option in GROUP.get(c, c):
                own = self.prior if _script(option) == main else 0.0
                if best:
                    step[option] = max((s + self._score(k, option) + own, path + option) for k, (s, path) in best.items())
                else:
                    step[option] = (own, option)
            best = step
        out = unicodedata.normalize("NFC", max(best.values())[1])
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[main, word] = out
        return out

    def restore(self, text: str) -> str:
        if text.isascii() or not SUSPECT.search(text):
            return text
        counts = Counter(_script(c) for c in text if c not in GROUP and c.isalpha() and ord(c) < LIMIT)
        main = counts.most_common(1)[0][0] if counts else 0
        return TOKEN.sub(lambda m: self.token(m.group(), main) if SUSPECT.search(m.group()) else m.group(), text)

    def consistent(self, text: str | None) -> str | None:
        return text if text is None else self.restore(plain_form(text))


def corpus_bigrams(documents: DataFrame, column: str = "content") -> dict[tuple[int, int], int]:
    """Counts of adjacent letters below ``LIMIT`` over all documents.

    At most LIMIT squared pairs (one alphabet's worth), whatever the corpus; each task
    sends one row for each pair it met.
    """

    def make():
        def step(cols):
            joined = "\n".join(t for t in cols["content"] if t)
            code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            code = np.where(code < LIMIT, code, 0).astype(np.int64)
            pair = np.bincount(code[:-1] * LIMIT + code[1:]) if len(code) > 1 else np.zeros(1, dtype=np.int64)
            at = np.flatnonzero(pair)
            a, b = at // LIMIT, at % LIMIT
            keep = [chr(x).isalpha() and chr(y).isalpha() for x, y in zip(a.tolist(), b.tolist())]
            return {"a": a[keep].tolist(), "b": b[keep].tolist(), "n": pair[at][keep].tolist()}

        return step

    counted = map_batches(documents.select(F.col(column).alias("content")).where("content is not null"), make, "a int, b int, n bigint", rows=10_000)
    return {(r.a, r.b): r.n for r in counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


def normalize(documents: DataFrame, bigrams: dict[tuple[int, int], int] | None = None, with_text: bool = True) -> DataFrame:
    """(document_id, normalized_content[, hashes]) of every row of (id, content)."""
    counts = corpus_bigrams(documents) if bigrams is None else bigrams
    names = ("document_id", "normalized_content", "content_key", "visible_key")
    spread = documents.sparkSession.sparkContext.broadcast(counts)
    digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def make():
        restorer = Restorer(spread.value)

        def step(cols):
            shown = [restorer.consistent(t) for t in cols["content"]]
            keys = [None if t is None else digest(t) for t in cols["content"]]
            return dict(zip(names, (cols["id"], shown if with_text else [None] * len(shown), keys, [None if t is None else digest(t) for t in shown])))

        return step

    schema = "document_id string, normalized_content string, content_key binary, visible_key binary"
    return map_batches(documents.select("id", "content"), make, schema)


def same_visible_text(documents: DataFrame, copies: int = COPIES) -> DataFrame:
    """(document_id_a, document_id_b), a < b: contents differ, visible text does not.

    Only keys of 16 bytes are shuffled. Groups of one content, however many copies
    it has, drop out before the join; the documents of one visible text are cut by a hash into parts of about
    ``copies``, and each pair of parts is joined by itself. Every pair is a row, as p3_found asks; ``normalize``
    gives the form that does not grow with the square of a group.
    """
    keys = normalize(documents.where("content <> ''"), with_text=False).select("document_id", "content_key", "visible_key").distinct()
    several = (
        keys.groupBy("visible_key").agg(F.min("content_key").alias("x"), F.max("content_key").alias("y"), F.count("*").alias("n")).where("x <> y")
        .select("visible_key", F.ceil(F.col("n") / copies).cast("int").alias("parts"))
    )
    placed = keys.join(several, "visible_key").withColumn("part", F.pmod(F.xxhash64("document_id", "content_key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a = placed.select("visible_key", F.col("part").alias("i"), F.col("other").alias("j"), F.col("document_id").alias("document_id_a"), F.col("content_key").alias("key_a"))
    b = placed.select("visible_key", F.col("other").alias("i"), F.col("part").alias("j"), F.col("document_id").alias("document_id_b"), F.col("content_key").alias("key_b"))
    return a.join(b, ["visible_key", "i", "j"]).where("document_id_a < document_id_b and key_a <> key_b").select("document_id_a", "document_id_b").distinct()
