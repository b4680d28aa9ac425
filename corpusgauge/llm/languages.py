"""Problem 4: the languages a document is written in, against its label.

Multinomial naive Bayes over hashed character n-grams (n = 1 to 4, words padded by
spaces). The log-probability matrix (``BUCKETS`` by languages, float32) goes to the tasks as
one broadcast; a batch's n-gram rows are gathered and summed by sentence with numpy.

Width and compatibility forms are undone first. Code, markup, addresses and short quotations are taken out first; the rest is cut at
sentence ends and lines, pieces too short to judge join their neighbour. A document is
written in a language if its sentences hold at least ``MIN_SHARE`` of the letters of the
document's prose; pieces under ``MIN_LETTERS`` letters are too short to judge and go with a
neighbour. The languages are those of the labelled rows; the model is fitted on at most
``SAMPLE_PER_LANGUAGE`` rows of each, chosen by a hash of the key, and so are the scripts each uses.

A label that names a language without labelled rows is a label, not a missing one: its
document counts as wrongly labelled only if the text fits the language found as well as
that language's own rows do. A text in a script that no modelled language uses is in none of them.

A null, empty or letterless content is written in no language and gives no row.
Repeated rows give one result.
"""

from __future__ import annotations

import locale
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .lookalikes import plain_form

#: Language codes by their other names; fixed values. More names and codes come from the locale names Python knows.
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "it": "it ita italian",
    "es": "es spa spanish castilian", "tr": "tr tur turkish", "zh": "zh zho chi cmn chinese mandarin",
    "ja": "ja jpn japanese", "ar": "ar ara arb arabic", "hi": "hi hin hindi", "th": "th tha thai",
}


def _known_names() -> dict[str, str]:
    """Name or code -> code, of the languages with a locale."""
    found = {}
    for name, value in locale.locale_alias.items():
        code, head = value.split("_")[0].lower(), re.split(r"[_.@-]", name)[0]
        if re.fullmatch("[a-z]{2,3}", code):
            found[code] = code
            if re.fullmatch("[a-z]{4,}", head):
                found.setdefault(head, code)
    return found


CODE = _known_names() | {n: c for c, names in NAMES.items() for n in names.split()}
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
MIN_SHARE = 0.10
SAMPLE_PER_LANGUAGE = 400
MIN_LETTERS = 18
SURE = 0.98  # below it a piece goes with the document's main language
SMOOTHING = 0.1

FENCED = re.compile(r"^(`{3,}|~{3,})[^\n]*\n.*?(?:^\1[`~]*[ \t]*$|\Z)", re.M | re.S)
BLOCKS = re.compile(
    r"<(pre|script|style|syntaxhighlight|source|code|math|nowiki|table)\b[^>]*>.*?</\1\s*>"
    r"|\\begin\{(lstlisting|verbatim|minted|equation\*?|align\*?|tabular|displaymath)\}.*?\\end\{\2\}"
    r"|<!--.*?-->|\$\$.*?\$\$|\\\[.*?\\\]|\{\|.*?\n\|\}|\{\{[^{}]*\}\}",
    re.S | re.I,
)
INLINE = re.compile(
    r"[A-Za-z0-9+]{32,}|`[^`\n]*`|\$[^$\n]{1,80}\$|</?[a-zA-Z][^<>]{0,300}>|&[#\w]{1,10};|\[\[(?:[^\[\]|]*\|)?"
    r"|(?<![!-~])[!-.0-<>?A-\[\]^`-~]*[/\\=_@][!-~]*"  # addresses, paths, commands: from the start of an ASCII run only
)
CODE_LINE = re.compile(r"^[^\t\n]*\t[^\t\n]*\t.*$|^(?:[ ]{4,}|\t).*$|^\s*[|!].*$|^.*(?:[{};]|&&|\|\|)\s*$|^\s*(?:def|class|import|return|SELECT|FROM|WHERE|for|if|run|sudo|curl|\$)\b.*[(){}=;].*$", re.M)
QUOTES = re.compile(r"\"([^\"\n]{2,120})\"|“([^”\n]{2,120})”|„([^“”\n]{2,120})[“”]|«([^»\n]{2,120})»|「([^」\n]{2,80})」|『([^』\n]{2,80})』")
CUT = re.compile(r"(?<=[.!?؟।])[\"”’»)]*\s+(?=[^\sa-z])|(?<=[。！？])|\n+|\r")
#: Scripts by their letters; a text with a fifth of its letters in one is in a language that uses it.
SCRIPTS = ("[\u3040-ヿ]", "[㐀-鿿]", "[\u0600-\u06ff]", "[\u0900-\u097f]", "[ก-๛]", "[Ͱ-Ͽ]", "[\u0400-ԯ]", "[\u0590-\u05ff]", "[ᄀ-ᇿ가-힯]", "[\u0980-\u0dff]", "[԰-֏]", "[Ⴀ-ჿ]")
NOT_LATIN = re.compile("[\u0370-\uffff]")
USES_SCRIPT = 0.02  # of a language's letters
UNKNOWN = "und"
MISFIT = 6.0  # standard deviations under the mean of a language's own rows
LETTER = re.compile(r"[^\W\d_]")


def language_code(label: str | None) -> str | None:
    """Two-letter code of a label: a code with or without region or script, or an English name."""
    if not label:
        return None
    head = re.split(r"[-_ ]", label.strip().lower())[0]
    return CODE.get(label.strip().lower()) or CODE.get(head)


def label_code(column: Column) -> Column:
    """``language_code`` as a column expression."""
    mapping = F.create_map(*(F.lit(x) for kv in CODE.items() for x in kv))
    low = F.lower(F.trim(column))
    return F.coalesce(F.try_element_at(mapping, low), F.try_element_at(mapping, F.regexp_extract(low, r"^([a-z]+)", 1)))


def prose(text: str) -> str:
    """The text without code, markup, formulas and addresses; lengths may change."""
    if "```" in text or "~~~" in text:
        text = FENCED.sub("\n", text)
    if "<" in text or "\\" in text or "$$" in text or "{" in text:
        text = BLOCKS.sub("\n", text)
    text = CODE_LINE.sub("", text)
    return INLINE.sub(" ", text)


def segments(text: str) -> list[tuple[int, int, int]]:
    """Pieces of prose to judge as (start, end, letters); short ones join a neighbour."""
    out: list[list[int]] = []
    at = 0
    for m in [*CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        n = len(LETTER.findall(text, at, end))
        if n:
            if out and (n < MIN_LETTERS or out[-1][2] < MIN_LETTERS):
                out[-1][1] = end
                out[-1][2] += n
            else:
                out.append([at, end, n])
        at = m.end() if m else end
    return [tuple(s) for s in out]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased letters with single spaces between words, and row starts."""
    parts = [" " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " " for t in texts]
    sizes = np.array([len(p) for p in parts])
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return code, np.r_[0, np.cumsum(sizes)[:-1]]


def _buckets(code: np.ndarray, order: int) -> np.ndarray:
    n = len(code) - order + 1
    with np.errstate(over="ignore"):
        h = np.full(max(n, 0), order, dtype=np.uint64)
        for k in range(order):
            h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(24)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def count_ngrams(texts: list[str]) -> np.ndarray:
    """Bucket counts of all texts together."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    if texts:
        code, _ = _codes(texts)
        for order in ORDERS:
            total += np.bincount(_buckets(code, order), minlength=BUCKETS)
    return total


class Model:
    """Log-probabilities of n-gram buckets by language; ``users`` names the languages of each script, ``usual`` the mean and
    deviation of the log-probability of an n-gram in a language's own rows."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = SMOOTHING, users: dict[str, frozenset[str]] | None = None):
        self.languages = sorted(counts)
        self.users = users or {}
        self.usual: dict[str, tuple[float, float]] = {}
        if not counts:  # nothing to learn from: no text gets a language
            self.log = np.zeros((BUCKETS, 0), dtype=np.float32)
            return
        table = np.stack([counts[x] for x in self.languages], axis=1).astype(np.float64)
        table *= table.sum(axis=0).max() / np.maximum(table.sum(axis=0), 1)  # unseen n-grams cost the same everywhere
        table += smoothing
        self.log = np.log(table / table.sum(axis=0)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean log-probability of an n-gram of each text under each language, and n-gram counts."""
        code, starts = _codes(texts)
        total = np.zeros((len(texts), len(self.languages)), dtype=np.float64)
        for order in ORDERS:
            rows = self.log[_buckets(code, order)]
            if len(rows):
                total += np.add.reduceat(rows, np.minimum(starts, len(rows) - 1), axis=0)
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, confidence and log-probability of each text; n-grams overlap, so evidence is tempered by their number."""
        if not texts:
            return [], [], []
        total = self.score(texts)
        unknown = set()
        for i, text in enumerate(texts):
            if self.users and NOT_LATIN.search(text):
                for script, users in self.users.items():
                    if 5 * len(re.findall(script, text)) > len(LETTER.findall(text)):
                        if users:
                            total[i, [k for k, x in enumerate(self.languages) if x not in users]] -= 1e6
                        else:
                            unknown.add(i)
                        break
        z = (total - total.max(axis=1, keepdims=True)) / (2 * len(ORDERS))
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        at = p.argmax(axis=1)
        rows = np.arange(len(at))
        return [UNKNOWN if i in unknown else self.languages[k] for i, k in enumerate(at)], p[rows, at].round(6).tolist(), total[rows, at].tolist()

    def fits(self, language: str, total: float, letters: int) -> bool:
        """Whether a text is as likely in a language as that language's own rows."""
        mean, spread = self.usual.get(language, (-np.inf, 0.0))
        return total / max(letters, 1) >= mean - MISFIT * spread


def fit(labelled: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model from at most ``per_language`` rows of each language (lowest hashes of the key).

    Rows are chosen by a threshold on the hash, from the number of rows a language has, so no language meets in one task.
    """
    every = 1 << 30
    rows = labelled.select(F.pmod(F.xxhash64(key), F.lit(every)).alias("k"), F.col(text).alias("text"), label_code(F.col(label)).alias("code")).where("code is not null and length(text) > 100")
    counts = {r.code: r["count"] for r in rows.groupBy("code").count().collect()}
    if not counts:
        return Model({})
    wanted = per_language + 6 * per_language**0.5
    limit = F.create_map(*(F.lit(x) for c, n in sorted(counts.items()) for x in (c, int(every * min(1.0, wanted / n)))))
    chosen: dict[str, list[tuple[int, str]]] = {}
    for r in rows.where(F.col("k") < F.element_at(limit, F.col("code"))).collect():
        chosen.setdefault(r.code, []).append((r.k, r.text))
    texts = {c: [QUOTES.sub(" ", prose(t)) for _, t in sorted(v)[:per_language]] for c, v in sorted(chosen.items())}
    letters = {c: max(1, sum(len(LETTER.findall(t)) for t in v)) for c, v in texts.items()}
    users = {s: frozenset(c for c, v in texts.items() if sum(len(re.findall(s, t)) for t in v) >= USES_SCRIPT * letters[c]) for s in SCRIPTS}
    held = Model({c: count_ngrams(v[len(v) // 8 :]) for c, v in texts.items()})
    model = Model({c: count_ngrams(v) for c, v in texts.items()}, users=users)
    for k, c in enumerate(held.languages):
        own = texts[c][: len(texts[c]) // 8]
        if len(own) >= 8:
            each = held.score(own)[:, k] / np.maximum([len(LETTER.findall(t)) for t in own], 1)
            model.usual[c] = (float(each.mean()), float(each.std()))
    return model


class Judge:
    """Segments and languages of whole contents."""

    def __init__(self, model: Model, min_share: float = MIN_SHARE):
        self.model, self.min_share = model, min_share

    def batch(self, contents: list[str | None]) -> list[list[tuple[int, str, float, float]]]:
        """Of each content its prose segments as (letters, language, confidence, log-probability), in order."""
        texts, owner, letters = [], [], []
        for i, content in enumerate(contents if self.model.languages else []):
            if content:
                text = QUOTES.sub(" ", prose(plain_form(content)))
                for a, b, n in segments(text):
                    texts.append(text[a:b])
                    owner.append(i)
                    letters.append(n)
        out: list[list[tuple[int, str, float, float]]] = [[] for _ in contents]
        for i, n, *found in zip(owner, letters, *self.model.predict(texts)):
            out[i].append((n, *found))
        return [self._settle(pieces) for pieces in out]

    @staticmethod
    def _settle(pieces: list[tuple[int, str, float, float]]) -> list[tuple[int, str, float, float]]:
        """Pieces that are not sure by themselves (names, addresses) go with the document."""
        main: Counter = Counter()
        for n, language, confidence, _ in pieces:
            main[language] += n * confidence
        if len(main) < 2:
            return pieces
        own = main.most_common(1)[0][0]
        return [(n, x if c >= SURE else own, c, t) for n, x, c, t in pieces]

    def languages(self, pieces: list[tuple[int, str, float, float]]) -> dict[str, tuple[float, float, bool]]:
        """Languages of a document with their share of letters, mean confidence, and whether the text fits them."""
        total = sum(n for n, *_ in pieces)
        share: Counter = Counter()
        sure: Counter = Counter()
        like: Counter = Counter()
        for n, language, confidence, t in pieces:
            share[language] += n
            sure[language] += n * confidence
            like[language] += t
        return {x: (n / total, sure[x] / n, self.model.fits(x, like[x], n)) for x, n in share.items() if x != UNKNOWN and n >= self.min_share * total}


def document_languages(documents: DataFrame, model: Model) -> DataFrame:
    """(document_id, label_code, language, share, confidence, fits, languages), one row a language."""
    names = ("document_id", "label_code", "language", "share", "confidence", "fits", "languages")
    spread = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = Judge(spread.value)

        def step(cols):
            rows = []
            for ident, label, pieces in zip(cols["id"], cols["language"], judge.batch(cols["content"])):
                found = judge.languages(pieces) if pieces else {}
                rows.extend((ident, language_code(label), x, *of, len(found)) for x, of in found.items())
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    schema = "document_id string, label_code string, language string, share double, confidence double, fits boolean, languages int"
    return map_batches(documents.select("id", "language", "content").where("content is not null"), make, schema, rows=500)


def document_segments(documents: DataFrame, model: Model) -> DataFrame:
    """(document_id, segment, language, confidence, letters): runs of prose in one language."""
    names = ("document_id", "segment", "language", "confidence", "letters")
    spread = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        judge = Judge(spread.value)

        def step(cols):
            rows = []
            for ident, pieces in zip(cols["id"], judge.batch(cols["content"])):
                runs: list[list] = []
                for n, language, sure, _ in pieces:
                    if runs and runs[-1][0] == language:
                        runs[-1][1] += n
                        runs[-1][2] += n * sure
                    else:
                        runs.append([language, n, n * sure])
                rows.extend((ident, i, x, w / n, n) for i, (x, n, w) in enumerate(runs))
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    schema = "document_id string, segment int, language string, confidence double, letters bigint"
    return map_batches(documents.select("id", "content").where("content is not null"), make, schema, rows=500)


def mislabelled(documents: DataFrame, model: Model) -> DataFrame:
    """(document_id, language) of documents whose label is missing, wrong or one of several languages."""
    found = document_languages(documents, model)
    wrong = (F.col("label_code") != F.col("language")) & (F.col("fits") | F.col("label_code").isin(*model.languages))
    case = F.col("label_code").isNull() | (F.col("languages") > 1) | wrong
    return found.where(case).select("document_id", "language").distinct()
