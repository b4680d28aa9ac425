"""Column functions over text: built-in expressions, so they stay in codegen; only ``entropy`` counts in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java(pattern: str) -> Column:
    return F.lit(pattern)


def tokens(c: ColumnOrName) -> Column:
    """Words and single other signs, in order."""
    return F.regexp_extract_all(col(c), java(P.TOKEN), F.lit(0))


def token_count(c: ColumnOrName) -> Column:
    return F.size(tokens(c)).cast("bigint")


def fold(c: ColumnOrName) -> Column:
    """Lower case with sharp s spelled out, as full case folding does."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def words(c: ColumnOrName) -> Column:
    return F.regexp_extract_all(fold(c), java(P.WORD), F.lit(0))


def shingles(w: ColumnOrName, k: int = 5) -> Column:
    """Distinct runs of k words of a word array; a shorter one is one run of all its words.

    Takes a computed column: an expression would be evaluated again for every run.
    """
    w = col(w)
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
    whole = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(w) >= k, runs).otherwise(whole))


def newlines(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), "\r\n?", "\n")


def lines(c: ColumnOrName) -> Column:
    return F.split(newlines(c), "\n", -1)


def count_of(c: ColumnOrName, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    text = col(c)
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("bigint")


def mask_secrets(c: ColumnOrName) -> Column:
    out = col(c)
    for pattern, mark in P.MASKS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def replace_controls(c: ColumnOrName) -> Column:
    """Control characters but tab and line ends become U+FFFD."""
    return F.regexp_replace(col(c), r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]", "�")


def visible_markers(c: ColumnOrName) -> Column:
    """Invisible and direction characters become visible names."""
    out = col(c)
    for char, name in P.MARKERS.items():
        out = F.replace(out, F.lit(char), F.lit(f"<{name}>"))
    return out


def truncate(c: ColumnOrName, limit: int, mark: str = "…[truncated]") -> Column:
    text = col(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))).otherwise(text)


def safe_filename(c: ColumnOrName) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9._-]+", "-")
    return F.substring(F.regexp_replace(plain, "^[-.]+|[-.]+$", ""), 1, 120)


def guard_cell(c: ColumnOrName) -> Column:
    """Spreadsheet cells that would be read as formulas get an apostrophe."""
    text = col(c)
    return F.when(text.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def severity(c: ColumnOrName) -> Column:
    """Lower-case severity; null and unknown become info."""
    low = F.lower(F.trim(col(c)))
    return F.when(low.isin(*P.SEVERITY_RANK), low).otherwise(F.lit("info"))


def choose(c: Column, mapping: dict[str, float | int]) -> Column:
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def confidence(c: ColumnOrName) -> Column:
    """Confidence clamped to 0..1; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c), F.lit(0.0))))


def score_band(c: ColumnOrName) -> Column:
    s = col(c)
    return F.when(s < 55, "critical").when(s < 70, "poor").when(s < 85, "warning").when(s.isNotNull(), "healthy")


def luhn(c: ColumnOrName) -> Column:
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def national_id(c: ColumnOrName) -> Column:
    """Eleven digits with two check digits."""
    d = [F.substring(col(c), i + 1, 1).cast("int") for i in range(11)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    first = F.pmod(odd * 7 - even, F.lit(10))
    rest = d[0]
    for x in d[1:10]:
        rest = rest + x
    return (d[9] == first) & (d[10] == F.pmod(rest, F.lit(10)))


def ipv4(c: ColumnOrName) -> Column:
    return F.forall(F.split(col(c), "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)


def entropy(c: ColumnOrName) -> Column:
    """Shannon entropy of the characters, in bits; counted in one pass, so a text of any length takes linear time."""

    @F.pandas_udf("double")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())).astype("float64")

    return counted(col(c))


ROT_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"


def rot13(c: ColumnOrName) -> Column:
    return F.translate(col(c), ROT_FROM, ROT_TO)


def retry_delay(attempt: ColumnOrName) -> Column:
    """Seconds: two to the attempt, at most a minute."""
    return F.least(F.pow(F.lit(2.0), F.least(col(attempt), F.lit(10))), F.lit(60.0)).cast("bigint")


def any_phrase(c: ColumnOrName, phrases: tuple[str, ...]) -> Column:
    low = F.lower(col(c))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p.lower())
    return out


def contains_regex(c: ColumnOrName, *patterns: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | col(c).rlike("(?Uim)" + p)
    return out


def pdf_date(c: ColumnOrName) -> Column:
    """Timestamp of a PDF date such as D:20240131120000Z; null where it is none."""
    digits = F.rpad(F.regexp_extract(col(c), r"^(?:D:)?([0-9]{4,14})", 1), 14, "0")
    full = F.regexp_replace(F.regexp_replace(digits, "^([0-9]{4})00", "$101"), "^([0-9]{6})00", "$101")
    return F.try_to_timestamp(F.when(full.rlike("^[0-9]{14}$") & ~full.rlike("^0000"), full), F.lit("yyyyMMddHHmmss"))


CONTROL_CLASS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}]"


def extraction_flags(c: ColumnOrName) -> Column:
    """What looks wrong with extracted text: control characters, blanks, broken lines, repeated sequences."""
    text = col(c)
    n = F.greatest(F.length(text), F.lit(1))
    controls = F.length(text) - F.length(F.regexp_replace(text, CONTROL_CLASS, ""))
    blanks = F.length(text) - F.length(F.regexp_replace(text, "[ \t\r\n]", ""))
    rows = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(rows, lambda x: F.length(x) <= 3))
    return F.array_compact(F.array(
        F.when(controls > 0.02 * n, F.lit("control_characters")),
        F.when(blanks > 0.65 * n, F.lit("mostly_blank")),
        F.when((F.size(rows) >= 5) & (short > 0.5 * F.size(rows)), F.lit("fragmented_lines")),
        F.when(text.rlike(r"(.{1,4})\1{5,}"), F.lit("repeated_sequence")),
    ))


SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "api-key", "cookie", "set-cookie")


def redact_headers(c: ColumnOrName) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(col(c), lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_HEADERS), F.lit("[REDACTED]")).otherwise(v))


REFERENCE = r"^(?:env|keychain|secret-manager|vault|file-secret):[A-Za-z0-9_./:@-]+$"
SECRET_KEY = r"(?i)(?:authorization|api[_-]?key|(?:access[_-]?)?token|secret|password|credential|cookie)"


def unreferenced_secrets(c: ColumnOrName) -> Column:
    """Keys of a map that name a secret and hold a value that is no reference to one, or that hold a secret-like value."""
    entries = F.map_entries(F.coalesce(col(c), F.create_map().cast("map<string,string>")))
    secret = lambda e: (e.key.rlike(SECRET_KEY) & (F.coalesce(e.value, F.lit("")) != "") & ~F.coalesce(e.value.rlike(REFERENCE), F.lit(False))) | F.coalesce(mask_secrets(e.value) != e.value, F.lit(False))
    return F.array_sort(F.transform(F.filter(entries, secret), lambda e: e.key))


def redact_url(c: ColumnOrName) -> Column:
    """A URL without user data and with sensitive query values replaced; other schemes become about:redacted."""
    url = col(c)
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@?#]*@", "$1")
    clean = F.regexp_replace(bare, r"(?i)([?&](?:token|key|api_key|apikey|secret|password|signature|access_token)=)[^&#]*", "$1[REDACTED]")
    return F.when(F.lower(url).rlike("^https?://"), clean).otherwise(F.lit("about:redacted"))


def base_name(c: ColumnOrName) -> Column:
    return F.regexp_extract(col(c), "[^/\\\\]+$", 0)


def render_template(template: str, values: dict[str, ColumnOrName]) -> Column:
    """A text with ``{{NAME}}`` placeholders filled from columns; unknown names are refused when the plan is built."""
    import re

    unknown = set(re.findall(r"\{\{(\w+)\}\}", template)) - set(values)
    if unknown:
        raise ValueError(f"unknown placeholders: {sorted(unknown)}")
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(col(value).cast("string"), F.lit("")))
    return out
