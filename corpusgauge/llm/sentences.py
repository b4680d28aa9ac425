"""Problem 9: sentence units across languages and scripts.

Document-centred disambiguation. A full stop after a word is ambiguous; whether the
word is an abbreviation, and whether a capitalised word after it is a proper name or a
sentence start, is decided first from unambiguous occurrences elsewhere in the same
document (the word with a full stop and a small letter, digit or comma behind it; the
next word written small). Where the document says nothing, counts over the whole corpus
decide: how often the word has a full stop and how often that ends nothing; which words are
mostly written small, and which begin sentences. Short lists of known abbreviations speak
only where both are silent: the document has the word nowhere without a full stop, and the corpus
has it hardly ever (under ``COUNTED`` times in all) or always with a full stop before capitals, as titles are,
which counts cannot tell from the last words of sentences. Terminators are script-specific: ideographic stops need no space,
the danda and the Arabic question mark end units, Thai units end at a space between
Thai letters. Quotations and brackets are paired within the paragraph; a stop inside
them ends a unit only if the pair itself is at its end, however long the pair. Time is
linear in the length of a text.

A blank line ends a unit; a list line with its mark is one unit; other line breaks
(LF, CR LF, CR) end nothing. Null, empty and blank texts have no units. Repeated
documents give one row per unit.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

COUNTED = 20  # uses in the corpus from which its counts replace the lists
STARTER_SHARE = 0.002  # of all capitals after full stops; so there are at most 500 starters
RARE_SHARE = 1e-6  # words rarer than this among all counted words are left out, so a lexicon has at most a million words

# Abbreviations assumed before anything is counted, and words that then tell a sentence start.
TITLES = frozenset("mr mrs ms dr prof st sr sra srta dott sig hr fr mme mlle m d ing av sayın lic د डॉ श\u094dरी".split())
BEFORE_NUMBER = frozenset("no nr fig figs sec sect p pp pag pág abs art vol ch kap s bd zif ziff núm num n cap ex eq tab".split())
COMMON = frozenset(
    "i.e e.g cf vs approx ca gem lt bzw bkz örn cfr v resp evtl ggf inkl vgl z.b d.h u.a ad es p.ex ej bsp dept est al max min".split()
)
CAN_END = frozenset("etc usw ecc vb vs inc ltd co corp u.s u.k e.u a.m p.m ff jr dgl vd plc gmbh bros".split())
STARTERS = frozenset("the a an he she it we they this that these those in on at for if when then there but and so der die das ein eine es er sie wir le la les un une il elle el los las bu bir".split())
BEFORE_NAMES = TITLES | BEFORE_NUMBER | COMMON
GERMAN_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

PARAGRAPH = re.compile(r"(?:\r\n|[\n\r\x85\u2028])[ \t\u00a0\u3000]*(?:(?:\r\n|[\n\r\x85\u2028])[ \t\u00a0\u3000]*)+|\u2029")
LINE = re.compile(r"\r\n|[\n\r\x85\u2028]")
BULLET = re.compile(r"[ \t]*(?:[-*+•◦▪‣·–—][ \t\u3000]+(?=\S)|(\d{1,3}[.)]|[(]\d{1,3}[)]|[a-zA-Z][)])[ \t\u3000]+(?=\S)|\d{1,3}、)")
STOP = re.compile(r"[.!?…。！？｡．؟।॥]+")
PAIRED = re.compile(r"[\"“”„«»‹›「」『』()（）\[\]【】〈〉《》]")
OPEN = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "〈": "〉", "《": "》"}
BRACKETS = "(（[【"
CLOSERS = "\"'”’“»›」』)）]】〉》*_"
SKIP = " \t\r\n\u00a0\u202f\u3000\"'“„«‹「『(（[【〈《¿¡*_"
IDEOGRAPHIC = "。！？｡．"
WORD_BEFORE = re.compile(r"(?:[^\W\d_](?:\.[^\W\d_])+|[^\W\d_][\u0300-\u036f\u0900-ः\u093a-ॏـ\w'’]*)$")
NUMBER_BEFORE = re.compile(r"\d$")
UNIT_BEFORE = re.compile(r"\d[ \u00a0\u202f]?[^\W\d_]{1,3}$")
WORD_AT = re.compile(r"[^\W\d_][\w'’\u0300-\u036f]*")
BARE = re.compile(r"[\W_]*([^\W\d_](?:[^\W\d_]|[\u0900-ः\u093a-ॏ]){0,5}(?:\.[^\W\d_])*)(\.?)[\W_]*")
ENDS_NOTHING = re.compile(r"\.(?=[,;:]|[ \u00a0](?:[a-zà-öø-ÿğışçöü]|\d))")
BEFORE_STOP = re.compile(r"(?<![\w.])(?:[^\W\d_]\.)*[^\W\d_](?:[^\W\d_]|[\u0900-ः\u093a-ॏ]){0,5}$")
SAID = re.compile(r"^[^。！？\n]{0,24}?(?:说|說|道|问|問|喊|答|表示|写道)[^。！？]{0,3}[。！？]")
THAI = "ก-\u0e3aเ-\u0e4e"
THAI_GAP = re.compile(rf"(?<=[{THAI}])\s+(?=[{THAI}])")
CAPITAL_AFTER = re.compile(r"\.[\"'”’»)\]]*[ \u00a0\r\n]+([^\W\d_a-zà-öø-ÿ][\w'’]*)")
LAST_WORD = re.compile(r"[^\W\d_]+$")
BLANK = re.compile(r"\s*")
WRITTEN = re.compile(r"(?<![\w'’.&/@_\u0300-\u036f-])[^\W\d_][\w'’\u0300-\u036f]*")
UNSTOPPED = re.compile(WRITTEN.pattern + r"(?![\w'’\u0300-\u036f.])")


class Pairs:
    """Matched quotation marks and brackets of a paragraph as (open, close, opening mark), nested or apart."""

    def __init__(self, text: str):
        found: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int]] = []
        waiting: dict[str, list[int]] = {}  # closing mark -> places in the stack of what it closes
        for m in PAIRED.finditer(text):
            c, at = m.group(), m.start()
            if c == '"':
                if stack and stack[-1][0] == '"':
                    found.append((stack.pop()[1], at, c))
                else:
                    stack.append((c, at))
                continue
            places = waiting.get(c, [])
            while places and (places[-1] >= len(stack) or c not in OPEN.get(stack[places[-1]][0], "")):
                places.pop()  # dropped with a pair around it
            if places:
                top = places.pop()
                found.append((stack[top][1], at, stack[top][0]))
                del stack[top:]
            elif c in OPEN and c != "»":
                for closer in OPEN[c]:
                    waiting.setdefault(closer, []).append(len(stack))
                stack.append((c, at))
        self.all = sorted(found)
        self.starts = [p[0] for p in self.all]
        self.outer: list[int] = []
        around: list[int] = []
        for k, p in enumerate(self.all):
            while around and self.all[around[-1]][1] < p[0]:
                around.pop()
            self.outer.append(around[-1] if around else -1)
            around.append(k)

    def __bool__(self) -> bool:
        return bool(self.all)

    def opens(self, at: int) -> bool:
        k = bisect_left(self.starts, at)
        return k < len(self.starts) and self.starts[k] == at

    def around(self, at: int) -> Iterator[tuple[int, int, str]]:
        """Pairs that begin before ``at``, from the nearest outwards; those already closed come too."""
        k = bisect_left(self.starts, at) - 1
        while k >= 0:
            yield self.all[k]
            k = self.outer[k]


@dataclass(frozen=True)
class Lexicon:
    """What the corpus says of words: see ``corpus_words``."""

    abbreviations: frozenset[str] = frozenset()
    plain: frozenset[str] = frozenset()
    small: frozenset[str] = frozenset()
    starters: frozenset[str] = STARTERS


class Evidence:
    """Unambiguous uses of words in one document, indexed once when first asked."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def inside(self) -> set[str]:
        """Words with a full stop that ends nothing."""
        found = (BEFORE_STOP.search(self.text, max(0, m.start() - 12), m.start()) for m in ENDS_NOTHING.finditer(self.text))
        return {unicodedata.normalize("NFC", w.group()) for w in found if w}

    @cached_property
    def small(self) -> set[str]:
        """Words written small."""
        found = {unicodedata.normalize("NFC", w) for w in set(WRITTEN.findall(self.text)) if w[0].islower()}
        return found | {w[:k] for w in found if "'" in w or "’" in w for k, c in enumerate(w) if c in "'’"}

    @cached_property
    def plain(self) -> set[str]:
        """Words without a full stop."""
        return {unicodedata.normalize("NFC", w) for w in set(UNSTOPPED.findall(self.text))}


class Splitter:
    def __init__(self, lexicon: Lexicon = Lexicon()):
        self.lexicon = lexicon

    def units(self, text: str) -> list[int]:
        """Ends of the sentence units of a text, in order."""
        facts = Evidence(text)
        out: list[int] = []
        at = 0
        for m in PARAGRAPH.finditer(text):
            self._paragraph(text, at, m.start(), facts, out)
            at = m.end()
        self._paragraph(text, at, len(text), facts, out)
        return out

    def _paragraph(self, text: str, a: int, b: int, facts: Evidence, out: list[int]) -> None:
        if b <= a:
            return
        para = text[a:b]
        if not para.strip("\ufeff \t\r\n\u200b\u00a0\u3000") or para.isspace():
            return
        if not LINE.search(para):
            if BULLET.match(para):
                out.append(a + len(para.rstrip()))
            else:
                self._block(text, para, a, facts, out)
            return
        start, at, in_list = 0, 0, False  # lines: list lines are units, other lines join
        first = True
        for m in [*LINE.finditer(para), None]:
            end = m.start() if m else len(para)
            mark = BULLET.match(para, at, end)
            if mark and not (mark.group(1) and not (first or in_list)):
                if at > start:
                    self._piece(text, para, start, at, a, in_list, facts, out)
                start, in_list = at, True
            first = False
            at = m.end() if m else end
        self._piece(text, para, start, len(para), a, in_list, facts, out)

    def _piece(self, text, para, start, end, a, in_list, facts, out) -> None:
        piece = para[start:end]
        if not piece.strip():
            return
        if in_list:
            out.append(a + start + len(piece.rstrip()))
        else:
            self._block(text, piece, a + start, facts, out)

    def _block(self, text: str, para: str, a: int, facts: Evidence, out: list[int]) -> None:
        pairs = Pairs(para) if PAIRED.search(para) else None
        ends: list[int] = []
        begin = 0
        body = len(para.rstrip())
        for m in STOP.finditer(para):
            i, j = m.start(), m.end()
            if j <= begin or j >= body:
                continue
            cut = self._cut(text, para, i, j, begin, pairs, facts)
            if cut and cut < body:
                ends.append(cut)
                begin = cut
        ends.append(body)
        if "\u0e00" <= max(para) and re.search(f"[{THAI}]", para):
            inside = lambda k: bool(pairs) and any(k < c for _, c, _ in pairs.around(k))
            ends = sorted({*ends, *(m.start() for m in THAI_GAP.finditer(para) if not inside(m.start()))})
        out.extend(a + e for e in ends)

    def _cut(self, text, para, i, j, begin, pairs, facts) -> int | None:
        """Where the unit ends if the stop at para[i:j] ends one."""
        stop = para[i:j]
        opened = None
        if pairs:
            for inner in pairs.around(i):
                if j <= inner[1]:
                    if BLANK.match(para, j, inner[1]).end() < inner[1]:
                        return None
                    j = inner[1] + 1
                    opened = inner
        while j < len(para) and para[j] in CLOSERS and not (pairs and pairs.opens(j)):
            j += 1
        ideographic = stop[-1] in IDEOGRAPHIC
        spaced = para[j].isspace() if j < len(para) else True
        if opened:
            leads = not para[begin : opened[0]].strip(SKIP)
            if opened[2] in BRACKETS:
                return j if leads and (spaced or ideographic) else None
            if ideographic:
                rest = para[j : j + 60].lstrip()
                if leads:
                    return None if rest[:1] in "とっ，、と" or SAID.match(rest) else j
                return None if rest[:1] in "とはがをのにでも、，" else j
        if not spaced and not ideographic and stop[-1] not in "؟।॥":
            return None
        if ideographic:
            return j
        if "…" in stop or stop.startswith(".."):
            k = self._next(para, j)
            if k < len(para) and not para[k].isupper():
                return None
            return None if i and para[i - 1].isspace() or set(stop) == {"…"} and not spaced else j
        k = self._next(para, j)
        if k >= len(para):
            return j
        after = para[k]
        if after in ",;:،؛，；：、" or after in "-–—" and not para[k + 1 : k + 2].isdigit():
            return None
        if stop[-1] in "।॥؟":
            return j
        if after.islower():
            return None
        if stop[-1] in "!?":
            return j
        return j if self._full_stop(para, i, k, facts) else None

    @staticmethod
    def _next(para: str, j: int) -> int:
        while j < len(para) and para[j] in SKIP:
            j += 1
        return j

    def _kind(self, word: str, low: str, digit: bool, facts: Evidence) -> str | None:
        """``title`` (names follow), ``abbreviation``, or None: the document's evidence, then the corpus, then the lists."""
        title = low in TITLES and (word[0].isupper() or low in ("dott", "sayın", "d") or not low.isascii())
        if len(low) <= 7 and (word in facts.inside or low in self.lexicon.abbreviations):
            return "title" if title else "abbreviation"
        if low in self.lexicon.plain:
            return None
        if "." in low:
            return "abbreviation" if low not in CAN_END or low in ("u.s", "u.k", "e.u") else None
        if len(word) == 1:
            return "title" if word.isupper() else None if "\u0e00" <= word <= "\u0e7f" else "abbreviation"
        if not (title or low in COMMON or digit and low in BEFORE_NUMBER) or word in facts.plain:
            return None
        return "title" if title else "abbreviation"

    def _full_stop(self, para: str, i: int, k: int, facts: Evidence) -> bool:
        before = para[max(0, i - 40) : i]
        after = para[k]
        next_word = m.group() if (m := WORD_AT.match(para, k)) else ""
        if NUMBER_BEFORE.search(before):
            return next_word.lower() not in GERMAN_MONTHS
        m = WORD_BEFORE.search(before)
        if not m:
            return True
        word = re.split("['’]", unicodedata.normalize("NFC", m.group()))[-1] or m.group()
        kind = self._kind(word, word.lower(), after.isdigit(), facts)
        if kind is None or UNIT_BEFORE.search(before) and not after.isdigit():
            return True
        if after.isdigit() or not next_word[:1].isupper():
            return False
        follows = unicodedata.normalize("NFC", next_word).lower()
        if kind == "title":
            return follows in self.lexicon.starters
        return follows in facts.small or follows in self.lexicon.small or follows in self.lexicon.starters


def corpus_words(texts: DataFrame, min_count: int = 5, share: float = 0.95) -> Lexicon:
    """What the whole corpus says of words of at most six letters.

    * abbreviations: nearly always with a full stop, which mostly ends nothing;
    * plain: listed words the corpus has at least ``COUNTED`` times and often without a full stop;
    * small: words mostly written small;
    * starters: the commonest capitalised words after full stops, those after initials, titles and other listed abbreviations aside.

    Counted in every partition before one shuffle. What reaches the driver is bounded by
    ``RARE_SHARE`` and ``STARTER_SHARE``, whatever the corpus.
    """
    names = ("word", "starts", "dotted", "plain", "inside", "small")

    def make():
        def step(cols):
            counts: Counter = Counter()
            inside: Counter = Counter()
            starts: Counter = Counter()
            for text in cols["text"]:
                if text:
                    counts.update(text.split())
                    for m in ENDS_NOTHING.finditer(text):
                        if w := BEFORE_STOP.search(text, max(0, m.start() - 12), m.start()):
                            inside[w.group().lower()] += 1
                    for m in CAPITAL_AFTER.finditer(text):
                        if w := LAST_WORD.search(text, max(0, m.start() - 9), m.start()):
                            starts[w.group(), m.group(1)] += 1
            rows: dict[str, list[int]] = {}
            for token, n in counts.items():
                if len(token) <= 24 and (m := BARE.fullmatch(token)):
                    bare = m.group(1)
                    row = rows.setdefault(bare.lower(), [0, 0, 0, 0])
                    row[0 if m.group(2) else 1] += n
                    row[3] += n if bare.islower() else 0
            for token, n in inside.items():
                rows.setdefault(token, [0, 0, 0, 0])[2] += n
            first: Counter = Counter()
            for (before, word), n in starts.items():
                if word[0].isupper() and len(before) > 1 and before.lower() not in BEFORE_NAMES:
                    first[word.lower()] += n
            out = [(w, 0, *r) for w, r in rows.items()] + [(w, n, 0, 0, 0, 0) for w, n in first.items()]
            return dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

        return step

    schema = "word string, starts bigint, dotted bigint, plain bigint, inside bigint, small bigint"
    counted = map_batches(texts.select("text").where("text is not null"), make, schema, rows=10_000)
    total = counted.groupBy("word").agg(*(F.sum(n).alias(n) for n in names[1:])).persist(StorageLevel.DISK_ONLY)
    try:
        uses = F.col("dotted") + F.col("plain")
        all_uses, all_starts = (n or 0 for n in total.agg(F.sum(uses), F.sum("starts")).first())
        enough = max(min_count, RARE_SHARE * all_uses)
        abbreviation = (F.col("dotted") >= share * uses) & (F.col("dotted") >= enough) & (F.col("inside") >= 0.3 * F.col("dotted"))
        small = (F.col("small") >= 0.5 * uses) & (F.col("plain") >= enough)
        plain = F.col("word").isin(*sorted(TITLES | BEFORE_NUMBER | COMMON | CAN_END)) & (uses >= COUNTED) & (F.col("dotted") < share * uses)
        starter = F.col("starts") >= max(min_count, STARTER_SHARE * all_starts)
        kept = total.where(abbreviation | small | plain | starter).select("word", abbreviation.alias("abbreviation"), plain.alias("plain"), small.alias("small"), starter.alias("starter")).collect()
    finally:
        total.unpersist()
    pick = lambda name: frozenset(r.word for r in kept if r[name])
    return Lexicon(pick("abbreviation"), pick("plain"), pick("small"), pick("starter") or STARTERS)


def sentence_units(documents: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, sent_end, unit) of every unit; ``lexicon`` overrides the corpus counts."""
    words = lexicon if lexicon is not None else corpus_words(documents)
    spread = documents.sparkSession.sparkContext.broadcast(words)

    def make():
        splitter = Splitter(spread.value)

        def step(cols):
            ids, ends, numbers = [], [], []
            for ident, text in zip(cols["doc_id"], cols["text"]):
                if text:
                    found = splitter.units(text)
                    ids.extend([ident] * len(found))
                    ends.extend(found)
                    numbers.extend(range(len(found)))
            return {"doc_id": ids, "sent_end": ends, "unit": numbers}

        return step

    return map_batches(documents.select("doc_id", "text").where("text is not null"), make, "doc_id bigint, sent_end bigint, unit int")
