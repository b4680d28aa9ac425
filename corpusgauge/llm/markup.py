"""Problem 6: markup residue: recognise it, and turn it into clean text.

A document is read against the grammars of four notations. Code blocks are found first, in
order of position, and closed to everything else: what they show is content. Then
each notation's marks are collected with their spans. Signs that several notations
share (``#`` and ``*`` lines, dollar formulas, ``<math>``) go to the notation that the
document's unambiguous marks speak for. Marks in their ordinary sense in prose (a price, a
comparison, a masked value, a snake_case name, a banner) match no grammar.

Clean text keeps headings (``# ``), lists (``- ``), code (fenced), tables (cells
between bars) and formulas (between dollar signs) and drops the rest of the notation.

Template deduction over pages of one host is in ``templates``. It tells repeated page
furniture, not which notation a sign belongs to, so p6_found rests on the grammars; the README
says so, with figures.

Null contents have no markup and a null clean text; empty ones an empty text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_batches

KINDS = ("html", "markdown", "wiki", "latex")
ELEMENTS = ("heading", "list", "code", "table", "formula", "inline")

# Names of the notations.
HTML_INLINE = (
    "p div span a b i u s em strong small big sub sup br hr img font center blockquote q cite abbr address section article header "
    "footer nav main aside figure figcaption label form input button select option textarea iframe html head body title meta link "
    "base noscript script style del ins mark kbd samp var tt strike time wbr object param embed canvas svg video audio picture code"
).split()
HTML_LIST = "ul ol li dl dt dd".split()
HTML_TABLE = "table tr td th thead tbody tfoot caption colgroup col".split()
MATHML = "math mi mo mn mrow msup msub mfrac msqrt mtext mtable mtr mtd munder mover".split()
WIKI_TAGS = "ref references nowiki noinclude includeonly onlyinclude gallery poem templatestyles syntaxhighlight source timeline".split()
LATEX_INLINE = (
    "textbf textit emph textsc texttt textsf textrm underline cite citep citet ref eqref pageref label href url footnote caption "
    "usepackage documentclass author title date maketitle input include includegraphics centering noindent newline newpage "
    "bibliography bibliographystyle textcolor color hspace vspace quad mbox autoref nameref textsuperscript gls"
).split()
LATEX_LISTS = "itemize enumerate description"
LATEX_TABLES = "tabular tabular\\* tabularx longtable array table"
LATEX_FORMULAS = "equation equation\\* align align\\* gather gather\\* displaymath math multline eqnarray"

_alt = "|".join
CODE = re.compile(
    r"(?P<md>^[ ]{0,3}(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<mdb>.*?)(?:^[ ]{0,3}(?P=f)[`~]*[ \t\r]*$|\Z))"
    r"|(?P<html><pre\b[^>]*>(?P<htmlb>.*?)(?:</pre\s*>|\Z))"
    r"|(?P<wiki><(?P<w>syntaxhighlight|source)\b[^>/]*>(?P<wikib>.*?)</(?P=w)\s*>)"
    r"|(?P<latex>\\begin\{(?P<l>lstlisting|verbatim\*?|minted|Verbatim)\}(?:\[[^\]]*\])?(?:\{\w+\})?(?P<latexb>.*?)\\end\{(?P=l)\})",
    re.M | re.S | re.I,
)
TAG = re.compile(rf"</?({_alt(HTML_INLINE + HTML_LIST + HTML_TABLE + MATHML + ['h[1-6]'] + WIKI_TAGS)})(?=[\s/>])[^<>]*>", re.I)
SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});")
MATH_TAG = re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.I | re.S)
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t\r]*$", re.M)
WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
WIKI_EMPHASIS = re.compile(r"'''(?=[^\s'])(.+?)'''|(?<!')''(?=[^\s'])([^'\n]+?)''(?!')")
WIKI_EXTERNAL = re.compile(r"(?<!\])\[(?:https?|ftp)://[^\s\]]+ [^\]\n]+\](?!\()")
HASH_LINE = re.compile(r"^(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
STAR_LINE = re.compile(r"^([*#:;]+)[ \t]*(\S[^\n]*)$", re.M)
UNDERLINE = re.compile(r"^(=+|-{2,})[ \t\r]*$", re.M)  # looked at backwards: a pattern over both lines backtracks on long ones
NO_TITLE = re.compile(r"[ \t]*(?:[-*+>|#]|\d+[.)])[ \t]|[\s=-]*$")
MD_LIST = re.compile(r"^[ \t]*([-+*]|\d{1,4}[.)])[ \t]+(\[[ xX]\][ \t]+)?(\S[^\n]*)$", re.M)
MD_TABLE = re.compile(r"^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t\r]*$(?:\n[^\n]*\|[^\n]*)*", re.M)
TICKS = re.compile(r"`+|\n")
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^>\n]*>|[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:[ \t]+\"[^\"\n]*\")?\)|\[\^[^\]\s]+\]|<https?://[^>\s]+>")
MD_STRONG = re.compile(r"(?<!\w)__(?=\S)([^\n_]+?)(?<=\S)__(?!\w)")
MD_EMPHASIS = re.compile(r"(?<![*\\\w])\*(?![\s*])([^\n*]+?)(?<![\s*])\*(?![*\w])|(?<=[^\x00-\x7f])\*(?![\s*])([^\n*]+?)(?<![\s*])\*(?!\*)|(?<![*\\])\*(?![\s*])([^\n*]+?)(?<![\s*])\*(?=-|[^\x00-\x7f])")
MD_UNDER = re.compile(r"(?<![\w\\])_(?![\s_])([^\n_]+?)(?<![\s_])_(?!\w)")
MD_QUOTE = re.compile(r"^>[ \t]", re.M)
DISPLAY = re.compile(r"\$\$(.+?)\$\$", re.S)
DOLLAR = re.compile(r"\$")
FORMULA_BODY = re.compile(r"(?![\s\d]|[A-Z]{2,}\b).+|\d.*[\\^_=+].*")
TEX_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
TEX_FORMULA = re.compile(rf"\\begin\{{({_alt(LATEX_FORMULAS.split())})\}}(.*?)\\end\{{\1\}}", re.S)
TEX_HEADING = re.compile(r"\\((?:sub){0,2}section|(?:sub)?paragraph|chapter|part)\*?(?:\[[^\]]*\])?\{([^{}\n]*)\}")
TEX_LIST = re.compile(rf"\\(?:begin|end)\{{(?:{_alt(LATEX_LISTS.split())})\}}(?:\[[^\]]*\])?|^[ \t]*\\item\b", re.M)
TEX_TABLE = re.compile(rf"\\begin\{{({_alt(LATEX_TABLES.split())})\}}(.*?)\\end\{{\1\}}", re.S)
TEX_INLINE = re.compile(rf"\\(?:{_alt(LATEX_INLINE)})\*?(?:\[[^\]\n]*\])?\{{|\\(?:maketitle|noindent|centering|newline|newpage|tableofcontents|item|LaTeX|TeX|ldots|dots)\b|~\\[a-z]+\{{|\\[,;%&#_]|\\begin\{{(?:document|center|quote|figure|abstract)\}}")


def underlined(text: str) -> list[tuple[int, int, str, str]]:
    """Lines underlined by = or -, alone in their paragraph: (start, end, title, underline)."""
    out = []
    for m in UNDERLINE.finditer(text):
        start = text.rfind("\n", 0, max(0, m.start() - 1)) + 1
        title = text[start : max(start, m.start() - 1)]
        first = start == 0 or text[max(0, text.rfind("\n", 0, start - 1)) : start].strip() == ""
        if m.start() and first and len(m.group(1)) >= 2 and "|" not in title and not NO_TITLE.match(title):
            out.append((start, m.end(), title.rstrip("\r"), m.group(1)))
    return out


def code_spans(text: str) -> list[tuple[int, int, str]]:
    """Backtick spans within a line as (start, end, inside): a run of backticks to the next run as long, in linear time."""
    out: list[tuple[int, int, str]] = []
    line: list[tuple[int, int]] = []

    def close() -> None:
        ends: dict[int, list[int]] = defaultdict(list)  # length -> places of runs that may close, last first
        for k in range(len(line) - 1, -1, -1):
            a, b = line[k]
            if not (text[b : b + 1].isascii() and text[b : b + 1].isalpha()):
                ends[b - a].append(k)
        done = -1
        for k, (a, b) in enumerate(line):
            before = text[a - 1 : a]
            if k <= done or before.isascii() and before.isalpha():
                continue
            places = ends[b - a]
            while places and places[-1] <= k:
                places.pop()
            if places:
                done = places[-1]
                out.append((a, line[done][1], text[b : line[done][0]]))
        line.clear()

    for m in TICKS.finditer(text):
        if text[m.start()] == "\n":
            if line:
                close()
        else:
            line.append(m.span())
    close()
    return out


def doubled_spans(text: str, mark: str) -> list[tuple[int, int, str]]:
    """Spans between doubled signs such as ``**`` within a line, as (start, end, inside), in linear time."""
    sign = re.escape(mark)
    closing = [m.start() for m in re.finditer(rf"(?<=\S)(?={sign})", text)]
    out, at = [], 0
    for m in re.finditer(rf"{sign}(?=\S)", text):
        if m.start() < at:
            continue
        k = bisect_left(closing, m.end() + 1)
        if k < len(closing) and (text.find("\n", m.end(), closing[k]) < 0):
            at = closing[k] + len(mark)
            out.append((m.start(), at, text[m.end() : closing[k]]))
    return out


def dollar_spans(text: str) -> list[tuple[int, int, str]]:
    """Formulas of any length between two neighbouring dollar signs of a line, as (start, end, body)."""
    out, at = [], [m.start() for m in DOLLAR.finditer(text)]
    k = 0
    while k + 1 < len(at):
        a, b = at[k], at[k + 1]
        k += 1
        before, after = text[a - 1 : a], text[b + 1 : b + 2]
        if before and (before in "\\$" or before == "_" or before.isalnum()) or after and (after in "$_" or after.isalnum()):
            continue
        if b == a + 1 or text[b - 1].isspace() or text[b - 1] == "\\" or text.find("\n", a, b) >= 0:
            continue
        body = text[a + 1 : b]
        if FORMULA_BODY.fullmatch(body):
            out.append((a, b + 1, body))
            k += 1
    return out


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, inside in spans:
        parts += [text[at:a], inside]
        at = b
    return "".join((*parts, text[at:]))


class Reading:
    """Marks of one text: {(kind, element): [(start, end)]}."""

    def __init__(self, text: str):
        self.text = text
        self.marks: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        self.code: list[tuple[int, int, str, str]] = []
        self.rest = self._blank_code(text)
        self._unambiguous()
        self._shared()

    def _add(self, kind: str, element: str, at: int, end: int) -> None:
        self.marks[kind, element].append((at, end))

    def _blank_code(self, text: str) -> str:
        if "```" not in text and "~~~" not in text and "<" not in text and "\\begin" not in text:
            return text
        parts, at = [], 0
        for m in CODE.finditer(text):
            kind = {"md": "markdown"}.get(k := next(k for k in ("md", "html", "wiki", "latex") if m.group(k)), k)
            self._add(kind, "code", m.start(), m.end())
            self.code.append((m.start(), m.end(), kind, m.group(k + "b")))
            parts += [text[at : m.start()], re.sub(r"[^\n]", "\x00", m.group())]
            at = m.end()
        return "".join((*parts, text[at:]))

    def _each(self, pattern: re.Pattern, kind: str, element: str) -> None:
        for m in pattern.finditer(self.rest):
            self._add(kind, element, m.start(), m.end())

    def _spans(self, spans: list[tuple[int, int, str]], kind: str, element: str) -> None:
        for a, b, _ in spans:
            self._add(kind, element, a, b)

    def _until(self, *closing: str) -> int:
        """Where the last closing mark ends: what opens after it has no end, and need not be tried."""
        low = self.rest.lower()
        return max(low.rfind(c) for c in closing) + 12

    def _unambiguous(self) -> None:
        rest = self.rest
        if "<" in rest:
            for m in SCRIPT.finditer(rest, 0, self._until("</script", "</style")):
                self._add("html", "inline", m.start(), m.end())
            self._each(COMMENT, "html", "inline")
            for m in TAG.finditer(rest):
                name = m.group(1).lower()
                if name in WIKI_TAGS:
                    self._add("wiki", "inline", m.start(), m.end())
                elif name in MATHML:
                    continue
                else:
                    element = "heading" if name[0] == "h" and name[1:].isdigit() else "list" if name in HTML_LIST else "table" if name in HTML_TABLE else "inline"
                    self._add("html", element, m.start(), m.end())
            for m in MATH_TAG.finditer(rest, 0, self._until("</math")):
                own = re.search(r"<m(?:i|o|n|row|sup|sub|frac|sqrt)\b", m.group(1), re.I)
                self._add("html" if own else "wiki", "formula", m.start(), m.end())
        if "&" in rest:
            self._each(ENTITY, "html", "inline")
        if "=" in rest:
            self._each(WIKI_HEADING, "wiki", "heading")
        if "[[" in rest:
            self._each(WIKI_LINK, "wiki", "inline")
        if "{" in rest:
            self._each(WIKI_TABLE, "wiki", "table")
            for m in WIKI_TEMPLATE.finditer(rest):
                if not re.search(r"\\[a-zA-Z]+\{\Z", rest[max(0, m.start() - 14) : m.start() + 1]):
                    self._add("wiki", "inline", m.start(), m.end())
        if "''" in rest:
            for m in WIKI_EMPHASIS.finditer(rest):
                # two apostrophes may be a typed quotation mark: a sentence in them is one
                if m.group(1) or not re.search(r"[.!?,]\Z|\s.*[.!?]", m.group(2)):
                    self._add("wiki", "inline", m.start(), m.end())
        if "://" in rest:
            self._each(WIKI_EXTERNAL, "wiki", "inline")
            self._each(MD_LINK, "markdown", "inline")
        elif "](" in rest or "[^" in rest:
            self._each(MD_LINK, "markdown", "inline")
        if "|" in rest and "-" in rest:
            self._each(MD_TABLE, "markdown", "table")
        if "\n=" in rest or "\n-" in rest:
            for start, end, _, _ in underlined(rest):
                self._add("markdown", "heading", start, end)
        if "`" in rest:
            self._spans(code_spans(rest), "markdown", "inline")
        if "*" in rest:
            self._spans(doubled_spans(rest, "**"), "markdown", "inline")
            self._each(MD_EMPHASIS, "markdown", "inline")
        if "_" in rest:
            self._each(MD_STRONG, "markdown", "inline")
            self._each(MD_UNDER, "markdown", "inline")
        if "~~" in rest:
            self._spans(doubled_spans(rest, "~~"), "markdown", "inline")
        if "\\" in rest:
            for m in TEX_HEADING.finditer(rest):
                self._add("latex", "heading", m.start(), m.end())
            self._each(TEX_LIST, "latex", "list")
            self._each(TEX_TABLE, "latex", "table")
            self._each(TEX_FORMULA, "latex", "formula")
            self._each(TEX_DISPLAY, "latex", "formula")
            inside = self._inside(("latex", "table"), ("latex", "formula"), ("latex", "list"))
            for m in TEX_INLINE.finditer(rest):
                if not inside(m.start()):
                    self._add("latex", "inline", m.start(), m.end())

    def _inside(self, *where: tuple[str, str]) -> Callable[[int], bool]:
        """Test of a place against the spans of these kinds found so far."""
        starts: list[int] = []
        ends: list[int] = []
        for a, b in sorted(x for w in where for x in self.marks.get(w, ())):
            if ends and a <= ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a)
                ends.append(b)

        def inside(at: int) -> bool:
            k = bisect_right(starts, at) - 1
            return k >= 0 and at < ends[k]

        return inside

    def _weight(self, kind: str) -> int:
        return sum(len(v) * (1 if e == "inline" else 3) for (k, e), v in self.marks.items() if k == kind)

    def _shared(self) -> None:
        rest = self.rest
        wiki, markdown, latex = (self._weight(k) for k in ("wiki", "markdown", "latex"))
        hashes = list(HASH_LINE.finditer(rest)) if "#" in rest else []
        stars = list(STAR_LINE.finditer(rest)) if re.search(r"^[*#]", rest, re.M) else []
        lone = {m.start() for m in hashes if self._alone(m)}
        bullets = [m for m in MD_LIST.finditer(rest)] if re.search(r"^[ \t]*(?:[-+*]|\d{1,4}[.)])[ \t]", rest, re.M) else []
        runs = self._runs(bullets)
        own = {m.start() for m in bullets if m.group(1) != "*" and not (m.group(1)[0].isdigit() and m.start() not in runs)}
        if any(len(m.group(1)) > 1 and m.start() in lone for m in hashes):
            markdown += 3
        if any(m.group(1) == "-" for m in bullets):
            markdown += 1
        if any(re.match(r"\*\*|#[#*]|\*[#:]", m.group(1)) and not m.group(2).rstrip().endswith("**") and rest[m.start() + len(m.group(1))] in " \t" for m in stars):
            wiki += 1
        as_wiki = wiki > markdown
        for m in hashes:
            if as_wiki or not (m.start() in lone or markdown):
                if len(m.group(1)) <= 2 and (as_wiki or m.start() not in lone):
                    self._add("wiki", "list", m.start(), m.end())
            elif m.start() in lone:
                self._add("markdown", "heading", m.start(), m.end())
        for m in stars:
            first = m.group(1)
            if as_wiki and set(first) <= {"*", "#"} and "*" in first and rest[m.start() + len(first)] in " \t":
                self._add("wiki", "list", m.start(), m.end())
        inside = self._inside(("latex", "table"), ("latex", "list"), ("wiki", "table"), ("markdown", "table"))
        for m in bullets:
            if m.group(1) == "*":
                if not as_wiki:
                    self._add("markdown", "list", m.start(), m.end())
            elif m.start() in own and not inside(m.start()):
                self._add("markdown", "list", m.start(), m.end())
        if "$" in rest:
            kind = "latex" if latex > markdown else "markdown" if markdown else "latex"
            display = [(m.start(), m.end(), m.group(1)) for m in DISPLAY.finditer(rest)]
            for spans in (display, dollar_spans(rest)):
                inside = self._inside(("latex", "formula"), ("markdown", "formula"))
                for a, b, body in spans:
                    if re.search(r"[\\^_=<>+]|^[A-Za-z]$", body) and not inside(a):
                        self._add(kind, "formula", a, b)

    def _alone(self, m: re.Match) -> bool:
        """A line with no other marked line of its sort next to it."""
        rest, at = self.rest, m.start()
        follows = rest[m.end() : m.end() + 3].lstrip("\r")[:2]
        if follows[:1] == "\n" and follows[1:] and follows[1:] in "#*":
            return False
        if not at or rest[max(0, at - 4) : at].endswith(("\n\n", "\n\r\n")):
            return True
        end = at  # the last line above that is not blank
        while end and rest[end - 1] in "\r\n \t":
            end -= 1
        return not end or rest[rest.rfind("\n", 0, end) + 1] not in "#*"

    @staticmethod
    def _runs(bullets: list[re.Match]) -> set[int]:
        """Starts of numbered lines that another numbered line touches: those are list lines."""
        numbered = [m for m in bullets if m.group(1)[0].isdigit()]
        out: set[int] = set()
        for a, b in zip(numbered, numbered[1:]):
            if 0 <= b.start() - a.end() <= 2:
                out.update((a.start(), b.start()))
        return out

    def kinds(self) -> list[tuple[str, str]]:
        return sorted(k for k, v in self.marks.items() if v)


def markup_kinds(text: str) -> list[tuple[str, str]]:
    """(markup, element) of each kind of marking in the text."""
    return Reading(text).kinds()


def _plain(s: str) -> str:
    return re.sub(r"[ \t]+", " ", s).strip()


def _bars(cells: list[str]) -> str:
    return "| " + " | ".join(_plain(c) for c in cells) + " |"


def _from_html(t: str) -> str:
    t = SCRIPT.sub("", COMMENT.sub("", t))
    t = MATH_TAG.sub(lambda m: "$" + _plain(re.sub(r"<[^>]*>", "", m.group(1))) + "$", t)
    t = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>", lambda m: "\n" + "#" * int(m.group(1)) + " " + _plain(re.sub(r"<[^>]*>", "", m.group(2))) + "\n", t, flags=re.I | re.S)
    t = re.sub(r"<tr\b[^>]*>(.*?)(?:</tr\s*>|(?=<tr\b)|(?=</table))", lambda m: "\n" + _bars([re.sub(r"<[^>]*>", "", c) for c in re.split(r"<t[dh]\b[^>]*>", m.group(1), flags=re.I)[1:]]), t, flags=re.I | re.S)
    t = re.sub(r"\s*<li\b[^>]*>\s*", "\n- ", t, flags=re.I)
    t = re.sub(r"<br\s*/?>|</?(?:p|div|ul|ol|table|section|article|blockquote)\b[^>]*>", "\n", t, flags=re.I)
    return html.unescape(TAG.sub("", t)).replace("\u00a0", " ")


def _from_wiki(t: str) -> str:
    t = COMMENT.sub("", re.sub(r"<ref\b[^>/]*>.*?</ref\s*>|<ref\b[^>]*/>", "", t, flags=re.I | re.S))
    t = MATH_TAG.sub(lambda m: "$" + m.group(1).strip() + "$", t)
    t = STAR_LINE.sub(lambda m: "  " * (len(m.group(1)) - 1) + "- " + m.group(2) if set(m.group(1)) <= {"*", "#"} else m.group(2), t)
    t = WIKI_HEADING.sub(lambda m: "#" * len(m.group(1)) + " " + m.group(2), t)
    t = WIKI_TABLE.sub(lambda m: "\n".join(_bars(re.split(r"\|\||!!", line.lstrip()[1:])) for line in m.group().split("\n")[1:] if re.match(r"\s*[|!](?![-}+])", line)), t)
    t = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", WIKI_TEMPLATE.sub("", t))
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+ ([^\]\n]+)\]", r"\1", t)
    return re.sub(r"'{2,5}", "", TAG.sub("", t))


def _from_latex(t: str) -> str:
    t = TEX_TABLE.sub(lambda m: "\n".join(_bars(r.split("&")) for r in re.split(r"\\\\", re.sub(r"^(?:\{[^}]*\})+|\\hline", "", m.group(2))) if r.strip()), t)
    t = TEX_FORMULA.sub(lambda m: "$" + m.group(2).strip() + "$", t)
    t = TEX_DISPLAY.sub(lambda m: "$" + (m.group(1) or m.group(2)).strip() + "$", t)
    depth = {"chapter": 1, "part": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
    t = TEX_HEADING.sub(lambda m: "#" * depth[m.group(1)] + " " + m.group(2), t)
    t = re.sub(r"^[ \t]*\\item\b[ \t]*", "- ", t, flags=re.M)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "", t)
    t = re.sub(r"~?\\(?:cite|citep|citet|ref|eqref|pageref|label|autoref|bibliography\w*|usepackage|documentclass|include\w*|input)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    for _ in range(3):  # nested commands from the inside out
        t = re.sub(rf"\\(?:{_alt(LATEX_INLINE)})\*?(?:\[[^\]\n]*\])?\{{([^{{}}]*)\}}", r"\1", t)
    return re.sub(r"\\([%&#_$])", r"\1", re.sub(r"\\(?:,|;|quad)|(?<=\w)~(?=\w)", " ", t))


def _from_markdown(t: str) -> str:
    t = _replaced(t, [(start, end, ("# " if mark[0] == "=" else "## ") + title) for start, end, title, mark in underlined(t)])
    t = HASH_LINE.sub(lambda m: m.group(1) + " " + m.group(2).rstrip("# \r"), t)
    t = DISPLAY.sub(lambda m: "$" + m.group(1).strip() + "$", t)
    t = _replaced(t, [(a, b, inside.strip()) for a, b, inside in code_spans(t)])
    t = MD_LINK.sub(lambda m: m.group(1) or "", t)
    for mark in ("**", "~~"):
        t = _replaced(t, doubled_spans(t, mark))
    for pattern in (MD_STRONG, MD_EMPHASIS, MD_UNDER):
        t = pattern.sub(lambda m: next((g for g in m.groups() if g), ""), t)
    return MD_LIST.sub(lambda m: ("- " if m.group(1) in "-+*" else m.group(1) + " ") + m.group(3), t)


def clean_text(text: str | None) -> str | None:
    """Text without notation, keeping headings, lists, code, tables and formulas."""
    if not text:
        return text
    reading = Reading(text)
    kinds = {k for k, _ in reading.kinds()}
    if not kinds:
        return text
    parts, at = [], 0
    rules = [f for k, f in (("html", _from_html), ("wiki", _from_wiki), ("latex", _from_latex), ("markdown", _from_markdown)) if k in kinds]
    for a, b, kind, body in [*reading.code, (len(text), len(text), "", "")]:
        piece = text[at:a]
        for rule in rules:
            piece = rule(piece)
        parts.append(piece)
        if kind:
            body = html.unescape(re.sub(r"</?code[^>]*>", "", body)) if kind == "html" else body
            parts.append("```\n" + body.strip("\r\n") + "\n```")
        at = b
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def found_markup(documents: DataFrame) -> DataFrame:
    """(document_id, markup, element), one row for each kind of marking in each content."""
    def make():
        def step(cols):
            rows = [(i, k, e) for i, t in zip(cols["id"], cols["content"]) if t for k, e in markup_kinds(t)]
            return dict(zip(("document_id", "markup", "element"), map(list, zip(*rows)))) if rows else {"document_id": [], "markup": [], "element": []}

        return step

    return map_batches(documents.select("id", "content").where("content is not null"), make, "document_id string, markup string, element string").distinct()


def cleaned(documents: DataFrame) -> DataFrame:
    """(document_id, clean_content) of every row."""
    def make():
        return lambda cols: {"document_id": cols["id"], "clean_content": [clean_text(t) for t in cols["content"]]}

    return map_batches(documents.select("id", "content"), make, "document_id string, clean_content string")
