"""Problem 2: personal information inside free text.

Candidate gradient boosting. High-recall generators propose overlapping spans of five types
(email, phone, id_number, address, name): every run of capitalised words with initials and
particles, and each of its parts, may be a name, every number with words and commas around it an
address, every run of seven digits a number. Lists of given names, street words and cues are
features, not conditions. Boosted trees, one model a type, score the spans by
features of their format and context; spans above the type's calibrated threshold are taken
in order of score, without overlap, and replaced by typed placeholders.

The models are fitted on the driver on labelled spans of sentences composed from
invented parts (``training_spans``, a few thousand rows, fixed seed; every third given name and every
fourth street word is invented too), never on the corpus. Names in scripts without capitals are proposed
after cue words only. Text
is searched in plain form (width, invisible and look-alike characters undone) with every
position mapped back, so values are exact substrings of the content.

Null and empty contents hold nothing. Repeated rows give one result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import map_batches
from .lookalikes import GROUP, HYPHENS, IGNORABLE, JOINERS, SPACES, SUSPECT, WIDE, _compatible

TYPES = ("email", "phone", "id_number", "address", "name")

# Common given names of the languages covered.
GIVEN = frozenset(
    """Adam Ahmet Alberto Alessandro Alexander Ali Alice Ana Anastasia Andrea Andreas Andrés Angela Anna Anneliese Antoine Antonio Arthur Ayşe
    Baptiste Beatrice Ben Birgit Brigitte Burak Calvin Camille Can Carla Carlos Carmen Carol Caroline Charles Chiara Chloé Christian Christine
    Clara Claire Claudia Çağlar Daniel David Deniz Diana Diego Dominik Elena Élodie Elif Elisa Elizabeth Emily Emma Emre Erik Esra Eva Fatma
    Federico Felix Fernando Francesca Francesco Frank Friedrich Gabriel Gemma George Giovanni Giulia Giuseppe Gonzalo Greta Gülşah Hakan
    Hans Heike Helen Hélène Henry Hugo Iñaki Ingrid Isabel İrem Jacques Jakob James Jan Javier Jean Jennifer Johanna John Jonas Jorge José Juan
    Julia Julien Jürgen Karen Karl Katharina Kemal Klaus Laura Léa Leyla Linda Lorenzo Louis Luca Lucas Lucía Luis Luisa Lukas Manuel Marcus
    Margaret María Maria Marie Marisol Mark Markus Martin Mary Mathieu Matteo Matthias Mehmet Merve Michael Michel Murat Mustafa Nathalie
    Niccolò Nicolas Noémie Nora Olivia Ömer Owen Pablo Paolo Patricia Paul Pauline Pedro Peter Petra Philippe Pierre Priya Rachel Rafael
    Robert Rosa Ruth Sabine Samuel Sandra Sarah Selin Sofia Sophie Stefan Stefano Stephen Susan Sven Thomas Tobias Tom Tomás Ursula Uwe Víctor
    Vincent Walter William Wolfgang Yusuf Zeynep""".split()
)
CJK_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文逄蔺阙邬闻佟郗郏"

UPPER = r"A-ZÀ-ÖØ-ÞĞİŞĆČŁŃŚŽ"
WORD = rf"[{UPPER}](?:\w|['’](?=[{UPPER}]))*[^\W\d_]"
SURNAME = rf"{WORD}(?:-{WORD})*"
PARTICLES = "van(?: der| den)?|von(?: der)?|de(?: la| los)?|del|della|di|da|dos|du|bin|ibn|al|el|ben|ter|zu|y"
RUN = re.compile(rf"(?<![\w@./-]){WORD}(?:-{WORD})*(?: (?:[{UPPER}]\.|{PARTICLES}|{WORD}(?:-{WORD})*)(?![\w@])){{1,5}}")
PART = re.compile(r"\S+")
CJK_NAME = re.compile(r"(?:联系人[:：]?|申请人|收件人[:：]?|负责人[:：]?|由|昨天|姓名[:：]?|客户)([一-鿿]{2,4}?)(?=的身份|的电话|的护照|[，。、；,;]|女士|先生|询问|批准|$)", re.M)

EMAIL = re.compile(
    r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]*(?:@| ?[\[({](?:at|arroba|chiocciola|arobase|ät|et|kuyruklu a)[\])}] ?| at (?=[\w-]+(?: dot [\w-]+)+))"
    r"[A-Za-zÀ-ɏ0-9-]+(?:(?:\.| ?[\[({](?:dot|punkt|punto|point|nokta)[\])}] ?| dot )[A-Za-zÀ-ɏ0-9-]+)*",
    re.I,
)
AT = re.compile(r"@| ?[\[({](?:at|arroba|chiocciola|arobase|ät|et|kuyruklu a)[\])}]| at (?=[\w-]+(?: dot [\w-]+)+)", re.I)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
NUMBER = re.compile(r"(?<![\w.+/$€£#-])(?:\+ ?|\(\+?)?\d(?:[ .\-/()]{0,2}\d){6,20}(?![\d_a-zà-ÿ@]|[-./]\d)|(?<=[一-鿿])(?:\+ ?)?\d(?:[ .\-/()]{0,2}\d){6,20}(?![\w]|[-./]\d)")
ACCOUNT = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})* ?$")  # an account number begins before this number
MIXED = re.compile(r"(?<![\w.+/-])(?:[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z]{1,2}\d{6,9}|\d{8}-? ?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{2}[A-Z0-9]{6,8}|\d{17}[Xx])(?![\w-])|(?<=[一-鿿])\d{17}[\dXx](?!\w)")

_TOWN = rf"(?:(?:Bad|San|Saint|Sankt|Santa|New|Los|Las|La|Le|Les|Den|St\.) )?{WORD}(?:-{WORD})*"
_STREET_EN = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Boulevard|Blvd\.?|Way|Place|Square|Terrace|Close|Crescent)"
_POST_EN = r"(?:[A-Z]{2} \d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z0-9]? \d[A-Z]{2})"
STREET_WORD = re.compile(rf"\b{_STREET_EN}(?=,|$| )|(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|hof)\b|\b(?:rue|avenue|boulevard|place|chemin|impasse|quai|Via|Viale|Piazza|Corso|Largo|Calle|Avenida|Plaza|Paseo|Mah\.|Mahallesi|Cad|Sok|Box|Postfach|Am|Im)\b|[路街巷]")
ADDRESSES = [
    re.compile(p)
    for p in (
        # any number before capitalised words, or after them, with a comma and a town behind
        rf"(?<![\w/.,-])\d{{1,5}}[A-Za-z]? (?:{WORD} ){{0,3}}{WORD}, {_TOWN}(?:,? {_POST_EN}| \d{{4,5}})?(?!\w)",
        rf"(?<![\w/-]){WORD}(?:[ -]{WORD}){{0,3}} \d{{1,4}} ?[a-z]?(?![a-z]), (?:[A-Z]{{1,2}}-)?\d{{4,5}} {_TOWN}(?!\w)",
        rf"(?<![\w/-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:{WORD} ){{1,3}}?{_STREET_EN},? {_TOWN}(?:,? {_POST_EN})?(?!\w)",
        rf"(?<![\w/-])(?:P\. ?O\. Box|PO Box|Postfach|Apartado(?: de correos)?|Casella postale|BP) \d+, (?:\d{{5}} )?{_TOWN}(?:,? {_POST_EN})?(?!\w)",
        rf"(?<![\w/-])(?:[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|hof)|(?:Am|Im|An der|Auf dem) {WORD}) \d{{1,4}} ?[a-z]?(?![a-z]), \d{{5}} {_TOWN}(?!\w)",
        rf"(?<![\w/-])\d{{1,4}}(?: bis| ter| quater)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route) (?:de la |des |du |de |d'|de l')?{WORD}(?:[ -]{WORD})*, \d{{5}} {_TOWN}(?!\w)",
        rf"(?<![\w/-])(?:Via|Viale|Piazza|Corso|Largo|Vicolo|Strada|Piazzale) (?:{WORD} ?|del(?:la)? |dei |di ){{1,3}}\d{{1,4}}(?:/?[A-Za-z])?, \d{{5}} {_TOWN}(?: \([A-Z]{{2}}\))?(?!\w)",
        rf"(?<![\w/-])(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda|C/) ?(?:de la |del |de )?{WORD}(?: {WORD})? \d{{1,4}}(?:, \d+[º°.]? ?\w?)?, \d{{5}} {_TOWN}(?!\w)",
        rf"(?<![\w/-]){WORD} (?:Mah\.|Mahallesi),? (?:{WORD} (?:Sok\.|Sokak|Sokağı|Cad\.|Caddesi|Bulvarı),? )?No: ?\d+(?:[/ ]?[A-Z\d]*)?(?:, Daire:? ?\d+)?, (?:\d{{5}} )?{_TOWN}(?:/{WORD})?(?!\w)",
        r"(?:[一-鿿]{2,5}省)?[一-鿿]{2}市(?:[一-鿿]{2}[区县])?[一-鿿]{2,3}(?:路|街|大道|巷)\d+号(?:\d+(?:号楼|栋|幢))?(?:\d+单元)?(?:\d+室)?",
    )
]

#: Words without which an address pattern cannot match.
HINTS = (
    (), (), (), ("Box", "Postfach", "Apartado", "Casella", "BP"), (), (), ("Via", "Piazza", "Corso", "Largo", "Vicolo", "Strada"), ("Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "C/"), ("Mah",), ("号",),
)

CUES = {
    "email": re.compile(r"(?i)(mail|e-?mail|contact|write|send|reply|from|von|kontakt|unter|écrire|à$|scrivere|escriba|correo|posta|邮箱|写信|adres|ile$|at$|an$|<$|[a-z] [\w-]+,$)"),
    "phone": re.compile(r"(?i)(\btel|phone|téléphone|telefon|teléfono|call|answers on|questions to|caller on|\bor$|oder$|\bou au$|\bau$|oppure|chiamare|llame|ya da$|nimmt$|répond|atiende|contesta|risponde|rückruf|电话|电話|mobil|cell|fax|numara|hattı|ulaş|regards|saluti|grüßen|cordialement|saludos|saygı|\n$|^$)"),
    "id_number": re.compile(r"(?i)(ssn|social security|national id|passport|insurance no|tax id|\bid (?:no|number|card)|steuer|ausweis|reisepass|sozialversicherung|sécurité sociale|insee|passeport|codice fiscale|passaporto|carta d'identità|\bdni\b|\bnie\b|\bnif\b|pasaporte|kimlik|pasaport|vergi|身份证|护照|gave$|nino)"),
    "address": re.compile(r"(?i)(liv\w+ at|left at|\bto$|ship|deliver|address|wohnt|liefer|adresse|habite|livrer|domicil|abita|spedire|residen|vive|enviar|direcci|adres|oturuyor|beri$|寄到|住|地址|\n$|in$|en$)"),
    "name": re.compile(r"(?i)(contact|applicant|approved by|taken by|met$|\band$|with$|yesterday|from:?$|antragsteller|fragte|freigegeben|wenden|an$|von:?$|merci|contacter|dossier de|hier,|validé par|de ?:$|codice fiscale di|scrivere a|ieri|approvat|dni de|ayer|escriba a|aprobad|başvuran|dün|onaylayan|sayın|için$|kimden:?$|owner=$|regards,\n$|saluti,\n$|cordialement,\n$|grüßen,?\n$|saludos,\n$|saygılarımla,\n$|frau$|herrn?$|联系人|申请人|收件人|由$|昨天)"),
}
AGAINST = re.compile(r"(?i)(batch|invoice|rechnung|facture|fattura|factura|fatura|lot|lote|lotto|parti|checksum|build|ticket|order|charge|serial|serie|version|release|isbn|sku|prüfsumme|somme|批次|发票|校验|bestell|colis|parcel no|article|part no|commit|hash|case|no\. of|issue)[^.?!。？\n]{0,14}$")
PROJECT = re.compile(r"(?i)(project|projekt|projet|progetto|proyecto|projesi|release|codename|the|der|die|das|le|la|el|il)\s$")
#: Words a person is often named after, and articles, which more often come before things.
TO_PERSON = re.compile(r"(?i)(?:^|[^\w])(?:to|by|with|thank|thanks to|dear|signed:?|reach|spoke with|asked|told|says|according to|colleague|reviewer|patient|witness|manager|client|author|engineer|teacher|doctor|neighbou?r|about|and|or|an|von|bei|mit|laut|durch|à|avec|par|selon|pour|contactez|con|da|a|según|por|secondo|hablé con|oggi|mrs?\.?|ms\.?|dr\.?|frau|herrn?|madame|monsieur|signora?|señora?)\s$")
ARTICLE = re.compile(r"(?i)(?:^|[^\w])(?:the|a|an|this|each|our|every|der|die|das|dem|den|des|ein|eine|einen|im|am|le|la|les|l'|un|une|des|du|il|lo|gli|i|el|los|las|una|del|bu|bir|of|in|on|at|près de)\s$")
UNITS = re.compile(r"^\s?(?:kg|g\b|mb\b|gb\b|km\b|%|s\b|ms\b|cells|pages|rows|items|hosts|users|eur|usd|€|\$|:\d)", re.I)
FORMATS = [
    re.compile(p)
    for p in (
        r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}",
        r"(?:\+44 ?(?:\(0\))?|0)\d{2,4} \d{3,4} ?\d{3,4}",
        r"(?:\+33 ?|0)\d(?:[ .]\d\d){4}",
        r"(?:\+49 ?(?:\(0\))?|0)\d{2,5}[ /-]\d{3,8}(?:[ -]\d{1,5}){0,2}",
        r"(?:\+34 ?)?[6-9]\d{2}(?: \d{3} \d{3}|(?: \d\d){3}|\d{6})",
        r"(?:\+39 ?)?0\d{1,3}[ /-]\d{4,8}|\+39 \d{2,3} \d{3} \d{3,4}|(?:\+39 ?)?3\d{2} ?\d{6,7}",
        r"(?:\+90 ?|0 ?)\(?\d{3}\)? ?\d{3} ?\d{2} ?\d{2}",
        r"(?:\+86 ?)?1\d{2} ?\d{4} ?\d{4}|0\d{2,3}-\d{4}-\d{4}|(?:\+86 ?)?0?\d{2,3}-\d{7,8}",
        r"\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}",
    )
]
ID_FORMATS = [
    re.compile(p)
    for p in (
        r"\d{3}([- ])\d{2}\1\d{4}",
        r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]",
        r"\d{8}-? ?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",
        r"[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?",
        r"\d{11}|\d{2} \d{3} \d{3} \d{3}",
        r"\d{17}[\dXx]",
        r"[A-Z]{1,2}\d{6,9}",
        r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    )
]
DATE = re.compile(r"(?:19|20)\d{2}[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d{2}|\d{1,3}(?:\.\d{1,3}){3}")


class Plain:
    """Text in plain form with the places of each character in the original."""

    NEEDED = re.compile(
        "[" + "".join(p.pattern.strip("[]").replace("]|[", "") for p in (IGNORABLE, JOINERS, WIDE, SPACES, HYPHENS, SUSPECT)) + "\u0300-\u036f]"
    )
    FORM: dict[str, str] = {}

    def __init__(self, text: str):
        self.original, self.text, self.start, self.end = text, text, None, None
        if text.isascii() or not self.NEEDED.search(text):
            return
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []
        for i, c in enumerate(text):
            form = self.FORM.get(c)
            if form is None:
                form = self.FORM[c] = self._form(c)
            if form == "mark":
                joined = unicodedata.normalize("NFC", out[-1] + c) if out else c
                if out and len(joined) == 1:
                    out[-1], end[-1] = joined, i + 1
                    continue
                form = c
            for part in form:
                out.append(part)
                start.append(i)
                end.append(i + 1)
        self.text, self.start, self.end = "".join(out), start, end

    @staticmethod
    def _form(c: str) -> str:
        if IGNORABLE.match(c) or JOINERS.match(c):
            return ""
        if unicodedata.combining(c):
            return "mark"
        if WIDE.match(c):
            return _compatible(WIDE.match(c))
        if SPACES.match(c):
            return " "
        if HYPHENS.match(c):
            return "-"
        return GROUP.get(c, c)[0] if SUSPECT.match(c) else c

    def place(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _flags(patterns: list[re.Pattern], value: str) -> list[float]:
    return [float(bool(p.fullmatch(value))) for p in patterns]


def _context(kind: str, text: str, a: int, b: int) -> list[float]:
    left = text[max(0, a - 48) : a]
    near = re.split(r"(?<=[.!?。])(?<!\b[Nn][or]\.)(?<!\bn\.)(?<!\bNo\.)\s|[。；]", left)[-1].rstrip(" (<:") if kind != "name" else left.rstrip(" <")
    own = [float(bool(CUES[k].search(near[-34:]))) for k in TYPES]
    return [
        own[TYPES.index(kind)], own[1], own[2],
        float(bool(AGAINST.search(left))), float(bool(UNITS.match(text[b : b + 8]))),
        float(text[a - 1 : a].isalnum() and text[a - 1 : a].isascii()), float(text[b : b + 1].isalnum() and text[b : b + 1].isascii()),
        float(a == 0 or text[a - 1] == "\n"), float(text[b : b + 1] in ("", "\n", "\r")),
    ]


def _email(text: str, a: int, b: int) -> list[float]:
    value = text[a:b]
    last = re.split(r"[.\])} ]+", value)[-1]
    return [
        float("@" in value), float(last.isalpha()), float(2 <= len(last) <= 10), float(bool(re.search(r"@v?\d+(?:\.|$)", value))),
        float("." in value.partition("@")[2] or "ot" in value or "unkt" in value or "unt" in value or "oint" in value or "okta" in value),
        float(text[b : b + 1] in "/:"), float(text[a - 1 : a] in "/@"), float(len(value)),
    ]


def _digits(value: str) -> list[float]:
    groups = re.findall(r"\d+", value)
    return [
        float(sum(map(len, groups))), float(len(groups)), float(max(map(len, groups), default=0)), float("+" in value), float("(" in value),
        float("." in value), float("-" in value), float("/" in value), float(" " in value), float(bool(DATE.fullmatch(value))),
        float(value[:1].isalpha()), float(value[-1:].isalpha()), float(value.count("(") == value.count(")")),
        float(bool(re.fullmatch(r"[1-9]\d{0,2}(?:([ .])\d{3})(?:\1\d{3})*", value))),
    ]


def _address(text: str, a: int, b: int) -> list[float]:
    value = text[a:b]
    tail = value.rpartition(",")[2]
    return [
        float(bool(re.search(r"\d{5}|[A-Z]\d[A-Z\d]? \d[A-Z]{2}|号", value))), float(value.count(",")), float(len(value)), float("\n" in value), float(bool(re.search(r"Box|Postfach|Flat|Mah|市", value))),
        float(bool(STREET_WORD.search(value.partition(",")[0] if "市" not in value else value))), float(bool(re.search(r"\d", tail))), float(value[0].isdigit()), float(len(re.findall(r"\S+", value))),
        float(any(p.fullmatch(value) for p in ADDRESSES[2:])),
    ]


def _name(text: str, a: int, b: int) -> list[float]:
    value = text[a:b]
    parts = value.split(" ")
    after = text[b : b + 14]
    before = text[max(0, a - 26) : a]
    han = not value.isascii() and "一" <= value[0] <= "鿿"
    return [
        float(parts[0] in GIVEN), float(len(parts) > 1 and parts[-1] in GIVEN), float(len(parts)), float(bool(re.search(r" [^\W\d_]\. ", value))),
        float(parts[-1].isupper()), float("-" in parts[-1]), float(bool(re.match(r"-?\d|\.\w|@|[-/]\w", after))), float(bool(PROJECT.search(before))),
        float(bool(re.match(r"(?:'s|’s|,|;| <|\n| asked|\.)", after))), float(bool(re.search(rf"[{UPPER}][\w]+ $", before))),
        float(bool(re.search(r"(?i)\b(?:dr|mr|mrs|ms|prof|sra?|dott|dott\.ssa|mme|m)\.? $|\b(?:frau|herrn?|sayın) $", before))),
        float(parts[0].lower() in COMMON_STARTS), float(han), float(han and value[0] in CJK_SURNAMES), float(han and 2 <= len(value) <= 3), float(bool(re.search(r"\d", value))),
        float(bool(re.match(r" (?:projesi|project|release|index|connector|mirror|team|building|Inc|GmbH|Ltd|AG|SA|LLC)\b", after))),
        float(bool(re.match(rf" [{UPPER}]\w", after))), float(any(c.islower() and c == x for x in parts for c in x[:1])), float(sum(x in GIVEN for x in parts)), float(any(x.lower() in COMMON_STARTS for x in parts[1:])),
        float(max(map(len, parts))), float(min(map(len, parts))), float(not before.strip() or bool(re.search(r"[.!?:。][\"'”’»)]*\s*$|\n\s*$", before))),
        float(bool(re.search(r"[^\W\d_]$", before.rstrip()) and before.endswith(" ") and before.rstrip().rpartition(" ")[2][:1].islower())), float(value.isascii()),
        float(bool(TO_PERSON.search(before))), float(bool(ARTICLE.search(before))), float(bool(re.match(r"[,;]? (?:\w+ )?[a-zà-ÿ]{2,}(?:s|ed|t|te|a|ó|ò|en)\b", text[b : b + 24]))), float(bool(re.match(r"[.,;:!?]|\s*$", after))),
    ]


COMMON_STARTS = frozenset(
    "the a an this that who what when wait please kind best dear item ticket batch invoice team key see read choose our each der die das ein jede wer was kein am im le la les un une "
    "el los las il lo gli un una bu her project projekt project antragsteller applicant caller minutes".split()
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of plain text that may be personal data."""
    out: list[tuple[str, int, int]] = []
    done = 0
    for anchor in AT.finditer(text):
        a = anchor.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        while a < anchor.start() and not text[a].isalnum():
            a += 1
        m = EMAIL.match(text, a)
        if m and ("@" in m.group() or re.search(r"[\])}]| dot ", m.group())):
            out.append(("email", m.start(), m.start() + len(m.group().rstrip(".-"))))
            done = m.end()
    for m in NUMBER.finditer(text):
        value, a = m.group(), m.start()
        if ACCOUNT.search(text, max(0, a - 40), a):
            continue
        if sum(c.isdigit() for c in value) < 7 or DATE.fullmatch(value):
            continue
        ends = [len(value)] + [g.start() for g in re.finditer(r" ", value)]
        for e in ends:
            piece = value[:e]
            if sum(c.isdigit() for c in piece) >= 7:
                out.append(("phone", a, a + e))
                if not piece.startswith(("+", "(")):
                    out.append(("id_number", a, a + e))
    for m in MIXED.finditer(text):
        out.append(("id_number", m.start(), m.end()))
    if any(c.isdigit() for c in text):
        for p, hints in zip(ADDRESSES, HINTS):
            for m in p.finditer(text) if not hints or any(h in text for h in hints) else ():
                out.append(("address", m.start(), m.end()))
    for m in RUN.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in PART.finditer(m.group())]
        for k, (a, b) in enumerate(words):
            if not text[a].isupper() or text[b - 1] == "." or text[a:b].lower() in COMMON_STARTS:
                continue
            full = 1  # words but for initials and particles
            for x, y in words[k + 1 : k + 5]:
                if text[x].isupper() and text[y - 1] != ".":
                    full += 1
                    out.append(("name", a, y))
                    if full == 3:
                        break
    if not text.isascii():
        for m in CJK_NAME.finditer(text):
            out.append(("name", m.start(1), m.end(1)))
    return out


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    own = {
        "email": lambda: _email(text, a, b),
        "phone": lambda: _flags(FORMATS, text[a:b]) + _digits(text[a:b]),
        "id_number": lambda: _flags(ID_FORMATS, text[a:b]) + _flags(FORMATS, text[a:b]) + _digits(text[a:b]),
        "address": lambda: _address(text, a, b),
        "name": lambda: _name(text, a, b),
    }[kind]()
    return own + _context(kind, text, a, b)


def training_spans(seed: int = 3, size: int = 9000) -> list[tuple[str, list[tuple[str, str]]]]:
    """Composed sentences with their personal values, and sentences that only look so."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cap = lambda: rng.choice("BCDFGHKLMNPRSTVW") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice(["er", "ova", "ini", "mann", "ley", "son", "ez", "eau", "oğlu"])
    up = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))
    givens = sorted(GIVEN)

    def surname():
        s = cap()
        return rng.choice([s, s, s, s.upper(), s + "-" + cap()])

    def name():
        g = rng.choice(givens) if rng.random() < 0.67 else outside()
        middle = rng.choice("ABCDEFGHJKL") + ". " if rng.random() < 0.2 else rng.choice(["van ", "von ", "de ", "da ", "del ", "van der ", "al "]) if rng.random() < 0.08 else ""
        return g + " " + middle + surname() + (" " + cap() if rng.random() < 0.06 else "")

    def outside():
        return (rng.choice(["Hi", "Ka", "Mi", "Ya", "Sha", "Te", "O", "Lu", "Bra", "Ni", "Jo", "Ra"]) + rng.choice(["ro", "shi", "ne", "li", "va", "mo", "ki", "dra"]) + rng.choice(["", "", "ko", "n", "na", "to", "sha", "ra"])).capitalize()

    def phone():
        s = rng.choice([" ", "-", "."])
        return rng.choice([
            f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}",
            f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", s.join(["01", d(2), d(2), d(2), d(2)]), f"+49 30 {d(5)} {d(3)}", f"030/{d(8)}", f"0{d(3)} {d(6)}",
            f"9{d(2)} {d(2)} {d(2)} {d(2)}", f"+34 9{d(2)} {d(3)} {d(3)}", f"0{d(2)}/{d(7)}", f"+39 0{d(2)} {d(3)} {d(4)}", f"0212 {d(3)} {d(2)} {d(2)}",
            f"0 (212) {d(7)}", f"+90 (212) {d(3)} {d(2)} {d(2)}", f"1{d(10)}", f"+86 1{d(2)} {d(4)} {d(4)}", f"010-{d(4)}-{d(4)}",
        ])

    def ident():
        s = rng.choice(["-", " "])
        return rng.choice([
            f"{d(3)}{s}{d(2)}{s}{d(4)}", f"X{d(8)}", f"{d(3)}{s}{d(2)}{s}{d(4)}", f"{up(6)}{d(2)}{up(1)}{d(2)}{up(1)}{d(3)}{up(1)}", f"{d(8)}-{up(1)}", f"{d(8)}{up(1)}", d(11),
            f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{rng.choice('12')} {d(2)} 0{rng.choice('123456789')} {d(2)} {d(3)} {d(3)} {d(2)}", f"{rng.choice('12')}{d(2)}0{rng.choice('123456789')}{d(10)}", d(18), d(17) + "X", f"C{d(2)}{up(2)}{d(4)}",
        ])

    def email():
        local, host = (rng.choice(givens).lower() + rng.choice(["_", ".", "+", ""]) + cap().lower() + rng.choice(["", d(2)])), cap().lower() + rng.choice(["", "-desk", ".mail"])
        local = unicodedata.normalize("NFKD", local).encode("ascii", "ignore").decode()
        host = unicodedata.normalize("NFKD", host).encode("ascii", "ignore").decode()
        top = rng.choice(["example", "test", "com", "org", "invalid", "de"])
        return rng.choice([f"{local}@{host}.{top}", f"{local}@{host}.{top}", f"{local}[at]{host}.{top}", f"{local} (at) {host.replace('.', ' (dot) ')} (dot) {top}", f"{local.upper()}@{host}.{top}", f"{local} at {host.split('.')[0]} dot {top}"])

    def address():
        w, t, n = cap() + rng.choice(["mere", "well", "brook"]), cap() + rng.choice(["ton", "ville", ""]), rng.randint(1, 250)
        han = lambda k: "".join(rng.choice("湾澜松溪岚清") for _ in range(k))
        return rng.choice([
            f"{n} {w} {rng.choice(['Street', 'Ave', 'Rd.', 'Lane', 'Drive'])}, {t}, {up(2)} {d(5)}", f"{n} {cap()} {rng.choice(['Gardens', 'Walk', 'Row', 'Hill', 'Mews', 'Green'])}, {t} {up(2)}{d(1)} {d(1)}{up(2)}", f"{w} {n}, {d(5)} {t}", f"Flat {rng.randint(1, 40)}, {n} {w} Road, {t} {up(2)}{d(1)} {d(1)}{up(2)}", f"P.O. Box {n}, {t}",
            f"{w}straße {n}, {d(5)} {t}", f"{w}weg {n}a, {d(5)} {t}", f"{n} rue de {w}, {d(5)} {t}", f"{n} bis, avenue {w}, {d(5)} {t}", f"Via {w} {n}, {d(5)} {t}", f"Piazza {w} {n}, {d(5)} {t}",
            f"Calle {w} {n}, {d(5)} {t}", f"{w} Mah. {t} Sok. No: {n}, {d(5)} {t}", f"{han(2)}市{han(2)}区{han(2)}路{n}号", f"{han(2)}市{han(2)}区{han(2)}路{n}号{rng.randint(1, 9)}单元{d(3)}室",
        ])

    def cjk():
        return rng.choice(CJK_SURNAMES) + "".join(rng.choice("清知若墨溪岚沐星辰言河") for _ in range(rng.choice([1, 2, 2])))

    def word():
        return cap() + "-" + d(3)

    patterns = [
        "Please contact {N} at {E} or {P}.", "Applicant {N}, SSN {I}, asked about {w}.", "{N}'s national ID is {I}.", "Caller on {P} gave {I} as proof.", "Passport no. {I} was scanned twice.",
        "The desk of {w} answers on {P} ext. 12.", "Minutes taken by {N}; questions to {P}.", "We met {N} and {N} at the {w} review.", "{N} has lived at {A} since 2021-03-04.", "The parcel for {w} was left at {A} with {N}.",
        "Ship the replacement for {w} to {A}.", "Kind regards,\n{N}\n{A}\nTel: {P}", "owner={N}; mail={E}; tel={P};", "From: {N} <{E}> The archive keeps it.", "Reply-to: {E}, case 3.", "Send the file to {E} before May 3.",
        "Yesterday {N} asked why it stopped.", "Approved by Dr. {N} for {w}.", "Antragsteller {N}, Steuer-ID {I}, fragte nach {w}.", "Rückrufe zu {w} nimmt {P} entgegen.", "{N} wohnt seit 2020 in {A}.", "Lieferadresse für {w}: {A}.",
        "Gestern fragte {N}, warum {w} stehen blieb.", "Bitte wenden Sie sich an {N} unter {E} oder {P}.", "Freigegeben von Frau {N} am 3. Mai.", "Merci de contacter {N} à {E} ou au {P}.", "L'astreinte de {w} répond au {P}.",
        "Le dossier de {N}, n° de sécurité sociale {I}, concerne {w}.", "{N} habite au {A} depuis mai.", "Livrer {w} à l'adresse {A}.", "Hier, {N} a demandé pourquoi.", "Il codice fiscale di {N} è {I}.", "{N} abita in {A} dal 3 maggio.",
        "Per {w} scrivere a {N}, {E} oppure chiamare {P}.", "Ieri {N} ha chiesto notizie.", "Approvato dalla dott.ssa {N} il 3 maggio.", "El DNI de {N} es {I}.", "{N} vive en {A} desde mayo.", "Para {w} escriba a {N}, {E}, o llame al {P}.",
        "Ayer {N} preguntó por {w}.", "Aprobado por la Sra. {N} hoy.", "Başvuran {N}, T.C. kimlik no {I}, sordu.", "{N} 3 Mayıs tarihinden beri {A} adresinde oturuyor.", "{w} için {N} ile {E} ya da {P} üzerinden görüşün.", "Onaylayan Sayın {N}, tarih 3 Mayıs.",
        "{w}的联系人：{C}，电话 {P}，邮箱 {E}。", "申请人{C}的身份证号为{I}，事由是{w}。", "{w}请寄到{A}，收件人{C}。", "昨天{C}询问{w}为何停止。", "2021年由{C}女士批准了{w}。", "Cordialement,\n{N}\n{P} Le calendrier continue.", "Saygılarımla,\n{N}\n{P} Arama sürüyor.",
        # other wordings
        "The form was signed by {N} and countersigned by {N}.", "Ask for {N} at the front desk, or ring {P}.", "{N} joined in spring; until then {N} ran the archive.", "Our new colleague {N} reads mail at {E}.", "Speak to {N} before the audit.", "A note by {N} came with {w}.", "We agreed with {N} that {w} stays.", "The lawyer told {N}, not {N}.", "As {N} says, {w} is fine.", "Dear {N}, we write about {w}.", "Questions about {N} or {N} go to the desk.", "It was {N} who called.",
        "Wir sprachen mit {N} über {w}.", "Laut {N} ist {w} fertig.", "Eine Notiz von {N} liegt bei.", "Une note de la part de {N} suit.", "Nous parlons avec {N} de {w}.", "Una nota scritta da {N} segue.", "Parliamo con {N} di {w}.", "Una nota escrita por {N} sigue.", "Hablamos con {N} de {w}.", "{N} moved to {A} in June.", "The queue is long. {N} lives in {A}.", "{N} vive in {A}.", "Todo sigue igual. {N} reside en {A}.", "{N} kam im Mai und blieb.", "Payment goes to {N}, {A}.",
        "The witness, {N}, gave the number {P}.", "Thanks to {N} for the notes.", "Unterschrieben hat {N}, geprüft {N}.", "Das Paket ging an {N}, {A}.", "Herr {N} ist unter {P} zu erreichen.", "Die Unterlagen von {N} fehlen.", "Selon {N}, rien ne manque.", "Le colis est pour {N}, {A}.",
        "Madame {N} répond au {P}.", "La firma è di {N}.", "Secondo {N} manca una pagina.", "Il signor {N} risponde al {P}.", "Lo firmó {N} en mayo.", "Según {N}, falta una página.", "Don {N} contesta en el {P}.", "İmza {N} tarafından atıldı.", "{N} Bey {P} numarasında.",
        # sentences without personal data
        "The {s} {s} connector reads the queue of {s} {s}.", "{s} {s} moved to the new hosts.", "Der Dienst {s} {s} liest die Liste.", "Le service {s} {s} relit la liste.", "In {s} the {s} {s} index ran for {n2} minutes, {s} did not.", "Quarterly Report of {s} and {s}.", "Open Data Portal and {s} Mirror agree.",
        "Then {s} restarted. Later {s} stopped.", "Ardından {s} devam etti.", "Sonra {s} durdu. Önce {s} başladı.", "Responde {s} de la lista.", "Después {s} volvió. Luego {s} siguió.", "Danach lief {s} weiter. Zuletzt {s} allein.", "Ensuite {s} est reparti. Puis {s} aussi.",
        "Poi {s} è ripartito. Infine {s} tace.", "Meanwhile {s} waited. Afterwards {s} ran.", "Recently {s} {s} moved.", "{s} Entwürfe und {s} Minuten fehlen.", "Nach {s} Prozent Toleranz lief {s} Protokoll weiter.", "{s} {s} reçoit la liste. {s} {s} copia i dati.", "Quizá {s} lo sepa. Quien {s} pregunta.",
        "The {s} Gateway, the {s} Index and {s} Archive agree.", "Le connecteur {s} {s} répond.", "El conector {s} {s} copia.", "Il connettore {s} {s} legge.", "{s} {s} bağlayıcısı okur.", "Wer {s} {s} prüft, liest mit.", "Ein Blick auf {s} {s} genügt.", "Copies of {s} {s} stay.", "On {s} {s} nothing ran.",
        "Limites de {s} pour {w}.", "Wartungsfenster von {s} und Kopie von {s}.", "Beim Wartungsfenster von {s} fehlt der Index von {s}.", "Le registre de {s} et la copie de {s}.", "El índice de {s} copia el Registro de {s}.", "Limiti di {s}, resumen de {s}.", "Resumen de {s}: Registro de {s}.", "Grenzen von {s} und Kopie von {s}.", "Guide de {s} et Index de {s}.", "Ende {s} Quartals ruht {s}.",
        "The account DE{n2} {n4} {n4} {n4} {n4} {n2} is closed.", "It took {n3} {s} pages, {s} and {s}.", "On Monday Morning {s} restarts.", "New York and Los Angeles keep a copy of {w}.", "See {s} {n2}, {n4} rows of {w}.", "In front of {s} {s} the {s} Review ended.", "Im {s} {s} lief nichts.", "Dans le {s} {s}, rien.",
        "Batch {n4}-{n5}-{n3} weighs 4.5 kg in {w}.", "Invoice 000{n3}-{n2}-{n3} belongs to {w}.", "Rechnung 000{n3}-{n2}-{n3} gehört zu {w}.", "La facture 000{n3}-{n2}-{n3} relève de {w}.", "The checksum {n12} of {w} was read twice.", "The checksum {n11} of {w} was read twice.",
        "批次{n11}属于{w}。", "The team gave it a mark, i.e. {n3} {n3} {n3} café points.", "It holds {n3} {n3} {n3} rows or {n2} {n3} {n3} bytes.", "Somme {n11} pour {w}.", "They counted 6{n2} {n3} {n3} words in {w}.",
        "批次{n12}属于{w}。", "发票000{n3}-{n2}-{n3}属于{w}。", "Ticket INC-2020-00{n3} moved to 192.0.2.{n2}.", "Queue time rose from 2020-03-14 to {n2}.5 s on 10.0.18.7.", "The handle @x_ops posted build {n7}.{n3} of {w}.", "The tag release@v{n1}.{n2}.4 marks {w}.",
        "Project Amber Falcon moved {w} to 300 hosts.", "The Silver Harbor release of {w} ships.", "Projekt Blauer Falke zog um.", "Le lot {n4}.{n5}.{n3} de {w} pèse 4 kg.", "Room {n2}, level 3 of the {w} building stays closed.", "Zimmer {n2}, Ebene 3 bleibt zu.",
        "Key a_{n2}: 0x{n3}AF, see [{n2}].", "The grid has {n2} * {n3} * 4 cells.", "Version v{n1}.{n2}.3 of {w} replaced v1.{n3}.0.", "The serial {n3}-{n3}-{n4} is printed on {w}.", "Order {n3} {n2} {n4} was packed.", "Dr. {s} prüfte die Seite.", "Mr. {s} and Mrs. {s} agreed.",
        "Alice Springs is far from {w}.", "Part no. X{n8} fits {w}.", "The fee moved from $5 to ${n4} for {w}.", "{w}的电话会议在{n2}点。", "负责{w}的采集程序由质量门槛批准了清单。", "由检索团队保留的附件。",
    ]
    out = []
    for i in range(size):
        found: list[tuple[str, str]] = []

        def fill(m: re.Match, found=found) -> str:
            key = m.group(1)
            make = {"N": ("name", name), "P": ("phone", phone), "I": ("id_number", ident), "E": ("email", email), "A": ("address", address), "C": ("name", cjk)}
            if key in make:
                kind, f = make[key]
                value = f()
                found.append((kind, value))
                return value
            return {"w": word, "s": surname}[key]() if key in "ws" else d(int(key[1:]))

        text = re.sub(r"\{(\w+)\}", fill, patterns[i % len(patterns)])
        lead = rng.choice(["", "The archive keeps it. ", "Das Archiv behält es. ", "Le service continue.\n\n"]) if not re.match(r"[{一-鿿]", text) else ""
        out.append((lead + text, found))
    return out


class Finder:
    def __init__(self, models: dict[str, BoostedTrees]):
        self.models = models

    def find_batch(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Accepted spans (type, start, end) of each original text, without overlap."""
        plain = [Plain(t) if t else None for t in texts]
        rows: dict[str, list] = {k: [] for k in TYPES}
        where: dict[str, list[tuple[int, int, int]]] = {k: [] for k in TYPES}
        for i, p in enumerate(plain):
            if p:
                for kind, a, b in set(candidates(p.text)):
                    rows[kind].append(features(kind, p.text, a, b))
                    where[kind].append((i, a, b))
        taken: list[list[tuple[float, int, str, int, int]]] = [[] for _ in texts]
        for kind, x in rows.items():
            if x:
                model = self.models[kind]
                for (i, a, b), p in zip(where[kind], model.predict(np.array(x, dtype=np.float64))):
                    if p >= model.threshold:
                        taken[i].append((-round(float(p), 2), a - b, kind, a, b))
        out: list[list[tuple[str, int, int]]] = []
        for i, spans in enumerate(taken):
            kept: list[tuple[int, int, str]] = []
            for _, _, kind, a, b in sorted(spans):
                if all(b <= x or y <= a for x, y, _ in kept):
                    kept.append((a, b, kind))
            out.append([(kind, *plain[i].place(a, b)) for a, b, kind in sorted(kept)])
        return out


@lru_cache(maxsize=1)
def models() -> dict[str, BoostedTrees]:
    x: dict[str, list] = {k: [] for k in TYPES}
    y: dict[str, list] = {k: [] for k in TYPES}
    for text, true in training_spans():
        for kind, a, b in sorted(set(candidates(text))):
            x[kind].append(features(kind, text, a, b))
            y[kind].append(float((kind, text[a:b]) in true))
    return {k: BoostedTrees(rounds=60).fit(np.array(x[k], dtype=np.float64), np.array(y[k])) for k in TYPES}


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def find_personal(items: DataFrame) -> DataFrame:
    """(item_type, item_id, pii_type, value), one row for each distinct value of an item."""
    fitted = models()
    names = ("item_type", "item_id", "pii_type", "value")

    def make():
        finder = Finder(fitted)

        def step(cols):
            rows = []
            for item, ident, text, spans in zip(cols["item_type"], cols["item_id"], cols["content"], finder.find_batch(cols["content"])):
                rows.extend((item, ident, kind, value) for kind, value in sorted({(k, text[a:b]) for k, a, b in spans}))
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return step

    return map_batches(items.select("item_type", "item_id", "content").where("content <> ''"), make, "item_type string, item_id string, pii_type string, value string", rows=500).distinct()


def redact(items: DataFrame) -> DataFrame:
    """(item_type, item_id, content with placeholders, number of replacements) of every row."""
    fitted = models()

    def make():
        finder = Finder(fitted)

        def step(cols):
            texts, counts = [], []
            for text, spans in zip(cols["content"], finder.find_batch(cols["content"])):
                for kind, a, b in reversed(spans):
                    text = text[:a] + PLACEHOLDER[kind] + text[b:]
                texts.append(text)
                counts.append(len(spans))
            return {"item_type": cols["item_type"], "item_id": cols["item_id"], "redacted": texts, "replaced": counts}

        return step

    return map_batches(items.select("item_type", "item_id", "content"), make, "item_type string, item_id string, redacted string, replaced int", rows=500)
