"""Files as documents: discovery, bounds, decoding, parsing, change feeds."""

from __future__ import annotations

import fnmatch
import html
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 20_000_000
TEXT_EXTENSIONS = "txt md markdown rst adoc csv tsv json jsonl yaml yml xml html htm log".split()
ARCHIVE_EXTENSIONS = "docx pptx xlsx odt epub".split()
ENTRY_BYTES, RATIO = 50_000_000, 200


def glob_pattern(pattern: str) -> str:
    """A path regex of a glob; a leading ``**/`` also matches the top."""
    rest = pattern.removeprefix("**/")
    translated = [fnmatch.translate(p) for p in {pattern, rest}]
    return "|".join(t.replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$") for t in translated)


def matches(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    kept = F.lit(not include)
    for p in include:
        kept = kept | path.rlike("^(?:" + glob_pattern(p) + ")")
    for p in exclude:
        kept = kept & ~path.rlike("^(?:" + glob_pattern(p) + ")")
    return kept


def discover(spark: SparkSession, root: str, *, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = (*TEXT_EXTENSIONS, *ARCHIVE_EXTENSIONS)) -> DataFrame:
    """(external_id, path, size, modified_at, version, skipped): files under a root, hidden ones left out.

    Content is not read: the size filter reaches the binary source before any byte does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    relative = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(F.col("size") > max_bytes, "too_large").when(~extension.isin(*extensions), "extension")
    listed = files.select(relative.alias("external_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    return listed.where(~F.col("external_id").rlike(r"(^|/)\.") & matches(F.col("external_id"), include, exclude)).select(
        "*", F.concat_ws(":", F.unix_micros("modified_at").cast("string"), F.col("size").cast("string")).alias("version"), reason.alias("skipped")
    )


def binary_looking(data: bytes) -> bool:
    head = data[:4096]
    if b"\0" in head:
        return True
    odd = sum(b < 9 or 13 < b < 32 for b in head)
    return bool(head) and odd / len(head) > 0.30


def decode(data: bytes, fallbacks: tuple[str, ...] = ("cp1252", "latin-1")) -> tuple[str, str, bool]:
    """Text, encoding, and whether characters were replaced."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig", "replace"), "utf-8-sig", False
    for encoding in ("utf-8", *fallbacks):
        try:
            return data.decode(encoding), encoding, False
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8", True


_FRONT = re.compile(r"\A---\n(.{0,16384}?)\n---\n", re.S)
_KEY = re.compile(r"^([A-Za-z][\w-]{0,63}):[ \t]*(.{0,1024})$")
_SECRET_KEY = re.compile(r"(?i)authorization|api[_-]?key|token|secret|password|credential|cookie")


def parse_markdown(text: str, stem: str = "") -> dict:
    """Front matter (scalars only, secrets redacted), headings outside fences, title."""
    text = re.sub(r"\r\n?", "\n", text)
    meta: dict[str, str] = {}
    if m := _FRONT.match(text):
        for line in m.group(1).split("\n")[:100]:
            if k := _KEY.match(line):
                meta[k.group(1)] = "[REDACTED]" if _SECRET_KEY.search(k.group(1)) else k.group(2).strip().strip("\"'")
    headings, fence = [], None
    for n, line in enumerate(text.split("\n"), 1):
        if f := re.match(r"\s*(```|~~~)", line):
            fence = None if fence == f.group(1) else fence or f.group(1)
        elif fence is None and (h := re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)):
            headings.append((len(h.group(1)), n, h.group(2)))
    first = next((t for level, _, t in headings if level == 1), None)
    return {"content": text, "metadata": meta, "headings": headings, "title": meta.get("title") or first or stem}


def canonical_entities(text: str) -> str:
    """Character references that end in a semicolon, undone once."""
    return re.sub(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", lambda m: html.unescape(m.group()), text)


_MEMBERS = {
    "docx": r"word/document\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+)\.xml$", "odt": r"content\.xml$", "epub": r".*\.x?html?$",
}


def _natural(name: str) -> list:
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


def parse_archive(data: bytes, extension: str) -> tuple[str, list[str]]:
    """Text of all members of an office archive and warnings; entity declarations, path tricks and bombs are refused."""
    warnings: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > 10_000 or any(i.file_size > ENTRY_BYTES or i.file_size > RATIO * max(1, i.compress_size) for i in infos):
            raise ValueError("archive exceeds its limits")
        if any(i.filename.startswith("/") or ".." in PurePosixPath(i.filename).parts for i in infos):
            raise ValueError("archive has unsafe paths")
        if any("vbaProject" in i.filename for i in infos):
            warnings.append("macros_present")
        names = sorted((i.filename for i in infos if re.search(_MEMBERS[extension], i.filename)), key=_natural)
        parts = []
        for name in names:
            raw = z.read(name)
            if b"<!ENTITY" in raw or (b"<!DOCTYPE" in raw and extension != "epub"):
                raise ValueError("entity declarations are refused")
            if extension == "epub":
                parts.append(canonical_entities(re.sub(rb"<[^>]*>", b" ", raw).decode("utf-8", "replace")))
                continue
            for node in ElementTree.fromstring(raw).iter():
                tag = node.tag.rpartition("}")[2]
                if tag == "vanish" and "hidden_text_present" not in warnings:
                    warnings.append("hidden_text_present")
                if tag in ("p", "h", "row", "si"):
                    text = "".join(t.text or "" for t in node.iter() if t.tag.rpartition("}")[2] in ("t", "span", "v") or t is node and extension == "odt")
                    if text.strip():
                        parts.append(text.strip())
    return "\n".join(parts), warnings


def route(mime: Column, path: Column) -> Column:
    """Parser for a file: by MIME type first, then by extension."""
    m, ext = F.lower(F.regexp_replace(F.coalesce(mime, F.lit("")), ";.*$", "")), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    by_mime = F.when(m == "text/markdown", "markdown").when(m == "application/pdf", "pdf").when(m.like("%officedocument%") | m.like("%opendocument%") | (m == "application/epub+zip"), "archive").when(m.like("text/%") | m.isin("application/json", "application/xml", "application/x-tex"), "text")
    by_ext = F.when(ext.isin("md", "markdown"), "markdown").when(ext == "pdf", "pdf").when(ext.isin(*ARCHIVE_EXTENSIONS), "archive").when(ext.isin(*TEXT_EXTENSIONS), "text")
    return F.coalesce(by_mime, by_ext, F.lit("unsupported"))


PARSED = "external_id string, title string, content string, encoding string, warnings array<string>, metadata map<string,string>, error string"


def read_documents(spark: SparkSession, root: str, **options) -> DataFrame:
    """Discovered files, decoded and parsed; a file that fails or is skipped gives a row with its error, the others go on."""
    found = discover(spark, root, **options)
    listed = found.where("skipped is null").select("external_id", "path")
    data = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ident, raw in zip(b["external_id"], b["content"]):
                ext = ident.rpartition(".")[2].lower()
                stem = PurePosixPath(ident).stem
                try:
                    if ext in ARCHIVE_EXTENSIONS:
                        text, warnings = parse_archive(raw, ext)
                        rows.append((ident, stem, text, None, warnings, {}, None))
                        continue
                    if binary_looking(raw):
                        raise ValueError("binary content")
                    text, encoding, replaced = decode(raw)
                    warnings = ["characters_replaced"] if replaced else []
                    if ext in ("md", "markdown"):
                        doc = parse_markdown(text, stem)
                        rows.append((ident, doc["title"], doc["content"], encoding, warnings, doc["metadata"], None))
                    else:
                        rows.append((ident, stem, re.sub(r"\r\n?", "\n", text), encoding, warnings, {}, None))
                except Exception as error:  # noqa: BLE001  (one bad file must not end the scan)
                    rows.append((ident, stem, None, None, [], {}, f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", PARSED)])

    none = F.lit(None)
    skipped = found.where("skipped is not null").select(
        "external_id", none.cast("string").alias("title"), none.cast("string").alias("content"), none.cast("string").alias("encoding"), F.array().cast("array<string>").alias("warnings"),
        F.create_map().cast("map<string,string>").alias("metadata"), F.concat(F.lit("skipped: "), "skipped").alias("error"),
    )
    return listed.join(data, "path").select("external_id", "content").mapInPandas(run, PARSED).unionByName(skipped)


def candidates(items: DataFrame) -> DataFrame:
    """Folders by how many supported files they hold."""
    folder = F.regexp_replace("external_id", "/?[^/]*$", "")
    return items.where("skipped is null").groupBy(folder.alias("folder")).agg(F.count("*").alias("files")).orderBy(F.col("files").desc(), "folder")
