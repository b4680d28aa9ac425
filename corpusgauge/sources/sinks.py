"""Sinks: canonical JSON, guarded CSV, HTML of a bounded report, appended history."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CELL = 32_000


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One canonical JSON object a line, keys in order; refuses to overwrite unless told."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV whose text cells cannot be read as formulas, bounded and without control characters."""
    cells = [T.guard_cell(F.substring(T.replace_controls(c), 1, MAX_CELL)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    df.select(*cells).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def append_history(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def render_html(title: str, findings: DataFrame, max_rows: int = 500) -> str:
    """A self-contained page of at most ``max_rows`` findings; everything is escaped."""
    rows = findings.limit(max_rows).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in findings.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str('' if v is None else v))}</td>" for v in r) + "</tr>" for r in rows)
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>'


def render_terminal(findings: DataFrame, max_rows: int = 50) -> str:
    rows = [" | ".join("" if v is None else str(v) for v in r) for r in findings.limit(max_rows).collect()]
    return "\n".join([" | ".join(findings.columns), *rows])


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
