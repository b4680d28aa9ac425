"""Command line: scan a folder, compare two reports, list queries.

Exit codes: 0 done, 1 failed, 2 bad usage, 3 findings at or above --fail-on.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import replace

from . import config as C
from .functions.patterns import SEVERITY_RANK
from .sources.sinks import canonical


def _write(text: str, path: str | None, overwrite: bool) -> None:
    if path is None:
        print(text)
        return
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(f"{path} exists; use --overwrite")
    part = path + ".part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    os.replace(part, path)


def compare_reports(before: dict, after: dict) -> dict:
    a = {f["fingerprint"]: f["severity"] for f in before["findings"]}
    b = {f["fingerprint"]: f["severity"] for f in after["findings"]}
    same = before.get("schema_version") == after.get("schema_version")
    return {
        "new": sorted(b.keys() - a.keys()), "resolved" if same else "not_observed": sorted(a.keys() - b.keys()),
        "severity_changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k]), "recurring": sorted(k for k in a.keys() & b.keys() if a[k] == b[k]),
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusgauge")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a folder")
    s.add_argument("path")
    s.add_argument("--config")
    s.add_argument("--output")
    s.add_argument("--overwrite", action="store_true")
    s.add_argument("--fail-on", choices=list(SEVERITY_RANK))
    s.add_argument("--master", default="local[*]")
    s.add_argument("--pii", action="store_true")
    c = sub.add_parser("compare", help="compare two JSON reports")
    c.add_argument("before")
    c.add_argument("after")
    sub.add_parser("queries", help="list the named queries")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        from . import plans

        print("\n".join(sorted(plans.queries())))
        return 0
    try:
        if args.command == "compare":
            with open(args.before, encoding="utf-8") as a, open(args.after, encoding="utf-8") as b:
                print(canonical(compare_reports(json.load(a), json.load(b))))
            return 0
        from . import pipeline
        from .session import session

        config = C.load(args.config) if args.config else C.Config()
        config = replace(config, scan=replace(config.scan, root=args.path), rules=replace(config.rules, pii=config.rules.pii or args.pii))
        docs, errors = pipeline.from_files(session(args.master), config)
        out = pipeline.report(pipeline.scan(docs, config, errors=errors), config)
        _write(canonical(out), args.output, args.overwrite)
        limit = args.fail_on or config.report.fail_on
        if limit and any(SEVERITY_RANK[s] >= SEVERITY_RANK[limit] for s in out["finding_counts"]):
            return 3
        return 0 if out["status"] != "failed" else 1
    except (OSError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
