"""Test plans against a target: control plane on the driver, observations judged as one batch.

The target is any callable that takes a payload and returns an observation; transports
live outside this package. A plan is authorised, bounded and sequential; nothing here reads corpus rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

OBSERVATION = (
    "id string, case_id string, payload string, is_control boolean, status int, body string, tools array<string>, functions array<string>, finish string, transport_error string, "
    "unsafe array<string>, safe array<string>, ambiguous array<string>"
)


@dataclass
class Case:
    id: str
    payloads: list[str]
    unsafe: list[str] = field(default_factory=list)
    safe: list[str] = field(default_factory=list)
    ambiguous: list[str] = field(default_factory=list)
    control: str | None = None
    severity: str = "high"
    destructive: bool = False


@dataclass
class Plan:
    cases: list[Case]
    authorized: bool = False
    max_requests: int = 100
    max_seconds: float = 300.0
    max_failures: int = 5
    allow_destructive: bool = False
    stop_on_critical: bool = False


def load_cases(text: str, values: dict[str, str] | None = None) -> list[Case]:
    """Enabled cases of a published JSON test pack, ``{{NAME}}`` placeholders filled from ``values``; repeated ids and placeholders without a value are refused."""
    values = values or {}

    def fill(payload: dict) -> str:
        missing = set(re.findall(r"\{\{(\w+)\}\}", payload["content"])) - set(values)
        if missing:
            raise ValueError(f"{payload['id']}: no value for {sorted(missing)}")
        return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m.group(1)], payload["content"])

    rows = json.loads(text)["test_cases"]
    ids = [r["id"] for r in rows] + [p["id"] for r in rows for p in r["payloads"]]
    if len(set(ids)) != len(ids):
        raise ValueError("case or payload ids repeat")
    return [
        Case(
            r["id"], [fill(p) for p in r["payloads"]], r.get("unsafe_indicators", []), r.get("safe_indicators", []), r.get("ambiguous_indicators", []), fill(r["control_payload"]) if r.get("control_payload") else None,
            r["severity"], r.get("side_effect_risk", "none") == "destructive",
        )
        for r in rows if r.get("enabled", True)
    ]


def shows_unsafe(case: Case, seen: dict) -> bool:
    """Whether a response holds one of the case's unsafe texts, tools or functions."""
    body, called = (seen.get("body") or "").lower(), {f"tool:{t}" for t in seen.get("tools", [])} | {f"function:{f}" for f in seen.get("functions", [])}
    return any(i in called or not re.match(r"(?:tool|function|field|status|finish|exact|regex):", i) and i.removeprefix("contains:").lower() in body for i in case.unsafe)


def execute(plan: Plan, target: Callable[[str], dict], clock: Callable[[], float] = time.monotonic) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Observations in order, controls first, and what was skipped with its reason.

    With ``stop_on_critical`` an attack of a critical case that shows an unsafe indicator ends the plan.
    """
    if not plan.authorized:
        raise PermissionError("the plan is not authorised")
    rows: list[tuple] = []
    skipped: list[tuple[str, str]] = []
    began, failures, stopped = clock(), 0, False
    for case in plan.cases:
        if stopped:
            skipped.append((case.id, "critical"))
            continue
        if case.destructive and not plan.allow_destructive:
            skipped.append((case.id, "destructive"))
            continue
        todo = [(case.control, True)] if case.control else []
        for payload, control in [*todo, *((p, False) for p in case.payloads)]:
            reason = "budget" if len(rows) >= plan.max_requests else "duration" if clock() - began > plan.max_seconds else "failures" if failures >= plan.max_failures else None
            if reason:
                skipped.append((case.id, reason))
                break
            try:
                seen = target(payload)
            except Exception as error:  # noqa: BLE001  (a failing target is an observation)
                seen = {"transport_error": type(error).__name__}
                failures += 1
            rows.append((
                f"{case.id}:{len(rows)}", case.id, payload, control, seen.get("status"), seen.get("body"), seen.get("tools", []), seen.get("functions", []), seen.get("finish"), seen.get("transport_error"),
                case.unsafe, case.safe, case.ambiguous,
            ))
            if plan.stop_on_critical and not control and case.severity == "critical" and shows_unsafe(case, seen):
                stopped = True
                break
    return rows, skipped


def observations(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, OBSERVATION)
