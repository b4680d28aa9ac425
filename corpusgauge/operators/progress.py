"""Progress, observed counts and time limits of a running scan."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with its row count observed as it runs; ``observation.get`` has it after the action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Events:
    """Sends progress events to sinks; a failing sink never ends the scan."""

    def __init__(self, *sinks: Callable[[str, dict], None]):
        self.sinks = sinks

    def emit(self, kind: str, **fields) -> None:
        for sink in self.sinks:
            try:
                sink(kind, fields)
            except Exception:  # noqa: BLE001,S112
                continue


@contextmanager
def time_limit(spark: SparkSession, seconds: float, group: str) -> Iterator[None]:
    """Run actions in a job group that is cancelled when the time is up."""
    spark.sparkContext.setJobGroup(group, f"at most {seconds} s", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def score_policy() -> dict:
    """Snapshot of what the scores rest on, to be stored with a report."""
    from ..functions import patterns as P

    return {"version": "1.0.0", "weights": dict(P.WEIGHTS), "severity_penalties": dict(P.SEVERITY_PENALTY), "issue_penalties": dict(P.ISSUE_PENALTY), "critical_cap": 54.99, "needs_dimensions": 2}


def upgrade_report(report: dict) -> dict:
    """A stored report in today's form: retired parts dropped, the overall score renewed from what remains.

    Weights count for the dimensions that are not null; under two of them there is no overall score.
    """
    out = {k: v for k, v in report.items() if k not in ("consistency", "consistency_findings")}
    scores = {k: v for k, v in (report.get("scores") or {}).items() if k not in ("consistency", "overall")}
    policy = score_policy()
    known = {k: scores[k] for k in policy["weights"] if scores.get(k) is not None}
    total = sum(policy["weights"][k] for k in known)
    overall = round(sum(v * policy["weights"][k] for k, v in known.items()) / total, 6) if len(known) >= 2 else None
    if overall is not None and (report.get("finding_counts") or {}).get("critical") and overall > policy["critical_cap"]:
        overall = policy["critical_cap"]
    out["findings"] = [f for f in report.get("findings", []) if f.get("category") != "consistency"]
    out["scores"] = scores | {"overall": overall}
    out["schema_version"] = "1.0.0"
    return out
