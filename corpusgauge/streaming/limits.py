"""Stateful operators: sliding-window rate limit and job leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMITED = "key string, event_id bigint, ts timestamp, accepted boolean"


def rate_limited(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, event_id, ts, accepted): at most ``limit`` accepted requests of a key in any ``seconds``.

    A refused request takes no place. State is the accepted times still inside the window,
    so at most ``limit`` of them. Input: (key, event_id, ts); rows of a batch are taken in time order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        taken = list(state.get[0]) if state.exists else []
        accepted = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            taken = [x for x in taken if x > t - seconds * 1_000_000]
            ok = len(taken) < limit
            if ok:
                taken.append(int(t))
            accepted.append(ok)
        state.update((taken,))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(), "accepted": accepted})

    return events.groupBy("key").applyInPandasWithState(step, LIMITED, "taken array<bigint>", "append", GroupStateTimeout.NoTimeout)


LEASES = "job_id string, state string, attempts int, worker string"


def job_states(events: DataFrame, max_attempts: int = 3, lease_seconds: int = 60, lateness: str = "0 seconds") -> DataFrame:
    """State of each job after its events (job_id, ts, action, worker): enqueue, claim, heartbeat, complete, fail, cancel.

    A claim or heartbeat holds the lease for ``lease_seconds`` of event time; a claim of
    another worker is refused while it holds and takes over once it has run out. A lease that runs out is also seen
    without another event of its job, when the watermark (``lateness`` behind the latest event) passes it.
    """

    def expired(attempts: int) -> str:
        return "failed" if attempts >= max_attempts else "queued"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, attempts, worker, lease = state.get if state.exists else ("absent", 0, "", 0)
        if state.hasTimedOut:
            name, worker = (expired(attempts), "") if name == "running" else (name, worker)
        else:
            rows = pd.concat(list(batches)).sort_values("ts")
            for t, action, who in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["action"], rows["worker"]):
                if name == "running" and lease <= t:
                    name, worker = expired(attempts), ""
                if action == "enqueue" and name == "absent":
                    name = "queued"
                elif action == "claim" and name == "queued":
                    name, attempts, worker, lease = "running", attempts + 1, who, int(t) + lease_seconds * 1_000_000
                elif action == "heartbeat" and name == "running" and who == worker:
                    lease = int(t) + lease_seconds * 1_000_000
                elif action == "complete" and name == "running" and who == worker:
                    name = "succeeded"
                elif action == "fail" and name == "running" and who == worker:
                    name, worker = expired(attempts), ""
                elif action == "cancel" and name in ("queued", "running"):
                    name = "cancelled"
        state.update((name, int(attempts), worker or "", int(lease)))
        if name == "running":
            state.setTimeoutTimestamp(max(int(lease) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "state": [name], "attempts": [int(attempts)], "worker": [worker or ""]})

    return (
        events.withWatermark("ts", lateness)
        .groupBy("job_id")
        .applyInPandasWithState(step, LEASES, "name string, attempts int, worker string, lease bigint", "update", GroupStateTimeout.EventTimeTimeout)
    )
