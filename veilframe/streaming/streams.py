"""Streaming forms of the operators.

Redaction is stateless, so the batch plan runs as it is. Requests wait for responses in a
stream-stream join with watermarks. Pairing codes are keyed state with a fold that batch replays
share.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect as D

# Lifetime of a code, wrong tries until it locks, and how long it stays locked.
TTL_S, TRIES, LOCK_S = 600, 5, 60


def redact_stream(texts: DataFrame, text: str = "text") -> DataFrame:
    """Detections without values, and redacted text, of a stream of texts."""
    return D.process(texts, text)


def answered(requests: DataFrame, responses: DataFrame, timeout: str = "60 seconds", late: str = "10 seconds") -> DataFrame:
    """requests (client, id, at) with status: that of a response within the timeout, or "timeout"
    once the watermark has passed it."""
    q = requests.withWatermark("at", late).select("client", "id", F.col("at").alias("asked_at"))
    r = responses.withWatermark("at", late).select(F.col("client").alias("r_client"), F.col("id").alias("r_id"), F.col("at").alias("answered_at"), "status")
    near = F.expr(f"client = r_client and id = r_id and answered_at >= asked_at and answered_at <= asked_at + interval {timeout}")
    return q.join(r, near, "leftOuter").select("client", "id", "asked_at", "answered_at", F.coalesce("status", F.lit("timeout")).alias("status"))


def distinct_requests(requests: DataFrame, late: str = "60 seconds") -> DataFrame:
    """Requests less those whose id came before at the same client within the watermark."""
    return requests.withWatermark("at", late).dropDuplicatesWithinWatermark(["client", "id"])


MESSAGES = "client string, id string, at double, kind string, outcome string"


def request_step(pending: dict[str, float], kind: str, id_: str, at: float, timeout: float = 60.0) -> str:
    """The outcome of a client's message; pending (id to time asked) changes with it.

    A request is sent, or duplicate-id while the same id is pending; a response answers, or is
    dropped if nothing is pending; after the timeout nothing is; close sweeps all that is pending.
    """
    for old in [i for i, asked in pending.items() if at > asked + timeout]:
        del pending[old]
    if kind == "close":
        swept = len(pending)
        pending.clear()
        return f"swept {swept}"
    if kind == "request":
        if id_ in pending:
            return "duplicate-id"
        pending[id_] = at
        return "sent"
    return "dropped" if pending.pop(id_, None) is None else "answered"


def _requests(pdf: pd.DataFrame, pending: dict[str, float]) -> pd.DataFrame:
    rows = [(m.client, m.id, m.at, m.kind, request_step(pending, m.kind, m.id, m.at)) for m in pdf.sort_values(["at", "kind", "id"]).itertuples()]
    return pd.DataFrame(rows, columns=["client", "id", "at", "kind", "outcome"])


def replay_requests(messages: DataFrame) -> DataFrame:
    """Outcomes of messages (client, id, at in seconds, kind: request, response or close) in batch."""
    chosen = messages.select("client", "id", F.col("at").cast("double").alias("at"), "kind")
    return chosen.groupBy("client").applyInPandas(lambda pdf: _requests(pdf, {}), MESSAGES)


def _timed(events: DataFrame, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Events with a time of their own for the watermark, which drops those that are later; one
    second on, as a watermark begins at 0 and drops what is at 0."""
    at = F.col("at").cast("double")
    return events.select(*keys, at.alias("at"), "kind", F.timestamp_seconds(at + 1).alias("event_time")).withWatermark("event_time", late)


def _until(state: GroupState, at: float) -> None:
    """Forget the state once the watermark has passed a time."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1000))


def stream_requests(messages: DataFrame) -> DataFrame:
    """The same on a stream, in order of time within a batch; a client whose last request is twice the
    timeout behind the watermark is forgotten."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = json.loads(state.get[0]) if state.exists else {}
        yield _requests(pd.concat(list(batches)), pending)
        state.update((json.dumps(pending),))
        _until(state, max(pending.values(), default=0.0) + 2 * 60.0)

    chosen = _timed(messages, "client", "id")
    return chosen.groupBy("client").applyInPandasWithState(fold, MESSAGES, "pending string", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass
class Code:
    """State of one pairing code."""

    made: float
    tries: int = 0
    locked: float = 0.0
    used: bool = False


def step(code: Code | None, kind: str, at: float) -> tuple[Code | None, str]:
    """The state after an event (issue, right or wrong) and its outcome."""
    if kind == "issue":
        return Code(at), "issued"
    if code is None or code.used:
        return code, "unknown"
    if at - code.made > TTL_S:
        return code, "expired"
    if at < code.locked:
        return code, "locked"
    if kind == "right":
        code.used = True
        return code, "ok"
    code.tries += 1
    if code.tries >= TRIES:
        code.tries, code.locked = 0, at + LOCK_S
        return code, "locked"
    return code, "incorrect"


OUTCOMES = "code_id string, at double, kind string, outcome string"


def replay_codes(events: DataFrame) -> DataFrame:
    """Outcomes of pairing events (code_id, at in seconds, kind), in order of time, in batch."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        code, rows = None, []
        for e in pdf.sort_values(["at", "kind"]).itertuples():
            code, outcome = step(code, e.kind, e.at)
            rows.append((e.code_id, e.at, e.kind, outcome))
        return pd.DataFrame(rows, columns=["code_id", "at", "kind", "outcome"])

    return events.select("code_id", F.col("at").cast("double").alias("at"), "kind").groupBy("code_id").applyInPandas(fold, OUTCOMES)


def stream_codes(events: DataFrame) -> DataFrame:
    """The same on a stream, events of a batch in order of time. A code whose last event is
    twice its lifetime behind the watermark is forgotten."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        code = Code(*state.get) if state.exists else None
        rows = []
        for e in pd.concat(list(batches)).sort_values(["at", "kind"]).itertuples():
            code, outcome = step(code, e.kind, e.at)
            rows.append((e.code_id, e.at, e.kind, outcome))
        if code is not None:
            state.update((code.made, code.tries, code.locked, code.used))
            _until(state, rows[-1][1] + 2 * TTL_S)
        yield pd.DataFrame(rows, columns=["code_id", "at", "kind", "outcome"])

    chosen = _timed(events, "code_id")
    return chosen.groupBy("code_id").applyInPandasWithState(fold, OUTCOMES, "made double, tries int, locked double, used boolean", "append", GroupStateTimeout.EventTimeTimeout)
