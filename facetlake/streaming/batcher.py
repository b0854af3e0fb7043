"""Requests of a stream in batches: full ones, urgent ones at once, the rest after a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batched_requests(requests: DataFrame, worker: str, request_id: str, urgent: str, most: int = 16, wait_ms: int = 200) -> DataFrame:
    """(worker, batch, place, request_id, reason): the requests of each worker in batches of at most ``most``.

    A batch goes when ``most`` requests are pending (``full``), when one of them is urgent (``urgent``), or ``wait_ms``
    after the first pending one came (``waited``). Urgent requests go first, others in the order of their ids among what came together
    (an Arrow batch of the worker's rows). A null urgency is none; a null id is a request with a null id.

    The state of a worker has fewer than ``most`` requests, none of them urgent, and its timer outlives a restart.
    Batches of a worker count from 0. Deal requests to workers by a hash of their ids, so that no worker is hot.
    """
    kind = requests.schema[worker].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, pending, since = state.get if state.exists else (0, [], 0)
        pending, now = list(pending), state.getCurrentProcessingTimeMs()

        def flushed(ids: list[str | None], reason: str) -> pd.DataFrame:
            nonlocal number
            number += 1
            n = len(ids)
            return pd.DataFrame({"worker": [key[0]] * n, "batch": [number - 1] * n, "place": range(n), "request_id": ids, "reason": [reason] * n})

        if state.hasTimedOut:
            yield flushed(pending, "waited")
            pending = []
        else:
            for pdf in batches:
                rows = pdf.sort_values("request_id", kind="stable")
                flags = rows["urgent"].fillna(False).astype(bool)
                first, rest = rows.loc[flags, "request_id"].tolist(), pending + rows.loc[~flags, "request_id"].tolist()
                place, kept = 0, len(pending)
                while first or len(rest) - place >= most:
                    ids, hurry = first[:most], bool(first)
                    first = first[most:]
                    low = rest[place : place + most - len(ids)]
                    place += len(low)
                    full = len(ids) + len(low) == most
                    yield flushed(ids + low, "full" if full or not hurry else "urgent")
                pending = rest[place:]
                since = now if place >= kept else since
        if pending:
            state.update((number, pending, since))
            state.setTimeoutDuration(max(1, since + wait_ms - now))
        else:
            state.update((number, [], 0))

    rows = requests.selectExpr(f"`{worker}` AS worker", f"CAST(`{request_id}` AS string) AS request_id", f"`{urgent}` AS urgent")
    made = rows.groupBy("worker").applyInPandasWithState(
        update,
        f"worker {kind}, batch long, place int, request_id string, reason string",
        "number long, pending array<string>, since long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return made.withColumnsRenamed({"worker": worker, "request_id": request_id})
