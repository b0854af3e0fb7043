"""Online behaviour as Structured Streaming: sessions, prototypes, incremental assignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_events(photos: DataFrame, owner: str, ts: str, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Events of a stream of photos; a closed event is final once the watermark passes it."""
    rows = photos.withWatermark(ts, late).groupBy(owner, F.session_window(ts, gap).alias("w"))
    return rows.agg(F.count("*").alias("photo_count"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time")).drop("w")


def prototype_updates(corrections: DataFrame, floor: float = 0.001) -> DataFrame:
    """Running prototypes from a stream of (cluster, seq, embedding, weight, is_addition).

    Additions and removals move the weighted mean; a removal leaves ``floor`` of
    weight at least, and the last member's removal ends the prototype.
    """
    import numpy as np

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        centre, weight, members = (np.array(state.get[0]), state.get[1], state.get[2]) if state.exists else (None, 0.0, 0)
        for pdf in batches:
            for row in pdf.sort_values("seq").itertuples():
                v, w = np.array(row.embedding, float), float(row.weight)
                if row.is_addition:
                    centre = v * w if centre is None else centre * weight + v * w
                    weight, members = weight + w, members + 1
                elif centre is not None:
                    members -= 1
                    if members <= 0:
                        centre, weight, members = None, 0.0, 0
                        continue
                    centre, weight = centre * weight - v * w, max(weight - w, floor)
                else:
                    continue
                length = np.linalg.norm(centre)
                centre = centre / length if length > 0 else centre
        if centre is None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"cluster": [key[0]], "centroid": [None], "member_count": [0], "total_weight": [0.0]})
        else:
            state.update((centre.tolist(), weight, members))
            yield pd.DataFrame({"cluster": [key[0]], "centroid": [centre.tolist()], "member_count": [members], "total_weight": [weight]})

    return corrections.groupBy("cluster").applyInPandasWithState(
        update,
        "cluster int, centroid array<double>, member_count int, total_weight double",
        "centroid array<double>, weight double, members int",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def threshold_updates(corrections: DataFrame, owner: str, start: float = 0.7, step: float = 0.02, low: float = 0.4, high: float = 0.95) -> DataFrame:
    """Running thresholds from a stream of (owner, seq, action): merges lower them, splits raise them, within limits.

    Each micro-batch gives the owners it touches (owner, threshold, merges, splits). A batch's corrections count in order
    of ``seq``; what comes in a later batch counts later. Other or null actions move nothing.
    """
    kind = corrections.schema[owner].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, merges, splits = state.get if state.exists else (start, 0, 0)
        for action in pd.concat(list(batches)).sort_values("seq", kind="stable")["action"]:
            if action == "merge":
                now, merges = max(low, now - step), merges + 1
            elif action == "split":
                now, splits = min(high, now + step), splits + 1
        state.update((now, merges, splits))
        yield pd.DataFrame({owner: [key[0]], "threshold": [now], "merges": [merges], "splits": [splits]})

    return corrections.groupBy(owner).applyInPandasWithState(
        update,
        f"`{owner}` {kind}, threshold double, merges long, splits long",
        "threshold double, merges long, splits long",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def assign_stream(faces: DataFrame, assign: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch of new faces to ``assign(batch, epoch)``."""
    return faces.writeStream.foreachBatch(assign).option("checkpointLocation", checkpoint).start()
