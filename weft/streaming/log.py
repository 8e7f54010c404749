"""The mutation log and the observer as streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.folds import Tracker
from weft.operators.namespace import replay
from weft.sources.store import VersionedTable


def apply_log(stream: DataFrame, inodes: VersionedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply each micro-batch of the log (seq, op, ino, size) to the table and publish a new version.

    A version remembers the last sequence that it holds, so a batch that runs again after a failure, or
    a record that comes late, changes nothing.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        applied = inodes.meta().get("applied", -1)
        new = batch.where(F.col("seq") > applied)
        last = new.agg(F.max("seq")).first()[0]
        if last is not None:
            inodes.publish(replay(inodes.read(), new, applied).select("ino", "size", "nlink"), applied=last)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def regimes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, regime) of a stream of measurements; each key's tracker is kept as state between micro-batches.

    Rows of a batch are taken in order; one that comes after a later row of its key was taken is dropped.
    """
    kinds = dict(stream.dtypes)
    fields = "level double, rate double, seen long, window long, before double, last long"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *values, last = state.get if state.exists else (*astuple(Tracker()), -(1 << 62))
        t = Tracker(*values)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows = rows[rows[order] > last]
        rows["regime"] = [t.step(v) for v in rows[value]]
        if len(rows):
            state.update((*(float(x) if isinstance(x, float) else int(x) for x in astuple(t)), int(rows[order].iloc[-1])))
        yield rows.assign(**{key: k[0]})[[key, order, "regime"]]

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, regime string", fields, "append", GroupStateTimeout.NoTimeout)


def running_totals(stream: DataFrame, key: str) -> DataFrame:
    """Touches and hotness of each key so far, for the update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("touches"), (10 * (1 - F.pow(F.lit(0.9), F.count("*")))).alias("hotness"))
