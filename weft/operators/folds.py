"""Ordered folds: regimes, slews, trust, hysteresis, hotness, debt.

Folds with a closed form are windows or grouped sums. Those without one read each key's rows in order from
one sorted exchange and carry the key's small state from batch to batch, so no key is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the trackers.
SLEW_STEP, DRIFT_RATE, SLEW_STEPS, RECOVERY = 0.25, 0.004, 8, 0.1
TRUST_MEMORY, TRUST_FLOOR = 0.9, 0.1


@dataclass
class Tracker:
    """The regime of a series of measurements in 0..1: a level and a rate, each an exponential mean, and a slew window."""

    level: float = 0.0
    rate: float = 0.0
    seen: int = 0
    window: int = 0
    before: float = 0.0

    def step(self, m: float) -> str:
        self.seen += 1
        if self.seen == 1:
            self.level = m
            return "unknown"
        jump = m - self.level
        self.rate = 0.9 * self.rate + 0.1 * jump
        self.level = 0.8 * self.level + 0.2 * m
        if self.window:
            recovered = abs(m - self.before) < RECOVERY
            self.window = 0 if recovered else self.window - 1
            if self.window:
                return "slew"
        if self.seen <= 4:
            return "stable"
        if abs(jump) > SLEW_STEP:
            self.window, self.before = SLEW_STEPS, self.level
            return "slew"
        return "drift" if abs(self.rate) > DRIFT_RATE else "stable"


@dataclass
class Slews:
    """Jumps of density and histogram change against their means, from the sixth sample on."""

    density: float = 0.0
    change: float = 0.0
    seen: int = 0

    def step(self, density: float, change: float) -> str:
        self.seen += 1
        out = "none"
        if self.seen > 5:
            jumps = [mean >= 0.005 and now > 4 * mean and now - mean > 0.2 for now, mean in ((density, self.density), (change, self.change))]
            out = "density_jump" if jumps[0] else "hist_jump" if jumps[1] else "none"
        self.density = 0.8 * self.density + 0.2 * density
        self.change = 0.8 * self.change + 0.2 * change
        return out


@dataclass
class Debt:
    """Deferred work under pressure: grows while pressured until ``most``, is paid off otherwise, never below 0."""

    debt: int = 0
    most: int = 1000

    def step(self, pressured: bool, work: int) -> str:
        deferred = bool(pressured) and self.debt < self.most
        self.debt = self.debt + int(work) if deferred else max(0, self.debt - int(work))
        return "defer" if deferred else "search"


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], new: Callable[[], object], out: str) -> DataFrame:
    """rows with what the state's step returned (out) and the state's fields after it, in the rows' order within each key."""
    names = list(new().__dataclass_fields__)
    kinds = {int: "long", float: "double"}
    fields = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), f"{out} string", *(f"state_{n} {kinds[type(v)]}" for n, v in zip(names, astuple(new()), strict=True))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for pdf in batches:
            found, states = [], []
            for k, *values in zip(pdf[key], *(pdf[c] for c in inputs), strict=True):
                if k != at:
                    at, state = k, new()
                found.append(state.step(*values))
                states.append(astuple(state))
            pdf[out] = found
            for i, n in enumerate(names):
                pdf[f"state_{n}"] = [s[i] for s in states]
            yield pdf

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, fields)


def track_regimes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return fold(rows, key, order, [value], Tracker, "regime")


def detect_slews(rows: DataFrame, key: str, order: list[str], density: str, change: str) -> DataFrame:
    return fold(rows, key, order, [density, change], Slews, "signal")


def defer_work(rows: DataFrame, key: str, order: list[str], pressured: str, work: str, most: int = 1000) -> DataFrame:
    return fold(rows, key, order, [pressured, work], lambda: Debt(0, most), "decision")


def decayed_mean(rows: DataFrame, keys: list[str], order: list[str], value: Column, memory: float, start: float) -> DataFrame:
    """Each key's mean after its last row, m = memory * m + (1 - memory) * value from ``start``: a sum of weights by rank from the end."""
    w = W.partitionBy(*keys)
    back = F.row_number().over(w.orderBy(*(F.desc(c) for c in order))) - 1
    ranked = rows.withColumn("__v", value).withColumn("__back", back)
    return ranked.groupBy(*keys).agg((F.sum((1 - memory) * F.pow(F.lit(memory), "__back") * F.col("__v")) + start * F.pow(F.lit(memory), F.count("*"))).alias("mean"))


def trust_weights(rows: DataFrame, key: str, channel: str, order: list[str], measured: str) -> DataFrame:
    """(key, channel, error, weight): each channel's decayed error 1 - measurement from 1, and the channels' shares of 1 / (floor + error)."""
    error = decayed_mean(rows, [key, channel], order, F.abs(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(measured)))), TRUST_MEMORY, 1.0).withColumnRenamed("mean", "error")
    raw = 1 / (TRUST_FLOOR + F.col("error"))
    return error.withColumn("weight", raw / F.sum(raw).over(W.partitionBy(key)))


def hysteresis(rows: DataFrame, key: str, order: list[str], value: str, enter: float, leave: float) -> DataFrame:
    """rows with pressured: on from a value of at least enter until one of at most leave; off before any of them."""
    w = W.partitionBy(key).orderBy(*order)
    decided = F.when(F.col(value) >= enter, True).when(F.col(value) <= leave, False)
    return rows.withColumn("pressured", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(False)))


def pressured_time(rows: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Each key's time between samples, summed where the earlier sample was pressured, and how often it entered and left."""
    w = W.partitionBy(key).orderBy(*order)
    was = F.coalesce(F.lag("pressured").over(w), F.lit(False))
    steps = rows.withColumn("was", was).withColumn("gap", F.col(at) - F.lag(at).over(w))
    return steps.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("was"), F.col("gap"))), F.lit(0)).cast("long").alias("pressured_time"),
        F.sum((F.col("pressured") & ~F.col("was")).cast("long")).alias("entered"),
        F.sum((~F.col("pressured") & F.col("was")).cast("long")).alias("left"),
    )


def hotness(touches: DataFrame, key: str) -> DataFrame:
    """h = 0.9 h + 1 at each touch, from 0: a geometric sum, so a count is all it needs."""
    return touches.groupBy(key).agg(F.count("*").alias("touches")).withColumn("hotness", (1 - F.pow(F.lit(0.9), "touches")) / 0.1)
