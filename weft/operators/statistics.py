"""Accounting and statistics: family shares, live ratios, percentiles by rank, reconciliation, concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def family_histogram(extents: DataFrame, family: str, size: str) -> DataFrame:
    """Extents and bytes of each family, and its share of all bytes in percent."""
    g = extents.groupBy(family).agg(F.count("*").alias("extents"), F.sum(size).cast("long").alias("bytes"))
    return g.withColumn("percent", F.round(100.0 * F.col("bytes") / F.sum("bytes").over(W.partitionBy()), 6))


def live_ratio(objects: DataFrame, segment: str, size: str, live: Column) -> DataFrame:
    """Live and total bytes of each segment and their ratio; 1 for an empty one."""
    g = objects.groupBy(segment).agg(F.sum(F.when(live, F.col(size)).otherwise(0)).cast("long").alias("live_bytes"), F.sum(size).cast("long").alias("total_bytes"))
    return g.withColumn("ratio", F.round(F.when(F.col("total_bytes") == 0, 1.0).otherwise(F.col("live_bytes") / F.col("total_bytes")), 6))


def _ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values with how many rows lie at or below them. Rows are counted by value before the window, so hot values shrink first."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    return c.withColumn("__upto", F.sum("__c").over(W.partitionBy(*by).orderBy(value))).withColumn("__n", F.sum("__c").over(W.partitionBy(*by)))


def _at_rank(rank0: Column, value: str) -> Column:
    """The value at a rank from 0: the least whose count up to it exceeds the rank."""
    return F.min(F.when(F.col("__upto") > rank0, F.col(value)))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, min, p50, p95, p99 and max of each group; percentiles by the nearest rank, ceil(p n) - 1 from 0."""
    r = _ranked(rows, by, value)
    n = F.col("__n")
    ranks = {f"p{p}": F.greatest(F.ceil(n * p / 100) - 1, F.lit(0)) for p in (50, 95, 99)}
    return r.groupBy(*by).agg(F.max("__n").alias("n"), F.round(F.sum(F.col(value) * F.col("__c")) / F.max("__n"), 6).alias("mean"), F.min(value).alias("min"), *(_at_rank(k, value).alias(name) for name, k in ranks.items()), F.max(value).alias("max"))


def rounded_percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Percentiles by the rank round((n - 1) q), the other rule in use."""
    r = _ranked(rows, by, value)
    return r.groupBy(*by).agg(*(_at_rank(F.floor((F.col("__n") - 1) * q + 0.5), value).alias(f"q{round(100 * q)}") for q in points))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at rank n / 2 from 0: of two middle values the larger."""
    return _ranked(rows, by, value).groupBy(*by).agg(_at_rank(F.floor(F.col("__n") / 2), value).alias("median"))


def reconcile(phases: DataFrame, totals: DataFrame, request: str, nanos: str, total: str) -> DataFrame:
    """For each request its phases' sum, what they leave of the total, and whether they overlap (sum beyond the total)."""
    s = phases.groupBy(request).agg(F.sum(nanos).cast("long").alias("phase_sum"))
    both = totals.select(request, F.col(total).alias("total")).join(s, request, "left").withColumn("phase_sum", F.coalesce("phase_sum", F.lit(0)))
    return both.withColumn("residual", F.col("total") - F.col("phase_sum")).withColumn("overlap", F.col("phase_sum") > F.col("total"))


def max_concurrency(ops: DataFrame, by: str, begin: str, end: str) -> DataFrame:
    """The most operations of a kind that run at once; one that ends when another begins doesn't run with it."""
    steps = ops.select(by, F.col(begin).alias("t"), F.lit(1).alias("d")).union(ops.select(by, F.col(end), F.lit(-1)))
    at = steps.groupBy(by, "t").agg(F.sum("d").alias("d"))
    running = F.sum("d").over(W.partitionBy(by).orderBy("t"))
    return at.withColumn("running", running).groupBy(by).agg(F.max("running").alias("max_concurrency"))


def group_cut(rows: DataFrame, seq: str, gen: str) -> DataFrame:
    """The component-wise largest sequence and generation: what one barrier has to cover."""
    return rows.agg(F.max(seq).alias("seq"), F.max(gen).alias("gen"))


def winner_shares(wins: DataFrame, cls: str, channel: str) -> DataFrame:
    """How often each channel won in each class, and its share there."""
    g = wins.groupBy(cls, channel).agg(F.count("*").alias("wins"))
    return g.withColumn("share", F.round(F.col("wins") / F.sum("wins").over(W.partitionBy(cls)), 6))


def increments(steps: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """What each step of a ladder adds to the one before."""
    return steps.withColumn("increment", F.col(value) - F.lag(value).over(W.partitionBy(group).orderBy(order)))


def longest_runs(picks: DataFrame, by: str, order: str, owner: str) -> DataFrame:
    """The most consecutive picks of one owner in each group: islands of two row numbers."""
    all_, own = F.row_number().over(W.partitionBy(by).orderBy(order)), F.row_number().over(W.partitionBy(by, owner).orderBy(order))
    return picks.withColumn("island", all_ - own).groupBy(by, owner, "island").count().groupBy(by).agg(F.max("count").alias("longest_run"))


def last_n(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Each group's last n rows, as a bounded ring keeps them."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")
