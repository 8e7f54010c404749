"""What a store's objects, extents and indexes add up to, and what of them to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Chunks shorter than this, or of less sampled entropy in bits, are searched in full; a class is skipped
#: for entropy coding from so many observations on, if that wins less than this share.
LEAST_PROBED, HIGH_ENTROPY, LEAST_OBSERVATIONS, LEAST_SHARE = 256, 7.2, 16, 0.10
#: Families whose outcome counts as certain.
CERTAIN = ("zero", "fill", "sparse", "palette", "periodic", "inline", "exact_ref", "entropy_ref")
#: The switches that a channel needs, and the one that a family needs. Raw needs none.
CHANNEL_SWITCHES = {
    "shared_content": ("exact_ref",),
    "prev_version": ("bases",),
    "adjacent": ("bases", "temporal_bases"),
    "prev_in_file": ("bases", "temporal_bases"),
    "family_base": ("bases", "temporal_bases"),
    "universe": ("universe",),
    "shared_dict": ("shared_dict",),
    "raw": (),
}
FAMILY_SWITCH = {
    "rans": "byte_rans",
    "sequence_rans": "sequence_rans",
    "sequence_deep": "sequence_rans_deep",
    "sequence_dict": "sequence_dict",
    "sequence_shared_dict": "shared_dict",
    "exact_ref": "exact_ref",
    "base_residual": "bases",
    "entropy_ref": "universe",
}


def object_accounting(references: DataFrame) -> DataFrame:
    """(kind, objects, bytes): references (obj, kind, size) by kind, each object counted once however often it is referred to."""
    once = references.groupBy("obj", "kind").agg(F.max("size").alias("size"))
    return once.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def overhead(extents: DataFrame) -> DataFrame:
    """(family, extents, descriptor_bytes, models): what extents (family, descriptor_bytes, model) carry besides their payload."""
    return extents.groupBy("family").agg(F.count("*").alias("extents"), F.sum("descriptor_bytes").cast("long").alias("descriptor_bytes"), F.countDistinct("model").alias("models"))


def incumbent_bytes(extents: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """keys with persisted: the descriptor and every object (keys, obj, size) that it refers to, once for each extent."""
    objects = references.dropDuplicates([*keys, "obj"]).groupBy(*keys).agg(F.sum("size").cast("long").alias("objects"))
    return extents.join(objects, keys, "left").select(*keys, (F.col("descriptor_bytes") + F.coalesce("objects", F.lit(0))).cast("long").alias("persisted"))


def retained(index: DataFrame, referenced: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """The index's rows to keep: those that extents refer to, and those of live descriptors."""
    return index.join(referenced.select(key).union(live.select(key)).distinct(), key, "left_semi")


def staged_to_commit(staged: DataFrame, reachable: DataFrame, key: str) -> DataFrame:
    """Of a transaction's staged objects those that its last root reaches; what only steps between needed isn't committed."""
    return staged.join(reachable.select(key).distinct(), key, "left_semi")


def index_mismatches(extents: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """keys with finding: extents (keys, cid) whose id the index (keys, cid) doesn't hold, or holds otherwise."""
    both = extents.join(index.withColumnRenamed("cid", "i_cid"), keys, "left")
    finding = F.when(F.col("i_cid").isNull(), "not-indexed").when(F.col("cid") != F.col("i_cid"), "differs")
    return both.select(*keys, finding.alias("finding")).where("finding is not null")


def invalid_entries(dirents: DataFrame, inodes: DataFrame, valid_name: Column) -> DataFrame:
    """(parent, name, finding): entries with an invalid name, a missing inode or another type than their inode's."""
    i = inodes.select("ino", F.col("kind").alias("i_kind"))
    finding = F.when(~valid_name, "name").when(F.col("i_kind").isNull(), "missing-inode").when(F.col("i_kind") != F.col("kind"), "type")
    return dirents.join(i, "ino", "left").select("parent", "name", finding.alias("finding")).where("finding is not null")


def winner_rank(trust: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """(key, winner, rank): where the winning channel stood in the plan's order: trust descending, ties by ordinal."""
    ranked = trust.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("trust"), "ordinal")))
    return ranked.join(winners.withColumnRenamed("winner", "channel"), [key, "channel"]).select(key, F.col("channel").alias("winner"), "rank")


def operation_totals(timings: DataFrame, op: str, value: str) -> DataFrame:
    """(op, n, total, mean, most, place): timings by operation, the largest total first; ties by name."""
    total = timings.groupBy(op).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return total.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), op)))  # a row for each operation


def copy_order(records: DataFrame, segment: str, offset: str) -> DataFrame:
    """records with the place of each within its segment: the order in which compaction copies them."""
    return records.withColumn("place", F.row_number().over(W.partitionBy(segment).orderBy(offset)))


def high_entropy(length: Column, sampled_entropy: Column) -> Column:
    """Whether the foreground search leaves a chunk raw."""
    return (length >= LEAST_PROBED) & (sampled_entropy >= HIGH_ENTROPY)


def skips_entropy_coding(observations: Column, share: Column) -> Column:
    """Whether a class of chunks is known to gain too little by entropy coding."""
    return (observations >= LEAST_OBSERVATIONS) & (share < LEAST_SHARE)


def channel_allowed(channel: Column, allowed: Column) -> Column:
    """Whether the switches (an array of names) let a channel be searched; entropy coding needs one of its two."""
    out = F.when(channel == "rans", F.arrays_overlap(allowed, F.array(F.lit("byte_rans"), F.lit("sequence_rans"))))
    for name, needs in CHANNEL_SWITCHES.items():
        test = F.lit(True)
        for s in needs:
            test = test & F.array_contains(allowed, s)
        out = out.when(channel == name, test)
    return F.coalesce(out, F.lit(False))


def family_allowed(family: Column, allowed: Column) -> Column:
    """Whether the switches let a descriptor of the family be used again; raw always, the exact small ones by ``configurational``."""
    out = F.when(family == "raw", F.lit(True))
    for name, s in FAMILY_SWITCH.items():
        out = out.when(family == name, F.array_contains(allowed, s))
    return out.otherwise(F.array_contains(allowed, "configurational"))


def family_mask(allowed: Column, chunk_is_raw: Column) -> Column:
    """The switches that a chunk's foreground search may use: dedup and zero or fill always, the rest unless the chunk is left raw."""
    always = F.array(F.lit("dedup"), F.lit("zero_fill"))
    return F.array_sort(F.when(chunk_is_raw, always).otherwise(F.array_union(always, allowed)))


def outcome_quality(family: Column, measured: Column) -> Column:
    """1 for families that are exact by construction, else the winner's own measurement, 0.5 without one, within 0 and 1."""
    return F.when(family.isin(*CERTAIN), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(measured, F.lit(0.5)))))


def descriptor_bytes(encoded: Column, *split: Column) -> Column:
    """What of an encoded descriptor is left when residual, reference, configuration and seed are counted by themselves."""
    left = encoded
    for part in split:
        left = F.greatest(left - F.coalesce(part, F.lit(0)), F.lit(0))
    return left


def class_key(mode: str, name: list[Column], sketch: list[Column], lifecycle: Column) -> Column:
    """The key of a chunk's class under a mode: by its name, its bytes, its history, all of them, or none."""
    parts = {"extension": name, "byte_sketch": sketch, "history": [lifecycle], "combined": [*name, *sketch, lifecycle], "none": []}[mode]
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256) if parts else F.lit(None).cast("string")


def prior_table(wins: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """(key, channel, wins, share) of the ``most`` classes seen most often, ties by key: how often each channel won."""
    by = wins.where(F.col(key).isNotNull()).groupBy(key, "channel").agg(F.count("*").alias("wins"))
    kept = by.groupBy(key).agg(F.sum("wins").alias("seen")).orderBy(F.desc("seen"), key).limit(most)  # the bound is the feature
    return by.join(kept, key).select(key, "channel", "wins", (F.col("wins") / F.col("seen")).alias("share"))


def admission(facts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rule, met): each rule tested on the one row of facts."""
    tested = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("met")) for n, c in rules))
    return facts.select(F.explode(tested).alias("r")).select("r.*")
