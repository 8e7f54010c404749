"""Column expressions: ids, names, sizes and costs of representations. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values by representation family: payload bytes beyond the 5-byte prefix, multipliers and constants of
#: read and write cycles (len * a / b + c), dependent reads, reference depth.
FAMILIES = {
    #  name: (payload, read (a, b, c), write (a, b, c), reads, depth)
    "zero": (0, (1, 8, 0), (1, 8, 0), 0, 0),
    "fill": (1, (1, 8, 0), (1, 8, 0), 0, 0),
    "raw": (32, (1, 1, 0), (1, 1, 0), 1, 0),
    "rans": (66, (4, 1, 0), (6, 1, 0), 1, 0),
    "exact_ref": (36, (1, 1, 0), (0, 1, 32), 1, 1),
    "base_residual": (36, (2, 1, 0), (3, 1, 0), 1, 1),
    "sparse": (20, (1, 8, 4), (1, 8, 8), 0, 0),
    "palette": (17, (1, 1, 0), (2, 1, 0), 0, 0),
    "periodic": (12, (1, 8, 0), (1, 8, 0), 0, 0),
    "entropy_ref": (26, (8, 1, 0), (10, 1, 0), 0, 0),
    "inline": (0, (1, 1, 0), (1, 1, 0), 0, 0),
    "permutation": (16, (4, 1, 0), (8, 1, 0), 0, 0),
    "sequence_rans": (86, (5, 1, 0), (8, 1, 0), 2, 0),
    "sparse_block64": (90, (1, 8, 8), (1, 8, 16), 2, 0),
    "sequence_dict": (126, (5, 1, 64), (10, 1, 0), 3, 1),
    "sequence_shared_dict": (162, (5, 1, 128), (11, 1, 0), 4, 1),
    "sequence_deep": (90, (5, 1, 0), (14, 1, 0), 2, 0),
}
#: Fixed values by policy mode: the weights of read, write, io and depth.
POLICIES = {
    "capacity": (2, 2, 256, 512),
    "balanced": (8, 8, 512, 1024),
    "latency": (64, 16, 4096, 8192),
    "archive": (1, 1, 64, 256),
    "ram": (32, 32, 2048, 4096),
}
#: Bytes of the chunk classes, and limits of descriptors and names.
CHUNK_CLASSES = (4096, 16384, 65536, 262144)
MAX_DEPTH, MAX_FANOUT, MAX_INLINE, MAX_PERIOD, MAX_PALETTE, MAX_NAME = 4, 4096, 4096, 1024, 16, 255


def content_id(data: Column) -> Column:
    """The hex SHA-256 of the bytes."""
    return F.sha2(data, 256)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *w) for m, w in POLICIES.items()], "mode string, lambda_read long, lambda_write long, lambda_io long, lambda_depth long")


def _by_family(family: Column, value) -> Column:
    out = F.lit(None).cast("long")
    for name, row in FAMILIES.items():
        out = F.when(family == name, F.lit(value(row)).cast("long") if not isinstance(value(row), Column) else value(row)).otherwise(out)
    return out


def _cycles(length: Column, rule: tuple[int, int, int]) -> Column:
    a, b, c = rule
    return F.floor(length * a / b).cast("long") + F.lit(c)


def encoded_size(family: Column, extra: Column) -> Column:
    """Bytes of the descriptor: prefix, the family's fixed payload, and what it carries besides (residual, literals, ...)."""
    return F.lit(5) + _by_family(family, lambda r: r[0]) + extra


def read_cycles(family: Column, length: Column) -> Column:
    return _by_family(family, lambda r: _cycles(length, r[1]))


def write_cycles(family: Column, length: Column) -> Column:
    return _by_family(family, lambda r: _cycles(length, r[2]))


def dependent_reads(family: Column, coded_residual: Column | None = None) -> Column:
    """Objects read one after another; a residual that is entropy-coded or a sequence needs two more."""
    base = _by_family(family, lambda r: r[3])
    if coded_residual is None:
        return base
    return base + F.when(family.isin("base_residual", "entropy_ref") & coded_residual, 2).otherwise(0)


def reference_depth(family: Column) -> Column:
    return _by_family(family, lambda r: r[4])


def persisted_bytes(*parts: Column) -> Column:
    """The sum of all parts that a store keeps, null counting as 0, with 4 bytes of checksum."""
    total = F.lit(4).cast("long")
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
    return total


def total_cost(persisted: Column, read: Column, write: Column, reads: Column, depth: Column, weights: list[Column] | None = None) -> Column:
    """The policy's objective; the two cycle terms are each divided by 1024 as integers. Without weights (read, write, io, depth), needs the policy's columns."""
    r, w, io, d = weights or [F.col(f"lambda_{k}") for k in ("read", "write", "io", "depth")]
    return persisted + F.floor(r * read / 1024).cast("long") + F.floor(w * write / 1024).cast("long") + io * reads + d * depth


def write_bucket(n: Column) -> Column:
    k = 1024
    return F.when(n < 4 * k, "<4K").when(n < 16 * k, "4-16K").when(n < 64 * k, "16-64K").when(n < 256 * k, "64-256K").when(n < k * k, "256K-1M").when(n == k * k, "=1M").otherwise(">1M")


def valid_name(name: Column) -> Column:
    """A directory entry's name: 1 to 255 bytes, no slash or NUL, not a dot entry."""
    return (F.octet_length(name) > 0) & (F.octet_length(name) <= MAX_NAME) & ~F.contains(name, F.lit("/")) & ~F.contains(name, F.lit("\0")) & ~name.isin(".", "..")


def temporary_name(name: Column) -> Column:
    """Names of unfinished writes: blob-<id>-tmp-<number>."""
    return name.startswith("blob-") & F.contains(name, F.lit("-tmp-"))


def chunk_class(n: Column) -> Column:
    return F.when(n.isin(*CHUNK_CLASSES), n)


def all_zero(data: Column) -> Column:
    return F.hex(data).rlike("^(00)*$")


def one_byte(data: Column) -> Column:
    """True if all bytes are equal; true for no bytes."""
    return F.hex(data).rlike("^(?:(..)\\1*)?$")


def feature_decision(feature_bits: Column, known: int, read_only: Column) -> Column:
    """Of incompatible bits: open, or refuse if a bit isn't known (read-only opens refuse as well)."""
    unknown = feature_bits.bitwiseAND(F.lit(~known))
    return F.when(unknown == 0, "open").when(read_only, "refuse-read").otherwise("refuse")


def measurement(ratio: Column) -> Column:
    """1 - log2(1 + x) / 2 of the ratio clamped to 0..1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log2(1 + x) / 2))


def regime_of(alpha: Column, omega: Column, slew: float = 0.05, drift: float = 0.02) -> Column:
    return F.when(F.abs(alpha) > slew, "slew").when(F.abs(omega) > drift, "drift").otherwise("stable")


def strategy_of(regime: Column) -> Column:
    """How widely to search; an unknown regime is searched narrowly."""
    return F.when(regime == "slew", "broad").when(regime == "drift", "balanced").otherwise("narrow")


def guidance_of(regime: Column) -> Column:
    return F.when(regime == "slew", "new_baseline").when(regime == "drift", "update_residuals").otherwise("keep_basis")


def search_budget(strategy: Column) -> Column:
    return F.when(strategy == "broad", 32).when(strategy == "balanced", 12).otherwise(4)


def name_class(name: Column) -> Column:
    """struct(extension, length_bucket, mix): the part after the last dot, length / 16 up to 15, and the mix of letters and digits."""
    n = F.greatest(F.length(name), F.lit(1))
    letters = F.length(F.regexp_replace(name, "[^A-Za-z]", "")) / n
    digits = F.length(F.regexp_replace(name, "[^0-9]", "")) / n
    mix = F.when(letters > 0.7, 0).when(digits > 0.3, 1).when(letters > 0.3, 2).otherwise(3)
    return F.struct(F.regexp_extract(name, r"^.+\.([^.]+)$", 1).alias("extension"), F.least(F.floor(F.length(name) / 16), F.lit(15)).cast("int").alias("length_bucket"), mix.alias("mix"))


def exact_sum(value: Column) -> Column:
    """An aggregate that orders as the sum of doubles does, whatever the order of the rows: values are summed as decimals of 9 places; those that no decimal holds (NaN, infinities) are summed beside them and weigh first."""
    fits = value.try_cast("decimal(28,9)")
    return F.when(F.count(value) > 0, F.struct(F.coalesce(F.sum(F.when(fits.isNull(), value)), F.lit(0.0)).alias("beyond"), F.coalesce(F.sum(fits), F.lit(0)).alias("exact")))
