"""The driver's tables as a store's: documents are blobs, line items extents, events a log, orders and parts a graph, regions a tree.

Each view comes with the same in DuckDB's SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where a query deals rows by a key.
ROWS = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over as many partitions as its rows need, which are counted: a task's memory doesn't grow with the table.

    Without it each task would aggregate a whole split of a file first, and AQE would join small partitions to large ones.
    """
    return df.repartition(max(1, -(-df.count() // ROWS)), *keys)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").cast("binary").alias("bytes"))


BLOBS = "blobs AS (SELECT doc_id, lang, source, encode(text) AS bytes FROM documents)"
CHUNKS = f"""{BLOBS}, chunks AS (SELECT doc_id, lang, source, i AS idx, bytes[i * {CHUNK} + 1 : (i + 1) * {CHUNK}] AS b
FROM (SELECT *, unnest(range(0, CAST(ceil(octet_length(bytes) / {CHUNK}.0) AS BIGINT))) AS i FROM blobs)), hashed AS (SELECT *, sha256(b) AS cid, octet_length(b) AS len FROM chunks)"""


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extent for each order and line number: some overlap, some leave holes."""
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("len"), F.max("l_partkey").alias("obj"), F.max("l_suppkey").alias("segment"), F.max(F.concat("l_returnflag", "l_linestatus")).alias("family"))
    return rows.select(F.col("l_orderkey").alias("ino"), ((F.col("l_linenumber") - 1) * 40).cast("long").alias("start"), "len", "obj", "segment", "family")


EXTENTS = """extents AS (SELECT l_orderkey AS ino, CAST((l_linenumber - 1) * 40 AS BIGINT) AS start, CAST(max(l_quantity) AS BIGINT) AS len,
max(l_partkey) AS obj, max(l_suppkey) AS segment, max(l_returnflag || l_linestatus) AS family FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), (F.col("o_custkey") % 200 + 100).alias("size"), (F.col("o_orderkey") % 5).alias("nlink"), F.col("o_custkey").alias("parent"))


INODES = "inodes AS (SELECT o_orderkey AS ino, o_custkey % 200 + 100 AS size, o_orderkey % 5 AS nlink, o_custkey AS parent FROM orders)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mutations: the event's type by its order is the operation, the user the inode, the value the size."""
    op = F.element_at(F.array(*map(F.lit, ("write", "setattr", "link", "unlink", "create"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("ino"), F.floor("value").cast("long").alias("size"), "event_type", "ts", "value")


LOG = "log AS (SELECT event_id AS seq, ['write', 'setattr', 'link', 'unlink', 'create'][event_id % 5 + 1] AS op, user_id AS ino, CAST(floor(value) AS BIGINT) AS size, event_type, ts, value FROM events)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p refers to part p div 3 where p isn't a multiple of 7, so that chains of several lengths arise."""
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 0 and p_partkey >= 3").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).cast("long").alias("dst"))


EDGES = "edges AS (SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part WHERE p_partkey % 7 <> 0 AND p_partkey >= 3)"


def dirents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/region/nation/customer: directories 1, 100 + region, 1000 + nation; customers from 100000 on."""
    region, nation, customer = (table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    return (
        region.select(F.lit(1).cast("long").alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("ino"))
        .union(nation.select((F.col("n_regionkey") + 100).cast("long"), "n_name", (F.col("n_nationkey") + 1000).cast("long")))
        .union(customer.select((F.col("c_nationkey") + 1000).cast("long"), "c_name", F.col("c_custkey") + 100000))
    )


DIRENTS = """dirents AS (SELECT CAST(1 AS BIGINT) AS parent, r_name AS name, CAST(r_regionkey + 100 AS BIGINT) AS ino FROM region
UNION ALL SELECT CAST(n_regionkey + 100 AS BIGINT), n_name, CAST(n_nationkey + 1000 AS BIGINT) FROM nation
UNION ALL SELECT CAST(c_nationkey + 1000 AS BIGINT), c_name, c_custkey + 100000 FROM customer)"""
