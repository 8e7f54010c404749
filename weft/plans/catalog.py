"""Queries by name, and for those that SQL can express, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import bytes as byte_functions
from weft.functions import values
from weft.operators import candidates, chunks, closure, folds, integrity, lookups, namespace, statistics
from weft.plans import stand_ins as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- chunks and accounting


@query(f"""WITH {s.CHUNKS}, one AS (SELECT lang, cid, count(*) AS n, max(len) AS len FROM hashed GROUP BY lang, cid)
SELECT lang, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * len) AS BIGINT) AS logical_bytes, CAST(sum(len) AS BIGINT) AS unique_bytes, CAST(sum((n - 1) * len) AS BIGINT) AS dedup_saved FROM one GROUP BY lang""")
def chunk_dedup(spark, sf_dir):
    return chunks.dedup_report(chunks.chunk(s.blobs(spark, sf_dir), s.CHUNK), "lang")


@query(f"WITH {s.CHUNKS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(idx * {s.CHUNK} AS BIGINT) AS off, CAST(len AS INTEGER) AS len, cid FROM hashed")
def chunk_ids(spark, sf_dir):
    return chunks.chunk(s.blobs(spark, sf_dir), s.CHUNK).select("doc_id", "idx", "off", "len", "cid")


@query(f"WITH {s.BLOBS} SELECT sha256(bytes) AS blob_id, CAST(max(octet_length(bytes)) AS INTEGER) AS size FROM blobs WHERE bytes IS NOT NULL GROUP BY 1")
def put_blobs(spark, sf_dir):
    return chunks.distinct_blobs(s.blobs(spark, sf_dir).where("bytes is not null")).select("blob_id", F.octet_length("bytes").alias("size"))


@query(f"WITH {s.BLOBS} SELECT doc_id, sha256(bytes[101:300]) AS part_id, CAST(octet_length(bytes[101:300]) AS INTEGER) AS n FROM blobs")
def blob_range(spark, sf_dir):
    part = chunks.byte_range(F.col("bytes"), F.lit(100), F.lit(200))
    return s.blobs(spark, sf_dir).select("doc_id", values.content_id(part).alias("part_id"), F.octet_length(part).alias("n"))


@query(f"WITH {s.CHUNKS}, one AS (SELECT cid, count(*) AS n, max(len) AS size FROM hashed GROUP BY cid HAVING count(*) >= 2) SELECT count(*) AS shared_objects, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS saved_bytes FROM one")
def cas_shared_saved(spark, sf_dir):
    return chunks.shared_saving(chunks.chunk(s.blobs(spark, sf_dir), s.CHUNK), "cid", "len")


@query(f"""WITH {s.BLOBS}, z AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, CAST(12 + octet_length(encode(source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0'))) + octet_length(bytes) AS BIGINT) AS size FROM blobs)
SELECT name, CAST(coalesce(sum(size) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, size FROM z""")
def pack_places(spark, sf_dir):
    named = s.blobs(spark, sf_dir).select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), "bytes")
    return chunks.pack(named, "name", "bytes").select("name", "place", "size")


@query(f"WITH {s.EXTENTS}, g AS (SELECT family, count(*) AS extents, CAST(sum(len) AS BIGINT) AS bytes FROM extents GROUP BY family) SELECT *, round(100.0 * bytes / sum(bytes) OVER (), 6) AS percent FROM g")
def family_histogram(spark, sf_dir):
    return statistics.family_histogram(s.extents(spark, sf_dir), "family", "len")


@query(f"WITH {s.EXTENTS} SELECT segment, CAST(sum(CASE WHEN family <> 'NO' THEN len ELSE 0 END) AS BIGINT) AS live_bytes, CAST(sum(len) AS BIGINT) AS total_bytes, round(sum(CASE WHEN family <> 'NO' THEN len ELSE 0 END) / sum(len), 6) AS ratio FROM extents GROUP BY segment")
def live_ratio_by_segment(spark, sf_dir):
    return statistics.live_ratio(s.extents(spark, sf_dir), "segment", "len", F.col("family") != "NO")


@query(f"WITH {s.EXTENTS}, r AS (SELECT segment, sum(CASE WHEN family = 'AF' THEN len ELSE 0 END) / sum(len) AS ratio FROM extents GROUP BY segment) SELECT segment FROM r WHERE round(ratio, 6) < 0.25")
def gc_victims(spark, sf_dir):
    ratios = statistics.live_ratio(s.extents(spark, sf_dir), "segment", "len", F.col("family") == "AF")
    return closure.victims(ratios, 0.25).select("segment")


_RANK = "list_sort(list(value))"


@query(f"""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, {_RANK}[greatest(CAST(ceil(count(value) * 50 / 100.0) AS INTEGER), 1)] AS p50,
{_RANK}[greatest(CAST(ceil(count(value) * 95 / 100.0) AS INTEGER), 1)] AS p95, {_RANK}[greatest(CAST(ceil(count(value) * 99 / 100.0) AS INTEGER), 1)] AS p99, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def nearest_rank_percentiles(spark, sf_dir):
    return statistics.summary(s.table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""SELECT event_type, {_RANK}[CAST(floor((count(value) - 1) * 0.5 + 0.5) AS INTEGER) + 1] AS q50, {_RANK}[CAST(floor((count(value) - 1) * 0.95 + 0.5) AS INTEGER) + 1] AS q95,
{_RANK}[CAST(floor((count(value) - 1) * 0.99 + 0.5) AS INTEGER) + 1] AS q99 FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def perf_percentiles(spark, sf_dir):
    return statistics.rounded_percentiles(s.table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"SELECT event_type, {_RANK}[CAST(floor(count(value) / 2) AS INTEGER) + 1] AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_medians(spark, sf_dir):
    return statistics.upper_median(s.table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"""WITH {s.EXTENTS}, {s.INODES}, p AS (SELECT ino, CAST(sum(len) AS BIGINT) AS phase_sum FROM extents GROUP BY ino)
SELECT i.ino, size AS total, coalesce(phase_sum, 0) AS phase_sum, size - coalesce(phase_sum, 0) AS residual, coalesce(phase_sum, 0) > size AS overlap FROM inodes i LEFT JOIN p ON i.ino = p.ino""")
def phase_reconciliation(spark, sf_dir):
    return statistics.reconcile(s.extents(spark, sf_dir), s.inodes(spark, sf_dir), "ino", "len", "size")


@query("""WITH o AS (SELECT o_orderpriority AS kind, CAST(epoch_us(o_orderdate) / 86400000000 AS BIGINT) AS b, CAST(epoch_us(o_orderdate) / 86400000000 AS BIGINT) + o_custkey % 30 + 1 AS e FROM orders),
st AS (SELECT kind, b AS t, 1 AS d FROM o UNION ALL SELECT kind, e, -1 FROM o), a AS (SELECT kind, t, sum(d) AS d FROM st GROUP BY kind, t), r AS (SELECT kind, sum(d) OVER (PARTITION BY kind ORDER BY t) AS running FROM a)
SELECT kind, CAST(max(running) AS BIGINT) AS max_concurrency FROM r GROUP BY kind""")
def max_concurrency(spark, sf_dir):
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    ops = s.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), day.alias("b"), (day + F.col("o_custkey") % 30 + 1).alias("e"))
    return statistics.max_concurrency(ops, "kind", "b", "e")


@query("SELECT max(event_id) AS seq, max(user_id) AS gen FROM events")
def group_cut(spark, sf_dir):
    return statistics.group_cut(s.table(spark, sf_dir, "events"), "event_id", "user_id")


@query(f"WITH {s.EXTENTS}, g AS (SELECT segment % 10 AS cls, family AS channel, count(*) AS wins FROM extents GROUP BY 1, 2) SELECT cls, channel, wins, round(wins / sum(wins) OVER (PARTITION BY cls), 6) AS share FROM g")
def winner_shares(spark, sf_dir):
    return statistics.winner_shares(s.extents(spark, sf_dir).select((F.col("segment") % 10).alias("cls"), F.col("family").alias("channel")), "cls", "channel")


@query("""WITH g AS (SELECT o_orderpriority AS mode, year(o_orderdate) AS step, count(*) AS physical FROM orders GROUP BY 1, 2)
SELECT mode, CAST(step AS INTEGER) AS step, physical, physical - lag(physical) OVER (PARTITION BY mode ORDER BY step) AS increment FROM g""")
def ablation_increments(spark, sf_dir):
    g = s.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mode"), F.year("o_orderdate").alias("step")).agg(F.count("*").alias("physical"))
    return statistics.increments(g, "mode", "step", "physical")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events),
g AS (SELECT user_id, count(*) AS n FROM r GROUP BY user_id, event_type, island) SELECT user_id, max(n) AS longest_run FROM g GROUP BY user_id""")
def longest_pick_runs(spark, sf_dir):
    return statistics.longest_runs(s.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def bounded_ring(spark, sf_dir):
    return statistics.last_n(s.table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 8)


@query(f"""WITH {s.BLOBS}, b AS (SELECT octet_length(bytes) AS n FROM blobs WHERE bytes IS NOT NULL)
SELECT CASE WHEN n < 4096 THEN '<4K' WHEN n < 16384 THEN '4-16K' WHEN n < 65536 THEN '16-64K' WHEN n < 262144 THEN '64-256K' WHEN n < 1048576 THEN '256K-1M' WHEN n = 1048576 THEN '=1M' ELSE '>1M' END AS bucket, count(*) AS writes FROM b GROUP BY 1""")
def write_buckets(spark, sf_dir):
    return s.blobs(spark, sf_dir).where("bytes is not null").groupBy(values.write_bucket(F.octet_length("bytes")).alias("bucket")).agg(F.count("*").alias("writes"))


@query(f"""WITH {s.BLOBS}, {s.EXTENTS} SELECT (SELECT count(*) FROM blobs) AS blobs, (SELECT CAST(sum(octet_length(bytes)) AS BIGINT) FROM blobs) AS logical_bytes,
(SELECT count(*) FROM extents) AS extents, (SELECT CAST(sum(len) AS BIGINT) FROM extents) AS extent_bytes, (SELECT count(DISTINCT segment) FROM extents) AS segments, (SELECT count(*) FROM orders) AS inodes""")
def store_status(spark, sf_dir):
    b = s.blobs(spark, sf_dir).agg(F.count("*").alias("blobs"), F.sum(F.octet_length("bytes")).alias("logical_bytes"))
    e = s.extents(spark, sf_dir).agg(F.count("*").alias("extents"), F.sum("len").alias("extent_bytes"), F.countDistinct("segment").alias("segments"))
    i = s.inodes(spark, sf_dir).agg(F.count("*").alias("inodes"))
    one = F.lit(1).alias("k")  # three rows of one
    return b.select("*", one).join(e.select("*", one), "k").join(i.select("*", one), "k").drop("k")


@query(f"WITH {s.EXTENTS} SELECT segment, family, CAST(sum(len) AS BIGINT) AS bytes FROM extents GROUP BY ROLLUP (segment, family)")
def rollup_families(spark, sf_dir):
    return s.extents(spark, sf_dir).rollup("segment", "family").agg(F.sum("len").alias("bytes"))


# --- lookups


@query(f"""WITH {s.EXTENTS}, p AS (SELECT o_orderkey AS ino, o_custkey % 300 AS pos FROM orders), j AS (SELECT p.ino, p.pos, max(start) AS s FROM p LEFT JOIN extents e ON p.ino = e.ino AND e.start <= p.pos GROUP BY p.ino, p.pos)
SELECT j.ino, j.pos, e.start AS found_start, e.len AS found_len FROM j LEFT JOIN extents e ON e.ino = j.ino AND e.start = j.s""")
def asof_extent(spark, sf_dir):
    points = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), (F.col("o_custkey") % 300).alias("pos"))
    return lookups.as_of(points, s.extents(spark, sf_dir).select("ino", "start", "len"), width=64).select("ino", "pos", F.col("found.start").alias("found_start"), F.col("found.len").alias("found_len"))


@query(f"""WITH {s.EXTENTS}, p AS (SELECT o_orderkey AS ino, o_custkey % 300 AS pos FROM orders) SELECT p.ino, p.pos, min(start) AS next_start FROM p LEFT JOIN extents e ON p.ino = e.ino AND e.start > p.pos GROUP BY p.ino, p.pos""")
def asof_next_extent(spark, sf_dir):
    points = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), (F.col("o_custkey") % 300).alias("pos"))
    found = lookups.as_of(points.withColumn("after", F.col("pos") + 1), s.extents(spark, sf_dir).select("ino", "start"), at="after", forward=True, width=64)
    return found.select("ino", "pos", F.col("found.start").alias("next_start"))


@query(f"""WITH {s.EXTENTS}, w AS (SELECT o_orderkey AS ino, o_custkey % 100 AS off, o_custkey % 100 + 64 AS stop FROM orders)
SELECT w.ino, off, stop, start, len FROM w JOIN extents e ON w.ino = e.ino AND start < stop AND start + len > off""")
def range_window(spark, sf_dir):
    w = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), (F.col("o_custkey") % 100).alias("off"), (F.col("o_custkey") % 100 + 64).alias("stop"))
    e = s.extents(spark, sf_dir).select("ino", "start", "len", (F.col("start") + F.col("len")).alias("end"))
    return lookups.overlapping(w, e, 128).drop("end")


@query("""WITH l AS (SELECT l_suppkey AS ino, l_orderkey * 8 + l_linenumber AS lock_id, l_orderkey AS owner, min(l_partkey % 1000 * 10) AS a, CASE WHEN l_linenumber % 3 = 0 THEN 'W' ELSE 'R' END AS typ FROM lineitem WHERE l_suppkey % 10 = l_orderkey % 10 GROUP BY 1, 2, 3, 5)
SELECT x.ino, x.lock_id AS a_id, y.lock_id AS b_id FROM l x JOIN l y ON x.ino = y.ino AND x.lock_id < y.lock_id AND x.owner <> y.owner AND x.a <= y.a + 5 AND y.a <= x.a + 5 AND (x.typ = 'W' OR y.typ = 'W')""")
def lock_conflicts(spark, sf_dir):
    return _conflicts(s.table(spark, sf_dir, "lineitem").where("l_suppkey % 10 = l_orderkey % 10"))


def _conflicts(rows: DataFrame) -> DataFrame:
    typ = F.when(F.col("l_linenumber") % 3 == 0, "W").otherwise("R").alias("typ")
    locks = rows.groupBy(F.col("l_suppkey").alias("ino"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lock_id"), F.col("l_orderkey").alias("owner"), typ).agg(F.min(F.col("l_partkey") % 1000 * 10).alias("start"))
    return lookups.conflicts(locks.withColumn("end", F.col("start") + 5), 256)


@query()
def lock_conflicts_all(spark, sf_dir):
    """lock_conflicts of all line items; tests/test_operators.py holds it against brute force."""
    return _conflicts(s.table(spark, sf_dir, "lineitem"))


@query(f"""WITH {s.LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY ino ORDER BY seq DESC) AS r FROM log), l AS (SELECT * FROM r WHERE r = 1), base AS (SELECT c_custkey AS ino, CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer)
SELECT coalesce(b.ino, l.ino) AS ino, CASE WHEN l.ino IS NULL THEN b.size ELSE l.size END AS size FROM base b FULL JOIN l ON b.ino = l.ino WHERE l.op IS NULL OR l.op <> 'unlink'""")
def overlay_latest(spark, sf_dir):
    base = s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ino"), F.floor("c_acctbal").cast("long").alias("size"))
    return lookups.overlay(base, s.log(spark, sf_dir).select("ino", "size", "seq", (F.col("op") == "unlink").alias("deleted")), ["ino"])


@query("WITH t AS (SELECT c_name, c_custkey FROM customer WHERE c_name > 'Customer#000000050' ORDER BY c_name LIMIT 21) SELECT c_name, c_custkey, (SELECT count(*) FROM t) > 20 AS has_more FROM (SELECT * FROM t ORDER BY c_name LIMIT 20)")
def directory_page(spark, sf_dir):
    return lookups.page(s.table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "c_name", "Customer#000000050", 20)


@query(f"WITH {s.CHUNKS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, lag(cid) OVER (PARTITION BY doc_id ORDER BY idx) AS previous, lead(cid) OVER (PARTITION BY doc_id ORDER BY idx) AS following FROM hashed")
def neighbour_bases(spark, sf_dir):
    c = chunks.chunk(s.blobs(spark, sf_dir), s.CHUNK).select("doc_id", "idx", "cid")
    return lookups.neighbours(c, "doc_id", "idx", "cid").drop("cid")


@query(f"""WITH {s.DIRENTS}, p AS (SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT path, d3.ino FROM p JOIN dirents d1 ON d1.parent = 1 AND d1.name = string_split(path, '/')[1] JOIN dirents d2 ON d2.parent = d1.ino AND d2.name = string_split(path, '/')[2] LEFT JOIN dirents d3 ON d3.parent = d2.ino AND d3.name = string_split(path, '/')[3]""")
def path_resolve(spark, sf_dir):
    region, nation, customer = (s.table(spark, sf_dir, n) for n in ("region", "nation", "customer"))
    j = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return closure.resolve_paths(j.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path")), s.dirents(spark, sf_dir), 1)


@query(f"WITH {s.DIRENTS} SELECT ino, min(parent) AS parent FROM dirents GROUP BY ino")
def owning_directory(spark, sf_dir):
    return closure.parents(s.dirents(spark, sf_dir))


# --- integrity and garbage


@query(f"""WITH {s.EXTENTS}, o AS (SELECT ino, start, len, max(start + len) OVER (PARTITION BY ino ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM extents) SELECT * FROM o WHERE start < furthest""")
def extent_overlap(spark, sf_dir):
    return integrity.overlaps(s.extents(spark, sf_dir).select("ino", "start", "len"))


@query(f"WITH {s.EXTENTS}, {s.INODES} SELECT e.ino, start, len, size FROM extents e JOIN inodes i ON e.ino = i.ino WHERE start + len > size")
def extent_past_end(spark, sf_dir):
    return integrity.beyond_end(s.extents(spark, sf_dir).select("ino", "start", "len"), s.inodes(spark, sf_dir))


@query("SELECT l_orderkey * 8 + l_linenumber AS seq, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_seq(spark, sf_dir):
    return integrity.repeated_sequence(s.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")))


@query(f"WITH {s.EXTENTS} SELECT obj, ino, start FROM extents WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = obj AND p_size % 5 <> 0)")
def missing_refs(spark, sf_dir):
    there = s.table(spark, sf_dir, "part").where("p_size % 5 <> 0")
    return integrity.missing(s.extents(spark, sf_dir).select("ino", "start", "obj"), there, "obj", "p_partkey")


@query(f"WITH {s.INODES}, d AS (SELECT l_orderkey AS ino, count(*) AS n FROM lineitem GROUP BY 1) SELECT i.ino, nlink, coalesce(n, 0) AS entries FROM inodes i LEFT JOIN d ON i.ino = d.ino WHERE coalesce(n, 0) <> nlink")
def nlink_check(spark, sf_dir):
    return integrity.wrong_links(s.inodes(spark, sf_dir), s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ino")))


@query(f"""WITH RECURSIVE {s.EDGES}, r(node) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT dst FROM r JOIN edges ON src = node) SELECT node FROM r""")
def reachable(spark, sf_dir):
    return closure.reachable(s.table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), s.edges(spark, sf_dir)).select("node")


@query(f"""WITH RECURSIVE {s.EDGES}, w(node, spot, d) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT node, dst, d + 1 FROM w JOIN edges ON src = spot WHERE d < 6), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
SELECT n.node, CAST(least(coalesce(max(d), 0), 5) AS INTEGER) AS depth, coalesce(max(d), 0) <= 4 AS accepted FROM n LEFT JOIN w ON n.node = w.node GROUP BY n.node""")
def chain_depth(spark, sf_dir):
    return closure.chain_depth(s.edges(spark, sf_dir))


@query("SELECT p_brand AS tag, count(*) AS objects, CAST(sum(p_size) AS BIGINT) AS bytes FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) GROUP BY p_brand")
def unreachable_by_tag(spark, sf_dir):
    live = s.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("obj"))
    return closure.unreachable(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), F.col("p_brand").alias("tag"), "p_size"), live, "obj", "tag", "p_size")


_RECORDS = """rec AS (SELECT l_partkey AS cid, l_suppkey AS segment, l_orderkey * 8 + l_linenumber AS "offset", CASE WHEN l_linenumber = 7 THEN 'pad' WHEN l_linenumber % 2 = 0 THEN 'model' ELSE 'data' END AS tag, CAST(l_quantity AS BIGINT) AS size FROM lineitem)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("l_linenumber") == 7, "pad").when(F.col("l_linenumber") % 2 == 0, "model").otherwise("data")
    return s.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cid"), F.col("l_suppkey").alias("segment"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offset"), tag.alias("tag"), F.col("l_quantity").cast("long").alias("size"))


@query(f"""WITH {_RECORDS}, idx AS (SELECT cid, max((segment, "offset")) AS spot FROM rec GROUP BY cid), live AS (SELECT p_partkey AS cid FROM part WHERE p_size > 10),
m AS (SELECT size, CASE WHEN tag = 'pad' THEN 'padding' WHEN (segment, "offset") <> spot THEN 'superseded' WHEN l.cid IS NOT NULL THEN 'live-' || tag ELSE 'dead-' || tag END AS category FROM rec r JOIN idx i ON r.cid = i.cid LEFT JOIN live l ON l.cid = r.cid)
SELECT category, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM m GROUP BY category""")
def physical_report(spark, sf_dir):
    rec = _records(spark, sf_dir)
    index = rec.groupBy("cid").agg(F.max(F.struct("segment", "offset")).alias("at")).select("cid", "at.segment", "at.offset")
    return closure.physical_report(rec, index, s.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cid")))


@query(f"""WITH {_RECORDS}, c AS (SELECT s_suppkey AS segment FROM supplier WHERE s_suppkey % 3 = 0) SELECT cid, segment, "offset", size FROM rec WHERE segment IN (SELECT segment FROM c) AND cid IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def gc_survivors(spark, sf_dir):
    chosen = s.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("segment"))
    live = s.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cid"))
    return closure.survivors(_records(spark, sf_dir), live, chosen, "cid", "segment").select("cid", "segment", "offset", "size")


@query(f"""WITH {s.EXTENTS}, {s.INODES}, o AS (SELECT ino, start, max(start + len) OVER (PARTITION BY ino ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM extents),
obj AS (SELECT p_partkey AS obj FROM part WHERE p_size % 5 <> 0), d AS (SELECT l_orderkey AS ino, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT 'extent-overlap' AS category, 'error' AS severity FROM o WHERE start < furthest UNION ALL SELECT 'extent-past-end', 'error' FROM extents e JOIN inodes i ON e.ino = i.ino WHERE start + len > size
UNION ALL SELECT 'missing-object', 'error' FROM extents WHERE obj NOT IN (SELECT obj FROM obj) UNION ALL SELECT 'missing-inode', 'error' FROM lineitem WHERE l_orderkey NOT IN (SELECT ino FROM inodes)
UNION ALL SELECT 'link-count', 'error' FROM inodes i LEFT JOIN d ON i.ino = d.ino WHERE coalesce(n, 0) <> nlink UNION ALL SELECT 'repeated-sequence', 'error' FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'unreachable', 'warning' FROM obj WHERE obj NOT IN (SELECT obj FROM extents)) SELECT category, severity, count(*) AS findings FROM f GROUP BY 1, 2""")
def fsck_report(spark, sf_dir):
    objects = s.table(spark, sf_dir, "part").where("p_size % 5 <> 0").select(F.col("p_partkey").alias("obj"))
    entries = s.dealt(s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ino")), "ino")
    return integrity.report([integrity.check_store(s.inodes(spark, sf_dir), entries, s.extents(spark, sf_dir), objects, s.dealt(s.log(spark, sf_dir), "seq"))])


@query("SELECT max(o_orderkey) AS generation, arg_max(o_orderpriority, o_orderkey) AS root_id FROM orders WHERE o_orderstatus = 'F'")
def newest_root(spark, sf_dir):
    return integrity.newest_root(s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation"), F.col("o_orderpriority").alias("root_id"), (F.col("o_orderstatus") == "F").alias("valid")))


# --- log, folds, candidates


_REPLAY = f"""WITH {s.LOG}, w AS (SELECT ino, seq, op, size, max(CASE WHEN op = 'create' OR (op = 'setattr' AND size IS NOT NULL) THEN seq END) OVER (PARTITION BY ino) AS anchor FROM log WHERE seq > {{after}}),
g AS (SELECT ino, max(CASE WHEN seq = anchor THEN CASE WHEN op = 'create' THEN 0 ELSE size END END) AS base, max(CASE WHEN op = 'write' AND seq > coalesce(anchor, -2) THEN size END) AS written,
CAST(sum(CASE WHEN op IN ('create', 'link') THEN 1 WHEN op = 'unlink' THEN -1 ELSE 0 END) AS BIGINT) AS nlink, max(seq) AS last_seq FROM w GROUP BY ino)
SELECT ino, greatest(coalesce(base, 0), coalesce(written, 0)) AS size, nlink, last_seq FROM g WHERE nlink > 0"""


@query(_REPLAY.format(after=-1))
def replay_state(spark, sf_dir):
    none = s.inodes(spark, sf_dir).where("false").select("ino", "size", "nlink")
    return namespace.replay(none, s.log(spark, sf_dir))


@query(_REPLAY.format(after=500))
def late_seq_drop(spark, sf_dir):
    none = s.inodes(spark, sf_dir).where("false").select("ino", "size", "nlink")
    return namespace.replay(none, s.log(spark, sf_dir), applied=500)


@query(f"WITH {s.EXTENTS}, {s.INODES}, t AS (SELECT e.ino, start, least(len, size - start) AS len FROM extents e JOIN inodes i ON e.ino = i.ino) SELECT * FROM t WHERE len > 0")
def truncate_extents(spark, sf_dir):
    return namespace.truncate(s.extents(spark, sf_dir).select("ino", "start", "len"), s.inodes(spark, sf_dir))


@query("""WITH d AS (SELECT user_id, event_id, value, CASE WHEN value >= 70 THEN 1 WHEN value <= 30 THEN 0 END AS x FROM events)
SELECT user_id, event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS pressured FROM d""")
def hysteresis(spark, sf_dir):
    return folds.hysteresis(s.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 70, 30).drop("value")


@query("SELECT user_id AS ino, count(*) AS touches, round((1 - pow(0.9, count(*))) / 0.1, 9) AS hotness FROM events GROUP BY 1")
def hotness(spark, sf_dir):
    return folds.hotness(s.log(spark, sf_dir), "ino").withColumn("hotness", F.round("hotness", 9))


def _unit() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))


@query("""WITH r AS (SELECT user_id, event_type, abs(1 - greatest(0.0, least(1.0, value / 100))) AS e, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) - 1 AS back FROM events),
g AS (SELECT user_id, event_type, sum((1 - 0.9::DOUBLE) * pow(0.9::DOUBLE, back) * e) + pow(0.9::DOUBLE, count(*)) AS error FROM r GROUP BY 1, 2)
SELECT user_id, event_type, round(error, 9) AS error, round((1 / (0.1 + error)) / sum(1 / (0.1 + error)) OVER (PARTITION BY user_id), 9) AS weight FROM g""")
def trust_weights(spark, sf_dir):
    t = folds.trust_weights(s.table(spark, sf_dir, "events").withColumn("m", F.col("value") / 100), "user_id", "event_type", ["event_id"], "m")
    return t.select("user_id", "event_type", F.round("error", 9).alias("error"), F.round("weight", 9).alias("weight"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS trust FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trust DESC, event_type) AS place FROM c) SELECT user_id, event_type, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def trust_order_budget(spark, sf_dir):
    c = s.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("trust")).withColumn("ordinal", F.col("event_type"))
    return candidates.plan_channels(c, "user_id", F.lit(3)).select("user_id", "event_type", "place")


_SERIES = "e AS (SELECT user_id, event_id, greatest(0.0, least(1.0, value / 100)) AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {_SERIES}, r(user_id, event_id, n, lev, rate, win, spot, regime) AS (SELECT user_id, event_id, n, m, CAST(0 AS DOUBLE), 0, CAST(0 AS DOUBLE), 'unknown' FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, lev2, rate2, CASE WHEN w > 0 THEN w WHEN hit THEN 8 ELSE 0 END, CASE WHEN hit THEN lev2 ELSE spot END, CASE WHEN w > 0 OR hit THEN 'slew' WHEN n <= 4 OR abs(rate2) <= 0.004 THEN 'stable' ELSE 'drift' END
FROM (SELECT *, w = 0 AND n > 4 AND abs(jump) > 0.25 AS hit FROM (SELECT e.user_id, e.event_id, e.n, spot, m - lev AS jump, 0.9 * rate + 0.1 * (m - lev) AS rate2, 0.8 * lev + 0.2 * m AS lev2,
CASE WHEN win = 0 OR abs(m - spot) < 0.1 THEN 0 ELSE win - 1 END AS w FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))) SELECT user_id, event_id, regime FROM r""")
def regimes(spark, sf_dir):
    rows = s.table(spark, sf_dir, "events").select("user_id", "event_id", _unit().alias("m"))
    return folds.track_regimes(rows, "user_id", ["event_id"], "m").select("user_id", "event_id", "regime")


@query(f"""WITH RECURSIVE {_SERIES}, r(user_id, event_id, n, d, h, signal) AS (SELECT user_id, event_id, n, 0.8 * CAST(0 AS DOUBLE) + 0.2 * m, 0.8 * CAST(0 AS DOUBLE) + 0.2 * (1 - m), 'none' FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, 0.8 * d + 0.2 * m, 0.8 * h + 0.2 * (1 - m), CASE WHEN e.n <= 5 THEN 'none' WHEN d >= 0.005 AND m > 4 * d AND m - d > 0.2 THEN 'density_jump' WHEN h >= 0.005 AND 1 - m > 4 * h AND 1 - m - h > 0.2 THEN 'hist_jump' ELSE 'none' END
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, event_id, signal FROM r""")
def slew_signals(spark, sf_dir):
    rows = s.table(spark, sf_dir, "events").select("user_id", "event_id", _unit().alias("m"), (1 - _unit()).alias("c"))
    return folds.detect_slews(rows, "user_id", ["event_id"], "m", "c").select("user_id", "event_id", "signal")


@query("""WITH m AS (SELECT l_orderkey * 8 + l_linenumber AS cand, l_partkey % 50 AS grp, l_suppkey AS anchor, CAST(l_quantity AS BIGINT) AS saving FROM lineitem), t AS (SELECT grp, anchor, sum(saving) AS gain FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gain DESC, anchor) AS r FROM t) SELECT grp, anchor, CAST(gain AS BIGINT) AS gain FROM r WHERE r = 1""")
def first_anchor(spark, sf_dir):
    m = s.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("grp"), F.col("l_suppkey").alias("anchor"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("member"), F.col("l_quantity").cast("long").alias("saving"))
    m = m.groupBy("grp", "anchor", "member").agg(F.sum("saving").alias("saving"))
    return candidates.choose_anchors(m, "grp", picks=1).select("grp", "anchor", "gain")


_COST = """c AS (SELECT l_orderkey AS chunk, CAST(l_linenumber AS BIGINT) AS ordinal, max(l_returnflag) AS family, CAST(max(l_quantity) AS BIGINT) AS persisted FROM lineitem WHERE l_discount < 0.09 GROUP BY 1, 2)"""


@query(f"WITH {_COST}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY persisted, ordinal) AS r FROM c) SELECT chunk, ordinal, family, persisted FROM r WHERE r = 1")
def cheapest_candidate(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").where("l_discount < 0.09").groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("long").alias("ordinal")).agg(F.max("l_returnflag").alias("family"), F.max("l_quantity").cast("long").alias("persisted"), F.lit(True).alias("valid"))
    return candidates.cheapest(rows, ["chunk"]).drop("valid")


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for the distinct 4 KiB chunks of pages."""
    pages = s.table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("bytes"))
    c = chunks.chunk(pages, s.CHUNK).dropDuplicates(["cid"]).select("cid", "bytes").withColumn("base", F.lit(None).cast("binary"))
    return candidates.with_costs(candidates.candidates(c))


_RAW = f"""WITH b AS (SELECT encode(html) AS bytes FROM pages), c AS (SELECT bytes[i * {s.CHUNK} + 1 : (i + 1) * {s.CHUNK}] AS b FROM (SELECT *, unnest(range(0, CAST(ceil(octet_length(bytes) / {s.CHUNK}.0) AS BIGINT))) AS i FROM b))
SELECT DISTINCT sha256(b) AS cid, 'raw' AS family, CAST(37 + octet_length(b) + 4 AS BIGINT) AS persisted, CAST(37 + octet_length(b) + 4 + octet_length(b) // 128 * 2 + 512 AS BIGINT) AS objective"""


@query(f"{_RAW.replace('octet_length(b) // 128 * 2', '2 * (8 * octet_length(b) // 1024)')} FROM c")
def candidate_costs_raw(spark, sf_dir):
    return _proposed(spark, sf_dir).where("family = 'raw'").select("cid", "family", "persisted", "objective")


@query()
def encode_pages(spark, sf_dir):
    return candidates.cheapest(_proposed(spark, sf_dir), ["cid"]).select("cid", "family", "persisted", "valid")


@query("SELECT mode, CAST(j AS BIGINT) AS j FROM (VALUES ('capacity', 1000 + 2 * 4096 // 1024 + 2 * 6144 // 1024 + 256 * 1 + 512 * 1), ('balanced', 1000 + 8 * 4096 // 1024 + 8 * 6144 // 1024 + 512 + 1024), ('latency', 1000 + 64 * 4096 // 1024 + 16 * 6144 // 1024 + 4096 + 8192), ('archive', 1000 + 4096 // 1024 + 6144 // 1024 + 64 + 256), ('ram', 1000 + 32 * 4096 // 1024 + 32 * 6144 // 1024 + 2048 + 4096)) t(mode, j)")
def policy_objective(spark, sf_dir):
    n = F.lit(2048)
    return values.policies(spark).select("mode", values.total_cost(F.lit(1000), values.read_cycles(F.lit("base_residual"), n), values.write_cycles(F.lit("base_residual"), n), F.lit(1), F.lit(1)).alias("j"))


@query("SELECT doc_id, round(1 - log2(1 + least(1.0, n_chars / 5000.0)) / 2, 9) AS measured FROM documents")
def measurements(spark, sf_dir):
    return s.table(spark, sf_dir, "documents").select("doc_id", F.round(values.measurement(F.col("n_chars") / 5000), 9).alias("measured"))


@query(f"WITH {s.BLOBS}, c AS (SELECT doc_id, regexp_matches(hex(bytes), '^(00)*$') AS z FROM blobs) SELECT doc_id, z AS all_zero FROM c")
def zero_blobs(spark, sf_dir):
    return s.blobs(spark, sf_dir).select("doc_id", values.all_zero(F.col("bytes")).alias("all_zero"))


@query("SELECT page_id, coalesce(regexp_extract(url, '^.+\\.([^.]+)$', 1), '') AS extension, CAST(least(length(url) // 16, 15) AS INTEGER) AS length_bucket FROM pages")
def name_classes(spark, sf_dir):
    return s.table(spark, sf_dir, "pages").select("page_id", values.name_class(F.col("url")).alias("c")).select("page_id", "c.extension", "c.length_bucket")


@query(f"""WITH {s.BLOBS}, b AS (SELECT doc_id, octet_length(bytes) AS n, regexp_extract_all(hex(bytes), '..') AS x FROM blobs), p AS (SELECT doc_id, n, unnest(x) AS x, unnest(range(n)) AS i FROM b),
whole AS (SELECT doc_id, -sum(c / t * log2(c / t)) AS e, count(*) AS k FROM (SELECT doc_id, c, CAST(sum(c) OVER (PARTITION BY doc_id) AS DOUBLE) AS t FROM (SELECT doc_id, x, count(*) AS c FROM p GROUP BY 1, 2)) GROUP BY doc_id),
parts AS (SELECT doc_id, s, -sum(c / t * log2(c / t)) AS e FROM (SELECT doc_id, s, c, CAST(sum(c) OVER (PARTITION BY doc_id, s) AS DOUBLE) AS t FROM (SELECT doc_id, s, x, count(*) AS c FROM p JOIN range(3) o(s) ON i % (greatest(1, n // least(n, 4096)) + s) = 0
AND i // (greatest(1, n // least(n, 4096)) + s) < least(n, 4096) GROUP BY 1, 2, 3)) GROUP BY 1, 2), least_ AS (SELECT doc_id, min(e) AS e FROM parts GROUP BY 1),
sk AS (SELECT doc_id, CAST(floor(20 * (count(*) FILTER (x BETWEEN '20' AND '7E' OR x IN ('09', '0A', '0D')) / count(*))) AS INTEGER) AS pr, CAST(floor(count(DISTINCT x) / 256 * 20) AS INTEGER) AS di FROM p WHERE i < 4096 AND i % greatest(1, least(n, 4096) // 2048) = 0 GROUP BY 1)
SELECT b.doc_id, round(abs(coalesce(w.e, 0)), 9) AS entropy, CAST(coalesce(k, 0) AS INTEGER) AS distinct_bytes, round(abs(coalesce(l.e, 0)), 9) AS sampled, coalesce(pr, 0) AS printable, coalesce(di, 0) AS distinct_share
FROM b LEFT JOIN whole w ON w.doc_id = b.doc_id LEFT JOIN least_ l ON l.doc_id = b.doc_id LEFT JOIN sk ON sk.doc_id = b.doc_id""")
def byte_features(spark, sf_dir):
    b = F.col("bytes")
    return s.blobs(spark, sf_dir).select("doc_id", F.round(byte_functions.byte_entropy(b), 9).alias("entropy"), byte_functions.distinct_bytes(b).alias("distinct_bytes"), F.round(byte_functions.sampled_entropy()(b), 9).alias("sampled"), byte_functions.byte_sketch(b).alias("s")).select("doc_id", "entropy", "distinct_bytes", "sampled", F.col("s.printable").alias("printable"), F.col("s.distinct").alias("distinct_share"))


@query("""WITH c AS (SELECT conv_id, turn, encode(text) AS a, lag(encode(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), t AS (SELECT conv_id, turn, least(octet_length(a), octet_length(b)) AS n, regexp_extract_all(hex(a), '..') AS a, regexp_extract_all(hex(b), '..') AS b FROM c WHERE b IS NOT NULL),
p AS (SELECT conv_id, turn, n, unnest(range(1, n + 1)) AS i, unnest(a[1:n]) AS x, unnest(b[1:n]) AS y FROM t), d AS (SELECT *, x <> y AND coalesce(lag(x = y) OVER (PARTITION BY conv_id, turn ORDER BY i), TRUE) AS begins FROM p),
g AS (SELECT conv_id, turn, count(*) FILTER (x <> y) AS positions, count(*) FILTER (begins) AS runs FROM d GROUP BY 1, 2), h AS (SELECT conv_id, turn, sum(abs(k)) AS l1 FROM (SELECT conv_id, turn, z, sum(k) AS k FROM (SELECT conv_id, turn, x AS z, 1 AS k FROM p UNION ALL SELECT conv_id, turn, y, -1 FROM p) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT t.conv_id, t.turn, CAST(coalesce(positions, 0) AS INTEGER) AS positions, CAST(coalesce(runs, 0) AS INTEGER) AS runs, round(coalesce(CAST(l1 AS DOUBLE) / (2 * n), 0), 9) AS hist_change FROM t LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn LEFT JOIN h ON h.conv_id = t.conv_id AND h.turn = t.turn""")
def version_differences(spark, sf_dir):
    turns = lookups.neighbours(s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("bytes")), "conv_id", "turn", "bytes")
    n = F.least(F.octet_length("bytes"), F.octet_length("previous"))
    d = byte_functions.difference(F.substring("bytes", F.lit(1), n), F.substring("previous", F.lit(1), n))
    return turns.where("previous is not null").select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.positions", "d.runs", F.round("d.hist_change", 9).alias("hist_change"))


from weft.plans import store_queries  # noqa: E402, F401  (registers its queries)
