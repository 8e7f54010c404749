"""Further queries over the driver's tables: accounting, indexes, gates, priors and reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import values
from weft.operators import accounting, candidates, closure, integrity, lookups, namespace
from weft.plans import stand_ins as s
from weft.plans.catalog import query

_REFS = """refs AS (SELECT l_orderkey AS ino, CAST((l_linenumber - 1) * 40 AS BIGINT) AS start, l_partkey AS obj, CASE l_linenumber % 3 WHEN 0 THEN 'model' WHEN 1 THEN 'payload' ELSE 'residual' END AS kind, p_size AS size
FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_DESC = "descs AS (SELECT ino, start, len, obj AS model, family, 5 + len % 32 AS descriptor_bytes FROM extents)"


def _refs(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "model").when(F.col("l_linenumber") % 3 == 1, "payload").otherwise("residual")
    rows = s.table(spark, sf_dir, "lineitem").join(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("size")), "l_partkey")
    return rows.select(F.col("l_orderkey").alias("ino"), ((F.col("l_linenumber") - 1) * 40).cast("long").alias("start"), F.col("l_partkey").alias("obj"), kind.alias("kind"), "size")


def _descs(spark, sf_dir):
    return s.extents(spark, sf_dir).withColumn("descriptor_bytes", 5 + F.col("len") % 32).withColumn("model", F.col("obj"))


@query(f"WITH {_REFS}, o AS (SELECT obj, kind, max(size) AS size FROM refs GROUP BY 1, 2) SELECT kind, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM o GROUP BY kind")
def object_accounting(spark, sf_dir):
    return accounting.object_accounting(_refs(spark, sf_dir))


@query(f"WITH {s.EXTENTS}, {_DESC} SELECT family, count(*) AS extents, CAST(sum(descriptor_bytes) AS BIGINT) AS descriptor_bytes, count(DISTINCT model) AS models FROM descs GROUP BY family")
def extent_overhead(spark, sf_dir):
    return accounting.overhead(_descs(spark, sf_dir))


@query(f"""WITH {s.EXTENTS}, {_DESC}, {_REFS}, o AS (SELECT ino, start, sum(size) AS n FROM (SELECT ino, start, obj, max(size) AS size FROM refs GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT d.ino, d.start, CAST(descriptor_bytes + coalesce(n, 0) AS BIGINT) AS persisted FROM descs d LEFT JOIN o ON d.ino = o.ino AND d.start = o.start""")
def incumbent_bytes(spark, sf_dir):
    return accounting.incumbent_bytes(_descs(spark, sf_dir), _refs(spark, sf_dir), ["ino", "start"])


@query(f"WITH {s.EXTENTS} SELECT p_partkey AS obj, p_size FROM part WHERE p_partkey IN (SELECT obj FROM extents WHERE len > 40) OR p_partkey IN (SELECT ps FROM (SELECT s_suppkey AS ps FROM supplier WHERE s_acctbal > 0))")
def retained_index(spark, sf_dir):
    index = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), "p_size")
    live = s.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("obj"))
    return accounting.retained(index, s.extents(spark, sf_dir).where("len > 40"), live, "obj")


@query(f"""WITH RECURSIVE {s.EDGES}, r(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT dst FROM r JOIN edges ON src = node)
SELECT p_partkey AS node, p_brand AS tag FROM part WHERE p_partkey IN (SELECT node FROM r)""")
def staged_to_commit(spark, sf_dir):
    part = s.table(spark, sf_dir, "part")
    live = closure.reachable(part.where("p_size = 50").select(F.col("p_partkey").alias("node")), s.edges(spark, sf_dir))
    return accounting.staged_to_commit(part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("tag")), live, "node")


@query(f"""WITH RECURSIVE {s.EDGES}, r(node) AS (SELECT p_partkey FROM part WHERE p_size = 50 OR p_size = 1 UNION SELECT dst FROM r JOIN edges ON src = node) SELECT count(*) AS live, (SELECT count(*) FROM part) - count(*) AS dead FROM r""")
def live_with_snapshots(spark, sf_dir):
    """The mark from the newest root (size 50) and from the snapshots' roots (size 1)."""
    part = s.table(spark, sf_dir, "part")
    roots = part.where("p_size = 50").union(part.where("p_size = 1")).select(F.col("p_partkey").alias("node"))
    return closure.reachable(roots, s.edges(spark, sf_dir)).agg(F.count("*").alias("live")).select("live", (F.lit(part.count()) - F.col("live")).alias("dead"))


@query(f"""WITH {s.EXTENTS}, i AS (SELECT l_orderkey AS ino, CAST((l_linenumber - 1) * 40 AS BIGINT) AS start, min(l_partkey) AS cid FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT e.ino, e.start, CASE WHEN i.cid IS NULL THEN 'not-indexed' ELSE 'differs' END AS finding FROM extents e LEFT JOIN i ON e.ino = i.ino AND e.start = i.start WHERE i.cid IS NULL OR i.cid <> e.obj""")
def index_mismatches(spark, sf_dir):
    index = s.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("ino"), ((F.col("l_linenumber") - 1) * 40).cast("long").alias("start")).agg(F.min("l_partkey").alias("cid"))
    return accounting.index_mismatches(s.extents(spark, sf_dir).select("ino", "start", F.col("obj").alias("cid")), index, ["ino", "start"])


@query("""WITH d AS (SELECT c_nationkey AS parent, CASE WHEN c_custkey % 9 = 0 THEN '..' WHEN c_custkey % 11 = 0 THEN c_name || '/x' ELSE c_name END AS name, c_custkey * 3 AS ino, CASE WHEN c_custkey % 4 = 0 THEN 'dir' ELSE 'file' END AS kind FROM customer),
i AS (SELECT o_orderkey AS ino, CASE WHEN o_custkey % 2 = 0 THEN 'dir' ELSE 'file' END AS kind FROM orders),
f AS (SELECT d.parent, d.name, CASE WHEN name IN ('.', '..') OR contains(name, '/') OR octet_length(encode(name)) > 255 OR name = '' THEN 'name' WHEN i.kind IS NULL THEN 'missing-inode' WHEN i.kind <> d.kind THEN 'type' END AS finding FROM d LEFT JOIN i ON d.ino = i.ino)
SELECT * FROM f WHERE finding IS NOT NULL""")
def invalid_entries(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 9 == 0, "..").when(F.col("c_custkey") % 11 == 0, F.concat("c_name", F.lit("/x"))).otherwise(F.col("c_name"))
    kind = lambda c: F.when(c, "dir").otherwise("file").alias("kind")
    d = s.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent"), name.alias("name"), (F.col("c_custkey") * 3).alias("ino"), kind(F.col("c_custkey") % 4 == 0))
    i = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ino"), kind(F.col("o_custkey") % 2 == 0))
    return accounting.invalid_entries(d, i, values.valid_name(F.col("name")))


@query("""WITH t AS (SELECT user_id, event_type AS channel, sum(value) AS trust, min(event_id) AS ordinal FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trust DESC, ordinal) AS rank FROM t),
w AS (SELECT user_id, arg_max(event_type, event_id) AS winner FROM events GROUP BY 1) SELECT r.user_id, winner, CAST(rank AS INTEGER) AS rank FROM r JOIN w ON r.user_id = w.user_id AND r.channel = w.winner""")
def winner_rank(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    trust = e.groupBy("user_id", F.col("event_type").alias("channel")).agg(values.exact_sum(F.col("value")).alias("trust"), F.min("event_id").alias("ordinal"))
    return accounting.winner_rank(trust, e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("winner")), "user_id")


@query("""WITH t AS (SELECT event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total, avg(CAST(floor(value * 100) AS BIGINT)) AS mean, max(CAST(floor(value * 100) AS BIGINT)) AS most FROM events GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY total DESC, event_type) AS INTEGER) AS place FROM t""")
def operation_totals(spark, sf_dir):
    return accounting.operation_totals(s.table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100).cast("long").alias("ms")), "event_type", "ms")


@query("""WITH rec AS (SELECT l_suppkey AS segment, l_orderkey * 8 + l_linenumber AS "offset", max(l_partkey) AS cid FROM lineitem GROUP BY 1, 2) SELECT segment, "offset", cid, CAST(row_number() OVER (PARTITION BY segment ORDER BY "offset") AS INTEGER) AS place FROM rec WHERE cid IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def full_compaction_order(spark, sf_dir):
    """Every segment is a victim; its live records in the order of copying."""
    rec = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("segment"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offset")).agg(F.max("l_partkey").alias("cid"))
    live = s.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("cid"))
    return accounting.copy_order(closure.survivors(rec, live, rec.select("segment").distinct(), "cid", "segment").select("segment", "offset", "cid"), "segment", "offset")


@query("""WITH c AS (SELECT user_id, count(*) AS observations, sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 0 END) / count(*) AS share FROM events GROUP BY 1) SELECT user_id, observations >= 16 AND share < 0.10 AS skips FROM c""")
def skipped_classes(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type").alias("rans"))
    c = e.join(F.broadcast(first), F.col("event_type") == F.col("rans"), "left").groupBy("user_id").agg(F.count("*").alias("observations"), (F.count("rans") / F.count("*")).alias("share"))
    return c.select("user_id", accounting.skips_entropy_coding(F.col("observations"), F.col("share")).alias("skips"))


_ALLOWED = "list_filter(['byte_rans', 'bases', 'temporal_bases', 'universe', 'shared_dict', 'exact_ref', 'configurational', 'sequence_rans'], lambda x, i: (c_custkey >> CAST(i - 1 AS BIGINT)) % 2 = 1)"


def _switches(spark, sf_dir):
    names = F.array(*map(F.lit, ("byte_rans", "bases", "temporal_bases", "universe", "shared_dict", "exact_ref", "configurational", "sequence_rans")))
    return s.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.filter(names, lambda x, i: F.expr("c_custkey").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0).alias("allowed"))


@query(f"""WITH a AS (SELECT c_custkey, {_ALLOWED} AS allowed FROM customer), c AS (SELECT *, unnest(['shared_content', 'prev_version', 'adjacent', 'universe', 'rans', 'raw', 'shared_dict']) AS channel FROM a)
SELECT c_custkey, channel, CASE channel WHEN 'shared_content' THEN list_contains(allowed, 'exact_ref') WHEN 'prev_version' THEN list_contains(allowed, 'bases') WHEN 'adjacent' THEN list_contains(allowed, 'bases') AND list_contains(allowed, 'temporal_bases')
WHEN 'universe' THEN list_contains(allowed, 'universe') WHEN 'rans' THEN list_contains(allowed, 'byte_rans') OR list_contains(allowed, 'sequence_rans') WHEN 'shared_dict' THEN list_contains(allowed, 'shared_dict') ELSE TRUE END AS open FROM c""")
def channel_gates(spark, sf_dir):
    rows = _switches(spark, sf_dir).withColumn("channel", F.explode(F.array(*map(F.lit, ("shared_content", "prev_version", "adjacent", "universe", "rans", "raw", "shared_dict")))))
    return rows.select("c_custkey", "channel", accounting.channel_allowed(F.col("channel"), F.col("allowed")).alias("open"))


@query(f"""WITH a AS (SELECT c_custkey, {_ALLOWED} AS allowed FROM customer), c AS (SELECT *, unnest(['raw', 'rans', 'sequence_rans', 'base_residual', 'zero', 'entropy_ref', 'exact_ref', 'sequence_shared_dict']) AS family FROM a)
SELECT c_custkey, family, CASE family WHEN 'raw' THEN TRUE WHEN 'rans' THEN list_contains(allowed, 'byte_rans') WHEN 'sequence_rans' THEN list_contains(allowed, 'sequence_rans') WHEN 'base_residual' THEN list_contains(allowed, 'bases')
WHEN 'entropy_ref' THEN list_contains(allowed, 'universe') WHEN 'exact_ref' THEN list_contains(allowed, 'exact_ref') WHEN 'sequence_shared_dict' THEN list_contains(allowed, 'shared_dict') ELSE list_contains(allowed, 'configurational') END AS open FROM c""")
def family_gates(spark, sf_dir):
    rows = _switches(spark, sf_dir).withColumn("family", F.explode(F.array(*map(F.lit, ("raw", "rans", "sequence_rans", "base_residual", "zero", "entropy_ref", "exact_ref", "sequence_shared_dict")))))
    return rows.select("c_custkey", "family", accounting.family_allowed(F.col("family"), F.col("allowed")).alias("open"))


@query(f"""WITH a AS (SELECT c_custkey, {_ALLOWED} AS allowed, c_acctbal > 5000 AS raw FROM customer) SELECT c_custkey, array_to_string(list_sort(CASE WHEN raw THEN ['dedup', 'zero_fill'] ELSE list_concat(['dedup', 'zero_fill'], allowed) END), ',') AS families FROM a""")
def family_masks(spark, sf_dir):
    return _switches(spark, sf_dir).select("c_custkey", F.array_join(accounting.family_mask(F.col("allowed"), F.col("c_acctbal") > 5000), ",").alias("families"))


@query("""SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber % 3 = 1 THEN 0.5 ELSE least(1.0, l_quantity / 40) END) AS quality, max(CAST(greatest(greatest(60 - l_quantity, 0) - l_linenumber, 0) AS BIGINT)) AS descriptor FROM lineitem GROUP BY 1, 2""")
def outcome_qualities(spark, sf_dir):
    n = F.col("l_linenumber")
    family = F.when(n % 3 == 0, "palette").otherwise("rans")
    measured = F.when(n % 3 == 2, F.col("l_quantity") / 40)
    rows = s.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", accounting.outcome_quality(family, measured).alias("q"), accounting.descriptor_bytes(F.lit(60), F.col("l_quantity").cast("long"), n).cast("long").alias("d"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max("q").alias("quality"), F.max("d").alias("descriptor"))


@query("""WITH k AS (SELECT sha256(source || chr(31) || lang) AS class, CASE WHEN n_chars < 2000 THEN 'rans' ELSE 'raw' END AS channel FROM documents), t AS (SELECT class, count(*) AS seen FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT k.class, channel, count(*) AS wins, count(*) / max(seen) AS share FROM k JOIN t ON k.class = t.class GROUP BY 1, 2""")
def class_priors(spark, sf_dir):
    d = s.table(spark, sf_dir, "documents")
    key = accounting.class_key("extension", [F.col("source"), F.col("lang")], [], F.lit(None))
    return accounting.prior_table(d.select(key.alias("class"), F.when(F.col("n_chars") < 2000, "rans").otherwise("raw").alias("channel")), "class", most=20)


_XATTRS = "x AS (SELECT user_id AS ino, event_type AS name, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS v FROM events)"


@query(f"WITH {_XATTRS}, r AS (SELECT *, row_number() OVER (PARTITION BY ino, name ORDER BY seq DESC) AS r FROM x) SELECT ino, count(*) AS attributes, string_agg(name, ',' ORDER BY name) AS names FROM r WHERE r = 1 AND v IS NOT NULL GROUP BY ino")
def xattr_list(spark, sf_dir):
    e = s.table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("ino"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("long")).alias("value"))
    return namespace.attributes(log).groupBy("ino").agg(F.count("*").alias("attributes"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("SELECT s_suppkey AS key, p_size, p_partkey IS NOT NULL AS found FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 37")
def point_lookup(spark, sf_dir):
    wanted = s.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 37).alias("p_partkey"))
    return lookups.points(wanted, s.table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"]).select("key", "p_size", "found")


@query(f"""WITH {s.EXTENTS}, e AS (SELECT ino, count(*) AS extents, CAST(sum(len) AS BIGINT) AS logical, count(DISTINCT obj) AS objects, count(DISTINCT segment) AS segments, max(start + len) AS reach FROM extents GROUP BY ino)
SELECT o_orderkey AS ino, coalesce(extents, 0) AS extents, coalesce(logical, 0) AS logical, coalesce(objects, 0) AS objects, coalesce(segments, 0) AS segments, coalesce(reach, 0) AS reach FROM orders LEFT JOIN e ON ino = o_orderkey""")
def inspect_files(spark, sf_dir):
    e = s.extents(spark, sf_dir).groupBy("ino").agg(F.count("*").alias("extents"), F.sum("len").alias("logical"), F.size(F.collect_set("obj")).cast("long").alias("objects"), F.size(F.collect_set("segment")).cast("long").alias("segments"), F.max(F.col("start") + F.col("len")).alias("reach"))
    return s.inodes(spark, sf_dir).select("ino").join(e, "ino", "left").na.fill(0)


@query(f"""WITH {s.EXTENTS}, o AS (SELECT DISTINCT ino, family, obj FROM extents), l AS (SELECT ino, family, sum(len) AS logical FROM extents GROUP BY 1, 2), p AS (SELECT ino, family, sum(p_size) AS stored FROM o JOIN part ON obj = p_partkey GROUP BY 1, 2)
SELECT l.ino, l.family, CAST(logical AS BIGINT) AS logical, CAST(stored AS BIGINT) AS stored, logical / stored AS ratio FROM l JOIN p ON l.ino = p.ino AND l.family = p.family""")
def explain_files(spark, sf_dir):
    """The ratio of each file's families: its own logical over its own stored bytes."""
    e = s.extents(spark, sf_dir)
    stored = e.select("ino", "family", "obj").distinct().join(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), "p_size"), "obj").groupBy("ino", "family").agg(F.sum("p_size").cast("long").alias("stored"))
    return e.groupBy("ino", "family").agg(F.sum("len").alias("logical")).join(stored, ["ino", "family"]).withColumn("ratio", F.col("logical") / F.col("stored"))


@query(f"""WITH {s.EXTENTS}, m AS (SELECT (SELECT count(*) FROM extents) AS extents, (SELECT CAST(sum(len) AS BIGINT) FROM extents) AS logical, (SELECT count(*) FROM part) AS objects, (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS stored,
(SELECT CAST(sum(p_size) AS BIGINT) FROM part WHERE p_partkey IN (SELECT obj FROM extents)) AS reachable, (SELECT count(*) FROM orders) AS inodes, (SELECT count(*) FROM events) AS mutations, (SELECT max(event_id) FROM events) AS last_seq)
SELECT *, stored - reachable AS reclaimable, logical / reachable AS ratio FROM m""")
def store_metrics(spark, sf_dir):
    e, part = s.extents(spark, sf_dir), s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), "p_size")
    live = e.select("obj").distinct().withColumn("live", F.lit(True))
    sizes = part.join(live, "obj", "left").agg(F.count("*").alias("objects"), F.sum("p_size").alias("stored"), F.sum(F.when(F.col("live"), F.col("p_size"))).alias("reachable"))
    one = e.agg(F.count("*").alias("extents"), F.sum("len").alias("logical"))
    log = s.table(spark, sf_dir, "events").agg(F.count("*").alias("mutations"), F.max("event_id").alias("last_seq"))
    row = one.crossJoin(sizes).crossJoin(s.inodes(spark, sf_dir).agg(F.count("*").alias("inodes"))).crossJoin(log)  # one row each
    return row.withColumn("reclaimable", F.col("stored") - F.col("reachable")).withColumn("ratio", F.col("logical") / F.col("reachable"))


@query(f"""WITH {s.EXTENTS}, f AS (SELECT (SELECT sum(len) FROM extents) > (SELECT sum(p_size) FROM part) AS a, (SELECT count(*) FROM extents WHERE len < 1) = 0 AS b, (SELECT max(p_size) FROM part) <= 49 AS c)
SELECT 'smaller-than-logical' AS rule, a AS met FROM f UNION ALL SELECT 'no-empty-extent', b FROM f UNION ALL SELECT 'objects-below-50', c FROM f""")
def admission_checklist(spark, sf_dir):
    e = s.extents(spark, sf_dir).agg(F.sum("len").alias("logical"), F.min("len").alias("least"))
    facts = e.crossJoin(s.table(spark, sf_dir, "part").agg(F.sum("p_size").alias("stored"), F.max("p_size").alias("largest")))  # one row each
    return accounting.admission(facts, [("smaller-than-logical", F.col("logical") > F.col("stored")), ("no-empty-extent", F.col("least") >= 1), ("objects-below-50", F.col("largest") <= 49)])


@query(f"""WITH RECURSIVE {s.EDGES}, w(node, target, d) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT node, dst, d + 1 FROM w JOIN edges ON src = target WHERE d < 6), m AS (SELECT node, max(d) AS d FROM w GROUP BY node)
SELECT node, CASE WHEN d > 4 THEN 'rebase' ELSE 'flatten' END AS action FROM m WHERE d >= 2""")
def chains_to_flatten(spark, sf_dir):
    """Chains of two or more references are to be flattened, those beyond the depth limit to be given another base."""
    depth = closure.chain_depth(s.edges(spark, sf_dir)).where("depth >= 2")
    return depth.select("node", F.when(F.col("accepted"), "flatten").otherwise("rebase").alias("action"))


@query("""SELECT l_suppkey AS segment, count(*) AS records, CAST(row_number() OVER (ORDER BY l_suppkey) AS INTEGER) AS place FROM lineitem GROUP BY l_suppkey""")
def segments_ascending(spark, sf_dir):
    counts = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("segment")).agg(F.count("*").alias("records"))
    return lookups.in_order(counts, ["segment"])


@query("""WITH c AS (SELECT l_orderkey AS chunk, CAST(l_linenumber AS BIGINT) AS ordinal, CAST(max(l_quantity) AS BIGINT) AS persisted, CAST(max(l_partkey) % 50 AS BIGINT) AS objective, max(l_discount) < 0.05 AS valid FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY objective, ordinal) AS r FROM c WHERE valid) SELECT chunk, ordinal, persisted, objective FROM r WHERE r = 1""")
def cheapest_by_objective(spark, sf_dir):
    """The first valid candidate by the objective; chunks without a valid one have none."""
    rows = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("long").alias("ordinal"))
    c = rows.agg(F.max("l_quantity").cast("long").alias("persisted"), (F.max("l_partkey") % 50).cast("long").alias("objective"), (F.max("l_discount") < 0.05).alias("valid"))
    return candidates.cheapest(c, ["chunk"], metric="objective").select("chunk", "ordinal", "persisted", "objective")


@query("""WITH c AS (SELECT l_orderkey AS chunk, CAST(l_linenumber AS BIGINT) AS ordinal, CAST(max(l_quantity) AS BIGINT) AS persisted, max(l_tax) < 0.04 AS valid FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY persisted, ordinal) AS r FROM c WHERE valid) SELECT chunk, ordinal, persisted FROM r WHERE r = 1""")
def cheapest_valid(spark, sf_dir):
    """The first candidate by persisted bytes that gives its chunk back, of all line items as candidates."""
    rows = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return candidates.cheapest(rows.agg(F.max("l_quantity").cast("long").alias("persisted"), (F.max("l_tax") < 0.04).alias("valid")), ["chunk"]).select("chunk", "ordinal", "persisted")


def _anchor_rounds(picks: int) -> str:
    """The greedy rounds, one after the other: k holds each round's anchors, h what each member has so far."""
    out = ""
    for k in range(1, picks + 1):
        had = f"LEFT JOIN h{k - 1} h ON h.grp = s.grp AND h.member = s.member" if k > 1 else ""
        got = "coalesce(had, 0)" if k > 1 else "0"
        out += f""", g{k} AS (SELECT s.grp, s.anchor, sum(greatest(saving - {got}, 0)) AS gain FROM s {had} GROUP BY 1, 2), k{k} AS (SELECT grp, anchor, gain FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gain DESC, anchor) AS r FROM g{k} WHERE gain > 0) WHERE r = 1),
h{k} AS (SELECT s.grp, member, max(saving) AS had FROM s WHERE (s.grp, s.anchor) IN ({" UNION ALL ".join(f"SELECT (grp, anchor) FROM k{j}" for j in range(1, k + 1))}) GROUP BY 1, 2)"""
    return out + " " + " UNION ALL ".join(f"SELECT grp, {k} AS pick, anchor, CAST(gain AS BIGINT) AS gain FROM k{k}" for k in range(1, picks + 1))


@query(f"""WITH m AS (SELECT l_partkey % 50 AS grp, l_suppkey AS anchor, l_orderkey % 40 AS member, CAST(sum(l_quantity) AS BIGINT) AS saving FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT grp, anchor, row_number() OVER (PARTITION BY grp ORDER BY sum(saving) DESC, anchor) AS r FROM m GROUP BY 1, 2), s AS (SELECT m.* FROM m JOIN t ON t.grp = m.grp AND t.anchor = m.anchor WHERE r <= 12){_anchor_rounds(4)}""")
def four_anchors(spark, sf_dir):
    """Up to four anchors of twelve rivals a group; members are saved from several anchors, so that rounds depend on those before."""
    rows = s.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("grp"), F.col("l_suppkey").alias("anchor"), (F.col("l_orderkey") % 40).alias("member"))
    return candidates.choose_anchors(rows.agg(F.sum("l_quantity").cast("long").alias("saving")), "grp")


@query(f"""WITH {s.EXTENTS}, x AS (SELECT ino, start, len * 100 AS n, len, ['raw', 'base_residual', 'sparse', 'sequence_dict'][start // 40 % 4 + 1] AS family FROM extents),
y AS (SELECT *, CASE family WHEN 'raw' THEN n WHEN 'base_residual' THEN 2 * n WHEN 'sparse' THEN n // 8 + 4 ELSE 5 * n + 64 END AS rd, CASE family WHEN 'raw' THEN n WHEN 'base_residual' THEN 3 * n WHEN 'sparse' THEN n // 8 + 8 ELSE 10 * n END AS wr,
CASE family WHEN 'sparse' THEN 0 WHEN 'sequence_dict' THEN 3 ELSE 1 END AS io, CASE WHEN family IN ('base_residual', 'sequence_dict') THEN 1 ELSE 0 END AS depth FROM x),
p(mode, r, w, i, d) AS (VALUES ('capacity', 2, 2, 256, 512), ('balanced', 8, 8, 512, 1024), ('latency', 64, 16, 4096, 8192), ('archive', 1, 1, 64, 256), ('ram', 32, 32, 2048, 4096))
SELECT ino, mode, CAST(sum(len + r * rd // 1024 + w * wr // 1024 + i * io + d * depth) AS BIGINT) AS objective FROM y, p GROUP BY 1, 2""")
def file_objectives(spark, sf_dir):
    """What each file's extents cost under each policy."""
    n, family = F.col("len") * 100, F.element_at(F.array(*map(F.lit, ("raw", "base_residual", "sparse", "sequence_dict"))), (F.col("start") / 40 % 4 + 1).cast("int"))
    cycles = {"read": values.read_cycles, "write": values.write_cycles, "io": lambda f, _: values.dependent_reads(f), "depth": lambda f, _: values.reference_depth(f)}
    rows = s.extents(spark, sf_dir).select("ino", "len", n.alias("n"), family.alias("family")).select("ino", "len", *(c(F.col("family"), F.col("n")).alias(k) for k, c in cycles.items()))
    costs = (values.total_cost(F.col("len"), *map(F.col, cycles), weights=[F.lit(v).cast("long") for v in w]) for w in values.POLICIES.values())
    each = rows.groupBy("ino").agg(*(F.sum(c).cast("long").alias(m) for m, c in zip(values.POLICIES, costs, strict=True)))  # a row a file
    return each.select("ino", F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("objective")) for m in values.POLICIES))).alias("p")).select("ino", "p.*")


@query("""WITH x AS (SELECT page_id, url, greatest(length(url), 1) AS n, length(regexp_replace(url, '[^A-Za-z]', '', 'g')) AS a, length(regexp_replace(url, '[^0-9]', '', 'g')) AS d FROM pages)
SELECT page_id, CASE WHEN a / n > 0.7 THEN 0 WHEN d / n > 0.3 THEN 1 WHEN a / n > 0.3 THEN 2 ELSE 3 END AS mix FROM x""")
def name_mixes(spark, sf_dir):
    return s.table(spark, sf_dir, "pages").select("page_id", values.name_class(F.col("url"))["mix"].alias("mix"))


@query(f"""WITH RECURSIVE {s.EXTENTS}, {s.INODES}, {s.EDGES}, i AS (SELECT *, ['file', 'directory', 'symlink'][ino % 3 + 1] AS data_kind FROM inodes), ix AS (SELECT l_orderkey AS ino, CAST((l_linenumber - 1) * 40 AS BIGINT) AS start, min(l_partkey) AS cid FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
w(node, spot, d) AS (SELECT src, dst, 1 FROM edges UNION ALL SELECT node, dst, d + 1 FROM w JOIN edges ON src = spot WHERE d < 6),
d AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '..' ELSE c_name END AS name, c_custkey * 3 AS ino, CASE WHEN c_custkey % 4 = 0 THEN 'directory' ELSE 'file' END AS kind FROM customer),
f AS (SELECT 'root-slot' AS category, 'warning' AS severity FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'snapshot-root', 'error' FROM supplier WHERE s_suppkey * 37 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'directory-entry', 'error' FROM d LEFT JOIN i ON i.ino = d.ino WHERE name = '..' OR i.ino IS NULL OR data_kind <> kind
UNION ALL SELECT 'inode', 'error' FROM i WHERE nlink = 0 OR (data_kind = 'directory' AND nlink < 2) OR (data_kind = 'symlink' AND ino % 2 = 1)
UNION ALL SELECT 'chunk-index', 'error' FROM extents e LEFT JOIN ix ON e.ino = ix.ino AND e.start = ix.start WHERE cid IS NULL OR cid <> e.obj
UNION ALL SELECT 'reference-depth', 'error' FROM (SELECT node FROM w GROUP BY node HAVING max(d) > 4)) SELECT category, severity, count(*) AS findings FROM f GROUP BY 1, 2""")
def fsck_metadata(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("file"), F.lit("directory"), F.lit("symlink")), (F.col("ino") % 3 + 1).cast("int"))
    inodes = s.inodes(spark, sf_dir).withColumn("data_kind", kind).withColumn("kind", kind).withColumn("symlink_target", F.repeat(F.lit("x"), (F.col("size") - F.col("ino") % 2).cast("int")))
    orders, supplier, customer, part = (s.table(spark, sf_dir, t) for t in ("orders", "supplier", "customer", "part"))
    entries = customer.select(F.col("c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 9 == 0, "..").otherwise(F.col("c_name")).alias("name"), (F.col("c_custkey") * 3).alias("ino"), F.when(F.col("c_custkey") % 4 == 0, "directory").otherwise("file").alias("kind"))
    index = s.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("ino"), ((F.col("l_linenumber") - 1) * 40).cast("long").alias("start")).agg(F.min("l_partkey").alias("cid"))
    found = integrity.check_metadata(
        roots=orders.select(F.col("o_orderkey").alias("generation"), (F.col("o_orderstatus") == "F").alias("valid")),
        snapshots=supplier.select(F.col("s_name").alias("name"), (F.col("s_suppkey") * 37).alias("root")),
        nodes=part.select(F.col("p_partkey").alias("node")),
        entries=entries,
        inodes=inodes,
        extents=s.extents(spark, sf_dir).select("ino", "start", F.col("obj").alias("cid")),
        index=index,
        references=s.edges(spark, sf_dir),
    )
    return integrity.report([found])
