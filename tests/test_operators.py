from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import accounting, candidates, chunks, closure, folds, integrity, lookups, namespace, statistics
from weft.plans.catalog import QUERIES
from weft.sources import results
from weft.sources.shared import fresh_dir
from weft.sources.store import BlobTable, VersionedTable
from weft.streaming import log as streams


def test_chunks_tile_the_blob(spark):
    data = bytes(range(256)) * 41
    got = chunks.chunk(spark.createDataFrame([(1, data), (2, b""), (3, None)], "id long, bytes binary"), 4096).orderBy("idx").collect()
    assert b"".join(r["bytes"] for r in got) == data and [r["len"] for r in got] == [4096, 4096, 2304]


def test_pack_places_follow_each_other(spark):
    rows = [(f"n{i:03d}", bytes(i)) for i in range(200)]
    got = chunks.pack(spark.createDataFrame(rows, "name string, data binary"), "name", "data").orderBy("name").collect()
    place = 0
    for r in got:
        assert r["place"] == place
        place += r["size"]


def test_as_of_and_windows_match_brute_force(spark):
    rng = random.Random(5)
    ext = [(k, s, s + rng.randint(1, 40)) for k in range(3) for s in rng.sample(range(400), 25)]
    pts = [(k, p) for k in range(4) for p in rng.sample(range(450), 30)]
    e = spark.createDataFrame(ext, "ino int, start long, end long")
    p = spark.createDataFrame(pts, "ino int, pos long")
    back = {(r["ino"], r["pos"]): r["found"] and r["found"]["start"] for r in lookups.as_of(p, e, width=50).collect()}
    assert back == {(k, x): max((s for i, s, _ in ext if i == k and s <= x), default=None) for k, x in pts}
    fore = {(r["ino"], r["pos"]): r["found"] and r["found"]["start"] for r in lookups.as_of(p, e, forward=True, width=50).collect()}
    assert fore == {(k, x): min((s for i, s, _ in ext if i == k and s >= x), default=None) for k, x in pts}
    w = [(k, a, a + rng.randint(0, 200)) for k in range(3) for a in rng.sample(range(400), 20)]
    met = lookups.overlapping(spark.createDataFrame(w, "ino int, off long, stop long"), e, 64).collect()
    assert sorted((r["ino"], r["off"], r["stop"], r["start"]) for r in met) == sorted((k, a, b, s) for k, a, b in w for i, s, t in ext if i == k and s < b and t > a and a < b)


def test_read_ranges_fill_holes_and_clip(spark):
    e = spark.createDataFrame([(1, 2, 5, b"abc"), (1, 8, 10, b"xy")], "ino int, start long, end long, bytes binary")
    r = spark.createDataFrame([("a", 1, 0, 100, 9), ("b", 1, 3, 4, 9), ("c", 1, 20, 30, 9), ("d", 2, 0, 3, 3)], "req string, ino int, off long, stop long, size long")
    got = {x["req"]: bytes(x["bytes"]) for x in lookups.read_ranges(r, e, 4).collect()}
    assert got == {"a": b"\0\0abc\0\0\0x", "b": b"b", "c": b"", "d": b"\0\0\0"}


def test_overlay_and_page(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 5, False), (2, "y", 7, False), (3, "", 6, True), (4, "z", 8, False)], "k long, v string, seq long, deleted boolean")
    assert sorted(map(tuple, lookups.overlay(base, new, ["k"]).collect())) == [(1, "a"), (2, "y"), (4, "z")]
    first = lookups.page(base, "k", None, 2).collect()
    assert [r["k"] for r in first] == [1, 2] and all(r["has_more"] for r in first)
    assert [(r["k"], r["has_more"]) for r in lookups.page(base, "k", 2, 2).collect()] == [(3, False)]


def test_percentile_rules(spark):
    df = spark.createDataFrame([("g", x) for x in range(1, 11)], "g string, x long")
    s = statistics.summary(df, ["g"], "x").first()
    assert (s["n"], s["p50"], s["p95"], s["p99"]) == (10, 5, 10, 10)
    assert statistics.rounded_percentiles(df, ["g"], "x").first()["q50"] == 6
    assert statistics.upper_median(df, ["g"], "x").first()["median"] == 6


def test_chain_depth_accepts_four(spark):
    line = [(i, i + 1) for i in range(5)] + [(10, 11), (11, 10), (20, 21), (20, 22), (21, 23), (22, 23), (23, 24)]
    got = {r["node"]: (r["depth"], r["accepted"]) for r in closure.chain_depth(spark.createDataFrame(line, "src long, dst long")).collect()}
    assert got[1] == (4, True) and got[0] == (5, False) and got[10] == (5, False) and got[20] == (3, True) and got[24] == (0, True)


def test_reachable_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "src long, dst long")
    got = closure.reachable(spark.createDataFrame([(1,)], "node long"), e).collect()
    assert sorted((r["node"], r["depth"]) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_paths(spark):
    d = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "parent long, name string, ino long")
    got = {r["path"]: r["ino"] for r in closure.resolve_paths(spark.createDataFrame([("/a/b",), ("a//./b/",), ("a/x",), ("",), ("a/..",)], "path string"), d, 1).collect()}
    assert got == {"/a/b": 3, "a//./b/": 3, "a/x": None, "": 1, "a/..": None}


def test_tracker_matches_its_description():
    t = folds.Tracker()
    calm = [t.step(0.5) for _ in range(10)]
    assert calm == ["unknown"] + ["stable"] * 9
    jump = [t.step(1.0) for _ in range(9)]
    assert jump[:8] == ["slew"] * 8
    t = folds.Tracker()
    assert "drift" in [t.step(i * 0.02) for i in range(30)] and folds.Debt(most=3).step(True, 2) == "defer"


def test_fold_carries_state_over_batches(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.random()) for k in range(5) for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {(r["k"], r["i"]): r["regime"] for r in folds.track_regimes(spark.createDataFrame(rows, "k int, i int, m double"), "k", ["i"], "m").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in range(5):
        t = folds.Tracker()
        assert [got[k, i] for i in range(500)] == [t.step(m) for kk, _, m in rows if kk == k]


def test_hysteresis_and_time(spark):
    rows = [(1, t, p) for t, p in enumerate([0, 8, 5, 5, 2, 5, 9])]
    h = folds.hysteresis(spark.createDataFrame(rows, "k int, t long, p int"), "k", ["t"], "p", 8, 2)
    assert [r["pressured"] for r in h.orderBy("t").collect()] == [False, True, True, True, False, False, True]
    assert tuple(folds.pressured_time(h, "k", ["t"], "t").first())[1:] == (3, 2, 1)


def test_replay_in_one_go_and_in_pieces(spark):
    rng = random.Random(8)
    ops = ["create", "write", "setattr", "link", "unlink"]
    rows = [(i, rng.choice(ops), rng.randint(1, 6), rng.randint(0, 99)) for i in range(300)]
    log = spark.createDataFrame(rows, "seq long, op string, ino long, size long")
    sizes, links = {}, {}
    for _, op, ino, size in rows:
        if op == "create":
            sizes[ino] = 0
        elif op == "setattr":
            sizes[ino] = size
        elif op == "write":
            sizes[ino] = max(sizes.get(ino, 0), size)
        links[ino] = links.get(ino, 0) + {"create": 1, "link": 1, "unlink": -1}.get(op, 0)
    none = spark.createDataFrame([], "ino long, size long, nlink long")
    got = {r["ino"]: (r["size"], r["nlink"]) for r in namespace.replay(none, log).collect()}
    assert got == {k: (sizes.get(k, 0), n) for k, n in links.items() if n > 0}
    with pytest.raises(Exception, match="repeated sequence"):
        namespace.strict(log.union(log.limit(1))).collect()


def test_names_after_rename(spark):
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 3)], "parent long, name string, ino long")
    log = spark.createDataFrame([(1, "rename", 2, 1, "a", 1, "b"), (2, "create", 4, 1, "a", None, None), (3, "unlink", 4, 1, "a", None, None)], "seq long, op string, ino long, parent long, name string, dst_parent long, dst_name string")
    assert [tuple(r) for r in namespace.replay_names(d, log).collect()] == [(1, "b", 2)]


def test_truncate_punch_copy(spark):
    e = spark.createDataFrame([(1, 0, 10), (1, 20, 10)], "ino long, start long, len long")
    assert sorted(map(tuple, namespace.truncate(e, spark.createDataFrame([(1, 25)], "ino long, size long")).collect())) == [(1, 0, 10), (1, 20, 5)]
    assert sorted(map(tuple, namespace.punch(e, spark.createDataFrame([(1, 5, 22)], "ino long, off long, stop long")).collect())) == [(1, 0, 5), (1, 22, 8)]
    c = spark.createDataFrame([(1, 5, 25, 7, 100)], "src long, off long, stop long, dst long, to long")
    assert sorted(map(tuple, namespace.copy_range(e, c).collect())) == [(7, 100, 5), (7, 115, 5)]


def test_allocate_numbers(spark):
    names = spark.createDataFrame([(f"f{i:02d}",) for i in range(30)], "name string")
    got = namespace.allocate(spark.createDataFrame([(41,)], "ino long"), names, "name").orderBy("name").collect()
    assert [r["ino"] for r in got] == list(range(42, 72))
    assert namespace.has_room(90, 2, 100) and not namespace.has_room(90, 3, 100)


def test_cheapest_and_swap(spark):
    rows = spark.createDataFrame([(1, 1, 9, True), (1, 2, 5, False), (1, 3, 7, True), (1, 4, 7, True)], "c int, ordinal int, persisted long, valid boolean")
    assert candidates.cheapest(rows, ["c"]).first()["ordinal"] == 3
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, descriptor string")
    s = spark.createDataFrame([(1, "a", "A"), (2, "x", "B")], "k int, old_descriptor string, descriptor string")
    assert sorted(r["descriptor"] for r in candidates.compare_and_swap(t, s, ["k"]).collect()) == ["A", "b"]


def test_anchors_cover(spark):
    rows = [("g", 1, m, 5) for m in range(4)] + [("g", 2, m, 9) for m in range(2, 5)] + [("g", 3, 0, 6)]
    got = candidates.choose_anchors(spark.createDataFrame(rows, "grp string, anchor long, member long, saving long"), "grp", picks=3).orderBy("pick").collect()
    assert [(r["anchor"], r["gain"]) for r in got] == [(2, 27), (1, 10), (3, 1)]


def test_base_residual_wins_on_small_edits(spark):
    base = bytes(range(256)) * 16
    edited = bytearray(base)
    edited[7] ^= 1
    df = spark.createDataFrame([("x", bytes(edited[:-1]) + b"!", base)], "cid string, bytes binary, base binary")
    best = candidates.cheapest(candidates.with_costs(candidates.candidates(df)), ["cid"]).first()
    assert best["family"] == "base_residual" and best["valid"]


def test_findings(spark):
    inodes = spark.createDataFrame([(1, 50, 1), (2, 9, 2)], "ino long, size long, nlink long")
    dirents = spark.createDataFrame([(1,), (2,), (5,)], "ino long")
    ext = spark.createDataFrame([(1, 0, 10, "a"), (1, 5, 10, "b"), (2, 8, 3, "z")], "ino long, start long, len long, obj string")
    got = {r["category"]: r["findings"] for r in integrity.report([integrity.check_store(inodes, dirents, ext, spark.createDataFrame([("a",), ("b",), ("c",)], "obj string"), spark.createDataFrame([(1,), (1,)], "seq long"))]).collect()}
    assert got == {"extent-overlap": 1, "extent-past-end": 1, "missing-object": 1, "missing-inode": 1, "link-count": 1, "repeated-sequence": 1, "unreachable": 1}


def test_blob_table(spark):
    t = BlobTable(spark, fresh_dir(spark, "blobs"))
    ids = [r["blob_id"] for r in t.put(spark.createDataFrame([(b"abc",), (b"abc",), (b"",)], "bytes binary")).collect()]
    t.put(spark.createDataFrame([(b"abc",), (b"new",)], "bytes binary"))
    assert ids[0] == ids[1] and t.table.read().count() == 3
    want = spark.createDataFrame([(ids[0],)], "blob_id string")
    assert bytes(t.get(want).first()["bytes"]) == b"abc" and t.contains(want.union(spark.createDataFrame([("no",)], "blob_id string"))).where("found").count() == 1
    assert bytes(t.ranges(want.withColumn("off", F.lit(1)).withColumn("len", F.lit(9))).first()["bytes"]) == b"bc"


def test_snapshots_and_stream_replay(spark):
    at = fresh_dir(spark, "inodes")
    table = VersionedTable(spark, f"{at}/t", "ino long, size long, nlink long")
    rows = [(i, ("create", "write", "link", "unlink")[i % 4], i % 3, i) for i in range(40)]
    log = spark.createDataFrame(rows, "seq long, op string, ino long, size long")
    for k in range(4):
        log.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{at}/log")
        q = streams.apply_log(spark.readStream.schema(log.schema).parquet(f"{at}/log"), table, f"{at}/cp")
        q.awaitTermination()
        if k == 1:
            table.snapshot("half")
            table.publish(table.read(), applied=table.versions() and 19)
    none = spark.createDataFrame([], "ino long, size long, nlink long")
    want = sorted(tuple(r)[:3] for r in namespace.replay(none, log).collect())
    assert sorted(map(tuple, table.read().select("ino", "size", "nlink").collect())) == want
    assert [n for n, _ in table.snapshots()] == ["half"]
    table.restore("half")
    assert table.read().count() == namespace.replay(none, log.where("seq < 20")).count()


def test_stream_regimes_over_batches(spark):
    at = fresh_dir(spark, "regimes")
    rng = random.Random(4)
    rows = [(k, i, rng.random()) for i in range(60) for k in range(3)]
    df = spark.createDataFrame(rows, "k long, i long, m double")
    got = []
    for part in range(3):
        df.where(f"i div 20 = {part}").coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = streams.regimes(spark.readStream.schema(df.schema).parquet(f"{at}/in"), "k", "i", "m")
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["k"], r["i"]): r["regime"] for r in spark.read.parquet(f"{at}/out").collect()}
    for k in range(3):
        t = folds.Tracker()
        assert [got[k, i] for i in range(60)] == [t.step(m) for kk, _, m in rows if kk == k]


def test_lock_conflicts_of_all_line_items_match_brute_force(spark, tmp_path):
    rng = random.Random(15)
    rows = [(order, line, rng.randint(1, 6), rng.randint(1, 8)) for order in range(60) for line in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    locks = [(supp, order * 8 + line, order, part % 1000 * 10, line % 3 == 0) for order, line, supp, part in rows]
    want = {(a[0], a[1], b[1]) for a in locks for b in locks if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and abs(a[3] - b[3]) <= 5 and (a[4] or b[4])}
    got = [tuple(r) for r in QUERIES["lock_conflicts_all"](spark, str(tmp_path)).select("ino", "a_id", "b_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(got) > 5 * QUERIES["lock_conflicts"](spark, str(tmp_path)).count()


def test_deep_paths_and_closures(spark):
    deep = 70
    d = spark.createDataFrame([(k, f"d{k}", k + 1) for k in range(1, deep + 1)], "parent long, name string, ino long")
    whole = "/".join(f"d{k}" for k in range(1, deep + 1))
    got = {r["path"]: r["ino"] for r in closure.resolve_paths(spark.createDataFrame([(whole,), (whole.replace("d69", "x"),), ("d1",)], "path string"), d, 1).collect()}
    assert got == {whole: deep + 1, whole.replace("d69", "x"): None, "d1": 2}
    chain = spark.createDataFrame([(k, k + 1) for k in range(19)] + [(19, 0)], "src long, dst long")
    assert {r["node"]: r["depth"] for r in closure.reachable(spark.createDataFrame([(0,)], "node long"), chain).collect()} == {k: k for k in range(20)}


def test_versions_point_to_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    t = VersionedTable(spark, f"{at}/t", "a long")
    t.publish(spark.range(3).withColumnRenamed("id", "a"), applied=9)
    files = lambda: len(list((tmp_path / "t" / "data").iterdir()))
    t.snapshot("one")
    assert files() == 1 and t.meta()["applied"] == 9
    t.append(spark.range(10, 12).withColumnRenamed("id", "a"), applied=12)
    assert files() == 2 and t.read().count() == 5 and t.read(snapshot="one").count() == 3
    t.restore("one")
    assert files() == 2 and t.read().count() == 3 and t.meta()["applied"] == 12
    assert [n for n, _ in t.snapshots()] == ["one"]
    t.delete_snapshot("one")
    with pytest.raises(KeyError):
        t.read(snapshot="one")
    assert t.snapshots() == [] and t.read().count() == 3
    t.snapshot("one")
    assert [n for n, _ in t.snapshots()] == ["one"] and t.read(snapshot="one").count() == 3
    b = BlobTable(spark, f"{at}/b")
    blob = lambda *xs: spark.createDataFrame([(bytearray(x),) for x in xs], "bytes binary")
    b.put(blob(b"x", b"y"))
    b.put(blob(b"y", b"z"))
    new = spark.read.parquet(b.table.meta()["data"][-1])
    assert [bytes(r["bytes"]) for r in new.collect()] == [b"z"] and b.table.read().count() == 3


@pytest.mark.parametrize("form", ["csv", "json"])
def test_results_round_trip(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, 'a,"b"', 0.5, True), (2, None, None, None), (3, "", -1.0, False)], "n long, t string, x double, b boolean")
    schema = results.write_results(rows, str(tmp_path / "r"), form)
    assert sorted(map(tuple, results.read_results(spark, str(tmp_path / "r"), schema, form).collect())) == sorted(map(tuple, rows.collect()))


def test_classes_and_gates(spark):
    row = spark.range(1).select(*(accounting.class_key(m, [F.lit("txt"), F.lit(1)], [F.lit(3)], F.lit("new")).alias(m) for m in ("none", "extension", "byte_sketch", "history", "combined")), accounting.high_entropy(F.lit(255), F.lit(8.0)).alias("small"), accounting.high_entropy(F.lit(256), F.lit(7.2)).alias("large")).first()
    assert row["none"] is None and len({row[m] for m in ("extension", "byte_sketch", "history", "combined")}) == 4 and not row["small"] and row["large"]


def test_winner_rank_ties_of_floating_sums(spark, tmp_path):
    """0.1 + 0.2 and 0.3 are alike, so the smaller ordinal comes first; NaN leads, and channels without a value come last."""
    rows = [(1, 1, "b", 0.3), (2, 1, "a", 0.1), (3, 1, "a", 0.2), (4, 2, "a", float("nan")), (5, 2, "b", 9.0), (6, 3, "b", None), (7, 3, "a", -2.0), (8, 3, "b", None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["winner_rank"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, "a", 2), (2, "b", 2), (3, "b", 2)]


def test_dealt_rows_stay_few_in_a_task(spark, monkeypatch):
    """More rows make more partitions, and rows of a key stay together."""
    from weft.plans import stand_ins

    monkeypatch.setattr(stand_ins, "ROWS", 500)
    for n in (0, 400, 9000):
        parts = stand_ins.dealt(spark.range(n).selectExpr("id div 3 as k"), "k").withColumn("p", F.spark_partition_id())
        assert parts.groupBy("k").agg(F.countDistinct("p").alias("d")).where("d > 1").count() == 0
        assert parts.select("p").distinct().count() == -(-n // 500)


def test_proposals_come_a_few_at_a_time():
    """A batch of 300 chunks is given out in pieces, each proposal beside its chunk, and none is lost."""
    import pyarrow as pa

    data = [bytes([i % 251, i % 7]) * 2048 for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(data), pa.array([None] * 300, pa.binary())], names=["id", "bytes", "base"])
    whole = list(candidates._proposed(iter([batch])))
    small = max(b.nbytes for b in whole)
    assert len(whole) == 1 or small < 4 * candidates.BLOCK
    rows = [r for b in whole for r in b.to_pylist()]
    assert all(r["valid"] and r["bytes"] == data[r["id"]] for r in rows) and {r["id"] for r in rows if r["family"] == "raw"} == set(range(300))
    size, candidates.BLOCK = candidates.BLOCK, 1 << 16
    try:
        parts = list(candidates._proposed(iter([batch])))
    finally:
        candidates.BLOCK = size
    assert len(parts) > 10 and [r for b in parts for r in b.to_pylist()] == rows
