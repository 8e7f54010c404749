"""Operators 1, 2, 3 and 10: exact search, archives, packing, token files."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import random
import zlib

import duckdb
import numpy as np
import pytest

from weft.llm import files
from weft.llm.base import fresh_dir
from weft.llm.packing import best_fit, pack, pack_documents
from weft.llm.queries import ORACLES, QUERIES, tokenizer
from weft.llm.token_files import TokenFileReader, TokenFileWriter, pack_bits, read_token_files, unpack_bits, write_token_files
from weft.llm.tokens import PieceEncoder
from weft.llm.topk_search import CoverTree, DualSearch, top_k
from weft.llm.warc import gzip_member, read_records, read_warc, record_bytes, write_warc

ODD = ["", " ", "  ", "a  b", "a \n b", "\n a", " a", "a ", "it's don't I'LL", "x<|endoftext|> y", "é éx", "　c", "1234 ²³", "a\x1c b", "日本語 テスト。", "👍🏽 ok", "x" * 700 + " y", "İ| x", "ab́. ç, ﬁx."]


def brute_top(rows, k, is_query):
    q = {}
    known = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known.append((i, np.floor(64 * np.array(v, float)).astype(object)))
    for i, v in known:
        if is_query(i):
            best = sorted({(-int((v * w).sum()), j) for j, w in known if j != i and len(w) == len(v)})[:k]
            q[i] = [(j, -s) for s, j in best]
    return q


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.1).round(3).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # a hot vector with many ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, rows[3][1]), (2005, [1.0, 2.0]), (2010, [2.0, 1.0]), (2020, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in top_k(df, "vec_id % 10 = 0", k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_top(rows, 7, lambda i: i % 10 == 0)
    assert {q: [v for _, v in sorted(x.items())] for q, x in got.items()} == {q: v for q, v in want.items() if v}
    assert top_k(df.where("false"), "vec_id % 10 = 0").count() == 0


def test_repeated_rows_of_equal_vectors_take_no_places(spark):
    rows = [(5, [1.0, 2.0])] * 21 + [(i, [1.0, 2.0]) for i in range(10, 20)] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in top_k(df, "vec_id % 10 = 0 or vec_id = 5", k=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [v for _, v in sorted(x.items())] for q, x in got.items()} == {5: list(range(10, 17)), 10: [5, *range(11, 17)]}


def test_dual_search_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-5, 5, (200, 3)) + c for c in rng.integers(-900, 900, (12, 3))])
    tree = CoverTree(points, list(range(len(points))))
    assert sorted(tree.keys) == list(range(len(points)))
    for i in range(len(tree.start)):
        own = tree.points[tree.start[i] : tree.end[i]]
        assert np.sqrt(((own - tree.center[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
    q = CoverTree(points[::7], list(range(0, len(points), 7)))
    search = DualSearch(q, tree, np.full(len(q.points), np.iinfo(np.int64).min), 5)
    i, _, s = search.found()
    for k in range(len(q.points)):
        assert sorted(s[i == k])[-5:] == sorted((points @ q.points[k]).tolist())[-5:]
    assert sum(len(h[0]) for h in search.hits) < len(points) * len(q.points) // 3


def test_top_k_with_large_components(spark):
    rows = [(i, [float((-1) ** i * 2**28 + i), float(2**24 * i)]) for i in range(30)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 10 = 0", k=3, scale=1.0).collect()}
    for q in (0, 10, 20):
        v = {i: [int(x) for x in e] for i, e in rows}
        best = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in v if j != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(j, -s) for s, j in best]


def test_op1_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf_dir}/embeddings.parquet'")
    got = QUERIES["op1_exact_topk"](spark, sf_dir).toPandas()
    want = con.sql(ORACLES["op1_exact_topk"]).df()
    key = ["query_id", "rank"]
    assert got.sort_values(key)[list(want.columns)].to_numpy().tolist() == want.sort_values(key).to_numpy().tolist()


PAGES = [(1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "", ""), (5, "http://a\nb", "é<b>"), (2, "u", "x"), (2, "u", "y"), (None, "n", "x"), (None, "n", "x"), (7, "q", "y"), (9, "long", "<p>" * 300_000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload_bytes int")
    to = fresh_dir(spark, "warc")
    write_warc(df, to, file_bytes=500)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in read_warc(spark, to).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(-1, "x", "response", 0), (-1, "x", "revisit", 0), (1, "x", "revisit", 2), (2, "x", "response", 0), (2, "x", "revisit", 2), (2, "y", "revisit", 7), (3, "", "revisit", 4), (4, "", "response", 0), (5, "é<b>", "response", 0), (7, "y", "response", 0), (9, "<p>" * 300_000, "response", 0)]
    assert got == sorted((p, len(t.encode()), sha(t), k, r) for p, t, k, r in want)


def test_warc_files_do_not_depend_on_the_order_of_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    names = []
    for x in (df, df.orderBy("html").repartition(3)):
        to = fresh_dir(spark, "warc")
        names.append({m["file"]: files.reader(files.join(to, m["file"])).read() for m in write_warc(x, to)})
    assert names[0] == names[1]
    to = fresh_dir(spark, "warc")
    assert write_warc(df.limit(0), to) == [] and read_warc(spark, to).count() == 0


def test_warc_small_payloads_can_all_be_responses(spark):
    to = fresh_dir(spark, "warc")
    write_warc(spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")], "page_id long, url string, html string"), to, least_payload=3)
    assert {r["page_id"]: r["record_type"] for r in read_warc(spark, to).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_reader_finds_damage():
    good = record_bytes("response", "urn:page:1:X", "u", "2024-01-01T00:00:00Z", "D", 2, b"hi", None)
    (headers, block), = read_records(io.BytesIO(gzip_member(good)))
    assert headers["WARC-Type"] == "response" and block.endswith(b"hi")
    assert len(list(read_records(io.BytesIO(gzip_member(good) * 50)))) == 50


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 90, 300).astype(float)
    items = np.stack([n, np.ones(300), n * n], axis=1)
    for choose in ("norm", "dot"):
        for weights in ((1.0, 0.0, 0.0), (1.0, 0.5, 0.5)):
            bins = best_fit(items, np.array([100.0, 4, 6000]), np.array(weights), choose)
            used = np.stack([np.bincount(bins, items[:, d]) for d in range(3)], axis=1)
            alone = np.bincount(bins) == 1
            assert ((used <= [100, 4, 6000]).all(axis=1) | alone).all()
    assert len(set(best_fit(np.array([[60.0], [40], [70], [30]]), np.array([100.0]), np.ones(1), "norm").tolist())) == 2


def check_packing(rows, max_tokens):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_tokens
    return len(by)


def test_pack_documents(spark):
    rng = random.Random(2)
    texts = [None, "", *ODD, "word " * 5000, *[" ".join(rng.choices(["the", "fish", "Über", "x1,"], k=rng.randint(1, 900))) for _ in range(150)]]
    df = spark.createDataFrame([(i % 160 if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, piece string")
    path = tokenizer("word_bpe_49k.json")
    rows = pack_documents(df, path).collect()
    tok = PieceEncoder(path).tokenizer
    want = []
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i % 160 if i else -1, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    n = check_packing(rows, 2048)
    assert n <= 1.06 * sum(w[3] for w in want) / 2048 + 1
    assert pack_documents(df.where("false"), path).count() == 0


def test_pack_in_rounds_wastes_little(spark):
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(1, 700), 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df, 2048).collect()
    assert len(got) == 6000 and check_packing(got, 2048) <= -(-sum(r[3] for r in rows) // 2048) * 1.005 + 1
    few = pack(df, 2048, max_docs=3, max_attention=600_000).collect()
    load: dict = {}
    for r in few:
        a = load.setdefault(r["sequence_id"], [0, 0, 0])
        a[0] += r["length"]
        a[1] += 1
        a[2] += r["length"] ** 2
    assert all(t <= 2048 and n <= 3 and c <= 600_000 for t, n, c in load.values())


@pytest.mark.parametrize("most, over", [(2048, 1.01), (32, 1.06)])
def test_rows_without_ids_of_their_own_are_packed_like_others(spark, most, over):
    """Null ids, one repeated id and repeated rows: every capacity holds, and no group takes them all."""
    rng = random.Random(8)
    rows = [(None, 0, 0, rng.randint(1, 300), 0) for _ in range(10_000)] + [(7, 0, 0, 5, 1)] * 4000 + [(i, 0, 0, rng.randint(1, 900), 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack(df, 2048, max_docs=most).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in got) == sorted((r[0] or -1, r[3]) for r in rows)
    load: dict = {}
    for r in got:
        load.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in load.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048 and len(places) <= most
    assert len(load) <= over * -(-sum(r[3] for r in rows) // 2048) + 1


def test_best_fit_weighs_every_capacity():
    """The last item: bin 0 leaves the fewest tokens (10 for 21), bin 1 the fewest documents (none for one)."""
    items, caps = np.array([[80, 1, 6400], [35, 1, 1225], [34, 1, 1156], [10, 1, 100]], float), np.array([100, 3, 10_000], float)
    by_tokens = best_fit(items, caps, np.array([1.0, 0, 0]), "norm")
    by_docs = best_fit(items, caps, np.array([0.01, 1, 0]), "norm")
    assert by_tokens.tolist() == [0, 1, 1, 0] and by_docs.tolist() == [0, 1, 1, 1]
    for bins in (by_tokens, by_docs, best_fit(items, caps, np.array([1.0, 0.3, 0.3]), "dot")):
        assert all((items[bins == b].sum(axis=0) <= caps).all() for b in set(bins.tolist()))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(1)
    parts = [" ", "  ", "a", "B", "é", "\n", "'s", ".", "'", "1", "²", "́", "中", "İ", "-", "_", "<|endoftext|>", "Word", "ß"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 16))) for _ in range(3000)]
    e = PieceEncoder(tokenizer(name))
    assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 20, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    data = pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (unpack_bits(data, bits, 1001) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            pack_bits(np.append(ids, np.uint32(1 << bits)), bits)


def test_token_file_random_access(spark):
    uri = fresh_dir(spark, "one") + "/f"
    w = TokenFileWriter(uri, 17, block_ids=64)
    ids = np.random.default_rng(0).integers(0, 100_000, 1000).astype("<u4")
    for i, (a, b) in enumerate([(0, 3), (3, 3), (3, 500), (500, 1000)]):
        w.add(i if i else None, ids[a:b])
    w.close()
    r = TokenFileReader(uri)
    assert r.doc_ids == [None, 1, 2, 3] and r.starts.tolist() == [0, 3, 3, 500, 1000]
    for a, b in [(0, 1000), (63, 65), (64, 128), (999, 1000), (10, 10)]:
        assert (r.ids(a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark):
    texts = [None, *ODD, "y " * 3000]
    df = spark.createDataFrame([(1000 - 7 * i if i else None, t, 1) for i, t in enumerate(texts)] + [(5, "same", 1), (5, "same", 1)], "doc_id long, text string, start int")
    path, to = tokenizer("byte_bpe_50k.json"), fresh_dir(spark, "tokens")
    manifest = write_token_files(df, to, path, end_id=2, vocabulary=50_257)
    got = [tuple(r) for r in read_token_files(spark, to).orderBy("start").collect()]
    tok, at, want = PieceEncoder(path).tokenizer, 0, []
    for doc_id, text in sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert json.loads(files.read_text(files.join(to, "manifest.json")))["bits"] == 16 and sum(m["n_ids"] for m in manifest) == at
    empty = fresh_dir(spark, "tokens")
    write_token_files(df.where("false"), empty, path, 2, 50_257)
    assert read_token_files(spark, empty).count() == 0
