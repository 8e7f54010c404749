from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.functions import bytes as b
from weft.functions import values as v
from weft.operators.candidates import _multiset_rank, _multiset_unrank, propose, restore
from weft.sources.corpora import corpus, noise_range, splitmix64


def test_ranks_count_in_order():
    sets = sorted(combinations(range(7), 3), key=lambda c: c[::-1])
    assert [b.subset_rank(list(s)) for s in sets] == list(range(len(sets)))
    assert [tuple(b.subset_unrank(i, 3)) for i in range(len(sets))] == sets
    assert b.arrangements([2, 1, 3]) == math.factorial(6) // 12


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12))
@settings(max_examples=50, deadline=None)
def test_arrangements_round_trip(symbols):
    kinds = sorted(set(symbols))
    assert _multiset_unrank(_multiset_rank(symbols), kinds, [symbols.count(k) for k in kinds]) == bytes(symbols)


@given(st.one_of(st.binary(max_size=300), st.integers(0, 255).map(lambda x: bytes([x]) * 50), st.binary(min_size=2, max_size=9).map(lambda p: p * 20 + p[:1]), st.lists(st.sampled_from([0, 0, 0, 0, 0, 7]), max_size=200).map(bytes)), st.binary(max_size=300))
@settings(max_examples=150, deadline=None)
def test_every_proposal_gives_back_the_bytes(data, base):
    base = (base + bytes(len(data)))[: len(data)]
    found = propose(data, base)
    assert found[-1][0] == "raw"
    for family, _, _, payload in found:
        assert restore(family, len(data), payload, base) == data


def test_proposals_by_kind_of_data():
    kinds = lambda d: {c[0] for c in propose(d, None)}
    assert {"zero", "fill"} <= kinds(bytes(5000))
    assert "periodic" in kinds(b"abc" * 2000)
    assert "sparse" in kinds(bytes(4000) + b"x" + bytes(96))
    assert kinds(splitmix64(1, 0, 1000).tobytes()) == {"raw"}  # noise must stay raw


def test_crc32c_known_value():
    assert b.crc32c_of(b"123456789") == 0xE3069283


def test_byte_functions(spark):
    rows = [(b"",), (b"aaaa",), (bytes(range(256)),), (b"ab" * 600,), (None,)]
    df = spark.createDataFrame(rows, "d binary")
    got = df.select(b.byte_entropy("d").alias("e"), b.distinct_bytes("d").alias("n"), b.sampled_entropy(64)("d").alias("s"), b.crc32c("d").alias("c"), b.fnv1a_hex("d").alias("f"), F.size(b.byte_histogram("d")).alias("h")).collect()
    assert [r["e"] for r in got] == [0, 0, 8, 1, 0]
    assert [r["n"] for r in got] == [0, 1, 256, 2, 0]
    assert got[3]["s"] == 0  # a stride of the period's length sees one symbol
    assert got[0]["f"] == "cbf29ce484222325" and got[4]["c"] is None
    assert all(r["h"] == 256 for r in got)


def test_difference(spark):
    df = spark.createDataFrame([(b"aabbcc", b"aaxxcx"), (b"abc", b"ab"), (b"", b"")], "a binary, b binary")
    got = [tuple(r["d"]) for r in df.select(b.difference("a", "b").alias("d")).collect()]
    assert got[0][:2] == (3, 2) and got[0][2] == pytest.approx(sum(((Counter(b"aabbcc") - Counter(b"aaxxcx")) + (Counter(b"aaxxcx") - Counter(b"aabbcc"))).values()) / 12)
    assert got[1] == (None, None, 1.0) and got[2] == (0, 0, 0.0)


def test_names_and_features(spark):
    names = ["a", "", ".", "..", "x/y", "n\0", "é" * 127, "é" * 128, "blob-12-tmp-0f", "blob-12"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(v.valid_name(F.col("n")).alias("ok"), v.temporary_name(F.col("n")).alias("tmp"), v.name_class(F.lit("report2024.txt")).alias("c")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False, True, False, True, True]
    assert [r["tmp"] for r in got] == [False] * 8 + [True, False]
    assert tuple(got[0]["c"]) == ("txt", 0, 2) or tuple(got[0]["c"])[0] == "txt"
    f = spark.createDataFrame([(1,), (5,)], "bits long").select(v.feature_decision(F.col("bits"), 3, F.lit(False)).alias("d")).collect()
    assert [r["d"] for r in f] == ["open", "refuse"]


def test_costs(spark):
    row = spark.range(1).select(
        v.encoded_size(F.lit("palette"), F.lit(10)).alias("size"), v.read_cycles(F.lit("sparse"), F.lit(4100)).alias("r"), v.write_cycles(F.lit("exact_ref"), F.lit(4096)).alias("w"),
        v.dependent_reads(F.lit("base_residual"), F.lit(True)).alias("n"), v.reference_depth(F.lit("sequence_dict")).alias("d"), v.search_budget(v.strategy_of(F.lit("unknown"))).alias("b"),
    ).first()
    assert tuple(row) == (32, 516, 32, 3, 1, 4)


def test_corpora(spark):
    one = {(r["version"], r["idx"]): bytes(r["bytes"]) for r in corpus(spark, "versioned", 1, versions=3).collect()}
    assert len(one) == 48 and all(len(x) == 65536 for x in one.values())
    changed = [sum(p != q for p, q in zip(one[0, j], one[2, j], strict=True)) for j in range(3)]
    assert changed == pytest.approx([28, 56, 84], abs=3)
    moved = {(r["version"], r["idx"]): bytes(r["bytes"]) for r in corpus(spark, "shuffled", 1, versions=2).collect()}
    assert moved[1, 5] == one[1, 1] and sorted(moved[1, i] for i in range(16)) == sorted(one[1, i] for i in range(16))
    assert noise_range(1, 2, 10, 100) == noise_range(1, 2, 0, 200)[10:110]
    zones = corpus(spark, "structured", 2).where("idx in (0, 16)").orderBy("idx").collect()
    assert bytes(zones[0]["bytes"][:27]) == b"abcdefghijklmnopqrstuvwxyza" and not any(zones[1]["bytes"])
