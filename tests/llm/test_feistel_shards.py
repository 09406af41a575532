"""Feistel shards against a plain Python permutation, and their law."""

import struct
import zlib
from collections import Counter
from math import isqrt

import pytest
import xxhash

import __spark_entry__ as entry
from pricewire.llm import feistel_shards as fs


def _hash(x, j, seed):
    """xxhash64(long, int, int) as Spark chains it: ints are hashed as 4 bytes, the seed is the hash so far."""
    h = xxhash.xxh64(struct.pack("<q", x), seed=42).intdigest()
    for v in (j, seed):
        h = xxhash.xxh64(struct.pack("<i", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def _python_position(x, n, seed=fs.SEED, rounds=fs.ROUNDS):
    a = max(1, isqrt(n))
    b = -(-n // a)
    while True:
        l, r = divmod(x, b)
        for j in range(rounds):
            if j % 2 == 0:
                l = (l + _hash(r, j, seed) % a) % a
            else:
                r = (r + _hash(l, j, seed) % b) % b
        x = l * b + r
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10, 17, 100, 101, 1023, 2500])
def test_permutation_matches_python_and_inverts(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_no")
    placed = fs.position_of(rows, "row_no", n, 3)
    got = {r.row_no: r.slot * 3 + r.shard for r in placed.collect()}
    assert got == {i: _python_position(i, n) for i in range(n)}
    assert sorted(got.values()) == list(range(n))
    back = fs.row_at(placed, n, 3, out="back").collect()
    assert all(r.back == r.row_no for r in back)


def _check_law(rows, k):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min([*sizes.values(), *([0] if len(sizes) < k else [])]) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_query_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    q = entry.queries()["op4_feistel_shards"]
    rows = q(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.slot * 16 + r.shard == _python_position(r.row_no, len(rows))
    _check_law(rows, 16)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, q(spark, sf).collect())) or all(
        (a.doc_id, a.shard, a.slot) == (b.doc_id, b.shard, b.slot)
        for a, b in zip(sorted(rows), sorted(q(spark, sf).collect()), strict=True))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 2), (1, "", 2), (2, "é" * 50_000, 3)] + [(7, "same", 4)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = fs.feistel_shards(df, n_shards=4).collect()
    assert len(got) == len(rows)
    _check_law(got, 4)
    assert Counter(r.size for r in got) == Counter({5: 20, 1: 4, 100_001: 1})
    assert {r.text_crc32 for r in got if r.size == 1} == {0}
    assert fs.feistel_shards(df.limit(0)).collect() == []
