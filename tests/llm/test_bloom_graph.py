"""Exact dedup and connected components against plain Python."""

import hashlib
import random

import pytest

from pricewire.llm import bloom_dedup
from pricewire.llm.graph import connected_components


def _brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, used = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (keep, t or "") not in used
        if kept:
            used.add((keep, t or ""))
        out.append((i, keep, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "é ü"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "b"),
        (9, "b"), (None, "c"), (None, "c"), (10, "d"), (None, "d")]


@pytest.mark.parametrize("options", [{}, {"bits_per_row": 1, "hashes": 1}, {"max_filter_bits": 32768, "hashes": 3}])
def test_exact_dedup_matches_brute_force(spark, options):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, f"t{rng.randint(0, 400)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in bloom_dedup.exact_dedup(df, **options).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == _brute(rows)


def test_full_filter_still_gives_whole_results(spark):
    rows = [(i, f"t{i}") for i in range(40_000)] + [(50_000, "t7")]  # more cells than the filter has bits
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bloom_dedup.exact_dedup(df, max_filter_bits=32768)
    assert got.count() == len(rows) and got.filter("kept").count() == 40_000
    assert [r.doc_id for r in got.filter("not kept").collect()] == [7]


def test_drop_copies_keeps_columns_and_one_row(spark):
    rows = [(1, "a", "x", 5), (2, "a", None, 6), (2, "a", "z", 6), (None, None, "n", 1), (3, "", "e", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size int")
    got = bloom_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 3]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert bloom_dedup.exact_dedup(df).collect() == []
    assert bloom_dedup.drop_copies(df).collect() == []
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 2000)]      # a chain, loops
    edges += [(-7, 3000 + i) for i in range(50)] + edges[:10]                         # a hub, repeats
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
