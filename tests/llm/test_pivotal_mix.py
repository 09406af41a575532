"""Mixing to target weights: targets against an iterative water filling, and the law of the copies."""

import random
import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from pricewire.llm import pivotal_mix as pm


def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Hand out by weight; what is above a cap is handed out again to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, full, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        total = sum(w[s] for s in names if s not in full)
        part, left = left, 0.0
        for s in [s for s in names if s not in full]:
            got[s] += part * w[s] / total
            if got[s] >= cap * sizes[s]:
                left += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                full.add(s)
    return got


def _check(rows, source_of, slack):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source_of[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
        assert r.size == 0 or r.taken % r.size == 0
    want = _targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[source_of[r.doc_id]]
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        biggest = max(r.size for r in rows if source_of[r.doc_id] == s)
        assert abs(taken[s] - target[s]) <= biggest / 2 + slack


@pytest.mark.parametrize("fan", [2, 5, 32])
def test_taken_words_meet_targets(spark, fan):
    rng = random.Random(fan)
    rows = [(i, " ".join("w" * rng.choice([1, 3, 10, 200])), rng.choice(["a", "b", "b", "b", "c", "é", "Z", None]))
            for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, " \t\n", "only empty"), (1003, "x " * 30_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = pm.pivotal_mix(df, fan=fan).collect()
    assert len(got) == len(rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert all(r.size == words[r.doc_id] for r in got)
    _check(got, {i: s for i, _, s in rows}, 1e-3)
    again = pm.pivotal_mix(df.repartition(7), fan=fan).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_query_on_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = entry.queries()["op7_pivotal_mix"](spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    assert len(rows) == len(source)
    _check(rows, source, 1e-3)


def test_fractions_do_not_change_on_average(spark):
    rows = [(i, "w " * (1 + i % 4), "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, runs = defaultdict(int), 12
    want = {}
    for seed in range(runs):
        for r in pm.pivotal_mix(df, fan=4, seed=seed).collect():
            total[r.doc_id] += r.copies
            want[r.doc_id] = r.target / r.source_size
    mean = sum(total[i] / runs - want[i] for i in total) / len(total)
    assert abs(mean) < 0.08 and all(abs(total[i] / runs - want[i]) < 0.7 for i in total)


def test_mixed_repeats_rows_as_taken(spark):
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 2), (2, None, "t", 3), (None, "d e", None, 4)] + [
        (10 + i, "w " * (i + 1), "s", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = pm.mixed(df)
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in pm.pivotal_mix(df).collect())
    assert set(map(tuple, out.collect())) <= set(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pm.pivotal_mix(df).collect() == [] and pm.mixed(df).collect() == []
