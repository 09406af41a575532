"""Quality rules: statistics against direct counts, the learner on planted rules, defined cases."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from pricewire.llm import quality_rules as qr


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {p for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "é", "#", "|", "\x1c", "a b c"]), max_size=60))
def test_statistics_match_direct_counts(parts):
    text = "".join(parts)
    assert qr.text_stats(text)[:5] == _brute(text)


def test_query_on_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.queries()["op1_quality_rules"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert tuple(r)[1:6] == _brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_learner_finds_planted_conjunction_and_columns_agree(spark):
    rng = np.random.default_rng(4)
    x = {f: rng.random(3000) for f in qr.FEATURES}
    bad = ((x["symbols"] > 0.6) & (x["upper"] < 0.4)) | (x["marks"] > 0.9)
    hold = np.arange(3000) % 3 == 0
    rules = qr.learn(x, bad, hold)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= r.mask(x)
    assert 1 < len(rules) <= 12 and (said == bad).mean() > 0.97
    assert {"symbols", "marks"} <= {t[0] for r in rules for t in r.tests}
    stats = [(1000, 5000 + i, 17 * i, i % 3, i % 7, 10, 900 - i, i, 0, i % 40) for i in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stats)], "id int, s struct<" + ",".join(
        f"{n}:long" for n in qr.STAT_NAMES) + ">")
    some = [qr.Rule((("symbols", True, 2.0), ("distinct", False, 0.75))), qr.Rule((("marks", True, 0.03),))]
    got = {r.id: r.rule for r in df.select("id", qr.rejected_by(some, "s").alias("rule")).collect()}
    for i, s in enumerate(stats):
        v = dict(zip(qr.STAT_NAMES, s, strict=True))
        want = 1 if v["n_symbols"] / 1000 >= 2 and v["n_distinct_words"] / 1000 <= 0.75 else 2 if v["n_marks"] / 1000 >= 0.03 else None
        assert got[i] == want


def test_held_out_accuracy(spark):
    """A list fitted on some labelled documents judges the others: it keeps the good and drops the detectable junk."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = qr.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = qr.judge(docs, labels, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert rules and sum(r.kept for r in good) > 0.98 * len(good)
    assert sum(not r.kept for r in junk) > 0.6 * len(junk)


def test_defined_cases(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, 1), (1, good, 2), (2, None, 3), (3, "", 4), (None, good, 5), (4, "a b c " * 30, 6), (5, good + " x" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for labels in (none, odd):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.kept) for r in qr.judge(df, labels).collect())
        assert got == [(False, 0, 80, True), (True, 1, 80, True), (True, 1, 80, True), (True, 2, 0, False), (True, 3, 0, False),
                       (True, 4, 90, False), (True, 5, 100_080, False)]
        kept = qr.keep_good(df, labels)
        assert kept.columns == df.columns and sorted(r.kept for r in kept.collect()) == [1, 2, 5]
    assert qr.judge(df.limit(0), none).collect() == []
