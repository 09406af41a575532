"""Blocks of the feature sweep (M8) against plain counts; the fits on a small separable sample."""

import math
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pricewire.operators import sweep as SW

TEXTS = {1: "profit rises again again", 2: "profit falls", 3: "", 4: None, 5: "board again meets a board", 6: "unused words only"}
SAMPLES = [("a", 1, True), ("b", 1, True), ("c", 2, True), ("d", 3, True), ("e", 4, False), ("f", 5, False), ("g", 9, False), ("h", None, True)]


def grams(text, order):
    w = re.findall(r"\b\w\w+\b", (text or "").lower())
    return Counter(" ".join(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def tables(spark):
    samples = spark.createDataFrame(SAMPLES, "id string, doc_idx long, train boolean")
    return samples, spark.createDataFrame(list(TEXTS.items()), "doc_idx long, text string")


def _vocab(order, size):
    total = Counter()
    for _, doc, train in SAMPLES:
        if train:
            total.update(grams(TEXTS.get(doc), order))
    return sorted(sorted(total, key=lambda t: (-total[t], t))[:size])


@pytest.mark.parametrize(("order", "size"), [(1, 100), (3, 100), (3, 4)])
def test_text_and_tfidf_blocks(tables, order, size):
    samples, docs = tables
    out, width = SW.text_block(samples, docs, "BOW", order, size)
    out = SW.tfidf_block(out, "BOW", "W", width)
    got = {r.id: (r.c, r.w) for r in out.select("id", vector_to_array("BOW").alias("c"), vector_to_array("W").alias("w")).collect()}
    vocab = _vocab(order, size)
    assert width == len(vocab) and set(got) == {s[0] for s in SAMPLES}
    counts = {i: [grams(TEXTS.get(d), order)[t] for t in vocab] for i, d, _ in SAMPLES}
    train = [counts[i] for i, _, t in SAMPLES if t]
    idf = [math.log((1 + len(train)) / (1 + sum(c[j] > 0 for c in train))) + 1 for j in range(width)]
    for i in got:
        raw = [c * f for c, f in zip(counts[i], idf)]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert got[i][0] == counts[i]
        assert got[i][1] == pytest.approx([x / norm for x in raw])


def test_no_term_fails(tables):
    samples, docs = tables
    with pytest.raises(ValueError, match="empty vocabulary"):
        SW.text_block(samples.where("doc_idx = 3"), docs, "BOW")


def test_columns_and_fits(spark, tables):
    samples, docs = tables
    rows = samples.withColumn("label", F.when(F.col("doc_idx") == 1, 1.0).otherwise(0.0)).withColumn("x", F.array(F.lit(0.0), F.col("label")))
    out, width = SW.text_block(rows, docs, "BOW")
    out = SW.dense_block(out, "x", "two", 2)
    sets = [("BOW", ["BOW"]), ("both", ["BOW", "two"]), ("two", ["two"])]
    cols = {r.features: tuple(r)[1:] for r in SW.sweep_columns(spark, out, sets, {"BOW": width, "two": 2}, ["BOW"]).collect()}
    entries = sum(len(set(grams(TEXTS.get(d), 1)) & set(_vocab(1, 100))) for _, d, _ in SAMPLES)
    assert cols == {"BOW": (width, 5, 3, entries), "both": (width + 2, 5, 3, entries), "two": (2, 5, 3, 0)}
    fits = {r.features: (r.train_acc, r.test_acc) for r in SW.sweep_fits(spark, out, sets, C=1000.0).collect()}
    assert set(fits) == {"BOW", "both", "two"}
    assert fits["both"] == fits["two"] == (1.0, 1.0)
