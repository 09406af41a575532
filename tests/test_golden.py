"""Hand-worked cases (FIXTURES.md part C) for the operators."""

import math

from pyspark.sql import functions as F

from pricewire.functions import prices as P
from pricewire.functions import text as X
from pricewire.functions.vectors import topic_normalize
from pricewire.operators import evaluate as E
from pricewire.operators import splits as SP
from pricewire.operators import terms as TM
from pricewire.operators import text as TX
from pricewire.operators import topics as TP


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_clean_text_cases(spark):
    assert one(spark, "this is a be?\n are you a. it's not my!", X.clean_text) == \
        "this is a be are you a it has not my"
    assert one(spark, "I can't; we've 42 well-known A1s", X.clean_text) == "i cannot we have well-known as"


def test_clean_text_sentences(spark):
    assert one(spark, "Up 5%. Why?", X.clean_text_sentences) == "up EOS why EOS"


def test_clean_text_non_ascii_not_lowered_to_ascii(spark):
    # U+0130 lower-cases to an ASCII i in the JVM; byte semantics drop it
    assert one(spark, "İstanbul", X.clean_text) == "stanbul"


def test_tokenize_splits(spark):
    toks = spark.createDataFrame([("we cannot wanna go -- gonna",)], "s string") \
        .select(X.tokenize("s").alias("t")).first()["t"]
    assert toks == ["we", "can", "not", "wan", "na", "go", "--", "gon", "na"]


def _prices(spark):
    rows = [("X", "2020-01-06", 99.0, 102.0), ("X", "2020-01-03", 110.0, 100.0), ("X", "2020-01-02", 100.0, 98.0)]
    return spark.createDataFrame(rows, "symbol string, d string, open double, close double") \
        .withColumn("date", F.to_date("d"))


def test_price_changes(spark):
    df = _prices(spark).select("date", P.change_next_open("open").alias("l1"),
                               P.change_next_close("close").alias("l2"),
                               P.change_intraday("open", "close").alias("l3"))
    got = {str(r["date"]): r for r in df.collect()}
    assert math.isclose(got["2020-01-02"]["l1"], 10.0) and math.isclose(got["2020-01-03"]["l1"], -10.0)
    assert got["2020-01-06"]["l1"] is None
    assert math.isclose(got["2020-01-03"]["l2"], 2.0)
    assert got["2020-01-06"]["l2"] is None and got["2020-01-02"]["l2"] is None
    assert math.isclose(got["2020-01-02"]["l3"], -2.0)


def test_labels_nan_and_thresholds(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (-1.0,), (0.99,), (0.2,), (0.7,), (0.5,)], "x double")
    r = df.select("x", P.significant("x", 1.0).alias("s"), P.direction_multiclass("x").alias("m"),
                  P.outside_buffer("x").alias("keep")).collect()
    assert r[0]["s"] == 0
    assert [x["m"] for x in r[1:4]] == [1, -1, 0]
    assert [x["keep"] for x in r[4:]] == [True, True, False]


def test_topic_hist_adjacent_gap_rule(spark):
    rows = [(0, "A", [1.0, 0.0]), (1, "B", [9.0, 9.0]), (2, "A", [0.0, 1.0]), (3, "A", [2.0, 2.0])]
    df = spark.createDataFrame(rows, "pos long, company string, topic array<double>")
    h = TP.topic_hist_adjacent(df, [0.5], [2]).orderBy("pos", "i").collect()
    got = [[r["hist"] for r in h if r["pos"] == p] for p in range(4)]
    assert got == [[0.0, 0.0], [0.0, 0.0], [0.25, 0.0], [0.0, 0.5]]


def test_topic_hist_indexed_as_read(spark):
    topics = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 1.0]), (1, 9, [0.5, 0.5])],
                                   "k int, doc_idx long, topic array<double>")
    s = spark.createDataFrame([("s", 9, [1, 2, 3]), ("t", 9, [1, 2, -1])], "key string, doc_idx long, prev_doc_idx array<long>")
    h = TP.topic_hist_indexed(s, topics, ["key"], alphas=[0.5], windows=[2]).orderBy("key", "i").collect()
    assert [r["hist"] for r in h if r["key"] == "s"] == [0.5, 0.75]     # 0.5*d3 + 0.25*d2
    assert [r["hist"] for r in h if r["key"] == "t"] == [0.0, 0.25]     # d3 missing


def test_topic_normalize(spark):
    df = spark.createDataFrame([([1.05, 3.05], 0.05)], "g array<double>, a double")
    v = df.select(topic_normalize("g", "a").alias("t")).first()["t"]
    assert [round(x, 9) for x in v] == [0.25, 0.75]


def test_fold_sizes_and_holdout(spark):
    df = spark.createDataFrame([(i, 1) for i in range(8)], "row_idx long, label int")
    f = SP.kfold_stratified(df, 3, "label", seed=1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == [3, 3, 2]
    h = SP.kfold_stratified(df, 6, "label", seed=1).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in h] == [2, 2, 1, 1, 1, 1]
    v = SP.holdout_last_fold(df, "label", seed=1).where("valid").count()
    assert v == 1


def test_balance_and_sampling_properties(spark):
    df = spark.createDataFrame([(i, 1 if i % 5 == 0 else 0) for i in range(50)], "row_idx long, label int")
    b = SP.balance_binary(df, "label", seed=3).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in b} == {0: 40, 1: 40}
    s = SP.sample_balanced(df, "label", seed=3).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in s} == {0: 10, 1: 10}


def test_tfidf_case(spark):
    docs = spark.createDataFrame([(0, "a b b"), (1, "a"), (2, "a c")], "row_idx long, text string")
    counts = docs.select("row_idx", F.explode(F.split("text", " ")).alias("term")).groupBy("row_idx", "term").count() \
        .withColumnRenamed("count", "cnt")
    vocab = TM.learn_vocab(counts)
    bow = TM.bow_counts(counts, vocab)
    t = TM.tfidf(bow, docs).join(vocab, "idx").where("row_idx = 0").collect()
    got = {r["term"]: round(r["value"], 6) for r in t}
    assert got == {"a": 0.283217, "b": 0.959056}


def test_chi2_and_mi_cases(spark):
    docs = spark.createDataFrame([(0, 1), (1, 0)], "row_idx long, label int")
    counts = spark.createDataFrame([(0, "t", 3), (1, "t", 1)], "row_idx long, term string, cnt long")
    assert round(TM.chi2_scores(counts, docs).first()["score"], 6) == 1.0
    docs4 = spark.createDataFrame([(i, i % 2) for i in range(4)], "row_idx long, label int")
    same = spark.createDataFrame([(1, "t", 1), (3, "t", 1)], "row_idx long, term string, cnt long")
    indep = spark.createDataFrame([(0, "u", 1), (1, "u", 1)], "row_idx long, term string, cnt long")
    assert round(TM.mi_scores(same, docs4).first()["score"], 6) == round(math.log(2), 6)
    assert round(TM.mi_scores(indep, docs4).first()["score"], 6) == 0.0


def test_confusion_metrics(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4 + [(-1, -1)] * 2
    p = spark.createDataFrame([("r", i, t, q) for i, (t, q) in enumerate(pairs)],
                              "run_id string, row_idx long, label int, prediction int")
    c = {r["cls"]: r for r in E.class_counts_tp_fp(p).collect()}
    assert (c[1]["tp"], c[1]["fn"], c[1]["fp"], c[1]["tn"]) == (3, 1, 2, 6)
    pr = {r["cls"]: r for r in E.precision_recall(p).collect()}
    assert round(pr[1]["precision"], 6) == 0.6 and round(pr[1]["recall"], 6) == 0.75
    assert round(pr[1]["f1"], 6) == 0.666667
    assert round(E.accuracy(p).first()["accuracy"], 6) == 0.75
    cm = E.confusion_matrix(p).where("actual = -1").first()
    assert (cm["n_m1"], cm["n_0"], cm["n_p1"]) == (2, 0, 0)


def test_mcnemar(spark):
    o = spark.createDataFrame([(10, 4), (0, 0)], "b long, c long")
    r = E.mcnemar(o).collect()
    assert round(r[0]["chi2"], 6) == 2.571429 and r[1]["chi2"] is None


def test_check_libsvm(spark):
    lines = ["1 1:0.5 1:0.2", "x 1:2", "1 2:nan", "", "1 0:1 2:3"]
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "line_no long, value string")
    probs = E.check_libsvm(df)
    assert E.bad_line_count(probs).first()["bad_lines"] == 4
    assert probs.where("line_no = 5").count() == 0


def test_vocab_and_coverage(spark):
    docs = spark.createDataFrame([(["a", "a", "a", "c", "c", "b", "b"],)], "tokens array<string>")
    f = TX.word_freq(docs)
    v = TX.vocab_topk(f, 2).orderBy("idx").collect()
    assert [(r["term"], r["idx"]) for r in v] == [("a", 0), ("b", 1)]
    cov = TX.vocab_coverage(f, TX.vocab_topk(f, 2)).first()["coverage"]
    assert round(cov, 6) == round(5 / 7, 6)
