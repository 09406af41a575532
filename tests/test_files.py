"""File sources and sinks: small files written to a fresh temporary folder."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pricewire.operators import runlogs as RL
from pricewire.sources import files as S
from pricewire.sources import writers as K


def _dir():
    return tempfile.mkdtemp(prefix="pricewire-test-")


def _write(folder, name, text):
    p = os.path.join(folder, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_line_numbers_and_collection(spark):
    d = _dir()
    _write(d, "c.tsv", "acme\t2020-01-02\tup up\nacme\t2020-01-03\t\nbeta\t2020-01-03T10:00:00Z\tdown\n")
    c = S.src_collection(spark, d).orderBy("doc_idx").collect()
    assert [(r["doc_idx"], r["company"], str(r["date"])) for r in c] == [(0, "acme", "2020-01-02"),
                                                                         (2, "beta", "2020-01-03")]
    assert c[0]["tokens"] == ["up", "up"]


def test_article_text_meta_and_names(spark):
    d = _dir()
    _write(d, "nyt_acme-text-1", "a1\tx\tFirst text\nbad line\na2\tx\tSecond\n")
    _write(d, "nyt_acme-json-1", "{'response': {'docs': [{'_id': u'a1', 'pub_date': u'2020-01-02T05:00:00Z'}]}}\n"
                                 "{'response': {'docs': []}}\nnot a literal\n")
    _write(d, "readme", "x\n")
    t = S.src_article_text(spark, d).orderBy("_id").collect()
    assert [(r["company"], r["_id"], r["text"]) for r in t] == [("acme", "a1", "First text"), ("acme", "a2", "Second")]
    m = S.src_article_meta(spark, d)
    ok = m.where("parsed").collect()
    assert [(r["company"], r["_id"], str(r["day"])) for r in ok] == [("acme", "a1", "2020-01-02")]
    assert m.where("NOT parsed").count() == 1
    assert [r["name"] for r in S.unrecognised_files(spark, d).collect()] == ["readme"]


def test_prices_symbol_map_listing(spark):
    d = _dir()
    hdr = "Date,Open,High,Low,Close,Volume,Adj Close\n"
    _write(d, "p/stock_AAA.csv", hdr + "2020-01-03,110,1,1,100,5,5\n2020-01-02,100,1,1,98,5,5\n")
    _write(d, "p/stock_BBB.csv", hdr + "2020-01-02,50,1,1,51,5,5\n")
    p = S.src_prices(spark, os.path.join(d, "p")).orderBy("symbol", "date").collect()
    assert [(r["symbol"], r["open"], r["close"]) for r in p] == [("AAA", 100.0, 98.0), ("AAA", 110.0, 100.0),
                                                                 ("BBB", 50.0, 51.0)]
    _write(d, "m.csv", "symbol,company\nAAA,Old\nBBB,Bee\nAAA,New\n")
    m = {r["symbol"]: r["company"] for r in S.src_symbol_map(spark, os.path.join(d, "m.csv")).collect()}
    assert m == {"AAA": "New", "BBB": "Bee"}
    _write(d, "l.csv", "AAA,Acme Inc ,1,2,3,4,5,6\n")
    assert S.src_listing_map(spark, os.path.join(d, "l.csv")).first()["company"] == "Acme Inc"


def test_labelled_samples_roundtrip(spark):
    d = _dir()
    rows = [("acme", "2020-01-02", 3, 1.5, [1.5] + [float("nan")] * 20, [-1] * 20, 1, 0)]
    df = spark.createDataFrame(rows, "company string, date string, doc_idx long, change double, "
                                     "changes array<double>, prev_doc_idx array<long>, label int, split int")
    K.sink_labelled_samples(df.withColumn("date", F.to_date("date")), os.path.join(d, "s"))
    back = S.src_labelled_samples(spark, os.path.join(d, "s")).first()
    assert back["doc_idx"] == 3 and back["changes"][0] == 1.5 and back["changes"][1] is None
    assert back["prev_doc_idx"] == [-1] * 20 and back["split"] == 0
    # An existing output is skipped unless overwrite
    K.sink_labelled_samples(df.withColumn("date", F.to_date("date")).withColumn("label", F.lit(0)),
                            os.path.join(d, "s"))
    assert S.src_labelled_samples(spark, os.path.join(d, "s")).first()["label"] == 1


@pytest.mark.parametrize("width", [45, 47])
def test_labelled_samples_width_is_checked_in_pruned_reads(spark, width):
    d = _dir()
    _write(d, "s.csv", ",".join(["acme", "2020-01-02", *["1"] * (width - 2)]) + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.src_labelled_samples(spark, os.path.join(d, "s.csv")).select("company").collect()


def test_topic_gamma_libsvm_pairs(spark):
    d = _dir()
    _write(d, "lda/k2/final.gamma", "1.05 3.05\n2.05 2.05\n")
    _write(d, "lda/k2/final.other", "num_topics 2\nalpha 0.05\n")
    _write(d, "lda/broken/final.gamma", "1 1\n")
    g = S.src_topic_gamma(spark, os.path.join(d, "lda")).orderBy("doc_idx").collect()
    assert [(r["folder"], r["doc_idx"], r["k"], r["alpha"]) for r in g] == [("k2", 0, 2, 0.05), ("k2", 1, 2, 0.05)]
    _write(d, "t.libsvm", "1 1:0.5 3:2\n0 2:1\n")
    ls = S.src_libsvm(spark, os.path.join(d, "t.libsvm")).orderBy("row_idx").collect()
    assert ls[0]["features"] == {1: 0.5, 3: 2.0} and ls[1]["label"] == 0.0
    _write(d, "pred.txt", "1\n0\n")
    pairs = S.src_label_prediction_pairs(spark, os.path.join(d, "t.libsvm"), os.path.join(d, "pred.txt"), "r")
    assert sorted((r["row_idx"], r["label"], r["prediction"]) for r in pairs.collect()) == [(0, 1, 1), (1, 0, 0)]


def test_sentiment_split_corpus_vectors(spark):
    d = _dir()
    _write(d, "sent.csv", "a,b,7,0.1,0.2,0.7\na,b,7,0.3,0.3,0.4\na,b,8,1,0,0\n")
    s = {r["doc_idx"]: r["sentiment"] for r in S.src_sentiment(spark, os.path.join(d, "sent.csv")).collect()}
    assert s[7] == [0.3, 0.3, 0.4] and s[8] == [1.0, 0.0, 0.0]
    _write(d, "split.csv", "c,2020-01-01,0,1,2,3,0\nc,2020-01-02,1,1,2,3,2\n")
    sp = S.src_split_column(spark, os.path.join(d, "split.csv")).orderBy("row_idx").collect()
    assert [r["split"] for r in sp] == [0, 2]
    lc = S.src_labelled_corpus(spark, os.path.join(d, "split.csv")).orderBy("pos").collect()
    assert [(r["company"], r["doc_idx"]) for r in lc] == [("c", 0), ("c", 1)]
    _write(d, "sig.txt", "true labels: [1, 0, 1]\ntime-series: [1, 1, 1]\ntopic-model: [0, 0, 1]\n"
                         "ngram-model: [1, 0, 0]\n")
    v = S.src_label_vectors(spark, os.path.join(d, "sig.txt")).orderBy("pos").collect()
    assert [(r["true"], r["time_series"], r["topic"], r["ngram"]) for r in v] == [(1, 1, 0, 1), (0, 1, 0, 0),
                                                                                   (1, 1, 1, 0)]


def test_run_logs(spark):
    d = _dir()
    lines = ["[Topic] k=10,  change only \t[Accuracy] train: 0.54 \ttest: 0.52",
             "[Topic] k=10,  change + topic distribution \t[Accuracy] train: 0.56 \ttest: 0.53",
             "[Topic] k=15,  change only \t[Accuracy] train: 0.55 \ttest: 0.51",
             "[Topic] k=15,  change + topic distribution \t[Accuracy] train: 0.57 \ttest: 0.54",
             "[Topic] k=10,  change only \t[Accuracy] train: 0.50 \ttest: 0.60"]
    _write(d, "lda.txt", "\n".join(lines) + "\n")
    log = S.src_run_log(spark, os.path.join(d, "lda.txt"))
    p = {r["k"]: (r["change"], r["dist"]) for r in RL.pivot_change_vs_dist(log).collect()}
    assert p == {10: (0.60, 0.53), 15: (0.51, 0.54)}
    _write(d, "hist.txt", "stock: t=1 \t[Accuracy] train: 0.48 \ttest: 0.50\nstock: t=2 \t[Accuracy] train: 0.49 \ttest: 0.51\n")
    h = RL.history_by_t(S.src_run_log(spark, os.path.join(d, "hist.txt"))).collect()
    assert [(r["days"], r["test_acc"]) for r in h] == [(1, 0.50), (2, 0.51)]
    _write(d, "alpha.txt", "k=10, alpha=0.9, L=5 \ttest: 0.51\nk=15, alpha=0.9, L=5 \ttest: 0.55\n"
                           "k=10, alpha=0.9, L=5 cond \ttest: 0.70\n")
    a = RL.pivot_alpha_window(S.src_run_log(spark, os.path.join(d, "alpha.txt"))).collect()
    assert a[0]["alpha"] == 0.9 and a[0]["5"] == 0.55


def test_stream_cleaning(spark):
    from pricewire.streaming import text_stream as TS
    src = "/root/testdata/sf0.001"
    d = _dir()
    stream = TS.clean_documents(TS.read_documents(spark, src, "documents.parquet"))
    out = TS.run_to_memory(stream, "clean_docs_test", os.path.join(d, "ckpt"))
    n = spark.read.parquet(f"{src}/documents.parquet").count()
    assert 0 < out.count() <= n


def test_join_sentiment(spark):
    from pricewire.operators.labels import join_sentiment
    d = _dir()
    _write(d, "sent.csv", "a,b,7,0.1,0.2,0.7\n")
    s = S.src_sentiment(spark, os.path.join(d, "sent.csv"))
    samples = spark.createDataFrame([(7, [1.0, 2.0]), (8, [3.0])], "doc_idx long, features array<double>")
    out = join_sentiment(samples, s).collect()
    assert [(r["doc_idx"], r["features"]) for r in out] == [(7, [1.0, 2.0, 0.1, 0.2, 0.7])]


def test_line_numbers_across_file_blocks(spark):
    d = _dir()
    _write(d, "big.txt", "".join(f"{i}\n" for i in range(5000)))
    _write(d, "small.txt", "".join(f"{i}\n" for i in range(7)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")     # many blocks per file
    try:
        df = S.with_line_numbers(spark.read.text(d))
        bad = df.where(F.col("value").cast("long") != F.col("line_no")).count()
        assert df.count() == 5007 and bad == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_stand_in_document_order(spark):
    lines = [(i, f"line {i}") for i in range(500)]
    df = spark.createDataFrame(lines, "doc_idx long, line string").repartition(7, "line")
    raw = df.select("doc_idx", F.lit("acme").alias("company"), F.lit("2020-01-02").alias("date"), F.col("line").alias("text"))
    for name, rows, sink, text in (("docterm", df, K.sink_doc_term, "{}"),
                                   ("libsvm", df.withColumnRenamed("doc_idx", "row_idx"), K.sink_libsvm, "{}"),
                                   ("raw", raw, K.sink_raw_corpus, "acme\t2020-01-02\t{}")):
        path = os.path.join(_dir(), name)
        sink(rows, path)
        back = S.with_line_numbers(spark.read.text(path), whole=True).collect()
        assert sorted((r.line_no, r.value) for r in back) == [(i, text.format(x)) for i, x in lines], name


def test_day_corpus_holds_every_text(spark):
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = entry.queries()["day_corpus_texts"](spark, sf)
    want = d.select(F.md5("text").alias("m")).union(
        d.where("doc_id % 7 = 0").select(F.md5(F.concat("text", F.lit(" (updated)"))).alias("m")))
    assert sorted(r.text_md5 for r in rows.collect()) == sorted(r.m for r in want.collect())


def test_raw_corpus_with_empty_document_reads_back_empty(spark):
    d = os.path.join(_dir(), "raw")
    raw = spark.createDataFrame([(5, "acme", "2020-01-02", "up up"), (6, "acme", "2020-01-03", ""), (9, "beta", "2020-01-03", 'a "b')],
                                "doc_idx long, company string, date string, text string").withColumn("date", F.to_date("date"))
    K.sink_raw_corpus(raw, d)
    assert [(r["doc_idx"], r["text"]) for r in S.src_collection(spark, d).orderBy("doc_idx").collect()] == [(0, "up up"), (2, 'a "b')]
    assert S.src_corpus_coverage(spark, d).count() == 3


def test_a_file_may_be_a_folder_of_parts(spark):
    d = _dir()
    _write(d, "texts/name=nyt_acme-text-1/part-00000.txt", "a1\tx\tOne\n")
    _write(d, "texts/name=nyt_beta-text-1/part-00000.txt", "b1\tx\tTwo\n")
    t = S.src_article_text(spark, os.path.join(d, "texts"))
    assert sorted((r["company"], r["_id"]) for r in t.collect()) == [("acme", "a1"), ("beta", "b1")]
    _write(d, "lda/k2/final.gamma/part-00000.txt", "1 2\n3 4\n")
    _write(d, "lda/k2/final.gamma/part-00001.txt", "5 6\n")
    _write(d, "lda/k2/final.other/part-00000.txt", "alpha 0.5\n")
    g = S.src_topic_gamma(spark, os.path.join(d, "lda")).orderBy("doc_idx").collect()
    assert [(r["folder"], r["doc_idx"], r["gamma"]) for r in g] == [("k2", 0, [1, 2]), ("k2", 1, [3, 4]), ("k2", 2, [5, 6])]


def test_libsvm_files_are_checked_each_on_its_own(spark):
    from pricewire.operators import evaluate as E
    d = _dir()
    _write(d, "a.txt", "1 1:2\n1 2:1 1:1\n")
    _write(d, "b.txt", "x 1:2\n\n1 1:é")
    _write(d, "c.txt", "1 1:2\r\n1 1:3\r\n")
    _write(d, "d.txt", "")
    found = {(r["file"][-5:], r["line_no"], r["pos"], r["problem"]) for r in E.check_libsvm_files(spark, d).collect()}
    assert found == {("a.txt", 2, 2, "not ascending"), ("b.txt", 1, 0, "bad label"), ("b.txt", 2, 0, "missing label"),
                     ("b.txt", 3, 1, "bad pair"), ("b.txt", 3, -1, "no newline")}


def test_run_log_groups(spark):
    d = _dir()
    lines = ["k=10, alpha=0.9, L=5 \ttest: 0.80", "k=10, alpha=0.9, L=5 \ttest: 0.51", "k=15, alpha=0.9, L=5 \ttest: 0.55",
             "k=10, alpha=0.9, L=5 cond \ttest: 0.70", "k=20, alpha=0.9, L=5 cond \ttest: 0.60", "today k=10 \ttest: 0.4",
             "today k=10 \ttest: 0.3"]
    _write(d, "log.txt", "\n".join(lines) + "\n")
    log = S.src_run_log(spark, os.path.join(d, "log.txt"))
    # the table over k keeps the last line of a setting, the list per k keeps every line
    assert [tuple(r) for r in RL.pivot_alpha_window(log).collect()] == [(0.9, 0.55)]
    assert [tuple(r) for r in RL.pivot_alpha_window(log, cont=True).collect()] == [(0.9, 0.70)]
    assert [tuple(r) for r in RL.add_beside_cont(log).collect()] == [(10, 0.80, 0.70), (15, 0.55, None)]
    assert [tuple(r) for r in RL.today_by_k(log).collect()] == [(10, 0.3)]
