"""Sink -> source round trips over data derived from the provided tables.

Each query writes with a ``sources.writers`` sink into a fresh folder under
the session's shared checkpoint folder (``spark.checkpoint.dir``; never a
machine-local one) and reads it back with the matching reader, so the
distributed write and read paths are checked against the same oracle SQL as
the in-memory queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricewire.operators import terms as TM
from pricewire.operators import text as TX
from pricewire.plans import q_prices, q_splits, q_terms, q_text
from pricewire.plans import sql as S_
from pricewire.plans.base import ORACLE, flatten, query, rounded
from pricewire.session import cut_lineage, ensure_checkpoint_dir
from pricewire.sources import files as S
from pricewire.sources import tables as T
from pricewire.sources import writers as K


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@query("src_labelled_samples", "SELECT * EXCLUDE (symbol) FROM (" + ORACLE["label_significance"].replace(
    "CASE WHEN abs(change) >=", "0 AS split, CASE WHEN abs(change) >=", 1) + ")")
def q_src_labelled_samples(spark, sf_dir):
    """K6 + S10: the labelled sample written as 46-column CSV and read back (the format holds the company, not the symbol)."""
    path = _folder(spark, "samples")
    K.sink_labelled_samples(q_prices.labelled_samples(spark, sf_dir).withColumn("split", F.lit(0)), path)
    s = S.src_labelled_samples(spark, path)
    s = s.select("company", "date", "doc_idx", "change", F.slice("changes", 2, T.N_PREV).alias("hist"),
                 "prev_doc_idx", "label", "split")
    s = flatten(flatten(s, "hist", T.N_PREV, "change_"), "prev_doc_idx", T.N_PREV, "prev_doc_")
    return rounded(s)


@query("src_symbol_map", ORACLE["join_symbol_company"].split("SELECT symbol, company")[0] +
       "SELECT symbol, company FROM symbol_map")
def q_src_symbol_map(spark, sf_dir):
    """The symbol map written as CSV with a header and read back (last duplicate wins)."""
    path = _folder(spark, "symbols")
    T.symbol_map(spark, sf_dir).write.csv(path, header=True)
    return S.src_symbol_map(spark, path)


@query("stock_data_roundtrip", ORACLE["stock_table"])
def q_stock_data_roundtrip(spark, sf_dir):
    """K5: the stock table written as CSV with a header and read back."""
    path = _folder(spark, "stock")
    K.sink_stock_data(q_prices.q_stock_table(spark, sf_dir), path)
    schema = "date date, company string, symbol string, next_close double, change double, sig int, sig_mc int"
    return spark.read.csv(path, header=True, schema=schema)


@query("dataset_roundtrip", ORACLE["split_by_date"])
def q_dataset_roundtrip(spark, sf_dir):
    """K8 + S18: train / test / valid stored partitioned by split and read back."""
    path = _folder(spark, "dataset")
    K.sink_dataset(q_splits.dated_split(spark, sf_dir).select("row_idx", "date", "label", "split"), path)
    return S.src_dataset(spark, path).select("row_idx", "date", "label", F.col("split").cast("int").alias("split"))


@query("vocab_roundtrip", ORACLE["vocab_topk"])
def q_vocab_roundtrip(spark, sf_dir):
    """K2: the vocabulary stored and read back."""
    path = _folder(spark, "vocab")
    K.sink_vocab(q_text.vocab(spark, sf_dir), path)
    return spark.read.parquet(path).select("term", "idx", F.col("freq").cast("long").alias("freq"))


@query("doc_term_file", ORACLE["doc_term_lines"].replace(
    "SELECT t.doc_idx, coalesce(k.line, '0 ') AS line",
    "SELECT row_number() OVER (ORDER BY t.doc_idx) - 1 AS line_no, coalesce(k.line, '0 ') AS line", 1))
def q_doc_term_file(spark, sf_dir):
    """K4: doc-term lines written as text and read back (one line per document, its place is the document's)."""
    path = _folder(spark, "docterm")
    d = q_text.stored_corpus(spark, sf_dir)
    # stored once: the range sort of the writer would count the words twice
    K.sink_doc_term(cut_lineage(TX.doc_term_lines(d, q_text.vocab(spark, sf_dir, docs=d), bound=q_text.VOCAB_SIZE)), path)
    return S.with_line_numbers(spark.read.text(path), whole=True).select("line_no", F.col("value").alias("line"))


@query("term_scores_file", ORACLE["given_vocab"])
def q_term_scores_file(spark, sf_dir):
    """K9 + S19 + F7: chi-square scores written as ``term,score`` CSV, the first k read
    back as a fixed vocabulary and used for counts."""
    path = _folder(spark, "scores")
    ds = q_terms.text_dataset(spark, sf_dir)
    K.sink_term_scores(q_terms.chi2(ds), path)
    vocab = TM.given_vocab(S.src_term_scores(spark, path), q_terms.TOP_K)
    c = TM.bow_counts(q_terms.counts(ds), vocab, bound=q_terms.TOP_K)
    return c.select("row_idx", "idx", F.col("cnt").cast("long").alias("cnt"))


@query("day_corpus_file", ORACLE["docs_per_day"])
def q_day_corpus_file(spark, sf_dir):
    """K1: the day corpus written per company (ordered rows with their texts) and read back: its articles."""
    return _day_corpus(spark, sf_dir).select("company", "date", "_id", "ord").distinct()


def _day_corpus(spark, sf_dir):
    """The day corpus as written and read back; an article with several texts has a row for each, under one ord."""
    path = _folder(spark, "days")
    from pricewire.functions import text as X
    m = TX.dedup_articles(T.article_meta(spark, sf_dir)).withColumn("date", X.pub_day("pub_date"))
    texts = TX.distinct_texts(T.article_text(spark, sf_dir))
    articles = TX.day_articles(m).select("company", "date", "_id", "ord").join(texts, "_id")
    K.sink_day_corpus(articles.select("company", "date", "ord", "_id", "text"), path)
    return spark.read.parquet(path)


@query("day_corpus_texts", S_.with_(q_text._META_SQL, f"days AS ({ORACLE['docs_per_day']})") + """
SELECT d.company, d.date, d._id, d.ord, md5(t.text) AS text_md5
FROM days d JOIN (SELECT DISTINCT _id, text FROM txt) t USING (_id)""")
def q_day_corpus_texts(spark, sf_dir):
    """K1 + J1: the day corpus with the texts that it was written with (shown by their md5)."""
    return _day_corpus(spark, sf_dir).select("company", "date", "_id", "ord", F.md5("text").alias("text_md5"))


# Fixed layout of the generated result log: run -> (k, variant) as in the
# reference's topic log ("[Topic] k=10,  change only ...").
RUN_LOG_LAYOUT = [("change_a", 10, "change only"), ("change_b", 10, "change + topic distribution"),
                  ("hist_a", 15, "change only"), ("hist_b", 15, "change + topic distribution")]


@query("article_meta_file", ORACLE["dedup_articles"])
def q_article_meta_file(spark, sf_dir):
    """S1 + S3 + A1: crawl metadata written as lines of Python literals, one file set per crawl, read back and de-duplicated."""
    path = _folder(spark, "crawl")
    m = T.article_meta(spark, sf_dir)
    line = F.format_string("{u'response': {u'docs': [{u'_id': u'%s', u'pub_date': \"%s\", u'line': %dL, u'crawl': %d, u'section': None}]}, u'ok': True}",
                           "_id", "pub_date", "line_no", "file_no")
    m.select("company", F.col("file_no").alias("crawl"), line.alias("value")).write.partitionBy("company", "crawl").text(path)
    found = S.literal_docs(spark.read.option("basePath", path).text(path), "value", "_id: string, pub_date: string, line: string, crawl: string")
    return TX.dedup_articles(found.select("company", F.col("d._id").alias("_id"), F.col("d.pub_date").alias("pub_date"),
                                          F.col("d.crawl").cast("int").alias("file_no"), F.col("d.line").cast("long").alias("line_no"))
                             ).select("_id", "company", "pub_date", "file_no", "line_no")


@query("run_log_tables", ORACLE["accuracy"].replace(
    "SELECT run_id, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM preds GROUP BY run_id",
    ", acc AS (SELECT run_id, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM preds GROUP BY run_id),\n"
    "lay AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {k}, '{v}')" for r, k, v in RUN_LOG_LAYOUT) +
    ") t(run_id, k, variant))\n"
    "SELECT k, max(CASE WHEN variant = 'change only' THEN accuracy END) AS change,\n"
    "       max(CASE WHEN variant <> 'change only' THEN accuracy END) AS dist\n"
    "FROM acc JOIN lay USING (run_id) GROUP BY k", 1))
def q_run_log_tables(spark, sf_dir):
    """S16 + P6 + A12: run accuracies written as a result log in the reference's line
    format, read back, parsed by regex and pivoted to 'change only' vs 'change + topic
    distribution' per k."""
    from pricewire.operators import evaluate as E
    from pricewire.operators import runlogs as RL
    from pricewire.plans.q_eval import preds
    acc = E.accuracy(preds(spark, sf_dir))
    lay = spark.createDataFrame(RUN_LOG_LAYOUT, "run_id string, k int, variant string")
    line = F.concat(F.lit("[Topic] k="), F.col("k").cast("string"), F.lit(",  "), F.col("variant"),
                    F.lit(" \t[Accuracy] train: "), F.format_string("%.6f", "accuracy"),
                    F.lit(" \ttest: "), F.format_string("%.6f", "accuracy"))
    path = _folder(spark, "runlog")
    acc.join(F.broadcast(lay), "run_id").select(line.alias("value")).write.text(path)
    log = S.src_run_log(spark, path)
    return RL.pivot_change_vs_dist(log).select(F.col("k").cast("int").alias("k"), "change", "dist")


@query("libsvm_roundtrip", ORACLE["topic_libsvm"].split("SELECT l.doc_id AS doc_idx")[0] + """
SELECT row_number() OVER (ORDER BY l.doc_id) - 1 AS row_idx, CAST(l.quality AS DOUBLE) AS label,
       CAST(len(t.topic) AS INTEGER) AS n_features,
       round(list_sum(list_transform(t.topic, lambda v: CAST(printf('%.6f', v) AS DOUBLE))), 6) AS total
FROM labels l JOIN topics_n t ON t.doc_idx = l.doc_id""")
def q_libsvm_roundtrip(spark, sf_dir):
    """K7 + S12: topic features written as LIBSVM lines and parsed back
    (line number, label, number of pairs, sum of values per line)."""
    from pricewire.operators import topics as TP
    lab = T.class_labels(spark, sf_dir).select("doc_idx", F.col("quality").alias("label"))
    path = _folder(spark, "libsvm")
    K.sink_libsvm(TP.topic_libsvm(lab, T.topics(spark, sf_dir)), path)
    back = S.src_libsvm(spark, path)
    vals = F.map_values("features")
    return rounded(back.select("row_idx", "label", F.size("features").alias("n_features"),
                               F.aggregate(vals, F.lit(0.0), lambda a, v: a + v).alias("total")))


@query("price_samples_roundtrip", q_prices._SERIES_SQL + f"""
SELECT company, date, doc_idx, round(next_open, 6) AS next_open, 0 AS split,
  {S_.lag_cols('open', T.N_PREV, 'open_', q_prices.W, default=0, rnd=6, start=0)},
  CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label
FROM series
QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})""")
def q_price_samples_roundtrip(spark, sf_dir):
    """K6 (price mode) + S13: price samples written as 26-column CSV and read back."""
    s = q_prices.labelled_samples(spark, sf_dir)
    flat = flatten(s.select("company", F.col("date").cast("string").alias("date"), "doc_idx", "next_open",
                            "opens", "label", F.lit(0).alias("split")), "opens", T.N_PREV, "open_", start=0)
    cols = ["company", "date", "doc_idx", "next_open", *[f"open_{i}" for i in range(T.N_PREV)], "label", "split"]
    path = _folder(spark, "pricesamples")
    flat.select(*cols).write.csv(path, nullValue="nan")
    back = S.src_price_samples(spark, path)
    return rounded(flatten(back, "opens", T.N_PREV, "open_", start=0))
