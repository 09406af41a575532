"""Logical inputs built from the provided parquet tables.

The reference reads price CSVs, a symbol map, a document corpus, topic-model
output and label files.  The test tables carry the same shapes; this module
states how each logical input is derived from them, as plain DataFrame
expressions so the optimiser can prune columns and push filters into the
parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.functions.vectors import topic_normalize

# ---------------------------------------------------------------------------
# Fixed values of the binding (see FIXTURES.md part B).
COMPANIES = 20               # a symbol's company = prefix || (user_id modulo this)
UNMAPPED = (50, 49)          # symbols without a company: user_id modulo the first = the second (2 %)
COMPANY_PREFIX = "src"
DOC_EPOCH = "2024-01-01"     # first corpus day
DOCS_PER_DAY = 20            # doc_id div this ...
CORPUS_DAYS = 30             # ... modulo this = day offset
SIG_PCT = 100.0              # significance threshold (percent) for these tables
INSIG_PCT = 25.0             # insignificance threshold (percent)
# The other reference thresholds (percent) scaled by the same factor 100 as the
# significance threshold (1 -> 100), to fit the value range of these tables.
STOCK_SIG_PCT = 200.0        # stock table significance (reference 2)
MC_PCT = 100.0               # up / flat / down threshold (reference 1)
BUFFER_PCT = (20.0, 70.0)    # buffer band (reference 0.2, 0.7)
TOPIC_K = 64                 # topic vector length: the whole embedding
TOPIC_ALPHA = 0.05           # Dirichlet alpha written next to the gammas
N_PREV = 20                  # history length of a labelled sample
# ---------------------------------------------------------------------------

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, date, open, close)``: first and last event value of a user-day.

    A partial (map-side) ``min_by``/``max_by`` aggregate, so a hot user is
    combined before the shuffle.
    """
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").cast("string").alias("symbol"),
                       F.to_date("ts").alias("date"))
              .agg(F.min_by("value", "ts").alias("open"), F.max_by("value", "ts").alias("close")))


def symbol_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, company)``: several symbols share a company, a few have none."""
    ev = table(spark, sf_dir, "events")
    return (ev.select("user_id").distinct().where(F.col("user_id") % UNMAPPED[0] != UNMAPPED[1])
              .select(F.col("user_id").cast("string").alias("symbol"),
                      F.concat(F.lit(COMPANY_PREFIX), (F.col("user_id") % COMPANIES).cast("string")).alias("company")))


def corpus_day(doc_id: Column) -> Column:
    return F.date_add(F.lit(DOC_EPOCH).cast("date"),
                      (F.floor(doc_id / F.lit(DOCS_PER_DAY)) % F.lit(CORPUS_DAYS)).cast("int"))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_idx, company, date, text)``: the news corpus."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("company"),
                    corpus_day(F.col("doc_id")).alias("date"), F.col("text"))


def topic_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, doc_idx, alpha, gamma)``: topic-model output for one k."""
    e = table(spark, sf_dir, "embeddings")
    gamma = F.transform(F.col("embedding"),
                        lambda x: F.abs(x.cast("double")) + F.lit(TOPIC_ALPHA))
    return e.select(F.lit(TOPIC_K).alias("k"), F.col("vec_id").alias("doc_idx"),
                    F.lit(TOPIC_ALPHA).alias("alpha"), gamma.alias("gamma"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, doc_idx, topic)``: normalised topic distribution per document."""
    g = topic_gamma(spark, sf_dir)
    return g.select("k", "doc_idx", topic_normalize("gamma", "alpha").alias("topic"))


def topic_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, company, topic)``: labelled rows in file order for W6/W7."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    t = topics(spark, sf_dir)
    return (e.join(t, e.vec_id == t.doc_idx)
             .select(F.col("vec_id").alias("pos"), F.col("label").cast("string").alias("company"),
                     F.col("doc_idx"), F.col("topic")))


def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_idx, quality, toxic, label3)`` with the three-class label quality - toxic."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("doc_idx"), "quality", "toxic",
                      (F.col("quality") - F.col("toxic")).alias("label3"))


# Fixed rule of the prediction fixture: run -> (divisor, right below, guess divisor).
# A run is right on a document when (doc_idx div divisor) % 10 < right_below,
# otherwise it guesses (doc_idx div guess) % 3 - 1.
PREDICTION_RUNS = [
    ("change_a", 1, 6, 1),
    ("change_b", 10, 7, 3),
    ("hist_a", 3, 5, 7),
    ("hist_b", 7, 8, 11),
]


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, row_idx, label, prediction)`` of four fixed three-class "models"
    over the labelled documents (label = quality - toxic)."""
    lab = class_labels(spark, sf_dir)
    d = F.col("doc_idx")
    out = None
    for run, div, right, guess in PREDICTION_RUNS:
        pred = F.when(F.floor(d / div) % 10 < right, F.col("label3")).otherwise(F.floor(d / guess) % 3 - 1)
        part = lab.select(F.lit(run).alias("run_id"), d.alias("row_idx"), F.col("label3").alias("label"),
                          pred.cast("int").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_idx, label, class3, features array<double>)`` from the embeddings, label = label % 2, class3 = label % 3."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_idx"), (F.col("label") % 2).cast("double").alias("label"),
                    (F.col("label") % 3).alias("class3"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def article_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(company, _id, pub_date, file_no, line_no)`` crawl metadata.

    Every document appears in file 0 with its corpus day; every fourth one is
    repeated in file 1 with the next day, which de-duplication must drop.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    day = corpus_day(F.col("doc_id"))
    first = d.select(F.col("source").alias("company"), F.col("doc_id").cast("string").alias("_id"),
                     F.concat(day.cast("string"), F.lit("T12:00:00Z")).alias("pub_date"),
                     F.lit(0).alias("file_no"), F.col("doc_id").alias("line_no"))
    again = d.where(F.col("doc_id") % 4 == 0).select(
        F.col("source").alias("company"), F.col("doc_id").cast("string").alias("_id"),
        F.concat(F.date_add(day, 1).cast("string"), F.lit("T08:30:00Z")).alias("pub_date"),
        F.lit(1).alias("file_no"), F.col("doc_id").alias("line_no"))
    return first.unionByName(again)


def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(company, _id, text)`` article bodies; every fifth repeated verbatim,
    every seventh also present with a changed text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    base = d.select(F.col("source").alias("company"), F.col("doc_id").cast("string").alias("_id"), "text")
    dup = d.where(F.col("doc_id") % 5 == 0).select(
        F.col("source").alias("company"), F.col("doc_id").cast("string").alias("_id"), "text")
    changed = d.where(F.col("doc_id") % 7 == 0).select(
        F.col("source").alias("company"), F.col("doc_id").cast("string").alias("_id"),
        F.concat("text", F.lit(" (updated)")).alias("text"))
    return base.unionByName(dup).unionByName(changed)
