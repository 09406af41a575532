"""Single-operator queries for inventory items whose work also appears inside a
larger query (each with its own projection and oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.functions import prices as P
from pricewire.functions import text as X
from pricewire.functions import vectors as V
from pricewire.operators import evaluate as E
from pricewire.operators import text as TX
from pricewire.operators import topics as TP
from pricewire.plans import sql as S
from pricewire.plans.base import ORACLE, query, rounded
from pricewire.plans.q_eval import _CELLS, _COUNTS, _PR, _PREDS, preds
from pricewire.plans.q_prices import _SERIES_SQL, _series, labelled_samples
from pricewire.sources import tables as T

_LAB = f"doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})"


def _one_label(name, sql_expr, col_fn):
    @query(name, _SERIES_SQL + f"SELECT symbol, date, {sql_expr} AS {name} FROM series")
    def q(spark, sf_dir):
        return _series(spark, sf_dir).select("symbol", "date", col_fn(F.col("change")).alias(name))
    q.__doc__ = f"{name} on every mapped trading day."
    return q


_one_label("significant", f"CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END",
           lambda c: P.significant(c, T.SIG_PCT))
_one_label("insignificant", f"CASE WHEN abs(change) <= {T.INSIG_PCT} THEN 1 ELSE 0 END",
           lambda c: P.insignificant(c, T.INSIG_PCT))
_one_label("direction_multiclass",
           f"CASE WHEN abs(change) >= {T.MC_PCT} AND change > 0 THEN 1 WHEN abs(change) >= {T.MC_PCT} THEN -1 ELSE 0 END",
           lambda c: P.direction_multiclass(c, T.MC_PCT))
_one_label("trend", f"CASE WHEN abs(change) >= {T.SIG_PCT} THEN CAST(change > 0 AS INTEGER) END",
           lambda c: P.trend(c, T.SIG_PCT))


@query("filter_covered", _SERIES_SQL + "SELECT company, date, doc_idx FROM series WHERE doc_idx IS NOT NULL")
def q_filter_covered(spark, sf_dir):
    """Mapped symbols' trading days of companies and dates that have documents."""
    return _series(spark, sf_dir).where(F.col("doc_idx").isNotNull()).select("company", "date", "doc_idx")


@query("filter_labelled", _SERIES_SQL + f"SELECT company, date, doc_idx, round(change, 6) AS change FROM series WHERE {_LAB}")
def q_filter_labelled(spark, sf_dir):
    """Significant plus insignificant days (the rows that get a label)."""
    return rounded(labelled_samples(spark, sf_dir).select("company", "date", "doc_idx", "change"))


@query("filter_empty_docs", S.with_(S.COLLECTION) + f"""
SELECT doc_idx, CAST(length({S.clean_text('text')}) AS INTEGER) AS clean_chars FROM coll
WHERE length({S.clean_text('text')}) > 0""")
def q_filter_empty_docs(spark, sf_dir):
    """P5: documents whose cleaned text is not empty."""
    c = T.collection(spark, sf_dir).select("doc_idx", X.clean_text("text").alias("clean"))
    return c.where(F.length("clean") > 0).select("doc_idx", F.length("clean").alias("clean_chars"))


@query("project_date_text", ORACLE["join_meta_text"].replace(
    "SELECT m._id, m.company, CAST(", "SELECT CAST(", 1))
def q_project_date_text(spark, sf_dir):
    """The (publication day, text) pairs of the joined articles."""
    j = TX.join_meta_text(T.article_meta(spark, sf_dir), T.article_text(spark, sf_dir))
    return j.select(X.pub_day("pub_date").alias("date"), F.md5("text").alias("text_md5"))


@query("union_symbols", S.with_(S.PRICES) + """
SELECT symbol, date, round(open, 6) AS open, round(close, 6) AS close FROM prices""")
def q_union_symbols(spark, sf_dir):
    """Every symbol's daily series in one table (one scan, no per-symbol append)."""
    return rounded(T.prices(spark, sf_dir))


_SAMP = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, S.TOPICS, S.TOPICS_LONG,
                f"samp AS (SELECT symbol, date, doc_idx FROM series WHERE {_LAB})")


@query("join_topic", _SAMP + """
SELECT s.symbol, s.date, s.doc_idx, CAST(t.i - 1 AS INTEGER) AS i, round(t.v, 6) AS v
FROM samp s JOIN topics_long t ON t.doc_idx = s.doc_idx""")
def q_join_topic(spark, sf_dir):
    """Each labelled sample with its document's topic vector (long form)."""
    s = labelled_samples(spark, sf_dir).select("symbol", "date", "doc_idx")
    t = TP.topics_long(T.topics(spark, sf_dir))
    return rounded(s.join(t, "doc_idx").select("symbol", "date", "doc_idx", "i", "v"))


@query("join_corpus_text", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, S.CLEAN_DOCS) + f"""
SELECT s.symbol, s.date, s.doc_idx, CAST(len(t.tokens) AS BIGINT) AS n_tokens
FROM series s JOIN toks t ON t.doc_idx = s.doc_idx
WHERE s.doc_idx IS NOT NULL AND (abs(s.change) >= {T.SIG_PCT} OR abs(s.change) <= {T.INSIG_PCT})""")
def q_join_corpus_text(spark, sf_dir):
    """Each labelled sample with its document's tokens (count shown)."""
    from pricewire.plans.q_text import corpus
    s = labelled_samples(spark, sf_dir).select("symbol", "date", "doc_idx")
    c = corpus(spark, sf_dir).select("doc_idx", F.size("tokens").cast("long").alias("n_tokens"))
    return s.join(c, "doc_idx").select("symbol", "date", "doc_idx", "n_tokens")


@query("join_positional", _PREDS + """
SELECT a.row_idx, a.label, b.prediction FROM
  (SELECT row_idx, label FROM preds WHERE run_id = 'change_a') a
  JOIN (SELECT row_idx, prediction FROM preds WHERE run_id = 'hist_a') b USING (row_idx)""")
def q_join_positional(spark, sf_dir):
    """True labels of one file paired with predictions of another by row index."""
    p = preds(spark, sf_dir)
    a = p.where(F.col("run_id") == "change_a").select("row_idx", "label")
    b = p.where(F.col("run_id") == "hist_a").select("row_idx", "prediction")
    return a.join(b, "row_idx")


@query("macro_f1", _PREDS + ", " + _CELLS + ", " + _COUNTS + ", " + _PR + """
SELECT run_id, round(avg(f1), 6) AS f1_all, round(avg(CASE WHEN cls IN (-1, 1) THEN f1 END), 6) AS f1_pos_neg
FROM prf GROUP BY run_id""")
def q_macro_f1(spark, sf_dir):
    """Mean F1 over the three classes and over -1 / 1."""
    return rounded(E.macro_f1(preds(spark, sf_dir)))


@query("f_beta", _PREDS + ", " + _CELLS + ", " + _COUNTS + ", " + _PR + """
SELECT run_id, cls, round(f1, 6) AS f1, round(f05, 6) AS f05, round(f2, 6) AS f2 FROM prf""")
def q_f_beta(spark, sf_dir):
    """F1, F0.5 and F2 per run and class."""
    return rounded(E.precision_recall(preds(spark, sf_dir)).select("run_id", "cls", "f1", "f05", "f2"))


@query("vector_combine", S.with_(S.TOPICS, """pairs AS (
  SELECT a.doc_idx, a.topic AS x, b.topic AS y FROM topics_n a JOIN topics_n b ON b.doc_idx = a.doc_idx + 1)""") + """
SELECT doc_idx, CAST(j - 1 AS INTEGER) AS j, round(x[j] + y[j], 6) AS added, round(x[j] - y[j], 6) AS subtracted,
       round(list_concat(x, y)[j], 6) AS concat_head, round(list_concat(x, y)[j + len(x)], 6) AS concat_tail
FROM pairs, range(1, len(x) + 1) r(j)""")
def q_vector_combine(spark, sf_dir):
    """Add, subtract and concatenate topic vectors (each document with the next one)."""
    t = T.topics(spark, sf_dir).select("doc_idx", "topic")
    nxt = t.select((F.col("doc_idx") - 1).alias("doc_idx"), F.col("topic").alias("y"))
    j = t.join(nxt, "doc_idx").select("doc_idx", F.col("topic").alias("x"), "y")
    c = j.select("doc_idx", V.vec_add("x", "y").alias("a"), V.vec_sub("x", "y").alias("s"),
                 V.vec_concat("x", "y").alias("c"), F.size("x").alias("k"))
    out = c.select("doc_idx", F.posexplode("a").alias("j", "added"), "s", "c", "k")
    out = out.select("doc_idx", F.col("j").cast("int").alias("j"), "added",
                     F.col("s")[F.col("j")].alias("subtracted"), F.col("c")[F.col("j")].alias("concat_head"),
                     F.col("c")[F.col("j") + F.col("k")].alias("concat_tail"))
    return rounded(out)


@query("top_coefficients")
def q_top_coefficients(spark, sf_dir):
    """V5: the N largest and N smallest logistic coefficients of a bag-of-words model
    with their terms (vocabulary learned on train)."""
    from pricewire.operators import models as M
    from pricewire.operators import terms as TM
    from pricewire.plans import q_terms as QT
    ds = QT.text_dataset(spark, sf_dir)
    vocab = TM.learn_vocab(QT.train_totals(ds), QT.MAX_FEATURES)
    cv = TM.to_count_vectorizer(vocab, "terms", "features")
    docs = ds.select("row_idx", "split", F.col("label").cast("double").alias("label"),
                     X.vector_tokens("text").alias("terms"))
    v = cv.transform(docs)
    m, _, _ = M.fit_logistic(v.where(F.col("split") == 0), v.where(F.col("split") == 1), 1.0)
    coef = m.coefficients.toArray().tolist()
    terms = cv.vocabulary
    order = sorted(range(len(coef)), key=lambda i: coef[i], reverse=True)
    n = 30
    rows = [("positive", r + 1, terms[i], float(coef[i])) for r, i in enumerate(order[:n])]
    rows += [("negative", r + 1, terms[i], float(coef[i])) for r, i in enumerate(order[::-1][:n])]
    return spark.createDataFrame(rows, "side string, rank int, term string, coefficient double")
