"""Term features and scores.

Everything is long form ``(row_idx, term, cnt)`` until a model needs a
vector.  Vocabularies are small tables (bounded by ``max_features`` or the
score file's ``top_k``), and only such are broadcast.  Scores
avoid the documents x classes cross product:

* chi^2 per term uses ``sum_c (O-E)^2/E = (1/F) * sum_{c: O>0} O^2/p_c - F``,
  so only (term, class) cells that occur are touched.
* mutual information derives the zero-count cells from class totals and the
  number of documents containing the term, never from a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import CountVectorizerModel

from pricewire.functions import text as X
from pricewire.operators.common import checked_broadcast, exact_rank


def doc_term_counts(docs: DataFrame, text_col: str = "text", ngram_max: int = 1,
                    keys=("row_idx",)) -> DataFrame:
    """``(keys..., term, cnt)``: vectoriser tokens (T6) and their 1..n-grams.

    Whole texts are placed by their keys first, so that counting moves no term."""
    # tokens are materialised once as a column; the n-gram builder refers to them
    # several times per element and must not re-run the regex each time
    toks = docs.select(*keys, text_col).repartition(*keys).select(*keys, X.vector_tokens(text_col).alias("_toks"))
    grams = X.ngrams("_toks", ngram_max) if ngram_max > 1 else F.col("_toks")
    # explode_outer: a plain explode lets the optimiser copy the token/n-gram
    # expressions into an inferred size filter (computed twice)
    terms = toks.select(*keys, F.explode_outer(grams).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("cnt"))


def vocab_term_counts(docs: DataFrame, vocab: DataFrame, text_col: str = "text", ngram_max: int = 1, keys=("row_idx",),
                      bound: int | None = None) -> DataFrame:
    """F1/F2 from texts: ``(keys..., idx, cnt)`` of the vocabulary's terms.  A bounded vocabulary is broadcast and joined before
    the counting, so neither the other terms nor any term of a text is stored or moved."""
    toks = docs.select(*keys, text_col).repartition(*keys).select(*keys, X.vector_tokens(text_col).alias("_toks"))
    grams = X.ngrams("_toks", ngram_max) if ngram_max > 1 else F.col("_toks")
    terms = toks.select(*keys, F.explode_outer(grams).alias("term")).where(F.col("term").isNotNull())
    found = terms.join(checked_broadcast(vocab.select("term", "idx"), bound), "term", "inner")
    return found.groupBy(*keys, "idx").agg(F.count(F.lit(1)).alias("cnt"))


def term_totals(docs: DataFrame, text_col: str = "text", ngram_max: int = 1) -> DataFrame:
    """``(term, cnt)`` over all texts, added up before they are moved; for ``learn_vocab``."""
    toks = docs.select(X.vector_tokens(text_col).alias("_toks"))
    grams = X.ngrams("_toks", ngram_max) if ngram_max > 1 else F.col("_toks")
    return (toks.select(F.explode_outer(grams).alias("term")).where(F.col("term").isNotNull())
            .groupBy("term").agg(F.count(F.lit(1)).alias("cnt")))


def learn_vocab(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """F1/F2 vocabulary ``(term, idx)``: the ``max_features`` terms with the highest
    total count (ties by term), numbered alphabetically, as a count vectoriser does."""
    tot = counts.groupBy("term").agg(F.sum("cnt").alias("_tot"))
    if max_features is not None:
        tot = tot.orderBy(F.col("_tot").desc(), F.col("term").asc()).limit(max_features)
    return exact_rank(tot.select("term"), [F.col("term")], [("_b", F.substring("term", 1, 2), True)], out="idx")


# Scores are ordered after rounding to this many digits, so that equal scores
# summed in a different order still tie (and break ties by term).
SCORE_DIGITS = 9


def _score_key():
    return F.round(F.col("score"), SCORE_DIGITS)


def given_vocab(scores: DataFrame, top_k: int) -> DataFrame:
    """S19 + F7: the first ``top_k`` terms of a score table (score desc, term desc);
    idx = position in that order."""
    order = [_score_key().desc(), F.col("term").desc()]
    top = scores.orderBy(*order).limit(top_k)
    # bounded by top_k rows: one ordered window is fine here
    return top.select("term", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("idx"))


def bow_counts(counts: DataFrame, vocab: DataFrame, keys=("row_idx",), bound: int | None = None) -> DataFrame:
    """``(keys..., idx, cnt)`` restricted to the vocabulary (broadcast when
    its size is bounded: ``max_features`` / ``top_k``)."""
    v = checked_broadcast(vocab.select("term", "idx"), bound)
    return counts.join(v, "term", "inner").select(*keys, "idx", "cnt")


def tfidf(bow: DataFrame, docs: DataFrame, fit_where=None, keys=("row_idx",),
          group_col: str | None = None) -> DataFrame:
    """``tf * (ln((1+n)/(1+df)) + 1)``, then unit L2 length per document.

    ``n`` counts every fitted document, also those without a vocabulary term.
    ``fit_where`` (a Column on ``docs``) selects the fitting documents (default
    all).  With ``group_col`` the IDF is fitted per group (e.g. per split,
    the reference's re-fit, Q7).
    """
    g = [group_col] if group_col else []
    fit_docs = docs if fit_where is None else docs.where(fit_where)
    fit_bow = bow.join(fit_docs.select(*keys, *g), list(keys) + g, "left_semi")
    df_ = fit_bow.groupBy(*g, "idx").agg(F.count(F.lit(1)).alias("_df"))
    if g:
        n = fit_docs.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        idf = df_.join(F.broadcast(n), g)       # one row per group
    else:
        idf = df_.withColumn("_n", F.lit(fit_docs.count()))   # one scalar
    idf = idf.select(*g, "idx", (F.log((F.col("_n") + 1) / (F.col("_df") + 1)) + 1).alias("_idf"))
    b = bow.join(docs.select(*keys, *g), list(keys), "inner") if g else bow
    w = b.join(idf, [*g, "idx"], "inner").withColumn("_w", F.col("cnt") * F.col("_idf"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norm, list(keys)).select(*keys, "idx", (F.col("_w") / F.col("_norm")).alias("value"))


def _class_table(docs: DataFrame, label_col: str) -> DataFrame:
    return docs.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))


def chi2_scores(counts: DataFrame, docs: DataFrame, label_col: str = "label",
                term_col: str = "term", keys=("row_idx",)) -> DataFrame:
    """per term ``sum_c (O_c - E_c)^2 / E_c``; ``O_c`` = summed counts in class c,
    ``E_c`` = class share x the term's total count."""
    classes = _class_table(docs, label_col)
    labelled = counts.join(docs.select(*keys, label_col), list(keys), "inner")
    obs = labelled.groupBy(term_col, label_col).agg(F.sum("cnt").cast("double").alias("_o"))
    # class shares by a window over the (few-row) class table
    cls = F.broadcast(classes.select(label_col, (F.col("_nc") / F.sum("_nc").over(Window.partitionBy()))
                                     .alias("_p")))
    cells = obs.join(cls, label_col, "inner")
    per_term = cells.groupBy(term_col).agg(F.sum(F.col("_o") * F.col("_o") / F.col("_p")).alias("_s"),
                                           F.sum("_o").alias("_f"))
    return per_term.select(term_col, (F.col("_s") / F.col("_f") - F.col("_f")).alias("score"))


def mi_scores(counts: DataFrame, docs: DataFrame, label_col: str = "label",
              term_col: str = "term", keys=("row_idx",)) -> DataFrame:
    """mutual information (nats) between a term's count in a document and the
    label, counts treated as discrete values (zero included), clipped at 0."""
    classes = _class_table(docs, label_col)
    labelled = counts.join(docs.select(*keys, label_col), list(keys), "inner")
    cells = labelled.groupBy(term_col, "cnt", label_col).agg(F.count(F.lit(1)).cast("double").alias("_nvc"))
    # class sizes and the total by a window over the (few-row) class table
    cls = F.broadcast(classes.withColumn("_N", F.sum("_nc").over(Window.partitionBy())))
    # non-zero count values
    nv = cells.groupBy(term_col, "cnt").agg(F.sum("_nvc").alias("_nv"))
    pos = (cells.join(nv, [term_col, "cnt"]).join(cls, label_col)
           .select(term_col, (F.col("_nvc") / F.col("_N") *
                              F.log(F.col("_nvc") * F.col("_N") / (F.col("_nv") * F.col("_nc")))).alias("_mi")))
    # zero cells: per (term, present class) n_0c = N_c - docs of c with the term
    seen = cells.groupBy(term_col, label_col).agg(F.sum("_nvc").alias("_s"))
    dt = seen.groupBy(term_col).agg(F.sum("_s").alias("_dt"))
    z = (seen.join(dt, term_col).join(cls, label_col)
         .withColumn("_n0", F.col("_N") - F.col("_dt"))
         .withColumn("_n0c", F.col("_nc") - F.col("_s")))
    zero_present = z.where(F.col("_n0c") > 0).select(
        term_col, (F.col("_n0c") / F.col("_N") * F.log(F.col("_n0c") * F.col("_N") /
                                                         (F.col("_n0") * F.col("_nc")))).alias("_mi"))
    # classes in which the term never occurs: all their documents are zero cells
    absent = (z.groupBy(term_col, "_N", "_n0").agg(F.sum("_nc").alias("_np"))
               .where((F.col("_N") > F.col("_np")) & (F.col("_n0") > 0))
               .select(term_col, ((F.col("_N") - F.col("_np")) / F.col("_N") *
                                  F.log(F.col("_N") / F.col("_n0"))).alias("_mi")))
    parts = pos.unionByName(zero_present).unionByName(absent)
    return parts.groupBy(term_col).agg(F.greatest(F.sum("_mi"), F.lit(0.0)).alias("score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """the ``k`` best terms (ties: later term first, as a stable ascending
    sort keeping the last k does), renumbered alphabetically: ``(term, idx, score)``."""
    top = scores.orderBy(_score_key().desc(), F.col("term").desc()).limit(k)
    # bounded by k rows: one ordered window is fine here
    return top.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("idx"), "score")


def order_by_score(scores: DataFrame) -> DataFrame:
    """V3: terms ranked by (score, term) descending, as written to a score file."""
    return exact_rank(scores, [_score_key().desc(), F.col("term").desc()],
                      [("_b", F.floor(_score_key() * 10_000), False)], out="rank")


def to_count_vectorizer(vocab: DataFrame, input_col: str = "terms", output_col: str = "features"):
    """Vector form for ``pyspark.ml``: a ``CountVectorizerModel`` over the (small)
    vocabulary, terms placed at their ``idx``."""
    terms = [r["term"] for r in vocab.orderBy("idx").select("term").collect()]
    return CountVectorizerModel.from_vocabulary(terms, inputCol=input_col, outputCol=output_col)
