"""Corpus operators: cleaning, word counts, vocabulary, doc-term table.

Documents are processed whole.  Per-term work is done in long form
``(doc_idx, pos, term)`` so that a join with the vocabulary is an ordinary
(broadcast-checked or shuffled) equi-join instead of an ``array_contains``
against a big literal, and word counts are a partial/final aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewire.functions import text as X
from pricewire.operators.common import checked_broadcast, exact_rank

# Terms kept by default in a frequency vocabulary (reference default).
DEFAULT_VOCAB_SIZE = 50_000


def clean_corpus(coll: DataFrame, text_col: str = "text", drop_empty: bool = True) -> DataFrame:
    """T1 + T5 + P5: ``clean`` text and ``tokens``; empty cleaned documents dropped."""
    src = coll.where(X.has_clean_text(text_col)) if drop_empty else coll
    return src.withColumn("clean", X.clean_text(text_col)).withColumn("tokens", X.tokenize("clean"))


def token_rows(docs: DataFrame, tokens_col: str = "tokens", keys=("doc_idx",)) -> DataFrame:
    """Long form ``(keys..., pos, term)`` of a token array.

    ``posexplode_outer`` + a filter on the generated column: a plain
    ``posexplode`` makes the optimiser infer ``size(tokens) > 0`` and push it
    below the projections, which copies the whole cleaning / tokenising chain
    into that filter and runs it again."""
    out = docs.select(*keys, F.posexplode_outer(tokens_col).alias("pos", "term"))
    return out.where(F.col("pos").isNotNull())


def word_freq(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """A5: ``(term, freq)`` over all documents (map-side partial counts)."""
    terms = docs.select(F.explode_outer(tokens_col).alias("term")).where(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def vocab_topk(freq: DataFrame, size: int | None = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """V1/V2: ``(term, idx, freq)``; idx = rank by (freq desc, term asc).

    With a size, the top ``size`` rows are taken first (each task keeps its own
    top ``size``), then numbered.  Without one every term is numbered by an
    exact distributed rank whose cells are (freq, first two letters of the term).
    """
    order = [F.col("freq").desc(), F.col("term").asc()]
    if size is not None:
        top = freq.orderBy(*order).limit(size)
        # bounded by ``size`` rows: a single ordered window is fine here
        return top.withColumn("idx", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return exact_rank(freq, order, [("_f", F.col("freq"), False), ("_p", F.substring("term", 1, 2), True)],
                      out="idx")


def vocab_coverage(freq: DataFrame, vocab: DataFrame) -> DataFrame:
    """Share of all tokens covered by the vocabulary (one row)."""
    v = vocab.select("term", F.lit(1).alias("_in"))
    j = freq.join(v, "term", "left")
    return j.agg(F.try_divide(F.sum(F.when(F.col("_in") == 1, F.col("freq")).otherwise(0)).cast("double"),
                              F.sum("freq").cast("double")).alias("coverage"),
                 F.sum("freq").cast("long").alias("total_tokens"),
                 F.count(F.col("_in")).cast("long").alias("vocab_terms"))


def _vocab_side(vocab: DataFrame, bound: int | None) -> DataFrame:
    return checked_broadcast(vocab.select("term", "idx"), bound)


def _by_document(docs: DataFrame, bound: int | None) -> DataFrame:
    """Before a broadcast join the documents are placed by id as whole word arrays: the words then stay with their
    document through the join, and regrouping them moves no word.  (A shuffled join would undo the placing.)"""
    return docs if bound is None else docs.repartition("doc_idx")


def filter_vocab(docs: DataFrame, vocab: DataFrame, keys=("doc_idx",), bound: int | None = None) -> DataFrame:
    """Per document, the in-vocabulary tokens in order (repeats kept), long form
    ``(keys..., pos, term, idx)``.  ``bound`` = the vocabulary's size limit, when
    it has one (then it is broadcast)."""
    return token_rows(docs, keys=keys).join(_vocab_side(vocab, bound), "term", "inner")


def raw_corpus(docs: DataFrame, vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """K3: ``(doc_idx, company, date, text)`` with only vocabulary words, space separated.

    Documents without any vocabulary word keep an empty text (left join).
    The regroup is by document, so a task holds one document at a time.
    """
    docs = _by_document(docs, bound)
    kept = filter_vocab(docs, vocab, bound=bound)
    grouped = (kept.groupBy("doc_idx")
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_t")))
    text = F.coalesce(F.array_join(F.transform("_t", lambda s: s["term"]), " "), F.lit(""))
    return (docs.select("doc_idx", "company", "date").join(grouped, "doc_idx", "left")
                .select("doc_idx", "company", "date", text.alias("text")))


def doc_term(docs: DataFrame, vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """A6 (long form): ``(doc_idx, idx, freq)`` per document and vocabulary index."""
    docs = _by_document(docs, bound)
    return filter_vocab(docs, vocab, bound=bound).groupBy("doc_idx", "idx").agg(F.count(F.lit(1)).alias("freq"))


def doc_term_summary(docs: DataFrame, vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """Number of distinct vocabulary words per document (0 when none)."""
    n = doc_term(docs, vocab, bound).groupBy("doc_idx").agg(F.count(F.lit(1)).alias("n_unique"))
    return (docs.select("doc_idx").join(n, "doc_idx", "left")
                .select("doc_idx", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique")))


def doc_term_lines(docs: DataFrame, vocab: DataFrame, bound: int | None = None) -> DataFrame:
    """K4: ``{n_unique} {idx:freq} ...`` per document, ascending idx; empty doc gives ``0 ``."""
    docs = _by_document(docs, bound)
    g = (filter_vocab(docs, vocab, bound=bound).groupBy("doc_idx")
         .agg(F.sort_array(F.collect_list("idx")).alias("_a")))
    # equal indices are neighbours: a run's length is the distance from its start to the next one's
    places = F.sequence(F.lit(0), F.size("_a") - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("_a", i) != F.get("_a", i - 1)))
    g = g.select("doc_idx", "_a", starts.alias("_s"))
    pairs = F.transform("_s", lambda p, j: F.concat(F.get("_a", p).cast("string"), F.lit(":"),
                                                    (F.coalesce(F.get("_s", j + 1), F.size("_a")) - p).cast("string"), F.lit(" ")))
    line = F.concat(F.size("_s").cast("string"), F.lit(" "), F.array_join(pairs, ""))
    return (docs.select("doc_idx").join(g, "doc_idx", "left")
                .select("doc_idx", F.when(F.col("_s").isNull(), F.lit("0 ")).otherwise(line).alias("line")))


# --------------------------------------------------------------------------- articles
def dedup_articles(meta: DataFrame, key: str = "_id", order=("file_no", "line_no")) -> DataFrame:
    """A1: the first row (by file, then line) of every ``_id`` — deterministic,
    and a partial ``min_by`` aggregate rather than a sort of all rows."""
    others = [c for c in meta.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return meta.groupBy(key).agg(first.alias("_r")).select(key, "_r.*")


def distinct_texts(text: DataFrame) -> DataFrame:
    """A2: distinct (``_id``, text) rows."""
    return text.select("_id", "text").distinct()


def join_meta_text(meta: DataFrame, text: DataFrame) -> DataFrame:
    """Deduplicated metadata joined with distinct texts on ``_id``."""
    return dedup_articles(meta).join(distinct_texts(text), "_id", "inner")


def day_articles(articles: DataFrame, order=("file_no", "line_no")) -> DataFrame:
    """A3 (long form): articles of each (company, day) numbered 0.. in source order.

    The day list is kept as ordered rows instead of one collected array, so a
    (company, day) holding a huge share of the articles is never gathered into
    one task; the order comes from an exact distributed rank whose cells are
    (file, block of 4096 lines).
    """
    return exact_rank(articles, [F.col(c) for c in order],
                      [("_f", F.col(order[0]), True), ("_b", F.floor(F.col(order[1]) / 4096), True)],
                      partition_by=("company", "date"), out="ord")
