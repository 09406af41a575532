"""Feature sweep with text (M8): word, n-gram, tf-idf, price and topic blocks side by side in one sparse vector.

A block is a vector column of a known width.  Text becomes a sparse count vector per *document* and is joined to the samples
that use it, so a day's article is tokenised once however many symbols share it.  All vectors are built by ``pyspark.ml``
stages: counts by a ``CountVectorizerModel`` over the vocabulary learned on train, tf-idf as counts times the smoothed idf of
train, at unit length, and ``VectorAssembler`` puts blocks side by side without making sparse ones dense.

Defined cases: a sample without text (or without a document) has a zero text block; documents come once per id; a vocabulary without any term fails, as it does in the
reference's vectoriser, but no samples at all have blocks of no term; a block is of one width for all rows (others fail the job).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.functions import text as X
from pricewire.operators import models as M
from pricewire.operators import terms as O
from pricewire.session import cut_lineage

SWEEP_TOLERANCE = 1e-4  # relative gain at which a fit of the sweep ends
SWEEP_ITERATIONS = 60   # per fit; the result says how many each took


def _sized(df: DataFrame, col: str, width: int) -> DataFrame:
    """The vector column with its width as metadata and nothing else (a count vectoriser would attach every term)."""
    bare = df.withColumn(col, F.col(col).alias(col, metadata={}))
    return VectorSizeHint(inputCol=col, size=width, handleInvalid="error").transform(bare)


def dense_block(df: DataFrame, array_col: str, out: str, width: int) -> DataFrame:
    """An ``array<double>`` column of ``width`` entries as a block."""
    return _sized(df.withColumn(out, array_to_vector(F.col(array_col))), out, width)


def text_block(samples: DataFrame, docs: DataFrame, out: str, ngram_max: int = 1, max_features: int = 100_000,
               doc_col: str = "doc_idx", text_col: str = "text", train_col: str = "train") -> tuple[DataFrame, int]:
    """F1 / F2 as a block: counts of the 1..``ngram_max``-grams of each sample's document; returns the samples with the
    vector column ``out``, and its width.

    The vocabulary holds the ``max_features`` commonest terms of the train samples (a document counts once per train
    sample that uses it), in alphabetical order.  It is bounded by that number, which is why it may reach the driver."""
    used = samples.groupBy(doc_col).agg(F.count_if(train_col).alias("_uses")).withColumnRenamed(doc_col, "_doc")
    texts = docs.select(F.col(doc_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = used.join(texts, F.col("_doc") == F.col("_id"), "left").select("_doc", "_uses", F.coalesce("_text", F.lit("")).alias("_text"))
    toks = cut_lineage(rows.select("_doc", "_uses", X.vector_tokens("_text").alias("_toks")))
    grams = toks.select("_doc", "_uses", (X.ngrams("_toks", ngram_max) if ngram_max > 1 else F.col("_toks")).alias("_terms"))
    counts = grams.where("_uses > 0").select(F.explode_outer("_terms").alias("term"), F.col("_uses").alias("cnt")).where("term IS NOT NULL")
    terms = [r.term for r in O.learn_vocab(counts, max_features).orderBy("idx").collect()]
    if not terms:
        if not samples.isEmpty():
            raise ValueError("empty vocabulary")
        return _sized(samples.withColumn(out, array_to_vector(F.array().cast("array<double>"))), out, 0), 0
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol=out)
    vectors = model.transform(grams).select("_doc", F.col(out).alias(out, metadata={}))
    joined = samples.join(vectors, F.col(doc_col).eqNullSafe(F.col("_doc")), "inner").drop("_doc")
    return _sized(joined, out, len(terms)), len(terms)


def tfidf_block(samples: DataFrame, counts_col: str, out: str, width: int, train_col: str = "train") -> DataFrame:
    """F3 as a block: ``tf * (ln((1 + n) / (1 + df)) + 1)`` at unit length, ``n`` and ``df`` over the train samples."""
    if not width:
        return _sized(samples.withColumn(out, F.col(counts_col)), out, 0)
    train = samples.where(F.col(train_col)).select(counts_col)
    idf = np.zeros(width) if train.isEmpty() else np.asarray(IDF(inputCol=counts_col, outputCol="_w").fit(train).idf.toArray())
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol=counts_col, outputCol="_w")
    unit = Normalizer(p=2.0, inputCol="_w", outputCol=out)
    return _sized(unit.transform(weigh.transform(samples)).drop("_w"), out, width)


def side_by_side(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """F10 for blocks: one vector, sparse where that is smaller."""
    return VectorAssembler(inputCols=list(blocks), outputCol=out, handleInvalid="error").transform(df)


def sweep_columns(spark: SparkSession, data: DataFrame, sets: Sequence[tuple[str, Sequence[str]]], widths: Mapping[str, int],
                  text: Sequence[str] = (), train_col: str = "train") -> DataFrame:
    """What each combination holds: ``(features, n_features, train_rows, test_rows, text_entries)``, measured on the
    assembled vectors; ``text_entries`` counts the entries other than zero in the blocks named in ``text`` (they come first)."""
    def one(item):
        name, blocks = item
        s = Summarizer.metrics("count", "numNonZeros")
        rows = side_by_side(data, blocks).groupBy(train_col).agg(s.summary(F.col("features")).alias("s")).select(train_col, "s.*").collect()
        by = {r[train_col]: r for r in rows}
        first = sum(widths[b] for b in blocks if b in text)
        size = max((len(r.numNonZeros) for r in rows), default=sum(widths[b] for b in blocks))
        entries = sum(int(r.numNonZeros.toArray()[:first].sum()) for r in rows)
        return name, size, *(int(by[t]["count"]) if t in by else 0 for t in (True, False)), entries
    with M.cached(data) as (data,):
        rows = M.grid_map(one, sets)
    return spark.createDataFrame(rows, "features string, n_features long, train_rows long, test_rows long, text_entries long")


def sweep_fits(spark: SparkSession, data: DataFrame, sets: Sequence[tuple[str, Sequence[str]]], label: str = "label",
               train_col: str = "train", C: float = 1.0, max_iter: int = SWEEP_ITERATIONS, tol: float = SWEEP_TOLERANCE) -> DataFrame:
    """M8: one logistic fit per combination over the same blocks: ``(features, iterations, train_acc, test_acc)``.  A fit
    that took ``max_iter`` iterations may have stopped short of its optimum."""
    def one(item):
        name, blocks = item
        a = side_by_side(data, blocks)
        model, train_acc, test_acc = M.fit_logistic(a.where(F.col(train_col)), a.where(~F.col(train_col)), C, label=label,
                                                    max_iter=max_iter, tol=tol)
        return name, int(model.summary.totalIterations) if model else 0, train_acc, test_acc
    with M.cached(data) as (data,):
        rows = M.grid_map(one, sets)
    return spark.createDataFrame(rows, "features string, iterations int, train_acc double, test_acc double")
