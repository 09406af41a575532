"""Price series, corpus alignment and labels.

Plan shape (one lazy job):

    prices ──⋈ broadcast(symbol map)──┐
                                        ├─ left ⋈ docs-per-day (pre-aggregated) ─ window W(symbol) ─ filter
    documents ─ groupBy(company,date).max(doc_idx) ┘

Windows run on the daily series, one row per (symbol, trading day), so the
size of a window partition is bounded by the number of trading days of one
symbol, not by the volume of raw events (those are combined map-side when the
daily table is built).  The documents side is reduced to one row per
(company, day) by a partial aggregate before it is shuffled, which also
absorbs a company holding a large share of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewire.functions import prices as P
from pricewire.operators.common import checked_broadcast

SERIES_KEY = "symbol"


def join_symbol_company(prices: DataFrame, symbol_map: DataFrame, strict: bool = False) -> DataFrame:
    """Attach the company of each symbol; unmapped symbols are dropped.

    ``strict=True`` keeps them with a NULL company and fails the job on the
    first one (the stock-table behaviour).  The map has no size bound of its
    own, so the join strategy is left to the planner and AQE (a listing of
    symbols is tiny and becomes a broadcast hash join at runtime).
    """
    m = checked_broadcast(symbol_map.select("symbol", "company"))
    if not strict:
        return prices.join(m, "symbol", "inner")
    out = prices.join(m, "symbol", "left")
    return out.withColumn("company", F.coalesce(
        F.col("company"), F.raise_error(F.concat(F.lit("unmapped symbol "), F.col("symbol")))))


def docs_per_day(docs: DataFrame) -> DataFrame:
    """J3 pre-aggregation: the highest ``doc_idx`` of each (company, date)."""
    return docs.groupBy("company", "date").agg(F.max("doc_idx").alias("doc_idx"))


def price_series(prices: DataFrame, symbol_map: DataFrame, docs: DataFrame | None = None,
                 n_prev: int = 20) -> DataFrame:
    """Daily series with change (L1), change history (W2), open history (W3) and,
    when ``docs`` is given, the day's document and the previous days' documents (J4).

    Columns: symbol, company, date, open, close, next_open, change,
    changes (today + n_prev previous), opens (today + n_prev - 1 previous),
    doc_idx (NULL if no document), prev_doc_idx (n_prev, -1 if none).
    """
    s = join_symbol_company(prices, symbol_map)
    if docs is not None:
        s = s.join(docs_per_day(docs), ["company", "date"], "left")
    w = P.series_window(SERIES_KEY)
    s = (s.withColumn("next_open", F.lead("open", 1).over(w))
          .withColumn("change", P.change_next_open("open", w)))
    cols = [F.array(F.col("change"), *[F.lag("change", i).over(w) for i in range(1, n_prev + 1)]).alias("changes"),
            P.lags("open", n_prev, w, start=0).alias("opens")]
    if docs is not None:
        cols.append(P.lags("doc_idx", n_prev, w, default=-1).alias("prev_doc_idx"))
    return s.select("*", *cols)


def label_significance(prices: DataFrame, symbol_map: DataFrame, docs: DataFrame,
                       sig: float = P.SIG_THRESHOLD_TREND, insig: float = 0.5,
                       n_prev: int = 20) -> DataFrame:
    """Days with a document; 1 = significant move, 0 = insignificant, rest dropped.

    Significant wins when both hold.  Windows are computed over all trading
    days first and filtered after, as the reference does.
    """
    s = price_series(prices, symbol_map, docs, n_prev)
    is_sig = P.significant("change", sig) == 1
    is_insig = P.insignificant("change", insig) == 1
    return (s.where(F.col("doc_idx").isNotNull() & (is_sig | is_insig))
             .withColumn("label", F.when(is_sig, F.lit(1)).otherwise(F.lit(0))))


def label_trend(prices: DataFrame, symbol_map: DataFrame, docs: DataFrame,
                sig: float = P.SIG_THRESHOLD_TREND, n_prev: int = 20) -> DataFrame:
    """Significant days with a document, labelled 1 up / 0 down (threshold = ``sig``)."""
    s = price_series(prices, symbol_map, docs, n_prev)
    return (s.where(F.col("doc_idx").isNotNull() & (P.significant("change", sig) == 1))
             .withColumn("label", P.trend("change", sig)))


def stock_table(prices: DataFrame, symbol_map: DataFrame, sig: float = P.SIG_THRESHOLD_STOCK_TABLE,
                sig_mc: float = P.MULTICLASS_THRESHOLD, strict: bool = False) -> DataFrame:
    """Every price row with next close, L2 change and the 2 % / 1 % labels."""
    s = join_symbol_company(prices, symbol_map, strict=strict)
    w = P.series_window(SERIES_KEY)
    chg = P.change_next_close("close", w)
    return s.select("date", "company", "symbol", F.lead("close", 1).over(w).alias("next_close"),
                    chg.alias("change")) \
            .withColumn("sig", P.significant("change", sig)) \
            .withColumn("sig_mc", P.direction_multiclass("change", sig_mc))


def join_corpus_stock(docs: DataFrame, prices: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """Each document with the (open, close) of its company and day.

    A repeated (company, date) price keeps one row (highest symbol), so
    documents are never duplicated by the join.
    """
    daily = (join_symbol_company(prices, symbol_map)
             .groupBy("company", "date")
             .agg(F.max_by(F.struct("open", "close"), "symbol").alias("p"))
             .select("company", "date", "p.open", "p.close"))
    return docs.select("doc_idx", "company", "date").join(daily, ["company", "date"], "inner")


def label_multiclass(corpus_stock: DataFrame, threshold: float = P.MULTICLASS_THRESHOLD,
                     lower: float = P.BUFFER_LOWER, upper: float = P.BUFFER_UPPER,
                     keep_last_row: bool = False) -> DataFrame:
    """Intraday change (L3), buffer filter (L8), up / flat / down label.

    ``keep_last_row`` reproduces the reference's rule that the row with the
    highest doc_idx is always kept with label 0.
    """
    c = corpus_stock.withColumn("change", P.change_intraday("open", "close"))
    labelled = c.withColumn("label", P.direction_multiclass("change", threshold))
    if not keep_last_row:
        return labelled.where(P.outside_buffer("change", lower, upper))
    # one scalar, fetched once; avoids a single-partition window over all rows
    last_idx = corpus_stock.agg(F.max("doc_idx")).first()[0]
    return (labelled.withColumn("_last", F.col("doc_idx") == F.lit(last_idx))
            .where(F.col("_last") | P.outside_buffer("change", lower, upper))
            .withColumn("label", F.when(F.col("_last"), F.lit(0)).otherwise(F.col("label")))
            .drop("_last"))


def label_regression(corpus_stock: DataFrame, lower: float = P.BUFFER_LOWER,
                     upper: float = P.BUFFER_UPPER) -> DataFrame:
    """As D11 with the change itself as label."""
    c = corpus_stock.withColumn("change", P.change_intraday("open", "close"))
    return c.where(P.outside_buffer("change", lower, upper)).withColumn("label", F.col("change"))


def label_counts(samples: DataFrame) -> DataFrame:
    """Significant / insignificant counts per company and in total (rollup)."""
    return (samples.rollup("company")
            .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("n_sig"),
                 F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("n_insig")))


def class_counts(samples: DataFrame, split_col: str = "split", label_col: str = "label") -> DataFrame:
    """Rows per (split, label) and the label's share within its split."""
    c = samples.groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split_col)))


def join_sentiment(samples: DataFrame, sentiment: DataFrame, features_col: str = "features") -> DataFrame:
    """Append the three sentiment values of a sample's document to its
    feature array; samples without sentiment are dropped (inner join)."""
    j = samples.join(sentiment.select("doc_idx", "sentiment"), "doc_idx", "inner")
    return j.withColumn(features_col, F.concat(F.col(features_col), F.col("sentiment"))).drop("sentiment")
