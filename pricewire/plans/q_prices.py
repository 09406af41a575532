"""Price, alignment and label queries over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.functions import prices as P
from pricewire.operators import labels as L
from pricewire.plans import sql as S
from pricewire.plans.base import flatten, query, rounded
from pricewire.sources import tables as T

W = "PARTITION BY symbol ORDER BY date"


def _inputs(spark, sf_dir):
    return T.prices(spark, sf_dir), T.symbol_map(spark, sf_dir), T.collection(spark, sf_dir)


def labelled_samples(spark, sf_dir, sig=T.SIG_PCT, insig=T.INSIG_PCT, n_prev=T.N_PREV):
    p, m, d = _inputs(spark, sf_dir)
    return L.label_significance(p, m, d, sig=sig, insig=insig, n_prev=n_prev)


def _flat_sample(s, n_prev=T.N_PREV):
    s = s.select("company", "symbol", "date", "doc_idx", "change",
                 F.slice("changes", 2, n_prev).alias("hist"), "prev_doc_idx", "label")
    s = flatten(s, "hist", n_prev, "change_")
    s = flatten(s, "prev_doc_idx", n_prev, "prev_doc_")
    return rounded(s)


_SAMPLE_SQL = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, f"""h AS (
  SELECT *,
  {S.lag_cols('change', T.N_PREV, 'change_', W, rnd=6)},
  {S.lag_cols('doc_idx', T.N_PREV, 'prev_doc_', W, default=-1)}
  FROM series)""") + f"""
SELECT company, symbol, date, doc_idx, round(change, 6) AS change,
  {', '.join(f'change_{i}' for i in range(1, T.N_PREV + 1))},
  {', '.join(f'prev_doc_{i}' for i in range(1, T.N_PREV + 1))},
  CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label
FROM h
WHERE doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})"""


@query("label_significance", _SAMPLE_SQL)
def q_label_significance(spark, sf_dir):
    """D14 (+ L1, L4, L5, W2, J2, J3, J4, P2, P3): the 46-column labelled sample."""
    return _flat_sample(labelled_samples(spark, sf_dir))


# --------------------------------------------------------------------------- series-level
def _series(spark, sf_dir, with_docs=True):
    p, m, d = _inputs(spark, sf_dir)
    return L.price_series(p, m, d if with_docs else None)


_SERIES_SQL = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES)


@query("change_next_open", S.with_(S.PRICES) + """
SELECT symbol, date, round(open, 6) AS open,
  round((lead(open) OVER (PARTITION BY symbol ORDER BY date) - open) / nullif(open, 0) * 100, 6) AS change
FROM prices""")
def q_change_next_open(spark, sf_dir):
    """L1 over every price series (mapped or not)."""
    p = T.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", "open", P.change_next_open("open").alias("change")))


@query("change_next_close", S.with_(S.PRICES) + """
SELECT symbol, date, round(close, 6) AS close,
  round((1 - lead(close) OVER w / nullif(CASE WHEN row_number() OVER w > 1 THEN close END, 0)) * -100, 6) AS change
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def q_change_next_close(spark, sf_dir):
    """L2: NULL on the newest and on the oldest row of a series."""
    p = T.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", "close", P.change_next_close("close").alias("change")))


@query("change_intraday", S.with_(S.PRICES) + """
SELECT symbol, date, round((close / nullif(open, 0) - 1) * 100, 6) AS change FROM prices""")
def q_change_intraday(spark, sf_dir):
    """L3."""
    p = T.prices(spark, sf_dir)
    return rounded(p.select("symbol", "date", P.change_intraday("open", "close").alias("change")))


def _label_cols_sql(x):
    return f"""CASE WHEN abs({x}) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS sig,
  CASE WHEN abs({x}) <= {T.INSIG_PCT} THEN 1 ELSE 0 END AS insig,
  CASE WHEN abs({x}) >= {T.MC_PCT} AND {x} > 0 THEN 1 WHEN abs({x}) >= {T.MC_PCT} THEN -1 ELSE 0 END AS direction,
  CASE WHEN abs({x}) >= {T.SIG_PCT} THEN CAST({x} > 0 AS INTEGER) END AS trend"""


@query("price_labels", _SERIES_SQL + f"""
SELECT symbol, date, round(change, 6) AS change, {_label_cols_sql('change')} FROM series""")
def q_price_labels(spark, sf_dir):
    """L4 significant, L5 insignificant, L6 direction, L7 trend on every mapped day."""
    s = _series(spark, sf_dir)
    return rounded(s.select("symbol", "date", "change",
                            P.significant("change", T.SIG_PCT).alias("sig"),
                            P.insignificant("change", T.INSIG_PCT).alias("insig"),
                            P.direction_multiclass("change", T.MC_PCT).alias("direction"),
                            P.trend("change", T.SIG_PCT).alias("trend")))


@query("next_day_value", S.with_(S.PRICES) + """
SELECT symbol, date, round(lead(open) OVER w, 6) AS next_open, round(lead(close) OVER w, 6) AS next_close
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def q_next_day_value(spark, sf_dir):
    """Next trading day's open and close."""
    p = T.prices(spark, sf_dir)
    w = P.series_window()
    return rounded(p.select("symbol", "date", F.lead("open").over(w).alias("next_open"),
                            F.lead("close").over(w).alias("next_close")))


@query("prev_changes", _SERIES_SQL + f"""
SELECT symbol, date, {S.lag_cols('change', T.N_PREV, 'change_', W, rnd=6)},
  {S.lag_cols('date', T.N_PREV, 'date_', W)}
FROM series""")
def q_prev_changes(spark, sf_dir):
    """The 20 previous changes of every day and their dates."""
    s = _series(spark, sf_dir)
    w = P.series_window()
    out = s.select("symbol", "date", F.slice("changes", 2, T.N_PREV).alias("hist"),
                   *[F.lag("date", i).over(w).alias(f"date_{i}") for i in range(1, T.N_PREV + 1)])
    return rounded(flatten(out, "hist", T.N_PREV, "change_"))


_PRICE_SAMPLE_SQL = _SERIES_SQL + f"""
SELECT company, symbol, date, doc_idx, round(next_open, 6) AS next_open,
  {S.lag_cols('open', T.N_PREV, 'open_', W, rnd=6, start=0)},
  CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label
FROM series
QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})"""


@query("open_history", _PRICE_SAMPLE_SQL)
def q_open_history(spark, sf_dir):
    """W3 / price samples: next open and today's plus 19 previous opens of each labelled day."""
    s = labelled_samples(spark, sf_dir)
    out = s.select("company", "symbol", "date", "doc_idx", "next_open", "opens", "label")
    return rounded(flatten(out, "opens", T.N_PREV, "open_", start=0))


@query("join_symbol_company", S.with_(S.PRICES, S.SYMBOL_MAP) + """
SELECT symbol, company, date, round(open, 6) AS open, round(close, 6) AS close
FROM prices JOIN symbol_map USING (symbol)""")
def q_join_symbol_company(spark, sf_dir):
    """Unmapped symbols are dropped."""
    p, m, _ = _inputs(spark, sf_dir)
    return rounded(L.join_symbol_company(p, m).select("symbol", "company", "date", "open", "close"))


@query("join_price_docs", _SERIES_SQL + """
SELECT company, symbol, date, doc_idx FROM series WHERE doc_idx IS NOT NULL""")
def q_join_price_docs(spark, sf_dir):
    """Trading days of mapped symbols that have a document; highest doc_idx wins."""
    s = _series(spark, sf_dir)
    return s.where(F.col("doc_idx").isNotNull()).select("company", "symbol", "date", "doc_idx")


@query("lookup_prev_docs", _SERIES_SQL + f"""
SELECT company, symbol, date, {S.lag_cols('doc_idx', T.N_PREV, 'prev_doc_', W, default=-1)}
FROM series""")
def q_lookup_prev_docs(spark, sf_dir):
    """Document of each of the 20 previous trading days, -1 if none (all days)."""
    s = _series(spark, sf_dir).select("company", "symbol", "date", "prev_doc_idx")
    return flatten(s, "prev_doc_idx", T.N_PREV, "prev_doc_")


_CORPUS_STOCK = """cs AS (
  SELECT c.company, c.date, c.doc_idx, d.open, d.close
  FROM coll c JOIN (
      SELECT company, date, arg_max(open, symbol) AS open, arg_max(close, symbol) AS close
      FROM prices JOIN symbol_map USING (symbol) GROUP BY 1, 2) d
    ON c.company = d.company AND c.date = d.date)"""


def _corpus_stock(spark, sf_dir):
    p, m, d = _inputs(spark, sf_dir)
    return L.join_corpus_stock(d, p, m)


@query("join_corpus_stock", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, _CORPUS_STOCK) + """
SELECT company, date, doc_idx, round(open, 6) AS open, round(close, 6) AS close FROM cs""")
def q_join_corpus_stock(spark, sf_dir):
    """Every document with its day's open and close (documents never duplicated)."""
    return rounded(_corpus_stock(spark, sf_dir).select("company", "date", "doc_idx", "open", "close"))


_INTRADAY = "(close / nullif(open, 0) - 1) * 100"
_OUTSIDE_BUFFER = (f"coalesce(NOT (abs({_INTRADAY}) > {T.BUFFER_PCT[0]} AND abs({_INTRADAY}) < {T.BUFFER_PCT[1]}),"
                   " true)")


@query("buffer_filter", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, _CORPUS_STOCK) + f"""
SELECT company, date, doc_idx, round({_INTRADAY}, 6) AS change FROM cs WHERE {_OUTSIDE_BUFFER}""")
def q_buffer_filter(spark, sf_dir):
    """Rows strictly inside the buffer band are dropped."""
    c = _corpus_stock(spark, sf_dir).withColumn("change", P.change_intraday())
    return rounded(c.where(P.outside_buffer("change", *T.BUFFER_PCT)).select("company", "date", "doc_idx", "change"))


@query("label_multiclass", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, _CORPUS_STOCK) + f"""
SELECT company, date, doc_idx, round({_INTRADAY}, 6) AS change,
  CASE WHEN abs({_INTRADAY}) >= {T.MC_PCT} AND {_INTRADAY} > 0 THEN 1
       WHEN abs({_INTRADAY}) >= {T.MC_PCT} THEN -1 ELSE 0 END AS label
FROM cs WHERE {_OUTSIDE_BUFFER}""")
def q_label_multiclass(spark, sf_dir):
    """Intraday change, buffer filter, up / flat / down."""
    out = L.label_multiclass(_corpus_stock(spark, sf_dir), threshold=T.MC_PCT,
                             lower=T.BUFFER_PCT[0], upper=T.BUFFER_PCT[1])
    return rounded(out.select("company", "date", "doc_idx", "change", "label"))


@query("label_regression", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, _CORPUS_STOCK) + f"""
SELECT company, date, doc_idx, round({_INTRADAY}, 6) AS label FROM cs WHERE {_OUTSIDE_BUFFER}""")
def q_label_regression(spark, sf_dir):
    """The intraday change itself as label."""
    out = L.label_regression(_corpus_stock(spark, sf_dir), *T.BUFFER_PCT)
    return rounded(out.select("company", "date", "doc_idx", "label"))


@query("label_trend", _SERIES_SQL + f"""
SELECT company, symbol, date, doc_idx, round(change, 6) AS change, CAST(change > 0 AS INTEGER) AS label
FROM series WHERE doc_idx IS NOT NULL AND abs(change) >= {T.SIG_PCT}""")
def q_label_trend(spark, sf_dir):
    """D13 / P3 (significant-only mode): up / down label of significant days with a document."""
    p, m, d = _inputs(spark, sf_dir)
    out = L.label_trend(p, m, d, sig=T.SIG_PCT)
    return rounded(out.select("company", "symbol", "date", "doc_idx", "change", "label"))


@query("stock_table", S.with_(S.PRICES, S.SYMBOL_MAP) + f"""
SELECT date, company, symbol, round(lead(close) OVER w, 6) AS next_close, round(chg, 6) AS change,
  CASE WHEN abs(chg) >= {T.STOCK_SIG_PCT} THEN 1 ELSE 0 END AS sig,
  CASE WHEN abs(chg) >= {T.MC_PCT} AND chg > 0 THEN 1 WHEN abs(chg) >= {T.MC_PCT} THEN -1 ELSE 0 END AS sig_mc
FROM (SELECT *, (1 - lead(close) OVER w / nullif(CASE WHEN row_number() OVER w > 1 THEN close END, 0)) * -100 AS chg
      FROM prices JOIN symbol_map USING (symbol)
      WINDOW w AS (PARTITION BY symbol ORDER BY date))
WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def q_stock_table(spark, sf_dir):
    """All mapped price rows with next close, L2 change, 2 % and 1 % labels (scaled)."""
    p, m, _ = _inputs(spark, sf_dir)
    return rounded(L.stock_table(p, m, sig=T.STOCK_SIG_PCT, sig_mc=T.MC_PCT))


@query("label_counts", _SERIES_SQL + f"""
, s AS (SELECT company, CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label FROM series
        WHERE doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT}))
SELECT company, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_sig,
       CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_insig
FROM s GROUP BY ROLLUP (company)""")
def q_label_counts(spark, sf_dir):
    """Per company and total (rollup) counts of the labelled sample."""
    return L.label_counts(labelled_samples(spark, sf_dir))


@query("label_remap", _SERIES_SQL + f"""
SELECT company, date, doc_idx, CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE -1 END AS label
FROM series WHERE doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})""")
def q_label_remap(spark, sf_dir):
    """Label 0 -> -1 on the labelled sample."""
    s = labelled_samples(spark, sf_dir)
    return s.select("company", "date", "doc_idx", P.label_remap("label").alias("label"))


@query("nan_to_zero", _SERIES_SQL + f"""
SELECT company, date, doc_idx, {', '.join(
    f"round(coalesce(lag(change, {i}) OVER ({W}), 0), 6) AS change_{i}" for i in range(0, T.N_PREV + 1))}
FROM series
QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})""")
def q_nan_to_zero(spark, sf_dir):
    """The 21-value change history with missing values as 0."""
    s = labelled_samples(spark, sf_dir)
    out = s.select("company", "date", "doc_idx", P.nan_to_zero("changes").alias("hist"))
    return rounded(flatten(out, "hist", T.N_PREV + 1, "change_", start=0))


@query("slice_history", _SERIES_SQL + f"""
SELECT company, date, doc_idx, {', '.join(
    f"round(lag(change, {i}) OVER ({W}), 6) AS f_{i}" for i in range(0, 6))}
FROM series
QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})""")
def q_slice_history(spark, sf_dir):
    """today's change and 5 previous changes as a feature block."""
    s = labelled_samples(spark, sf_dir)
    out = s.select("company", "date", "doc_idx", P.slice_history("changes", 5, include_today=True).alias("f"))
    return rounded(flatten(out, "f", 6, "f_", start=0))


@query("direction_from_price", _SERIES_SQL + """
SELECT symbol, date, CASE WHEN c > 0 THEN 1 WHEN c <= 0 THEN 0 ELSE -1 END AS direction
FROM (SELECT symbol, date, (next_open - open) * 100 / nullif(open, 0) AS c FROM series)""")
def q_direction_from_price(spark, sf_dir):
    """Direction of the next-open change; undefined -> -1."""
    s = _series(spark, sf_dir, with_docs=False)
    c = F.try_divide((F.col("next_open") - F.col("open")) * 100, F.col("open"))
    return s.select("symbol", "date", P.direction_from_price(c).alias("direction"))
