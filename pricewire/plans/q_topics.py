"""Topic-feature queries: ``embeddings`` as topic-model output, the labelled
news/price sample as the rows that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.operators import topics as O
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.plans.q_prices import labelled_samples
from pricewire.sources import tables as T

KEY = ("symbol", "date")
W = "PARTITION BY symbol ORDER BY date"
F9_ALPHA, F9_L = 0.9, 5          # history variant used by the F9 feature sets
W8_DECAYS, W8_WINDOWS = O.ADJ_DECAYS, O.ADJ_WINDOWS


def _grid_sql(pairs, a="alpha", b="L"):
    rows = ", ".join(f"({x}, {y})" for x, y in pairs)
    return f"grid AS (SELECT CAST(g1 AS DOUBLE) AS {a}, CAST(g2 AS INTEGER) AS {b} FROM (VALUES {rows}) v(g1, g2))"


_SAMPLES_SQL = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, S.TOPICS, S.TOPICS_LONG,
                       f"""samp AS (
  SELECT symbol, date, doc_idx, [{', '.join(f'coalesce(lag(doc_idx, {i}) OVER ({W}), -1)' for i in range(1, T.N_PREV + 1))}] AS prevs
  FROM series
  QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT}))""")

_CHANGE_SQL = """chg AS (
  SELECT s.symbol, s.date, t.k, t.i, t.v AS today,
         CASE WHEN s.prevs[1] > 0 THEN coalesce(p.v, 0) ELSE 0 END AS prev
  FROM samp s JOIN topics_long t ON t.doc_idx = s.doc_idx
  LEFT JOIN topics_long p ON p.doc_idx = s.prevs[1] AND p.k = t.k AND p.i = t.i)"""

_HIST_SQL = _grid_sql([(a, L) for a in O.HIST_ALPHAS for L in O.HIST_WINDOWS]) + f""",
hl AS (SELECT symbol, date, {T.N_PREV} - j AS w, prevs[j] AS hdoc FROM samp, range(1, {T.N_PREV + 1}) r(j)),
hj AS (SELECT hl.symbol, hl.date, hl.w, t.k, t.i, t.v FROM hl JOIN topics_long t ON t.doc_idx = hl.hdoc WHERE hl.hdoc > 0),
agg AS (SELECT hj.symbol, hj.date, hj.k, hj.i, g.alpha, g.L,
               sum(CASE WHEN hj.w < g.L THEN pow(g.alpha, hj.w + 1) * hj.v ELSE 0 END) AS hist
        FROM hj, grid g GROUP BY ALL),
hist AS (
  SELECT s.symbol, s.date, t.k, t.i, g.alpha, g.L, coalesce(a.hist, 0) AS hist
  FROM samp s JOIN topics_long t ON t.doc_idx = s.doc_idx CROSS JOIN grid g
  LEFT JOIN agg a ON a.symbol = s.symbol AND a.date = s.date AND a.k = t.k AND a.i = t.i
                 AND a.alpha = g.alpha AND a.L = g.L)"""


def samples(spark, sf_dir):
    return labelled_samples(spark, sf_dir)


@query("topic_normalize", S.with_(S.TOPICS, S.TOPICS_LONG) + """
SELECT k, doc_idx, CAST(i - 1 AS INTEGER) AS i, round(v, 6) AS v FROM topics_long""")
def q_topic_normalize(spark, sf_dir):
    """(gamma - alpha) / sum(gamma - alpha), long form."""
    return rounded(O.topics_long(O.normalize_gamma(T.topic_gamma(spark, sf_dir))))


@query("topic_change_prev", _SAMPLES_SQL + ", " + _CHANGE_SQL + """
SELECT symbol, date, k, CAST(i - 1 AS INTEGER) AS i, round(today, 6) AS today, round(prev, 6) AS prev,
       round(today - prev, 6) AS change FROM chg""")
def q_topic_change_prev(spark, sf_dir):
    """W4 + L13: today's topics minus the previous trading day's document topics."""
    return rounded(O.topic_change_prev(samples(spark, sf_dir), T.topics(spark, sf_dir), KEY))


@query("topic_hist_indexed", _SAMPLES_SQL + ", " + _HIST_SQL + """
SELECT symbol, date, k, CAST(i - 1 AS INTEGER) AS i, alpha, L, round(hist, 6) AS hist FROM hist""")
def q_topic_hist_indexed(spark, sf_dir):
    """Decayed topic history over the previous documents, all 25 (alpha, L) at once."""
    return rounded(O.topic_hist_indexed(samples(spark, sf_dir), T.topics(spark, sf_dir), KEY))


@query("topic_change_hist_table", _SAMPLES_SQL + ", " + _CHANGE_SQL + ", " + _HIST_SQL + """
SELECT symbol, date, k, 'today' AS variant, CAST(i - 1 AS INTEGER) AS i, round(today, 6) AS value FROM chg
UNION ALL
SELECT symbol, date, k, 'change', CAST(i - 1 AS INTEGER), round(today - prev, 6) FROM chg
UNION ALL
SELECT symbol, date, k, 'alpha=' || CAST(alpha AS VARCHAR) || ', L=' || CAST(L AS VARCHAR),
       CAST(i - 1 AS INTEGER), round(hist, 6) FROM hist""")
def q_topic_change_hist_table(spark, sf_dir):
    """per k, today / change / 25 history variants in one long table."""
    s, t = samples(spark, sf_dir), T.topics(spark, sf_dir)
    c = O.topic_change_prev(s, t, KEY)
    h = O.topic_hist_indexed(s, t, KEY)
    today = c.select(*KEY, "k", F.lit("today").alias("variant"), "i", F.col("today").alias("value"))
    change = c.select(*KEY, "k", F.lit("change").alias("variant"), "i", F.col("change").alias("value"))
    name = F.concat(F.lit("alpha="), F.col("alpha").cast("string"), F.lit(", L="), F.col("L").cast("string"))
    hist = h.select(*KEY, "k", name.alias("variant"), "i", F.col("hist").alias("value"))
    return rounded(today.unionByName(change).unionByName(hist))


@query("topic_features", _SAMPLES_SQL + ", " + _CHANGE_SQL + ", " + _HIST_SQL + f""",
blk AS (
  SELECT c.symbol, c.date, c.k, c.i - 1 AS i, c.today, c.today - c.prev AS chg, h.hist,
         max(c.i) OVER (PARTITION BY c.symbol, c.date, c.k) AS kk
  FROM chg c JOIN hist h ON h.symbol = c.symbol AND h.date = c.date AND h.k = c.k AND h.i = c.i
  WHERE h.alpha = {F9_ALPHA} AND h.L = {F9_L})
SELECT symbol, date, k, variant, CAST(j AS INTEGER) AS j, round(value, 6) AS value FROM (
  SELECT symbol, date, k, 'today' AS variant, i AS j, today AS value FROM blk
  UNION ALL SELECT symbol, date, k, 'change', i, chg FROM blk
  UNION ALL SELECT symbol, date, k, 'change+today', i, chg FROM blk
  UNION ALL SELECT symbol, date, k, 'change+today', i + kk, today FROM blk
  UNION ALL SELECT symbol, date, k, 'today+hist', i, today + hist FROM blk
  UNION ALL SELECT symbol, date, k, 'today|hist', i, today FROM blk
  UNION ALL SELECT symbol, date, k, 'today|hist', i + kk, hist FROM blk
  UNION ALL SELECT symbol, date, k, 'change|today+hist', i, chg FROM blk
  UNION ALL SELECT symbol, date, k, 'change|today+hist', i + kk, today + hist FROM blk
  UNION ALL SELECT symbol, date, k, 'change|today|hist', i, chg FROM blk
  UNION ALL SELECT symbol, date, k, 'change|today|hist', i + kk, today FROM blk
  UNION ALL SELECT symbol, date, k, 'change|today|hist', i + 2 * kk, hist FROM blk)""")
def q_topic_features(spark, sf_dir):
    """F9 + L13: the seven topic feature sets (today, change, sums and concatenations)."""
    out = O.topic_features(samples(spark, sf_dir), T.topics(spark, sf_dir), KEY, [F9_ALPHA], [F9_L])
    return rounded(out.drop("alpha", "L").withColumn("j", F.col("j").cast("int")))


@query("topic_features_grid", _SAMPLES_SQL + ", " + _CHANGE_SQL + ", " + _HIST_SQL + """,
b AS (
  SELECT c.symbol, c.date, c.k, c.i, c.today, c.today - c.prev AS chg, h.hist, h.alpha, h.L, len(t.topic) AS kk
  FROM chg c JOIN hist h ON h.symbol = c.symbol AND h.date = c.date AND h.k = c.k AND h.i = c.i
  JOIN samp s ON s.symbol = c.symbol AND s.date = c.date JOIN topics_n t ON t.doc_idx = s.doc_idx),
once AS (SELECT DISTINCT symbol, date, k, i, kk, today, chg FROM b)
SELECT symbol, date, k, variant, alpha, L, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total, round(sum(j * value), 5) AS moment
FROM (
  SELECT symbol, date, k, 'today' AS variant, NULL::DOUBLE AS alpha, NULL::INTEGER AS L, i AS j, today AS value FROM once
  UNION ALL SELECT symbol, date, k, 'change', NULL, NULL, i, chg FROM once
  UNION ALL SELECT symbol, date, k, 'change+today', NULL, NULL, i, chg FROM once
  UNION ALL SELECT symbol, date, k, 'change+today', NULL, NULL, i + kk, today FROM once
  UNION ALL SELECT symbol, date, k, 'today+hist', alpha, L, i, today + hist FROM b
  UNION ALL SELECT symbol, date, k, 'today|hist', alpha, L, i, today FROM b
  UNION ALL SELECT symbol, date, k, 'today|hist', alpha, L, i + kk, hist FROM b
  UNION ALL SELECT symbol, date, k, 'change|today+hist', alpha, L, i, chg FROM b
  UNION ALL SELECT symbol, date, k, 'change|today+hist', alpha, L, i + kk, today + hist FROM b
  UNION ALL SELECT symbol, date, k, 'change|today|hist', alpha, L, i, chg FROM b
  UNION ALL SELECT symbol, date, k, 'change|today|hist', alpha, L, i + kk, today FROM b
  UNION ALL SELECT symbol, date, k, 'change|today|hist', alpha, L, i + 2 * kk, hist FROM b)
GROUP BY symbol, date, k, variant, alpha, L""")
def q_topic_features_grid(spark, sf_dir):
    """F9 with all 25 (alpha, L): each sample's feature vectors by number of values, sum, and sum weighted by place (from 1)."""
    out = O.topic_features(samples(spark, sf_dir), T.topics(spark, sf_dir), KEY)
    place = (F.col("j") + 1) * F.col("value")
    g = out.groupBy(*KEY, "k", "variant", "alpha", "L").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
                                                            F.sum(place).alias("moment"))
    return rounded(g.withColumn("moment", F.round("moment", 5)))


_SEQ_SQL = S.with_(S.TOPICS, f"""seq AS (
  SELECT e.vec_id AS pos, CAST(e.label AS VARCHAR) AS company, t.topic
  FROM embeddings e JOIN topics_n t ON t.doc_idx = e.vec_id),
sl AS (SELECT pos, company, i, topic[i] AS v FROM seq, range(1, len(topic) + 1) r(i))""")


def _adj_sql(decays, windows):
    return _grid_sql([(d, w) for d in decays for w in windows], "decay", "w") + f""",
pairs AS (
  SELECT a.pos, a.i, a.pos - b.pos AS d, b.v FROM sl a JOIN sl b
    ON b.company = a.company AND b.i = a.i AND b.pos BETWEEN a.pos - {max(windows)} AND a.pos - 1),
agg AS (SELECT p.pos, p.i, g.decay, g.w,
               sum(CASE WHEN p.d <= g.w THEN pow(g.decay, p.d) * p.v ELSE 0 END) AS hist
        FROM pairs p, grid g GROUP BY ALL),
adj AS (SELECT s.pos, s.company, s.i, s.v AS today, g.decay, g.w, coalesce(a.hist, 0) AS hist
        FROM sl s CROSS JOIN grid g
        LEFT JOIN agg a ON a.pos = s.pos AND a.i = s.i AND a.decay = g.decay AND a.w = g.w)"""


@query("topic_hist_adjacent", _SEQ_SQL + ", " + _adj_sql(O.ADJ_DECAYS, O.ADJ_WINDOWS) + """
SELECT pos, company, CAST(i - 1 AS INTEGER) AS i, decay, w, round(hist, 6) AS hist FROM adj""")
def q_topic_hist_adjacent(spark, sf_dir):
    """Decayed history over the previous rows of the same company (file order), 24 (decay, w)."""
    return rounded(O.topic_hist_adjacent(T.topic_sequence(spark, sf_dir)))


@query("topic_change_adjacent", _SEQ_SQL + """
SELECT a.pos, a.company, CAST(a.i - 1 AS INTEGER) AS i, round(a.v - b.v, 6) AS change
FROM sl a JOIN sl b ON b.pos = a.pos - 1 AND b.i = a.i AND b.company = a.company""")
def q_topic_change_adjacent(spark, sf_dir):
    """Difference to the previous row when it is of the same company."""
    return rounded(O.topic_change_adjacent(T.topic_sequence(spark, sf_dir)))


@query("hist_features", _SEQ_SQL + ", " + _adj_sql(W8_DECAYS, W8_WINDOWS) + """,
kk AS (SELECT pos, max(i) AS k FROM sl GROUP BY pos)
SELECT pos, decay, w, variant, CAST(j AS INTEGER) AS j, round(value, 6) AS value FROM (
  SELECT pos, decay, w, 'add' AS variant, i - 1 AS j, today + hist AS value FROM adj
  UNION ALL SELECT pos, decay, w, 'cont', i - 1, today FROM adj
  UNION ALL SELECT adj.pos, decay, w, 'cont', i - 1 + kk.k, hist FROM adj JOIN kk USING (pos))""")
def q_hist_features(spark, sf_dir):
    """W8 + L13: today + history (add) and today then history (cont)."""
    out = O.hist_features(T.topic_sequence(spark, sf_dir), W8_DECAYS, W8_WINDOWS)
    return rounded(out.withColumn("j", F.col("j").cast("int")))


@query("topic_libsvm", S.with_(S.TOPICS) + """
SELECT l.doc_id AS doc_idx,
       CAST(l.quality AS VARCHAR) || ' ' ||
       array_to_string(list_transform(range(1, len(t.topic) + 1),
                                      lambda i: CAST(i AS VARCHAR) || ':' || printf('%.6f', t.topic[i])), ' ') AS line
FROM labels l JOIN topics_n t ON t.doc_idx = l.doc_id""")
def q_topic_libsvm(spark, sf_dir):
    """topic vector and label of each labelled document as a LIBSVM line."""
    lab = T.class_labels(spark, sf_dir).select("doc_idx", F.col("quality").alias("label"))
    return O.topic_libsvm(lab, T.topics(spark, sf_dir))
