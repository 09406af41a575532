"""Model queries (F8, F10, F12, M1-M9).  Fits are ``pyspark.ml`` jobs; the
feature tables they read come from the provided tables (``embeddings`` as
dense features, the labelled news/price sample with its topic and price
blocks)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import functions as F

from pricewire.functions import text as X
from pricewire.functions.prices import nan_to_zero
from pricewire.operators import models as M
from pricewire.operators import splits as SP
from pricewire.operators import sweep as SW
from pricewire.operators import text as TX
from pricewire.operators import topics as TP
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.plans.q_prices import labelled_samples
from pricewire.session import cut_lineage
from pricewire.sources import tables as T

SEED = 7
TEST_PORTION = 0.3
SPLIT_DATE = "2024-01-20"
KEY = ("symbol", "date")
W = "PARTITION BY symbol ORDER BY date"


def dense(spark, sf_dir):
    """``(row_idx, label, features array, split)``: 0 train / 2 test by md5 order."""
    d = T.dense_features(spark, sf_dir)
    return SP.valid_portion(d, TEST_PORTION, SEED)


def dense_vectors(spark, sf_dir):
    d = M.assemble(dense(spark, sf_dir), ["features"], "vec")
    return d.where(F.col("split") == 0), d.where(F.col("split") == 2)


_DENSE_SQL = f"""dn AS (
  SELECT vec_id AS row_idx, CAST(label % 2 AS DOUBLE) AS label, embedding,
         CASE WHEN row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id) - 1
                   < round_even(count(*) OVER () * {1 - TEST_PORTION}, 0) THEN 0 ELSE 2 END AS split
  FROM embeddings),
dl AS (SELECT row_idx, split, j - 1 AS j, CAST(embedding[j] AS DOUBLE) AS x FROM dn, range(1, len(embedding) + 1) r(j))"""


@query("scale_minmax", S.with_(_DENSE_SQL) + """,
mm AS (SELECT j, min(x) AS lo, max(x) AS hi FROM dl WHERE split = 0 GROUP BY j)
SELECT row_idx, CAST(dl.j AS INTEGER) AS j,
       round(CASE WHEN hi = lo THEN 0 ELSE (x - lo) / (hi - lo) * 2 - 1 END, 6) AS value
FROM dl JOIN mm USING (j)""")
def q_scale_minmax(spark, sf_dir):
    """[-1, 1] min-max scaling fitted on train, applied to train and test."""
    tr, te = dense_vectors(spark, sf_dir)
    tr_s, (te_s,) = M.scale_minmax(tr, [te], "vec")
    out = tr_s.unionByName(te_s)
    out = M.to_array(out, "vec_scaled", "scaled").select("row_idx", F.posexplode("scaled").alias("j", "value"))
    return rounded(out)


def sample_blocks(spark, sf_dir):
    """Labelled samples with topic blocks (today, change) and stock blocks."""
    s = labelled_samples(spark, sf_dir)
    t = T.topics(spark, sf_dir)
    c = TP.topic_change_prev(s, t, KEY)
    arr = (c.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("i", "today", "change"))).alias("_c"))
            .select(*KEY, F.transform("_c", lambda r: r["today"]).alias("topic_today"),
                    F.transform("_c", lambda r: r["change"]).alias("topic_change")))
    s = s.join(arr, list(KEY), "inner")
    s = _md5_split(s)
    return (s.withColumn("stock1", M.stock_block("changes", 1))
             .withColumn("stock5", M.stock_block("changes", 5))
             .withColumn("label", F.col("label").cast("double")))


@query("stock_features", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES) + f"""
SELECT symbol, date, CAST(j - 1 AS INTEGER) AS j, round(value, 6) AS value FROM (
  SELECT symbol, date, [{', '.join(f'coalesce(lag(change, {i}) OVER ({W}), 0)' for i in range(1, 6))}] AS h
  FROM series
  QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})),
  LATERAL (SELECT unnest(h) AS value, generate_subscripts(h, 1) AS j)""")
def q_stock_features(spark, sf_dir):
    """F8 + L10 + L14: five previous changes (missing as 0) as a feature block."""
    s = labelled_samples(spark, sf_dir).select(*KEY, M.stock_block("changes", 5).alias("b"))
    return rounded(s.select(*KEY, F.posexplode("b").alias("j", "value")))


_TOPIC_SAMPLES = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, S.TOPICS, S.TOPICS_LONG,
                         f"""samp AS (
  SELECT symbol, date, doc_idx, [{', '.join(f'coalesce(lag(change, {i}) OVER ({W}), 0)' for i in range(1, 6))}] AS h
  FROM series
  QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT}))""")


@query("hstack_features", _TOPIC_SAMPLES + f"""
SELECT symbol, date, CAST(j AS INTEGER) AS j, round(value, 6) AS value FROM (
  SELECT s.symbol, s.date, t.i - 1 AS j, t.v AS value FROM samp s JOIN topics_long t ON t.doc_idx = s.doc_idx
  UNION ALL
  SELECT s.symbol, s.date, {T.TOPIC_K} + r.k - 1, s.h[r.k] FROM samp s JOIN (SELECT DISTINCT doc_idx FROM topics_long) d
    ON d.doc_idx = s.doc_idx, range(1, 6) r(k))""")
def q_hstack_features(spark, sf_dir):
    """today's topics and five stock changes assembled into one feature vector."""
    b = M.assemble(sample_blocks(spark, sf_dir), ["topic_today", "stock5"], "fv")
    out = M.to_array(b, "fv", "arr").select(*KEY, F.posexplode("arr").alias("j", "value"))
    return rounded(out)


@query("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    """M1: L2 logistic regression (C = 1, 500 iterations), train and test accuracy."""
    tr, te = dense_vectors(spark, sf_dir)
    _, a_tr, a_te = M.fit_logistic(tr, te, 1.0, features="vec")
    return spark.createDataFrame([(1.0, a_tr, a_te)], "C double, train_acc double, test_acc double")


@query("tune_logistic")
def q_tune_logistic(spark, sf_dir):
    """M2: C = 10^-3..10^3 by 5-fold cross-validation on stratified md5 folds."""
    tr, te = dense_vectors(spark, sf_dir)
    tr = SP.kfold_stratified(tr, 5, "label", SEED).withColumn("fold", F.col("fold") - 1)
    C, a_tr, a_te, metrics = M.tune_logistic(tr, te, "fold", features="vec")
    rows = [(float(c), float(m), c == C, a_tr if c == C else None, a_te if c == C else None)
            for c, m in zip(M.LOGISTIC_C, metrics)]
    return spark.createDataFrame(rows, "C double, cv_accuracy double, best boolean, train_acc double, test_acc double")


def _train_valid(spark, sf_dir):
    tr, te = dense_vectors(spark, sf_dir)
    v = SP.valid_portion(tr.drop("split"), 0.2, f"{SEED}:v")
    return v.where(F.col("split") == 0), v.where(F.col("split") == 2)


@query("tune_svm_linear")
def q_tune_svm_linear(spark, sf_dir):
    """M3: linear SVM, C = 2^-5..2^9 chosen on a validation split (first best kept)."""
    tr, va = _train_valid(spark, sf_dir)
    rows, best = M.tune_svm_linear(tr, va)
    return spark.createDataFrame([(c, a, c == best) for c, a in rows], "C double, valid_acc double, best boolean")


@query("tune_svm_three_class")
def q_tune_svm_three_class(spark, sf_dir):
    """M3 with three classes (one against the rest)."""
    tr, va = (d.withColumn("label", F.col("class3").cast("double")) for d in _train_valid(spark, sf_dir))
    rows, best = M.tune_svm_linear(tr, va, classes=(0.0, 1.0, 2.0))
    return spark.createDataFrame([(c, a, c == best) for c, a in rows], "C double, valid_acc double, best boolean")


@query("tune_svm_rbf_approx")
def q_tune_svm_rbf_approx(spark, sf_dir):
    """M4: C x gamma (the whole 15 x 13 grid) on 128 random Fourier features."""
    tr, va = _train_valid(spark, sf_dir)
    return spark.createDataFrame(M.tune_svm_rbf_approx(tr, va, "features", 64), "C double, gamma double, valid_acc double")


def price_samples(spark, sf_dir):
    s = labelled_samples(spark, sf_dir)
    s = s.withColumn("split", F.when(F.col("date") <= F.lit(SPLIT_DATE).cast("date"), 0).otherwise(1))
    return s.where(F.col("next_open").isNotNull())


def _md5_split(s):
    """Samples keyed by (symbol, date); 70 % train (0) / 30 % test (1) in md5 order."""
    s = s.withColumn("_id", F.concat_ws("|", "symbol", F.col("date").cast("string")))
    s = SP.valid_portion(s, TEST_PORTION, SEED, id_col="_id")
    return s.withColumn("split", F.when(F.col("split") == 0, 0).otherwise(1)).drop("_id")


@query("tune_regression")
def q_tune_regression(spark, sf_dir):
    """M5: next-open regression (squared and Huber loss) over a regParam grid, by validation MSE."""
    s = price_samples(spark, sf_dir).withColumn("x", nan_to_zero("opens"))
    s = M.assemble(s, ["x"], "features")
    rows = M.tune_regression(s.where(F.col("split") == 0), s.where(F.col("split") == 1),
                             [0.0, 0.01, 0.1, 1.0], label="next_open")
    return spark.createDataFrame(rows, "loss string, reg_param double, mse double, r2 double")


@contextmanager
def svr_samples(spark, sf_dir):
    """Split, opens and next open of the samples, computed once: ranges, train and valid blocks read them."""
    s = price_samples(spark, sf_dir).select("split", nan_to_zero("opens").alias("x"), "next_open").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield s
    finally:
        s.unpersist()


@query("tune_svr")
def q_tune_svr(spark, sf_dir):
    """M5: epsilon-insensitive regression of the next open, the whole grid of C (15), gamma (13) and epsilon (8)."""
    with svr_samples(spark, sf_dir) as s:
        rows = M.tune_svr(s.where(F.col("split") == 0), s.where(F.col("split") == 1), "x", T.N_PREV, label="next_open")
    return spark.createDataFrame(rows, "C double, gamma double, epsilon double, mse double, r2 double")


@query("tune_svr_linear")
def q_tune_svr_linear(spark, sf_dir):
    """M5 without a kernel: epsilon-insensitive linear regression over C (15) and epsilon (8)."""
    with svr_samples(spark, sf_dir) as s:
        rows = M.tune_svr(s.where(F.col("split") == 0), s.where(F.col("split") == 1), "x", T.N_PREV, gammas=None, label="next_open")
    return spark.createDataFrame(rows, "C double, gamma double, epsilon double, mse double, r2 double").drop("gamma")


_VAR1 = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES) + f""",
ps AS (
  SELECT date, next_open AS y, open AS x1, coalesce(lag(open, 1) OVER ({W}), 0) AS x2,
         CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label,
         CASE WHEN date <= DATE '{SPLIT_DATE}' THEN 0 ELSE 1 END AS split
  FROM series
  QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})),
tr AS (SELECT * FROM ps WHERE split = 0 AND y IS NOT NULL),
st AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22, covar_pop(x1, x2) AS s12,
              covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM tr),
co AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
              (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM st),
cf AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS a FROM co),
te AS (SELECT ps.label, (cf.a + cf.b1 * x1 + cf.b2 * x2 - x1) * 100 / nullif(x1, 0) AS c
       FROM ps, cf WHERE ps.split = 1 AND ps.y IS NOT NULL)
SELECT round((SELECT a FROM cf), 6) AS intercept, round((SELECT b1 FROM cf), 6) AS coef_1,
       round((SELECT b2 FROM cf), 6) AS coef_2,
       round(avg(CAST(CASE WHEN c > 0 THEN 1 WHEN c <= 0 THEN 0 ELSE -1 END = label AS DOUBLE)), 6) AS test_acc
FROM te"""


@query("var_price_regression_n1", _VAR1)
def q_var_price_regression_n1(spark, sf_dir):
    """M7 for n = 1 with its closed-form check: coefficients and direction accuracy."""
    s = price_samples(spark, sf_dir)
    tr, te = s.where(F.col("split") == 0), s.where(F.col("split") == 1)
    feats = F.transform(F.slice("opens", 1, 2), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    from pyspark.ml.regression import LinearRegression
    m = LinearRegression(featuresCol="_xv", labelCol="next_open", regParam=0.0, solver="normal").fit(
        M.assemble(tr.withColumn("_x", feats), ["_x"], "_xv"))
    p = M.var_price_regression(tr, te, 1)
    acc = p.agg(F.avg((F.col("predicted_label") == F.col("label")).cast("double")).alias("test_acc"))
    coef = m.coefficients.toArray().tolist()
    out = acc.select(F.lit(float(m.intercept)).alias("intercept"), F.lit(coef[0]).alias("coef_1"),
                     F.lit(coef[1]).alias("coef_2"), "test_acc")
    return rounded(out)


_M = T.N_PREV + 1  # opens x1.. and the next open y, as rows and columns of the swept matrix

# The sweep operator on one matrix per step: after step k the last column holds the regression on the first k opens.
_VAR_ALL = S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ps AS (
  SELECT next_open AS y, open AS x0, [open, {', '.join(f'coalesce(lag(open, {i}) OVER ({W}), 0)' for i in range(1, T.N_PREV))}] AS x,
         CASE WHEN abs(change) >= {T.SIG_PCT} THEN 1 ELSE 0 END AS label,
         CASE WHEN date <= DATE '{SPLIT_DATE}' THEN 0 ELSE 1 END AS split
  FROM series
  QUALIFY doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})),
tr AS (SELECT row_number() OVER () AS id, list_concat(x, [y]) AS v FROM ps WHERE split = 0 AND y IS NOT NULL),
lv AS (SELECT id, i, v[i] AS v FROM tr, range(1, {_M + 1}) r(i)),
mu AS (SELECT i, avg(v) AS m FROM lv GROUP BY i),
ce AS (SELECT id, i, v - m AS v FROM lv JOIN mu USING (i)),
cv AS (SELECT a.i, b.i AS j, avg(a.v * b.v) AS c FROM ce a JOIN ce b USING (id) GROUP BY ALL),
m0 AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i)),
sw AS (SELECT 0::BIGINT AS k, a FROM m0 UNION ALL
       SELECT k + 1, list_transform(range(1, {_M + 1}), lambda i: list_transform(range(1, {_M + 1}), lambda j:
         CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / a[i][j] WHEN i = k + 1 THEN a[i][j] / a[i][i]
              WHEN j = k + 1 THEN -a[i][j] / a[j][j] ELSE a[i][j] - a[i][k + 1] * a[k + 1][j] / a[k + 1][k + 1] END))
       FROM sw WHERE k < {T.N_PREV}),
co AS (SELECT n, list_transform(range(1, least(n + 1, {T.N_PREV}) + 1), lambda i: a[i][{_M}]) AS w
       FROM range(1, 21) r(n) JOIN sw ON k = least(n + 1, {T.N_PREV})),
ml AS (SELECT list(m ORDER BY i) AS m FROM mu),
cf AS (SELECT n, w, m[{_M}] - list_dot_product(w, m[1 : len(w)]) AS b FROM co, ml),
te AS (SELECT n, label, (b + list_dot_product(w, x[1 : len(w)]) - x0) * 100 / nullif(x0, 0) AS c
       FROM ps, cf WHERE split = 1 AND y IS NOT NULL)
SELECT CAST(n AS INTEGER) AS n_days, round(any_value(b), 4) AS intercept, round(any_value(w[1]), 6) AS coef_1,
       round(any_value(w[len(w)]), 6) AS coef_last,
       round(avg(CAST(CASE WHEN c > 0 THEN 1 WHEN c <= 0 THEN 0 ELSE -1 END = label AS DOUBLE)), 6) AS test_acc
FROM te JOIN cf USING (n) GROUP BY n"""


@query("var_price_regression", _VAR_ALL)
def q_var_price_regression(spark, sf_dir):
    """M7: OLS of the next open on today's and the n previous opens, n = 1..20, from one moment matrix; direction accuracy."""
    s = price_samples(spark, sf_dir)
    out = M.var_price_sweep(s.where(F.col("split") == 0), s.where(F.col("split") == 1), range(1, 21), T.N_PREV)
    return out.select("n_days", F.round("intercept", 4).alias("intercept"), *[F.round(c, 6).alias(c) for c in ("coef_1", "coef_last", "test_acc")])


SWEEP_SETS = [
    ("topics today", ["topic_today"]),
    ("topic change", ["topic_change"]),
    ("change + topic distribution", ["topic_change", "topic_today"]),
    ("stock t=1", ["stock1"]),
    ("stock t=5", ["stock5"]),
    ("topics today + stock t=1", ["topic_today", "stock1"]),
]


@query("feature_set_sweep")
def q_feature_set_sweep(spark, sf_dir):
    """M8: one logistic fit per feature combination; result table."""
    return M.feature_set_sweep(spark, sample_blocks(spark, sf_dir), SWEEP_SETS)


BLOCK_WIDTHS = [("topic_today", T.TOPIC_K), ("topic_change", T.TOPIC_K), ("stock1", 1), ("stock5", 5)]


def _set_columns() -> list[tuple[str, list[int]]]:
    """The sweep's sets as columns of all blocks side by side."""
    begin, at = {}, 0
    for name, width in BLOCK_WIDTHS:
        begin[name] = range(at, at + width)
        at += width
    return [(name, [i for b in blocks for i in begin[b]]) for name, blocks in SWEEP_SETS]


def _wide(spark, sf_dir):
    return sample_blocks(spark, sf_dir).select(*KEY, "label", "split", F.concat(*[b for b, _ in BLOCK_WIDTHS]).alias("features"))


def _tuned_sets(data):
    return M.tune_svm_sets(data.where(F.col("split") == 0), data.where(F.col("split") == 1), _set_columns())


def _best_C(rows) -> dict[str, float]:
    return {name: (mine := [r for r in rows if r[0] == name])[M.first_best(mine)][1] for name, _ in SWEEP_SETS}


@query("tune_all_feature_sets")
def q_tune_all_feature_sets(spark, sf_dir):
    """M9: linear-SVM tuning of every feature set on its train / test split, 15 values of C each."""
    with M.cached(_wide(spark, sf_dir)) as (data,):
        rows = _tuned_sets(data)
    best = _best_C(rows)
    return spark.createDataFrame([(*r, r[1] == best[r[0]]) for r in rows], "features string, C double, valid_acc double, best boolean")


@query("fit_selected")
def q_fit_selected(spark, sf_dir):
    """M6: every feature set refitted with its tuned C; predictions on its train and test rows."""
    data = cut_lineage(_wide(spark, sf_dir))
    best = _best_C(_tuned_sets(data))
    tuning = [(name, at, best[name]) for name, at in _set_columns()]
    preds = M.fit_selected(data.where(F.col("split") == 0), data.where(F.col("split") == 1), tuning, KEY)
    return preds.select(F.col("name").alias("features"), "part", *KEY, F.col("label").cast("int").alias("label"),
                        F.col("prediction").cast("int").alias("prediction"))


# The combinations of the sweep with text: every text kind with and without a stock block, stock alone, topics alone, and text
# with topics with and without a stock block.
STOCK_DAYS = (1, 5)
TEXT_ORDERS = {"BOW": 1, "ngrams": 3}
TOPIC_WIDTHS = {"today": 1, "change": 1, "change+today": 2, "today+hist": 1, "today|hist": 2, "change|today+hist": 2, "change|today|hist": 3}
TEXT_KINDS = [kind + end for kind in TEXT_ORDERS for end in ("", "-TFIDF")]
TEXT_FEATURES = 100_000
HISTORY = (0.9, 5)


def _combinations() -> list[tuple[str, list[str]]]:
    stocks = [[], *([f"stock{t}"] for t in STOCK_DAYS)]
    text = [[kind, *stock] for kind in TEXT_KINDS for stock in stocks]
    both = [[kind, topic, *stock] for kind in TEXT_KINDS for topic in ("today", "today+hist", "today|hist") for stock in stocks]
    return [(", ".join(blocks), blocks) for blocks in [*text, *stocks[1:], *([v] for v in TOPIC_WIDTHS), *both]]


def sweep_data(spark, sf_dir):
    """Labelled samples with every block of the sweep as a vector, stored once, and the blocks' widths."""
    s = labelled_samples(spark, sf_dir)
    f = TP.topic_features(s, T.topics(spark, sf_dir), KEY, [HISTORY[0]], [HISTORY[1]])
    arrays = [F.transform(F.array_sort(F.collect_list(F.when(F.col("variant") == v, F.struct("j", "value")))), lambda r: r["value"]).alias(f"_{v}")
              for v in TOPIC_WIDTHS]
    s = s.join(f.groupBy(*KEY).agg(*arrays), list(KEY), "inner")
    s = _md5_split(s).withColumn("train", F.col("split") == 0).withColumn("label", F.col("label").cast("double"))
    s = cut_lineage(s.select(*KEY, "doc_idx", "label", "train", "changes", *[f"`_{v}`" for v in TOPIC_WIDTHS]))
    widths = {v: n * T.TOPIC_K for v, n in TOPIC_WIDTHS.items()} | {f"stock{t}": t for t in STOCK_DAYS}
    coll = T.collection(spark, sf_dir).join(s.select("doc_idx").distinct(), "doc_idx", "left_semi")
    texts = cut_lineage(TX.clean_corpus(coll).select("doc_idx", X.join_tokens("tokens").alias("text")))
    for kind, order in TEXT_ORDERS.items():
        s, widths[kind] = SW.text_block(s, texts, kind, order, TEXT_FEATURES)
        widths[f"{kind}-TFIDF"] = widths[kind]
    s = cut_lineage(s)
    for kind in TEXT_ORDERS:
        s = SW.tfidf_block(s, kind, f"{kind}-TFIDF", widths[kind])
    for t in STOCK_DAYS:
        s = SW.dense_block(s.withColumn("_stock", M.stock_block("changes", t)), "_stock", f"stock{t}", t)
    for v in TOPIC_WIDTHS:
        s = SW.dense_block(s, f"_{v}", v, widths[v])
    return s.select("label", "train", *[f"`{b}`" for b in widths]), widths


def _sweep_sql() -> str:
    """Columns and text entries of every combination from the counts of all n-grams; the text kinds share them."""
    grams = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))"
    ctes = [S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES, f"""samp AS (
  SELECT symbol, date, doc_idx FROM series
  WHERE doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})),
ss AS (
  SELECT doc_idx, row_number() OVER (ORDER BY md5(symbol || '|' || CAST(date AS VARCHAR) || ':{SEED}'), symbol || '|' || CAST(date AS VARCHAR)) - 1
                  < round_even(count(*) OVER () * {1 - TEST_PORTION}, 0) AS train
  FROM samp WHERE doc_idx IN (SELECT vec_id FROM embeddings))""", S.CLEAN_DOCS, """uses AS (
  SELECT doc_idx, count(*) AS n, count(*) FILTER (WHERE train) AS n_train FROM ss GROUP BY doc_idx),
ww AS (SELECT doc_idx, n, n_train, regexp_extract_all(lower(array_to_string(tokens, ' ')), '\\b\\w\\w+\\b') AS w FROM toks JOIN uses USING (doc_idx)),
sz AS (SELECT count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE NOT train) AS test_rows FROM ss)"""]
    for kind, order in TEXT_ORDERS.items():
        lists = ", ".join(grams.format(n=n) for n in range(1, order + 1))
        ctes.append(f"""c_{kind} AS (SELECT doc_idx, n, n_train, term, count(*) AS cnt
  FROM (SELECT doc_idx, n, n_train, unnest(flatten([{lists}])) AS term FROM ww) GROUP BY ALL),
v_{kind} AS (SELECT term FROM c_{kind} WHERE n_train > 0 GROUP BY term ORDER BY sum(cnt * n_train) DESC, term ASC LIMIT {TEXT_FEATURES}),
t_{kind} AS (SELECT (SELECT count(*) FROM v_{kind}) AS width, (SELECT coalesce(sum(n), 0) FROM c_{kind} JOIN v_{kind} USING (term)) AS entries)""")
    fixed = {v: n * T.TOPIC_K for v, n in TOPIC_WIDTHS.items()} | {f"stock{t}": t for t in STOCK_DAYS}
    rows = []
    for name, blocks in _combinations():
        kind = next((k for k in TEXT_ORDERS if blocks[0].split("-")[0] == k), None)
        more = sum(fixed[b] for b in blocks if b in fixed)
        cols = f"width + {more}, entries FROM t_{kind}" if kind else f"{more}, 0"
        rows.append(f"SELECT '{name}' AS features, {cols}")
    parts = "\nUNION ALL ".join(rows)
    return S.with_(*ctes) + f"""SELECT features, CAST(n_features AS BIGINT) AS n_features, train_rows, test_rows, CAST(text_entries AS BIGINT) AS text_entries
FROM ({parts}) t(features, n_features, text_entries), sz"""


@query("feature_set_columns", _sweep_sql())
def q_feature_set_columns(spark, sf_dir):
    """M8: what each of the sweep's combinations of text, tf-idf, stock, topic and history blocks holds."""
    data, widths = sweep_data(spark, sf_dir)
    return SW.sweep_columns(spark, data, _combinations(), widths, TEXT_KINDS)
