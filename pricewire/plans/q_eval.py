"""Evaluation queries over the four fixed prediction runs of the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.operators import evaluate as O
from pricewire.operators import topics as TP
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.plans.q_prices import labelled_samples
from pricewire.sources import tables as T

_PREDS = S.with_(S.LABELS3, S.PREDICTIONS)
_CELLS = """cells AS (
  SELECT r.run_id, t.c AS actual, p.c AS predicted, CAST(count(x.row_idx) AS BIGINT) AS n
  FROM (SELECT DISTINCT run_id FROM preds) r
  CROSS JOIN (VALUES (-1), (0), (1)) t(c) CROSS JOIN (VALUES (-1), (0), (1)) p(c)
  LEFT JOIN preds x ON x.run_id = r.run_id AND x.label = t.c AND x.prediction = p.c
  GROUP BY ALL)"""
_COUNTS = """cc AS (
  SELECT run_id, k.c AS cls,
         CAST(sum(CASE WHEN actual = k.c AND predicted = k.c THEN n ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN actual = k.c AND predicted <> k.c THEN n ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN actual <> k.c AND predicted = k.c THEN n ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN actual <> k.c AND predicted <> k.c THEN n ELSE 0 END) AS BIGINT) AS tn
  FROM cells CROSS JOIN (VALUES (-1), (0), (1)) k(c) GROUP BY ALL)"""
_PR = """pr AS (
  SELECT run_id, cls,
         coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(tn / nullif(fp + tn, 0), 0) AS specificity FROM cc),
prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
         CASE WHEN precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END AS f05,
         CASE WHEN precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2
  FROM pr)"""
_METRICS = """acc AS (SELECT run_id, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM preds GROUP BY run_id),
mf AS (SELECT run_id, avg(f1) AS f1_all, avg(CASE WHEN cls IN (-1, 1) THEN f1 END) AS f1_pos_neg FROM prf GROUP BY run_id),
metrics AS (SELECT run_id, split_part(run_id, '_', 1) AS family, accuracy, f1_all, f1_pos_neg
            FROM acc JOIN mf USING (run_id))"""


def preds(spark, sf_dir):
    return T.model_predictions(spark, sf_dir)


@query("confusion_matrix", _PREDS + ", " + _CELLS + """
SELECT run_id, actual,
       CAST(sum(CASE WHEN predicted = -1 THEN n ELSE 0 END) AS BIGINT) AS n_m1,
       CAST(sum(CASE WHEN predicted = 0 THEN n ELSE 0 END) AS BIGINT) AS n_0,
       CAST(sum(CASE WHEN predicted = 1 THEN n ELSE 0 END) AS BIGINT) AS n_p1
FROM cells GROUP BY run_id, actual""")
def q_confusion_matrix(spark, sf_dir):
    """3 x 3 confusion matrix per run (true classes without rows included)."""
    return O.confusion_matrix(preds(spark, sf_dir))


@query("class_counts_tp_fp", _PREDS + ", " + _CELLS + ", " + _COUNTS + """
SELECT run_id, cls, tp, fn, fp, tn FROM cc""")
def q_class_counts_tp_fp(spark, sf_dir):
    """Tp / fn / fp / tn per run and class."""
    return O.class_counts_tp_fp(preds(spark, sf_dir))


@query("precision_recall", _PREDS + ", " + _CELLS + ", " + _COUNTS + ", " + _PR + """
SELECT run_id, cls, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(f05, 6) AS f05, round(f2, 6) AS f2
FROM prf""")
def q_precision_recall(spark, sf_dir):
    """E3 + E4: precision, recall, specificity and F-scores per class."""
    return rounded(O.precision_recall(preds(spark, sf_dir)))


@query("accuracy", _PREDS + """
SELECT run_id, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM preds GROUP BY run_id""")
def q_accuracy(spark, sf_dir):
    """E5: accuracy per run."""
    return rounded(O.accuracy(preds(spark, sf_dir)))


@query("evaluate_runs", _PREDS + ", " + _CELLS + ", " + _COUNTS + ", " + _PR + ", " + _METRICS + """
SELECT run_id, family, round(accuracy, 6) AS accuracy, round(f1_all, 6) AS f1_all,
       round(f1_pos_neg, 6) AS f1_pos_neg FROM metrics""")
def q_evaluate_runs(spark, sf_dir):
    """E6 + E7: accuracy and macro F1 (all classes; -1 and 1) for every run in one job."""
    return rounded(O.evaluate_runs(preds(spark, sf_dir)))


@query("best_model", _PREDS + ", " + _CELLS + ", " + _COUNTS + ", " + _PR + ", " + _METRICS + """
SELECT family, metric, run_id, round(value, 6) AS value FROM (
  SELECT family, 'f1_all' AS metric, run_id, f1_all AS value FROM metrics
  QUALIFY row_number() OVER (PARTITION BY family ORDER BY f1_all DESC, run_id ASC) = 1
  UNION ALL
  SELECT family, 'f1_pos_neg', run_id, f1_pos_neg FROM metrics
  QUALIFY row_number() OVER (PARTITION BY family ORDER BY f1_pos_neg DESC, run_id ASC) = 1)""")
def q_best_model(spark, sf_dir):
    """V4: best run per feature family by each mean F1."""
    m = O.evaluate_runs(preds(spark, sf_dir))
    return rounded(O.best_model(m, "f1_all").unionByName(O.best_model(m, "f1_pos_neg")))


def _pairs_sql(r1, r2):
    return f"""SELECT '{r1}' AS model1, '{r2}' AS model2,
    CAST(sum(CASE WHEN a.prediction = a.label AND b.prediction = b.label THEN 1 ELSE 0 END) AS BIGINT) AS a,
    CAST(sum(CASE WHEN a.prediction = a.label AND b.prediction <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS b,
    CAST(sum(CASE WHEN a.prediction <> a.label AND b.prediction = b.label THEN 1 ELSE 0 END) AS BIGINT) AS c,
    CAST(sum(CASE WHEN a.prediction <> a.label AND b.prediction <> b.label THEN 1 ELSE 0 END) AS BIGINT) AS d
  FROM preds a JOIN preds b ON a.row_idx = b.row_idx AND a.run_id = '{r1}' AND b.run_id = '{r2}'"""


PAIRS = [("hist_a", "change_a"), ("hist_a", "change_b")]


@query("paired_outcomes", _PREDS + _pairs_sql("change_a", "hist_b"))
def q_paired_outcomes(spark, sf_dir):
    """right/wrong agreement counts of two models on the same rows."""
    return O.paired_outcomes(preds(spark, sf_dir), "change_a", "hist_b")


@query("mcnemar", _PREDS + "SELECT model1, model2, a, b, c, d, round((b - c) * (b - c) / nullif(b + c, 0), 6) AS chi2 "
       "FROM (" + " UNION ALL ".join(_pairs_sql(a, b) for a, b in PAIRS) + ")")
def q_mcnemar(spark, sf_dir):
    """McNemar chi-square of the history model against the two change models."""
    p = preds(spark, sf_dir)
    outs = [O.mcnemar(O.paired_outcomes(p, a, b)) for a, b in PAIRS]
    return rounded(outs[0].unionByName(outs[1]))


@query("regression_metrics", S.with_(S.PRICES, S.SYMBOL_MAP, S.COLLECTION, S.DOCS_PER_DAY, S.SERIES) + f"""
SELECT round(avg((open - next_open) * (open - next_open)), 6) AS mse,
       round(power(corr(open, next_open), 2), 6) AS r2
FROM series
WHERE doc_idx IS NOT NULL AND (abs(change) >= {T.SIG_PCT} OR abs(change) <= {T.INSIG_PCT})""")
def q_regression_metrics(spark, sf_dir):
    """MSE and squared correlation of a no-change forecast (today's open for the next open)."""
    s = labelled_samples(spark, sf_dir).select(F.col("next_open").alias("y"), F.col("open").alias("p"))
    return rounded(O.regression_metrics(s))


def libsvm_lines(spark, sf_dir):
    """LIBSVM lines of the topic features, with some lines damaged on purpose
    (bad label, value ``nan``, index out of order, empty line)."""
    lab = T.class_labels(spark, sf_dir).select("doc_idx", F.col("quality").alias("label"))
    lines = TP.topic_libsvm(lab, T.topics(spark, sf_dir))
    d, v = F.col("doc_idx"), F.col("line")
    damaged = (F.when(d % 29 == 0, F.lit(""))
                .when(d % 17 == 0, F.regexp_replace(v, r"^\S+", "x"))
                .when(d % 23 == 0, F.regexp_replace(v, r" 1:\S+", " 1:nan"))
                .when(d % 19 == 0, F.concat(v, F.lit(" 3:0.5")))
                .otherwise(v))
    return lines.select((d + 1).alias("line_no"), damaged.alias("value"))


_LIBSVM_SQL = S.with_(S.TOPICS, r"""base AS (
  SELECT l.doc_id AS doc_idx,
         CAST(l.quality AS VARCHAR) || ' ' ||
         array_to_string(list_transform(range(1, len(t.topic) + 1),
                         lambda i: CAST(i AS VARCHAR) || ':' || printf('%.6f', t.topic[i])), ' ') AS line
  FROM labels l JOIN topics_n t ON t.doc_idx = l.doc_id),
ln AS (
  SELECT doc_idx + 1 AS line_no,
         CASE WHEN doc_idx % 29 = 0 THEN ''
              WHEN doc_idx % 17 = 0 THEN regexp_replace(line, '^\S+', 'x')
              WHEN doc_idx % 23 = 0 THEN regexp_replace(line, ' 1:\S+', ' 1:nan')
              WHEN doc_idx % 19 = 0 THEN line || ' 3:0.5'
              ELSE line END AS value FROM base),
tk AS (
  SELECT line_no, CAST(pos - 1 AS INTEGER) AS pos, tok FROM (
    SELECT line_no, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
    FROM (SELECT line_no, list_filter(string_split_regex(trim(value), '\s+'), lambda x: x <> '') AS t FROM ln))),
ft AS (
  SELECT line_no, pos,
         CASE WHEN len(string_split(tok, ':')) = 2
                   AND regexp_matches(string_split(tok, ':')[1], '^[+-]?[0-9]+$')
                   AND regexp_matches(string_split(tok, ':')[2], '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
                   AND NOT contains(lower(string_split(tok, ':')[2]), 'nan')
                   AND NOT contains(lower(string_split(tok, ':')[2]), 'inf')
              THEN TRY_CAST(string_split(tok, ':')[1] AS BIGINT) END AS idx
  FROM tk WHERE pos > 0),
fp AS (
  SELECT *, coalesce(last_value(idx IGNORE NULLS) OVER (PARTITION BY line_no ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev FROM ft),
problems AS (
  SELECT line_no, pos, 'bad label' AS problem FROM tk
  WHERE pos = 0 AND NOT list_bool_and(list_transform(
        CASE WHEN contains(tok, ',') THEN string_split(tok, ',') ELSE [tok] END,
        lambda p: regexp_matches(p, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$')
                  AND NOT contains(lower(p), 'nan') AND NOT contains(lower(p), 'inf')))
  UNION ALL SELECT line_no, 0, 'missing label' FROM ln WHERE line_no NOT IN (SELECT line_no FROM tk)
  UNION ALL SELECT line_no, pos, 'bad pair' FROM fp WHERE idx IS NULL
  UNION ALL SELECT line_no, pos, 'negative index' FROM fp WHERE idx < 0
  UNION ALL SELECT line_no, pos, 'not ascending' FROM fp WHERE idx >= 0 AND idx <= prev)""")


@query("check_libsvm", _LIBSVM_SQL + "SELECT line_no, pos, problem FROM problems")
def q_check_libsvm(spark, sf_dir):
    """Every problem of every LIBSVM line, one row each."""
    return O.check_libsvm(libsvm_lines(spark, sf_dir)).select(
        F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("int").alias("pos"), "problem")


@query("check_libsvm_summary", _LIBSVM_SQL + "SELECT CAST(count(DISTINCT line_no) AS BIGINT) AS bad_lines FROM problems")
def q_check_libsvm_summary(spark, sf_dir):
    """Number of lines with a problem."""
    return O.bad_line_count(O.check_libsvm(libsvm_lines(spark, sf_dir)))
