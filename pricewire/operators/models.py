"""Model fitting and tuning as ``pyspark.ml`` jobs.

Fits are distributed by Spark ML; the driver only holds parameter grids and
metric rows.  Feature blocks stay ``array<double>`` until the fit, where they
are concatenated and turned into one ``VectorUDT`` column (``array_to_vector``).

Regularisation is mapped from the reference's ``C`` (penalty on the summed
loss) to Spark's ``regParam`` (penalty on the mean loss): ``regParam = 1/(C n)``.
"""

from __future__ import annotations

from typing import Iterable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.functions.prices import direction_from_price, slice_history
from pricewire.operators import grid as G

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel

# ---------------------------------------------------------------------------
# The reference's grids and settings.
LOGISTIC_C = [0.001, 0.01, 0.1, 1, 10, 100, 1000]
LOGISTIC_MAX_ITER = 500
SVM_C = [2.0 ** e for e in range(-5, 10)]        # 2^-5 .. 2^9
SVM_GAMMA = [2.0 ** e for e in range(-10, 3)]    # 2^-10 .. 2^2
SVR_EPSILON = [0, 0.01, 0.1, 0.5, 1, 2, 4, 8]
# ---------------------------------------------------------------------------

# Grid points fitted at the same time (independent Spark jobs, like
# ``CrossValidator(parallelism=...)``); each fit is itself distributed.
GRID_PARALLELISM = 8


def grid_map(fn, items, parallelism: int = GRID_PARALLELISM) -> list:
    """Run independent fits concurrently from driver threads, results in order."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as ex:
        return list(ex.map(fn, items))


@contextmanager
def cached(*frames: DataFrame):
    """Persist the (already narrowed) inputs of an iterative fit: every optimiser pass re-reads them, and without this each
    pass recomputes the whole plan.  The input is first rebalanced to even partitions (small ones merged at run time), and
    computed once, by its first reader.  Memory-and-disk, so a lost executor recomputes only its blocks."""
    out = [f.hint("rebalance").persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield out
    finally:
        for f in out:
            f.unpersist()


def reg_param(C: float, n: int) -> float:
    return 1.0 / (C * max(n, 1))


def assemble(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """join array blocks side by side into one vector column (a block left
    out is simply not listed).  The arrays are concatenated and converted once
    (``array_to_vector``), which needs no vector-size metadata, so it also
    works on an empty input (``VectorAssembler`` would read a first row)."""
    arr = F.concat(*[F.col(b) for b in blocks]) if len(blocks) > 1 else F.col(blocks[0])
    return df.withColumn(out, array_to_vector(arr))


def hstack_arrays(*blocks: Column) -> Column:
    """F10 in array form (for inspection and SQL checks)."""
    return F.concat(*blocks)


def stock_block(changes: str, n: int, include_today: bool = False) -> Column:
    """F8: ``n`` historical changes (NULL/NaN as 0) as a feature block."""
    sl = slice_history(changes, n, include_today)
    return F.transform(sl, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))


def scale_minmax(train: DataFrame, others: Iterable[DataFrame], col: str = "features",
                 lo: float = -1.0, hi: float = 1.0):
    """fit a [-1, 1] min-max scaler on ``train`` and apply it to every set.

    Constant features map to the middle (0); values outside the train range
    extrapolate.  Returns ``(train_scaled, [others_scaled])``.
    """
    sc = MinMaxScaler(min=lo, max=hi, inputCol=col, outputCol=f"{col}_scaled").fit(train)
    return sc.transform(train), [sc.transform(o) for o in others]


def _accuracy(pred: DataFrame, label: str = "label") -> float | None:
    """Share of right predictions; None without rows."""
    if pred.isEmpty():
        return None
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    return ev.evaluate(pred)


def fit_logistic(train: DataFrame, test: DataFrame, C: float = 1.0, features: str = "features",
                 label: str = "label", max_iter: int = LOGISTIC_MAX_ITER, tol: float = 1e-6):
    """M1: L2 logistic regression; returns ``(model, train_acc, test_acc)``: no model without train rows, no accuracy without
    rows or model."""
    with cached(train.select(features, label), test.select(features, label)) as (tr, te):
        n = tr.count()
        if not n:
            return None, None, None
        lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, elasticNetParam=0.0,
                                regParam=reg_param(C, n), standardization=False, tol=tol)
        # A pass sends one gradient a task, which is as wide as the vocabulary: no more tasks than cores.
        m = lr.fit(tr.coalesce(tr.sparkSession.sparkContext.defaultParallelism))
        return m, _accuracy(m.transform(tr), label), _accuracy(m.transform(te), label)


def tune_logistic(train: DataFrame, test: DataFrame, fold_col: str, Cs: Sequence[float] = LOGISTIC_C,
                  features: str = "features", label: str = "label", parallelism: int = 4):
    """M2: cross-validated C over stored folds (``fold_col`` 0-based), refit on all
    of train; returns ``(best_C, train_acc, test_acc, cv_metrics)``."""
    with cached(train.select(features, label, fold_col), test.select(features, label)) as (tr, te):
        n = tr.count()
        k = tr.agg(F.max(fold_col)).first()[0] + 1
        lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=LOGISTIC_MAX_ITER,
                                elasticNetParam=0.0, standardization=False)
        grid = ParamGridBuilder().addGrid(lr.regParam, [reg_param(C, n) for C in Cs]).build()
        ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                            numFolds=int(k), parallelism=parallelism)
        m = cv.fit(tr)
        best = max(range(len(Cs)), key=lambda i: (m.avgMetrics[i], -i))
        return (Cs[best], _accuracy(m.transform(tr), label), _accuracy(m.transform(te), label),
                list(m.avgMetrics))


def _grid_rows(blocks, models, names: Sequence[tuple]) -> list[tuple]:
    return [(*name, score) for name, score in zip(names, G.scores(blocks, models), strict=True)]


def first_best(rows: Sequence[tuple]) -> int:
    """Index of the highest last entry, the first of equals."""
    return max(range(len(rows)), key=lambda i: (rows[i][-1], -i))


def _scaled_features(train: DataFrame, features: str, scale: bool) -> Column:
    """The features, mapped to [-1, 1] by the ranges of ``train`` if ``scale``."""
    return G.scaled(F.col(features), *G.ranges(train, F.col(features))) if scale else F.col(features)


def tune_svm_sets(train: DataFrame, valid: DataFrame, sets: Sequence[tuple[str, Sequence[int]]], Cs: Sequence[float] = SVM_C,
                  features: str = "features", label: str = "label", classes: Sequence[float] = (0.0, 1.0),
                  scale: bool = True) -> list[tuple[str, float, float]]:
    """M9: rows ``(set, C, valid_acc)`` of a linear SVM for each column set of one array column and each C, all
    fitted together.  Three and more classes use one against the rest."""
    x = _scaled_features(train, features, scale)
    views = [G.Columns(tuple(at)) for _, at in sets]
    names = [(name, float(C)) for name, _ in sets for C in Cs]
    settings = [(v, C, -1) for v in range(len(sets)) for C in Cs]
    with G.packed(train, x, label, views) as tr, G.packed(valid, x, label, views) as va:
        found = _grid_rows(va, G.classifiers(tr, settings, classes), names)
    return [(name, C, score["accuracy"]) for name, C, score in found]


def tune_svm_linear(train: DataFrame, valid: DataFrame, Cs: Sequence[float] = SVM_C, features: str = "features",
                    label: str = "label", classes: Sequence[float] = (0.0, 1.0), dim: int = 64, scale: bool = True):
    """M3: C by validation accuracy (first best kept); returns rows ``(C, valid_acc)`` and the best C."""
    rows = [r[1:] for r in tune_svm_sets(train, valid, [("all", range(dim))], Cs, features, label, classes, scale)]
    return rows, rows[first_best(rows)][0]


def tune_svm_rbf_approx(train: DataFrame, valid: DataFrame, features: str, dim: int, Cs: Sequence[float] = SVM_C,
                        gammas: Sequence[float] = SVM_GAMMA, n_out: int = 128, label: str = "label",
                        classes: Sequence[float] = (0.0, 1.0), seed: int = 7, scale: bool = True):
    """M4: the C x gamma grid of a linear SVM on random Fourier features (approximate RBF kernel by design), all points
    fitted together on one projection.  Rows ``(C, gamma, valid_acc)``, C first as in the reference's loops."""
    x = _scaled_features(train, features, scale)
    draw = G.Projection.draw(dim, n_out, seed)
    views = draw.views(gammas)
    grid = [(C, v) for C in Cs for v in range(len(views))]
    with G.packed(train, x, label, views, draw) as tr, G.packed(valid, x, label, views, draw) as va:
        models = G.classifiers(tr, [(v, C, -1) for C, v in grid], classes)
        found = _grid_rows(va, models, [(float(C), float(gammas[v])) for C, v in grid])
    return [(C, g, score["accuracy"]) for C, g, score in found]


def tune_svr(train: DataFrame, valid: DataFrame, features: str, dim: int, Cs: Sequence[float] = SVM_C,
             gammas: Sequence[float] | None = SVM_GAMMA, epsilons: Sequence[float] = SVR_EPSILON, n_out: int = 128,
             label: str = "label", seed: int = 7, scale: bool = True):
    """M5: epsilon-insensitive regression over C, gamma and epsilon on random Fourier features (``gammas=None``: linear).
    Rows ``(C, gamma or None, epsilon, mse, r2)``; all points are fitted together."""
    x = _scaled_features(train, features, scale)
    draw = G.Projection.draw(dim, n_out, seed) if gammas is not None else None
    views = draw.views(gammas) if draw else [G.Columns(tuple(range(dim)))]
    grid = [(C, v, e) for C in Cs for v in range(len(views)) for e in epsilons]
    with G.packed(train, x, label, views, draw) as tr, G.packed(valid, x, label, views, draw) as va:
        points = [G.Point(v, "epsilon", float(C), epsilon=float(e)) for C, v, e in grid]
        models = [G.Model((p,), (w,)) for p, w in zip(points, G.fit(tr, points), strict=True)]
        found = _grid_rows(va, models, [(float(C), float(gammas[v]) if draw else None, float(e)) for C, v, e in grid])
    return [(C, g, e, score["mse"], score["r2"]) for C, g, e, score in found]


def tune_regression(train: DataFrame, valid: DataFrame, reg_params: Sequence[float],
                    losses: Sequence[str] = ("squaredError", "huber"), features: str = "features",
                    label: str = "label"):
    """M5: regression grid by validation MSE (with squared correlation).
    Rows ``(loss, regParam, mse, r2)``."""
    with cached(train.select(features, label), valid.select(features, label)) as (tr, va):
        def one(point):
            loss, rp = point
            lr = LinearRegression(featuresCol=features, labelCol=label, loss=loss, regParam=rp,
                                  elasticNetParam=0.0, maxIter=100)
            p = lr.fit(tr).transform(va)
            e = F.col("prediction") - F.col(label)
            r = p.agg(F.avg(e * e).alias("mse"), F.pow(F.corr("prediction", label), 2).alias("r2")).first()
            return loss, float(rp), *(None if r[c] is None else float(r[c]) for c in ("mse", "r2"))  # no rows: NULL

        return grid_map(one, [(loss, rp) for loss in losses for rp in reg_params])


def var_price_regression(train: DataFrame, test: DataFrame, n_days: int, opens: str = "opens",
                         target: str = "next_open", label: str = "label") -> DataFrame:
    """M7: OLS of the next open on today's and the ``n_days`` previous opens
    (missing opens as 0, as the reference does), then the predicted direction
    (L12) against the label.  Returns the test predictions
    ``(..., prediction, predicted_label)``."""
    feats = F.transform(F.slice(opens, 1, n_days + 1), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    tr = assemble(train.withColumn("_x", feats), ["_x"], "_xv").select("_xv", target)
    te = assemble(test.withColumn("_x", feats), ["_x"], "_xv")
    lr = LinearRegression(featuresCol="_xv", labelCol=target, regParam=0.0, solver="normal")
    with cached(tr) as (tr_c,):
        m = lr.fit(tr_c)
    p = m.transform(te)
    x0 = F.col("_x")[0]
    change = F.try_divide((F.col("prediction") - x0) * 100, x0)
    return p.withColumn("predicted_label", direction_from_price(change)).drop("_x", "_xv")


def price_moments(train: DataFrame, width: int, opens: str = "opens", target: str = "next_open") -> tuple[np.ndarray, np.ndarray]:
    """Means and centred second moments of ``(opens..., target)``, two aggregates over the rows (missing opens as 0)."""
    v = F.concat(F.transform(F.slice(opens, 1, width), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))), F.array(F.col(target)))
    rows = train.select(v.alias("v"))
    mean = rows.select(Summarizer.mean(array_to_vector("v")).alias("m")).first()["m"]
    if mean is None or not len(mean):
        return np.zeros(width + 1), np.zeros((width + 1, width + 1))
    centre = F.array(*[F.lit(float(m)) for m in mean])
    c = rows.select(F.zip_with("v", centre, lambda a, b: a - b).alias("c"))
    outer = F.flatten(F.transform("c", lambda a: F.transform("c", lambda b: a * b)))
    second = c.select(Summarizer.mean(array_to_vector(outer)).alias("m")).first()["m"]
    return mean.toArray(), second.toArray().reshape(width + 1, width + 1)


def var_price_sweep(train: DataFrame, test: DataFrame, days: Iterable[int], width: int, opens: str = "opens",
                    target: str = "next_open", label: str = "label") -> DataFrame:
    """M7 for every number of days: the normal equations of n days are the leading block of one moment matrix of
    all ``width`` opens.  ``(n_days, intercept, coef_1, coef_last, test_acc)``; ``test`` is read once."""
    mean, second = price_moments(train, width, opens, target)
    fits = []
    for n in days:
        k = min(n + 1, width)
        w = np.linalg.lstsq(second[:k, :k], second[:k, -1], rcond=None)[0]
        fits.append((int(n), float(mean[-1] - w @ mean[:k]), w.tolist()))
    coded = F.array(*[F.struct(F.lit(n).alias("n_days"), F.lit(b).alias("intercept"), F.array(*[F.lit(x) for x in w]).alias("w")) for n, b, w in fits])
    x = F.transform(opens, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    d = test.select(x.alias("x"), F.col(label).alias("label"), F.explode(coded).alias("m")).select("x", "label", "m.*")
    dot = F.aggregate(F.zip_with("w", F.slice("x", F.lit(1), F.size("w")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    change = F.try_divide((dot + F.col("intercept") - F.col("x")[0]) * 100, F.col("x")[0])
    hit = F.avg((direction_from_price(change) == F.col("label")).cast("double"))
    return d.groupBy("n_days").agg(F.first("intercept").alias("intercept"), F.first(F.col("w")[0]).alias("coef_1"),
                                   F.first(F.element_at("w", -1)).alias("coef_last"), hit.alias("test_acc"))


def feature_set_sweep(spark: SparkSession, data: DataFrame, sets: Sequence[tuple[str, Sequence[str]]],
                      label: str = "label", split_col: str = "split", C: float = 1.0) -> DataFrame:
    """M8: one logistic fit per feature set ``(name, [array blocks])`` over the same
    cached data; result table ``(features, n_features, train_acc, test_acc)``, NULL where no row tells."""
    def one(item):
        name, blocks = item
        a = assemble(data, list(blocks))
        tr, te = a.where(F.col(split_col) == 0), a.where(F.col(split_col) == 1)
        row = a.select("features").first()
        nf = None if row is None else len(row["features"])
        _, acc_tr, acc_te = fit_logistic(tr, te, C, label=label)
        return name, nf, acc_tr, acc_te

    with cached(data) as (data,):
        rows = grid_map(one, sets)
    return spark.createDataFrame(rows, "features string, n_features int, train_acc double, test_acc double")


def fit_selected(train: DataFrame, test: DataFrame, tuning: Sequence[tuple[str, Sequence[int], float]], keys: Sequence[str],
                 features: str = "features", label: str = "label", classes: Sequence[float] = (0.0, 1.0)) -> DataFrame:
    """M6: every feature set ``(name, columns, tuned C)`` refitted on ``train`` (scaled to [-1, 1]), all together, and its
    predictions on both sets: ``keys, label, name, prediction, part`` (train or test)."""
    x = _scaled_features(train, features, True)
    views = [G.Columns(tuple(at)) for _, at, _ in tuning]
    with G.packed(train, x, label, views) as tr:
        models = G.classifiers(tr, [(v, C, -1) for v, (_, _, C) in enumerate(tuning)], classes)
    named = [(name, m) for (name, _, _), m in zip(tuning, models, strict=True)]
    both = [G.predictions(df, keys, x, views, named, label).withColumn("part", F.lit(part)) for df, part in ((train, "train"), (test, "test"))]
    return both[0].unionByName(both[1])


def to_array(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, vector_to_array(F.col(col)))

