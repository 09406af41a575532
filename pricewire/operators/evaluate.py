"""Evaluation.

All metrics are computed for every run in one grouped job: predictions
``(run_id, row_idx, label, prediction)`` are first reduced to confusion
cells ``(run_id, true, pred, n)`` (a partial aggregate, at most 9 rows per
run), and every later metric works on that tiny table.  Definitions are the
standard ones (the reference swaps fp/fn and reuses a stale F value when
p + r = 0; see SURVEY Q4/Q5).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewire.sources.files import with_line_numbers

# The three classes and their order.
CLASSES = [-1, 0, 1]


def confusion_cells(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """``(run_id, actual, predicted, n)`` for every class pair, zeros included."""
    cnt = preds.groupBy("run_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    runs = preds.select("run_id").distinct()
    pairs = F.array(*[F.struct(F.lit(t).alias("actual"), F.lit(p).alias("predicted")) for t in classes for p in classes])
    grid = runs.select("run_id", F.inline(pairs))
    return (grid.join(cnt, ["run_id", "actual", "predicted"], "left")
                .select("run_id", "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_matrix(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """``(run_id, actual, n_m1, n_0, n_p1)`` - one row per true class (3 x 3)."""
    cells = confusion_cells(preds, classes)
    cols = [F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).cast("long")
            .alias(f"n_{'m' if c < 0 else ('p' if c > 0 else '')}{abs(c)}") for c in classes]
    return cells.groupBy("run_id", "actual").agg(*cols)


def class_counts_tp_fp(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """``(run_id, cls, tp, fn, fp, tn)`` per class (standard definitions)."""
    cells = confusion_cells(preds, classes)
    x = cells.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls"))
    t, p, n = F.col("actual") == F.col("cls"), F.col("predicted") == F.col("cls"), F.col("n")

    def s(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0)).cast("long")

    return x.groupBy("run_id", "cls").agg(s(t & p).alias("tp"), s(t & ~p).alias("fn"),
                                          s(~t & p).alias("fp"), s(~t & ~p).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    """``(1 + b^2) p r / (b^2 p + r)``, 0 when p + r = 0."""
    b2 = float(beta) ** 2
    return F.when(p + r > 0, (1 + b2) * p * r / (F.lit(b2) * p + r)).otherwise(F.lit(0.0))


def precision_recall(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """E3 + E4: precision, recall, specificity, F1, F0.5, F2 per (run, class)."""
    c = class_counts_tp_fp(preds, classes)
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    out = c.select("run_id", "cls", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                   _ratio(tn, fp + tn).alias("specificity"))
    p, r = F.col("precision"), F.col("recall")
    return out.select("*", f_beta(p, r, 1).alias("f1"), f_beta(p, r, 0.5).alias("f05"), f_beta(p, r, 2).alias("f2"))


def accuracy(preds: DataFrame) -> DataFrame:
    """E5: ``(run_id, accuracy)``."""
    return preds.groupBy("run_id").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def macro_f1(preds: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Mean F1 of all classes, and of the two outer classes (-1 and 1)."""
    pr = precision_recall(preds, classes)
    outer = F.col("cls").isin(min(classes), max(classes))
    return pr.groupBy("run_id").agg(F.avg("f1").alias("f1_all"),
                                    F.avg(F.when(outer, F.col("f1"))).alias("f1_pos_neg"))


def evaluate_runs(preds: DataFrame, family: Column | None = None) -> DataFrame:
    """Accuracy and macro F1 of every run, with its feature family."""
    fam = family if family is not None else F.split(F.col("run_id"), "_").getItem(0)
    runs = preds.select("run_id").distinct().withColumn("family", fam)
    return runs.join(accuracy(preds), "run_id").join(macro_f1(preds), "run_id")


def best_model(metrics: DataFrame, by: str) -> DataFrame:
    """V4: best run per family by ``by`` (ties: lowest run_id, i.e. first in sorted order)."""
    w = Window.partitionBy("family").orderBy(F.col(by).desc(), F.col("run_id").asc())
    return (metrics.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                   .select("family", F.lit(by).alias("metric"), "run_id", F.col(by).alias("value")))


def paired_outcomes(preds: DataFrame, run1: str, run2: str) -> DataFrame:
    """``a`` both right, ``b`` only 1 right, ``c`` only 2 right, ``d`` both wrong."""
    p1 = preds.where(F.col("run_id") == run1).select("row_idx", "label", (F.col("prediction") == F.col("label")).alias("r1"))
    p2 = preds.where(F.col("run_id") == run2).select("row_idx", (F.col("prediction") == F.col("label")).alias("r2"))
    j = p1.join(p2, "row_idx", "inner")
    r1, r2 = F.col("r1"), F.col("r2")

    def s(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return j.agg(s(r1 & r2).alias("a"), s(r1 & ~r2).alias("b"), s(~r1 & r2).alias("c"), s(~r1 & ~r2).alias("d")) \
            .select(F.lit(run1).alias("model1"), F.lit(run2).alias("model2"), "*")


def mcnemar(outcomes: DataFrame) -> DataFrame:
    """``chi2 = (b - c)^2 / (b + c)`` without continuity correction (NULL when b + c = 0)."""
    b, c = F.col("b").cast("double"), F.col("c").cast("double")
    return outcomes.withColumn("chi2", F.try_divide((b - c) * (b - c), b + c))


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", group: Sequence[str] = ()) -> DataFrame:
    """Mean squared error and squared correlation."""
    e = F.col(p) - F.col(y)
    return df.groupBy(*group).agg(F.avg(e * e).alias("mse"), F.pow(F.corr(p, y), 2).alias("r2"))


# --------------------------------------------------------------------------- LIBSVM check
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT = r"^[+-]?[0-9]+$"


def _is_number(c: Column) -> Column:
    low = F.lower(c)
    return c.rlike(_NUMBER) & ~low.contains("nan") & ~low.contains("inf")


def check_libsvm(lines: DataFrame, ends_with_newline: bool = True, by: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """One row per problem ``(line_no, pos, problem)`` of LIBSVM text lines
    ``(line_no, value)`` (1-based line numbers); ``by`` names the columns that identify a line.

    Problems: ``missing label`` (empty line), ``bad label`` (also each part of a
    comma multi-label), ``bad pair`` (not ``int:number``), ``negative index``,
    ``not ascending`` (compared with the last well-formed index of the line,
    starting at -1; index 0 is allowed) and ``no newline`` (last line only,
    when the text does not end with one).
    """
    toks = lines.select(*by, F.posexplode(F.filter(F.split(F.trim(F.col("value")), r"\s+"),
                                                        lambda t: t != F.lit(""))).alias("pos", "tok"))
    label = toks.where(F.col("pos") == 0)
    multi = F.col("tok").contains(",")
    label_ok = F.when(multi, F.forall(F.split(F.col("tok"), ","), _is_number)).otherwise(_is_number(F.col("tok")))
    bad_label = label.where(~label_ok).select(*by, "pos", F.lit("bad label").alias("problem"))
    nonempty = label.select(*by)
    missing = lines.join(nonempty, list(by), "left_anti").select(
        *by, F.lit(0).alias("pos"), F.lit("missing label").alias("problem"))
    feats = toks.where(F.col("pos") > 0)
    parts = F.split(F.col("tok"), ":")
    ok_pair = (F.size(parts) == 2) & parts.getItem(0).rlike(_INT) & _is_number(parts.getItem(1))
    f = feats.select(*by, "pos", F.when(ok_pair, parts.getItem(0).try_cast("long")).alias("idx"))
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_prev", F.coalesce(F.last("idx", ignorenulls=True).over(w), F.lit(-1)))
    bad_pair = f.where(F.col("idx").isNull()).select(*by, "pos", F.lit("bad pair").alias("problem"))
    neg = f.where(F.col("idx") < 0).select(*by, "pos", F.lit("negative index").alias("problem"))
    asc = f.where((F.col("idx") >= 0) & (F.col("idx") <= F.col("_prev"))).select(
        *by, "pos", F.lit("not ascending").alias("problem"))
    out = bad_label.unionByName(missing).unionByName(bad_pair).unionByName(neg).unionByName(asc)
    if not ends_with_newline:
        last = lines.agg(F.max("line_no").alias("line_no")).select(
            "line_no", F.lit(-1).alias("pos"), F.lit("no newline").alias("problem"))
        out = out.unionByName(last)
    return out


def check_libsvm_files(spark: SparkSession, path: str) -> DataFrame:
    """E11 over the LIBSVM files of a folder: ``(file, line_no, pos, problem)`` with 1-based line numbers per file.

    A file lacks its last newline when its size is one byte less than its lines with a newline each; that row names
    the last line, at ``pos`` -1.  (Compressed files have another size and are not told apart.)  Empty files have no rows.
    """
    raw = spark.read.option("lineSep", "\n").text(path).withColumn("_size", F.col("_metadata.file_size"))
    lines = with_line_numbers(raw).select(F.col("file_path").alias("file"), (F.col("line_no") + 1).alias("line_no"), "value", "_size")
    ends = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"),
                                     F.max("line_no").alias("line_no"))
    cut = ends.where(F.col("_bytes") == F.col("_size") + 1).select("file", "line_no", F.lit(-1).alias("pos"),
                                                                  F.lit("no newline").alias("problem"))
    return check_libsvm(lines, by=("file", "line_no")).unionByName(cut)


def bad_line_count(problems: DataFrame) -> DataFrame:
    """E11 summary: number of lines with at least one problem."""
    return problems.agg(F.countDistinct("line_no").cast("long").alias("bad_lines"))
