"""Result-log tables (P6, A10-A13) over parsed log lines (``sources.files.parse_run_log``).

A repeated key in a log keeps its last line, as the reference's dict updates
do: ``max_by(value, line_no)`` per key, a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_runs(log: DataFrame, contains: str | None = None, excludes: str | None = None) -> DataFrame:
    """Lines whose text contains / does not contain a marker (``cond``, ``today``, ...)."""
    out = log
    if contains is not None:
        out = out.where(F.col("value").contains(contains))
    if excludes is not None:
        out = out.where(~F.col("value").contains(excludes))
    return out


def _last(log: DataFrame, keys: list[str], value: str = "test_acc") -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by(value, "line_no").alias(value))


def best_test_by_group(log: DataFrame, by: list[str], last_of: list[str] | None = None) -> DataFrame:
    """A10: best test accuracy per group (e.g. (alpha, L), k, k x add/cont).  With ``last_of`` only the last line of each
    such key counts, as for (alpha, L) over its k; without it every line does, as for k."""
    return (_last(log, last_of) if last_of else log).groupBy(*by).agg(F.max("test_acc").alias("best_test_acc"))


def history_runs(log: DataFrame, cont: bool = False) -> DataFrame:
    """History lines whose topics are added to today's or, with ``cont``, put beside them (marked ``cond``)."""
    return select_runs(select_runs(log, "alpha"), *(("cond", None) if cont else (None, "cond")))


def pivot_alpha_window(log: DataFrame, cont: bool = False) -> DataFrame:
    """Alpha x L table of the best accuracy over k of the 'add' or the ``cont`` history lines."""
    best = best_test_by_group(history_runs(log, cont), ["alpha", "L"], ["alpha", "L", "k"])
    return best.groupBy("alpha").pivot("L").agg(F.max("best_test_acc")).orderBy("alpha")


def add_beside_cont(log: DataFrame) -> DataFrame:
    """A10: ``(k, add, cont)``: best accuracy of either kind of history line per k that has 'add' lines."""
    add = best_test_by_group(history_runs(log), ["k"]).withColumnRenamed("best_test_acc", "add")
    cont = best_test_by_group(history_runs(log, cont=True), ["k"]).withColumnRenamed("best_test_acc", "cont")
    return add.join(cont, "k", "left").orderBy("k")


def pivot_change_vs_dist(log: DataFrame) -> DataFrame:
    """Per k, 'change only' next to 'change + topic distribution' (last line wins)."""
    v = (log.withColumn("variant", F.when(F.col("value").contains("topic distribution"), F.lit("dist"))
                                    .when(F.col("value").contains("change only"), F.lit("change")))
            .where(F.col("variant").isNotNull()))
    return v.groupBy("k").pivot("variant", ["change", "dist"]).agg(F.max_by("test_acc", "line_no")).orderBy("k")


def today_by_k(log: DataFrame) -> DataFrame:
    """Accuracy of the 'today' lines by k (last line wins)."""
    return _last(select_runs(log, "today"), ["k"]).orderBy("k")


def history_by_t(log: DataFrame) -> DataFrame:
    """Accuracy by number of previous days = line order (1-based)."""
    return log.select((F.col("line_no") + 1).alias("days"), "test_acc").orderBy("days")
