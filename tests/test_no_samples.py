"""The model jobs over samples without rows: no document of the topics is the last one of a company's day."""

import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewire.operators import grid as G
from pricewire.operators import models as M

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings")


def test_model_queries_without_samples(spark, tmp_path):
    for t in TABLES:
        d = spark.read.parquet(f"{SF}/{t}.parquet")
        (d.withColumn("vec_id", F.col("vec_id") + 1_000_000) if t == "embeddings" else d).write.parquet(str(tmp_path / f"{t}.parquet"))
    q = entry.queries()
    cols = q["feature_set_columns"](spark, str(tmp_path)).collect()
    assert len(cols) == 57 and all(tuple(r)[2:] == (0, 0, 0) for r in cols)
    assert {r.features: r.n_features for r in cols}["change|today|hist"] == 192
    assert {r.features: r.n_features for r in cols}["BOW, stock5"] == 5
    sweep = q["feature_set_sweep"](spark, str(tmp_path)).collect()
    assert len(sweep) == 6 and all(tuple(r)[1:] == (None, None, None) for r in sweep)
    tuned = q["tune_all_feature_sets"](spark, str(tmp_path)).collect()
    assert [r.C for r in tuned] == M.SVM_C * 6 and all(math.isnan(r.valid_acc) for r in tuned) and sum(r.best for r in tuned) == 6
    assert q["fit_selected"](spark, str(tmp_path)).collect() == []


def test_ranges_and_fits_of_no_rows(spark):
    none = spark.createDataFrame([], "features array<double>, label double")
    some = spark.createDataFrame([([1.0, 2.0], 1.0)], none.schema)
    assert G.ranges(none, F.col("features")) == ([], [])
    rows = M.tune_svm_sets(none, some, [("a", (0, 1))], (1.0, 2.0))
    assert [r[2] for r in rows] == [0.0, 0.0]  # coefficients of zero predict class 0
    assert all(math.isnan(r[2]) for r in M.tune_svm_sets(some, none, [("a", (0, 1))], (1.0, 2.0)))
    assert M.fit_logistic(none, some) == (None, None, None)
