"""Properties of the scalable primitives on random inputs."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricewire.operators import common as C
from pricewire.operators import splits as SP


def test_exact_rank_equals_row_number_with_hot_group(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rng.randint(0, 20)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_idx long, grp string").withColumn("key", C.random_key("row_idx", 9))
    got = C.hash_rank(df, "key", partition_by=["grp"], out="r", tie=["row_idx"], with_group_size="n")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("grp").orderBy("key", "row_idx")) - 1)
    j = got.join(want, "row_idx")
    assert j.where(F.col("r") != F.col("w")).count() == 0
    sizes = {r["grp"]: r["n"] for r in got.select("grp", "n").distinct().collect()}
    assert sizes["hot"] == 1000


def test_ntile_matches_array_split(spark):
    cases = [(n, k) for n in range(1, 40) for k in range(1, 8)]
    rows = [(n, k, r) for n, k in cases for r in range(n)]
    df = spark.createDataFrame(rows, "n long, k int, r long")
    out = {}
    for k in range(1, 8):
        sub = df.where(F.col("k") == k).select("n", "r", C.ntile_from_rank("r", "n", k).alias("t")).collect()
        for row in sub:
            out[(row["n"], k, row["r"])] = row["t"]
    for n, k in cases:
        sizes = [len(p) for p in np.array_split(np.arange(n), k)]
        expect = [i + 1 for i, s in enumerate(sizes) for _ in range(s)]
        assert [out[(n, k, r)] for r in range(n)] == expect, (n, k)


def test_folds_disjoint_complete_and_balanced(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(301)], "row_idx long, label int")
    f = SP.kfold_stratified(df, 5, "label", seed=2)
    assert f.count() == 301 and f.select("row_idx").distinct().count() == 301
    per = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)


def test_oversampling_draws_only_minority_rows(spark):
    df = spark.createDataFrame([(i, 1 if i < 7 else (0 if i < 90 else -1)) for i in range(100)],
                               "row_idx long, label int")
    o = SP.oversample_three_class(df, "label", seed=4)
    counts = {r["label"]: r["count"] for r in o.groupBy("label").count().collect()}
    assert counts == {0: 83, 1: 83, -1: 83}
    drawn = o.where("draw >= 0")
    assert drawn.where("(label = 1 AND row_idx >= 7) OR (label = -1 AND row_idx < 90)").count() == 0


def test_rows_with_null_keys_keep_their_rank(spark):
    from pyspark.sql import functions as F

    from pricewire.operators.common import hash_rank, random_key
    rows = [(i, None if i % 10 == 0 else i % 3) for i in range(100)] + [(None, 1)] * 3
    df = spark.createDataFrame(rows, "id long, g int").withColumn("k", random_key("id", 5))
    got = hash_rank(df, "k", ["g"], with_group_size="n").collect()
    assert len(got) == len(rows)
    for g in (None, 0, 1, 2):
        ranks = sorted(r["rank"] for r in got if r.g == g)
        assert ranks == list(range(len(ranks))) and {r.n for r in got if r.g == g} == {len(ranks)}
    assert df.filter(F.col("k").isNull()).count() == 3


def test_line_ids_are_unique_over_files_and_long_lines_are_whole(spark, tmp_path):
    from pricewire.sources import files
    for name in ("a", "b"):
        (tmp_path / f"part-{name}.txt").write_text("1 1:2\n0 2:3\n1 3:4\n")
    (tmp_path / "part-c.txt").write_text("1 " + " ".join(f"{i}:1" for i in range(1, 1_000_006)) + "\n")
    got = files.src_libsvm(spark, str(tmp_path)).selectExpr("row_idx", "size(features) n").collect()
    assert sorted(r.row_idx for r in got) == list(range(7)) and max(r.n for r in got) == 1_000_005


def test_run_log_numbers_are_read_to_their_end(spark):
    from pricewire.sources.files import parse_run_log
    r = parse_run_log(spark.createDataFrame([("k=100, alpha=0.95, L=120",)], "value string")).first()
    assert (r.k, r.alpha, r.L) == (100, 0.95, 120)
