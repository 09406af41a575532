"""Splits and sampling (D1-D10, W9, U2) with repeatable md5 order.

The reference draws with unseeded ``random``/``numpy``; here every random
choice is an exact rank by ``md5('<id>:<seed>')`` (``common.hash_rank``), so a
run repeats and DuckDB can check it.  Oversampling with replacement does not
loop: the ``i``-th extra draw of a class takes the minority row whose rank is
``hash(i) mod n``.  The draw numbers themselves come from the rows of the
larger class (its rows ranked past the minority size, one per missing row), so
the whole thing is one plan with no driver round trip and no cross join; the
only joins are on (label, rank), which is unique on the minority side, so a
hot class spreads evenly.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewire.operators.common import hash_rank, hash_to_long, ntile_from_rank, random_key, seed_text
from pricewire.session import cut_lineage

SPLIT_TRAIN, SPLIT_TEST, SPLIT_VALID = 0, 1, 2


def _keyed(df: DataFrame, id_col: str, seed) -> DataFrame:
    return df.withColumn("_key", random_key(id_col, seed))


def split_by_date(df: DataFrame, split_date: str, perc_val: float = 0.15, seed=7,
                  id_col: str = "row_idx", date_col: str = "date") -> DataFrame:
    """``split`` 0 (date <= split_date), 1 (after); then ``int(n_train * perc_val)``
    train rows (smallest md5 keys) become 2 (validation is taken from train)."""
    is_train = F.col(date_col) <= F.lit(split_date).cast("date")
    d = _keyed(df, id_col, seed).withColumn("_train", is_train)
    r = hash_rank(d, "_key", partition_by=["_train"], out="_r", with_group_size="_n", tie=[id_col])
    n_val = F.floor(F.col("_n") * F.lit(float(perc_val)))
    split = (F.when(~F.col("_train"), F.lit(SPLIT_TEST))
              .when(F.col("_r") < n_val, F.lit(SPLIT_VALID))
              .otherwise(F.lit(SPLIT_TRAIN)))
    return r.withColumn("split", split).drop("_key", "_train", "_r", "_n")


def valid_portion(df: DataFrame, portion: float = 0.15, seed=7, id_col: str = "row_idx") -> DataFrame:
    """``rint(n * (1 - portion))`` rows stay train (0), the rest become valid (2)."""
    d = _keyed(df, id_col, seed)
    r = hash_rank(d, "_key", out="_r", with_group_size="_n", tie=[id_col])
    keep = F.bround(F.col("_n") * F.lit(1.0 - float(portion)), 0)
    return (r.withColumn("split", F.when(F.col("_r") < keep, F.lit(SPLIT_TRAIN)).otherwise(F.lit(SPLIT_VALID)))
             .drop("_key", "_r", "_n"))


def _class_sizes(df: DataFrame, label_col: str, part: Sequence[str]) -> DataFrame:
    """Per (part, label): n and the size of the largest class of the part
    (a table with one row per class, joined back by broadcast)."""
    c = df.groupBy(*part, label_col).agg(F.count(F.lit(1)).alias("_n"))
    return c.withColumn("_nmax", F.max("_n").over(Window.partitionBy(*part)))


def oversample(df: DataFrame, label_col: str = "label", seed=7, id_col: str = "row_idx",
               classes: Sequence[int] | None = None, target_class: int | None = None,
               partition_by: Sequence[str] = ()) -> DataFrame:
    """Raise classes to a target size by drawing rows with replacement.

    * ``target_class=None``: every class is raised to the largest class (D2).
    * ``target_class=c``: the classes in ``classes`` are raised to the size of
      class ``c``; larger ones are left alone (D7).

    Output: the input rows with ``draw = -1`` plus the drawn copies with
    ``draw = 0, 1, ...`` per class.  A class that needs draws but is empty
    fails the job (as the reference does).  The class-size table has one row
    per (partition, class) and is broadcast.
    """
    part = list(partition_by) or ["_p"]
    base = df if partition_by else df.withColumn("_p", F.lit(0))
    ranked = hash_rank(_keyed(base, id_col, seed), "_key", partition_by=[*part, label_col], out="_r",
                       tie=[id_col]).drop("_key")
    sizes = _class_sizes(base, label_col, part)
    # target size and source class per partition, by windows over the small
    # class table (no join: the partition key may be a constant)
    wp = Window.partitionBy(*part)
    if target_class is None:
        src = F.min(F.when(F.col("_n") == F.col("_nmax"), F.col(label_col))).over(wp)
        tgt = F.col("_nmax")
    else:
        # taken from the data (not a literal) so the draw join keeps an equi-key
        src = F.max(F.when(F.col(label_col) == F.lit(target_class), F.col(label_col))).over(wp)
        tgt = F.max(F.when(F.col(label_col) == F.lit(target_class), F.col("_n"))).over(wp)
    need = sizes.select(*part, src.alias("_src"), F.col(label_col).alias("_cls"), F.col("_n").alias("_ncls"),
                        (tgt - F.col("_n")).alias("_deficit"))
    if classes is not None:
        need = need.where(F.col("_cls").isin(list(classes)))
    need = F.broadcast(need.where(F.col("_deficit") > 0))
    # draw numbers: rows of the source class ranked past the class size, one per missing row
    src = ranked.select(*part, F.col(label_col).alias("_src"), "_r")
    draws = src.join(need, [*part, "_src"], "inner")
    draws = draws.where((F.col("_r") >= F.col("_ncls")) & (F.col("_r") < F.col("_ncls") + F.col("_deficit")))
    draws = draws.select(*part, "_cls", "_ncls", (F.col("_r") - F.col("_ncls")).alias("draw"))
    pick_key = F.md5(F.concat(F.col("draw").cast("string"), F.lit(f":{seed}:"), F.col("_cls").cast("string")))
    empty = F.raise_error(F.lit("cannot oversample an empty class"))
    draws = draws.withColumn("_pick", F.when(F.col("_ncls") > 0, hash_to_long(pick_key) % F.col("_ncls"))
                             .otherwise(empty.cast("long")))
    picked = (draws.join(ranked.withColumnRenamed(label_col, "_cls").withColumnRenamed("_r", "_pick"),
                         [*part, "_cls", "_pick"], "inner")
                   .withColumnRenamed("_cls", label_col))
    originals = df.withColumn("draw", F.lit(-1).cast("long"))
    return originals.unionByName(picked.select(*originals.columns))


def balance_binary(df: DataFrame, label_col: str = "label", seed=7, id_col: str = "row_idx",
                   partition_by: Sequence[str] = ()) -> DataFrame:
    """Oversample the smaller of two classes to the size of the larger."""
    return oversample(df, label_col, seed, id_col, partition_by=partition_by)


def oversample_three_class(df: DataFrame, label_col: str = "label", seed=7, id_col: str = "row_idx",
                           partition_by: Sequence[str] = ()) -> DataFrame:
    """Classes +1 and -1 raised to at least the size of class 0."""
    return oversample(df, label_col, seed, id_col, classes=[1, -1], target_class=0, partition_by=partition_by)


def sample_balanced(df: DataFrame, label_col: str = "label", seed=7, id_col: str = "row_idx",
                    sample: bool = True, partition_by: Sequence[str] = ()) -> DataFrame:
    """D3: all positives plus as many negatives drawn with replacement, in each part of ``partition_by``.

    Labels other than 0/1 fail the job.  ``sample=False`` returns both classes
    unsampled (``draw = -1``).  ``seed`` may be a column, one value per part.
    """
    part = list(partition_by)
    checked = df.withColumn(label_col, F.when(F.col(label_col).isin(0, 1), F.col(label_col))
                            .otherwise(F.raise_error(F.lit("label must be 0 or 1")).cast(df.schema[label_col].dataType)))
    if not sample:
        return checked.withColumn("draw", F.lit(-1).cast("long"))
    pos = checked.where(F.col(label_col) == 1)
    neg = _keyed(checked.where(F.col(label_col) == 0), id_col, seed)
    negr = hash_rank(neg, "_key", partition_by=part, out="_pick", tie=[id_col]).drop("_key")
    # negatives' count on every row: a window over the two-row class table of a part,
    # joined back on the label (an equi-join, never a cartesian product)
    cls = checked.groupBy(*part, label_col).agg(F.count(F.lit(1)).alias("_nc"))
    cls = cls.select(*part, label_col, F.coalesce(F.sum(F.when(F.col(label_col) == 0, F.col("_nc"))).over(Window.partitionBy(*part)),
                                                  F.lit(0)).alias("_nneg"))
    posr = hash_rank(_keyed(pos, id_col, seed).withColumn("_seed", seed_text(seed)), "_key", partition_by=part, out="draw", tie=[id_col])
    key = F.md5(F.concat(F.col("draw").cast("string"), F.lit(":"), F.col("_seed"), F.lit(":neg")))
    draws = posr.select(*part, label_col, "draw", "_seed").join(F.broadcast(cls), [*part, label_col]).withColumn(
        "_pick", F.when(F.col("_nneg") > 0, hash_to_long(key) % F.col("_nneg"))
                  .otherwise(F.raise_error(F.lit("no negatives to sample")).cast("long")))
    picked = draws.select(*part, "draw", "_pick").join(negr, [*part, "_pick"], "inner").drop("_pick")
    out = pos.withColumn("draw", F.lit(-1).cast("long"))
    return out.unionByName(picked.select(*out.columns))


def kfold_stratified(df: DataFrame, k: int, label_col: str = "label", seed=7, id_col: str = "row_idx",
                     key_col: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """``fold`` 1..k per class (``ntile`` over md5 order, sizes differ by <= 1), in each part of ``partition_by``."""
    d = df.withColumn("_key", F.col(key_col) if key_col else random_key(id_col, seed))
    r = hash_rank(d, "_key", partition_by=[*partition_by, label_col], out="_r", with_group_size="_n",
                  tie=[id_col] if key_col is None else [id_col, "draw"])
    return r.withColumn("fold", ntile_from_rank("_r", "_n", k)).drop("_key", "_r", "_n")


def kfold_pairs(folded: DataFrame, k: int) -> DataFrame:
    """D4 pairs: every row once per pair ``1..k``, as ``test`` in its own fold, else ``train``."""
    pair = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pair")
    out = folded.select("*", pair)
    return out.withColumn("role", F.when(F.col("fold") == F.col("pair"), F.lit("test")).otherwise(F.lit("train")))


def holdout_last_fold(df: DataFrame, label_col: str = "label", seed=7, id_col: str = "row_idx",
                      k: int = 6) -> DataFrame:
    """The last of ``k`` folds of every class is the validation set (``valid`` flag)."""
    f = kfold_stratified(df, k, label_col, seed, id_col)
    return f.withColumn("valid", F.col("fold") == F.lit(k)).drop("fold")


def repeated_kfold(df: DataFrame, k: int, repeats: int, label_col: str = "label", seed=7,
                   id_col: str = "row_idx") -> DataFrame:
    """Hold out the last of 6 folds, then ``repeats`` times: balanced sampling
    of the rest and a stratified k-fold.  Output ``(repeat, ..., draw, fold)``."""
    # One plan for all repeats: the rows are stored once and repeated, and every rank is taken within its repeat.
    h = holdout_last_fold(df, label_col, seed, id_col)
    rest = cut_lineage(h.where(~F.col("valid")).drop("valid"))
    rest = rest.withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)]).cast("array<int>")))
    rep_seed = F.concat(F.lit(f"{seed}:"), F.col("repeat").cast("string"))
    s = sample_balanced(rest, label_col, rep_seed, id_col, partition_by=["repeat"])
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("draw").cast("string"), F.lit(":"), rep_seed))
    return kfold_stratified(s.withColumn("_fk", key), k, label_col, id_col=id_col, key_col="_fk", partition_by=["repeat"]).drop("_fk")


def shuffle_permutation(df: DataFrame, seed=7, id_col: str = "row_idx", split_col: str = "split") -> DataFrame:
    """``(split, row_idx, shuffled_idx)`` permutation per split, to be stored once."""
    d = _keyed(df.select(split_col, id_col), id_col, seed)
    return hash_rank(d, "_key", partition_by=[split_col], out="shuffled_idx", tie=[id_col]).drop("_key")


def replay_permutation(df: DataFrame, perm: DataFrame, id_col: str = "row_idx",
                       split_col: str = "split") -> DataFrame:
    """D9 replay: attach the stored permutation and order by it."""
    return df.join(perm, [split_col, id_col], "inner").orderBy(split_col, "shuffled_idx")


def apply_split(samples: DataFrame, split_table: DataFrame, id_col: str = "row_idx",
                oversampling: bool = False, label_col: str = "label", seed=7) -> DataFrame:
    """Route samples by a stored split id; unknown ids fail the job;
    optionally D7 within each split."""
    j = samples.join(split_table.select(id_col, "split"), id_col, "left")
    j = j.withColumn("split", F.coalesce(F.col("split"),
                                         F.raise_error(F.lit("no split for a sample")).cast("int")))
    if oversampling:
        return oversample_three_class(j, label_col, seed, id_col, partition_by=["split"])
    return j.withColumn("draw", F.lit(-1).cast("long"))


def union_splits(train: DataFrame, test: DataFrame, valid: DataFrame) -> DataFrame:
    """Stack the three sets with split ids 0 / 1 / 2."""
    return (train.withColumn("split", F.lit(SPLIT_TRAIN))
            .unionByName(test.withColumn("split", F.lit(SPLIT_TEST)))
            .unionByName(valid.withColumn("split", F.lit(SPLIT_VALID))))
