"""Shared building blocks: checked broadcast, md5 ordering, exact ranks.

``hash_rank`` is the workhorse behind every "random" choice in the library
(splits, folds, oversampling, shuffles).  It gives the exact
``row_number() OVER (PARTITION BY g ORDER BY md5(id:seed)) - 1`` without a
single-task window: rows are bucketed by the first hex digits of their md5
key (uniform, so a group holding a third of all rows is still cut into
tens of thousands of even buckets), ranked inside each bucket, and shifted by the
running count of the earlier buckets, which comes from a small
``(group, bucket, n)`` table.  The big side is shuffled once, on
``(group, bucket)``, and that same partitioning serves the offset join.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows up to which a side is broadcast after an explicit count.
BROADCAST_MAX_ROWS = 2_000_000
# Hex digits of the md5 key used as rank bucket: 16**4 = 65536 cells per group,
# so a group of 10^11 rows still ranks about 1.5M rows per task, while the
# per-cell count table stays at most 65536 rows per group.
RANK_BUCKET_HEX = 4


def _cols(cols) -> list[Column]:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def checked_broadcast(df: DataFrame, bound: int | None = None,
                      max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is bounded by construction
    (``bound``: e.g. a vocabulary limited to n terms, a class table) and the
    bound is small.  Without a proven bound no hint is given: the planner's
    size estimate and AQE's runtime statistics decide (and fall back to a
    shuffled join for a big side).  No extra job is run to count rows."""
    if bound is not None and bound <= max_rows:
        return F.broadcast(df)
    return df


def random_key(id_col, seed) -> Column:
    """Deterministic pseudo-random sort key: ``md5('<id>:<seed>')``; the seed may be a column.

    DuckDB: ``md5(CAST(id AS VARCHAR) || ':' || '<seed>')``.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(":"), seed_text(seed)))


def seed_text(seed) -> Column:
    """A seed as text: a fixed one, or one per row."""
    return seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))


def hash_to_long(key: Column) -> Column:
    """First 15 hex digits of an md5 key as a non-negative bigint."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def exact_rank(df: DataFrame, order: Sequence[Column], buckets: Sequence[tuple[str, Column, bool]],
               partition_by: Sequence[str] = (), out: str = "rank",
               with_group_size: str | None = None) -> DataFrame:
    """Exact 0-based ``row_number() OVER (PARTITION BY p ORDER BY order) - 1``.

    ``buckets`` are ``(name, expr, ascending)`` coarsenings of a prefix of
    ``order`` (same direction), e.g. the first hex digits of an md5 key, or a
    frequency followed by the term's first letters.  Ranks are computed inside
    each (partition, bucket) cell and shifted by the running count of the
    earlier cells, taken from a small per-cell count table; no task ever
    holds a whole group.  ``order`` must be a total order for a stable result.
    """
    part, names = list(partition_by), [b[0] for b in buckets]
    # Join keys that are never NULL, so rows with a NULL group or bucket keep their rank; shared by the
    # windows, the counts and the join, which therefore need one shuffle of the rows.
    keys = [f"_key_{i}" for i in range(len(part) + len(names))]
    d = df.select("*", *[b[1].alias(b[0]) for b in buckets])
    for key, c in zip(keys, [*part, *names], strict=True):
        d = d.withColumn(key, F.coalesce(F.col(c).cast("string"), F.lit("\x00null")))
    groups = keys[:len(part)]
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cell_n"), *[F.first(n).alias(n) for n in names])
    cell_order = [F.col(n).asc() if asc else F.col(n).desc() for n, _, asc in buckets]
    before = Window.partitionBy(*groups).orderBy(*cell_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_cell_off", F.coalesce(F.sum("_cell_n").over(before), F.lit(0)))
    keep = [*keys, "_cell_off"]
    if with_group_size:
        offsets = offsets.withColumn(with_group_size, F.sum("_cell_n").over(Window.partitionBy(*groups)))
        keep.append(with_group_size)
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = d.withColumn("_cell_rn", F.row_number().over(within) - 1)
    joined = ranked.join(offsets.select(*keep), on=keys, how="inner")
    return (joined.withColumn(out, (F.col("_cell_off") + F.col("_cell_rn")).cast("long"))
                  .drop(*keys, *names, "_cell_off", "_cell_rn"))


def hash_rank(df: DataFrame, key: str, partition_by: Sequence[str] = (), out: str = "rank",
              tie: Sequence[str] = (), with_group_size: str | None = None,
              bucket_hex: int = RANK_BUCKET_HEX) -> DataFrame:
    """Exact 0-based rank by an md5 ``key`` (string) within ``partition_by``.

    The bucket is the key's first ``bucket_hex`` hex digits: uniform, so even a
    group holding a third of all rows spreads over 16**bucket_hex cells.
    """
    return exact_rank(df, [F.col(key), *_cols(tie)],
                      [("_rank_bucket", F.substring(F.col(key), 1, bucket_hex), True)],
                      partition_by=partition_by, out=out, with_group_size=with_group_size)


def ntile_from_rank(rank: Column | str, n: Column | str, k: int) -> Column:
    """``ntile(k)`` (1-based) from a 0-based rank and the group size.

    The first ``n % k`` tiles get one extra row, as SQL ``ntile`` and
    ``numpy.array_split`` do.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(n) if isinstance(n, str) else n
    q = F.floor(n / F.lit(k)).cast("long")
    rem = (n % F.lit(k)).cast("long")
    big = rem * (q + F.lit(1))
    return (F.when(r < big, F.floor(r / (q + F.lit(1))))
             .otherwise(rem + F.floor(F.try_divide(r - big, q)))
             .cast("int") + F.lit(1))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
