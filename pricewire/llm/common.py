"""Helpers shared by the corpus operators: words, row identity, shared-folder tables, checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewire.session import cut_lineage, ensure_checkpoint_dir

# A word: a run of characters other than space and \t \n \v \f \r (bytes.split() in Python tasks).
WORD = r"[^\x20\x09-\x0D]+"
# Rows up to which a table of fixed-width keys is broadcast, after counting it; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
RANK_CELL_BITS = 14


def text_of(text_col: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def n_words(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def packed_row(docs: DataFrame, *more: Column) -> DataFrame:
    """(_row: all columns of ``docs``, more...): no column of the documents can clash with one that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def text_key(text_col: str) -> Column:
    """64-bit key of a text; with the id it identifies a row up to exact repeats."""
    return F.xxhash64(text_of(text_col), F.col(text_col).isNull())


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    return cut_lineage(df)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again: like ``saved``, but columns that repeat take little room."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a saved table of a few fixed-width columns if a count shows at most ``rows`` rows;
    otherwise leave the shuffled join (which AQE may split when skewed)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def global_rank(df: DataFrame, hash_col: str, order: list[str], out: str = "row_no",
                within: str | None = None) -> DataFrame:
    """Exact 0-based position in the order (top bits of ``hash_col``, ``order``), over all rows or per
    non-null ``within`` value, without a window over a whole group.

    Rows are ranked inside cells of 1/2**14 of the hash space; a table of cell counts (2**14 rows per
    group at most) gives the offsets by a running sum.  Rows equal in ``order`` are interchangeable.
    """
    part = [within] if within else []
    d = df.withColumn("_cell", F.shiftrightunsigned(F.col(hash_col), 64 - RANK_CELL_BITS))
    before = Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.groupBy(*part, "_cell").agg(F.count(F.lit(1)).alias("_n"))
               .select(*part, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    rank = F.row_number().over(Window.partitionBy(*part, "_cell").orderBy(*[F.col(c) for c in order]))
    return (d.withColumn("_rn", rank).join(offsets, [*part, "_cell"])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_cell", "_rn", "_off"))
