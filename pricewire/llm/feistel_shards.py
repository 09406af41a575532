"""Reproducible shuffle into shards by a Feistel permutation of global row numbers (DataFrame functions only).

Rows get exact row numbers 0..n-1 in the order of a hash of their content.  An alternating Feistel network on
pairs (left, right) in Z_a x Z_b, the smallest near-square grid with a*b >= n, permutes them; results outside
0..n-1 walk on along their cycle until they fall inside, so the map is a bijection on 0..n-1 for every n.  Position p goes
to shard p mod k, slot p div k: shard sizes differ by one row at most (law ``rows``) and slots have no gaps.
``position_of`` / ``row_at`` compute the place of a row number and the row number at a place without the data.

Defined cases: null text has size 1 and crc 0; null ids and repeated rows are rows like any other (exact repeats
are interchangeable); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.llm.common import global_rank, saved, text_of

ROUNDS = 8
SEED = 20240229


def grid(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _permuted(x: Column, n: int, seed: int, rounds: int, invert: bool) -> Column:
    """One pass of the network over ``x`` (below a*b): struct<x, inside>; the rounds fold over a sequence."""
    a, b = grid(n)

    def one(s: Column, j: Column) -> Column:
        left_round = j % 2 == 0
        k = F.xxhash64(F.when(left_round, s["r"]).otherwise(s["l"]), j, F.lit(seed))
        move = F.pmod(k, F.when(left_round, F.lit(a)).otherwise(F.lit(b)).cast("long"))
        step = -move if invert else move
        return F.struct(F.when(left_round, F.pmod(s["l"] + step, F.lit(a))).otherwise(s["l"]).cast("long").alias("l"),
                        F.when(left_round, s["r"]).otherwise(F.pmod(s["r"] + step, F.lit(b))).cast("long").alias("r"))
    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if invert else F.sequence(F.lit(0), F.lit(rounds - 1))
    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def joined(s: Column) -> Column:
        v = s["l"] * F.lit(b).cast("long") + s["r"]
        return F.struct(v.alias("x"), (v < n).alias("inside"))
    return F.aggregate(order, start, one, joined)


def extra_walks(spark: SparkSession, n: int, seed: int = SEED, rounds: int = ROUNDS, invert: bool = False) -> int:
    """Passes needed after the first one: the longest walk of the fewer than sqrt(n)+1 values outside 0..n-1."""
    a, b = grid(n)
    left, walks = spark.range(n, a * b).select(F.col("id").alias("x")), 0
    while n > 0 and not left.isEmpty():
        left = left.select(_permuted(F.col("x"), n, seed, rounds, invert).alias("s")).filter("not s.inside").select("s.x")
        walks += 1
    return walks


def walked(df: DataFrame, col: str, n: int, seed: int = SEED, rounds: int = ROUNDS, invert: bool = False) -> DataFrame:
    """The permutation of 0..n-1 with cycle walking, applied to ``col`` in place."""
    walks = extra_walks(df.sparkSession, n, seed, rounds, invert)
    start = F.struct(F.col(col).cast("long").alias("x"), F.lit(False).alias("inside"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(walks)), start, lambda s, _: F.when(s["inside"], s).otherwise(
        _permuted(s["x"], n, seed, rounds, invert)), lambda s: s["x"])
    return df.withColumn(col, out)


def position_of(df: DataFrame, row_col: str, n: int, n_shards: int, seed: int = SEED) -> DataFrame:
    """Adds shard and slot of each row number in ``row_col``."""
    d = walked(df.withColumn("_p", F.col(row_col)), "_p", n, seed)
    return (d.withColumn("shard", (F.col("_p") % n_shards).cast("int"))
            .withColumn("slot", F.expr(f"_p div {n_shards}L")).drop("_p"))


def row_at(df: DataFrame, n: int, n_shards: int, seed: int = SEED, out: str = "row_no") -> DataFrame:
    """Adds the row number at (shard, slot): the inverse of ``position_of``."""
    return walked(df.withColumn(out, F.col("slot") * n_shards + F.col("shard")), out, n, seed, invert=True)


def feistel_shards(docs: DataFrame, n_shards: int = 16, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under law ``rows``), row_no."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = saved(rows.withColumn("_h", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed))))
    n = rows.count()
    numbered = global_rank(rows, "_h", ["_h", "doc_id", "size", "text_crc32"])
    placed = position_of(numbered, "row_no", n, n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_no")
