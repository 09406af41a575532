"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Pass 1 reads the texts and counts, map-side first, how many rows fall on each cell of a Bloom table (several
64-bit hashes per row, ``bits_per_row`` cells per row).  Cells hit twice become the set bits of a filter made of
4 KB bitmaps.  Pass 2 probes it: a text that occurs twice has all its cells set, so rows with a clear cell
are unique and pass straight through; only the rest shuffle, on the SHA-256 of the text, which decides
exactly.  The filter's size is fixed before it is built (``max_filter_bits`` at most, 128 MB), which bounds the
broadcast; a fuller filter only lets more rows shuffle.

Defined cases: null text counts as empty.  Of equal texts the largest doc_id stays, null ids are smaller than all
others; of rows repeated with that id exactly one stays.  Empty tables give empty results; extra columns are
kept by ``drop_copies`` and ignored by ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import saved, text_of

BITS_PER_ROW = 16
HASHES = 2
MAX_FILTER_BITS = 1 << 30
BITMAP_BITS = 32768  # what one native bitmap holds


def _cells(text: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(text, F.lit(j)), F.lit(bits)) for j in range(hashes)]


def filter_bits(n_rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_FILTER_BITS) -> int:
    bits = BITMAP_BITS
    while bits < min(n_rows * bits_per_row, max_bits):
        bits *= 2
    return bits


def repeat_filter(docs: DataFrame, text_col: str, bits: int, hashes: int = HASHES) -> DataFrame:
    """Pass 1: (bucket, bitmap) with a bit for each cell that two or more row hashes fall on."""
    cells = docs.select(F.explode(F.array(*_cells(text_of(text_col), bits, hashes))).alias("cell"))
    twice = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return (twice.select(F.expr(f"cell div {BITMAP_BITS}").alias("bucket"),
                         (F.col("cell") % BITMAP_BITS).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")))


def probe(docs: DataFrame, text_col: str, bits: int, bitmaps: DataFrame, hashes: int = HASHES,
          out: str = "_maybe") -> DataFrame:
    """Pass 2: ``out`` is true where every cell of the row's text is set; such rows may be repeated."""
    df, hit = docs, F.lit(True)
    for j, cell in enumerate(_cells(text_of(text_col), bits, hashes)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{j}"), F.col("bitmap").alias(f"_m{j}")))
        df = (df.withColumn(f"_c{j}", cell).withColumn(f"_b{j}", F.expr(f"_c{j} div {BITMAP_BITS}"))
              .join(side, f"_b{j}", "left"))
        byte = F.expr(f"cast(conv(hex(substring(_m{j}, cast((_c{j} % {BITMAP_BITS}) div 8 + 1 as int), 1)), 16, 10)"
                      " as int)")
        hit = hit & (F.coalesce(F.getbit(byte, (F.col(f"_c{j}") % 8).cast("int")), F.lit(0)) == 1)
    return df.withColumn(out, hit).select(*[F.col(f"`{c}`") for c in docs.columns], out)


def _filter(docs: DataFrame, text_col: str, bits_per_row: int, hashes: int, max_bits: int):
    bits = filter_bits(docs.count(), bits_per_row, max_bits)
    return bits, saved(repeat_filter(docs, text_col, bits, hashes))


def _resolve(rows: DataFrame, id_col: str, tie: Column) -> DataFrame:
    """Adds keep_id, group_size, kept to the possibly repeated rows, which carry ``text_sha256``."""
    groups = rows.groupBy("text_sha256").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    nth = F.row_number().over(Window.partitionBy("text_sha256", id_col).orderBy(tie))
    return (rows.withColumn("_nth", nth).join(groups, "text_sha256")
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).drop("_nth"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW,
                hashes: int = HASHES, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (see the module text)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bits, bitmaps = _filter(docs, "text", bits_per_row, hashes, max_filter_bits)
    rows = (probe(docs, "text", bits, bitmaps, hashes)
            .select("doc_id", F.sha2(text_of("text"), 256).alias("text_sha256"), "_maybe"))
    rows = saved(rows)
    unique = rows.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    rest = _resolve(rows.filter("_maybe").drop("_maybe"), "doc_id", F.lit(0))
    return unique.unionByName(rest.select(*unique.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW,
                hashes: int = HASHES, max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    bits, bitmaps = _filter(docs, text_col, bits_per_row, hashes, max_filter_bits)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("doc_id"))
    text = f"_row.`{text_col}`"
    rows = probe(packed, text, bits, bitmaps, hashes)
    maybe = rows.filter("_maybe").withColumn("text_sha256", F.sha2(text_of(text), 256))
    rest = _resolve(maybe, "doc_id", F.xxhash64("_row")).filter("kept")
    return rows.filter(~F.col("_maybe")).select("_row.*").unionByName(rest.select("_row.*"))
