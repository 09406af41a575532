"""Token counts by separator scan of flat token files.

A flat file is nothing but little-endian token ids, each document ended by an end-of-document id, without index or
header.  ``scan`` cuts every file into blocks, finds the separators of a block with one vectorised
comparison, and stitches documents that cross blocks by a prefix scan over the block table (separators before the
block, place of the last one), one short row per block.

``write_flat`` makes such files from texts with Spark's text writer: a row's bytes are its ids and the line separator is
the end-of-document id, so files commit like any other Spark output.  The same tasks write the doc_ids, in the same order, to
flat files of 8-byte records beside them.

Defined cases: null text is a document of 0 tokens; tokens after a file's last separator are a document with
``ended`` false; empty files give no rows; repeated rows are documents of their own; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewire.llm.common import shared_path

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20
FILE_ROWS = 50_000
NULL_ID = -(1 << 63)  # how a null doc_id is stored in a flat id file


@lru_cache(maxsize=2)
def _encoder(vocab: str):
    import tiktoken
    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(vocab: str):
    """Arrow UDF: the text's ids as little-endian 16-bit numbers, without separator."""
    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(vocab)
        for batch in texts:
            yield pd.Series([np.array(enc.encode_ordinary(x or ""), "<u2").tobytes() for x in batch], dtype=object)
    return encode


def write_flat(docs: DataFrame, path: str, vocab: str = VOCAB, end: int = END_OF_DOCUMENT, id_col: str = "doc_id",
               text_col: str = "text", file_rows: int = FILE_ROWS) -> None:
    """Flat files below ``path``: kind=tokens (ids and separators), kind=doc_ids (8-byte doc_id, then two bytes)."""
    sep = int(end).to_bytes(2, "little").decode("latin-1")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    rows = docs.select(ident.alias("id"), token_bytes(vocab)(F.col(text_col).cast("string")).alias("ids"))
    kinds = F.array(F.struct(F.lit("doc_ids").alias("kind"), F.reverse(F.unhex(F.lpad(F.hex("id"), 16, "0"))).alias("value")),
                    F.struct(F.lit("tokens").alias("kind"), F.col("ids").alias("value")))
    out = rows.select("id", "ids", F.explode(kinds).alias("k")).select("id", "ids", "k.kind", "k.value")
    # Both kinds in the same local order, so the n-th document of a task's token file is the n-th of its id file.
    out = out.sortWithinPartitions("kind", "id", "ids").select("kind", F.col("value").cast("string").alias("value"))
    (out.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", sep)
     .option("compression", "none").option("maxRecordsPerFile", file_rows).text(path))


def _flat_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content): the whole name, which is equal below kind=tokens and kind=doc_ids; any part of it may repeat."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def blocks(files: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files(file, content) -> (file, block, first, n, ends): where each block starts, its tokens, its separators."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                ids = np.frombuffer(content, f"<u{width}", count=len(content) // width)
                for b, at in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[at:at + block_tokens]
                    yield pd.DataFrame({"file": [name], "block": [b], "first": [at], "n": [len(part)],
                                        "ends": [np.flatnonzero(part == end) + at]})
    return files.mapInPandas(find, "file string, block long, first long, n long, ends array<long>")


def stitch(found: DataFrame) -> DataFrame:
    """Block table -> (file, doc_no, start, n_tokens, ended): a prefix scan carries counts and open documents over blocks."""
    past = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    d = (found.withColumn("before", F.coalesce(F.sum(F.size("ends")).over(past), F.lit(0)))
         .withColumn("open", F.coalesce(F.max(F.array_max("ends")).over(past) + 1, F.lit(0)))
         .withColumn("length", F.max(F.col("first") + F.col("n")).over(whole))
         .withColumn("last", F.max("block").over(whole)))
    starts = F.concat(F.array("open"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    closed = F.when(F.size("ends") > 0, F.arrays_zip(starts.alias("s"), F.col("ends").alias("e")))
    tail_from = F.coalesce(F.array_max("ends") + 1, F.col("open"))
    tail = F.when((F.col("block") == F.col("last")) & (tail_from < F.col("length")),
                  F.array(F.struct(tail_from.alias("s"), F.col("length").alias("e"))))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    every = F.concat(F.coalesce(closed, none), F.coalesce(tail, none))
    d = d.select("file", "before", F.posexplode(every).alias("i", "x"), F.size("ends").alias("m"))
    return d.select("file", (F.col("before") + F.col("i")).alias("doc_no"), F.col("x.s").alias("start"),
                    (F.col("x.e") - F.col("x.s")).alias("n_tokens"), (F.col("i") < F.col("m")).alias("ended"))


def scan(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, width: int = 2,
         block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of all flat token files below ``path``."""
    return stitch(blocks(_flat_files(spark, path), end, width, block_tokens))


def flat_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(file, doc_no, doc_id) from the flat id files: fixed records of 8 bytes and a separator."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                got = np.frombuffer(content, np.dtype([("id", "<i8"), ("sep", f"V{width}")]))["id"]
                yield pd.DataFrame({"file": name, "doc_no": np.arange(len(got)), "doc_id": got})
    ids = _flat_files(spark, path).mapInPandas(read, "file string, doc_no long, doc_id long")
    return ids.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def document_token_counts(docs: DataFrame, vocab: str = VOCAB, end: int = END_OF_DOCUMENT, id_col: str = "doc_id",
                          text_col: str = "text", block_tokens: int = BLOCK_TOKENS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write ``docs`` as flat files in the shared folder, scan them: doc_id, n_tokens, ended."""
    spark = docs.sparkSession
    path = shared_path(spark, "flat-tokens")
    write_flat(docs, path, vocab, end, id_col, text_col, file_rows)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_tokens long, ended boolean")
    counts = scan(spark, f"{path}/kind=tokens", end, block_tokens=block_tokens)
    return (counts.join(flat_ids(spark, f"{path}/kind=doc_ids"), ["file", "doc_no"])
            .select("doc_id", "n_tokens", "ended"))
