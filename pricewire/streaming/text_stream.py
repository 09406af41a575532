"""The stateless operators on Structured Streaming.

The reference has no streaming; its row-wise steps (cleaning, tokenising,
publication day, price labels of an already computed change) are plain
column expressions, so they run unchanged on a streaming DataFrame.  Window
functions over a price series (``lead``/``lag``) are batch-only and are not
offered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewire.functions import prices as P
from pricewire.functions import text as X

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def read_documents(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
                   max_files: int = 1) -> DataFrame:
    """A streaming source of document parquet files in ``folder`` (explicit schema)."""
    return (spark.readStream.schema(DOCUMENT_SCHEMA).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", file_glob).parquet(folder))


def clean_documents(stream: DataFrame) -> DataFrame:
    """T1 + T5 + P5 on a stream: ``(doc_idx, company, clean, tokens)``."""
    out = stream.select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("company"),
                        X.clean_text("text").alias("clean"))
    return out.where(F.length("clean") > 0).withColumn("tokens", X.tokenize("clean"))


def label_changes(stream: DataFrame, sig: float, insig: float, change_col: str = "change") -> DataFrame:
    """L4 / L5 / L6 / D14 labels of rows that already carry their change."""
    c = F.col(change_col)
    return stream.select("*", P.significant(c, sig).alias("sig"), P.insignificant(c, insig).alias("insig"),
                         P.direction_multiclass(c).alias("direction"))


def run_to_memory(stream: DataFrame, name: str, checkpoint: str):
    """Drive a stream to completion into an in-memory table (tests, notebooks)."""
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", checkpoint).start())
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)
