"""Writers for the reference's outputs.

Each writer takes a DataFrame and a destination folder and runs one
distributed write.  ``mode`` follows K10: ``"ignore"`` skips an existing
output (the reference's "skip if the file exists"), ``"overwrite"``
replaces it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewire.plans.base import flatten


def _mode(overwrite: bool) -> str:
    """Skip when the output exists unless ``overwrite``."""
    return "overwrite" if overwrite else "ignore"


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` is for plain file calls; None in a store that only Hadoop's file systems reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


NO_VALUE = "__HIVE_DEFAULT_PARTITION__"   # the partition folder of null and empty values, as Spark names it
ESCAPED = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\{[]^\x7f"]}


def sink_named_csv(rows: DataFrame, name: str, path: str) -> None:
    """A CSV with a header for each value of the column ``name``, in a new folder: ``name=<value>/part-...csv``.

    One task writes a value, so there is one file each.  Hadoop's local file system starts four processes for the permissions
    of every file it makes; where the folder is mounted, the tasks make the same files themselves."""
    spark = rows.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    top = _mounted(spark, path)
    rows = rows.withColumn(name, F.when(F.col(name) != "", F.col(name)))
    if top is None:  # the tasks move their own files to their places
        rows.repartition(tasks, name).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2") \
            .partitionBy(name).csv(path, header=True)
        return
    columns = [c for c in rows.columns if c != name]
    header = (",".join(columns) + "\n").encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = folder = out = None
        files = 0

        def close() -> None:
            if out:
                out.close()
                os.replace(out.name, f"{folder}/part-00000.csv")  # at once, and the same from another attempt of the task
        try:
            for batch in batches:
                values, lines = (batch.column(i).to_pylist() for i in range(2))
                cuts = [i for i in range(len(values)) if not i or values[i] != values[i - 1]]
                for lo, hi in zip(cuts, [*cuts[1:], len(values)], strict=True):
                    if out is None or values[lo] != value:
                        close()
                        value = values[lo]
                        folder = f"{top}/{name}={value if value == NO_VALUE else value.translate(ESCAPED)}"
                        os.makedirs(folder, exist_ok=True)
                        out = open(f"{folder}/.part-{uuid.uuid4().hex}", "wb")
                        out.write(header)
                        files += 1
                    out.write(("\n".join(lines[lo:hi]) + "\n").encode())
            close()
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})
    os.makedirs(top)
    lines = rows.select(F.coalesce(name, F.lit(NO_VALUE)).alias(name), F.to_csv(F.struct(*columns)).alias("line"))
    lines.repartition(tasks, name).sortWithinPartitions(name).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def sink_day_corpus(articles: DataFrame, path: str, overwrite: bool = False) -> None:
    """K1: the day corpus as ordered rows ``(date, ord, _id, text)`` per company folder."""
    articles.write.mode(_mode(overwrite)).partitionBy("company").parquet(path)


def sink_vocab(vocab: DataFrame, path: str, overwrite: bool = False) -> None:
    """K2: vocabulary ``(term, idx, freq)``."""
    vocab.select("term", "idx", "freq").write.mode(_mode(overwrite)).parquet(path)


def _in_order(rows: DataFrame) -> DataFrame:
    """Range-sorted by document id: in these formats the line's place, over all files by name, is the document.

    A range sort runs the work behind its rows twice (once for the bounds): callers store costly rows first."""
    return rows.orderBy("doc_idx" if "doc_idx" in rows.columns else "row_idx")


def sink_raw_corpus(raw: DataFrame, path: str, overwrite: bool = False) -> None:
    """K3: ``company \\t date \\t words`` lines, in document order."""
    _in_order(raw).select("company", F.col("date").cast("string"), "text").write.mode(_mode(overwrite)) \
        .csv(path, sep="\t", quote="", escape="", emptyValue="")


def sink_doc_term(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """K4: ``{n_unique} {idx:freq} ...`` lines, in document order."""
    _in_order(lines).select("line").write.mode(_mode(overwrite)).text(path)


def sink_stock_data(stock: DataFrame, path: str, overwrite: bool = False) -> None:
    """K5: the stock table as CSV with a header."""
    stock.write.mode(_mode(overwrite)).csv(path, header=True)


def sink_labelled_samples(samples: DataFrame, path: str, n: int = 20, overwrite: bool = False,
                          fmt: str = "csv") -> None:
    """K6: the labelled sample, flat (46 columns) for CSV or with arrays for Parquet."""
    out = samples.select("company", F.col("date").cast("string").alias("date"), "doc_idx", "change",
                         F.slice("changes", 2, n).alias("hist"), "prev_doc_idx", "label", "split")
    if fmt == "parquet":
        out.write.mode(_mode(overwrite)).parquet(path)
        return
    flat = flatten(flatten(out, "hist", n, "change_"), "prev_doc_idx", n, "prev_doc_")
    cols = ["company", "date", "doc_idx", "change", *[f"change_{i}" for i in range(1, n + 1)],
            *[f"prev_doc_{i}" for i in range(1, n + 1)], "label", "split"]
    flat.select(*cols).write.mode(_mode(overwrite)).csv(path, nullValue="nan")


def sink_libsvm(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """K7: LIBSVM text lines (``label i:v ...``, indices from 1); zero values kept, in row order."""
    _in_order(lines).select("line").write.mode(_mode(overwrite)).text(path)


def libsvm_line(label_col: str, features_col: str, digits: int = 6):
    """K7 line for an ``array<double>`` feature column."""
    fmt = f"%.{digits}f"
    pairs = F.transform(features_col, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string(fmt, v)))
    return F.concat(F.col(label_col).cast("string"), F.lit(" "), F.array_join(pairs, " ")).alias("line")


def sink_dataset(dataset: DataFrame, path: str, overwrite: bool = False) -> None:
    """K8: train / test / valid in one table partitioned by ``split``."""
    dataset.write.mode(_mode(overwrite)).partitionBy("split").parquet(path)


def sink_term_scores(scores: DataFrame, path: str, overwrite: bool = False) -> None:
    """K9: ``term,score`` sorted by score, then term, descending (one ordered output)."""
    scores.orderBy(F.col("score").desc(), F.col("term").desc()).select("term", "score") \
        .write.mode(_mode(overwrite)).csv(path)
