"""Readers for the reference's file formats.

Every reader is one ``spark.read`` over a path or glob with an explicit
schema, so a folder of many files is one distributed scan.  Where the
reference addresses rows by their line number, ``with_line_numbers`` gives
dense 0-based line numbers per file without a single-task window and without
Python: rows of one file block are contiguous in a scan partition, so a
line's number is the count of rows in the earlier blocks of its file plus its
offset inside its block (``monotonically_increasing_id`` minus the block's
first id).  The per-block table has one row per file block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewire.functions import prices as P
from pricewire.functions import text as X
from pricewire.functions.literals import literal_to_json

# ---------------------------------------------------------------------------
# Fixed values of the file formats.
SAMPLE_HISTORY = 20                       # changes / documents per labelled sample
LISTING_COLUMNS = ["symbol", "company_name", "val", "total", "year", "service", "category", "web"]
PRICE_COLUMNS = ["Date", "Open", "High", "Low", "Close"]
# ---------------------------------------------------------------------------


def with_line_numbers(df: DataFrame, out: str = "line_no", whole: bool = False, folder: bool = False) -> DataFrame:
    """Add the 0-based line number of each row within its file or, with ``whole``,
    within the whole input in the order of the file paths, where it is a unique id; with
    ``folder`` within its folder, in the order of the file names (``df`` must come straight
    from a file scan).  Also adds ``file_path``."""
    d = df.select("*", F.col("_metadata.file_path").alias("file_path"),
                  F.col("_metadata.file_block_start").alias("_blk"),
                  F.monotonically_increasing_id().alias("_mid"))
    blocks = d.groupBy("file_path", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    scope = [] if whole else [F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1) if folder else F.col("file_path")]
    before = Window.partitionBy(*scope).orderBy("file_path", "_blk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # one row per file block (data size / block size): small, but it grows with
    # the data, so the join strategy is left to the planner and AQE
    j = d.join(blocks.select("file_path", "_blk", "_off", "_first"), ["file_path", "_blk"])
    return j.withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_blk", "_mid", "_off", "_first")


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """Readers made inside list many folders in a few tasks a core; Spark's setting is a task for each, up to 10000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_name(c: Column | None = None) -> Column:
    """Name of the file; one that Spark wrote as a folder of part files, also as a partition folder ``column=name``,
    has the folder's name."""
    path = F.col("_metadata.file_path") if c is None else c
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:/part-[^/]*)?$", 1), r"^[^=]*=", "")


def company_from_file(name: Column, kind: str) -> Column:
    """S3: text before the first ``-json`` / ``-text``, after its last ``_``."""
    prefix = F.regexp_extract(name, rf"^(.*?)-{kind}", 1)
    return F.regexp_extract(prefix, r"([^_]*)$", 1)


def literal_docs(lines: DataFrame, value: str, fields: str) -> DataFrame:
    """Rows of ``(..., value)`` lines ``{'response': {'docs': [...]}}`` without ``value``, one per entry of the list: ``parsed`` and
    ``d`` (a struct of ``fields``); a line that is no such literal gives one row with ``parsed = false`` and a NULL ``d``."""
    json = F.concat(F.lit("["), literal_to_json(F.col(value)), F.lit("]"))
    read = lines.withColumn("_j", F.from_json(json, f"array<struct<response: struct<docs: array<struct<{fields}>>>>>",
                                              {"allowUnquotedControlChars": "true"}))
    docs = F.when(F.size("_j") == 1, F.get("_j", F.lit(0))["response"]["docs"])
    keep = [c for c in lines.columns if c != value]
    return read.select(*keep, docs.isNotNull().alias("parsed"), F.explode(F.coalesce(docs, F.array(F.lit(None)))).alias("d"))


def src_article_meta(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S3: crawl metadata lines ``{'response': {'docs': [...]}}`` (Python literals) from files whose name contains ``json``.
    Returns ``(company, _id, pub_date, day, file_no, line_no, parsed)``.  A line with an empty list gives no row; every line
    that is no such literal gives one with ``parsed = false`` (a rejects output)."""
    raw = with_line_numbers(spark.read.text(path)).where(F.col("file_path").contains("json"))
    named = raw.select(company_from_file(file_name(F.col("file_path")), "json").alias("company"), F.col("file_path").alias("file_no"),
                       "line_no", "value")
    out = literal_docs(named, "value", "_id: string, pub_date: string")
    return out.select("company", F.col("d._id").alias("_id"), F.col("d.pub_date").alias("pub_date"),
                      X.pub_day_split(F.col("d.pub_date")).alias("day"), "file_no", "line_no", "parsed")


def src_article_text(spark: SparkSession, path: str) -> DataFrame:
    """S2 + S3: tab lines with exactly three fields -> ``(company, _id, text)``."""
    raw = spark.read.text(path).where(F.col("_metadata.file_path").contains("text"))
    parts = F.split(F.col("value"), "\t")
    return (raw.select(company_from_file(file_name(), "text").alias("company"), parts.alias("p"))
               .where(F.size("p") == 3)
               .select("company", F.col("p")[0].alias("_id"), F.col("p")[2].alias("text")))


def unrecognised_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: file names that are neither ``json`` nor ``text`` files (reported)."""
    names = spark.read.text(path).select(file_name().alias("name")).distinct()
    return names.where(~F.col("name").contains("json") & ~F.col("name").contains("text"))


def src_day_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Per-company TSV ``date \\t docs`` (company after the last ``-`` of the
    file name, ``.tsv`` removed); cleaned, tokenised, empty documents dropped."""
    schema = "date string, docs string"
    df = spark.read.csv(path, sep="\t", schema=schema)
    company = F.regexp_extract(F.regexp_replace(file_name(), r"\.tsv$", ""), r"([^-]*)$", 1)
    out = df.select(company.alias("company"), F.to_date("date").alias("date"), X.clean_text("docs").alias("clean"))
    return out.where(F.length("clean") > 0).withColumn("tokens", X.tokenize("clean"))


def src_collection(spark: SparkSession, path: str) -> DataFrame:
    """S5 + S9: ``company \\t date \\t tokens`` lines; the line number is the
    document index; empty documents dropped after numbering."""
    out = _collection_lines(spark, path)
    return out.where(F.length("text") > 0).withColumn("tokens", F.split("text", " "))


def _collection_lines(spark: SparkSession, path: str) -> DataFrame:
    df = with_line_numbers(spark.read.text(path), whole=True)
    p = F.split("value", "\t")
    return df.select(F.col("line_no").alias("doc_idx"), p[0].alias("company"),
                    X.pub_day(p[1]).alias("date"), F.coalesce(p[2], F.lit("")).alias("text"))


def src_prices(spark: SparkSession, path: str) -> DataFrame:
    """S6 + U1: one CSV per symbol (header), symbol = file name after the last
    ``_`` without ``.csv``; one directory scan for all symbols, in a few tasks a
    core (Spark's packing counts 4 MB for a file, which makes a task of 32)."""
    schema = T.StructType([T.StructField(c, T.StringType() if c == "Date" else T.DoubleType()) for c in PRICE_COLUMNS])
    with listed_by_cores(spark):  # the symbol comes from the name, so folders need not be read as partition values
        # the parser makes its buffer anew for each file; a longer line fills it more than once
        df = spark.read.option("inputBufferSize", 1 << 14).csv(path, header=True, schema=schema, recursiveFileLookup=True)
    sym = F.regexp_extract(file_name(), r"([^_]*)\.csv$", 1)
    return df.select(sym.alias("symbol"), F.to_date("Date").alias("date"),
                     P.nan_to_null("Open").alias("open"), P.nan_to_null("High").alias("high"),
                     P.nan_to_null("Low").alias("low"), P.nan_to_null("Close").alias("close")) \
        .coalesce(4 * spark.sparkContext.defaultParallelism)


def src_symbol_map(spark: SparkSession, path: str) -> DataFrame:
    """Two-column symbol -> company CSV, header skipped; a later duplicate wins."""
    df = spark.read.csv(path, header=True, schema="symbol string, company string")
    df = df.withColumn("_pos", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return df.groupBy("symbol").agg(F.max_by("company", "_pos").alias("company"))


def src_listing_map(spark: SparkSession, path: str) -> DataFrame:
    """8-column headerless listing; symbol and name (one trailing space stripped)."""
    schema = ", ".join(f"{c} string" for c in LISTING_COLUMNS)
    df = spark.read.csv(path, header=False, schema=schema)
    return df.select("symbol", F.regexp_replace("company_name", " $", "").alias("company"))


def src_corpus_coverage(spark: SparkSession, path: str) -> DataFrame:
    """S9 + A4: ``(company, date, doc_idx)`` with the corpus line number as index."""
    return _collection_lines(spark, path).select("company", "date", "doc_idx")  # every line, empty ones too


def _sample_schema(n: int = SAMPLE_HISTORY) -> T.StructType:
    fields = [T.StructField("company", T.StringType()), T.StructField("date", T.StringType()),
              T.StructField("doc_idx", T.LongType()), T.StructField("change", T.DoubleType())]
    fields += [T.StructField(f"change_{i}", T.DoubleType()) for i in range(1, n + 1)]
    fields += [T.StructField(f"prev_doc_{i}", T.LongType()) for i in range(1, n + 1)]
    fields += [T.StructField("label", T.IntegerType()), T.StructField("split", T.IntegerType())]
    return T.StructType(fields)


def src_labelled_samples(spark: SparkSession, path: str, n: int = SAMPLE_HISTORY) -> DataFrame:
    """The 46-column labelled sample; a row of another width fails the job
    (FAILFAST; no column pruning, so also when few columns are read); split must be 0 or 1.  ``nan`` values read as NaN and become NULL."""
    df = spark.read.option("columnPruning", False).csv(path, schema=_sample_schema(n), mode="FAILFAST", nanValue="nan")
    changes = F.array(P.nan_to_null("change"), *[P.nan_to_null(f"change_{i}") for i in range(1, n + 1)])
    split = F.when(F.col("split").isin(0, 1), F.col("split")).otherwise(
        F.raise_error(F.concat(F.lit("unknown split "), F.col("split").cast("string"))).cast("int"))
    return df.select("company", F.to_date("date").alias("date"), "doc_idx", P.nan_to_null("change").alias("change"),
                     changes.alias("changes"),
                     F.array(*[F.col(f"prev_doc_{i}") for i in range(1, n + 1)]).alias("prev_doc_idx"),
                     "label", split.alias("split"))


def src_topic_gamma(spark: SparkSession, root: str) -> DataFrame:
    """``root/<folder>/final.gamma`` (one row of gammas per document, line
    number = doc_idx) with ``alpha`` from ``final.other``; folders without
    ``final.other`` are skipped.  All folders in one table; ``k`` = vector length.
    Either file may be a folder of part files, in the order of their names."""
    g = with_line_numbers(spark.read.text(f"{root.rstrip('/')}/*/final.gamma"), folder=True)
    g = g.select(F.regexp_extract("file_path", r"([^/]*)/final\.gamma(?:/part-[^/]*)?$", 1).alias("folder"),
                 F.col("line_no").alias("doc_idx"),
                 F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != ""),
                             lambda t: t.cast("double")).alias("gamma"))
    other = spark.read.text(f"{root.rstrip('/')}/*/final.other")
    alpha = (other.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)/final\.other(?:/part-[^/]*)?$", 1).alias("folder"),
                          F.regexp_extract("value", r"alpha\s+(\S+)", 1).alias("a"))
                  .where(F.col("a") != "").groupBy("folder").agg(F.first(F.col("a").cast("double")).alias("alpha")))
    return g.join(F.broadcast(alpha), "folder", "inner").select(
        F.size("gamma").alias("k"), "folder", "doc_idx", "alpha", "gamma")


def src_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``label i:v ...`` with the 0-based line index: ``(row_idx, label, features map)``."""
    df = with_line_numbers(spark.read.text(path), whole=True)
    toks = F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "")
    pairs = F.transform(F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda p: F.struct(
        F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    return df.select(F.col("line_no").alias("row_idx"), toks[0].cast("double").alias("label"),
                     F.map_from_entries(pairs).alias("features"))


def src_price_samples(spark: SparkSession, path: str, n: int = SAMPLE_HISTORY) -> DataFrame:
    """26-column price samples; opens = columns -22..-3 (``nan`` -> 0),
    target = column 3, label = -2, split = -1; splits other than 0/1 dropped."""
    fields = ["company string", "date string", "doc_idx long", "next_open double"]
    fields += [f"open_{i} double" for i in range(n)] + ["label int", "split int"]
    df = spark.read.csv(path, schema=", ".join(fields), nanValue="nan")
    opens = P.nan_to_zero(F.array(*[F.col(f"open_{i}") for i in range(n)]))
    return (df.where(F.col("split").isin(0, 1))
              .select("company", F.to_date("date").alias("date"), "doc_idx", "next_open", opens.alias("opens"),
                      "label", "split"))


def src_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_idx, sentiment[3])`` from column 2 and the last three columns;
    a later line of the same document wins."""
    df = with_line_numbers(spark.read.text(path))
    p = F.split("value", ",")
    last3 = F.slice(p, -3, 3)
    d = df.select(p[2].cast("long").alias("doc_idx"), F.struct("file_path", "line_no").alias("_pos"),
                  F.transform(last3, lambda x: x.cast("double")).alias("sentiment"))
    return d.groupBy("doc_idx").agg(F.max_by("sentiment", "_pos").alias("sentiment"))


def src_label_prediction_pairs(spark: SparkSession, labels_path: str, predictions_path: str,
                               run_id: str) -> DataFrame:
    """S15 + J9: true label (first token of a LIBSVM line) and prediction (one int
    per line) paired by line number."""
    lab = with_line_numbers(spark.read.text(labels_path), whole=True).select(
        "line_no", F.split(F.trim("value"), r"\s+")[0].cast("double").cast("int").alias("label"))
    pred = with_line_numbers(spark.read.text(predictions_path), whole=True).select(
        "line_no", F.trim("value").cast("double").cast("int").alias("prediction"))
    return lab.join(pred, "line_no").select(F.lit(run_id).alias("run_id"), F.col("line_no").alias("row_idx"),
                                            "label", "prediction")


def parse_run_log(lines: DataFrame) -> DataFrame:
    """``k``, ``alpha``, ``L`` and test accuracy of result-log lines
    (numbers are read to their end)."""
    v = F.col("value")

    def num(pattern: str, kind: str) -> Column:
        s = F.regexp_extract(v, pattern, 1)
        return F.when(s != "", s.try_cast(kind))

    return lines.select("*", num(r"k=([0-9]+)", "int").alias("k"), num(r"alpha=([0-9]+\.?[0-9]*)", "double").alias("alpha"),
                        num(r"L=([0-9]+)", "int").alias("L"), num(r"test: (.*)$", "double").alias("test_acc"),
                        num(r"train: *([0-9.eE+-]+)", "double").alias("train_acc"),
                        num(r"t=([0-9]+)", "int").alias("t"))


def src_run_log(spark: SparkSession, path: str) -> DataFrame:
    """A result log as ``(line_no, value, k, alpha, L, test_acc, train_acc, t)``."""
    return parse_run_log(with_line_numbers(spark.read.text(path)).drop("file_path"))


def src_label_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<name>: [a, b, ...]`` -> ``(pos, true, time_series, topic, ngram)``."""
    df = spark.read.text(path)
    name = F.regexp_extract("value", r"^([a-z\- ]+):", 1)
    arr = F.from_json(F.regexp_extract("value", r"(\[.*\])", 1), "array<int>")
    long = df.select(name.alias("name"), F.posexplode(arr).alias("pos", "v"))
    return (long.groupBy("pos").pivot("name", ["true labels", "time-series", "topic-model", "ngram-model"])
                .agg(F.first("v"))
                .withColumnRenamed("true labels", "true").withColumnRenamed("time-series", "time_series")
                .withColumnRenamed("topic-model", "topic").withColumnRenamed("ngram-model", "ngram"))


def src_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset (Parquet, partitioned by ``split``)."""
    return spark.read.parquet(path)


def src_term_scores(spark: SparkSession, path: str) -> DataFrame:
    """S19 input: ``term,score`` CSV."""
    return spark.read.csv(path, schema="term string, score double")


def src_split_column(spark: SparkSession, path: str, column: int = 6) -> DataFrame:
    """``(row_idx, split)`` from column ``column`` of a split file, by line."""
    df = with_line_numbers(spark.read.text(path), whole=True)
    return df.select(F.col("line_no").alias("row_idx"), F.split("value", ",")[column].cast("int").alias("split"))


def src_labelled_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, company, doc_idx, label)`` of each labelled row, file order kept."""
    df = with_line_numbers(spark.read.text(path), whole=True)
    p = F.split("value", ",")
    return df.select(F.col("line_no").alias("pos"), p[0].alias("company"), p[2].cast("long").alias("doc_idx"),
                     F.element_at(p, -1).cast("double").alias("label"))
