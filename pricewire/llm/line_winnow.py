"""Line dedup by winnowing over line hashes.

A document is the sequence of hashes of its lines with a word (trimmed of ASCII white space).  Each window of ``window``
lines selects the position of its smallest hash (the rightmost of equals) as a fingerprint, so two documents that
share ``window`` lines in a row are sure to share one.  Fingerprints that occur once in the corpus are dropped; the positions
left are joined on the content of the windows that selected them, and each is matched to the
first such place (by doc_id, the text's key, then position).  A match extends both ways over the windows next to it that match too;
the runs of lines so covered repeat an earlier run of at least ``window`` lines and are deleted, the first occurrence
stays.  Blank lines are neither compared nor deleted.

Shorter runs count too: each run of fewer than ``window`` lines that holds at least ``min_words`` words, and the whole of each
document of fewer than ``window`` lines, are windows like the others, with fingerprints of their own (``min_words=None``: only
windows of ``window`` lines count).

Defined cases: null text is null and has no lines; a null doc_id comes before all others; different texts with one
doc_id (or none) are places of their own, in the order of the texts' keys; rows equal in doc_id and text are copies of one place
and delete nothing from each other, while repeats inside one document count; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import stored, text_key

WINDOW = 3
MIN_WORDS = 20
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
SPACES = r"[\x20\x09-\x0D]+"


def _line_hashes(lines: Column, words: bool = False) -> Column:
    """array<struct<at, h>>: place and hash of the lines with a word; ``words`` adds their number of words, n."""
    made = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_replace(x, TRIM, "").alias("t")))
    return F.transform(F.filter(made, lambda x: x["t"] != ""),
                       lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["t"]).alias("h"),
                                          *[F.size(F.split(x["t"], SPACES)).alias("n")] * words))


def _window(i: Column, size: int) -> Column:
    part = F.slice("_h", i + 1, size)
    low = F.array_min(part)
    return F.struct(i.alias("start"), (i + size - F.array_position(F.reverse(part), low)).cast("int").alias("place"),
                    low.alias("h"), F.xxhash64(part).alias("c0"), F.xxhash64(F.lit(1), part).alias("c1"),
                    F.lit(size).alias("size"))


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tkey, lines) -> one row per window: doc_id, tkey, start, place (of its fingerprint), h, content."""
    d = docs.withColumn("_h", _line_hashes(F.col("lines"))).filter(F.size("_h") >= window)
    d = d.withColumn("_h", F.col("_h.h"))
    starts = F.sequence(F.lit(0), F.size("_h") - window)
    d = d.select("doc_id", "tkey", F.explode(F.transform(starts, lambda i: _window(i, window))).alias("w"))
    content = F.struct(F.hex("w.c0").alias("c0"), "w.c1").alias("content")
    return d.select("doc_id", "tkey", "w.start", "w.place", "w.h", content)


def wordy_windows(docs: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """As ``windows``, with the shorter runs of at least ``min_words`` words and whole shorter documents; and size."""
    d = docs.select("doc_id", "tkey", _line_hashes(F.col("lines"), words=True).alias("_l"))
    d = d.select("doc_id", "tkey", F.col("_l.h").alias("_h"), F.col("_l.n").alias("_n"))

    def of(size: int) -> Column:
        starts = F.when(F.size("_h") >= size, F.sequence(F.lit(0), F.size("_h") - size)).otherwise(F.array().cast("array<int>"))
        if size < window:
            words = lambda i: F.aggregate(F.slice("_n", i + 1, size), F.lit(0), lambda a, n: a + n)
            starts = F.filter(starts, lambda i: (F.size("_h") == size) | (words(i) >= min_words))
        return F.transform(starts, lambda i: _window(i, size))
    # An outer generator: with a plain one the optimiser copies the hashing into an inferred filter.
    d = d.select("doc_id", "tkey", F.explode_outer(F.concat(*map(of, range(1, window + 1)))).alias("w")).filter("w IS NOT NULL")
    return d.select("doc_id", "tkey", "w.start", "w.place", "w.h", F.struct("w.c0", "w.c1").alias("content"), "w.size")


def repeated_runs(docs: DataFrame, window: int = WINDOW, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(doc_id, tkey, lines) -> doc_id, tkey, runs: array<struct<first, last>> of places among lines with a word."""
    made = windows(docs, window).withColumn("size", F.lit(window)) if min_words is None else wordy_windows(docs, window, min_words)
    w = stored(made, "line-windows")
    prints = w.select("doc_id", "tkey", "place", "h").distinct()
    often = prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    seeds = w.join(often, "h", "left_semi")
    first = seeds.groupBy("content").agg(F.min(F.struct("doc_id", "tkey", "start")).alias("ref"), F.count(F.lit(1)).alias("n"))
    # A later place of the same document must not overlap the first one.
    match = seeds.join(first.filter("n > 1"), "content").filter(
        ~F.col("doc_id").eqNullSafe(F.col("ref.doc_id")) | (F.col("tkey") != F.col("ref.tkey")) | (F.col("start") >= F.col("ref.start") + F.col("size")))
    # Extension: matched windows that touch or overlap join into one run.
    by = Window.partitionBy("doc_id", "tkey").orderBy("start")
    m = match.groupBy("doc_id", "tkey", "start").agg((F.col("start") + F.max("size")).alias("end"))
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(past), F.lit(True)).cast("int"))
    m = m.withColumn("_run", F.sum("_new").over(by))
    runs = m.groupBy("doc_id", "tkey", "_run").agg(F.min("start").alias("first"),
                                                   (F.max("end") - 1).alias("last"))
    return runs.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                min_words: int | None = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_deleted, deleted_runs, text (without the deleted lines)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       text_key(text_col).alias("tkey"))
    lined = base.select("doc_id", "tkey", F.split("text", "\n").alias("lines"))
    runs = repeated_runs(lined, window, min_words)
    same = F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.tkey") == F.col("r.tkey"))
    d = base.alias("b").join(runs.alias("r"), same, "left").select("b.doc_id", "b.text", "r.runs")
    d = d.withColumn("_lines", F.split("text", "\n"))
    d = d.withColumn("_at", F.transform(_line_hashes(F.col("_lines")), lambda p: p["at"]))
    spans = F.transform("runs", lambda r: F.struct(F.get("_at", r["first"]).alias("s"), F.get("_at", r["last"]).alias("e")))
    d = d.withColumn("_spans", spans)
    kept = F.filter("_lines", lambda x, i: ~(F.exists("_spans", lambda r: i.between(r["s"], r["e"]))
                                             & (F.regexp_replace(x, TRIM, "") != "")))
    length = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return d.select("doc_id", F.greatest(F.size("_at"), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(length, F.lit(0)).cast("long").alias("n_deleted"),
                    F.when(F.col("runs").isNotNull(), F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"])))
                    .otherwise(F.array().cast("array<string>")).alias("deleted_runs"),
                    F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
