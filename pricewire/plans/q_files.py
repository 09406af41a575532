"""Readers over folders of the reference's file formats.

Each query first writes the format from the given tables into a fresh folder below the shared checkpoint folder, then
runs the reader (and the operators behind it) over the whole folder.  A file that names its company, symbol or set is a
partition folder ``name=<file name>`` here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.operators import evaluate as E
from pricewire.operators import labels as L
from pricewire.operators import runlogs as RL
from pricewire.operators import text as TX
from pricewire.operators import topics as TP
from pricewire.plans import q_eval, q_splits, q_text
from pricewire.plans import sql as S_
from pricewire.plans.base import ORACLE, flatten, query, rounded
from pricewire.plans.q_io import _folder
from pricewire.session import cut_lineage
from pricewire.sources import files as S
from pricewire.sources import tables as T
from pricewire.sources import writers as K

FLAT = r"[\t\r\n]+"      # what a one-line format cannot hold becomes a space


def _named(rows, value, name, path: str) -> None:
    """Write lines ``value``, one folder per ``name``."""
    rows.select(value.alias("value"), name.alias("name")).write.partitionBy("name").text(path)


def _ordered(rows, value, order, path: str) -> None:
    """Write lines ``value`` by ``order``: a line's place over all files is its row's."""
    rows.orderBy(order).select(value.alias("value")).write.text(path)


@query("article_text_file", S_.with_(q_text._META_SQL) + f"""
SELECT company, _id, md5(regexp_replace(text, '{FLAT}', ' ', 'g')) AS text_md5 FROM txt WHERE text IS NOT NULL""")
def q_article_text_file(spark, sf_dir):
    """S2 + S3: article bodies as tab lines, one file set per company, read back with the company of the name."""
    path = _folder(spark, "texts")
    _named(T.article_text(spark, sf_dir), F.concat_ws("\t", "_id", "company", F.regexp_replace("text", FLAT, " ")),
           F.concat(F.lit("nyt_"), F.col("company"), F.lit("-text-1")), path)
    return S.src_article_text(spark, path).select("company", "_id", F.md5("text").alias("text_md5"))


@query("day_corpus_tsv", S_.with_(S_.COLLECTION.replace("         text\n", f"         regexp_replace(text, '{FLAT}', ' ', 'g') AS text\n"),
                                  S_.CLEAN_DOCS) + """
SELECT company, date, md5(clean) AS clean_md5, CAST(len(tokens) AS BIGINT) AS n_tokens FROM toks""")
def q_day_corpus_tsv(spark, sf_dir):
    """S4 + T1 + T5 + P5: per-company files of ``date, text`` lines read back, cleaned and cut into words."""
    path = _folder(spark, "daytsv")
    _named(T.collection(spark, sf_dir), F.concat_ws("\t", F.col("date").cast("string"), F.regexp_replace("text", FLAT, " ")),
           F.concat(F.lit("nyt-"), F.col("company"), F.lit(".tsv")), path)
    return S.src_day_corpus(spark, path).select("company", "date", F.md5("clean").alias("clean_md5"),
                                                F.size("tokens").cast("long").alias("n_tokens"))


def _raw_corpus(spark, sf_dir) -> str:
    """The raw corpus written; its rows are stored once, so the range sort of the writer does not filter the words twice."""
    path = _folder(spark, "rawcorpus")
    d = q_text.stored_corpus(spark, sf_dir)
    K.sink_raw_corpus(cut_lineage(TX.raw_corpus(d, q_text.vocab(spark, sf_dir, docs=d), bound=q_text.VOCAB_SIZE)), path)
    return path


@query("collection_file", f"""SELECT * FROM (
SELECT row_number() OVER (ORDER BY doc_idx) - 1 AS doc_idx, company, date, md5(text) AS text_md5, text <> '' AS kept
FROM ({ORACLE['raw_corpus']})) WHERE kept""")
def q_collection_file(spark, sf_dir):
    """K3 + S5: the raw corpus written in document order and read back; the line is the document, empty ones go."""
    c = S.src_collection(spark, _raw_corpus(spark, sf_dir))
    return c.select("doc_idx", "company", "date", F.md5("text").alias("text_md5"), F.lit(True).alias("kept"))


@query("corpus_coverage_file", f"""
SELECT row_number() OVER (ORDER BY doc_idx) - 1 AS doc_idx, company, date FROM ({ORACLE['raw_corpus']})""")
def q_corpus_coverage_file(spark, sf_dir):
    """K3 + S9: company, day and document number of every line of the raw corpus, empty ones too."""
    return S.src_corpus_coverage(spark, _raw_corpus(spark, sf_dir)).select("doc_idx", "company", "date")


@query("prices_file", S_.with_(S_.PRICES) + """
SELECT symbol, date, open, greatest(open, close) AS high, least(open, close) AS low, close FROM prices""")
def q_prices_file(spark, sf_dir):
    """S6 + U1: daily prices written as a CSV per symbol with a header, all read back in one scan."""
    path = _folder(spark, "prices")
    p = T.prices(spark, sf_dir)
    rows = p.select(F.concat(F.lit("stock_"), F.col("symbol"), F.lit(".csv")).alias("name"), F.col("date").cast("string").alias("Date"),
                    F.col("open").alias("Open"), F.greatest("open", "close").alias("High"), F.least("open", "close").alias("Low"),
                    F.col("close").alias("Close"))
    K.sink_named_csv(rows, "name", path)
    return rounded(S.src_prices(spark, path))


@query("listing_file", ORACLE["join_symbol_company"].split("SELECT symbol, company")[0] +
       "SELECT symbol, company FROM symbol_map")
def q_listing_file(spark, sf_dir):
    """The exchange listing (eight columns, a space after the name) written and read back."""
    path = _folder(spark, "listing")
    m = T.symbol_map(spark, sf_dir)
    m.select("symbol", F.concat("company", F.lit(" ")), *[F.lit("n/a").alias(f"c{i}") for i in range(6)]).write.csv(
        path, ignoreTrailingWhiteSpace=False)
    return S.src_listing_map(spark, path)


_GAMMAS = ", ".join(f"round(gamma[{i}], 6) AS g_{i}" for i in range(1, T.TOPIC_K + 1))


@query("topic_gamma_file", S_.with_(S_.TOPICS) + f"""
SELECT k, 'k{T.TOPIC_K}' AS folder, row_number() OVER (ORDER BY doc_idx) - 1 AS doc_idx, CAST({T.TOPIC_ALPHA} AS DOUBLE) AS alpha,
       {_GAMMAS} FROM topics""")
def q_topic_gamma_file(spark, sf_dir):
    """Topic-model output (gammas by document, alpha beside them) written and read back."""
    root = _folder(spark, "lda")
    g = T.topic_gamma(spark, sf_dir)
    _ordered(g, F.array_join(F.transform("gamma", lambda v: v.cast("string")), " "), "doc_idx", f"{root}/k{T.TOPIC_K}/final.gamma")
    g.select(F.concat(F.lit("alpha "), F.col("alpha").cast("string")).alias("value")).distinct().write.text(
        f"{root}/k{T.TOPIC_K}/final.other")
    return rounded(flatten(S.src_topic_gamma(spark, root), "gamma", T.TOPIC_K, "g_"))


@query("sentiment_file", S_.with_(S_.TOPICS, S_.LABELS3) + """
SELECT t.doc_idx, CAST(len(t.topic) + 3 AS INTEGER) AS n_features, CAST(l.quality AS DOUBLE) AS s1, CAST(l.toxic AS DOUBLE) AS s2,
       CAST(l.label3 AS DOUBLE) AS s3, round(t.topic[1], 6) AS first FROM topics_n t JOIN lab l USING (doc_idx)""")
def q_sentiment_file(spark, sf_dir):
    """S14 + J7: three sentiment values per document written (every third document twice, the later line counts), read back
    and appended to the topic features."""
    path = _folder(spark, "sentiment")
    lab = T.class_labels(spark, sf_dir)
    every = lab.select("doc_idx", F.lit(1).alias("turn"), "quality", "toxic", "label3")
    early = lab.where("doc_idx % 3 = 0").select("doc_idx", F.lit(0).alias("turn"), F.lit(9), F.lit(9), F.lit(9))
    lines = every.union(early)
    _ordered(lines, F.concat_ws(",", F.lit("news"), F.lit("2024-01-01"), *[F.col(c).cast("string") for c in
                                                                           ("doc_idx", "turn", "quality", "toxic", "label3")]),
             F.struct("doc_idx", "turn"), path)
    topics = T.topics(spark, sf_dir).select("doc_idx", F.col("topic").alias("features"))
    j = L.join_sentiment(topics, S.src_sentiment(spark, path))
    n = F.size("features")
    return rounded(j.select("doc_idx", n.alias("n_features"), *[F.get("features", n - 4 + i).alias(f"s{i}") for i in (1, 2, 3)],
                            F.get("features", F.lit(0)).alias("first")))


@query("label_prediction_file", S_.with_(S_.LABELS3, S_.PREDICTIONS) + """
SELECT run_id, row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, label, prediction FROM preds WHERE run_id = 'change_a'""")
def q_label_prediction_file(spark, sf_dir):
    """S15 + J9: labels of a LIBSVM file and predictions of a result file paired by line."""
    folder = _folder(spark, "pairs")
    p = q_eval.preds(spark, sf_dir).where(F.col("run_id") == "change_a").withColumn(
        "features", F.array(F.col("row_idx").cast("double")))
    K.sink_libsvm(p.select("row_idx", K.libsvm_line("label", "features")), f"{folder}/test.libsvm")
    _ordered(p, F.col("prediction").cast("string"), "row_idx", f"{folder}/test.out")
    return S.src_label_prediction_pairs(spark, f"{folder}/test.libsvm", f"{folder}/test.out", "change_a").select(
        "run_id", "row_idx", "label", "prediction")


@query("split_column_file", f"""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, split FROM ({ORACLE['split_by_date']})""")
def q_split_column_file(spark, sf_dir):
    """The split of each row from the seventh column of a split file, by line."""
    path = _folder(spark, "splits")
    d = q_splits.dated_split(spark, sf_dir)
    _ordered(d, F.concat_ws(",", *[F.col(c).cast("string") for c in ("row_idx", "date", "label", "label", "label", "label", "split")]),
             "row_idx", path)
    return S.src_split_column(spark, path)


@query("labelled_corpus_file", S_.with_(S_.COLLECTION, S_.LABELS3) + """
SELECT row_number() OVER (ORDER BY doc_idx) - 1 AS pos, company, doc_idx, CAST(quality AS DOUBLE) AS label
FROM coll JOIN lab USING (doc_idx)""")
def q_labelled_corpus_file(spark, sf_dir):
    """Company, document and label of each labelled row, in the order of the file."""
    path = _folder(spark, "labelled")
    j = T.collection(spark, sf_dir).drop("text").join(T.class_labels(spark, sf_dir), "doc_idx")
    _ordered(j, F.concat_ws(",", *[F.col(c).cast("string") for c in ("company", "date", "doc_idx", "quality")]), "doc_idx", path)
    return S.src_labelled_corpus(spark, path)


# --------------------------------------------------------------------------- LIBSVM files
LINES_A_FILE = 100


@query("check_libsvm_files", q_eval._LIBSVM_SQL + f""",
nb AS (SELECT line_no AS ln, (line_no - 1) // {LINES_A_FILE} AS file,
              row_number() OVER (PARTITION BY (line_no - 1) // {LINES_A_FILE} ORDER BY line_no) AS line_no FROM ln)
SELECT nb.file, nb.line_no, p.pos, p.problem FROM problems p JOIN nb ON nb.ln = p.line_no
UNION ALL SELECT file, max(line_no), -1, 'no newline' FROM nb WHERE file % 2 = 1 GROUP BY file""")
def q_check_libsvm_files(spark, sf_dir):
    """E11 over a written folder of LIBSVM files; every second file lacks its last newline (its lines but the last end in a
    newline of their own, and a space parts them)."""
    path = _folder(spark, "libsvmset")
    from pyspark.sql import Window
    n = F.floor((F.col("line_no") - 1) / LINES_A_FILE)
    last = F.lead("line_no").over(Window.partitionBy("name").orderBy("line_no")).isNull()
    rows = q_eval.libsvm_lines(spark, sf_dir).withColumn("odd", n % 2).withColumn("name", F.concat(F.lit("set-"), n.cast("string")))
    rows = rows.withColumn("value", F.when((F.col("odd") == 1) & ~last, F.concat("value", F.lit("\n"))).otherwise(F.col("value")))
    for odd, sep in ((0, "\n"), (1, " ")):
        part = rows.where(F.col("odd") == odd).repartition("name").sortWithinPartitions("name", "line_no")
        part.select("value", "name").write.mode("append").option("lineSep", sep).partitionBy("name").text(path)
    found = E.check_libsvm_files(spark, path)
    return found.select(F.regexp_extract(S.file_name(F.col("file")), r"([0-9]+)$", 1).cast("long").alias("file"),
                        F.col("line_no").cast("long").alias("line_no"), F.col("pos").cast("int").alias("pos"), "problem")


# --------------------------------------------------------------------------- result logs
# Fixed layout of the written history log: a row's setting by its number, as (k, alpha, L, kind).
LOG_K = [10, 15, 20]


def _setting(d):
    def pick(values, i):
        return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    k = pick(LOG_K, F.floor(d / 7) % 3)
    alpha, length = pick(TP.HIST_ALPHAS, d % 5), pick(TP.HIST_WINDOWS, F.floor(d / 5) % 5)
    return F.concat(F.lit("k="), k.cast("string"), F.lit(", alpha="), alpha.cast("string"), F.lit(", L="), length.cast("string"),
                    F.when(F.floor(d / 2) % 2 == 1, F.lit(" cond")).otherwise(F.lit("")))


def _pick_sql(values, i):
    return f"([{', '.join(map(str, values))}])[CAST({i} AS INTEGER) + 1]"


_LOG_SQL = S_.with_(S_.LABELS3, S_.PREDICTIONS) + f""", lg AS (
  SELECT k, CAST(alpha AS DOUBLE) AS alpha, L, cont, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS acc FROM (
    SELECT {_pick_sql(LOG_K, '(row_idx // 7) % 3')} AS k, {_pick_sql(TP.HIST_ALPHAS, 'row_idx % 5')} AS alpha,
           {_pick_sql(TP.HIST_WINDOWS, '(row_idx // 5) % 5')} AS L, (row_idx // 2) % 2 = 1 AS cont, label, prediction
    FROM preds WHERE run_id = 'hist_a') GROUP BY 1, 2, 3, 4)
"""


def _history_log(spark, sf_dir):
    """A history log: the accuracy of each setting's part of one run, as lines; read back."""
    p = q_eval.preds(spark, sf_dir).where(F.col("run_id") == "hist_a")
    acc = E.accuracy(p.withColumn("run_id", _setting(F.col("row_idx"))))
    path = _folder(spark, "histlog")
    _ordered(acc, F.concat(F.col("run_id"), F.lit(" \t[Accuracy] train: 0.5 \ttest: "), F.format_string("%.6f", "accuracy")), "run_id", path)
    return S.src_run_log(spark, path)


def _window_sql(cont: bool) -> str:
    cells = ", ".join(f"max(CASE WHEN L = {w} THEN acc END) AS L{w}" for w in TP.HIST_WINDOWS)
    return f"SELECT {str(cont).lower()} AS cont, alpha, {cells} FROM lg WHERE cont = {cont} GROUP BY alpha"


@query("run_log_windows", _LOG_SQL + _window_sql(False) + " UNION ALL " + _window_sql(True))
def q_run_log_windows(spark, sf_dir):
    """S16 + P6 + A10 + A11: alpha x L tables of the best accuracy over k, of the 'add' and the 'cont' lines of a history log."""
    log = _history_log(spark, sf_dir)
    parts = [RL.pivot_alpha_window(log, cont).select(F.lit(cont).alias("cont"), "alpha", *[F.col(f"`{w}`").alias(f"L{w}")
                                                                                          for w in TP.HIST_WINDOWS])
             for cont in (False, True)]
    return parts[0].unionByName(parts[1])


@query("run_log_add_cont", _LOG_SQL + """
SELECT k, max(CASE WHEN NOT cont THEN acc END) AS add, max(CASE WHEN cont THEN acc END) AS cont FROM lg GROUP BY k""")
def q_run_log_add_cont(spark, sf_dir):
    """S16 + P6 + A10: best 'add' and 'cont' accuracy per k of a history log."""
    return RL.add_beside_cont(_history_log(spark, sf_dir))


_DAYS = [("today", "[Topic] today k=", "hist_b", LOG_K, "(row_idx // 7) % 3"), ("days", "stock: t=", "change_b", list(range(1, 6)), "row_idx % 5")]


@query("run_log_today", S_.with_(S_.LABELS3, S_.PREDICTIONS) + " UNION ALL ".join(
    f"SELECT '{kind}' AS log, CAST({_pick_sql(vals, i)} AS BIGINT) AS at, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS acc "
    f"FROM preds WHERE run_id = '{run}' GROUP BY 2" for kind, _, run, vals, i in _DAYS))
def q_run_log_today(spark, sf_dir):
    """S16 + P6 + A13: accuracy of the 'today' lines by k, and by number of previous days (the line's place)."""
    out = []
    for (kind, mark, run, vals, _), table in zip(_DAYS, (RL.today_by_k, RL.history_by_t), strict=True):
        p = q_eval.preds(spark, sf_dir).where(F.col("run_id") == run)
        i = F.floor(F.col("row_idx") / 7) % 3 if kind == "today" else F.col("row_idx") % 5
        acc = E.accuracy(p.withColumn("run_id", F.get(F.array(*[F.lit(v) for v in vals]), i.cast("int"))))
        path = _folder(spark, f"{kind}log")
        _ordered(acc.coalesce(1), F.concat(F.lit(mark), F.col("run_id").cast("string"), F.lit(" \ttrain: 0.5 \ttest: "),
                                           F.format_string("%.6f", "accuracy")), "run_id", path)
        t = table(S.src_run_log(spark, path))
        out.append(t.select(F.lit(kind).alias("log"), F.col(t.columns[0]).cast("long").alias("at"), F.col("test_acc").alias("acc")))
    return out[0].unionByName(out[1])
