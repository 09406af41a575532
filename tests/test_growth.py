"""Steps whose cost must not grow faster than their input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pricewire.functions import text as X
from pricewire.operators import terms as TM
from pricewire.operators import topics as TP
from pricewire.plans import q_files, q_io, q_text
from pricewire.sources import files
from pricewire.sources import writers as K

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_adjacent_history_keeps_no_sum_by_component(spark):
    """Repeated places are added, a missing company looks back at nothing, vectors differ in length."""
    rows = [(0, "a", [1.0, 2.0]), (1, "a", [3.0, 4.0, 5.0]), (1, "a", [1.0, 9.0, 1.0]), (2, "b", [7.0]), (3, "a", [0.5, None]), (3, None, [8.0]), (4, None, [2.0])]
    df = spark.createDataFrame(rows, "pos long, company string, topic array<double>")
    out = TP.topic_hist_adjacent(df, (1.0, 0.5), (1, 3))
    assert _plan(TP._adjacent(df, (1.0,), (1,))).count("HashAggregate(keys=[pos") <= 2 and "i#" not in _plan(TP._adjacent(df, (1.0,), (1,))).split("keys=")[1].split("]")[0]
    got = {(r.pos, r.company, r.i, r.decay, r.w): r.hist for r in out.collect()}
    want = {}
    for pos, company, topic in rows:
        for i, v in enumerate(topic):
            if v is None:
                continue
            for dc in (1.0, 0.5):
                for w in (1, 3):
                    want[pos, company, i, dc, w] = sum(dc ** (pos - p) * t[i] for p, c, t in rows if company is not None and c == company
                                                      and 1 <= pos - p <= w and i < len(t) and t[i] is not None)
    assert got == pytest.approx(want)


def test_vocabulary_counts_move_no_term(spark):
    docs = spark.createDataFrame([(1, "profit rises again again"), (2, "profit falls"), (2, "again profit"), (3, ""), (4, None), (None, "profit again")],
                                 "row_idx long, text string")
    vocab = spark.createDataFrame([("profit", 0), ("again", 1), ("again again", 2)], "term string, idx long")
    df = TM.vocab_term_counts(docs, vocab, ngram_max=2, bound=10)
    assert _plan(df).count("Exchange hashpartitioning") == 1  # the texts, by row
    assert Counter({(r.row_idx, r.idx): r.cnt for r in df.collect()}) == {
        (1, 0): 1, (1, 1): 2, (1, 2): 1, (2, 0): 2, (2, 1): 1, (None, 0): 1, (None, 1): 1}
    old = TM.bow_counts(TM.doc_term_counts(docs, ngram_max=2), vocab, bound=10)
    assert {tuple(r) for r in old.collect()} == {tuple(r) for r in df.collect()}
    totals = {r.term: r.cnt for r in TM.term_totals(docs).collect()}
    assert totals == {"profit": 4, "rises": 1, "again": 4, "falls": 1}


def test_a_symbol_is_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_files, "_folder", lambda spark, name: str(tmp_path / name))
    rows = entry.queries()["prices_file"](spark, SF).collect()
    files = list((tmp_path / "prices").glob("name=*/*.csv"))
    assert len(files) == len({r.symbol for r in rows}) == len(list((tmp_path / "prices").glob("name=*")))


def test_named_csv_files_are_spark_s(spark, tmp_path, monkeypatch):
    """The files that tasks make themselves hold what Spark's writer puts there; rows of a name in several batches are one file."""
    rows = [("stock_a.csv", "2024-01-01", 1.5, None), ("stock_a.csv", None, None, None), ("a=b/c%1:é", 'say "x", y', -0.0, 1e300), (None, "n", 2.0, 3.0),
            ("", "e", float("nan"), float("inf")), ("stock_a.csv", "", 1.0, 0.1), ("tail\\", "back\\slash", 123456789.125, 1e-7)] + [("many", str(i), float(i), None) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, Date string, Open double, Close double")
    df.repartition(3, "name").write.partitionBy("name").csv(f"{tmp_path}/spark", header=True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        K.sink_named_csv(df, "name", f"file://{tmp_path}/own")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(K, "_mounted", lambda spark, path: None)
    K.sink_named_csv(df, "name", f"{tmp_path}/store")

    def held(top):
        files = [f for f in (tmp_path / top).rglob("*") if f.is_file() and f.name[0] not in "._"]
        assert len(files) == len({f.parent for f in files})
        return {f.parent.name: (f.read_text().split("\n")[0], sorted(f.read_text().split("\n"))) for f in files}
    assert held("own") == held("spark") == held("store") and len(held("own")) == 5
    assert not [f for f in (tmp_path / "own").rglob(".*")]
    with pytest.raises(Exception):  # the folder must be new
        monkeypatch.undo()
        K.sink_named_csv(df, "name", f"{tmp_path}/own")


def test_prices_are_listed_and_read_in_few_tasks(spark, tmp_path):
    """Many folders of one file each: neither a listing task nor a scan task for a few of them."""
    n, tracker = 300, spark.sparkContext.statusTracker()
    for i in range(n):
        (tmp_path / f"name=stock_s{i}.csv").mkdir()
        (tmp_path / f"name=stock_s{i}.csv" / "part-0.csv").write_text(f"Date,Open,High,Low,Close\n2024-01-01,{i}.5,nan,,1\n" if i % 2 else "Date,Open,High,Low,Close\n")
    most, key = 4 * spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    spark.sparkContext.setJobGroup("prices", "prices")
    try:
        df = files.src_prices(spark, str(tmp_path))
        got = {r.symbol: tuple(r)[2:] for r in df.collect()}
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("prices")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spark.conf.get(key) == before
    assert jobs and all(0 < tracker.getStageInfo(k).numTasks <= most for j in jobs for k in j.stageIds)
    assert got == {f"s{i}": (i + 0.5, None, None, 1.0) for i in range(1, n, 2)}


def test_cleaning_looks_for_no_negated_class(spark):
    """Removing the disallowed characters keeps the runs of allowed ones: the same text, without the slow search."""
    texts = ["", None, "Can't we? We'll -- see.", "tab\there\r\nnext\n\n line", "\u0130stanbul \u212Aelvin \U0001F600smile\U0001F600", "12.5%", "a1b2--c \u00fc\u00f6 ",
             "'ve'S N'T", " \n ", "\u00a0x\u2028y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = {X.clean_text: X.CONTRACTIONS, X.clean_text_sentences: X.CONTRACTIONS + X.SENTENCE_MARKS}
    for clean, rules in pairs.items():
        assert "[^a-z" not in _plan(df.select(clean("text")))
        plain = X.ascii_lower("text")
        for pattern, to in [*rules, (X.DISALLOWED, ""), (X.WHITESPACE_RUN, " ")]:
            plain = F.regexp_replace(plain, F.lit(pattern), F.lit(to))
        rows = df.select(clean("text").alias("got"), plain.alias("want")).collect()
        assert [r.got for r in rows] == [r.want for r in rows]
    assert [r[0] for r in df.select(X.clean_text("text")).collect()][:3] == ["", None, " cannot we we will -- see"]


@pytest.mark.parametrize("name, sink", [("corpus_coverage_file", "sink_raw_corpus"), ("collection_file", "sink_raw_corpus"), ("doc_term_file", "sink_doc_term")])
def test_ordered_writers_get_stored_rows(spark, tmp_path, monkeypatch, name, sink):
    """The range sort of a writer runs its input twice: it must not be the join with the vocabulary."""
    docs = [(3, "profit Rises, rises"), (1, "profit 9 falls"), (7, "12"), (2, None), (5, "\n"), (4, "rises")]
    spark.createDataFrame([(i, t, "en", f"s{i}", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    plans, write = [], getattr(K, sink)
    monkeypatch.setattr(q_io.K, sink, lambda rows, path: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, path)))
    rows = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).orderBy("doc_idx" if name != "doc_term_file" else "line_no").collect()]
    assert len(plans) == 1 and "Join" not in plans[0] and "Generate" not in plans[0]
    if name == "doc_term_file":  # rises 3, profit 2, falls 1
        assert rows == [(0, "2 1:1 2:1 "), (1, "2 0:2 1:1 "), (2, "1 0:1 "), (3, "0 ")]
    else:
        kept = [(0, "s1"), (1, "s3"), (2, "s4"), (3, "s5")]
        assert [r[:2] for r in rows] == (kept if name == "corpus_coverage_file" else kept[:3])


def test_stored_corpus_holds_a_text_for_the_words(spark, tmp_path, monkeypatch):
    docs = [(1, "profit 9 falls -- falls"), (2, "\n"), (3, " "), (4, None), (5, "cannot"), (None, "a\nb"), (1, "profit 9 falls -- falls")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    stored, cut = [], q_text.cut_lineage
    monkeypatch.setattr(q_text, "cut_lineage", lambda df: stored.append(df.dtypes) or cut(df))
    got = q_text.stored_corpus(spark, str(tmp_path))
    assert stored == [[("doc_idx", "bigint"), ("company", "string"), ("date", "date"), ("words", "string")]]
    want = q_text.corpus(spark, str(tmp_path)).select(*got.columns)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {(r.doc_idx, *r.tokens) for r in got.collect()} == {(1, "profit", "falls", "--", "falls"), (2,), (3,), (5, "can", "not"), (None, "a", "b")}
