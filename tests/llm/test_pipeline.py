"""The pipeline on the smallest documents, stage by stage against plain Python."""

import re
from collections import Counter

import corpus_pipeline as cp
from pricewire.llm import ngram_join, piece_sampling, pivotal_mix, quality_rules
from tests.llm.test_ngram_join import _brute, _set

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    rows = docs.collect()
    one = cp.quality(spark, docs, SF)
    assert one.columns == docs.columns
    left = [r for r in rows if judged[r.doc_id]]
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, left)) and 0 < len(left) < len(rows)
    best = {}
    for r in left:
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    left = [r for r in left if best[r.text] == r.doc_id]
    two = cp.exact_dedup(spark, one, SF)
    assert two.columns == docs.columns and Counter(map(tuple, two.collect())) == Counter(map(tuple, left))
    stay = {d for d, n, c in _brute([(r.doc_id, r.text) for r in left], 5, 80) if n == 0 or d == c}
    left = [r for r in left if r.doc_id in stay]
    three = cp.near_dedup(spark, two, SF)
    assert three.columns == docs.columns and Counter(map(tuple, three.collect())) == Counter(map(tuple, left))
    copies = {r.doc_id: r.copies for r in pivotal_mix.pivotal_mix(three).collect()}
    want = Counter({tuple(r): copies[r.doc_id] for r in left if copies[r.doc_id]})
    four = cp.mix(spark, three, SF)
    assert four.columns == docs.columns and Counter(map(tuple, four.collect())) == want
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in left)
    assert abs(sum(len(r.text.split()) for r in four.collect()) - 1.5 * words) < 0.2 * words
    made = cp.segment(spark, four, SF)
    text = {r.doc_id: r.text for r in left}
    decoded = piece_sampling.decode(made.withColumn("ids", piece_sampling.unpacked())).collect()
    assert all(r.text == text[r.doc_id] and len(r.ids) == r.n_pieces for r in decoded)
    last = made.collect()
    assert Counter((r.doc_id, r.copy) for r in last) == {
        (d, c + 1): piece_sampling.K for d, n in copies.items() for c in range(n)} and _set("a b", 5)
    twice = {(r.doc_id, r.copy): r.perturbed for r in last if r["sample"] == 1 and copies[r.doc_id] > 1}
    assert twice and all(twice[d, 1] != twice[d, 2] for d, c in twice if c == 1)  # copies draw samples of their own
    ran = cp.run(spark, SF).collect()
    assert Counter(map(tuple, ran)) == Counter(map(tuple, last))


NAMES = ["_id", "_key", "_s", "_nth", "_copies", "_copy", "_row", "size", "tkey"]


def test_clashing_columns_come_back_unchanged(spark):
    text = " ".join(f"word{i} and{i % 7}" for i in range(60))
    rows = [(5, text, "en", "a", 1), (6, text + " more", "en", "a", 2), (7, None, "en", None, 3), (8, "short", "en", "b", 4),
            (9, " ".join(f"other{i} one{i}" for i in range(80)), "de", "b", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    docs = spark.createDataFrame([(*r, *range(10 * r[0], 10 * r[0] + len(NAMES))) for r in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    own = {tuple(r) for r in docs.collect()}
    good = quality_rules.keep_good(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {5, 6, 9} and {tuple(r) for r in good.collect()} < own
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {5, 7, 8, 9} and {tuple(r) for r in one.collect()} < own
    both = docs.union(docs.limit(1))  # a repeated row
    assert Counter(map(tuple, ngram_join.keep_one(both).collect())) == Counter(map(tuple, one.collect()))
    mix = pivotal_mix.mixed(both)
    taken = Counter()
    for r in pivotal_mix.pivotal_mix(both).collect():
        taken[r.doc_id] += r.copies
    assert mix.columns == docs.columns and {tuple(r) for r in mix.collect()} <= own
    assert Counter(r.doc_id for r in mix.collect()) == +taken


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
        if "text" not in docs.columns:
            break
