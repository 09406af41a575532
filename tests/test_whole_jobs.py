"""Registered queries run at the reference's sizes."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_vocabulary_is_not_cut_at_a_thousand(spark):
    rows = entry.queries()["vocab_topk"](spark, SF).collect()
    every = entry.queries()["vocab_all"](spark, SF).count()
    assert every > 1000 and len(rows) == min(every, 50_000)


def test_trigrams_are_counted(spark):
    from pricewire.plans import q_terms
    terms = [r.term for r in q_terms.train_counts(q_terms.text_dataset(spark, SF), 3).select("term").distinct().collect()]
    assert any(t.count(" ") == 2 for t in terms)
    last = entry.queries()["ngram_counts_order3"](spark, SF).agg({"idx": "max"}).first()[0]
    assert last + 1 == min(len(terms), 100_000)


def test_svm_grids_are_whole(spark):
    """The registered grids really run: every point has a row."""
    from pricewire.operators import models as M
    rows = entry.queries()["tune_all_feature_sets"](spark, SF).collect()
    assert [r.C for r in rows] == M.SVM_C * 6 and sum(r.best for r in rows) == 6
    assert all(0 <= r.valid_acc <= 1 for r in rows)
