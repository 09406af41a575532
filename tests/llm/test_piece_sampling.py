"""Sampled segmentations: valid, distinct, distributed as the lattice says, decoded to the text."""

import zlib
from collections import Counter
from math import exp, log

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
from pricewire.llm import piece_sampling as ps

SP = sentencepiece.SentencePieceProcessor(model_file=ps.MODEL)


def _weights(alpha=ps.ALPHA):
    v = ps.vocabulary(ps.MODEL, alpha)
    return v, {SP.id_to_piece(i): (i, float(v.weight[i])) for i in range(259, SP.get_piece_size())}


def _all(text):
    """Every segmentation of a text, with its probability."""
    v, piece = _weights()
    s = ps.SPACE + text.replace(" ", ps.SPACE)

    def walk(at):
        if at == len(s):
            return [((), 0.0)]
        out = []
        for n in range(1, min(v.longest, len(s) - at) + 1):
            if s[at:at + n] in piece:
                i, w = piece[s[at:at + n]]
                out += [((i, *r), w + x) for r, x in walk(at + n)]
        if s[at] not in piece:
            raw = s[at].encode()
            out += [((*[v.byte_of[b] for b in raw], *r), len(raw) * v.byte_weight + x) for r, x in walk(at + 1)]
        return out
    found = walk(0)
    z = sum(exp(x) for _, x in found)
    return {ids: exp(x) / z for ids, x in found}


def _samples(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.samples for r in ps.sample_segmentations(df, k=k, **options).collect()}


def test_first_samples_and_pairs_follow_the_lattice(spark):
    text, n = "the\nand é", 4000
    want = _all(text)
    got = _samples(spark, [(i, text) for i in range(n)], 2)
    first = Counter(tuple(s[0].ids) for s in got.values())
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-3
    second = Counter(tuple(s[1].ids) for s in got.values())
    for ids, q in want.items():  # without replacement: P(second) = sum over others p/(1-p) q
        p2 = sum(p / (1 - p) * q for o, p in want.items() if o != ids)
        assert abs(second[ids] / n - p2) < 5 * (p2 * (1 - p2) / n) ** 0.5 + 2e-3
    for s in got.values():
        assert s[0].ids != s[1].ids and s[0].perturbed >= s[1].perturbed
        for x in s:
            assert x.log_prob == pytest.approx(log(want[tuple(x.ids)]), abs=1e-6) and x.log_inclusion <= 0


def test_inclusion_scores_estimate_without_bias(spark):
    """Horvitz-Thompson: the sum of p / inclusion over a sample has mean 1."""
    want = _all("he is")
    got = _samples(spark, [(i, "he is") for i in range(3000)], 3)
    totals = [sum(want[tuple(x.ids)] / exp(x.log_inclusion) for x in s) for s in got.values()]
    assert np.mean(totals) == pytest.approx(1.0, abs=0.05)


def test_all_segmentations_when_fewer_than_k(spark):
    want = _all("on")
    got = _samples(spark, [(1, "on")], 50)[1]
    assert len(got) == len(want) and {tuple(x.ids) for x in got} == set(want)
    assert all(x.log_inclusion == 0 for x in got)


def test_texts_decode_and_samples_are_distinct(spark):
    rows = [(1, "Hello  world\n\n x "), (2, " lead\ttab"), (3, "漢字 😀 ñandú"), (4, "a" * 5000), (5, "word " * 20_000),
            (6, "▁mark"), (7, ""), (8, None), (None, "no id")]
    got = _samples(spark, rows, 4)
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        ids = [tuple(x.ids) for x in got[i]]
        assert len(set(ids)) == len(ids) == (4 if t else 1)
        for x in got[i]:
            assert SP.decode(list(x.ids)) == t.replace(ps.SPACE, " ") and x.n_pieces == len(x.ids)
            assert all(SP.id_to_piece(p) for p in x.ids)
        values = [x.perturbed for x in got[i]]
        assert values == sorted(values, reverse=True)


def test_samples_do_not_depend_on_batches(spark):
    rows = [(i, f"text number {i} with some more words in it\nand a second line {i * 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.samples for r in ps.sample_segmentations(df.coalesce(1), k=3).collect()}
    many = {r.doc_id: r.samples for r in ps.sample_segmentations(df.repartition(9), k=3).collect()}
    assert one == many


def test_decode_column_and_query(spark):
    df = spark.createDataFrame([(SP.encode("some text"),), ([],), (None,)], "ids array<int>")
    assert [r.text for r in ps.decode(df).collect()] == ["some text", "", None]
    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["op8_piece_sampling"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs * ps.K and all(r.round_trip for r in rows)
    assert len({(r.doc_id, r.ids_crc32) for r in rows}) == len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ps.sample_digests(empty).collect() == []


def test_texts_are_sampled_once(spark):
    df = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    plan = ps.sample_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_lattice_grows_and_begins_anew(monkeypatch):
    texts = [f"some text {i} of words{i % 7}\n\nnext {'x' * (i % 5)}line" for i in range(60)] + [" two  spaces\x01", "a▁b"]
    keys, v = np.arange(len(texts), dtype=np.uint64), ps.vocabulary(ps.MODEL, ps.ALPHA)
    want = ps._rows(texts, keys, ps.Lattice(v), 3, False)
    monkeypatch.setattr(ps, "TASK_CHARS", 90)
    assert ps._rows(texts, keys, ps.Lattice(v), 3, False) == want
    monkeypatch.setattr(ps, "NODES", 40)
    assert ps._rows(texts, keys, ps.Lattice(v), 3, False) == want
    monkeypatch.setattr(ps, "NEAR", 2)
    for a, b in zip(ps._rows(texts, keys, ps.Lattice(v), 3, False), want, strict=True):
        assert [(x[0], x[1], x[5]) for x in a] == [(x[0], x[1], x[5]) for x in b]


def test_query_returns_the_ids(spark, tmp_path):
    """The segmentations themselves, and digests of them."""
    texts = {1: "some text\nof words", 2: "", 3: None, 4: "漢字 a▁b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = entry.queries()["op8_piece_sampling"](spark, str(tmp_path))
    rows = d.withColumn("ids", ps.unpacked()).collect()
    assert Counter(r.doc_id for r in rows) == {1: ps.K, 2: 1, 4: ps.K}
    for r in rows:
        assert SP.decode(list(r.ids)) == texts[r.doc_id].replace(ps.SPACE, " ") and r.round_trip and len(r.ids) == r.n_pieces
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
