"""Separator scan: flat files written and scanned again, block stitching, defined cases."""

import base64

import numpy as np
import pytest
import tiktoken

from pricewire.llm import separator_scan as ss
from pricewire.llm.common import shared_path


def _encoder():
    with open(ss.VOCAB, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=ss.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_counts_after_the_round_trip(spark, block):
    rows = [(5, "hello world, this is a text"), (1, ""), (2, None), (None, "no id"), (7, "<|endoftext|> is text"), (5, "repeat"),
            (5, "repeat"), (-3, "negative\nid\n\n"), (9, "long " * 20_000 if block > 60 else "short"), (1 << 40, "é ü 漢字 😀")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int").repartition(3)
    enc = _encoder()
    got = [tuple(r) for r in ss.document_token_counts(df, block_tokens=block).collect()]
    assert sorted(got, key=str) == sorted(((i, len(enc.encode_ordinary(t or "")), True) for i, t in rows), key=str)


def test_flat_files_hold_nothing_but_ids_and_separators(spark):
    df = spark.createDataFrame([(2, "two words"), (1, "one")], "doc_id long, text string").coalesce(1)
    path = shared_path(spark, "flat-test")
    ss.write_flat(df, path)
    enc = _encoder()
    content = spark.read.format("binaryFile").load(f"{path}/kind=tokens").collect()[0].content
    assert np.frombuffer(content, "<u2").tolist() == [*enc.encode_ordinary("one"), 50256, *enc.encode_ordinary("two words"), 50256]


def test_several_files_of_one_task(spark):
    rows = [(i, "word " * i) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    enc = _encoder()
    got = [tuple(r) for r in ss.document_token_counts(df, block_tokens=3, file_rows=2).collect()]
    assert sorted(got) == [(i, len(enc.encode_ordinary(t)), True) for i, t in rows]


def test_files_of_one_task_keep_keys_of_their_own(spark, tmp_path):
    names = {f"part-00000-c0ffee00-c1c2-4c3d-9c4e-00c500c600c7.c00{k}.txt" for k in range(3)}
    for name in names:
        (tmp_path / name).write_bytes(np.array([5, ss.END_OF_DOCUMENT], "<u2").tobytes())
    assert {(r.file, r.doc_no, r.n_tokens) for r in ss.scan(spark, str(tmp_path)).collect()} == {(n, 0, 1) for n in names}


@pytest.mark.parametrize("block", [1, 2, 3, 5, 100])
def test_stitching_matches_a_plain_split(spark, block):
    rng = np.random.default_rng(block)
    files = {f"f{i}": rng.choice([7, 8, 9], n, p=[0.3, 0.4, 0.3]) for i, n in enumerate([0, 1, 2, 13, 40, 41])}
    files["none"] = np.array([8] * 11)
    df = spark.createDataFrame([(k, bytearray(v.astype("<u4").tobytes())) for k, v in files.items()], "file string, content binary")
    want = []
    for name, ids in files.items():
        start, no = 0, 0
        for end in np.flatnonzero(ids == 7):
            want.append((name, no, start, int(end) - start, True))
            start, no = int(end) + 1, no + 1
        if start < len(ids):
            want.append((name, no, start, len(ids) - start, False))
    got = ss.stitch(ss.blocks(df, end=7, width=4, block_tokens=block)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    assert ss.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
