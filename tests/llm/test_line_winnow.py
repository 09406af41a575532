"""Line dedup by winnowing against a direct comparison of all windows."""

import hashlib
import random

import pytest

from pricewire.llm.line_winnow import dedup_lines, windows
from pricewire.llm.common import text_key
from pricewire.llm.queries import QUERIES

WS = " \t\n\x0b\x0c\r"


def _brute(rows, w):
    docs = {}
    for i, t in rows:
        docs[i, t] = [] if t is None else [(k, x.strip(WS)) for k, x in enumerate(t.split("\n")) if x.strip(WS)]
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    first = {}
    for i, t in order:
        ls = [x for _, x in docs[i, t]]
        for a in range(len(ls) - w + 1):
            c, at = tuple(ls[a:a + w]), ((i is not None, i or 0), a)
            first[c] = min(first.get(c, at), at)
    out = []
    for i, t in rows:
        ls, gone = docs[i, t], set()
        for a in range(len(ls) - w + 1):
            d, b = first[tuple(x for _, x in ls[a:a + w])]
            if d != (i is not None, i or 0) or a >= b + w:
                gone |= set(range(a, a + w))
        dead = {ls[g][0] for g in gone}
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead)
        out.append((i, len(ls), len(gone), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_matches_brute_force(spark, window):
    rng = random.Random(window)
    block = [f"shared line {k}" for k in range(9)]
    rows = [(i, "\n".join(rng.choice(["a", "b", " b\t", "", "c d", "  "]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows += [(200 + i, "\n".join([f"own {i}", *block[rng.randint(0, 3):rng.randint(4, 9)], f"end {i}"])) for i in range(30)]
    rows += [(400, "\n".join(["same"] * 300)), (401, None), (402, ""), (None, "a\nb\nc d\na\nb\nc d"),
             (403, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (404, "long " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_lines int").repartition(4)
    got = [(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in dedup_lines(df, window, min_words=None).collect()]
    assert sorted(got, key=str) == _brute(rows, window)


def _brute_words(rows, w, least):
    """Whole texts without repeats of their ids: every window of every size that counts against all others."""
    docs = {i: [(k, x.strip(WS)) for k, x in enumerate((t or "").split("\n")) if x.strip(WS)] for i, t in rows}
    wins = []
    for i, ls in docs.items():
        for n in range(1, w + 1):
            for a in range(len(ls) - n + 1):
                c = tuple(x for _, x in ls[a:a + n])
                if n == w or n == len(ls) or sum(len(x.split()) for x in c) >= least:
                    wins.append((c, (i, a)))
    first = {}
    for c, at in wins:
        first[c] = min(first.get(c, at), at)
    gone = {i: set() for i in docs}
    for c, (i, a) in wins:
        d, b = first[c]
        if d != i or a >= b + len(c):
            gone[i] |= set(range(a, a + len(c)))
    out = []
    for i, t in rows:
        dead = {docs[i][g][0] for g in gone[i]}
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead)
        out.append((i, len(docs[i]), len(gone[i]), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [1, 3, 4])
def test_short_runs_match_brute_force(spark, window):
    rng = random.Random(window)
    lines = ["a", "b", " b\t", "", "c d", "e f g", "h i j  k l", " h i j  k l", "m\tn o p q r"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(80)] + [(90, None), (91, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in dedup_lines(df, window, min_words=5).collect()]
    assert sorted(got, key=str) == _brute_words(rows, window, 5)


def test_a_single_repeated_long_line_goes(spark):
    long = " ".join(f"word{k}" for k in range(20))
    rows = [(1, f"own one\n{long}\nend one"), (2, f"own two\n{long}\nend two"), (3, "short\npair"), (4, "short\npair"),
            (5, "own five\nshort\nlast five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df, min_words=20).collect()}
    assert got == dict(rows) | {2: "own two\nend two", 4: ""}


def test_rows_equal_in_id_and_text_do_not_delete_each_other(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 3 + [(2, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in dedup_lines(df).collect()) == [(1, "a\nb\nc")] * 3 + [(2, "d")]


def test_null_and_repeated_ids_are_places_of_their_own(spark):
    for i in (None, 7):
        rows = [(i, "a\nb\nc\nx"), (i, "a\nb\nc\ny")]
        got = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got in (["a\nb\nc\nx", "y"], ["a\nb\nc\ny", "x"])


def test_registered_forms_match_brute_force_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wants = {"op3_line_dedup": _brute_words(rows, 3, 20), "op3_line_dedup_windows": _brute(rows, 3)}
    for name, want in wants.items():
        got = [(r.doc_id, r.n_lines, r.n_deleted, r.text_md5) for r in QUERIES[name](spark, sf).collect()]
        md5 = [(i, n, k, None if t is None else hashlib.md5(t.encode()).hexdigest()) for i, n, k, t in want]
        assert sorted(got, key=str) == sorted(md5, key=str) and sum(r[2] for r in got) > 0


def test_shared_windows_share_a_fingerprint(spark):
    rows = [(1, [str(k) for k in range(40)]), (2, ["x", *[str(k) for k in range(7, 12)], "y"])]
    df = spark.createDataFrame(rows, "doc_id long, lines array<string>").selectExpr("doc_id", "0L tkey", "lines")
    w = windows(df, 5).collect()
    prints = {d: {r.h for r in w if r.doc_id == d} for d in (1, 2)}
    assert prints[1] & prints[2] and len(prints[1]) < 36
    assert text_key("t") is not None


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
