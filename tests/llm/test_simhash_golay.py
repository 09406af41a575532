"""op11: fingerprints by plain counting, the code's sharing rule, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricewire.llm import simhash_golay as sg
from pricewire.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, fp string, u long"


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    """[(id, fp)] -> {row: component} by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (n, _) in enumerate(fps):
        if n is not None:
            least[find(i)] = min(n, least.get(find(i), n))
    return [least.get(find(i)) for i in range(len(fps))]


def test_every_pair_within_four_bits_shares_a_key():
    rng = random.Random(3)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        row, key, kind = sg._keys(np.array([a, b], np.uint64).view(np.int64))
        one, two = ({(int(k), int(q)) for k, q, r in zip(key, kind, row) if r == i} for i in (0, 1))
        meets = [(sg.EXACT, sg.EXACT), (sg.LEFT, sg.RIGHT), (sg.RIGHT, sg.LEFT)]
        assert any((k, y) in two for k, q in one for x, y in meets if x == q)


def test_indices_are_all_codewords_within_distance_four():
    check, _ = sg._tables()
    code = (np.arange(4096) << 11) | check
    weight = np.bitwise_count(code)
    assert weight[1:].min() == 7 and (weight == 7).sum() == 253
    for word in random.Random(5).sample(range(1 << 23), 50):
        near = np.flatnonzero(np.bitwise_count(code ^ word) <= 4)
        got = sg.codeword_indices(np.array([word]))[0]
        assert sorted(got[got >= 0]) == sorted(near)
        assert np.bitwise_count(code[got[0]] ^ word) <= 3


def test_fingerprints_equal_plain_counts():
    for text in [None, "", " \t\n", "One", "a b c", "A  b\nC d e", "Été éTÉ x y z w", "x y z w " * 300]:
        assert sg.fingerprint(text) == plain(text)


def test_components_equal_all_pairs(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(300):  # chains and clouds around few centres, some far apart
        f = rng.choice(base) if i % 3 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << b
        rows.append((i, f))
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in rows]
    links = sg.fingerprint_links(spark.createDataFrame(sorted(set(signed)), "fp long"))
    got = {}
    for u, v in links.collect():
        assert (u ^ v).bit_count() <= 4 if (u ^ v) >= 0 else ((u ^ v) + (1 << 64)).bit_count() <= 4
        got.setdefault(u, set()).add(v)
        got.setdefault(v, set()).add(u)
    want = components(rows)

    def reach(f):
        seen, todo = {f}, [f]
        while todo:
            for g in got.get(todo.pop(), ()):
                if g not in seen:
                    seen.add(g)
                    todo.append(g)
        return seen
    for (f,), (n, _), w in zip(signed, rows, want):
        members = reach(f)
        assert min(i for i, (s,) in enumerate(signed) if s in members) == w


def test_defined_cases(spark):
    rows = [(4, None, "x", 1), (3, "", "x", 1), (None, "some words of one text", "x", 2), (8, "some words of one text", None, 2),
            (8, "some words of one text", None, 2), (7, "SOME words of\none text", "y", 2), (None, "quite another thing here now", "z", 3)]
    got = sg.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r for r in got}
    assert by[3, "0" * 16].component_id == by[4, "0" * 16].component_id == 3
    one = f"{plain('some words of one text'):016x}"
    assert {by[i, one].component_id for i in (None, 7, 8)} == {7} and by[8, one].n_same == 4
    assert by[None, f"{plain('quite another thing here now'):016x}"].component_id is None
    assert sg.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        sg.near_duplicates(spark.createDataFrame([], SCHEMA), max_bits=5)


def test_one_group_of_copies_and_one_of_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = [(i, text + f" tail{i}") for i in range(150)]
    docs = spark.createDataFrame(near + [(1000 + i, text) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r for r in sg.near_duplicates(docs).collect()}
    want = components([(i, plain(t)) for i, t in near] + [(1000, plain(text))])
    assert [got[i].component_id for i, _ in near] == want[:-1]
    assert {got[1000 + i].component_id for i in range(300)} == {want[-1]}


def test_query_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    fps = [(d.doc_id, plain(d.text)) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, (_, f), c in zip(docs, fps, components(fps))}
    got = QUERIES["op11_simhash_golay"](spark, SF_SMALL)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.select("doc_id", "fingerprint", F.col("component_id")).collect()} == want
