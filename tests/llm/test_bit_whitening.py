"""op12: cross-products, basis and rows against plain arithmetic on whole numbers and numpy."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewire.llm import bit_whitening as bw
from pricewire.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, component string, n string, v int"


def plain(rows, components=16):
    """{(row number, component): (n, deviation, |whitened|, explained)} of [(id, vector)], by numpy on distinct vectors."""
    good = [(i, v) for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * c) + 1000000 for c in v) for i, v in good}
    fit = sorted(set(x.values()))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[n * a - t for a, t in zip(f, s)] for f in fit], float) / n
    w, q = np.linalg.eigh(c.T @ c / n)
    w, q = w[::-1], q[:, ::-1]
    out = {}
    for i, f in x.items():
        v = [n * a - t for a, t in zip(f, s)]
        for k in range(min(components, len(w))):
            if w[k] > 1e-12 * w.sum():
                out[i, k + 1] = (n, sum(a * a for a in v), abs(np.array(v, float) / n @ q[:, k]) / math.sqrt(w[k]), w[k] / w.sum())
    return out


def check(got, rows):
    """rows [(id, vector)] with distinct ids."""
    want = plain(rows)
    place = {d: i for i, (d, _) in enumerate(rows)}
    assert {(place[r.vec_id], r.component) for r in got} == set(want)
    for r in got:
        n, dev, white, share = want[place[r.vec_id], r.component]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(abs(r.whitened) - white) < 1e-7 and abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(0, 2 ** 62), min_size=d, max_size=d), min_size=1, max_size=70)))
def test_cross_products_are_exact(rows):
    y = np.array(rows, np.uint64)
    bits = [int(v).bit_length() for v in y.max(axis=0)]
    got = bw.cross_products(bw.bit_planes(y, bits), bits)
    for i in range(len(bits)):
        for j in range(i, len(bits)):
            assert got[i, j] == sum(a[i] * a[j] for a in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-2 ** 62, 2 ** 62), min_size=3, max_size=3), min_size=1, max_size=30))
def test_packed_vectors_are_canonical(rows):
    z = np.array(rows, np.int64)
    packed = [x.as_py() for part in bw._pack(z) for x in part]
    assert len(set(packed)) == len(set(map(tuple, rows)))
    import pyarrow as pa
    back = [tuple(v) for x in bw._unpack(pa.array(packed, pa.binary())) for v in (x - bw.SHIFT).tolist()]
    assert sorted(back) == sorted(map(tuple, rows))


def test_small_eigenvalues_beside_large_ones():
    rng = np.random.default_rng(2)
    y = rng.integers(-1000, 1000, (300, 6)) * np.array([10 ** 9, 1, 10 ** 7, 1, 10 ** 3, 1])
    y[:, 1] += y[:, 0] // 10 ** 9  # the small ones lean on the large ones
    n, s = len(y), [int(v) for v in y.astype(object).sum(axis=0)]
    c = [[n * sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) - s[i] * s[j] for j in range(6)] for i in range(6)]
    e, axes, _ = bw.principal_axes(c, n)
    assert len(e) == 6
    v = np.array(c, object)
    whole = np.array([[int(x) for x in row] for row in np.round(axes * 2.0 ** 53)], object)
    exact = whole.T.dot(v).dot(whole)
    cov = np.array([[int(x) / (n * n << 106) for x in row] for row in exact]) / np.sqrt(np.outer(e, e))
    assert np.abs(cov - np.eye(6)).max() < 1e-4


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=20) * np.arange(1, 21)]) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(100)]  # a third are copies of one vector
    check(bw.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


def test_query_against_numpy(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()]
    got = QUERIES["op12_bit_whitening"](spark, SF_SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


def test_defined_cases(spark):
    def run(rows):
        return bw.whiten(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)).collect()
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1e300, 0.0, 0.0]), (7, [1.0, 2.0])]
    good = [(10, [0.0, 1.0, 0.5]), (None, [1.0, 0.0, 0.5]), (12, [3.0, 2.0, 0.5]), (12, [3.0, 2.0, 0.5])]
    got = run(bad + good)
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (10, 1), (10, 2), (12, 1), (12, 1), (12, 2), (12, 2)]
    assert {r.n for r in got} == {3}  # the constant third dimension gives no component
    assert run([]) == [] and run(bad[:5]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    far = run([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 5.0])])
    assert {r.deviation for r in far if r.vec_id < 3} == {None} and max(r.identity_error for r in far) < 1e-4
    same = run([(1, [0.0, 1.0]), (2, [0.005, 1.009]), (3, [1.0, 0.0])])  # equal after the floor
    assert {r.n for r in same} == {2}
