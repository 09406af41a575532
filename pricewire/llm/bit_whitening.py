"""Embedding whitening by bit-sliced scatter.

Each entry c becomes the integer x = floor(64 * c) + 1000000.  The fit list holds each distinct x vector once:

1. Vectors are packed (one byte of width, then little-endian integers of the least width that fits them), so
   equal vectors are equal bytes; a distinct aggregation combines copies before they shuffle.
2. Sums S and bounds of every dimension, exact.
3. Bit-sliced scatter: per task, each dimension is shifted by its minimum; its bit planes are packed across rows into 64-bit
   words, and the cross-product of two dimensions is the sum over pairs of planes of 2^(p+q) times the popcount of
   their AND.  Partial products travel as limbs of 32 bits, one row per pair of dimensions and task, and Spark sums them.
4. The d x d scatter is centred as integers (n * cross-product - S S') before it becomes floating point; one exact
   rotation into the eigenvectors' basis and Jacobi steps there make small eigenvalues accurate beside large ones.
5. The largest deviation of the whitened fit list's covariance from the identity is measured on its rows.

The driver holds d x d numbers, never rows.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry, or one whose x is no long, are dropped;
of vectors of different lengths, those of the length with most distinct vectors (of equals the longest) are used, the others
dropped; repeated rows and null ids keep their rows; components without variance are not returned (a table of one
distinct vector gives no rows), nor is anything of an empty table; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewire.llm.common import saved

SCALE, SHIFT = 64, 1_000_000
LIMB = 32
LIMBS = 6              # products below 2^192
WORDS = 1 << 10        # 64-bit words of a bit plane packed at a time
NO_VARIANCE = 1e-20    # share of the trace below which a component counts as without variance


# ------------------------------------------------------------------ rows
def _vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 c) as long matrix) of a batch's usable vectors, one pair per length."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        z = np.floor(values * SCALE)
        bad = np.concatenate(([0], np.cumsum(~(np.abs(z) < 2.0 ** 63 - 2 * SHIFT))))
    size = np.diff(offsets)
    fine = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & ~col.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == d))
        yield rows, z[offsets[rows][:, None] + np.arange(d)].astype(np.int64)


def _pack(z: np.ndarray) -> Iterator[pa.Array]:
    """The rows of a matrix of longs as canonical bytes."""
    need = np.full(len(z), 8)
    for width in (4, 2, 1):
        lim = 1 << (8 * width - 1)
        need[((z >= -lim) & (z < lim)).all(axis=1)] = width
    for width in np.unique(need).tolist():
        part = z[need == width].astype(f"<i{width}")
        step = 1 + width * z.shape[1]
        data = np.empty((len(part), step), np.uint8)
        data[:, 0] = width
        data[:, 1:] = part.view(np.uint8).reshape(len(part), -1)
        at = np.arange(len(part) + 1, dtype=np.int64) * step
        yield pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(data)])


def _unpack(col: pa.Array) -> Iterator[np.ndarray]:
    """x as long matrices, one per length and width."""
    offsets = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) else np.empty(0, np.uint8)
    size = np.diff(offsets)
    width = data[offsets[:-1]] if len(col) else size
    for step, w in np.unique(np.stack([size, width]), axis=1).T.tolist() if len(col) else ():
        rows = np.flatnonzero((size == step) & (width == w))
        part = data[offsets[rows][:, None] + np.arange(1, step)]
        yield np.ascontiguousarray(part).view(f"<i{w}").astype(np.int64) + SHIFT


def fit_list(table: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(xb): each distinct x vector once, packed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, z in _vectors(batch.column(0)):
                for xb in _pack(z):
                    yield pa.RecordBatch.from_arrays([xb.cast(pa.binary())], ["xb"])
    return table.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(pack, "xb binary").distinct()


def _by_length(batches: Iterator[pa.RecordBatch], d: int | None = None) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in _unpack(batch.column(0)):
            if d is None or x.shape[1] == d:
                yield x


# ----------------------------------------------------------------- sums
def _limbs(value: int) -> list[int]:
    """value >= 0 in limbs of 32 bits, lowest first."""
    return [value >> (LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS)]


def _whole(limbs) -> int:
    return sum(int(v) << (LIMB * i) for i, v in enumerate(limbs))


def _sum_limbs() -> list:
    return [F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]


LIMB_SCHEMA = ", ".join(f"l{i} long" for i in range(LIMBS))


def dimension_sums(fit: DataFrame) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """{length: (n, S, minima, maxima)} of the fit list, exact."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}
        for x in _by_length(batches):
            d = x.shape[1]
            n, s, lo, hi = state.get(d, (0, np.zeros(d, object), np.full(d, 2 ** 63 - 1), np.full(d, -2 ** 63)))
            base = x.min(axis=0)
            wide = int((x.max(axis=0).astype(object) - base.astype(object)).max()) >= 1 << 40
            more = (x.astype(object) - base if wide else x - base).sum(axis=0).astype(object) + len(x) * base.astype(object)
            state[d] = [n + len(x), s + more, np.minimum(lo, base), np.maximum(hi, x.max(axis=0))]
        rows = [(d, j, n, int(lo[j]), int(hi[j]), *_limbs(int(s[j]) + (n << 64))) for d, (n, s, lo, hi) in state.items() for j in range(d)]
        if rows:
            names = ["d", "j", "n", "lo", "hi", *[f"l{i}" for i in range(LIMBS)]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows],
                                             pa.schema([(m, pa.int32() if m in "dj" else pa.int64()) for m in names]))
    parts = fit.mapInArrow(part, f"d int, j int, n long, lo long, hi long, {LIMB_SCHEMA}")
    total = parts.groupBy("d", "j").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *_sum_limbs())
    out: dict[int, tuple] = {}
    for r in sorted(total.collect(), key=lambda r: (r.d, r.j)):
        _, s, lo, hi = out.setdefault(r.d, (r.n, [], [], []))
        s.append(_whole(r[5:]) - (r.n << 64))
        lo.append(r.lo)
        hi.append(r.hi)
    return out


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """(planes, words) of non-negative y (rows, d): dimension j gives bits[j] planes, lowest first, packed across rows."""
    words = -(-len(y) // 64)
    planes = np.zeros((sum(bits), 8 * words), np.uint8)
    at = 0
    for j, b in enumerate(bits):
        for p in range(b):
            plane = np.packbits(y[:, j] >> p & 1)
            planes[at, :len(plane)] = plane
            at += 1
    return planes.view(np.uint64)


def cross_products(planes: np.ndarray, bits: list[int]) -> np.ndarray:
    """(d, d) of Python integers from weighted AND-popcounts; only j >= i is filled."""
    d = len(bits)
    begin = np.concatenate(([0], np.cumsum(bits)))
    power = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if sum(bits) else np.empty(0, np.int64)
    small = 2 * max(bits, default=0) + planes.shape[1].bit_length() + 6 < 62
    weight = (np.int64(1) << power) if small else np.array([1 << int(p) for p in power], object)
    out = np.zeros((d, d), object)
    for i in range(d):
        for p in range(bits[i]):
            a = begin[i] + p
            count = np.bitwise_count(planes[a] & planes[begin[i]:]).sum(axis=1, dtype=np.int64)
            term = count * weight[begin[i]:] * (1 << p)
            cut = begin[i:-1] - begin[i]
            live = np.flatnonzero(np.array(bits[i:]) > 0)
            out[i, i + live] += np.add.reduceat(term, cut[live]).astype(object)
    return out


def scatter(fit: DataFrame, lo: list[int], hi: list[int]) -> list[list[int]]:
    """Exact cross-products of the shifted dimensions over the fit list: [[sum of y_i y_j]], d x d."""
    d, bits = len(lo), [int(b - a).bit_length() for a, b in zip(lo, hi, strict=True)]
    low = np.array(lo, np.int64)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        held: list[np.ndarray] = []
        n = 0
        for x in _by_length(batches, d):
            for at in range(0, len(x), 64 * WORDS):
                held.append(x[at:at + 64 * WORDS] - low)  # spreads of a long stay right modulo 2^64, read as unsigned
                n += len(held[-1])
                if n >= 64 * WORDS:
                    total = total + cross_products(bit_planes(np.concatenate(held).view(np.uint64), bits), bits)
                    held, n = [], 0
        if n:
            total = total + cross_products(bit_planes(np.concatenate(held).view(np.uint64), bits), bits)
        i, j = np.triu_indices(d)
        limbs = np.array([_limbs(v) for v in total[i, j]], np.int64).reshape(-1, LIMBS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          *[pa.array(limbs[:, k]) for k in range(LIMBS)]],
                                         ["i", "j", *[f"l{k}" for k in range(LIMBS)]])
    parts = fit.mapInArrow(part, f"i int, j int, {LIMB_SCHEMA}")
    out = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j").agg(*_sum_limbs()).collect():
        out[r.i][r.j] = out[r.j][r.i] = _whole(r[2:])
    return out


# -------------------------------------------------------------- the basis
def _jacobi(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of a symmetric, nearly diagonal matrix; each off-diagonal entry is judged beside its own diagonal."""
    m, d = m.copy(), len(m)
    v = np.eye(d)
    for _ in range(30):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(m[p, q]) <= 1e-17 * np.sqrt(abs(m[p, p] * m[q, q])):
                    continue
                turned = True
                tau = (m[q, q] - m[p, p]) / (2 * m[p, q])
                t = (1 if tau >= 0 else -1) / (abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = t * c
                for a in (m, m.T, v):
                    a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                m[p, q] = m[q, p] = 0.0
        if not turned:
            break
    return np.diag(m).copy(), v


def _ratio(a: int, b: int) -> float:
    """a / b of integers of any size."""
    return a / b


def principal_axes(centred: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of centred / n^2, given n * cross-products - S S'."""
    c = np.array(centred, object)
    d = len(c)
    trace = _ratio(int(sum(c[i, i] for i in range(d))), n * n)
    if not trace:
        return np.empty(0), np.empty((d, 0)), 0.0
    first = np.array([[_ratio(int(v), n * n) for v in row] for row in c])
    w, q = np.linalg.eigh(first)
    q = q[:, np.argsort(-w, kind="stable")]
    whole = np.array([[int(v) for v in row] for row in np.round(q * 2.0 ** 53)], object)  # q up to rounding, exact from here
    turned = whole.T.dot(c).dot(whole)
    m = np.array([[_ratio(int(v), n * n << 106) for v in row] for row in turned])
    e, j = _jacobi((m + m.T) / 2)
    axes = (np.array(whole, float) / 2.0 ** 53) @ j
    length = np.sqrt((axes * axes).sum(axis=0))
    e, axes = e / length ** 2, axes / length
    order = np.argsort(-e, kind="stable")
    e, axes = e[order], axes[:, order]
    live = e > NO_VARIANCE * trace
    return e[live], axes[:, live], trace


# -------------------------------------------------------------- whitening
def _centred(x: np.ndarray, n: int, s: list[int], lo: list[int], hi: list[int]) -> np.ndarray:
    """n * x - S, as longs if they fit, else as Python integers."""
    rest = [t - n * a for t, a in zip(s, lo, strict=True)]
    if max(n * (b - a) for a, b in zip(lo, hi, strict=True)) < 1 << 62:
        return n * (x - np.array(lo, np.int64)) - np.array(rest, np.int64)
    return n * (x.astype(object) - np.array(lo, object)) - np.array(rest, object)


def _deviation(v: np.ndarray) -> list:
    """Exact sums of squares per row; None beyond a long."""
    if v.dtype != object:
        most = int(np.abs(v).max(initial=0))
        if most * most * v.shape[1] < 1 << 63:
            return (v * v).sum(axis=1).tolist()
    near = np.square(v.astype(float)).sum(axis=1)
    out: list = [None] * len(v)
    for i in np.flatnonzero(near < 2.0 ** 63 * 1.001).tolist():
        exact = sum(int(a) * int(a) for a in v[i])
        out[i] = exact if exact < 1 << 63 else None
    return out


def whiten(table: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id {}, deviation long, w array<double>".format(table.select(F.col(id_col)).schema[0].dataType.simpleString())
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = saved(fit_list(table, vector_col))
    sums = dimension_sums(fit)
    d = max(sums, key=lambda k: (sums[k][0], k), default=0)
    n, s, lo, hi = sums.get(d, (0, [], [], []))
    axes, roots, explained, error = np.empty((d, 0)), np.empty(0), [], 0.0
    if n:
        cross = scatter(fit, lo, hi)
        rest = [t - n * a for t, a in zip(s, lo, strict=True)]
        centred = [[n * cross[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
        e, axes, trace = principal_axes(centred, n)
        axes, e = axes[:, :components], e[:components]
        roots, explained = np.sqrt(e), (e / trace).tolist() if trace else []
    k = axes.shape[1]
    scale = axes / (n * roots) if k else axes

    def project(v: np.ndarray) -> np.ndarray:
        return v.astype(float) @ scale

    if k:
        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for x in _by_length(batches, d):
                z = np.hstack([np.ones((len(x), 1)), project(_centred(x, n, s, lo, hi))])
                total += z.T @ z
            i, j = np.triu_indices(k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                             ["i", "j", "m"])
        got = fit.mapInArrow(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
        m = {(r.i, r.j): r.m / n for r in got}  # the x - S/n are centred exactly; what is left of the means is taken off
        error = max(abs(m[i, j] - m[0, i] * m[0, j] - (i == j)) for i, j in m if i)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, z in _vectors(batch.column(1)) if k else ():
                if z.shape[1] != d:
                    continue
                v = _centred(z + SHIFT, n, s, lo, hi)
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * k), pa.array(project(v).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(_deviation(v), pa.int64()), w],
                                                 ["vec_id", "deviation", "w"])
    out = rows.mapInArrow(white, schema).select("vec_id", "deviation", F.posexplode_outer("w").alias("i", "whitened"))
    share = F.array(*[F.lit(float(x)) for x in explained]) if explained else F.array().cast("array<double>")
    return out.filter("i is not null").select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error"))
