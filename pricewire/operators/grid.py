"""Many linear models fitted together (M2-M6, M9): one pass over the data gives the loss and gradient of every grid point.

The rows are packed once into blocks (a few thousand rows of doubles each, kept memory-and-disk).  A grid point is a loss, a
``C``, a view of the features and, where needed, a class against the rest or a fold left out.  Each point runs its own
limited-memory BFGS; the points that all of them ask for next are evaluated in one Spark job, in which a task
multiplies its blocks with all coefficient vectors at once and the partial gradients are added.  So a grid costs
as many passes as its slowest point needs, not their sum.

The objective is the LIBSVM one divided by C n: ``mean loss + |w|^2 / (2 C n)``, the intercept without penalty.  Hinge and
epsilon-insensitive loss are made smooth over a width ``DELTA`` around their kinks (approached in steps, each started from
the last solution), which moves the mean loss by at most ``DELTA / 2``.

Views are column sets of the packed features, or random Fourier features of the RBF kernel ``exp(-gamma |x - y|^2)``
(Rahimi and Recht 2007): one random projection for all gammas, taken where a block is read (a block moves as the features
it comes from); a gamma only scales it.  Four times a gamma doubles the angles, so the gammas of a grid share their cosines.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
CACHE_ROWS = 256      # of a block at once: their scores and losses for the points of a view stay in a core's cache
DELTAS = (0.5, 0.05)
MEMORY = 10
MAX_EVALUATIONS = 60   # per point and smoothing width
TOLERANCE = 1e-4      # on the gradient; LIBSVM's own is 1e-3
FLAT = 1e-7           # relative gain that counts as none; three in a row end a fit
TASK_BYTES = 32 << 20  # of packed features that a task of a pass reads at least, if there are so many
TASK_WORK = 2e8       # multiplications that a task of a pass does at least, if there are so many
VIEW_WORK = 30        # points whose multiplications take as long as a view's features
DOUBLINGS = 8         # of an angle before its cosine is taken anew; each doubles the rounding error
FAN_IN = 16           # tasks that add partial gradients
DIRECT_BYTES = 64 << 20  # of partial gradients that the driver adds up itself; beyond it Spark does


@dataclass(frozen=True)
class Columns:
    """A view: some columns of the packed features."""
    at: tuple[int, ...]

    @property
    def width(self) -> int:
        return len(self.at)

    def make(self, x: np.ndarray) -> np.ndarray:
        return x[:, list(self.at)]


@dataclass(frozen=True)
class Fourier:
    """A view: random Fourier features for one gamma of rows packed with a ``Projection``."""
    gamma: float
    shift: tuple[float, ...]

    @property
    def width(self) -> int:
        return len(self.shift)

    def make(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.shift)) * np.cos(np.sqrt(2.0 * self.gamma) * x + np.array(self.shift))

    def doublings(self, angle_of: float) -> int | None:
        """How often the angles of a gamma double to this one's; None if they do not, or too often."""
        times = round(math.log(self.gamma / angle_of, 4)) if self.gamma > 0 and angle_of > 0 else -1
        return times if 0 <= times <= DOUBLINGS and angle_of * 4.0 ** times == self.gamma else None


@dataclass(frozen=True)
class Projection:
    """The random directions that all gammas share."""
    directions: np.ndarray
    shift: tuple[float, ...]

    @classmethod
    def draw(cls, dim: int, n_out: int, seed: int = 7) -> Projection:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((dim, n_out)), tuple(rng.uniform(0, 2 * np.pi, n_out).tolist()))

    def views(self, gammas: Sequence[float]) -> list[Fourier]:
        return [Fourier(float(g), self.shift) for g in gammas]


@dataclass(frozen=True)
class Point:
    """One model of a grid."""
    view: int
    loss: str                      # hinge, logistic, epsilon or squared
    C: float
    positive: float | None = None  # the class held against the rest; None for regression
    epsilon: float = 0.0
    without: int = -1              # fold that is left out


@dataclass(frozen=True)
class Blocks:
    frame: DataFrame   # n, x, y, fold as packed bytes
    views: tuple
    width: int
    n: int
    fold_rows: dict[int, int]
    parts: int         # partitions of the frame
    directions: np.ndarray | None = None  # of the projection of x

    def tasks(self, points: Sequence[Point]) -> int:
        """Tasks of a pass: few for few rows, more if the points make much work of them."""
        work = self.n * (sum(self.views[p.view].width for p in points) + VIEW_WORK * sum(self.views[v].width for v in {p.view for p in points}))
        return max(1, min(self.parts, max(-(-8 * self.n * self.width // TASK_BYTES), int(work / TASK_WORK))))

    def rows_of(self, p: Point) -> int:
        return self.n - self.fold_rows.get(p.without, 0)


def _read(batches: Iterator[pa.RecordBatch], directions: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y and folds of packed blocks, a few rows of a block at once."""
    for batch in batches:
        for n, x, y, fold in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            block = np.frombuffer(x).reshape(n, -1), np.frombuffer(y), np.frombuffer(fold, np.int32)
            for start in range(0, n, CACHE_ROWS):
                rows, *others = (a[start:start + CACHE_ROWS] for a in block)
                yield rows if directions is None else rows @ directions, *others


class Features:
    """The features of views (places in ``views``) for some rows after others, without new memory for each."""

    def __init__(self, views: Sequence, at: Iterable[int]) -> None:
        self.views = views
        self.plain: list[int] = []
        self.chains: list[list[int]] = []  # views whose angles are those of the first, doubled more and more often
        for v in sorted(at, key=lambda v: getattr(views[v], "gamma", 0.0)):
            chain = next((c for c in self.chains if self._follows(v, c[0])), None)
            if chain:
                chain.append(v)
            else:
                self.chains.append([v])
        self.plain = [c[0] for c in self.chains if len(c) == 1]
        self.chains = [c for c in self.chains if len(c) > 1]
        self.turns = {v: (np.sqrt(2.0 / views[v].width) * np.cos(views[v].shift), np.sqrt(2.0 / views[v].width) * np.sin(views[v].shift))
                      for c in self.chains for v in c}
        self.space = np.empty((4, 0, 0))

    def _follows(self, v: int, first: int) -> bool:
        a, b = self.views[v], self.views[first]
        return isinstance(a, Fourier) and isinstance(b, Fourier) and a.width == b.width and a.doublings(b.gamma) is not None

    def of(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each view with its features of the rows ``x``; these hold until the next is asked for."""
        for v in self.plain:
            yield v, self.views[v].make(x)
        if self.chains and self.space.shape[1:] != x.shape:
            self.space = np.empty((4, *x.shape))
        for chain in self.chains:
            cos, sin, z, spare = self.space
            gamma = self.views[chain[0]].gamma
            np.multiply(x, np.sqrt(2.0 * gamma), out=spare)
            np.cos(spare, out=cos)
            np.sin(spare, out=sin)
            for v in chain:
                for _ in range(self.views[v].doublings(gamma)):
                    np.multiply(sin, cos, out=spare)
                    np.multiply(sin, sin, out=cos)
                    cos *= -2.0
                    cos += 1.0
                    np.add(spare, spare, out=sin)
                gamma = self.views[v].gamma
                by_cos, by_sin = self.turns[v]
                np.multiply(cos, by_cos, out=z)
                np.multiply(sin, by_sin, out=spare)
                z -= spare
                yield v, z


def ranges(df: DataFrame, features: Column) -> tuple[list[float], list[float]]:
    """Least and largest value of each entry of an array column (empty lists for no rows)."""
    v = df.select(array_to_vector(features).alias("v"))
    # grouped, as a summary without a group fails on no rows
    r = v.groupBy(F.lit("all").alias("g")).agg(Summarizer.metrics("min", "max").summary(F.col("v")).alias("s")).select("s.*").first()
    return (r["min"].toArray().tolist(), r["max"].toArray().tolist()) if r is not None else ([], [])


def scaled(features: Column, lo: Sequence[float], hi: Sequence[float]) -> Column:
    """Entries mapped from [lo, hi] to [-1, 1]; constant ones become 0 (F12).  Without ranges (of no rows) they stay."""
    if not lo:
        return features
    pairs = F.array(*[F.array(F.lit((a + b) / 2), F.lit(2 / (b - a) if b > a else 0.0)) for a, b in zip(lo, hi, strict=True)])
    return F.zip_with(features, pairs, lambda x, p: (x - p[0]) * p[1])


@contextmanager
def packed(df: DataFrame, features: Column, label: str, views: Sequence | None = None, projection: Projection | None = None,
           fold: str | None = None) -> Iterator[Blocks]:
    """Blocks of ``df`` for fits and scores; ``features`` is an array column of one length, nulls are not allowed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if not len(batch):
                continue
            x = flat.reshape(len(batch), -1)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            f = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            at = range(0, len(x), BLOCK_ROWS)
            yield pa.RecordBatch.from_pylist([{"n": len(y[i:i + BLOCK_ROWS]), "x": np.ascontiguousarray(x[i:i + BLOCK_ROWS]).tobytes(),
                                               "y": y[i:i + BLOCK_ROWS].tobytes(), "fold": f[i:i + BLOCK_ROWS].tobytes()} for i in at],
                                             pa.schema([("n", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("fold", pa.binary())]))
    which = F.col(fold).cast("int") if fold else F.lit(-2)
    rows = df.select(features.cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), which.alias("fold"))
    frame = rows.mapInArrow(pack, "n int, x binary, y binary, fold binary").persist(StorageLevel.MEMORY_AND_DISK)
    even = frame
    try:
        def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, x, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    which, times = np.unique(np.frombuffer(f, np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(times), pa.array([len(x) // 8 // n] * len(which)),
                                                      pa.array([1] + [0] * (len(which) - 1))], ["fold", "rows", "width", "blocks"])
        got = (frame.select("n", "x", "fold").mapInArrow(folds, "fold int, rows long, width long, blocks long").groupBy("fold")
               .agg(F.sum("rows").alias("rows"), F.max("width").alias("width"), F.sum("blocks").alias("blocks")).collect())
        width = projection.directions.shape[1] if projection else max((r.width for r in got), default=0)
        n = sum(r.rows for r in got)
        parts = frame.rdd.getNumPartitions()
        most = min(sum(r.blocks for r in got), frame.sparkSession.sparkContext.defaultParallelism)
        if parts < most:  # few partitions, as of a small input: its blocks can still be dealt to all cores
            even, parts = frame.repartition(most).persist(StorageLevel.MEMORY_AND_DISK), most
        yield Blocks(even, tuple(views or [Columns(tuple(range(width)))]), width, n, {r.fold: r.rows for r in got}, max(parts, 1),
                     projection.directions if projection else None)
    finally:
        even.unpersist()
        frame.unpersist()


# ----------------------------------------------------------------- losses
def _smooth(a: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """max(a, 0), made quadratic on [0, delta]: value and slope."""
    slope = np.clip(a / delta, 0.0, 1.0)
    return slope * (a - slope * (delta / 2)), slope


def _losses(loss: str, of: np.ndarray, score: np.ndarray, y: np.ndarray, delta: float, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their slopes by the score, of points (all of one loss, ``of`` a column of their classes or epsilons) by rows.
    The memory of ``score`` and ``spare`` (two of its size) is used."""
    if loss in ("hinge", "logistic"):
        sign = np.where(y == of, 1.0, -1.0)
        if loss == "logistic":
            m = sign * score
            return np.logaddexp(0.0, -m), -sign * np.exp(-np.logaddexp(0.0, m))
        value, slope = _smooth(1.0 - sign * score, delta)
        return value, -sign * slope
    r = np.subtract(score, y, out=score)
    if loss == "squared":
        return r * r / 2, r
    slope, value = spare  # as _smooth of |r| - epsilon, with the sign of r
    np.clip(r, -of, of, out=slope)
    r -= slope
    np.divide(r, delta, out=slope)
    np.clip(slope, -1.0, 1.0, out=slope)
    np.multiply(slope, delta / 2, out=value)
    np.subtract(r, value, out=value)
    value *= slope
    return value, slope


def evaluate(blocks: Blocks, points: Sequence[Point], at: Sequence[np.ndarray], delta: float) -> list[tuple[float, np.ndarray]]:
    """(mean loss, its gradient) of each point at its coefficients (intercept last), in one pass."""
    by_view: dict[int, list[int]] = {}
    for i in sorted(range(len(points)), key=lambda i: points[i].loss):
        by_view.setdefault(points[i].view, []).append(i)
    runs: dict[int, list[tuple]] = {}  # of a view's points of one loss: places, classes or epsilons, folds left out
    for v, ids in by_view.items():
        cuts = [k for k in range(len(ids)) if not k or points[ids[k]].loss != points[ids[k - 1]].loss]
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            mine = [points[i] for i in ids[lo:hi]]
            of = np.array([[p.epsilon if p.positive is None else p.positive] for p in mine])
            without = np.array([[p.without if p.without >= 0 else -9] for p in mine]) if any(p.without >= 0 for p in mine) else None
            runs.setdefault(v, []).append((mine[0].loss, lo, hi, of, without))
    stacked = {v: np.stack([at[i] for i in ids]) for v, ids in by_view.items()}
    views, directions = blocks.views, blocks.directions

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((len(w), w.shape[1] + 1)) for v, w in stacked.items()}
        features = Features(views, by_view)
        space = np.empty((3, max(map(len, by_view.values())), CACHE_ROWS))
        for x, y, fold in _read(batches, directions):
            for v, z in features.of(x):
                mine = space[:, :len(by_view[v]), :len(x)]
                scores = np.matmul(stacked[v][:, :-1], z.T, out=mine[0])
                scores += stacked[v][:, -1:]
                for loss, lo, hi, of, without in runs[v]:
                    value, slope = _losses(loss, of, scores[lo:hi], y, delta, mine[1:, lo:hi])
                    if without is not None:
                        used = fold != without
                        value, slope = value * used, slope * used
                    total[v][lo:hi, 0] += value.sum(axis=1)
                    scores[lo:hi] = slope
                total[v][:, 1:-1] += scores @ z
                total[v][:, -1] += scores.sum(axis=1)
        for v, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["view", "part"])
    tasks = blocks.tasks(points)
    parts = blocks.frame.coalesce(tasks).mapInArrow(part, "view int, part binary")
    if tasks * sum(8 * w.size for w in stacked.values()) > DIRECT_BYTES:
        parts = _added(parts)
    sums: dict[int, np.ndarray] = {}
    for r in parts.collect():
        sums[r.view] = sums.get(r.view, 0) + np.frombuffer(r.part)
    out: list = [None] * len(points)
    for view, total in sums.items():
        t = total.reshape(len(by_view[view]), -1)
        for k, i in enumerate(by_view[view]):
            n = max(blocks.rows_of(points[i]), 1)
            out[i] = (t[k, 0] / n, t[k, 1:] / n)
    return [o if o is not None else (0.0, np.zeros(len(w))) for o, w in zip(out, at, strict=True)]


def _added(parts: DataFrame) -> DataFrame:
    """Partial sums added per view, in two steps over salted groups, so that no task reads all of them."""
    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in group:
            for view, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[view] = sums.get(view, 0) + np.frombuffer(part)
        for view, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([view], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["view", "part"])
    return parts.repartition(FAN_IN, F.rand(0)).mapInArrow(add, parts.schema)


# ------------------------------------------------------------- optimiser
def _lbfgs(w: np.ndarray, tolerance: float, most: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS with a backtracking line search; yields points, is sent (value, gradient), returns the best one."""
    f, g = yield w
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    used, flat = 1, 0
    while used < most and np.abs(g).max(initial=0.0) > tolerance and flat < 3:
        q, steps = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * s.dot(q)
            steps.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= s.dot(y) / y.dot(y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y, rho), a in zip(pairs, reversed(steps), strict=True):
            q += s * (a - rho * y.dot(q))
        slope = -q.dot(g)
        if slope >= 0:  # not a descent direction: start the memory anew
            pairs, q, slope = [], g / max(1.0, np.linalg.norm(g)), -g.dot(g) / max(1.0, np.linalg.norm(g))
        t = 1.0
        while used < most:
            trial = w - t * q
            f2, g2 = yield trial
            used += 1
            if f2 <= f + 1e-4 * t * slope:
                break
            t *= max(0.1, min(0.5, -slope * t / (2 * (f2 - f - slope * t)))) if np.isfinite(f2) else 0.1
            if t < 1e-12:
                return w
        else:
            return w
        s, y = trial - w, g2 - g
        if s.dot(y) > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs[-(MEMORY - 1):], (s, y, 1.0 / s.dot(y))]
        flat = flat + 1 if f - f2 <= FLAT * max(1.0, abs(f)) else 0
        w, f, g = trial, f2, g2
    return w


def fit(blocks: Blocks, points: Sequence[Point], tolerance: float = TOLERANCE, most: int = MAX_EVALUATIONS) -> list[np.ndarray]:
    """The coefficients (intercept last) of every point."""
    best = [np.zeros(blocks.views[p.view].width + 1) for p in points]
    rounds = DELTAS if any(p.loss in ("hinge", "epsilon") for p in points) else DELTAS[-1:]
    for delta in rounds:
        running = {i: _lbfgs(best[i], tolerance, most) for i in range(len(points))}
        asked = {i: next(run) for i, run in running.items()}
        while asked:
            ids = list(asked)
            got = evaluate(blocks, [points[i] for i in ids], [asked[i] for i in ids], delta)
            for i, (f, g) in zip(ids, got, strict=True):
                reg = 1.0 / (points[i].C * max(blocks.rows_of(points[i]), 1))
                w = asked[i].copy()
                w[-1] = 0.0
                try:
                    asked[i] = running[i].send((f + reg * w.dot(w) / 2, g + reg * w))
                except StopIteration as done:
                    best[i] = done.value
                    del asked[i]
    return best


# ---------------------------------------------------------------- results
@dataclass(frozen=True)
class Model:
    """What predicts together: one point, or one per class."""
    points: tuple[Point, ...]
    coefficients: tuple[np.ndarray, ...]
    classes: tuple[float, ...] = ()  # two: negative and positive one of a single point; more: one point each; none: regression

    def predict(self, z: np.ndarray) -> np.ndarray:
        scores = np.stack([z @ w[:-1] + w[-1] for w in self.coefficients], axis=1)
        if not self.classes:
            return scores[:, 0]
        if len(self.coefficients) == 1:
            return np.where(scores[:, 0] > 0, self.classes[1], self.classes[0])
        return np.array(self.classes)[scores.argmax(axis=1)]


def classifiers(blocks: Blocks, settings: Sequence[tuple[int, float, int]], classes: Sequence[float], loss: str = "hinge", **kw) -> list[Model]:
    """A classifier for each (view, C, fold left out or -1); three and more classes by one against the rest."""
    against = list(classes)[1:] if len(classes) == 2 else list(classes)
    points = [Point(v, loss, float(c), positive=k, without=f) for v, c, f in settings for k in against]
    found = fit(blocks, points, **kw)
    m = len(against)
    return [Model(tuple(points[i:i + m]), tuple(found[i:i + m]), tuple(classes)) for i in range(0, len(points), m)]


def scores(blocks: Blocks, models: Sequence[Model], only_left_out: bool = False) -> list[dict[str, float]]:
    """Per model over the blocks: n, accuracy, mse, r2 (squared correlation; None if constant), in one pass.
    ``only_left_out`` keeps, for models with a fold left out, the rows of that fold."""
    views, directions = blocks.views, blocks.directions
    single: dict[int, list[int]] = {}                            # by view: models that predict one by one
    together: dict[int, tuple[list[int], np.ndarray]] = {}       # by view: regressions over all rows, with their coefficients
    for i, m in enumerate(models):
        single.setdefault(m.points[0].view, []).append(i)
    for v, ids in single.items():
        plain = [i for i in ids if not models[i].classes and not (only_left_out and models[i].points[0].without >= 0)]
        if plain:
            together[v] = plain, np.stack([models[i].coefficients[0] for i in plain])
            single[v] = sorted({*ids} - {*plain})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 8))
        features = Features(views, single)
        for x, y, fold in _read(batches, directions):
            for v, z in features.of(x):
                for i in single[v]:
                    m = models[i]
                    p, t = m.predict(z), y
                    if only_left_out and m.points[0].without >= 0:
                        p, t = p[fold == m.points[0].without], t[fold == m.points[0].without]
                    total[i] += [len(t), (p == t).sum(), np.square(p - t).sum(), p.sum(), t.sum(), (p * p).sum(), (t * t).sum(), (p * t).sum()]
                if v in together:
                    ids, w = together[v]
                    p = w[:, :-1] @ z.T + w[:, -1:]
                    one = np.ones(len(ids))
                    total[ids] += np.stack([one * len(y), (p == y).sum(axis=1), np.square(p - y).sum(axis=1), p.sum(axis=1), one * y.sum(),
                                            (p * p).sum(axis=1), one * (y * y).sum(), (p * y).sum(axis=1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])
    parts = blocks.frame.mapInArrow(part, "i int, part array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("part")[k]).alias(f"s{k}") for k in range(8)]).collect()
    out: list[dict] = [{"n": 0, "accuracy": float("nan"), "mse": float("nan"), "r2": None} for _ in models]
    for r in sums:
        n, hits, se, sp, sy, spp, syy, spy = r[1:]
        if n:
            vp, vy = spp / n - (sp / n) ** 2, syy / n - (sy / n) ** 2
            r2 = (spy / n - sp * sy / n / n) ** 2 / (vp * vy) if vp > 1e-12 * max(spp / n, 1e-300) and vy > 0 else None
            out[r.i] = {"n": int(n), "accuracy": hits / n, "mse": se / n, "r2": r2}
    return out


def predictions(df: DataFrame, keys: Sequence[str], features: Column, views: Sequence, models: Sequence[tuple[str, Model]],
                label: str = "label") -> DataFrame:
    """One row per row of ``df`` and named model: keys, label, name, prediction."""
    schema = df.select(*keys, F.col(label).cast("double").alias(label)).schema
    n = len(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for name, m in models:
                p = m.predict(views[m.points[0].view].make(x))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], pa.array([name] * len(p)), pa.array(p)],
                                                 [*schema.names, "name", "prediction"])
    rows = df.select(*keys, F.col(label).cast("double").alias(label), features.cast("array<double>").alias("_x"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(work, f"{types}, name string, prediction double")
