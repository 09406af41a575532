"""Topic features.

Topic vectors are joined and moved whole; they are cut into components
``(key..., i, v)`` only where all vectors of a result row lie together, so the
sums by component need no shuffle of their own:

* W4/W5/F9 (indexed history): a sample's own and previous documents are one
  list, exploded, joined to the topics and placed by sample; today, the
  previous day and all (alpha, L) combinations are sums of *one* aggregation.
* W6/W8 (adjacent history in file order): each row sends its vector to the
  places ``pos + d`` that look back at it, uniformly spread, instead of a
  window partitioned by company (a company holding a third of the rows would
  otherwise be one task).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewire.functions.vectors import topic_normalize

# ---------------------------------------------------------------------------
# The reference's parameter grids.
HIST_ALPHAS = [1.0, 0.9, 0.8, 0.7, 0.6]     # indexed history weights
HIST_WINDOWS = [1, 3, 5, 10, 20]             # indexed history lengths
ADJ_DECAYS = [1.0, 0.9, 0.8, 0.7]            # adjacent history decays
ADJ_WINDOWS = [1, 2, 3, 4, 5, 6]             # adjacent history windows
# ---------------------------------------------------------------------------


def normalize_gamma(gamma: DataFrame) -> DataFrame:
    """L11 on a ``(k, doc_idx, alpha, gamma)`` table."""
    return gamma.select("k", "doc_idx", topic_normalize("gamma", "alpha").alias("topic"))


def topics_long(topics: DataFrame) -> DataFrame:
    """``(k, doc_idx, i, v)`` with 0-based component ``i``."""
    return topics.select("k", "doc_idx", F.posexplode("topic").alias("i", "v"))


def _param_tag(a: float, n: int, prefix: str) -> str:
    return f"{prefix}_{str(a).replace('.', 'p')}_{n}"


def _sample_components(samples: DataFrame, topics: DataFrame, key: Sequence[str], n_prev: int | None, zero_is_missing: bool) -> DataFrame:
    """``(key..., k, i, at, n, size, v)``: component ``i`` of the sample's own document (``at`` 0) and of the first ``n_prev``
    (None: all) of its ``n`` previous ones (``at`` 1, 2, ...), placed by sample.

    Whole vectors are joined, missing documents (-1) having gone before the join, and moved once to their sample; only
    there are they cut into components, so that sums by (key, k, i) need no further shuffle."""
    prev = F.col("prev_doc_idx") if n_prev is None else F.slice("prev_doc_idx", 1, n_prev)
    docs = F.posexplode(F.concat(F.array(F.col("doc_idx").cast("long")), prev.cast("array<long>"))).alias("at", "doc_idx")
    s = samples.select(*key, F.size("prev_doc_idx").alias("n"), docs)
    s = s.where((F.col("at") == 0) | (F.col("doc_idx") > (0 if zero_is_missing else -1)))
    j = s.join(topics.select("k", "doc_idx", "topic"), "doc_idx", "inner").repartition(*key, "k")
    return j.select(*key, "k", "at", "n", F.size("topic").alias("size"), F.posexplode("topic").alias("i", "v"))


def _today() -> Column:
    return F.max(F.when(F.col("at") == 0, F.col("v")))


def _size() -> Column:
    return F.max(F.when(F.col("at") == 0, F.col("size")))


def _prev() -> Column:
    return F.sum(F.when(F.col("at") == 1, F.col("v")).otherwise(0.0))


def _history_sums(alphas: Sequence[float], windows: Sequence[int], order: str) -> list[Column]:
    """One sum per (alpha, L): components weighted by ``alpha^(w + 1)`` for places ``w < L`` of the history as read."""
    w = (F.col("n") - F.col("at")) if order == "as_read" else (F.col("at") - 1)
    return [F.sum(F.when((F.col("at") > 0) & (w < L), F.pow(F.lit(float(a)), w + 1) * F.col("v")).otherwise(0.0))
            .alias(_param_tag(a, L, "h")) for a in alphas for L in windows]


def topic_change_prev(samples: DataFrame, topics: DataFrame, key: Sequence[str],
                      zero_is_missing: bool = True) -> DataFrame:
    """``(key..., k, i, today, prev, change)``; ``change = today - prev``.

    ``prev`` is the topic of the previous trading day's document
    (``prev_doc_idx[0]``) and 0 when there is none (or it is document 0, as
    in the reference, unless ``zero_is_missing=False``).  Samples whose own
    document has no topic vector are dropped.  ``key`` identifies a sample.
    """
    c = _sample_components(samples, topics, key, 1, zero_is_missing)
    g = c.groupBy(*key, "k", "i").agg(_today().alias("today"), _prev().alias("prev")).where(F.col("today").isNotNull())
    return g.select(*key, "k", "i", "today", "prev", (F.col("today") - F.col("prev")).alias("change"))


def topic_hist_indexed(samples: DataFrame, topics: DataFrame, key: Sequence[str],
                       alphas: Sequence[float] = HIST_ALPHAS, windows: Sequence[int] = HIST_WINDOWS,
                       order: str = "as_read", zero_is_missing: bool = True) -> DataFrame:
    """``(key..., k, alpha, L, i, hist)`` for every (alpha, L) at once.

    ``hist = sum_{w < L} alpha^(w+1) * topic(doc_w)`` where ``doc_w`` is the
    w-th document of the history list as read.  ``order='as_read'`` keeps the
    reference's reading (farthest day first, Q1); ``'nearest_first'`` starts
    at yesterday.  A missing document is skipped but its weight still
    advances.  Samples without any history document get zero vectors.
    """
    c = _sample_components(samples, topics, key, None, zero_is_missing)
    g = c.groupBy(*key, "k", "i").agg(_today().alias("_t"), *_history_sums(alphas, windows, order)).where(F.col("_t").isNotNull())
    grid = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(L).alias("L"), F.col(_param_tag(a, L, "h")).alias("hist"))
                     for a in alphas for L in windows])
    return g.select(*key, "k", "i", F.inline(grid))


def _adjacent(rows: DataFrame, decays: Sequence[float], windows: Sequence[int]) -> DataFrame:
    """``(pos, company, i, today, _k, sums...)``: each row goes as a whole vector to the places ``pos + d`` that look back
    at it; there the rows of the place's own company are summed.  A company holding most rows is spread by place.

    The vectors of a place and company are gathered by distance (seven arrays, whatever the length) and cut into components
    last, so that no sum is kept by component."""
    most = max(windows)
    sent = rows.select("company", "topic", F.col("pos").alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("d"))
    at = sent.select((F.col("_from") + F.col("d")).alias("pos"), "company", "d", "topic").repartition("pos")
    g = at.groupBy("pos", "company").agg(*[F.collect_list(F.when(F.col("d") == d, F.col("topic"))).alias(f"_l{d}") for d in range(most + 1)])
    g = g.where(F.size("_l0") > 0)
    nothing = F.array().cast("array<double>")

    def one(vectors: str, merge) -> Column:
        """The vectors of one distance as one: nearly always there is one."""
        first, rest = F.get(vectors, F.lit(0)), F.slice(vectors, F.lit(2), F.size(vectors))
        many = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, merge))
        return F.when(F.size(vectors) > 1, many).otherwise(F.coalesce(first, nothing))
    largest = one("_l0", lambda a, b: F.greatest(a, b))
    added = [one(f"_l{d}", lambda a, b: F.coalesce(a + b, a, b)).alias(f"_v{d}") for d in range(1, most + 1)]
    size = F.transform("_l0", lambda v: F.size(v))
    # today's vector is the largest value of each place, and _k the size of the longest vector that has the place
    g = g.select("pos", "company", largest.alias("_v0"), F.array_max(size).alias("_k"), *added)
    cells = F.arrays_zip("_v0", *[f"_v{d}" for d in range(1, most + 1)])
    # outer, and filtered after: a plain generator would have its arrays copied into a filter
    c = g.select("pos", "company", "_k", F.posexplode_outer(cells).alias("i", "c")).where(F.col("c._v0").isNotNull())
    back = [F.when(F.col("company").isNotNull(), F.coalesce(F.col(f"c._v{d}"), F.lit(0.0))).otherwise(0.0).alias(f"_v{d}") for d in range(1, most + 1)]
    c = c.select("pos", "company", "i", F.col("c._v0").alias("today"), "_k", *back)
    sums = [sum((F.lit(float(dc) ** d) * F.col(f"_v{d}") for d in range(1, w + 1)), F.lit(0.0)).alias(_param_tag(dc, w, "a"))
            for dc in decays for w in windows]
    return c.select("pos", "company", "i", "today", "_k", *sums)


def topic_hist_adjacent(rows: DataFrame, decays: Sequence[float] = ADJ_DECAYS,
                        windows: Sequence[int] = ADJ_WINDOWS) -> DataFrame:
    """``(pos, company, decay, w, i, hist)``: sum of ``decay^d * topic(pos - d)``
    over ``d = 1..w`` for rows of the same company; a row of another company
    in between still counts towards the distance.

    ``rows`` is ``(pos, company, topic)`` with a dense ``pos`` (file order), one row each.
    """
    grid = F.array(*[F.struct(F.lit(float(dc)).alias("decay"), F.lit(w).alias("w"), F.col(_param_tag(dc, w, "a")).alias("hist"))
                     for dc in decays for w in windows])
    return _adjacent(rows, decays, windows).select("pos", "company", "i", F.inline(grid))


def topic_change_adjacent(rows: DataFrame) -> DataFrame:
    """``(pos, company, i, change)``: topic minus the previous row's, only when
    the previous row (``pos - 1``) is of the same company; other rows yield none.

    (The reference subtracts into an aliased row, which compounds the
    differences; the plain difference is computed here, see SURVEY Q2.)
    """
    prev = rows.select((F.col("pos") + 1).alias("pos"), "company", F.col("topic").alias("_before"))
    j = rows.select("pos", "company", "topic").join(prev, ["pos", "company"], "inner")
    return j.select("pos", "company", F.posexplode(F.zip_with("topic", "_before", lambda v, p: v - p)).alias("i", "change"))


def hist_features(rows: DataFrame, decays: Sequence[float] = ADJ_DECAYS,
                  windows: Sequence[int] = ADJ_WINDOWS) -> DataFrame:
    """W8 + L13: ``(pos, decay, w, variant, j, value)`` with variants ``add``
    (today + history, k values) and ``cont`` (today then history, 2k values)."""
    i, today = F.col("i"), F.col("today")
    grid = []
    for dc in decays:
        for w in windows:
            h = F.col(_param_tag(dc, w, "a"))
            for variant, j, value in (("add", i, today + h), ("cont", i, today), ("cont", i + F.col("_k"), h)):
                grid.append(F.struct(F.lit(float(dc)).alias("decay"), F.lit(w).alias("w"), F.lit(variant).alias("variant"),
                                     j.alias("j"), value.alias("value")))
    return _adjacent(rows, decays, windows).select("pos", F.inline(F.array(*grid)))


def topic_features(samples: DataFrame, topics: DataFrame, key: Sequence[str], alphas: Sequence[float] = HIST_ALPHAS,
                   windows: Sequence[int] = HIST_WINDOWS, order: str = "as_read", zero_is_missing: bool = True) -> DataFrame:
    """F9 + L13: ``(key..., k, variant, alpha, L, j, value)`` for the seven topic feature sets.

    Sets with history come once per (alpha, L), the others once with NULL there.  Concatenations are laid out block
    after block.  Today, change and every history come from one pass over the sample's vectors.
    """
    c = _sample_components(samples, topics, key, None, zero_is_missing)
    c = c.groupBy(*key, "k", "i").agg(_today().alias("today"), _prev().alias("_p"), _size().alias("_k"), *_history_sums(alphas, windows, order))
    c = c.where(F.col("today").isNotNull())
    today, chg, kcol, zero = F.col("today"), F.col("today") - F.col("_p"), F.col("_k"), F.lit(0)
    none = (F.lit(None).cast("double"), F.lit(None).cast("int"))
    blocks = [("today", zero, today, none), ("change", zero, chg, none),
              ("change+today", zero, chg, none), ("change+today", kcol, today, none)]
    for a in alphas:
        for L in windows:
            hs, at = F.col(_param_tag(a, L, "h")), (F.lit(float(a)), F.lit(L))
            blocks += [("today+hist", zero, today + hs, at),
                       ("today|hist", zero, today, at), ("today|hist", kcol, hs, at),
                       ("change|today+hist", zero, chg, at), ("change|today+hist", kcol, today + hs, at),
                       ("change|today|hist", zero, chg, at), ("change|today|hist", kcol, today, at),
                       ("change|today|hist", kcol * 2, hs, at)]
    arr = F.array(*[F.struct(F.lit(v).alias("variant"), at[0].alias("alpha"), at[1].alias("L"), off.cast("int").alias("off"),
                             val.alias("value")) for v, off, val, at in blocks])
    out = c.select(*key, "k", "i", F.inline(arr))
    return out.select(*key, "k", "variant", "alpha", "L", (F.col("i") + F.col("off")).alias("j"), "value")


def topic_libsvm(labelled: DataFrame, topics: DataFrame, label_col: str = "label",
                 digits: int = 6) -> DataFrame:
    """``(doc_idx, line)`` LIBSVM line ``label 1:v1 2:v2 ...`` (indices from 1)."""
    j = labelled.select("doc_idx", label_col).join(topics.select("doc_idx", "topic"), "doc_idx", "inner")
    fmt = f"%.{digits}f"
    pairs = F.transform("topic", lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"),
                                                        F.format_string(fmt, v)))
    return j.select("doc_idx", F.concat(F.col(label_col).cast("string"), F.lit(" "),
                                        F.array_join(pairs, " ")).alias("line"))
