"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct ``k``-word shingles (64-bit hashes), in the global order of the hashes.  The order
is cut into fragments; a document's set is cut with it into segments, one per fragment, and each fragment is
counted on its own:

1. Equal sets form a class; only one document of a class goes on.
2. Partial counts per fragment of the shingles that a document shares with any other, summed per document, over the first
   n - need + l shingles of each set: two sets that link share at least l of them (prefix principle), so documents with
   fewer shared ones link with nothing.  The sets of the rest are built again and counted whole: a document must share
   ``need`` = ceil(t n) shingles.  The counts also give each shingle's frequency.
3. Pairs come from the rarest n - need + 1 shingles of each set, with length, position and shared-count bounds.  First
   each posting list is paired with its most central document only (a star, so a group of m near copies gives about m
   pairs); then, once linked documents are joined, the pairs of different components that still share such a shingle.  No
   pair that could add a link between components is left out.
4. Partial overlaps of a pair are counted per fragment and summed; 100 * common >= percent * union links it.

Components of the links (distributed connected components) give each class its smallest doc_id.

Defined cases: null or empty text has an empty set and links with nothing; fewer than k words make one shingle;
rows with equal id and text are one class; a null doc_id takes part but is never a component's smallest id unless all
are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import packed_row, saved, small, text_key
from pricewire.llm.graph import connected_components

FRAGMENTS = 64          # at least; more when a fragment would hold over FRAGMENT_TOKENS shingles
FRAGMENT_TOKENS = 2_000_000
WORD_CACHE = 1 << 19    # word hashes that a task remembers
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
    return np.unique(out)


def need(n, percent: int):
    """Least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def spare(n, percent: int):
    """l of the prefix principle for a set of n."""
    return -(-(100 - percent) * n // 100)


def _need(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _sets_udf(k: int, percent: int, whole: bool):
    kind = "struct<n:bigint,a:bigint,b:bigint,toks:binary>"

    @F.pandas_udf(kind)
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash
        words = _WordHashes()
        for batch in texts:
            rows = []
            for text in batch:
                s = shingles(text, k, words)
                n = len(s)
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                part = s if whole else s[:n - need(n, percent) + spare(n, percent)]
                rows.append((n, a, b, part.tobytes()))
            yield pd.DataFrame(rows, columns=["n", "a", "b", "toks"])
    return sets


def _packed(sets: DataFrame, fragments: int) -> DataFrame:
    """sets(a, toks) -> one row per batch and fragment: (frag, toks, owners), so no row per shingle is shuffled."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parts = [np.frombuffer(x, np.uint64) for x in batch["toks"]]
            toks = np.concatenate(parts)
            owners = np.repeat(batch["a"].to_numpy(np.int64), [len(p) for p in parts])
            frag = ((toks >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(frag, kind="stable")
            toks, owners, frag = toks[order], owners[order], frag[order]
            cuts = np.flatnonzero(np.diff(frag)) + 1
            for t, o, f in zip(np.split(toks, cuts), np.split(owners, cuts), np.split(frag, cuts), strict=True):
                if len(f):
                    yield pd.DataFrame({"frag": [int(f[0])], "toks": [t.tobytes()], "owners": [o.tobytes()]})
    return sets.select("a", "toks").mapInPandas(pack, "frag int, toks binary, owners binary")


def _shared(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, owner, frequency) of a fragment's shingles that two or more sets have; sorted by owner."""
    toks = np.concatenate([np.frombuffer(x, np.uint64) for x in group["toks"]])
    owners = np.concatenate([np.frombuffer(x, np.int64) for x in group["owners"]])
    order = np.lexsort((owners, toks))
    toks, owners = toks[order], owners[order]
    fresh = np.ones(len(toks), bool)  # the classes' copies count once
    fresh[1:] = (toks[1:] != toks[:-1]) | (owners[1:] != owners[:-1])
    toks, owners = toks[fresh], owners[fresh]
    at = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1])))
    times = np.diff(np.concatenate((at, [len(toks)])))
    freq = np.repeat(times, times)
    keep = freq > 1
    toks, owners, freq = toks[keep], owners[keep], freq[keep]
    order = np.argsort(owners, kind="stable")
    return toks[order], owners[order], freq[order]


def _fragments(n_tokens: int) -> int:
    return max(FRAGMENTS, -(-n_tokens // FRAGMENT_TOKENS))


def shared_counts(sets: DataFrame, fragments: int) -> DataFrame:
    """(a, shared): partial counts per fragment, summed per set."""
    def count(group: pd.DataFrame) -> pd.DataFrame:
        a, n = np.unique(_shared(group)[1], return_counts=True)
        return pd.DataFrame({"a": a, "shared": n})
    parts = _packed(sets, fragments).groupBy("frag").applyInPandas(count, "a long, shared long")
    return parts.groupBy("a").agg(F.sum("shared").alias("shared"))


def segments(sets: DataFrame, fragments: int) -> DataFrame:
    """(a, frag, toks, freqs): the shared shingles of each set, cut by fragment."""
    def cut(group: pd.DataFrame) -> pd.DataFrame:
        toks, owners, freq = _shared(group)
        cuts = np.flatnonzero(np.diff(owners)) + 1
        rows = [(int(o[0]), int(group["frag"].iloc[0]), t.view(np.int64), f) for t, o, f in zip(
            np.split(toks, cuts), np.split(owners, cuts), np.split(freq, cuts), strict=True) if len(o)]
        return pd.DataFrame(rows, columns=["a", "frag", "toks", "freqs"])
    return _packed(sets, fragments).groupBy("frag").applyInPandas(
        cut, "a long, frag int, toks array<long>, freqs array<long>")


def _linked(common: Column, nx: Column, ny: Column, percent: int) -> Column:
    return common * 100 >= (nx + ny - common) * percent


def links(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """pairs(x, y, nx, ny) -> the linked ones (u, v): partial overlaps per fragment, summed per pair."""
    one = segs.select(F.col("a").alias("x"), "frag", F.col("toks").alias("tx"))
    two = segs.select(F.col("a").alias("y"), "frag", F.col("toks").alias("ty"))
    met = pairs.join(one, "x").join(two, ["y", "frag"])
    part = met.select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).cast("long").alias("part"))
    total = part.groupBy("x", "y", "nx", "ny").agg(F.sum("part").alias("common"))
    return total.filter(_linked(F.col("common"), F.col("nx"), F.col("ny"), percent)).select(
        F.col("x").alias("u"), F.col("y").alias("v"))


def _possible(p: str, q: str, percent: int) -> Column:
    """Length, shared-count and position bounds of two postings of one shingle (it may be their first common one)."""
    def c(side, name):
        return F.col(f"{side}.{name}")
    least = F.floor((F.lit(percent) * (c(p, "n") + c(q, "n")) + 99 + percent) / F.lit(100 + percent))
    length = F.least(c(p, "n"), c(q, "n")) * 100 >= F.greatest(c(p, "n"), c(q, "n")) * percent
    return (length & (F.least(c(p, "shared"), c(q, "shared")) >= least)
            & (F.least(c(p, "n") - c(p, "pos"), c(q, "n") - c(q, "pos")) >= least))


def _ordered(pairs: DataFrame) -> DataFrame:
    """(p, q) structs -> distinct (x, y, nx, ny) with x < y."""
    first = F.col("p.a") < F.col("q.a")
    return pairs.select(F.when(first, F.col("p.a")).otherwise(F.col("q.a")).alias("x"),
                        F.when(first, F.col("q.a")).otherwise(F.col("p.a")).alias("y"),
                        F.when(first, F.col("p.n")).otherwise(F.col("q.n")).alias("nx"),
                        F.when(first, F.col("q.n")).otherwise(F.col("p.n")).alias("ny")).distinct()


def set_links(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """sets(a, n, toks: whole) of distinct sets -> links (u, v) that join every component (not every pair inside one)."""
    sizes = sets.select("a", "n").distinct()
    segs = saved(segments(sets, fragments))
    able = segs.groupBy("a").agg(F.sum(F.size("toks")).alias("shared")).join(sizes, "a")
    able = saved(able.filter(F.col("shared") >= _need(F.col("n"), percent)))
    segs = saved(segs.join(small(able.select("a")), "a", "left_semi"))
    # Rarest first; the n - shared shingles that nobody shares come before all others.
    rare = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("freqs", "toks")))), F.lit(1),
                   (F.first("shared") - _need(F.first("n"), percent) + 1).cast("int"))
    post = (segs.join(able, "a").groupBy("a").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), rare.alias("r"))
            .select("a", "n", "shared", F.posexplode("r").alias("i", "r"))
            .select(F.col("r.toks").alias("tok"), F.struct("a", "n", "shared",
                                                           (F.col("n") - F.col("shared") + F.col("i")).alias("pos")).alias("q")))
    post = saved(post)
    central = post.groupBy("tok").agg(F.min(F.struct(F.expr("q.n - q.shared").alias("own"), F.col("q"))).alias("m"),
                                      F.count(F.lit(1)).alias("times")).filter("times > 1")
    star = post.join(central.select("tok", F.col("m.q").alias("p")), "tok").filter(F.col("p.a") != F.col("q.a"))
    tried = saved(_ordered(star.filter(_possible("p", "q", percent))))
    found = saved(links(tried, segs, percent))
    comp = connected_components(found)
    named = post.withColumn("a", F.col("q.a")).join(comp.withColumnRenamed("node", "a"), "a", "left").select(
        "tok", "q", F.coalesce("component", "a").alias("c"))
    open_ = named.groupBy("tok").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("tok")
    rest = saved(named.join(open_, "tok", "left_semi"))
    two = rest.select("tok", F.col("q").alias("p"), F.col("c").alias("cp")).join(rest, "tok").filter(
        (F.col("p.a") < F.col("q.a")) & (F.col("cp") != F.col("c")) & _possible("p", "q", percent))
    more = _ordered(two).join(tried.select("x", "y"), ["x", "y"], "left_anti")
    return found.unionByName(links(saved(more), segs, percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, label (of the component; null for empty sets), tkey."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       text_key(text_col).alias("tkey"))
    first = saved(base.select("doc_id", "tkey", _sets_udf(k, percent, False)("text").alias("s"))
                  .select("doc_id", "tkey", "s.*"))
    full = first.filter("n > 0")
    classes = saved(full.groupBy("a", "b").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("doc_id").alias("low"),
                                               F.first("n").alias("n")))
    total = full.agg(F.sum(F.length("toks") / 8)).first()[0] or 0
    shared = shared_counts(full, _fragments(int(total)))
    l_least = F.floor((_need(F.col("n"), percent) * (100 - percent) + 99) / 100)
    able = saved(classes.join(shared, "a").filter(F.col("shared") >= l_least)
                 .select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.tkey").alias("tkey"), "n"))
    one = small(able.select("doc_id", "tkey"))
    again = base.alias("d").join(one.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id"))
                                 & (F.col("d.tkey") == F.col("o.tkey")), "left_semi")
    whole = again.select(_sets_udf(k, percent, True)("text").alias("s")).select("s.n", "s.a", "s.toks")
    tokens = able.agg(F.sum("n")).first()[0] or 0
    edges = saved(set_links(saved(whole), percent, _fragments(int(tokens))))
    comp = connected_components(edges).withColumnRenamed("node", "a")
    named = classes.join(comp, "a", "left").withColumn("label", F.coalesce("component", "a"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_class = named.join(lows, "label").select("a", "b", "label", "component_id")
    out = first.drop("toks").join(of_class, ["a", "b"], "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(~empty, F.col("label")).alias("label"), "tkey")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each component the smallest doc_id (nulls last)."""
    rows = saved(near_duplicates(docs, k, percent, id_col, text_col))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    best = rows.filter("label is not null").groupBy("label").agg(F.min(key).alias("best"))
    gone = (rows.join(best, "label").filter(~key.eqNullSafe(F.col("best")))
            .select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct())
    gone = small(saved(gone))
    wide = packed_row(docs, F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"))
    left = wide.alias("d").join(gone.alias("g"), F.col("d._id").eqNullSafe(F.col("g._id"))
                                & (F.col("d._key") == F.col("g._key")), "left_anti")
    repeats = rows.filter("label is not null").groupBy("doc_id", "tkey").count().filter("count > 1")
    if repeats.isEmpty():
        return left.select("_row.*")
    nth = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.xxhash64("_row")))
    empty = F.regexp_count(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) == 0
    return left.withColumn("_nth", nth).filter((F.col("_nth") == 1) | empty).select("_row.*")
