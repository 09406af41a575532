"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

``source_targets`` gives each source its share of the words, stopping at ``cap`` times its size and resharing
the excess by weight (water filling in closed form).  Every document of a source then has the same wanted number
of copies f = target / source size.  Its whole part is taken outright; the fractions are rounded by
duels.  Two documents i and j trade words so that their common mass size_i*p_i + size_j*p_j stays the same until one
fraction is 0 or 1; the direction is drawn so that no fraction changes on average.  Duels run in a
reduction tree: ``fan`` documents of a source settle among themselves inside one row, the one left
fractional goes up to the next level.  A source's taken words thus equal its target, but for the last
document, which is rounded to the nearer side (an error of half its size at most).

Draws hash the seed and the places of the two documents in an exact rank per source, so reruns agree.

Defined cases: null text has size 0 and is taken 0 times; the null source is a source of its own, sorted last;
a source of size 0 has target 0; an empty table gives an empty result; repeated rows are mixed separately.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import global_rank, n_words, packed_row, saved, text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
FAN = 32
SEED = 7


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) -> (source, src, source_size, target): one row per source, null included and last."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    per = per.withColumn("src", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    per = per.withColumn("_w", w).withColumn("_full", F.col("source_size") * F.lit(cap))
    by = Window.orderBy(F.col("_full") / F.col("_w"), "src")
    upto, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    want = F.sum("source_size").over(every) * F.lit(share)
    # Sources fill up in the order of size per weight; one is full if the level left by those before reaches it.
    level = ((want - F.coalesce(F.sum("_full").over(upto), F.lit(0.0)))
             / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))))
    per = per.withColumn("_want", want).withColumn("_isfull", F.col("_full") / F.col("_w") <= level)
    rest = ((F.col("_want") - F.sum(F.when(F.col("_isfull"), F.col("_full")).otherwise(0.0)).over(every))
            / F.sum(F.when(F.col("_isfull"), 0.0).otherwise(F.col("_w"))).over(every))
    return per.select("source", "src", "source_size",
                      F.when(F.col("_isfull"), F.col("_full")).otherwise(F.col("_w") * rest).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


_UNIT = "struct<place:bigint,doc_id:bigint,tkey:bigint,size:bigint,base:bigint,p:double,one:boolean>"


def _unit(u: Column, p: Column, one: Column) -> Column:
    return F.struct(u["place"].alias("place"), u["doc_id"].alias("doc_id"), u["tkey"].alias("tkey"),
                    u["size"].alias("size"), u["base"].alias("base"), p.alias("p"), one.alias("one"))


def _duel(acc: Column, new: Column, seed: int) -> Column:
    """acc.left meets ``new``: the loser of the draw is settled (appended), the other stays fractional."""
    i = acc["left"]
    si, sj, pi, pj = i["size"].cast("double"), new["size"].cast("double"), i["p"], new["p"]
    up, down = F.least((1 - pi) * si, pj * sj), F.least(pi * si, (1 - pj) * sj)  # words to i, words to j
    to_i = _uniform(F.lit(seed), i["place"], new["place"]) * (up + down) < down
    no = F.lit(False)
    # (settled document, fractional document) of the four outcomes
    fills_i = F.struct(_unit(i, F.lit(1.0), F.lit(True)).alias("done"), _unit(new, pj - up / sj, no).alias("left"))
    empties_j = F.struct(_unit(new, F.lit(0.0), no).alias("done"), _unit(i, pi + up / si, no).alias("left"))
    empties_i = F.struct(_unit(i, F.lit(0.0), no).alias("done"), _unit(new, pj + down / sj, no).alias("left"))
    fills_j = F.struct(_unit(new, F.lit(1.0), F.lit(True)).alias("done"), _unit(i, pi - down / si, no).alias("left"))
    out = (F.when(to_i, F.when((1 - pi) * si <= pj * sj, fills_i).otherwise(empties_j))
           .otherwise(F.when(pi * si <= (1 - pj) * sj, empties_i).otherwise(fills_j)))
    return F.transform(F.array(out), lambda o: F.struct(
        o["left"].alias("left"), F.concat(acc["done"], F.array(o["done"])).alias("done")))[0]


def pivotal_rounding(units: DataFrame, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """units(src, place, doc_id, tkey, size > 0, base, p) -> the same rows with ``copies`` = base + 0 or 1.

    ``place`` is 0..n-1 in each src; a level groups ``fan`` neighbours by place div fan, so groups have a fixed
    size whatever the size of a source, and only the residuals go up.
    """
    level = units.select("src", F.col("place").alias("at"), F.struct(
        "place", "doc_id", "tkey", "size", "base", "p", F.lit(False).alias("one")).cast(_UNIT).alias("u"))
    most = units.agg(F.max("place")).first()[0]
    settled = []
    while most is not None:
        row = F.array_sort(F.collect_list(F.struct("at", "u")))
        met = level.groupBy("src", F.expr(f"at div {fan}L").alias("at")).agg(row.alias("row"))
        first = F.struct(F.col("row")[0]["u"].alias("left"), F.array().cast(f"array<{_UNIT}>").alias("done"))
        state = F.aggregate(F.slice("row", 2, fan), first, lambda a, x: _duel(a, x["u"], seed))
        level = saved(met.select("src", "at", state.alias("s")))
        settled.append(level.select("src", F.explode("s.done").alias("u")))
        level, last = level.select("src", "at", F.col("s.left").alias("u")), most < fan
        if last:
            settled.append(level.select("src", F.col("u").withField("one", F.col("u.p") >= 0.5).alias("u")))
            break
        most //= fan
    if not settled:
        return units.withColumn("copies", F.col("base"))
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    return done.select("src", "u.place", "u.doc_id", "u.tkey", "u.size",
                       (F.col("u.base") + F.col("u.one").cast("long")).alias("copies"))


def pivotal_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, tkey (key of its text)."""
    rows = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                             n_words(text_col).alias("size"), text_key(text_col).alias("tkey")))
    targets = saved(source_targets(rows, weights, share, cap))
    same = F.col("r.source").eqNullSafe(F.col("t.source"))
    rows = rows.alias("r").join(targets.alias("t"), same).select("doc_id", "tkey", "size", "src", "source_size", "target")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(f).cast("long")).withColumn("p", f - F.floor(f))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "tkey", F.lit(seed)))
    rows = saved(rows)
    split = rows.filter((F.col("size") > 0) & (F.col("p") > 0))
    whole = rows.filter((F.col("size") == 0) | (F.col("p") == 0))
    places = saved(global_rank(split, "_h", ["_h", "doc_id", "tkey"], out="place", within="src"))
    rounded = pivotal_rounding(places.select("src", "place", "doc_id", "tkey", "size", "base", "p"), fan, seed)
    per = targets.select("src", "source_size", "target")
    out = (rounded.select("src", "doc_id", "tkey", "size", "copies").unionByName(
        whole.select("src", "doc_id", "tkey", "size", F.when(F.col("size") > 0, F.col("base")).otherwise(0)
                     .cast("long").alias("copies"))).join(per, "src"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                      "copies", "tkey")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (rows taken 0 times are left out).

    Rows equal in id and text get their copies in turn, so every row of the mix is used once.
    """
    taken = pivotal_mix(docs, id_col, text_col, source_col, **options)
    by = Window.partitionBy("_id", "_key").orderBy(F.desc("_copies"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key"), F.col("copies").alias("_copies"))
    taken = taken.withColumn("_nth", F.row_number().over(by)).filter("_copies > 0")
    rows = packed_row(docs, F.col(id_col).cast("long").alias("_id"), text_key(text_col).alias("_key"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_key").orderBy(F.xxhash64("_row"))))
    on = F.col("r._id").eqNullSafe(F.col("t._id")) & (F.col("r._key") == F.col("t._key")) & (F.col("r._nth") == F.col("t._nth"))
    both = rows.alias("r").join(taken.alias("t"), on)
    return both.select("r._row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
