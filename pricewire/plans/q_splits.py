"""Split and sampling queries over the ``labels`` table (one row per labelled document)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.operators import labels as LB
from pricewire.operators import splits as O
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.sources import tables as T

SEED = 7
SPLIT_DATE = "2024-01-20"
PERC_VAL = 0.15
K = 5


def dataset(spark, sf_dir):
    """``(row_idx, date, label, label3)``: labelled documents dated by the corpus rule."""
    lab = T.class_labels(spark, sf_dir)
    return lab.select(F.col("doc_idx").alias("row_idx"), T.corpus_day(F.col("doc_idx")).alias("date"),
                      F.col("quality").alias("label"), "label3")


def dated_split(spark, sf_dir):
    return O.split_by_date(dataset(spark, sf_dir), SPLIT_DATE, PERC_VAL, SEED)


def _key(seed=SEED, col="row_idx"):
    return f"md5(CAST({col} AS VARCHAR) || ':{seed}')"


DS = f"""ds AS (
  SELECT doc_id AS row_idx,
         DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} AS INTEGER) AS date,
         quality AS label, quality - toxic AS label3 FROM labels)"""

SPLIT = f"""sp AS (
  SELECT row_idx, date, label, label3,
         CASE WHEN NOT tr THEN 1 WHEN rk < floor(n * {PERC_VAL}) THEN 2 ELSE 0 END AS split
  FROM (SELECT *, date <= DATE '{SPLIT_DATE}' AS tr,
               row_number() OVER (PARTITION BY date <= DATE '{SPLIT_DATE}' ORDER BY {_key()}, row_idx) - 1 AS rk,
               count(*) OVER (PARTITION BY date <= DATE '{SPLIT_DATE}') AS n FROM ds))"""


def _oversample_sql(src_tbl, label, seed, part=None, classes=None, target=None):
    """SQL twin of ``operators.splits.oversample`` (partition column optional)."""
    p = part or "1"
    pj = f"s.{part} = t.{part} AND " if part else ""
    pcol = f"{part}, " if part else ""
    cls_filter = f" AND s.{label} IN ({', '.join(map(str, classes))})" if classes else ""
    if target is None:
        tgt = f"""tgt AS (SELECT {pcol}min({label}) AS src, max(n) AS target
               FROM (SELECT *, max(n) OVER (PARTITION BY {p}) AS mx FROM sizes) WHERE n = mx GROUP BY ALL)"""
    else:
        tgt = f"tgt AS (SELECT {pcol}{label} AS src, n AS target FROM sizes WHERE {label} = {target})"
    rj = f"rk.{part} = n.{part} AND " if part else ""
    rj2 = f"rk.{part} = p.{part} AND " if part else ""
    return f"""sizes AS (SELECT {pcol}{label}, count(*) AS n FROM {src_tbl} GROUP BY ALL),
{tgt},
need AS (SELECT {'s.' + part + ', ' if part else ''}s.{label} AS cls, s.n AS ncls, t.target - s.n AS deficit, t.src
         FROM sizes s JOIN tgt t ON {pj}true WHERE t.target - s.n > 0{cls_filter}),
rk AS (SELECT *, row_number() OVER (PARTITION BY {pcol}{label} ORDER BY {_key(seed)}, row_idx) - 1 AS r FROM {src_tbl}),
draws AS (SELECT {'n.' + part + ', ' if part else ''}n.cls, n.ncls, rk.r - n.ncls AS draw
          FROM rk JOIN need n ON {rj}rk.{label} = n.src WHERE rk.r >= n.ncls AND rk.r < n.ncls + n.deficit),
picks AS (SELECT *, {S.md5_long(f"md5(CAST(draw AS VARCHAR) || ':{seed}:' || CAST(cls AS VARCHAR))")} % ncls AS pick
          FROM draws),
drawn AS (SELECT rk.*, p.draw FROM picks p JOIN rk ON {rj2}rk.{label} = p.cls AND rk.r = p.pick)"""


def _balanced_sql(src_tbl, seed, name="bal"):
    """SQL twin of ``sample_balanced``: CTE ``{name}`` with (row_idx, label, draw)."""
    return f"""{name}_pos AS (SELECT *, row_number() OVER (ORDER BY {_key(seed)}, row_idx) - 1 AS draw
            FROM {src_tbl} WHERE label = 1),
{name}_neg AS (SELECT *, row_number() OVER (ORDER BY {_key(seed)}, row_idx) - 1 AS pick,
                     count(*) OVER () AS nneg FROM {src_tbl} WHERE label = 0),
{name}_nn AS (SELECT DISTINCT nneg FROM {name}_neg),
{name}_draws AS (SELECT p.draw, {S.md5_long(f"md5(CAST(p.draw AS VARCHAR) || ':{seed}:neg')")} % n.nneg AS pick
             FROM {name}_pos p, {name}_nn n),
{name} AS (
  SELECT row_idx, label, CAST(-1 AS BIGINT) AS draw FROM {name}_pos
  UNION ALL SELECT g.row_idx, g.label, d.draw FROM {name}_draws d JOIN {name}_neg g ON g.pick = d.pick)"""


@query("split_by_date", S.with_(DS, SPLIT) + """
SELECT row_idx, date, label, split FROM sp""")
def q_split_by_date(spark, sf_dir):
    """Date split, then 15 % of train (md5 order) to validation."""
    return dated_split(spark, sf_dir).select("row_idx", "date", "label", "split")


@query("union_splits", S.with_(DS, SPLIT) + """
SELECT row_idx, label, split FROM sp""")
def q_union_splits(spark, sf_dir):
    """Train / test / valid frames stacked with split ids 0 / 1 / 2."""
    d = dated_split(spark, sf_dir).select("row_idx", "label", "split")
    parts = [d.where(F.col("split") == i).drop("split") for i in (0, 1, 2)]
    return O.union_splits(*parts)


@query("class_counts", S.with_(DS, SPLIT) + """
SELECT split, label, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share
FROM sp GROUP BY split, label""")
def q_class_counts(spark, sf_dir):
    """Rows per (split, label) and share within the split."""
    return rounded(LB.class_counts(dated_split(spark, sf_dir)))


@query("valid_portion", S.with_(DS) + f"""
SELECT row_idx, CASE WHEN rk < round_even(n * {1 - PERC_VAL}, 0) THEN 0 ELSE 2 END AS split
FROM (SELECT row_idx, row_number() OVER (ORDER BY {_key()}, row_idx) - 1 AS rk, count(*) OVER () AS n FROM ds)""")
def q_valid_portion(spark, sf_dir):
    """rint(n * 0.85) rows stay train, the rest validation."""
    return O.valid_portion(dataset(spark, sf_dir), PERC_VAL, SEED).select("row_idx", "split")


@query("balance_binary", S.with_(DS, _oversample_sql("ds", "label", SEED)) + """
SELECT row_idx, label, CAST(-1 AS BIGINT) AS draw FROM ds
UNION ALL SELECT row_idx, label, draw FROM drawn""")
def q_balance_binary(spark, sf_dir):
    """The smaller class oversampled with replacement to the larger one."""
    return O.balance_binary(dataset(spark, sf_dir), "label", SEED).select("row_idx", "label", "draw")


@query("oversample_three_class", S.with_(DS, _oversample_sql("ds", "label3", SEED, classes=[1, -1], target=0)) + """
SELECT row_idx, label3, CAST(-1 AS BIGINT) AS draw FROM ds
UNION ALL SELECT row_idx, label3, draw FROM drawn""")
def q_oversample_three_class(spark, sf_dir):
    """Classes +1 / -1 raised to the size of class 0."""
    d = dataset(spark, sf_dir)
    return O.oversample_three_class(d, "label3", SEED).select("row_idx", "label3", "draw")


@query("apply_split_file", S.with_(DS, SPLIT, _oversample_sql("sp", "label3", SEED, part="split",
                                                               classes=[1, -1], target=0)) + """
SELECT split, row_idx, label3, CAST(-1 AS BIGINT) AS draw FROM sp
UNION ALL SELECT split, row_idx, label3, draw FROM drawn""")
def q_apply_split_file(spark, sf_dir):
    """D8 + S20: route samples by a stored split table, oversampling inside each split."""
    d = dataset(spark, sf_dir)
    split_table = dated_split(spark, sf_dir).select("row_idx", "split")
    out = O.apply_split(d.drop("date"), split_table, oversampling=True, label_col="label3", seed=SEED)
    return out.select("split", "row_idx", "label3", "draw")


@query("sample_balanced", S.with_(DS, _balanced_sql("ds", SEED)) + """
SELECT row_idx, label, draw FROM bal""")
def q_sample_balanced(spark, sf_dir):
    """D3: all positives plus as many negatives drawn with replacement."""
    return O.sample_balanced(dataset(spark, sf_dir).drop("label3"), "label", SEED).select("row_idx", "label", "draw")


@query("kfold_id", S.with_(DS) + f"""
SELECT row_idx, label, CAST(ntile({K}) OVER (PARTITION BY label ORDER BY {_key()}, row_idx) AS INTEGER) AS fold
FROM ds""")
def q_kfold_id(spark, sf_dir):
    """Fold number 1..k per class (ntile over md5 order)."""
    return O.kfold_stratified(dataset(spark, sf_dir), K, "label", SEED).select("row_idx", "label", "fold")


@query("kfold_stratified", S.with_(DS) + f"""
SELECT row_idx, label, fold, CAST(pair AS INTEGER) AS pair, CASE WHEN fold = pair THEN 'test' ELSE 'train' END AS role
FROM (SELECT row_idx, label,
             CAST(ntile({K}) OVER (PARTITION BY label ORDER BY {_key()}, row_idx) AS INTEGER) AS fold FROM ds),
     range(1, {K + 1}) r(pair)""")
def q_kfold_stratified(spark, sf_dir):
    """K (train, test) pairs from per-class folds."""
    f = O.kfold_stratified(dataset(spark, sf_dir), K, "label", SEED)
    return O.kfold_pairs(f, K).select("row_idx", "label", "fold", "pair", "role")


@query("holdout_last_fold", S.with_(DS) + f"""
SELECT row_idx, label, ntile(6) OVER (PARTITION BY label ORDER BY {_key()}, row_idx) = 6 AS valid FROM ds""")
def q_holdout_last_fold(spark, sf_dir):
    """Last of six folds of each class held out for validation."""
    return O.holdout_last_fold(dataset(spark, sf_dir), "label", SEED).select("row_idx", "label", "valid")


REPEATS = RK = 3  # one repeat per fold


def _repeat_sql(rep):
    seed = f"{SEED}:{rep}"
    return _balanced_sql("rest", seed, f"b{rep}") + f""",
f{rep} AS (SELECT {rep} AS repeat, row_idx, label, draw,
               CAST(ntile({RK}) OVER (PARTITION BY label ORDER BY
                    md5(CAST(row_idx AS VARCHAR) || ':' || CAST(draw AS VARCHAR) || ':{seed}'), row_idx, draw)
                    AS INTEGER) AS fold FROM b{rep})"""


@query("repeated_kfold", S.with_(DS, f"""rest AS (
  SELECT row_idx, label FROM ds
  QUALIFY ntile(6) OVER (PARTITION BY label ORDER BY {_key()}, row_idx) < 6)""",
                                 *[_repeat_sql(r) for r in range(REPEATS)]) +
       "\nUNION ALL ".join(f"SELECT * FROM f{r}" for r in range(REPEATS)).join(["SELECT * FROM (", ")"]))
def q_repeated_kfold(spark, sf_dir):
    """Hold-out, then repeated balanced sampling + stratified k-fold."""
    d = dataset(spark, sf_dir).select("row_idx", "label")
    out = O.repeated_kfold(d, RK, REPEATS, "label", SEED)
    return out.select("repeat", "row_idx", "label", "draw", "fold")


@query("shuffle_stored", S.with_(DS, SPLIT) + f"""
SELECT split, row_idx,
       CAST(row_number() OVER (PARTITION BY split ORDER BY {_key()}, row_idx) - 1 AS BIGINT) AS shuffled_idx
FROM sp""")
def q_shuffle_stored(spark, sf_dir):
    """A stored permutation per split, replayed by a join."""
    sp = dated_split(spark, sf_dir)
    perm = O.shuffle_permutation(sp, SEED)
    return O.replay_permutation(sp.select("split", "row_idx"), perm).select("split", "row_idx", "shuffled_idx")
