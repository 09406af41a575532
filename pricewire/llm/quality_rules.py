"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditionals.

Statistics of whole texts are computed in Arrow batches.  The list is learned by sequential covering on labelled
statistics: a rule is a conjunction of thresholds, grown by FOIL gain on two thirds of the rows and pruned on
the other third; while pruned rules reach ``min_precision`` there, the rows they cover are removed and the next rule is
grown.  The rules become ``CASE WHEN`` arms in the order learned; the first arm that holds gives the
verdict, and a text that no arm fits is kept.

The fit reads at most ``fit_rows`` labelled documents, those with the smallest hashes of doc_id (a bounded sample, the
only one); statistics and verdicts cover every row.

Defined cases: null text has no words and fails the base rules; documents labelled both ways, null labels and null ids
in labels are not learned from; without labels of both kinds the list is empty and the base rules decide;
repeated rows are judged alike; empty tables give empty results; ``keep_good`` keeps all columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewire.llm.common import packed_row

FIT_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
              "n_upper", "n_digits", "n_marks")
STATS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in STAT_NAMES])
#: Features of the rules: name -> (numerator, denominator); None: the count itself.
FEATURES = {"words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
            "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
            "distinct": ("n_distinct_words", "n_words"), "upper": ("n_upper", "word_chars"),
            "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words")}


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen, twice = set(), set()
    if len(set(grams)) == len(grams):
        return 0
    for g in grams:
        (twice if g in seen else seen).add(g)
    n, covered = 0, 0  # covered: the first position that no earlier window holds
    for i, g in enumerate(grams):
        if g in twice:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def text_stats(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STAT_NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)),
            len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
            len(raw) - len(raw.translate(None, b"0123456789")), sum(map(text.count, "!?;:_=+~^")))


@F.pandas_udf(STATS_TYPE)
def stats_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(x) for x in text], columns=list(STAT_NAMES), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """Reject when every (feature, at least?, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float = 0.0
    covered: int = 0

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<='} {t:.6g}" for f, up, t in self.tests)

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        m = np.ones(len(next(iter(x.values()))), bool)
        for f, up, t in self.tests:
            m &= x[f] >= t if up else x[f] <= t
        return m

    def condition(self, features: dict[str, Column]) -> Column:
        c = F.lit(True)
        for f, up, t in self.tests:
            c = c & (features[f] >= F.lit(t) if up else features[f] <= F.lit(t))
        return c


def feature_columns(stats: str) -> dict[str, Column]:
    def ratio(a, b):
        top = F.col(f"{stats}.{a}").cast("double")
        return top if b is None else top / F.greatest(F.col(f"{stats}.{b}"), F.lit(1)).cast("double")
    return {f: ratio(a, b) for f, (a, b) in FEATURES.items()}


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int, bins: int) -> Rule:
    rule, live = Rule(()), np.ones(len(bad), bool)
    while len(rule.tests) < max_tests and bad[live].sum() < live.sum():
        p0, n0 = bad[live].sum(), live.sum()
        base, best = np.log2(p0 / n0), (1e-9, None)
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[live], np.linspace(0, 1, bins + 1)))
            mid = (cuts[1:] + cuts[:-1]) / 2
            order = np.argsort(v[live], kind="stable")
            vs, cum = v[live][order], np.concatenate(([0], np.cumsum(bad[live][order])))
            for up in (True, False):
                at = np.searchsorted(vs, mid, "left" if up else "right")
                n, p = (n0 - at, cum[-1] - cum[at]) if up else (at, cum[at])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - base), -1.0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, up, float(mid[int(gain.argmax())])))
        if best[1] is None:
            break
        rule = Rule((*rule.tests, best[1]))
        live = rule.mask(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = r.mask(x)
        p, n = bad[m].sum(), m.sum() - bad[m].sum()
        return (p - n) / (p + n) if p + n else -1.0
    while len(rule.tests) > 1:
        shorter = max((Rule(rule.tests[:i]) for i in range(1, len(rule.tests))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    m = rule.mask(x)
    return Rule(rule.tests, float(bad[m].mean()) if m.any() else 0.0, int(m.sum()))


def learn(x: dict[str, np.ndarray], bad: np.ndarray, hold: np.ndarray, min_precision: float = 0.9,
          max_rules: int = 12, max_tests: int = 3, bins: int = 64) -> list[Rule]:
    """Sequential covering: ``hold`` marks the rows that prune and judge, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow, prune = left & ~hold, left & hold
        if bad[grow].sum() < 3 or bad[prune].sum() < 1 or bad[grow].all():
            break
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], max_tests, bins)
        if not rule.tests:
            break
        rule = _prune(rule, {f: v[prune] for f, v in x.items()}, bad[prune])
        if rule.precision < min_precision or rule.covered < 2:
            break
        rules.append(rule)
        left &= ~rule.mask(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", min_precision: float = 0.9) -> list[Rule]:
    """Learn the list from at most ``fit_rows`` labelled documents (label 0: reject, 1: keep)."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high")).filter("_low = _high"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).select("_id", F.col("_low").alias("_label"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(known), "_id").dropDuplicates(["_id"])
    rows = rows.select("_label", "_id", stats_udf("_text").alias("_s"))
    cols = feature_columns("_s")
    got = (rows.select((F.col("_label") == 0).alias("bad"), F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)).alias("third"),
                       "_id", *[c.alias(f) for f, c in cols.items()]).toPandas().sort_values("_id"))
    x = {f: got[f].to_numpy(float) for f in FEATURES}
    return learn(x, got["bad"].to_numpy(bool), (got["third"] == 0).to_numpy(bool), min_precision) if len(got) else []


def rejected_by(rules: list[Rule], stats: str) -> Column:
    """The number (from 1) of the first rule that holds, else null: one ordered CASE expression."""
    features = feature_columns(stats)
    if not rules:
        return F.lit(None).cast("int")
    case = F.when(rules[0].condition(features), F.lit(1))
    for i, r in enumerate(rules[1:], 2):
        case = case.when(r.condition(features), F.lit(i))
    return case


def base_failed(stats: str) -> Column:
    n, r = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
          text_col: str = "text", **fit_options) -> DataFrame:
    """One row per document: its statistics, base_failed, kept and the number of the rule that rejects it."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, **fit_options) if rules is None else rules
    d = docs.select(F.col(id_col).alias("doc_id"), stats_udf(F.col(text_col).cast("string")).alias("s"))
    d = d.withColumn("base_failed", base_failed("s")).withColumn("rule", rejected_by(rules, "s"))
    return d.select("doc_id", *[f"s.{n}" for n in STAT_NAMES[:5]], "base_failed",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
              text_col: str = "text", **fit_options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, **fit_options) if rules is None else rules
    d = packed_row(docs, stats_udf(F.col(text_col).cast("string")).alias("_s"))
    return d.filter(~base_failed("_s") & rejected_by(rules, "_s").isNull()).select("_row.*")
