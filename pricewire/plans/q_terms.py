"""Term-feature queries: the labelled documents, split by date, as the text dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.functions import text as X
from pricewire.operators import terms as O
from pricewire.operators import text as TX
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.plans.q_splits import DS, SPLIT, dated_split
from pricewire.plans.q_text import corpus
from pricewire.session import cut_lineage
from pricewire.sources import tables as T

MAX_FEATURES = 100_000   # the reference's default
NGRAM_MAX = 3
TOP_K = 100


def text_dataset(spark, sf_dir):
    """``(row_idx, split, label, text)``: cleaned, tokenised document text per
    labelled row, written once (reliable checkpoint): every term query reads it
    several times (vocabulary, counts, document totals)."""
    sp = dated_split(spark, sf_dir).select(F.col("row_idx").alias("doc_idx"), "split", "label")
    # join first, clean after: only labelled documents pay for the regex work
    coll = T.collection(spark, sf_dir).join(sp, "doc_idx", "inner")
    c = TX.clean_corpus(coll).select(F.col("doc_idx").alias("row_idx"), "split", "label",
                                     X.join_tokens("tokens").alias("text"))
    return cut_lineage(c)


def counts(ds, ngram_max=1):
    return O.doc_term_counts(ds, ngram_max=ngram_max)


def train_docs(ds):
    return ds.where(F.col("split") == 0)


def train_counts(ds, ngram_max=1, all_counts=None):
    c = counts(ds, ngram_max) if all_counts is None else all_counts
    return c.join(train_docs(ds).select("row_idx"), "row_idx", "left_semi")


def train_totals(ds, ngram_max=1):
    """Total counts of the terms of every text whose row is in train; the texts are joined, not their terms."""
    return O.term_totals(ds.join(train_docs(ds).select("row_idx"), "row_idx", "left_semi"), ngram_max=ngram_max)


def chi2(ds):
    return O.chi2_scores(train_counts(ds), train_docs(ds))


_VT = "regexp_extract_all(lower(text), '\\b\\w\\w+\\b')"
_DOCS = S.with_(DS, SPLIT, S.COLLECTION, S.CLEAN_DOCS, """tdocs AS (
  SELECT sp.row_idx, sp.split, sp.label, array_to_string(toks.tokens, ' ') AS text
  FROM sp JOIN toks ON toks.doc_idx = sp.row_idx)""")


def _cnt_sql(ngram_max=1):
    """Counts of all n-grams up to the order; the tokens of a text are cut once."""
    return f"""cnt AS (SELECT row_idx, term, count(*) AS cnt FROM (
  SELECT row_idx, unnest(flatten(list_transform(range(1, {ngram_max + 1}), lambda n: list_transform(range(1, len(w) - n + 2),
         lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS term FROM (SELECT row_idx, {_VT} AS w FROM tdocs)) GROUP BY ALL)"""


def _vocab_sql(limit=MAX_FEATURES):
    return f"""tot AS (SELECT term, sum(cnt) AS t FROM cnt JOIN tdocs USING (row_idx) WHERE split = 0 GROUP BY term),
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx
        FROM (SELECT term FROM tot ORDER BY t DESC, term ASC LIMIT {limit}))"""


_CHI2_SQL = """cls AS (SELECT label, count(*) AS nc FROM tdocs WHERE split = 0 GROUP BY label),
nn AS (SELECT sum(nc) AS n FROM cls),
obs AS (SELECT term, label, sum(cnt) AS o FROM cnt JOIN tdocs USING (row_idx) WHERE split = 0 GROUP BY ALL),
ft AS (SELECT term, sum(o) AS f FROM obs GROUP BY term),
chi AS (
  SELECT ft.term, sum(power(coalesce(obs.o, 0) - cls.nc / nn.n * ft.f, 2) / (cls.nc / nn.n * ft.f)) AS score
  FROM ft CROSS JOIN cls CROSS JOIN nn LEFT JOIN obs ON obs.term = ft.term AND obs.label = cls.label
  GROUP BY ft.term)"""


@query("bow_counts", _DOCS + ", " + _cnt_sql() + ", " + _vocab_sql() + """
SELECT c.row_idx, v.idx, CAST(c.cnt AS BIGINT) AS cnt FROM cnt c JOIN voc v USING (term)""")
def q_bow_counts(spark, sf_dir):
    """term counts with a vocabulary learned on train (top 100,000), used for every split."""
    ds = text_dataset(spark, sf_dir)
    c = counts(ds)
    vocab = O.learn_vocab(train_counts(ds, all_counts=c), MAX_FEATURES)
    return O.bow_counts(c, vocab, bound=MAX_FEATURES).select("row_idx", "idx", F.col("cnt").cast("long").alias("cnt"))


@query("ngram_counts", _DOCS + ", " + _cnt_sql(2) + ", " + _vocab_sql() + """
SELECT c.row_idx, v.idx, CAST(c.cnt AS BIGINT) AS cnt FROM cnt c JOIN voc v USING (term)""")
def q_ngram_counts(spark, sf_dir):
    """F2 + T7: uni- and bigram counts, vocabulary learned on train."""
    ds = text_dataset(spark, sf_dir)
    c = counts(ds, 2)
    vocab = O.learn_vocab(train_counts(ds, 2, all_counts=c), MAX_FEATURES)
    return O.bow_counts(c, vocab, bound=MAX_FEATURES).select("row_idx", "idx", F.col("cnt").cast("long").alias("cnt"))


@query("ngram_counts_order3", _DOCS + ", " + _cnt_sql(NGRAM_MAX) + ", " + _vocab_sql() + """
SELECT c.row_idx, v.idx, CAST(c.cnt AS BIGINT) AS cnt FROM cnt c JOIN voc v USING (term)""")
def q_ngram_counts_order3(spark, sf_dir):
    """F2 + T7 at the reference's default order: uni-, bi- and trigram counts, vocabulary learned on train."""
    ds = text_dataset(spark, sf_dir)
    vocab = O.learn_vocab(train_totals(ds, NGRAM_MAX), MAX_FEATURES)
    return O.vocab_term_counts(ds, vocab, ngram_max=NGRAM_MAX, bound=MAX_FEATURES).select(
        "row_idx", "idx", F.col("cnt").cast("long").alias("cnt"))


@query("tfidf", _DOCS + ", " + _cnt_sql() + ", " + _vocab_sql() + """,
bow AS (SELECT c.row_idx, v.idx, c.cnt FROM cnt c JOIN voc v USING (term)),
n AS (SELECT count(*) AS n FROM tdocs WHERE split = 0),
df AS (SELECT idx, count(*) AS df FROM bow JOIN tdocs USING (row_idx) WHERE split = 0 GROUP BY idx),
w AS (SELECT b.row_idx, b.idx, b.cnt * (ln((n.n + 1.0) / (df.df + 1.0)) + 1) AS w FROM bow b JOIN df USING (idx), n)
SELECT row_idx, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_idx)), 6) AS value FROM w""")
def q_tfidf(spark, sf_dir):
    """tf-idf with the +1 idf, unit L2 rows, IDF fitted on train only."""
    d = text_dataset(spark, sf_dir)
    c = counts(d)
    vocab = O.learn_vocab(train_counts(d, all_counts=c), MAX_FEATURES)
    bow = O.bow_counts(c, vocab, bound=MAX_FEATURES)
    return rounded(O.tfidf(bow, d, fit_where=F.col("split") == 0))


def _r96(c):
    """Chi-square scores of small integer counts are often exact 7-digit ties
    (e.g. 289/640); both sides round to 9 digits first, so float noise of the
    two different summation orders cannot flip the 6-digit result."""
    return F.round(F.round(c, 9), 6)


@query("chi2_scores", _DOCS + ", " + _cnt_sql() + ", " + _CHI2_SQL + """
SELECT term, round(round(score, 9), 6) AS score FROM chi""")
def q_chi2_scores(spark, sf_dir):
    """chi-square of every train term against the label."""
    c = chi2(text_dataset(spark, sf_dir))
    return c.select("term", _r96(F.col("score")).alias("score"))


@query("mi_scores", _DOCS + ", " + _cnt_sql() + """,
cls AS (SELECT label, count(*) AS nc FROM tdocs WHERE split = 0 GROUP BY label),
nn AS (SELECT sum(nc) AS n FROM cls),
dcnt AS (SELECT c.term, c.cnt, d.label FROM cnt c JOIN tdocs d USING (row_idx) WHERE d.split = 0),
cells AS (SELECT term, cnt AS v, label, count(*) AS nvc FROM dcnt GROUP BY ALL),
seen AS (SELECT term, label, sum(nvc) AS s FROM cells GROUP BY ALL),
terms AS (SELECT DISTINCT term FROM cells),
zero AS (SELECT t.term, 0 AS v, cls.label, cls.nc - coalesce(s.s, 0) AS nvc
         FROM terms t CROSS JOIN cls LEFT JOIN seen s ON s.term = t.term AND s.label = cls.label),
allc AS (SELECT * FROM cells UNION ALL SELECT * FROM zero WHERE nvc > 0),
marg AS (SELECT term, v, sum(nvc) AS nv FROM allc GROUP BY ALL)
SELECT term, round(greatest(sum(nvc / nn.n * ln(nvc * nn.n / (nv * nc))), 0), 6) AS score
FROM allc JOIN marg USING (term, v) JOIN cls USING (label), nn GROUP BY term""")
def q_mi_scores(spark, sf_dir):
    """mutual information (nats) of each train term's count with the label."""
    ds = text_dataset(spark, sf_dir)
    return rounded(O.mi_scores(train_counts(ds), train_docs(ds)))


@query("select_k_best", _DOCS + ", " + _cnt_sql() + ", " + _CHI2_SQL + f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx, round(round(score, 9), 6) AS score
FROM (SELECT * FROM chi ORDER BY round(score, 9) DESC, term DESC LIMIT {TOP_K})""")
def q_select_k_best(spark, sf_dir):
    """the k best chi-square terms, renumbered alphabetically."""
    k = O.select_k_best(chi2(text_dataset(spark, sf_dir)), TOP_K)
    return k.withColumn("score", _r96(F.col("score")))


@query("order_by_score", _DOCS + ", " + _cnt_sql() + ", " + _CHI2_SQL + """
SELECT term, round(round(score, 9), 6) AS score,
       CAST(row_number() OVER (ORDER BY round(score, 9) DESC, term DESC) - 1 AS BIGINT) AS rank FROM chi""")
def q_order_by_score(spark, sf_dir):
    """V3 / K9 order: terms by (score, term) descending with their rank."""
    r = O.order_by_score(chi2(text_dataset(spark, sf_dir)))
    return r.withColumn("score", _r96(F.col("score")))


@query("given_vocab", _DOCS + ", " + _cnt_sql() + ", " + _CHI2_SQL + f""",
gv AS (SELECT term, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, term DESC) - 1 AS BIGINT) AS idx
       FROM chi QUALIFY idx < {TOP_K})
SELECT c.row_idx, g.idx, CAST(c.cnt AS BIGINT) AS cnt FROM cnt c JOIN gv g USING (term)""")
def q_given_vocab(spark, sf_dir):
    """S19 + F7: counts over the first k terms of a score table (idx = score order)."""
    ds = text_dataset(spark, sf_dir)
    vocab = O.given_vocab(chi2(ds), TOP_K)
    return O.bow_counts(counts(ds), vocab, bound=TOP_K).select("row_idx", "idx", F.col("cnt").cast("long").alias("cnt"))


@query("vocab_of_dataset", S.with_(DS, SPLIT, S.COLLECTION, S.CLEAN_DOCS) + """,
wf AS (SELECT term, count(*) AS freq FROM (
         SELECT unnest(toks.tokens) AS term FROM sp JOIN toks ON toks.doc_idx = sp.row_idx WHERE sp.split IN (0, 1))
       GROUP BY term)
SELECT term, CAST(row_number() OVER (ORDER BY freq DESC, term ASC) - 1 AS BIGINT) AS idx, CAST(freq AS BIGINT) AS freq
FROM wf""")
def q_vocab_of_dataset(spark, sf_dir):
    """V2: word vocabulary over train + test documents (not valid), all terms ranked."""
    sp = dated_split(spark, sf_dir).where(F.col("split").isin(0, 1)).select(F.col("row_idx").alias("doc_idx"))
    docs = TX.clean_corpus(T.collection(spark, sf_dir).join(sp, "doc_idx", "left_semi"))
    return TX.vocab_topk(TX.word_freq(docs), None)
