"""Text and corpus queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewire.functions import text as X
from pricewire.operators import text as O
from pricewire.plans import sql as S
from pricewire.plans.base import query, rounded
from pricewire.session import cut_lineage
from pricewire.sources import tables as T

VOCAB_SIZE = O.DEFAULT_VOCAB_SIZE   # vocabulary size used by the registered queries: the reference's


def corpus(spark, sf_dir):
    return O.clean_corpus(T.collection(spark, sf_dir))


def stored_corpus(spark, sf_dir):
    """The cleaned, tokenised corpus written once (reliable checkpoint) for
    queries that read it twice (vocabulary + documents): the regex cleaning
    of whole documents is the expensive step and must not run twice.

    The words (none empty, none with a space) are stored as one text: as an array each takes 16 bytes or more."""
    c = cut_lineage(corpus(spark, sf_dir).select("doc_idx", "company", "date", X.join_tokens("tokens").alias("words")))
    return c.select("doc_idx", "company", "date", F.array_remove(F.split("words", " "), "").alias("tokens"))


def vocab(spark, sf_dir, size=VOCAB_SIZE, docs=None):
    docs = corpus(spark, sf_dir) if docs is None else docs
    return O.vocab_topk(O.word_freq(docs), size)


_CORPUS_SQL = S.with_(S.COLLECTION, S.CLEAN_DOCS)


@query("clean_text", S.with_(S.COLLECTION) + f"""
SELECT doc_idx, {S.clean_text('text')} AS clean FROM coll""")
def q_clean_text(spark, sf_dir):
    """T1 on every whole document."""
    c = T.collection(spark, sf_dir)
    return c.select("doc_idx", X.clean_text("text").alias("clean"))


@query("clean_text_sentences", S.with_(S.COLLECTION) + f"""
SELECT doc_idx, {S.clean_text('text', sentences=True)} AS clean FROM coll""")
def q_clean_text_sentences(spark, sf_dir):
    """Sentence ends become EOS."""
    c = T.collection(spark, sf_dir)
    return c.select("doc_idx", X.clean_text_sentences("text").alias("clean"))


@query("clean_corpus", S.with_(S.COLLECTION) + f"""
SELECT doc_idx, CAST(i - 1 AS BIGINT) AS line_no, {S.clean_text('line')} AS clean
FROM (SELECT doc_idx, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i FROM coll)""")
def q_clean_corpus(spark, sf_dir):
    """Every line of every document cleaned on its own."""
    c = T.collection(spark, sf_dir)
    lines = c.select("doc_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_idx", F.col("line_no").cast("long").alias("line_no"),
                        X.clean_text("line").alias("clean"))


@query("pub_day", S.with_("m AS (SELECT 0)") + f"""
SELECT _id, CAST(regexp_replace(pub_date, 'T.*?Z', '') AS DATE) AS day, file_no FROM (
  SELECT CAST(doc_id AS VARCHAR) AS _id,
         CAST(DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} AS INTEGER) AS VARCHAR)
           || 'T12:00:00Z' AS pub_date, 0 AS file_no FROM documents
  UNION ALL
  SELECT CAST(doc_id AS VARCHAR),
         CAST(DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} + 1 AS INTEGER) AS VARCHAR)
           || 'T08:30:00Z', 1 FROM documents WHERE doc_id % 4 = 0)""")
def q_pub_day(spark, sf_dir):
    """T4: publication day from timestamp text."""
    m = T.article_meta(spark, sf_dir)
    return m.select("_id", X.pub_day("pub_date").alias("day"), "file_no")


@query("tokenize", _CORPUS_SQL + """
SELECT doc_idx, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM toks""")
def q_tokenize(spark, sf_dir):
    """T5 + P5: word tokens of every non-empty cleaned document."""
    d = corpus(spark, sf_dir)
    return d.select("doc_idx", F.size("tokens").cast("long").alias("n_tokens"),
                    X.join_tokens("tokens").alias("tokens"))


@query("vector_tokens", _CORPUS_SQL + """
SELECT doc_idx, CAST(len(v) AS BIGINT) AS n_tokens, array_to_string(v, ' ') AS tokens
FROM (SELECT doc_idx, regexp_extract_all(lower(clean), '\\b\\w\\w+\\b') AS v FROM toks)""")
def q_vector_tokens(spark, sf_dir):
    """Vectoriser tokens (2+ word characters) of the cleaned text."""
    d = corpus(spark, sf_dir)
    v = X.vector_tokens("clean")
    return d.select("doc_idx", F.size(v).cast("long").alias("n_tokens"), F.array_join(v, " ").alias("tokens"))


@query("ngrams", _CORPUS_SQL + """
SELECT doc_idx, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT doc_idx, list_concat(tokens,
        list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS g FROM toks)""")
def q_ngrams(spark, sf_dir):
    """Unigrams then bigrams of every document."""
    d = corpus(spark, sf_dir)
    g = X.ngrams("tokens", 2)
    return d.select("doc_idx", F.size(g).cast("long").alias("n_grams"), F.array_join(g, "|").alias("grams"))


@query("word_freq", _CORPUS_SQL + ", " + S.WORD_FREQ + """
SELECT term, CAST(freq AS BIGINT) AS freq FROM wf""")
def q_word_freq(spark, sf_dir):
    """A5: corpus word counts."""
    return O.word_freq(corpus(spark, sf_dir))


@query("vocab_topk", _CORPUS_SQL + ", " + S.WORD_FREQ + ", " + S.vocab(VOCAB_SIZE) + """
SELECT term, idx, CAST(freq AS BIGINT) AS freq FROM vocab""")
def q_vocab_topk(spark, sf_dir):
    """V1: top-n terms by frequency, index = rank (ties by term)."""
    return vocab(spark, sf_dir)


@query("vocab_all", _CORPUS_SQL + ", " + S.WORD_FREQ + ", " + S.vocab(None) + """
SELECT term, idx, CAST(freq AS BIGINT) AS freq FROM vocab""")
def q_vocab_all(spark, sf_dir):
    """V1 without a size: every term ranked by an exact distributed rank."""
    return O.vocab_topk(O.word_freq(corpus(spark, sf_dir)), None)


@query("vocab_coverage", _CORPUS_SQL + ", " + S.WORD_FREQ + ", " + S.vocab(VOCAB_SIZE) + """
SELECT round(CAST((SELECT sum(freq) FROM vocab) AS DOUBLE) / (SELECT sum(freq) FROM wf), 6) AS coverage,
       CAST((SELECT sum(freq) FROM wf) AS BIGINT) AS total_tokens,
       CAST((SELECT count(*) FROM vocab) AS BIGINT) AS vocab_terms""")
def q_vocab_coverage(spark, sf_dir):
    """Share of all tokens covered by the vocabulary."""
    d = stored_corpus(spark, sf_dir)
    f = O.word_freq(d)
    return rounded(O.vocab_coverage(f, O.vocab_topk(f, VOCAB_SIZE)))


_VOCAB_SQL = _CORPUS_SQL + ", " + S.WORD_FREQ + ", " + S.vocab(VOCAB_SIZE) + """,
kept AS (
  SELECT t.doc_idx, t.pos, t.term, v.idx
  FROM (SELECT doc_idx, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM toks) t
  JOIN vocab v USING (term))"""


@query("raw_corpus", _VOCAB_SQL + """
SELECT t.doc_idx, t.company, t.date, coalesce(k.text, '') AS text
FROM toks t LEFT JOIN (SELECT doc_idx, string_agg(term, ' ' ORDER BY pos) AS text FROM kept GROUP BY 1) k
  USING (doc_idx)""")
def q_raw_corpus(spark, sf_dir):
    """P4 + K3: in-vocabulary words of each document, order and repeats kept."""
    d = stored_corpus(spark, sf_dir)
    return O.raw_corpus(d, vocab(spark, sf_dir, docs=d), bound=VOCAB_SIZE)


@query("doc_term", _VOCAB_SQL + """
SELECT t.doc_idx, CAST(coalesce(n, 0) AS BIGINT) AS n_unique
FROM toks t LEFT JOIN (SELECT doc_idx, count(DISTINCT idx) AS n FROM kept GROUP BY 1) k USING (doc_idx)""")
def q_doc_term(spark, sf_dir):
    """Distinct vocabulary words per document (documents without any kept)."""
    d = stored_corpus(spark, sf_dir)
    return O.doc_term_summary(d, vocab(spark, sf_dir, docs=d), bound=VOCAB_SIZE)


@query("doc_term_lines", _VOCAB_SQL + """
SELECT t.doc_idx, coalesce(k.line, '0 ') AS line
FROM toks t LEFT JOIN (
  SELECT doc_idx, CAST(count(*) AS VARCHAR) || ' ' || string_agg(CAST(idx AS VARCHAR) || ':' || CAST(n AS VARCHAR) || ' ', '' ORDER BY idx) AS line
  FROM (SELECT doc_idx, idx, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1) k USING (doc_idx)""")
def q_doc_term_lines(spark, sf_dir):
    """K4: ``{n_unique} {idx:freq} ...`` lines for a topic-model input."""
    d = stored_corpus(spark, sf_dir)
    return O.doc_term_lines(d, vocab(spark, sf_dir, docs=d), bound=VOCAB_SIZE)


@query("corpus_stats", S.with_(S.COLLECTION) + """
SELECT CAST(count(DISTINCT company) AS BIGINT) AS n_companies, CAST(count(*) AS BIGINT) AS n_records FROM coll""")
def q_corpus_stats(spark, sf_dir):
    """A4: number of companies and of records."""
    c = T.collection(spark, sf_dir)
    return c.agg(F.countDistinct("company").cast("long").alias("n_companies"),
                 F.count(F.lit(1)).cast("long").alias("n_records"))


_META_SQL = f"""meta AS (
  SELECT source AS company, CAST(doc_id AS VARCHAR) AS _id,
         CAST(DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} AS INTEGER) AS VARCHAR)
           || 'T12:00:00Z' AS pub_date, 0 AS file_no, doc_id AS line_no FROM documents
  UNION ALL
  SELECT source, CAST(doc_id AS VARCHAR),
         CAST(DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} + 1 AS INTEGER) AS VARCHAR)
           || 'T08:30:00Z', 1, doc_id FROM documents WHERE doc_id % 4 = 0),
txt AS (
  SELECT source AS company, CAST(doc_id AS VARCHAR) AS _id, text FROM documents
  UNION ALL SELECT source, CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT source, CAST(doc_id AS VARCHAR), text || ' (updated)' FROM documents WHERE doc_id % 7 = 0),
first_meta AS (
  SELECT _id, arg_min(company, (file_no, line_no)) AS company, arg_min(pub_date, (file_no, line_no)) AS pub_date,
         arg_min(file_no, (file_no, line_no)) AS file_no, arg_min(line_no, (file_no, line_no)) AS line_no
  FROM meta GROUP BY _id)"""


@query("dedup_articles", S.with_(_META_SQL) + """
SELECT _id, company, pub_date, file_no, line_no FROM first_meta""")
def q_dedup_articles(spark, sf_dir):
    """A1: first metadata row of every article id."""
    return O.dedup_articles(T.article_meta(spark, sf_dir)).select("_id", "company", "pub_date", "file_no", "line_no")


@query("distinct_texts", S.with_(_META_SQL) + """
SELECT DISTINCT _id, md5(text) AS text_md5 FROM txt""")
def q_distinct_texts(spark, sf_dir):
    """A2: distinct (id, text) rows (text shown by its md5)."""
    t = O.distinct_texts(T.article_text(spark, sf_dir))
    return t.select("_id", F.md5("text").alias("text_md5"))


@query("join_meta_text", S.with_(_META_SQL) + """
SELECT m._id, m.company, CAST(regexp_replace(m.pub_date, 'T.*?Z', '') AS DATE) AS date, md5(t.text) AS text_md5
FROM first_meta m JOIN (SELECT DISTINCT _id, text FROM txt) t USING (_id)""")
def q_join_meta_text(spark, sf_dir):
    """J1 + P1: article metadata joined with its text(s), date and text kept."""
    j = O.join_meta_text(T.article_meta(spark, sf_dir), T.article_text(spark, sf_dir))
    return j.select("_id", "company", X.pub_day("pub_date").alias("date"), F.md5("text").alias("text_md5"))


@query("docs_per_day", S.with_(_META_SQL) + """
SELECT company, CAST(regexp_replace(pub_date, 'T.*?Z', '') AS DATE) AS date, _id,
       CAST(row_number() OVER (PARTITION BY company, CAST(regexp_replace(pub_date, 'T.*?Z', '') AS DATE)
                               ORDER BY file_no, line_no) - 1 AS BIGINT) AS ord
FROM first_meta""")
def q_docs_per_day(spark, sf_dir):
    """A3: the articles of each (company, day) in source order."""
    m = O.dedup_articles(T.article_meta(spark, sf_dir)).withColumn("date", X.pub_day("pub_date"))
    return O.day_articles(m).select("company", "date", "_id", "ord")
