"""DuckDB oracle building blocks: the same table binding as ``sources.tables``,
written as SQL common table expressions, plus small generators for repeated
column lists.  These strings are only used to cross-check the Spark jobs.
"""

from __future__ import annotations

from pricewire.sources import tables as T

PRICES = f"""prices AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date,
         arg_min(value, ts) AS open, arg_max(value, ts) AS close
  FROM events GROUP BY 1, 2)"""

SYMBOL_MAP = f"""symbol_map AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS symbol,
         '{T.COMPANY_PREFIX}' || CAST(user_id % {T.COMPANIES} AS VARCHAR) AS company
  FROM events WHERE user_id % {T.UNMAPPED[0]} <> {T.UNMAPPED[1]})"""

COLLECTION = f"""coll AS (
  SELECT doc_id AS doc_idx, source AS company,
         DATE '{T.DOC_EPOCH}' + CAST((doc_id // {T.DOCS_PER_DAY}) % {T.CORPUS_DAYS} AS INTEGER) AS date,
         text
  FROM documents)"""

DOCS_PER_DAY = """dd AS (SELECT company, date, max(doc_idx) AS doc_idx FROM coll GROUP BY 1, 2)"""

# series with change, next open and day document (before any filter)
SERIES = """series AS (
  SELECT p.symbol, m.company, p.date, p.open, p.close, dd.doc_idx,
         lead(p.open) OVER (PARTITION BY p.symbol ORDER BY p.date) AS next_open,
         (lead(p.open) OVER (PARTITION BY p.symbol ORDER BY p.date) - p.open) / nullif(p.open, 0) * 100 AS change
  FROM prices p JOIN symbol_map m USING (symbol)
  LEFT JOIN dd ON dd.company = m.company AND dd.date = p.date)"""

TOPICS = f"""topics AS (
  SELECT {T.TOPIC_K} AS k, vec_id AS doc_idx,
         list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) + {T.TOPIC_ALPHA}) AS gamma
  FROM embeddings),
topics_n AS (
  SELECT k, doc_idx,
         list_transform(gamma, lambda x: (x - {T.TOPIC_ALPHA})
             / list_sum(list_transform(gamma, lambda y: y - {T.TOPIC_ALPHA}))) AS topic
  FROM topics)"""

TOPICS_LONG = """topics_long AS (
  SELECT k, doc_idx, i, topic[i] AS v FROM topics_n, range(1, len(topic) + 1) r(i))"""

LABELS3 = """lab AS (SELECT doc_id AS doc_idx, quality, toxic, quality - toxic AS label3 FROM labels)"""

PREDICTIONS = "preds AS (\n" + "\n  UNION ALL\n".join(
    f"""  SELECT '{run}' AS run_id, doc_idx AS row_idx, label3 AS label,
         CAST(CASE WHEN (doc_idx // {div}) % 10 < {right} THEN label3 ELSE (doc_idx // {guess}) % 3 - 1 END
              AS INTEGER) AS prediction FROM lab"""
    for run, div, right, guess in T.PREDICTION_RUNS) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def lag_cols(col: str, n: int, alias: str, window: str, default=None, rnd: int | None = None,
             start: int = 1) -> str:
    out = []
    for i in range(start, start + n):
        e = col if i == 0 else f"lag({col}, {i}) OVER ({window})"
        if default is not None:
            e = f"coalesce({e}, {default})"
        if rnd is not None:
            e = f"round({e}, {rnd})"
        out.append(f"{e} AS {alias}{i}")
    return ",\n  ".join(out)


def md5_key(col: str, seed) -> str:
    return f"md5(CAST({col} AS VARCHAR) || ':{seed}')"


def md5_long(expr: str) -> str:
    return f"CAST(('0x' || substr({expr}, 1, 15)) AS BIGINT)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chain(expr: str, rules) -> str:
    for pat, rep in rules:
        expr = f"regexp_replace({expr}, {_lit(pat)}, {_lit(rep)}, 'g')"
    return expr


def clean_text(expr: str, sentences: bool = False) -> str:
    """T1 / T2 as DuckDB SQL (ASCII-only lower case, same rewrite order)."""
    from pricewire.functions import text as X
    low = f"translate({expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = X.CONTRACTIONS + (X.SENTENCE_MARKS if sentences else [])
    out = _chain(low, rules)
    out = f"regexp_replace({out}, {_lit(X.DISALLOWED)}, '', 'g')"
    return f"regexp_replace({out}, {_lit(X.WHITESPACE_RUN)}, ' ', 'g')"


def tokens(expr: str) -> str:
    """T5 as DuckDB SQL (backreferences written \\1 instead of $1)."""
    from pricewire.functions import text as X
    rules = [(p, r.replace("$", "\\")) for p, r in X.TOKEN_SPLITS]
    return f"list_filter(string_split_regex({_chain(expr, rules)}, '\\s+'), lambda x: x <> '')"


CLEAN_DOCS = f"""cd AS (
  SELECT doc_idx, company, date, {clean_text('text')} AS clean FROM coll),
toks AS (
  SELECT doc_idx, company, date, clean, {tokens('clean')} AS tokens FROM cd WHERE length(clean) > 0)"""

WORD_FREQ = """wf AS (SELECT term, count(*) AS freq FROM (SELECT unnest(tokens) AS term FROM toks) GROUP BY term)"""


def vocab(size: int | None) -> str:
    q = "row_number() OVER (ORDER BY freq DESC, term ASC) - 1"
    lim = f" QUALIFY idx < {size}" if size is not None else ""
    return f"vocab AS (SELECT term, CAST({q} AS BIGINT) AS idx, freq FROM wf{lim})"
