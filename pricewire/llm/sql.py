"""DuckDB SQL of the queries that SQL expresses, over whole tables."""

from __future__ import annotations

from pricewire.llm import licence_scan, line_winnow, url_aliases

WS = r"[\x20\x09-\x0D]"


def _lower(x: str) -> str:
    return f"translate({x}, '{url_aliases.AZ[0]}', '{url_aliases.AZ[1]}')"


OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

# Links from an inverted index of shingles; components by walking the links.
OP5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (
        SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""


def op3(window: int = line_winnow.WINDOW, min_words: int | None = line_winnow.MIN_WORDS) -> str:
    def of(size: int) -> str:
        short = f"n_lines = {size} OR {' + '.join(f'lead(words, {j}) OVER p' for j in range(size))} >= {min_words}"
        return (f"SELECT doc_id, pos, {size} AS size, [{', '.join(f'lead(t, {j}) OVER p' for j in range(size))}] AS c FROM s "
                f"WINDOW p AS (PARTITION BY doc_id ORDER BY pos) "
                f"QUALIFY lead(i, {size - 1}) OVER p IS NOT NULL AND ({'true' if size == window else short})")
    sizes = [window] if min_words is None else range(1, window + 1)
    return rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (SELECT doc_id, i, regexp_replace(line, '^{WS}+|{WS}+$', '', 'g') AS t FROM raw),
s AS (SELECT doc_id, i, t, len(regexp_split_to_array(t, '{WS}+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
             count(*) OVER (PARTITION BY doc_id) AS n_lines FROM l WHERE t <> ''),
w AS ({" UNION ALL ".join(map(of, sizes))}),
f AS (SELECT c, min(struct_pack(d := doc_id, a := pos)) AS ref FROM w GROUP BY c),
m AS (SELECT w.doc_id, w.pos, size FROM w JOIN f ON w.c = f.c WHERE w.doc_id <> ref.d OR w.pos >= ref.a + size),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(0, size)) AS pos FROM m),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone),
runs AS (SELECT doc_id, list(min_ || '-' || max_ ORDER BY min_) AS deleted_runs FROM (
         SELECT doc_id, run, min(pos) AS min_, max(pos) AS max_ FROM g GROUP BY doc_id, run) GROUP BY doc_id),
dead AS (SELECT s.doc_id, s.i FROM s JOIN gone USING (doc_id, pos)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM raw ANTI JOIN dead USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM s GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       coalesce(deleted_runs, []) AS deleted_runs, md5(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END) AS text_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN runs USING (doc_id)
LEFT JOIN kept USING (doc_id)
"""


def _rules(host: str, path: str) -> tuple[str, str]:
    rule, verdict = "NULL", "NULL"
    for says, text in sorted(url_aliases.RULES, key=lambda r: len(r[1])):
        domain, slash, prefix = text.partition("/")
        fits = f"(({host} = '{domain}' OR ends_with({host}, '.{domain}')) AND starts_with({path}, '{slash}{prefix}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    return rule, verdict


def op6() -> str:
    def q(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def host(u):
        return f"coalesce({_lower(f'regexp_extract({u}, {q(r"(?s)^.*?://([^/?#]*)")}, 1)')}, '')"

    def path(u):
        return f"coalesce(regexp_extract({u}, {q(r'(?s)^.*?://[^/?#]*([^?#]*)')}, 1), '')"

    def node(u):
        bare = f"regexp_replace({u}, '(?s)#.*$', '')"
        return (f"CASE WHEN regexp_matches({u}, '{url_aliases.SCHEME}//') THEN {_lower(f"regexp_extract({bare}, '(?s)^(.*?)://', 1)")} || '://' || "
                f"{host(u)} || regexp_extract({bare}, '(?s)://[^/?]*(.*)$', 1) END")
    scheme = "regexp_extract(url, '(?s)^(.*?)://', 1)"
    origin = f"({scheme} || '://' || regexp_extract(url, '(?s)://([^/?#]*)', 1))"
    folder = f"regexp_replace({path('url')}, '[^/]*$', '')"
    absolute = (f"CASE WHEN ref = '' THEN NULL WHEN regexp_matches(ref, '{url_aliases.SCHEME}//') THEN ref "
                f"WHEN regexp_matches(ref, '{url_aliases.SCHEME}') THEN NULL WHEN starts_with(ref, '//') THEN {scheme} || ':' || ref "
                f"WHEN starts_with(ref, '/') THEN {origin} || ref WHEN starts_with(ref, '#') THEN NULL "
                f"WHEN starts_with(ref, '?') THEN {origin} || {path('url')} || ref "
                f"ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || ref END")
    plain = "ref"
    for pattern, sign in url_aliases.ENTITIES:
        plain = f"regexp_replace({plain}, '{pattern}', {q(sign)}, 'g')"
    rule, verdict = _rules("host", "path")
    return f"""
WITH RECURSIVE named AS (SELECT url, unnest([
    regexp_extract(regexp_extract(html, {q(url_aliases.LINK)}), {q(url_aliases.HREF)}, 1),
    regexp_extract(regexp_extract(html, {q(url_aliases.META)}), {q(url_aliases.GOTO)}, 1)]) AS ref FROM pages
    WHERE url IS NOT NULL AND html IS NOT NULL),
f AS (SELECT url, {plain} AS ref FROM named),
t AS (SELECT url, {absolute} AS dst FROM f),
e AS (SELECT DISTINCT {node('url')} AS a, {node('dst')} AS b FROM t),
b AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
r AS (SELECT a AS x, a AS y FROM b UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a),
j AS (SELECT x, y, {host('y')} AS host, {path('y')} AS path FROM r),
c AS (SELECT x, min({verdict}) AS says FROM j GROUP BY x),
p AS (SELECT page_id, url, {host('url')} AS host, {path('url')} AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, says, 'allow') AS verdict
FROM p LEFT JOIN c ON c.x = {node('p.url')}
"""


def op9() -> str:
    """Every unit against every template whose size fits, by counting common bigrams."""
    t = licence_scan.MIN_DICE
    rows = []
    for k, (name, text) in enumerate(licence_scan.TEMPLATES):
        grams = licence_scan.template_bigrams(text)
        rows.append(f"({k}, '{name}', [{', '.join(chr(39) + g + chr(39) for g in grams)}])")
    pattern = licence_scan.COPYRIGHT
    norm = (f"trim(regexp_replace({_lower(f"regexp_replace(u, '{pattern}', ' ', 'g')")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))")
    return f"""
WITH t(k, name, grams) AS (VALUES {', '.join(rows)}),
lines AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS u FROM documents),
paras AS (SELECT doc_id, 'paragraph' AS unit, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS u FROM documents),
units AS (SELECT doc_id, u FROM lines
          UNION ALL SELECT doc_id, u FROM paras WHERE contains(u, chr(10))
          UNION ALL SELECT doc_id, text FROM documents WHERE len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) > 1),
n AS (SELECT doc_id, row_number() OVER () AS id, string_split({norm}, ' ') AS w FROM units),
g AS (SELECT doc_id, id, list_distinct([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) AS grams FROM n
      WHERE len(w) >= 2),
d AS (SELECT doc_id, id, k, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
      FROM g JOIN t ON list_has_any(g.grams, t.grams)),
b AS (SELECT doc_id, id, max(struct_pack(dice := dice, rank := -k, name := name)) AS best FROM d
      WHERE dice >= {float(t)} GROUP BY doc_id, id),
h AS (SELECT doc_id, max(best) AS best, count(*) AS n_hits FROM b GROUP BY doc_id)
SELECT x.doc_id, h.best.name AS licence, h.best.dice::DOUBLE AS dice, coalesce(n_hits, 0) AS n_hits
FROM documents x LEFT JOIN h USING (doc_id)
"""


# CRC-32 bit by bit, turns as 64 hex digits, nodes as the digits of their path, subtree sums by listing each node's ancestors.
OP13 = """
WITH t AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS size,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(size ORDER BY turn NULLS FIRST, id) AS sizes FROM t GROUP BY c),
h AS (SELECT *, c - c % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
          list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 6 AS h FROM o),
r AS (SELECT h.c, CASE WHEN h = 0 THEN h.ids ELSE list_concat(coalesce(b.ids, [])[1 : h], h.ids[h + 1 :]) END AS ids,
             CASE WHEN h = 0 THEN h.sizes ELSE list_concat(coalesce(b.sizes, [])[1 : h], h.sizes[h + 1 :]) END AS sizes
      FROM h LEFT JOIN o b ON b.c = h.base),
p AS (SELECT c, ids, sizes, unnest(range(0, len(ids) + 1)) AS d FROM r),
n AS (SELECT array_to_string(ids[1 : d], '') AS node, d, min(c) AS low, count(*) AS n,
             any_value(CASE WHEN d > 0 THEN sizes[d] ELSE 0 END) AS size,
             string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len(ids)) AS ends FROM p GROUP BY node, d),
k AS (SELECT left(node, 64 * (d - 1)) AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT n.node, size, n, kids, unnest(range(0, d + 1)) AS up FROM n LEFT JOIN k USING (node)),
s AS (SELECT left(node, 64 * up) AS node, sum((n - 1) * size)::BIGINT AS gain, count(*) FILTER (WHERE kids IS NULL) AS leaves
      FROM e GROUP BY 1)
SELECT n.low AS conv_id, n.d::BIGINT AS depth, up.low AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
       leaves AS n_leaves, gain AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n up ON n.d > 0 AND up.node = left(n.node, 64 * (n.d - 1))
"""

ORACLE = {"op3_line_dedup": op3(), "op3_line_dedup_windows": op3(min_words=None), "op5_ngram_jaccard": OP5, "op6_url_aliases": op6(), "op9_licence_scan": op9(),
          "op10_bloom_dedup": OP10, "op13_prefix_trie": OP13}
