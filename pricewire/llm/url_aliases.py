"""URL filters with redirect equivalence.

A url's own verdict is that of the longest rule that fits its host (or a parent domain) and path prefix.
Pages also name other addresses of themselves: ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``.  These
edges join urls into alias classes (distributed connected components).  A url that no rule fits takes the
decision of its class: allow if any member is explicitly allowed, else block if any is blocked, else allow.

Defined cases: a null url or one without ``://`` has empty host and path, no rule, no aliases, and is allowed; a url with
``://`` but no scheme at its start (``/login?next=https://b.org/``) has a host, as the rule on hosts says, but no aliases; named
addresses of another kind (``mailto:``, ``javascript:``) and null html name nothing; entities in a named address are decoded; repeated rows are judged alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewire.llm.common import saved
from pricewire.llm.graph import connected_components

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The rules that a pages query judges by (verdict, host followed by path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
# The value of href in a canonical link tag, and the target of a refresh tag.
LINK = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["'\s][^>]*>"""
HREF = r"""(?is)href\s*=\s*["']?([^"'\s>]+)"""
META = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["'\s][^>]*>"""
GOTO = r"""(?is)url\s*=\s*["']?([^"'\s>]+)"""
# A scheme stands at the start of an address, before any slash, question mark or hash.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
# The entities that an address in an attribute may hold, the ampersand last.
ENTITIES = ((r"&(quot|#34|#x22);", '"'), (r"&(apos|#39|#x27);", "'"), (r"&(lt|#60|#x3[Cc]);", "<"), (r"&(gt|#62|#x3[Ee]);", ">"),
            (r"&(#47|#x2[Ff]);", "/"), (r"&(#58|#x3[Aa]);", ":"), (r"&(amp|#38|#x26);", "&"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *AZ), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits; ``rules`` becomes one CASE expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def node_of(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, fragment cut; null if it does not begin with a scheme and ``://``."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme, rest = F.translate(F.regexp_extract(bare, r"(?s)^(.*?)://", 1), *AZ), F.regexp_extract(bare, r"(?s)://[^/?]*(.*)$", 1)
    return F.when(url.rlike(SCHEME + "//"), F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolve(base: Column, ref: Column) -> Column:
    """``ref`` as found on the page ``base``: absolute, scheme-relative, root-relative, a query or relative; else null."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"(?s)://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (F.when(ref.isNull() | (ref == ""), None).when(ref.rlike(SCHEME + "//"), ref).when(ref.rlike(SCHEME), None)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref.startswith("#"), None)
            .when(ref.startswith("?"), F.concat(origin, path_of(base), ref))
            .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), ref)))


def decoded(ref: Column) -> Column:
    for pattern, sign in ENTITIES:
        ref = F.regexp_replace(ref, pattern, sign)
    return ref


def alias_edges(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> distinct (src, dst) node strings of canonical links and redirects."""
    targets = F.array(F.regexp_extract(F.regexp_extract("html", LINK, 0), HREF, 1),
                      F.regexp_extract(F.regexp_extract("html", META, 0), GOTO, 1))
    found = pages.filter("url is not null and html is not null").select("url", F.explode(targets).alias("ref"))
    found = found.withColumn("ref", decoded(F.col("ref")))
    e = found.filter("ref <> ''").select(node_of(F.col("url")).alias("src"),
                                         node_of(resolve(F.col("url"), F.col("ref"))).alias("dst"))
    return e.filter("src is not null and dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, host, path, rule, verdict, alias_verdict (null: the class has no decision)."""
    pages = pages.select("page_id", "url", "html")
    edges = saved(alias_edges(pages))
    ids = edges.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v"))
    comp = connected_components(ids)
    url = F.col("url")
    own_rule, own = rule_of(F.col("host"), F.col("path"), rules)
    mine = (pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"),
                         F.xxhash64(node_of(url)).alias("node"))
            .withColumn("rule", own_rule).withColumn("own", own))
    # Only nodes on an edge can have aliases, so a class's decisions come from the edge table alone.
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    decided = (nodes.withColumn("node", F.xxhash64("url"))
               .withColumn("says", rule_of(host_of(url), path_of(url), rules)[1]).filter("says is not null"))
    classes = (decided.join(comp, "node").groupBy("component")
               .agg(F.min("says").alias("alias_verdict")))  # 'allow' sorts before 'block'
    aliases = comp.join(classes, "component").select("node", "alias_verdict")
    return (mine.join(aliases, "node", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict"))
