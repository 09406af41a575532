"""URL filters: parsing, rules and alias classes."""

from pricewire.llm.url_aliases import alias_edges, judge


def _canon(href):
    return f"<html><head><LINK href='{href}' rel=\"canonical\"></head></html>"


def _go(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


PAGES = [
    (1, "https://Ex.ORG/a", _canon("http://example.com/en/x")),      # its alias is blocked by a rule
    (2, "https://ex.org/b", _go("https://ex.org/a")),                # reaches it over a redirect
    (3, "https://ex.org/c#top", _canon("/d")),
    (4, "https://ex.org/d", _canon("//www.example.com/en/ok")),      # an allowed alias
    (5, "https://ex.org/e", _canon("d")),                            # relative: joins 3 and 4
    (6, "https://x.net/es/1", None),                                 # own rule
    (7, "https://x.net/es/2", _canon("https://plain.com/")),         # own block stays, despite an allowed alias
    (8, "https://ex.org/f", _canon("https://x.net/es/2")),           # explicit allow in the class wins over the block
    (9, None, _canon("https://x.net/es/1")),
    (10, "no scheme", "<p>"),
    (11, "http://example.com/en/x?q=1", None),
    (12, "http://sub.www.example.com/en/", None),
    (13, "http://example.com", None),                                # empty path fits no rule
    (14, "ftp://badexample.com/en/", None),                          # not a subdomain of example.com, but com/ fits
    (6, "https://x.net/es/1", None),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in judge(df).collect()}
    assert judge(df).count() == len(PAGES)
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {
        1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"),
        6: ("net/es/", "block"), 7: ("net/es/", "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"),
        11: ("example.com/en/", "block"), 12: ("www.example.com/en/", "allow"), 13: (None, "allow"), 14: ("com/", "allow")}
    assert (got[1].host, got[1].path) == ("ex.org", "/a")
    assert (got[3].host, got[3].path) == ("ex.org", "/c")
    assert (got[9].host, got[9].path, got[10].host, got[10].path) == ("", "", "", "")
    assert (got[13].host, got[13].path) == ("example.com", "")


def test_edges_and_empty_tables(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert ("https://ex.org/c", "https://ex.org/d") in {tuple(r) for r in alias_edges(df).collect()}
    assert judge(df.limit(0)).collect() == []


ODD = [
    (1, "https://a.org/", _go("/login?next=https://b.org/")),        # a path of a.org, though it holds ://
    (2, "https://a.org/login?next=https://b.org/", _canon("https://q.org/x?u=1&amp;v=2")),
    (3, "https://q.org/x?u=1&v=2", _canon("https:&#x2F;&#47;x.net/es/9")),
    (4, "https://a.org/m", _canon("mailto:x@x.net")),
    (5, "https://a.org/p?q=1", _canon("?q=2")),
    (6, "/login?next=https://x.net/es/", _canon("https://x.net/es/9")),   # judged by its host, but no node
    (7, "https://b.org/", None),
    (8, "https://a.org/n", _canon("javascript:go('x')")),
]


def test_addresses_with_odd_forms(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string")
    assert {tuple(r) for r in alias_edges(df).collect()} == {
        ("https://a.org/", "https://a.org/login?next=https://b.org/"),
        ("https://a.org/login?next=https://b.org/", "https://q.org/x?u=1&v=2"),
        ("https://q.org/x?u=1&v=2", "https://x.net/es/9"), ("https://a.org/p?q=1", "https://a.org/p?q=2")}
    got = {r.page_id: r for r in judge(df).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "block", "block", "allow", "allow", "block", "allow", "allow"]
    assert (got[6].host, got[6].path, got[6].rule) == ("x.net", "/es/", "net/es/")


def test_sql_agrees_on_aliases(spark, tmp_path):
    import duckdb

    from pricewire.llm.sql import op6
    rows = [*PAGES, *[(100 + i, u, h) for i, u, h in ODD]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = sorted(map(str, con.execute(op6()).fetchall()))
    assert sorted(str(tuple(r)) for r in judge(df).drop("alias_verdict").collect()) == want
