"""op13: tree layouts, walks over ranges, and whole results against a plain dictionary of prefixes and SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewire.llm import prefix_trie as pt
from pricewire.llm.queries import QUERIES
from pricewire.llm.sql import OP13

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, node long"
IDS = [bytes([i]) * 16 + (n).to_bytes(4, "big") for i, n in ((0, 0), (0, 1), (0, 256), (7, 3), (255, 9))]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(convs):
    """{prefix: [low, count, children, leaves, saved, ends]} of {conv_id: tuple of (key, size)}."""
    at = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            at[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in at:
        if p:
            kids[p[:-1]] += 1
    out = {p: [min(cs), len(cs), kids[p], 0, 0, [c for c in sorted(cs) if len(convs[c]) == len(p)]] for p, cs in at.items()}
    for p, cs in at.items():
        for d in range(len(p) + 1):
            out[p[:d]][3] += kids[p] == 0
            out[p[:d]][4] += (len(cs) - 1) * (p[-1][1] if p else 0)
    return out


def plain_rows(rows):
    """The whole query on [(conv_id, turn, role, text)], in plain Python."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, ((role, text), len(text))))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - int(c - 100 * int(c / 100)), [])[:h] + own[c][h:])
    nodes = plain_nodes(convs)
    return sorted((low, len(p), nodes[p[:-1]][0] if p else None, n, k, leaves, gain,
                   hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
                  for p, (low, n, k, leaves, gain, ends) in nodes.items()) if convs else []


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_layouts_grow_and_keep_order():
    root = pt.Node(b"")
    seen = set()
    for n in range(256):
        pt.insert(root, bytes([(n * 37) % 256, n]), 1, n)
        seen.add(root.layout)
        assert len(root.children()) == n + 1
    assert seen == {4, 16, 48, 256}
    assert [b for b, _ in root.children()] == list(range(256))
    assert all(root.child((n * 37) % 256).low == n for n in range(256)) and root.children()[0][1].path == b"\x00"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(IDS), max_size=5), min_size=1, max_size=25), st.integers(1, 6))
def test_ranges_add_up_to_plain_prefixes(lists, ranges):
    convs = {i: tuple((x, int.from_bytes(x[16:], "big")) for x in v) for i, v in enumerate(lists)}
    keys = defaultdict(list)
    for i, v in enumerate(lists):
        keys[b"".join(v)].append(i)
    order = sorted(keys)
    cuts = [order[i * len(order) // ranges:(i + 1) * len(order) // ranges] for i in range(ranges)]
    cuts = [c for c in cuts if c]
    total = {}
    for i, part in enumerate(cuts):
        root = pt.Node(b"")
        for k in reversed(part):
            pt.insert(root, k, len(keys[k]), min(keys[k]))
        for node, parent, depth, low, parent_low, *sums in pt.walk(
                root, cuts[i - 1][-1] if i else None, cuts[i + 1][0] if i + 1 < len(cuts) else None):
            if node in total:
                t = total[node]
                assert t[:2] == [parent, depth] and parent_low is None
                total[node] = [parent, depth, min(t[2], low), None, *[a + b for a, b in zip(t[4:], sums)]]
            else:
                total[node] = [parent, depth, low, parent_low, *sums]
    want = plain_nodes(convs)
    assert len(total) == len(want)
    for p, (low, count, kids, leaves, gain, _) in want.items():
        name = hashlib.sha256(b"".join(x for x, _ in p)).digest()[:16]
        parent, depth, l2, up, *sums = total[name]
        assert [depth, l2, *sums] == [len(p), low, count, kids, leaves, gain]
        assert not p or parent == hashlib.sha256(b"".join(x for x, _ in p[:-1])).digest()[:16]
        assert up is None or up == want[p[:-1]][0]


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_query_equals_plain_and_sql(spark, ranges):
    table = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    want = plain_rows([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    same(result(pt.prefix_trie(table, ranges)), want)
    if ranges == 1:
        same(result(QUERIES["op13_prefix_trie"](spark, SF_SMALL)), want)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
        res = con.execute(OP13)
        assert [c[0] for c in res.description] == COLUMNS
        same(res.fetchall(), want)


def test_copies_and_a_common_first_turn(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 7)
    rows = [(c, t, "user", f"text {t}") for c in range(100, 200) for t in range(7)]  # one conversation a hundred times
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(200, 320) for t in range(6)]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)
    same(result(pt.prefix_trie(df, 6)), plain_rows(rows))


def test_defined_cases(spark):
    def run(rows, **kw):
        return result(pt.prefix_trie(spark.createDataFrame([(*r, 3, "k", None) for r in rows], SCHEMA), **kw))
    rows = [(5, None, "user", "first"), (5, 0, None, None), (5, 0, "", ""), (5, 2, "a", "b"), (5, 2, "a", "b"), (5, 2, "", "ab"),
            (0, 1, "user", "é" * 3000), (0, 2, "user", "x\ny"), (107, 1, "user", "alone"), (-3, 1, "u", "t"), (-100, 4, "u", "z"),
            (-107, 1, "u", "w"), (2 ** 60, 1, "u", "w"), (2 ** 60, 2, "u", "w")]
    same(run(rows + [(None, 1, "user", "nobody")]), plain_rows(rows))
    assert run([]) == [] and run([(None, 1, "user", "nobody")]) == []
    # Conversation 107 has fewer turns than it takes from an absent one: it has no turns, but is a member of the root.
    assert zlib.crc32(b"107") % 6 > 0
    empty = hashlib.sha256(b"107").hexdigest()
    assert run([(107, 1, "user", "alone")]) == [(107, 0, None, 1, 0, 1, 0, empty)]
