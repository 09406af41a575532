"""Python literals read by built-in expressions, against ``ast.literal_eval``."""

import ast
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewire.functions.literals import literal_to_json
from pricewire.sources import files as S


def read(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = df.select("i", literal_to_json(F.col("value")).alias("j")).collect()
    return [r.j for r in sorted(got)]


def same(value):
    """A literal as the JSON form keeps it: numbers as texts, tuples and lists alike."""
    if isinstance(value, dict):
        return {same(k): same(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [same(v) for v in value]
    if isinstance(value, bytes):
        return value.decode("latin-1")
    return value


FORMS = [
    r"""{'a': 'b'}""", r"""{u'a': u"It's", 'c': u'say "no"'}""", r"""["\xe9", 'é\U0001F600', '\101\0', 'tab\there', '\a\v\b\f\r\n']""",
    r"""['\\', '\\\'', "\\\"", '\'"', "'\"", '\q\ ', r'\n\\', ur'x' 'y', R"a\'b", '']""".replace("ur'x'", "'x'"),
    r"""{'x': None, 'y': True, 'z': False, 'None': ['True', 'u', "u'"], }""", r"""('a', 'b',)""", r"""[('a', ('b',), []), {}, ()]""",
    r"""['''it's "so"''', '''''', """ + '"""x\'\'y"""]', r"""['a' "b" u'c', 'd' 'e']""", r"""[b'\xff\x00', rb'\x', bR"q"]""",
    """{'k:,]}': '[{(,', "u'": ' u\\'x\\' '}""", "['a\tb']", "['é' , '日本', '\\\\u0041']", "{'d': {'e': [{'f': 'g'}, {'h': 'i'}]}}",
]
REJECTS = ["", " ", "{'a': }", "{'a' 'b'", "['a' ['b']]", "[a]", "{'a': 'b'}}", "['a', , 'b']", "[,]", "nan", "{'a': 'b'} x", "'open",
           "print('x')", "['a'] ['b']", "[1 2]", "['a' 1]", "{'a': lambda: 0}", "['a'; 'b']", "not json at all", "<html>"]


def test_forms_equal_literal_eval(spark):
    for text, got in zip(FORMS, read(spark, FORMS)):
        assert got is not None, text
        assert json.loads(got, strict=False) == same(ast.literal_eval(text)), text


def test_numbers_keep_their_text(spark):
    lines = ["[1, -2, 1L, 0x1F, 0o17, 0b1, 1_000, 1., .5, -1e-5, 1+2j, {3: 4}]"]
    got = json.loads(read(spark, lines)[0])
    assert got == ["1", "-2", "1", "0x1F", "0o17", "0b1", "1000", "1.", ".5", "-1e-5", "1+2j", {"3": "4"}]


def test_others_are_rejected(spark):
    for text, got in zip(REJECTS, read(spark, REJECTS)):
        ok = True
        try:
            json.loads(got) if got is not None else 1 / 0
        except (ValueError, ZeroDivisionError):
            ok = False
        assert not ok, (text, got)


VALUES = st.recursive(st.none() | st.booleans() | st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=12), lambda v:
                      st.lists(v, max_size=4) | st.dictionaries(st.text(st.sampled_from("ab'\"\\,:{}[]u "), max_size=5), v, max_size=4), max_leaves=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(VALUES, min_size=20, max_size=20))
def test_written_literals_come_back(spark, values):
    lines = [f(v).replace("\n", " ") for v in values for f in (repr, ascii)]
    for text, got in zip(lines, read(spark, lines)):
        assert got is not None and json.loads(got, strict=False) == ast.literal_eval(text), text


def test_long_strings_with_many_escapes(spark):
    text = "{'a': '" + "\\'\\\\\\xe9x" * 30000 + "'}"
    assert json.loads(read(spark, [text])[0]) == ast.literal_eval(text)


def test_metadata_lines(spark, tmp_path):
    lines = [r"""{u'response': {u'docs': [{u'_id': u'1', u'pub_date': u'2013-01-02T03:04:05Z', u'n': 1L, u'x': None}]}, u'ok': True}""",
             r"""{'response': {'docs': [{'_id': u"It's", 'pub_date': '2013-01-03T00:00:00Z', 'h': 'say u\'hi\' \xe9'}, {'_id': '3', 'pub_date': None}]}}""",
             r"""{'response': {'docs': []}}""", r"""{'response': {}}""", r"""{'response': {'docs': [{'_id': 'x'}]}}, {}""", "garbage", "",
             r"""{"response": {"docs": ({"_id": "9", "pub_date": "2014-05-06T",},)}}"""]
    (tmp_path / "2013_acme-json.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = [tuple(r) for r in S.src_article_meta(spark, str(tmp_path)).orderBy("line_no", "_id").select(
        "line_no", "parsed", "_id", F.col("day").cast("string"), "company").collect()]
    assert got == [(0, True, "1", "2013-01-02", "acme"), (1, True, "3", None, "acme"), (1, True, "It's", "2013-01-03", "acme"),
                   (3, False, None, None, "acme"), (4, False, None, None, "acme"), (5, False, None, None, "acme"),
                   (6, False, None, None, "acme"), (7, True, "9", "2014-05-06", "acme")]
