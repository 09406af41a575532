"""Python literals as JSON text, in built-in expressions only.

A line is cut into tokens by one regular expression; each token is rewritten on its own (strings with their escapes, numbers,
``None``/``True``/``False``, brackets), so quotes and prefixes inside strings are never touched, and the tokens are
joined to JSON.

Read: dicts, lists and tuples in any nesting with trailing commas; strings in both quotes, once or three times, with the
prefixes u, b, r, ur, br and all escapes of Python 3, side by side joined to one; integers (also ``1L``, hexadecimal, octal, binary,
``1_000``), floats and complex numbers, which become JSON strings of their text.  Not read (the result is NULL): everything else,
also sets, tuples and names as keys, and ``\\N{...}``.  Parentheses always make a list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Unicode keeps out of texts stand for escaped backslashes and quotes while a line is cut (so a string ends at the
# next plain quote) and for the outer marks of JSON while tokens are joined.
_BACK, _ONE, _TWO, _OPEN, _CLOSE, _COMMA, _NONE = (chr(0xFDD0 + i) for i in range(7))
_PREFIX = r"(?:[uU]|[bB][rR]?|[rR][bB]?|[uU][rR])?"
_STRING = "|".join(rf"{_PREFIX}{q * 3}(?s:.*?){q * 3}|{_PREFIX}{q}[^{q}]*+{q}" for q in "'\"")
_REAL = r"(?:0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+|(?:[0-9][0-9_]*+\.?[0-9_]*+|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_NUMBER = rf"[+-]?\s*{_REAL}[lLjJ]?(?:\s*[+-]\s*{_REAL}[jJ])?"
_TOKEN = rf"{_STRING}|{_NUMBER}|[A-Za-z_]\w*+|\s++|(?s:.)"
_ESCAPE = (rf"\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}|\\U[0-9a-fA-F]{{8}}|\\[0-7]{{1,3}}|\\(?s:.)|[{_BACK}{_ONE}{_TWO}]"
           rf"|[^\\{_BACK}{_ONE}{_TWO}]++")
# Two values without a comma between them, or a comma without a value before it.
_BAD = r"[\]}no][\[{sno]|s[\[{no]|[\[{:,],|^,"


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _u(code: Column) -> Column:
    """A number as a JSON escape."""
    return F.concat(F.lit("\\u"), F.lpad(F.hex(code.cast("long")), 4, "0"))


def _number(digits: Column, base: int) -> Column:
    return F.conv(digits, base, 10).cast("long")


def _escape(e: Column) -> Column:
    """One escape, mark or run of plain characters as JSON."""
    kind = F.substring(e, 2, 1)
    low = _number(F.substring(e, 3, 8), 16) - 0x10000
    wide = F.when(low < 0, _u(low + 0x10000)).otherwise(F.concat(_u(F.lit(0xD800) + F.floor(low / 1024)), _u(F.lit(0xDC00) + low % 1024)))
    return (F.when(e == _BACK, F.lit("\\\\")).when(e == _ONE, F.lit("'")).when(e == _TWO, F.lit('\\"'))
            .when(~F.startswith(e, F.lit("\\")), _swap(e, ('"', '\\"')))
            .when((kind == "x") & (F.length(e) == 4), _u(_number(F.substring(e, 3, 2), 16)))
            .when((kind == "u") & (F.length(e) == 6), e)
            .when((kind == "U") & (F.length(e) == 10), wide)
            .when(kind.rlike("[0-7]"), _u(_number(F.substring(e, 2, 3), 8)))
            .when(kind.isin("n", "t", "r", "b", "f"), e)
            .when(kind == "a", F.lit("\\u0007")).when(kind == "v", F.lit("\\u000b"))
            .otherwise(F.concat(F.lit("\\\\"), kind)))


def _string(t: Column) -> Column:
    """A string token as JSON between marks."""
    prefix = F.lower(F.regexp_extract(t, "^([a-zA-Z]*)", 1))
    quoted = F.substring(t, F.length(prefix) + 1, F.length(t))
    width = F.when(quoted.rlike("^('{3}|\"{3})") & (F.length(quoted) >= 6), 3).otherwise(1)
    body = F.substring(quoted, width + 1, F.length(quoted) - 2 * width)
    raw = _swap(body, ("\\", "\\\\"), ('"', '\\"'), (_BACK, "\\\\\\\\"), (_ONE, "\\\\'"), (_TWO, '\\\\\\"'))
    cooked = F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_ESCAPE), F.lit(0)), _escape), "")
    return F.concat(F.lit(_OPEN), F.when(F.contains(prefix, F.lit("r")), raw).otherwise(cooked), F.lit(_CLOSE))


def _token(t: Column) -> Column:
    """(kind, marked JSON) of a token; kind NULL for what no literal holds."""
    def made(kind: str, json: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), json.alias("json"))
    out = F.when(t.rlike(rf"^(?:{_STRING})$"), made("s", _string(t)))
    out = out.when(t.rlike(rf"^(?:{_NUMBER})$"), made("n", F.concat(F.lit(_OPEN), F.regexp_replace(t, r"[\s_lL]", ""), F.lit(_CLOSE))))
    for text, kind, json in (("None", "o", _NONE), ("True", "o", "true"), ("False", "o", "false"), (",", ",", _COMMA), ("(", "[", "["),
                             (")", "]", "]"), ("[", "[", "["), ("]", "]", "]"), ("{", "{", "{"), ("}", "}", "}"), (":", ":", ":")):
        out = out.when(t == text, made(kind, F.lit(json)))
    return out


def literal_to_json(line: Column) -> Column:
    """The JSON text of a line that holds Python literals (more than one are joined by commas, as in a tuple without parentheses);
    NULL where it holds anything else."""
    cut = _swap(line, ("\\\\", _BACK), ("\\'", _ONE), ('\\"', _TWO))
    tokens = F.filter(F.regexp_extract_all(cut, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^\s+$"))
    made = F.transform(tokens, _token)
    shape = F.array_join(F.transform(made, lambda m: m["kind"]), "")
    even = F.length(F.regexp_replace(shape, r"[^\[{]", "")) == F.length(F.regexp_replace(shape, r"[^\]}]", ""))
    text = _swap(F.array_join(F.transform(made, lambda m: m["json"]), ""), (_CLOSE + _OPEN, ""))
    text = F.regexp_replace(text, rf"{_COMMA}(?=[\]}}]|$)", "")
    text = _swap(text, (_OPEN, '"'), (_CLOSE, '"'), (_COMMA, ","), (_NONE, "null"))
    return F.when(~F.exists(made, lambda m: m.isNull()) & ~shape.rlike(_BAD) & even & (F.size(tokens) > 0), text)
