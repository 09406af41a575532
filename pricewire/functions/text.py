"""Text column expressions.

All functions take and return ``Column`` objects built from Spark SQL string
and array functions, so they run in the JVM, work on batch and streaming
DataFrames alike, and need no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Contraction rewrites, applied in this order (pattern, replacement):
CONTRACTIONS = [
    ("'ve", " have"),
    ("'re", " are"),
    ("'d", " would"),
    ("'ll", " will"),
    ("can't", " cannot"),
    ("n't", " not"),
    ("'m", " am"),
    ("'s", " has"),
]
# End-of-sentence marks and the text written for each.
SENTENCE_MARKS = [(r"\.", " <EOS>"), (r"\?", " <EOS>"), (r"\!", " <EOS>")]
# Characters kept after cleaning (letters, hyphen, space, newline).
DISALLOWED = r"[^a-zA-Z\- \n]"
# Runs of the kept characters: what is left when every DISALLOWED character is removed.
ALLOWED_RUN = r"[a-zA-Z\- \n]+"
# Runs of two or more whitespace characters become one space.
WHITESPACE_RUN = r"\s{2,}"
# Word-tokeniser splits applied to cleaned text: double dash set apart, and
# fixed words split in two (the second part of "wanna" only before a space or end).
TOKEN_SPLITS = [
    (r"--", " -- "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gim)(me)\b", "$1 $2"),
    (r"(?i)\b(gon)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(lem)(me)\b", "$1 $2"),
    (r"(?i)\b(wan)(na)(\s|$)", "$1 $2$3"),
]
# Default vectoriser token: two or more word characters.
VECTOR_TOKEN = r"(?U)\b\w\w+\b"
# ---------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    """Lower-case ASCII letters only (byte-string ``lower`` semantics).

    ``lower()`` in the JVM is Unicode-aware and maps e.g. U+0130 to an ASCII
    ``i``; ``translate`` keeps every non-ASCII character for the later
    removal step, which is what the reference's byte strings do.
    """
    return F.translate(_col(c), _UPPER, _LOWER)


def _replace_chain(c: Column, rules) -> Column:
    for pattern, repl in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(repl))
    return c


def _expand_contractions(low: Column) -> Column:
    # every contraction pattern contains an apostrophe: texts without one skip
    # the eight regex passes (same result, one substring test instead)
    return F.when(F.instr(low, "'") > 0, _replace_chain(low, CONTRACTIONS)).otherwise(low)


def _keep_allowed(c: Column) -> Column:
    """``c`` without the DISALLOWED characters, as its joined runs of allowed ones: looking for the negated class takes the
    JVM about 15 times as long (18 s and 1.1 s over the same 0.1 GB)."""
    return F.array_join(F.regexp_extract_all(c, F.lit(ALLOWED_RUN), F.lit(0)), "")


def clean_text(c) -> Column:
    """Lower-case, expand contractions, keep ``[a-z- \\n]``, squeeze whitespace."""
    out = _expand_contractions(ascii_lower(c))
    out = _keep_allowed(out)
    return F.regexp_replace(out, F.lit(WHITESPACE_RUN), F.lit(" "))


def clean_text_sentences(c) -> Column:
    """As T1, but ``. ? !`` become an ``EOS`` token (``<`` and ``>`` are dropped)."""
    out = _replace_chain(_expand_contractions(ascii_lower(c)), SENTENCE_MARKS)
    out = _keep_allowed(out)
    return F.regexp_replace(out, F.lit(WHITESPACE_RUN), F.lit(" "))


def has_clean_text(c, sentences: bool = False) -> Column:
    """True when ``clean_text`` (or ``clean_text_sentences``) of ``c`` is not empty.

    Cleaning keeps exactly the characters ``[a-zA-Z- \\n]`` and every
    rewrite inserts letters, so this is a test on the raw text.  Filtering on
    it (instead of on the cleaned column) keeps the optimiser from copying the
    whole cleaning chain into the filter, which would run it twice.
    """
    return _col(c).rlike(r"[a-zA-Z\- \n.?!]" if sentences else r"[a-zA-Z\- \n]")


def pub_day(c) -> Column:
    """T4: publication day from ``YYYY-MM-DDThh:mm:ssZ`` text (or a plain date)."""
    return F.to_date(F.regexp_replace(_col(c), F.lit(r"T.*?Z"), F.lit("")))


def pub_day_split(c) -> Column:
    """T4 (metadata form): text before ``T`` as a date."""
    return F.to_date(F.split(_col(c), "T").getItem(0))


# Words the tokeniser splits (case-insensitive); used as one guard test.
_SPLIT_WORDS = r"(?i)(--|cannot|gimme|gonna|gotta|lemme|wanna)"


def tokenize(c) -> Column:
    """T5: word tokens of *cleaned* text (array<string>).

    The seven split rewrites only run on texts that contain one of the split
    words (one guard test instead of seven regex passes)."""
    x = _col(c)
    spaced = F.when(x.rlike(_SPLIT_WORDS), _replace_chain(x, TOKEN_SPLITS)).otherwise(x)
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != F.lit(""))


def vector_tokens(c) -> Column:
    """Vectoriser tokens, lower-cased words of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(VECTOR_TOKEN), 0)


def ngrams(tokens, max_order: int, min_order: int = 1) -> Column:
    """All n-grams of order ``min_order..max_order``, unigrams first.

    The n-grams of order n zip n shifted slices of the token array (one pass,
    no per-gram slice), so it stays one projection.
    """
    tok = _col(tokens)
    parts = []
    for n in range(min_order, max_order + 1):
        if n == 1:
            parts.append(tok)
            continue
        length = F.size(tok) - F.lit(n - 1)
        shifted = [F.slice(tok, k + 1, length) for k in range(n)]
        if n == 2:
            grams = F.zip_with(shifted[0], shifted[1], lambda a, b: F.concat(a, F.lit(" "), b))
        else:
            zipped = F.arrays_zip(*[sh.alias(f"p{k}") for k, sh in enumerate(shifted)])
            grams = F.transform(zipped, _join_fields(n))
        # fewer tokens than n: no grams (slice would get a negative length)
        parts.append(F.when(F.size(tok) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _join_fields(n: int):
    # one-argument lambda: Spark passes (element, index) to two-argument ones
    return lambda r: F.concat_ws(" ", *[r[f"p{k}"] for k in range(n)])


def join_tokens(tokens) -> Column:
    """Tokens back to one space-separated string."""
    return F.array_join(_col(tokens), " ")
