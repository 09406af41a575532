"""License scans: templates, bounds, anchors, defined cases, and a brute-force Dice."""

import random
import re

from pricewire.llm import licence_scan as ls


def _norm(text):
    text = re.sub(r"(?im)^[ \t]*(copyright|\(c\)|©)[^\n]*$", " ", text)
    return re.findall(r"[^\W_]+", text.translate(str.maketrans(*ls.AZ)))


def _grams(text):
    w = _norm(text)
    return set(zip(w, w[1:], strict=False))


def _brute(text):
    if text is None:
        return None, None, 0
    units = text.split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p]
    units += [text] if re.search(r"\n[ \t\r]*\n", text) else []
    best = []
    for u in units:
        g = _grams(u)
        scores = [(2.0 * len(g & t) / (len(g) + len(t)), -k, name) for k, (name, body) in enumerate(ls.TEMPLATES)
                  for t in [_grams(body)] if g]
        if scores and max(scores)[0] >= 0.8:
            best.append(max(scores))
    return (*((max(best)[2], max(best)[0]) if best else (None, None)), len(best))


def _wrapped(text, width):
    w = text.split()
    return "\n".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    by = dict(ls.TEMPLATES)
    texts = [None, "", "\n\n", "licence", "x " * 100_000 + "\n" + by["MIT-notice"]]
    texts += [f"some words\n{body}\nmore words" for body in by.values()]
    texts += [f"intro\n\nCopyright (c) 2020 A. Person\n{_wrapped(by[n], 9)}\n\nend of file" for n in ("MIT", "ISC", "GPL-3.0")]
    for _ in range(60):  # words dropped, added and changed
        name, body = rng.choice(ls.TEMPLATES)
        w = [x if rng.random() > 0.08 else rng.choice(["", "zz", x + " yy"]) for x in body.split()]
        texts.append("\n".join(["The start.", " ".join(w).upper() if rng.random() < 0.3 else " ".join(w), "End."]))
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, dice double")
    got = {r.doc_id: (r.licence, r.dice, r.n_hits) for r in ls.licence_scan(df).collect()}
    assert got == {i: _brute(t) for i, t in enumerate(texts)}
    assert sum(g[0] is not None for g in got.values()) > 40
    wrapped = next(i for i, t in enumerate(texts) if t and "Copyright" in t)
    assert got[wrapped][0] == "MIT"


def test_size_bounds_are_those_of_dice():
    for n in range(1, 60):
        low, high = ls.size_bounds(n)
        for m in range(1, 150):
            assert (2 * min(n, m) / (n + m) >= 0.8) == (low <= m <= high)


def test_every_reaching_unit_has_an_anchor():
    words = set(ls.anchors())
    for _, body in ls.TEMPLATES:
        grams = ls.template_bigrams(body)
        without = [g for g in grams if not words & set(g.split())]
        assert len(without) < ls.size_bounds(len(grams))[0]


def test_empty_table(spark):
    assert ls.licence_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
