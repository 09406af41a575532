"""N-gram Jaccard join against all pairs in plain Python."""

import random
import re

import pytest

from pricewire.llm import ngram_join as nj


def _set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _brute(rows, k, percent):
    sets = [_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def _corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocab, k=40))
    base = " ".join(rng.choices(vocab, k=90)).split()
    texts = []
    for _ in range(45):       # one large group with few to many edits, so links are partly chains
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(w))
            w[p:p + 1] = rng.choice([[], [rng.choice(vocab)], [w[p], "new"]])
        texts.append(" ".join(w))
    for _ in range(40):       # a common passage in short and long texts
        own = " ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 30])))
        texts.append(f"{own} {passage}" if rng.random() < .5 else f"{passage} {own}")
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 30))) for _ in range(40)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "One Two", "a b c d e", "a b c d E", "É x y z", "é x y z"]
    texts += [texts[3]] * 6 + [texts[50].upper()] + ["same words " * 30, "words same " * 30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_components_match_all_pairs(spark, k, percent, seed):
    rows = _corpus(seed) + [(None, "one two"), (None, "quite alone here"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, label int").repartition(4)
    got = nj.near_duplicates(df, k, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == _brute(rows, k, percent)


def test_more_fragments_change_nothing(spark, monkeypatch):
    rows = _corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nj, "FRAGMENTS", 1)
    one = sorted(map(tuple, nj.near_duplicates(df).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(nj, "FRAGMENTS", 300)
    assert one == sorted(map(tuple, nj.near_duplicates(df).select("doc_id", "component_id").collect()))
    assert one == sorted((d, c) for d, _, c in _brute(rows, 5, 80))


def test_keep_one_of_each_component(spark):
    rows = [(*r, "s") for r in _corpus(4)] + [(None, "a lone text", "s"), (None, "one two", "s"), (0, "twice given", "x"), (0, "twice given", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = nj.keep_one(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    want = _brute([r[:2] for r in rows], 5, 80)
    stay = [d for d, n, c in want if n and d is not None and d == c and d != 0] + [d for d, n, _ in want if n == 0]
    assert sorted(x for x in kept if x is not None and x != 0) == sorted(x for x in stay if x != 0)
    assert kept.count(None) == 1  # 'a lone text'; 'one two' has a member with an id


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_duplicates(df).collect() == [] and nj.keep_one(df).collect() == []


def test_bounds():
    for percent in (60, 80, 85):
        for n in range(1, 200):
            assert 100 * nj.need(n, percent) >= percent * n > 100 * (nj.need(n, percent) - 1)
            assert n - nj.need(n, percent) + nj.spare(n, percent) <= n
