from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import jaccard_join as J
from lapidary.llm.components import components

SP = " \t\n\x0b\x0c\r"


def _words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SP:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _set(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x in range(len(sets)):
        ids = [sets[y][0] for y in range(len(sets)) if root(y) == root(x) and sets[y][0] is not None]
        least[x] = min(ids) if ids and sets[x][1] else sets[x][0]
    return sorted((i, len(s), least[x]) for x, (i, s) in enumerate(sets))


def _corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé東") for _ in range(3))
    passage = [word() for _ in range(40)]
    texts: list = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            texts.append([word() for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 200]))])
        elif kind < 0.85:  # near copies at all distances around the threshold
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t + [word() for _ in range(rng.randint(0, 1 + len(t) // 4))]
            texts.append(t)
        else:
            texts.append([word() for _ in range(10)] + passage + [word() for _ in range(rng.randint(0, 30))])
    out = [rng.choice([" ", "\n", " \t "]).join(t) for t in texts]
    return [(i * 7 % 1009, t.upper() if i % 10 == 0 else t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "tile"), [(1, 2048), (2, 3)])
def test_components_by_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(J, "TILE", tile)
    rows = [*_corpus(seed), (5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "a\tb"), (5004, "a\tb"), (5005, "a b c")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, key string")
    got = sorted(map(tuple, J.jaccard_components(df).collect()))
    assert got == _brute(rows)


def test_copies_without_an_id_link_the_others(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    near = list(words)
    near[30] = "x"
    other = [f"v{rng.random()}" for _ in range(50)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join(near)), (None, " ".join(other)), (None, " ".join(other[:-1])), (3, " ".join(other) + " end"), (7, "a b c"), (7, " ".join(near)), (7, "d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(None, 56, 1), (1, 56, 1), (2, 56, 1), (None, 46, 3), (None, 45, 3), (3, 47, 3), (7, 1, 7), (7, 56, 1), (7, 1, 7)], key=repr)


def test_one_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near = ["x" if i == 30 else w for i, w in enumerate(base)]
    rows = [(4, " ".join(base)), (9, " ".join(near)), (4, " ".join(base)), (4, "other words"), (None, " ".join(near)), (5, None), (5, ""), (6, "a b"), (None, "a b"), (None, "only without id")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, t string")
    got = sorted(((r.doc_id, r.text, r.t) for r in J.without_near_copies(df).collect()), key=repr)
    want = [(4, " ".join(base)), (4, "other words"), (5, None), (5, ""), (6, "a b"), (None, "only without id")]
    assert got == sorted([(*x, "k") for x in want], key=repr)
    assert J.without_near_copies(df.limit(0)).collect() == []


def test_second_round_links_what_the_first_missed(spark, monkeypatch):
    """A chain a - b - c where keys' hubs alone would not connect everything."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        t = list(base)
        for j in range(i, i + 8):
            t[j * 9 % 400] = f"x{i}_{j}"
        rows.append((rng.randrange(10**6), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == _brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sets_by_brute_force():
    texts = [t for _, t in _corpus(9)] + [None, "", "a  b", "x" * 5000]
    got = list(J.shingle_sets(pa.array(texts)))
    assert [len(g) for g in got] == [len(_set(t)) for t in texts]
    seen = {}
    for t, g in zip(texts, got, strict=True):
        assert (np.diff(g.astype(object)) > 0).all() if len(g) > 1 else True
        assert seen.setdefault(frozenset(_set(t)), g.tolist()) == g.tolist()


def test_bound_is_never_too_low():
    rng = np.random.default_rng(6)
    for n in (1, 3, 40, 700):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 3 // 4], rng.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        if len(b):
            x, y = J._words_of([J.bitmap(a)]), J._words_of([J.bitmap(b)])
            w = min(x.shape[1], y.shape[1])
            assert J.most_overlap(J._folded(x, w), np.array([len(a)]), J._folded(y, w), np.array([len(b)]))[0] >= len(np.intersect1d(a, b))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_a_group_that_nearly_links_makes_few_pairs(spark, monkeypatch):
    """Most pairs of the group are about 0.70 alike, which narrow bitmaps do not tell from 0.75."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        p, q = rng.sample(range(0, 140, 10), 2)
        for j in (p, q, q + 3):
            t[j] = f"x{i}_{j}"
        rows.append((i, " ".join(t)))
    made, tiled = [], J._tiled

    def counted(rows, info, percent, mode):
        out = J.saved(tiled(rows, info, percent, mode), "counted")
        made.append((mode, out.count()))
        return out

    monkeypatch.setattr(J, "_tiled", counted)
    got = sorted(map(tuple, J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _brute(rows)
    assert sum(n for mode, n in made if mode != "one") <= 5 * len(rows), made


def test_wide_bitmaps_fold_to_narrow_ones():
    rng = np.random.default_rng(7)
    for n in (1, 7, 150, 3_000, 40_000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        narrow, wide = J._words_of([J.bitmap(s)]), J._words_of([J.bitmap(s, True)])
        assert (J._folded(wide, narrow.shape[1]) == narrow).all()
