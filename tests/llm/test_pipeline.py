from __future__ import annotations

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))
import corpus_pipeline as P  # noqa: E402
from lapidary.llm import packing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["th", "ing", "er", "wh", "on"]) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(90):
        t = [word() for _ in range(rng.choice([3, 30, 120]))]
        kind = rng.random()
        if kind < 0.15 and rows:
            t = rng.choice(rows)[1].split()
        elif kind < 0.3 and rows:
            t = rng.choice(rows)[1].split()
            t[rng.randrange(len(t))] = word()
        elif kind < 0.5:
            t = [*t, *passage.split(), *[word() for _ in range(20)]]
        rows.append((i, " ".join(t), "en", f"s{i % 3}"))
    return [*rows, (200, None, "en", "s0"), (201, "", "en", "s1"), (202, "12 34 !!", None, None), (5, rows[5][1], "en", rows[5][3]), (203, "A.", "en", None)]


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _without_near(rows):
    sets = [_shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    least = defaultdict(lambda: 10**9)
    for x, r in enumerate(rows):
        least[root(x)] = min(least[root(x)], r[0])
    return sorted({r for x, r in enumerate(rows) if r[0] == least[root(x)]})


def _without_repeats(rows):
    seen, out = set(), []
    for i, t, lang, source in sorted(rows):
        raw = t.encode()
        mask = [False] * len(raw)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                mask[s : s + 100] = [True] * 100
            seen.add(raw[s : s + 100])
        left = bytes(c for c, m in zip(raw, mask, strict=True) if not m).decode(errors="ignore")
        if left.strip(" "):
            out.append((i, left, lang, source))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    rows = [(*r, len(r[1] or "")) for r in _rows()]
    spark.createDataFrame(rows, DOCS).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    tables = []
    for i, (_, stage) in enumerate(P.STAGES):
        docs = P.saved(stage(spark, docs, folder), f"t{i}")
        tables.append(docs)
        assert i == len(P.STAGES) - 1 or docs.columns == names
    got = [sorted((r.doc_id, r.text, r.lang, r.source) for r in t.select("doc_id", "text", "lang", "source").collect()) if "text" in t.columns else None for t in tables]
    readable = [r for r in _rows() if any(c.isalpha() for c in r[1] or "")]
    key = lambda r: (r[0], r[1], r[2] or "", r[3] or "")
    assert sorted(got[0], key=key) == sorted(readable, key=key)
    near = _without_near([(a, b, c, d) for a, b, c, d in readable if d is not None] + [r for r in readable if r[3] is None])
    assert sorted(got[1], key=key) == sorted(near, key=key)
    assert sorted(got[2], key=key) == sorted(_without_repeats(near), key=key)
    assert all(r.n_chars == len(r.text) for r in tables[2].collect())
    times = Counter(r[0] for r in got[3])
    assert set(got[3]) <= set(got[2]) and max(times.values()) <= 3
    words = lambda rows: Counter({s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}})
    assert abs(sum(words(got[3]).values()) - sum(words(got[2]).values())) < 0.35 * sum(words(got[2]).values())

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    want = []
    for i, text, *_ in got[3]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    pieces = tables[4].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    used = defaultdict(list)
    for r in pieces:
        used[r.sequence_id].append((r.offset, r.length))
    for s in used.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(used) == -(-sum(r.length for r in pieces) // 4096)

    again = P.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_pass_through(spark, tmp_path):
    df = spark.createDataFrame([(1, "the thing here", "en", "s", 14, "a", 1), (2, "ding dong bell", "en", "s", 14, "b", 2)], f"{DOCS}, language string, size int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:
        docs = P.saved(stage(spark, docs, str(tmp_path)), "x")
        assert docs.columns == df.columns
