from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.llm import suffix_dedup as S


def _brute(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, sha of distinct (id, text) rows with distinct ids."""
    seen, out = set(), []
    docs = sorted({(i if i is not None else -(2**63), t or "") for i, t in rows})
    for i, t in docs:
        raw = t.encode()
        mask = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                mask[s : s + length] = [True] * length
            seen.add(w)
        left = bytes(c for c, m in zip(raw, mask, strict=True) if not m)
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((i, len(raw), sum(mask), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def _corpus(seed, n=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé東x") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts: list[str] = ["z" * 400, "ab" * 150, "", "short"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            texts.append(" ".join(word() for _ in range(rng.choice([2, 20, 60, 150]))))
        elif kind < 0.7:
            t = rng.choice(texts)
            k = rng.randrange(len(t) + 1)
            texts.append(t[:k] + word() + t[k:])
        elif kind < 0.8:
            texts.append(rng.choice(texts))
        else:
            texts.append(word() + passage + word() + passage[: rng.randrange(len(passage))])
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "bucket"), [(1, 16_384), (2, 3), (3, 20)])
def test_report_by_brute_force(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(S, "ANCHOR_ROWS", bucket)
    monkeypatch.setattr(S, "SORT_ROWS", 64 if seed == 3 else S.SORT_ROWS)
    monkeypatch.setattr(S, "SMALL", 4)
    rows = [*_corpus(seed), (2000, None), (None, "x y z " * 40), (2001, "x y z " * 40)]
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id long, text string, t int, runs string")
    got = sorted((r.doc_id if r.doc_id is not None else -(2**63), *tuple(r)[1:]) for r in S.removal_report(df, length=40, gram=12).collect())
    assert got == _brute(rows, 40)


def test_production_lengths(spark):
    rows = _corpus(11, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.removal_report(df).collect())) == _brute(rows, 100)


def test_identical_rows_and_empty_table(spark):
    rows = [(1, "q" * 50 + "r" * 70), (1, "q" * 50 + "r" * 70), (2, "q" * 50 + "r" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_removed) for r in S.removal_report(df).collect())
    assert out == [(1, 0), (1, 0), (2, 120)]
    assert S.removal_report(df.limit(0)).collect() == []


def test_texts_without_repeats(spark):
    rows = _corpus(5)
    df = spark.createDataFrame([(i, t, "en", f"t{i}") for i, t in rows], "doc_id long, text string, lang string, d string").withColumn("n", F.length("text"))
    out = S.without_repeats(df, length=40, gram=12)
    assert out.columns == df.columns
    left = {i: sha for i, _, removed, _, sha in _brute(rows, 40) if removed}
    for r in out.collect():
        assert r.d == f"t{r.doc_id}"
        if r.doc_id not in left:
            assert r.text == dict(rows)[r.doc_id]
    assert out.count() == len(rows)


def test_multikey_quicksort(monkeypatch):
    monkeypatch.setattr(S, "SMALL", 3)
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    assert S.multikey_quicksort(w).tolist() == sorted(range(500), key=lambda i: (w[i].tolist(), i))


def test_offsets_apart():
    rng = np.random.default_rng(3)
    for most in (1, 7, 1000):
        offset = rng.integers(0, 12, 100)
        parts = S.offsets_apart(offset, most)
        assert sorted(np.concatenate(parts).tolist()) == list(range(100))
        kinds = [set(offset[p].tolist()) for p in parts]
        assert sum(map(len, kinds)) == len(set(offset.tolist()))
        assert all(len(p) <= most or len(k) == 1 for p, k in zip(parts, kinds, strict=True))
        assert all((np.diff(p[offset[p] == v]) > 0).all() for p, k in zip(parts, kinds, strict=True) for v in k)


def test_long_texts_in_windows(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BYTES", 150)
    rows = [(i, t * 4) for i, t in _corpus(21, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = S._texts(df, "doc_id", "text")
    assert S._all_stretches(texts, 40, 12).count() > 0
    assert sorted(map(tuple, S.removal_report(df, length=40, gram=12).collect())) == _brute(rows, 40)


def test_stretches_cover_every_start_once():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 99, 100, 101, 700]))).encode() for _ in range(30)]
    offsets = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    with np.errstate(over="ignore"):
        doc, first, last, at, _, _ = S.stretches(raw, offsets)
    starts = sorted(s for a, z in zip(first, last, strict=True) for s in range(a, z + 1))
    assert starts == [int(offsets[k]) + s for k, t in enumerate(texts) for s in range(len(t) - 99)]
    assert ((first >= offsets[doc]) & (last + 100 <= offsets[doc + 1]) & (at >= first) & (at <= last + 100)).all()
