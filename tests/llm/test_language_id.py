from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lapidary.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, source string, language string"


def _word(rng, parts):
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))


def _rows(n=400, seed=2):
    rng = random.Random(seed)
    kinds = {"en": ["th", "ing", "er", "ed", "wh"], "fr": ["eau", "oi", "é", "que", "ch"], "de": ["sch", "ung", "ü", "ei", "zu"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        text = " ".join(_word(rng, kinds[lang]) for _ in range(rng.choice([2, 30, 200])))
        rows.append((i, text.upper() if i % 9 == 0 else text, lang, f"h{i % 5}.{lang}", "c"))
    return rows


def test_trigram_cells_by_brute_force():
    texts = ["abc  d\ne", None, "", "ab", "éab 12 x"]
    cell, row = L._cells(pa.array(texts))
    want = []
    for r, t in enumerate(texts):
        b = bytes(c if c >= 128 or 97 <= c < 123 else 32 for c in (t or "").encode())
        want += [r for i in range(len(b) - 2) if b"  " not in b[i : i + 3]]
    assert row.tolist() == want


def test_posterior_by_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(df)
    assert model.languages == ["de", "en", "fr"]
    assert np.allclose(np.exp(model.log_p).sum(1), 1)
    out = {r.doc_id: r for r in L.identify(df, model, F.col("text"), F.col("source"), F.col("lang"), keep=["doc_id"]).collect()}
    p, ll = {}, {}
    for i, text, *_ in rows:
        cell, _ = L._cells(pa.array([text.lower()]))
        mean = np.append(model.log_p[:, cell].mean(1), L.NOISE)
        ll[i] = mean * len(cell) / (1 + len(cell) / L.EFFECTIVE)
        e = np.exp(ll[i] - ll[i].max())
        p[i] = e / e.sum()
    for i, _, lang, host, _ in rows:
        if i % 40:
            continue
        others = lambda of: sum((p[j] for j, r in enumerate(rows) if j != i and of(r)), np.zeros(4))  # noqa: B023, E731
        base = (others(lambda r: True) + 1) / (others(lambda r: True).sum() + 4)
        same = others(lambda r: r[3] == host)
        pd = (same + L.DOMAIN * base) / (same.sum() + L.DOMAIN)  # each host is its own domain of two labels
        prior = (same + L.HOST * pd) / (same.sum() + L.HOST)
        suffix = lambda r: r[3].split(".")[1]
        seen = lambda of, value, kinds: (others(lambda r: of(r) == value) + 1) / (others(lambda r: True) + kinds)
        log = ll[i] + np.log(prior) + np.log(seen(lambda r: r[2], lang, 5)) + np.log(seen(suffix, suffix(rows[i]), 3))
        post = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert out[i].language == [*model.languages, "und"][int(post.argmax())]
        assert math.isclose(out[i].posterior, post.max(), abs_tol=2e-6)


def test_held_out_accuracy_and_rejection(spark):
    rows = _rows(600)
    model = L.fit(spark.createDataFrame(rows[:400], SCHEMA))
    odd = [(1000, None, None, None, "c"), (1001, "", "fr", "h", "c"), (1002, "123 456 !!!", "en", "h", "c"), (1003, "qxjzk vvvqq zzxkj wqqjx " * 50, None, "h", "c"), (1003, "qxjzk vvvqq zzxkj wqqjx " * 50, None, "h", "c")]
    test = spark.createDataFrame(rows[400:] + odd, SCHEMA)
    out = L.identify(test, model, F.col("text"), F.lit(None).cast("string"), keep=["doc_id", "lang", "language"], into="_").collect()
    assert len(out) == 205
    assert [r[3] for r in out if r.doc_id >= 1000] == ["und"] * 5
    short = spark.createDataFrame([*rows[400:], (999, "A.", "en", "h", "c")], SCHEMA)
    one = L.identify(short, model, F.col("text"), F.col("source"), F.col("lang"), keep=["doc_id"]).where("doc_id = 999").collect()
    assert [r.language for r in one] == ["en"]
    assert sum(r[3] == r.lang for r in out if r.doc_id < 1000) >= 190


def test_empty_and_unlabelled(spark):
    df = spark.createDataFrame(_rows(5), SCHEMA)
    model = L.fit(df.limit(0))
    assert [r.language for r in L.identify(df, model, F.col("text"), F.col("source"), keep=["doc_id"]).collect()] == ["und"] * 5
    assert L.identify(df.limit(0), L.fit(df), F.col("text"), F.col("source"), keep=["doc_id"]).collect() == []


def test_pages_of_the_table(spark):
    out = L.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 250
    assert sum(r.language == r.declared_language for r in out) >= 0.9 * len(out)


def test_more_labels_than_a_block(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(L.BLOCK + 6):
        name = letters[k // 26] + letters[k % 26]
        parts = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(6)]
        rows += [(100 * k + i, " ".join(rng.choice(parts) for _ in range(40 if k else 5)), name, "h", "c") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = L.fit(df)
    assert model.languages == sorted({r[2] for r in rows})
    assert np.allclose(np.exp(model.log_p).sum(1), 1)
    out = L.identify(df, model, F.col("text"), F.col("source"), F.col("lang"), keep=["doc_id", "lang"]).collect()
    assert len(out) == len(rows)
    assert all(r.language == r.lang == r.declared_language for r in out)
