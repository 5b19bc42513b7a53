from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lapidary.llm import syncmers as S


def _rows(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "é", "ing", "東", "a"]) for _ in range(rng.randint(1, 3)))
    rows = [(i * 3, " ".join(word() for _ in range(rng.choice([0, 1, 4, 5, 40, 300])))) for i in range(n)]
    return [*rows, (1, None), (2, rows[5][1]), (4, rows[5][1]), (4, "again"), (4, "again"), (10**15, "an outlying id")]


def _run(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, edited string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return S.op8_closed_syncmers(spark, str(tmp_path)).collect()


def _kmers(spark, texts):
    """Position and hash of each text's chosen k-mers: hashes from Spark, the choice in Python."""
    tokens = {t: [w[i : i + 4] for w in re.findall(r"[^\x20\x09-\x0D]+", t) for i in range(0, len(w), 4)] for t in texts}
    pairs = sorted({p for ws in tokens.values() for p in zip(ws, ws[1:], strict=False)})
    h = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}
    out = {}
    for t, ws in tokens.items():
        s = [h[p] for p in zip(ws, ws[1:], strict=False)]
        out[t] = [(i, (s[i], s[i + 2], s[i + 3])) for i in range(len(ws) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    triples = sorted({x for ks in out.values() for _, x in ks})
    hashed = {(r.a, r.b, r.c): r.h for r in spark.createDataFrame(triples, "a long, b long, c long").select("a", "b", "c", F.hash("a", "b", "c").alias("h")).collect()}
    return {t: [(i, hashed[x]) for i, x in ks] for t, ks in out.items()}, {t: len(ws) for t, ws in tokens.items()}


def test_edited_text_and_likeness(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    rows = _rows(80)
    out = {}
    for r in _run(spark, rows, tmp_path):
        out.setdefault(r.doc_id, []).append(r)
    texts = sorted({t or "" for _, t in rows})
    h = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0], h[r[1]]))
    edits = [(i, t, nxt, t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]) for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True)]
    kmers, size = _kmers(spark, [*texts, *[e[3] for e in edits]])
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for i, t, nxt, e in edits:
        sets = [{(x, *((b[1], b[0] - at) for b in kmers[y][k + 1 : k + 2])) for k, (at, x) in enumerate(kmers[y])} for y in (t, e, nxt)]
        known = all(size[y] == 0 or kmers[y] for y in (t, e)), all(size[y] == 0 or kmers[y] for y in (t, nxt))
        want.setdefault(i, []).append((len(t), hashlib.sha256(e.encode()).hexdigest(), alike(sets[0], sets[1]) if known[0] else None, alike(sets[0], sets[2]) if known[1] else None))
    assert set(out) == set(want)
    for i, rs in out.items():
        got = sorted((r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rs)
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want[i], key=repr)] or sorted(g[:2] for g in got) == sorted(w[:2] for w in want[i])
        if len(got) == 1:
            for g, w in zip(got[0][2:], want[i][0][2:], strict=True):
                assert w is None or abs(g - w) < 1e-12
                assert 0 <= g <= 1
    text = dict(ordered)
    by_text = {}
    for i, rs in out.items():
        for r in rs if i != 4 else []:
            assert by_text.setdefault(text[i], r.fingerprint) == r.fingerprint
            if len(text[i].split()) >= 40:
                assert r.near_edited > 0.4 > r.near_next
    assert next(r for r in out[2]).near_next < 0.5
    assert out[1][0].fingerprint == "" and out[1][0].near_edited == 1.0


def test_chosen_kmers_are_closed_syncmers(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(700))
    want, size = _kmers(spark, [text])
    out = S.fingerprint(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out.fingerprint.split() == [f"{i}:{x}" for i, x in want[text]]
    assert 0.35 * size[text] < out.n_kmers < 0.65 * size[text]


def test_anchors_are_context_free(spark):
    """A passage has the same anchors in both texts, at positions that differ by one shift."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(300))
    texts = [" ".join(word() for _ in range(n)) + " " + passage + " " + " ".join(word() for _ in range(150)) for n in (200, 350)]
    a, b = ({int(x.split(":")[1]): int(x.split(":")[0]) for x in r.fingerprint.split()} for r in S.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect())
    shifts = [b[x] - a[x] for x in a.keys() & b.keys()]
    assert len(shifts) > 200 and shifts.count(300) > 0.98 * len(shifts)


def test_order_and_distance_count(spark):
    """A text behind another opening stays alike, one whose words stand in another order is not, though it has the same words."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    parts = [words[i : i + 8] for i in range(0, 400, 8)]
    rng.shuffle(parts)
    text = " ".join(words)
    pairs = [("same", text), ("moved", "another opening of it all " + text), ("shuffled", " ".join(w for p in parts for w in p)), ("none", "")]
    near = {r.k: r.near for r in S.likeness(spark.createDataFrame([(k, text, o) for k, o in pairs], "k string, one string, other string"), "one", "other").collect()}
    assert near["same"] == 1.0 and near["moved"] > 0.95 and near["none"] == 0.0
    plain = {r.k: {x.split(":")[1] for x in r.fingerprint.split()} for r in S.fingerprint(spark.createDataFrame(pairs, "k string, text string"), "k").collect()}
    assert near["shuffled"] < 0.35 and near["shuffled"] < 0.8 * len(plain["same"] & plain["shuffled"]) / len(plain["same"] | plain["shuffled"])


def test_measure_is_the_same_for_all_lengths(spark, tmp_path):
    """Texts of growing length, all edited alike: likeness has no jump."""
    rng = random.Random(11)
    words = [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") + str(rng.randrange(99)) for _ in range(600)]
    rows = [(i, " ".join(words[: 20 + 5 * i])) for i in range(100)]
    near = {r.doc_id: r.near_edited for r in _run(spark, rows, tmp_path)}
    assert all(0.25 < near[i] < 0.85 for i in near)
    smooth = [sum(near[i + k] for k in range(10)) / 10 for i in range(5, 85)]
    assert max(abs(x - y) for x, y in zip(smooth, smooth[1:], strict=False)) < 0.08


def test_blocks_bounded_with_outliers_and_ties(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    rows = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 5 WHEN id = 2999 THEN 1000000000000000 ELSE id END AS o", "hash(id % 2) AS h", "id AS u").selectExpr("o", "CAST(h AS BIGINT) AS h", "u")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        sizes = [r["count"] for r in rows.withColumn("block", S._block(rows)).groupBy("block").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) > 20 and max(sizes) < 300


def test_small_tables(spark, tmp_path):
    assert _run(spark, [], tmp_path / "a") == []
    one = _run(spark, [(5, "abcdefgh")], tmp_path / "b")
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1.0
    assert len(_run(spark, [(None, "x y"), (3, "z")], tmp_path / "c")) == 2
    long = _run(spark, [(1, "x" * 400_000), (2, None)], tmp_path / "d")
    assert sorted(r.n_chars for r in long) == [0, 400_000]
