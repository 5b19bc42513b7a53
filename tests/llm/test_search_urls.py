from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from lapidary.llm import topk, url_filter
from lapidary.llm.queries import ORACLE_SQL


def _brute(rows, k=10):
    ok = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)): (i, v) for i, v in ok}.values():
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(450)]
    rows += [(1000 + i, [0.5] * 20) for i in range(15)] + [(600, None), (700, [float("nan")] + [0.0] * 19), (701, [None] * 20), (800, [1.0] * 3), (801, [0.25] * 3), (None, [1.0] * 3)]
    rows += [(100, rows[100][1]), (200, rows[7][1]), (33, rows[34][1])]  # repeated ids: the same vector, and unlike ones
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(map(tuple, topk.top_k(df).collect())) == _brute(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_large_values():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert topk.Bucket(np.array([1, 2]), c).search(np.array([0]), q, 1)[2].tolist() == [2**60 + 6]


def test_top_k_in_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=20 if i % 3 else 9).astype(np.float32).tolist()) for i in range(320)]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())) == _brute(rows)


def test_top_k_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet/*.parquet'")
    assert sorted(con.sql(ORACLE_SQL["op5_exact_topk"]).fetchall()) == _brute(rows)


def _rule(host, path):
    best = None
    for h, p, v in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    m = min([rest.find(c, n) for c in "?#" if rest.find(c, n) >= 0], default=len(rest))
    return rest[:n].translate({i: i + 32 for i in range(65, 91)}), rest[n:m]


def test_url_rules_and_ratio(spark):
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/75?x#y", "http://example.com/en/8", "ftp://xnet/de/1", "http://x.net/de/1", "http://example.net/de/8", "http://É.org/es/", "http://a.org?/es/", "http://a.org#x://b", "HTTP://B.net/fr/" + "z" * 20000]
    urls += [f"http://good{i % 7}.net/de/{i}" for i in range(200)] + [f"http://spam{i % 5}.com/en/{i}" for i in range(200)] + [f"http://{w}{i}.org/fr/{i}" for w in ("good", "spam") for i in range(50)]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(3, "http://", "x")]
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = _split(urls[r.page_id])
        rule = _rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    named = {urls[r.page_id]: r.verdict for r in out}
    right = sum(named[f"http://good{i}.org/fr/{i}"] == "allow" for i in range(50)) + sum(named[f"http://spam{i}.org/fr/{i}"] == "block" for i in range(50))
    assert right >= 90
    none = spark.createDataFrame([(1, "http://q.org/x")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.filter_urls(none).collect()] == [(1, "q.org", "/x", None, "allow", None)]


def test_markov_sums_to_one():
    m = url_filter.Markov(["abab", "abc", "b"], order=2)
    base = url_filter._codes(["ab"], 2)[0][1] & ~np.uint64(255)
    code = base | np.arange(256, dtype=np.uint64)
    total = np.exp([m.log_likelihood(code[i : i + 1], np.zeros(1, int), 1)[0] for i in range(256)]).sum()
    assert abs(total - 1) < 1e-9


def _witten_bell(texts: list[str], order: int):
    """The smoothed probability of a byte after a context, by dictionaries and recursion."""
    counts = defaultdict(Counter)
    for t in texts:
        b = b"\x02" * order + t.encode() + b"\x03"
        for i in range(order, len(b)):
            for o in range(order + 1):
                counts[b[i - o : i]][b[i]] += 1

    def p(context: bytes, x: int) -> float:
        lower = p(context[1:], x) if context else 1 / 256
        own = counts.get(context)
        return (own[x] + len(own) * lower) / (sum(own.values()) + len(own)) if own else lower

    def score(t: str) -> float:
        b = b"\x02" * order + t.encode() + b"\x03"
        return sum(math.log(p(b[i - order : i], b[i])) for i in range(order, len(b)))

    return score


def test_model_and_threshold_against_dictionaries():
    rng = random.Random(6)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
    good, bad = [make("aab/é") for _ in range(60)], [make("bcc/") for _ in range(60)]
    ratio = url_filter.Ratio(good, bad, order=3)
    part = lambda x, out: [t for i, t in enumerate(x) if (i % 5 == 0) == out]
    a, b = _witten_bell(part(good, False), 3), _witten_bell(part(bad, False), 3)
    want = lambda t: (a(t) - b(t)) / (len(t.encode()) + 1)
    texts = [make("abc/éx") for _ in range(80)] + ["", "never seen"]
    assert np.allclose(ratio.score(texts), [want(t) for t in texts])
    held = [(want(t), True) for t in part(good, True)] + [(want(t), False) for t in part(bad, True)]
    share = lambda at: sum((s >= at) == own for s, own in held if own) / len(part(good, True)) + sum((s >= at) == own for s, own in held if not own) / len(part(bad, True))
    assert share(ratio.threshold) >= max(share(s) for s, _ in held) - 1e-9


def test_url_ids_are_carried_as_they_are(spark):
    ids = [2**53 + 1, None, 2**53 + 3, None]
    rows = spark.createDataFrame([(i, "http://a.net/de/1") for i in ids], "page_id long, url string")
    assert sorted((r.page_id for r in url_filter.filter_urls(rows.coalesce(1)).collect()), key=str) == sorted(ids, key=str)
    assert url_filter.filter_urls(rows.limit(0)).collect() == []


def test_every_labelled_url_is_counted(spark):
    """The models and the threshold are those of all labelled URLs, not of a sample: held against the models in memory."""
    from inspect import signature

    from pyspark.sql import functions as F

    assert "fit_rows" not in signature(url_filter.filter_urls).parameters
    rng = random.Random(9)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    urls = [f"http://{make('abc')}.net/de/{make('aabé')}" for _ in range(150)] + [f"http://{make('abc')}.com/en/{make('abb')}" for _ in range(150)] + [f"http://{make('abc')}.org/fr/{make('abé')}" for _ in range(100)] + ["", None, "x" * 300]
    urls += urls[:20]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    out = url_filter.filter_urls(df).collect()
    held = {r.url: r.h for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("h")).collect()}
    of = lambda rule, part: [u for u in urls if u and f"{rule}/" in u and held[u] == part]
    a, b = url_filter.Markov(of(".net/de", False)), url_filter.Markov(of(".com/en", False))

    def want(u):
        code, row = url_filter._codes([u or ""], url_filter.ORDER)
        return float((a.log_likelihood(code, row, 1) - b.log_likelihood(code, row, 1))[0]) / len(code)

    assert np.allclose([r.score for r in out], [want(urls[r.page_id]) for r in out], atol=1e-7)
    score = {urls[r.page_id]: r.score for r in out}
    good, bad = [score[u] for u in of(".net/de", True)], [score[u] for u in of(".com/en", True)]
    at = sorted({*good, *bad, 0.0})
    share = {t: sum(s >= t for s in good) * len(bad) + sum(s < t for s in bad) * len(good) for t in at}
    threshold = min((t for t in at if share[t] == max(share.values())), key=abs)
    assert all(r.verdict == ("block" if r.score < threshold else "allow") for r in out if r.rule is None)


def test_more_labelled_urls_than_a_sample_held(spark):
    """22,000 URLs a class, of which 20,000 were counted once."""
    from pyspark.sql import functions as F

    df = spark.range(44_000).selectExpr("id AS page_id", "concat('http://a', id % 7, CASE WHEN id % 2 = 0 THEN '.net/de/' ELSE '.com/en/' END, id) AS url")
    fit = [(r.page_id, r.url) for r in df.where(F.pmod(F.xxhash64("url"), F.lit(5)) != 0).collect()]
    a, b = (url_filter.Markov([u for i, u in fit if i % 2 == kind]) for kind in (0, 1))
    out = url_filter.filter_urls(df).collect()
    assert len(out) == 44_000
    out = out[:200]
    code, row = url_filter._codes([f"http://{r.host}{r.path}" for r in out], url_filter.ORDER)
    want = (a.log_likelihood(code, row, 200) - b.log_likelihood(code, row, 200)) / np.bincount(row)
    assert np.allclose([r.score for r in out], want, atol=1e-8)
