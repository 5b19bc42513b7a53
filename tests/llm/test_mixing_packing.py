from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lapidary.llm import mixing, packing

DOCS = "doc_id long, text string, source string, size string, start string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def _random_docs(n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["a", "bb", "the", "Ünï"]) for _ in range(rng.choice([0, 1, 5, 80, 400]))), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None])) for i in range(n)]
    return [*rows, (n, None, "s0"), (n + 1, " \t\n", "s9"), (5, rows[5][1], rows[5][2])]


def _targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: Fraction(left * w[s], sum(w[x] for x in rest)) for s in rest}
        if not (above := {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}):
            return {s: float(v) for s, v in (share | stopped).items()}
        stopped |= above


def test_mix_meets_targets_and_limits(spark):
    rows = _random_docs()
    out = mixing.taken_words(mixing.mix(_docs(spark, rows))).collect()
    assert sorted((r.doc_id, r["size"]) for r in out) == sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    sizes: dict = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = _targets(sizes)
    source = {i: s for i, _, s in rows}
    taken: Counter = Counter()
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.02 * t + 2 * mixing.BLOCK
    again = mixing.taken_words(mixing.mix(_docs(spark, rows).repartition(7))).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mix_slots_are_whole(spark):
    m = mixing.mix(_docs(spark, _random_docs()), block=8, shard=16)
    quota = {r.source: r for r in m.sources.collect()}
    slots = m.slots.collect()
    assert sorted(s.slot for s in slots) == list(range(sum(q.quota for q in quota.values())))
    uses = Counter((s.source, s.block) for s in slots)
    assert len({(s.source, s.block, s["pass"]) for s in slots}) == len(slots)
    for name, q in quota.items():
        own = [uses[name, b] for b in range(q.blocks)]
        assert sum(own) == q.quota and (not own or max(own) - min(own) <= 1)


def test_mix_empty(spark):
    assert mixing.taken_words(mixing.mix(_docs(spark, []))).collect() == []
    assert [r.taken for r in mixing.taken_words(mixing.mix(_docs(spark, [(1, None, None)]))).collect()] == [0]


def _check_packing(lengths, runs, capacity):
    bins: dict = defaultdict(list)
    for r in runs:
        for k in range(r.bins * r.each):
            bins[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert Counter(n for b in bins.values() for _, n in b) == Counter(lengths)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_gapless_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 5)) for _ in range(rng.randint(0, 400))]
    n = _check_packing(lengths, packing.plan(Counter(lengths), capacity), capacity)
    assert n <= max(-(-sum(lengths) // capacity) * 11 / 9 + 1, sum(x > capacity // 2 for x in lengths) * 11 / 9 + 1)


def _optimum(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, [*left, r - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(100 + seed)
    lengths = [rng.randint(3, 20) for _ in range(9)]
    count, fixed = [Counter(lengths)[n] for n in range(21)], []
    packing._reduce(count, 20, lambda bins, ls: fixed.append((bins, ls)))
    rest = [n for n in range(21) for _ in range(count[n])]
    assert sum(b for b, _ in fixed) + (_optimum(rest, 20) if rest else 0) == _optimum(lengths, 20)


def test_pieces_match_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    texts = ["", None, "Hello, wörld's  don't\n\tSTOP 1234 é e\u0301 \u0301x a\u00a0b \u2028z \x1c q\x85r 東京 🙂ok", " ".join(f"word{i}" for i in range(3000)), "ΑΣ ΑΣ. <|endoftext|> x<|startoftext|>y", "x" * 9000]
    rows = [(i, x, "s") for i, x in enumerate(texts)] + [(1, None, "s")]
    parts = packing.pieces(_docs(spark, rows))
    out = packing.pack(parts).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
        got = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i])
        assert got == (want * 2 if i == 1 else want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


def test_words_match_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    t, w, rng = Tokenizer.from_file(path), packing.Words(path, most=200), random.Random(8)
    alphabet = "abcXYZéÀßñ'´`.,;<>|_-019 \n\t\r\x0b\x1c\xa0\u00ad½ªµ\u0301ſʼ…Σς東🙂İı"
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + rng.choice(["", " don't we'll I'M", "<|endoftext|>", "ab " * 50]) for _ in range(8)]
        assert [x.tolist() for x in w.encode(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    monkeypatch.setattr(packing, "hashes", lambda raw, start, end: (end - start).astype(np.uint64))  # words of equal length collide
    t, w = Tokenizer.from_file(path), packing.Words(path)
    for texts in (["one"], ["two one", "a"], ["three four", "fours"], [None, ""]):
        assert [x.tolist() for x in w.encode(pa.array(texts, pa.string()))] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_pack_empty(spark):
    assert packing.pack(packing.pieces(_docs(spark, []))).collect() == []
