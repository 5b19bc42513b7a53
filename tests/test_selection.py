from __future__ import annotations

import random

import pytest

from lapidary.operators import selection

CANDIDATES = "book_id string, block_id string, cand_pos long, section_no long, first_index long, word_count long, utility double, covers array<string>, terms array<string>, redundant_with array<string>, protected_for array<string>"
SECTIONS = "book_id string, section_no long, section_pos long, cap long, cover boolean, included boolean"


def _model(blocks, goals, sections, target):
    """The four passes again, written as one list of tries: (candidates in order, protected, late, goal)."""
    caps = {s[1]: s[3] for s in sections}
    taken, tags = [], {}
    used = lambda n=None: sum(b[5] for b in taken if n is None or b[3] == n)
    ids = lambda: {b[1] for b in taken}

    def fits(b, limit, protected):
        if b[1] in ids() or used() + b[5] > int(target * limit):
            return False
        return protected or not set(b[9]) & ids() and used(b[3]) + b[5] <= caps.get(b[3], 600)

    anchors = sorted(blocks, key=lambda b: (-b[6], b[5], b[2]))
    for goal in goals:
        for b in anchors:
            if goal in b[7] + b[8]:
                if b[1] in ids() or fits(b, 1.12, True):
                    taken.extend([] if b[1] in ids() else [b])
                    tags.setdefault(b[1], []).append(goal)
                    break
    for s in sections:
        if s[4] and not any(b[3] == s[1] for b in taken):
            taken.extend(next(([b] for b in anchors if b[3] == s[1] and fits(b, 1.12, True)), []))
    protected = ids()
    ranked = sorted(blocks, key=lambda b: (-b[6], b[2]))
    for b in ranked:
        if fits(b, 1.0, False):
            taken.append(b)
    if used() < int(target * 0.94):
        now = used()
        rest = [b for b in ranked if b[1] not in ids() and not set(b[9]) & ids()]
        for b in sorted(rest, key=lambda b: (abs(now + b[5] - target), -b[6])):
            if fits(b, 1.03, False):
                taken.append(b)
            if used() >= int(target * 0.97):
                break
    return [(b[1], b[1] in protected, tags.get(b[1], [])) for b in taken]


@pytest.mark.parametrize(("seed", "folded"), [*((s, selection.FOLDED) for s in range(6)), (1, 0), (7, 24)])
def test_selection_against_a_model(spark, seed, folded):
    """By folds, in rounds, and with some books either way."""
    rng = random.Random(seed)
    books, rows, want = [f"b{i}" for i in range(4)], [], {}
    sections, goals, targets = [], [], []
    for book in books:
        n = rng.randint(2, 5)
        own = [(book, f"{book}-{i}", i, rng.randint(1, n), i, rng.randint(20, 400), round(rng.random() * 5, 2), [f"R{rng.randint(0, 5)}"], [f"R{rng.randint(0, 9)}"] * rng.randint(0, 1), [f"{book}-{rng.randint(0, 25)}"] * rng.randint(0, 2), []) for i in range(25)]
        s = [(book, k, k, rng.choice([300, 600, 900]), rng.random() < 0.7, True) for k in range(1, n + 1)]
        g = [f"R{k}" for k in rng.sample(range(8), 4)]
        target = rng.randint(300, 2500)
        own = own if folded != 24 or book > "b1" else own[:20]
        rows += own
        sections += s
        goals += [(book, i, r) for i, r in enumerate(g)]
        targets.append((book, target))
        want[book] = _model(own, g, s, target)
    out = selection.select(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(goals, "book_id string, ord long, requirement_id string"), spark.createDataFrame(targets, "book_id string, target long"), folded=folded)
    got: dict = {b: [] for b in books}
    for r in sorted(out.collect(), key=lambda r: r.step):
        got[r.book_id].append((r.block_id, r.protected, r.protected_for))
    assert got == want
    words = {r[1]: r[5] for r in rows}
    for book, target in targets:
        assert sum(words[b] for b, _, _ in got[book]) <= int(target * 1.12)


def test_continuity_covers_each_section(spark):
    c = [("b", "B1", 0, 1, 1, 100, 10.0, [], [], [], []), ("b", "B2", 1, 2, 1, 100, 1.0, [], [], [], [])]
    s = [("b", 1, 1, 600, True, True), ("b", 2, 2, 600, True, True)]
    out = selection.select(spark.createDataFrame(c, CANDIDATES), spark.createDataFrame(s, SECTIONS), spark.createDataFrame([], "book_id string, ord long, requirement_id string"), spark.createDataFrame([("b", 500)], "book_id string, target long")).collect()
    assert sorted((r.block_id, r.protected, r.target) for r in out) == [("B1", True, 500), ("B2", True, 500)]


def test_review_keeps_a_sections_only_block(spark):
    c = spark.createDataFrame([("b", "B1", 0, 1, 1, 100, 1.0, [], [], [], []), ("b", "B2", 1, 2, 1, 100, 1.0, [], [], [], []), ("b", "B3", 2, 2, 2, 50, 1.0, [], [], [], []), ("b", "B4", 3, 2, 2, 50, 1.0, [], [], [], ["R1"])], CANDIDATES)
    asked = spark.createDataFrame([("b", x) for x in ("B1", "B2", "B4", "B9")], "book_id string, block_id string")
    assert [r.block_id for r in selection.review_removals(c, asked).collect()] == ["B2"]


@pytest.mark.parametrize("folded", [selection.FOLDED, 0])
def test_review_additions_in_order(spark, folded):
    c = spark.createDataFrame([("b", f"B{i}", i, 1 + i % 2, i, 300, 1.0, [], [], [], ["R1"] if i == 5 else []) for i in range(8)], CANDIDATES)
    kept = c.where("cand_pos = 0")
    asked = spark.createDataFrame([("b", p, f"B{i}") for p, i in enumerate([0, 2, 2, 4, 5, 7, 99])], "book_id string, pos long, block_id string")
    caps = spark.createDataFrame([("b", 1, 600), ("b", 2, 200)], "book_id string, section_no long, cap long")
    out = selection.review_additions(kept, c, asked, caps, spark.createDataFrame([("b", 1000)], "book_id string, target long"), folded=folded).collect()
    # 300 kept; B2 fits (600 of 690); B4 passes its section's cap; B5 is protected, so its cap does not count; B7 passes its cap
    assert sorted(r.block_id for r in out) == ["B2", "B5"]


def test_passages_are_made_from_counted_documents(spark):
    """Texts are read and counted once; what selects moves numbers only."""
    from lapidary import queries

    for made in (queries.blocks, queries.block_sections, queries.candidates):
        plan = made(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "text#" not in plan


def test_long_budgets_are_folded_in_one_job(spark):
    """More bridges than an array fold could hold, with what greedy taking in order gives."""
    from lapidary.operators import bridges

    n = 5000
    rows = spark.range(n).selectExpr("'b' AS book_id", "id AS pos", "id * 7 % 23 + 5 AS words")
    left, want = 6000, []
    for i in range(n):
        if (w := i * 7 % 23 + 5) <= left:
            want.append(i)
            left -= w
    got = bridges.within_budget(rows, spark.createDataFrame([("b", 300_000)], "book_id string, words long"), 0.02)
    assert sorted(r.pos for r in got.collect()) == want and bridges.SHORT > n
