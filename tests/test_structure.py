from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapidary.operators import bridges, graph, greedy, scans, scoring, structure

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _book(spark, lines):
    return spark.createDataFrame([("b", i, x) for i, x in enumerate(lines)], "book_id string, line_no long, line string")


def test_segments(spark):
    out = structure.segment_lines(_book(spark, ["before it", "# One", "## Two", "text here", "Chapter 3", "", "more text"])).orderBy("section_pos").collect()
    assert [(r.section_pos, r.title, r.text) for r in out] == [(1, "Opening", "before it"), (2, "Two", "text here"), (3, "Chapter 3", "more text")]
    only = structure.segment_lines(_book(spark, ["# One", "# Two"])).collect()
    assert [(r.title, r.text) for r in only] == [("Book text", "# One\n# Two")]


def test_paragraph_ids_leave_gaps(spark):
    rows = [("b", 2, "T", 1, "first words", None), ("b", 2, "T", 2, "x", None), ("b", 2, "T", 3, "third words", 7), ("b", 5, " ", 1, "other section", None)]
    out = structure.paragraphs(spark.createDataFrame(rows, "book_id string, section_pos long, title string, block_pos long, text string, page int"))
    got = sorted((r.paragraph_id, r.title, r.idx, r.page) for r in out.collect())
    assert got == [("CH001-P0001", "T", 1, None), ("CH001-P0003", "T", 3, 7), ("CH002-P0001", "Section 5", 1, None)]


def _bins(words, most):
    out, used = [], 0
    for w in words:
        if not out or used + w > most:
            out.append([])
            used = 0
        out[-1].append(w)
        used += w
    return [i for i, b in enumerate(out, 1) for _ in b]


@SETTINGS
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 40))
def test_bins_by_hand(spark, words, most):
    df = spark.createDataFrame([("k", i, w) for i, w in enumerate(words)], "k string, i long, w long")
    assert [r.chunk for r in structure.bins(df, ["k"], "i", "w", most).orderBy("i").collect()] == _bins(words, most)


@SETTINGS
@given(st.lists(st.integers(0, 12), min_size=1, max_size=15), st.integers(0, 200))
def test_bridge_budget_by_hand(spark, words, source):
    df = spark.createDataFrame([("b", i, w) for i, w in enumerate(words)], "book_id string, pos long, words long")
    total = spark.createDataFrame([("b", source)], "book_id string, words long")
    used, kept = 0, []
    for i, w in enumerate(words):
        if used + w <= int(source * 0.1):
            used += w
            kept.append(i)
    assert sorted(r.pos for r in bridges.within_budget(df, total, 0.1).collect()) == kept


def test_runs_and_blocks(spark):
    rows = [("n", p, f"P{p}", f"text {p}", 2, "why") for p in (5, 1, 2, 2, 3, 7)]
    out = structure.run_blocks(spark.createDataFrame(rows, "n string, pos long, paragraph_id string, text string, word_count long, reason string"), ["n"]).orderBy("run").collect()
    assert [(r.paragraph_ids, r.word_count) for r in out] == [(["P1", "P2", "P3"], 6), (["P5"], 2), (["P7"], 2)]
    assert out[0].reason == "why (run 1 of 3 of a passage with gaps)" and out[0].text == "text 1\n\ntext 2\n\ntext 3"


def test_caps(spark):
    s = spark.createDataFrame([("b", 1, "body", 8000), ("b", 2, "body", 2000), ("c", 1, "body", 1000), ("b", 3, "exclude", 50)], "book_id string, section_no long, kind string, word_count long")
    t = s.join(spark.createDataFrame([("b", 2500), ("c", 1000)], "book_id string, target long"), "book_id")
    assert {(r.book_id, r.section_no): r.cap for r in structure.section_caps(t, F.col("target")).collect()} == {("b", 1): 2000, ("b", 2): 600, ("c", 1): 1000}
    high = spark.createDataFrame([("c", 1, "high")], "book_id string, section_no long, priority string")
    assert [r.cap for r in structure.section_caps(t, F.col("target"), high).where("book_id = 'c'").collect()] == [int(1000 * 1.15)]


def test_overview_excerpt_falls_back_to_the_body(spark):
    s = spark.createDataFrame([("b", 1, "body", 9), ("b", 2, "body", 9), ("b", 3, "exclude", 9)], "book_id string, section_no long, kind string, word_count long")
    p = spark.createDataFrame([("b", n, i, f"{n}-{i}", 600) for n in (1, 2, 3) for i in (1, 2, 3)], "book_id string, section_no long, idx long, paragraph_id string, word_count long")
    out = structure.overview_excerpt(p, s, 3000).collect()
    assert sorted((r.part, r.paragraph_id) for r in out) == [("ending", "2-1"), ("ending", "2-2"), ("front", "1-1"), ("front", "1-2")]


def test_outline_prefers_the_longest_level(spark):
    rows = [("b", 0, 1, "Introduction", 1), *[("b", i, 2, f"{i} Part", i * 10) for i in (1, 2, 3)], ("b", 8, 2, "3 Part", 30), ("b", 9, 1, "Chapter 4", 90)]
    out = structure.outline_sections(spark.createDataFrame(rows, "book_id string, pos long, level int, title string, start_page int")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.start_page) for r in out] == [(1, "1 Part", 10), (2, "2 Part", 20), (3, "3 Part", 30)]


def test_page_ranges(spark):
    o = spark.createDataFrame([("b", 1, "A", 1, None), ("b", 2, "B", 5, 6), ("b", 3, "C", 9, None), ("b", 4, "D", 9, None), ("b", 5, "E", 40, None)], "book_id string, pos long, title string, start_page int, end_page int")
    out = structure.page_ranges(o, spark.createDataFrame([("b", 30)], "book_id string, pages int")).orderBy("pos").collect()
    assert [(r.title, r.start_page, r.end_page) for r in out] == [("A", 1, 4), ("B", 5, 6), ("D", 9, 30)]


REQS = "book_id string, pos long, requirement_id string, kind string, description string, importance string, claims array<string>, sections array<string>, must boolean"
RELS = "book_id string, pos long, source string, target string, relation string"


def test_repair_links_and_promotes(spark):
    reqs = spark.createDataFrame([("b", 0, "R16", "major_proposition", "d", "essential", ["C1"], ["CH003"], True), ("b", 1, "S1", "evidence", "d", "supporting", [], ["CH001"], False), ("b", 2, "S4", "supporting_argument", "d", "supporting", ["C1"], ["CH003"], False)], REQS)
    made, edges = graph.repaired(reqs, spark.createDataFrame([], RELS))
    assert [(r.source, r.target, r.relation, r.weak) for r in edges.collect()] == [("S4", "R16", "supports", False)]
    out = {r.requirement_id: (r.must, r.importance) for r in graph.promoted(made, edges).collect()}
    assert out["S4"] == (True, "essential") and out["S1"] == (False, "supporting")
    assert graph.violations(made, edges, spark.createDataFrame([], "book_id string, pos long, requirement_id string")).collect() == []


def test_repair_makes_support(spark):
    reqs = spark.createDataFrame([("b", 0, "R16", "major_proposition", "d", "essential", ["C1"], ["CH003"], True)], REQS)
    made, edges = graph.repaired(reqs, spark.createDataFrame([], RELS))
    assert sorted(r.requirement_id for r in made.collect()) == ["R16", "auto-support-for-R16"]
    assert [(r.source, r.target) for r in edges.collect()] == [("auto-support-for-R16", "R16")]


def test_scores_default_and_last(spark):
    b = spark.createDataFrame([("b", "x"), ("b", "y")], "book_id string, block_id string")
    s = spark.createDataFrame([("b", "x", 1, 4.0), ("b", "x", 2, 5.0)], "book_id string, block_id string, seq long, score double")
    assert {r.block_id: r.score for r in scoring.with_scores(b, s).collect()} == {"x": 5.0, "y": 10.0}


def test_approved_bridges(spark):
    p = spark.createDataFrame([("b", 1, "x", "y", "Transition: on we go", True, ["y", "q"], ["R1", "R9"]), ("b", 2, "x", "y", "later", True, ["x"], []), ("b", 3, "x", "z", "stray", True, [], []), ("b", 4, "y", "z", " ", True, [], [])], "book_id string, pos long, before_id string, after_id string, text string, necessary boolean, grounding_blocks array<string>, grounding_requirements array<string>")
    pairs = spark.createDataFrame([("b", "x", "y"), ("b", "y", "z")], "book_id string, before_id string, after_id string")
    out = bridges.accepted(p, pairs).collect()
    assert [(r.pos, r.text, r.grounding_blocks) for r in out] == [(1, "later", ["x"])]
    checks = spark.createDataFrame([("b", 1, "x", "y", True, False, False, False, "transition: fine now"), ("b", 0, "x", "y", False, False, False, False, "no")], "book_id string, seq long, before_id string, after_id string, grounded boolean, new_claim boolean, impersonates boolean, wordy boolean, approved_text string")
    assert [r.text for r in bridges.approved(bridges.accepted(p, pairs), checks, 5).collect()] == ["fine now"]
    assert bridges.approved(bridges.accepted(p, pairs), checks, 1).collect() == []


@pytest.mark.parametrize("block", [4, 16_384])
def test_running_sums_and_carried_values_cross_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randint(0, 9), rng.choice([None, None, f"h{i}"])) for i in range(200)]
    out = scans.running(spark.createDataFrame(rows, "k string, i long, v long, h string"), ["k"], "i", {"total": F.col("v"), "n": F.lit(1)}, {"last": F.col("h")})
    want = []
    for k, i, v, h in rows:
        own = [r for r in rows if r[0] == k and r[1] <= i]
        want.append((k, i, v, h, sum(r[2] for r in own), len(own), next((r[3] for r in reversed(own) if r[3]), None)))
    assert sorted(map(tuple, out.select("k", "i", "v", "h", "total", "n", "last").collect()), key=str) == sorted(want, key=str)


def test_numbers_by_any_order(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 101, i) for i in range(300)]
    out = scans.numbered(spark.createDataFrame(rows, "k string, v long, i long"), ["k"], [F.desc("v"), F.col("i")]).collect()
    for key in "ab":
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [(r.v, r.i) for r in sorted((r for r in out if r.k == key), key=lambda r: r.pos)] == [(v, i) for _, v, i in own]
        assert sorted(r.pos for r in out if r.k == key) == list(range(1, len(own) + 1))


@pytest.mark.parametrize("seed", range(3))
def test_bins_of_long_keys_equal_the_fold(spark, monkeypatch, seed):
    monkeypatch.setattr(scans, "BLOCK", 8)
    monkeypatch.setattr(structure, "GROUP", 3)
    monkeypatch.setattr(structure, "SHORT", 30)
    rng = random.Random(seed)
    books = {k: [rng.choice([0, 1, 2, 5, 9, 30, 200 if rng.random() < 0.1 else 3]) for _ in range(n)] for k, n in (("a", 150), ("b", 31), ("c", 12))}
    most = rng.choice([5, 20, 90])
    df = spark.createDataFrame([(k, i, w, "x") for k, ws in books.items() for i, w in enumerate(ws)], "k string, i long, w long, own string")
    out = structure.bins(df, ["k"], "i", "w", most).collect()
    for k, ws in books.items():
        assert [r.chunk for r in sorted((r for r in out if r.k == k), key=lambda r: r.i)] == _bins(ws, most), k
    assert out[0].own == "x"


def test_a_long_range_is_two_rows(spark):
    ranges = spark.createDataFrame([("b", 1, "all", 1, 10_000_000), ("b", 2, "one", 5, 5), ("b", 3, "some", 7, 12), ("c", 1, "none", 9, 8)], "book_id string, pos long, title string, start_page int, end_page int")
    pages = spark.createDataFrame([("b", p, 0, "t") for p in (1, 5, 7, 8, 12, 13, 10_000_000, 10_000_001)] + [("c", 9, 0, "t")], "book_id string, page_no long, block_no int, text string")
    found = structure.page_blocks(ranges, pages)
    assert sorted((r.section_pos, r.page_no) for r in found.collect()) == [(1, p) for p in (1, 5, 7, 8, 12, 13, 10_000_000)] + [(2, 5)] + [(3, p) for p in (7, 8, 12)]
    assert sorted(found.columns) == sorted(["book_id", "section_pos", "title", "page_no", "block_no", "text"])


def test_texts_stay_out_of_the_search_for_ranges(spark):
    """A page is a row for each power of two in use, but its text is not: it is joined to the page's ranges."""
    ranges = spark.createDataFrame([("b", i, "t", 1, 2**i) for i in range(12)], "book_id string, pos long, title string, start_page int, end_page int")
    pages = spark.range(100).select(F.lit("b").alias("book_id"), F.col("id").alias("page_no"), F.lit(0).alias("block_no"), F.concat(F.lit("x"), "id").alias("text"))
    plan = structure.page_blocks(ranges, pages)._jdf.queryExecution().optimizedPlan()
    copies = [plan.p(i) for i in range(200) if plan.p(i) is not None and plan.p(i).nodeName() == "Generate"]
    assert copies
    for node in copies:
        assert "text" not in [node.output().apply(i).name() for i in range(node.output().size())]


def test_edges_hold_what_all_lines_hold(spark):
    rng = random.Random(5)
    words = ["Page 7", "Chapter 3", "a line", "Notes", "12 Monkeys and men", "x" * 120, "", "Running head 4"]
    rows = [("b", p, i, rng.choice(words)) for p in range(40) for i in range(rng.choice([1, 3, 9, 16, 17, 40]))]
    lines = spark.createDataFrame(rows, "book_id string, page_no long, line_no long, text string")
    edges = structure.page_edges(lines)
    assert edges.count() < len(rows)
    noise, found = (sorted(map(tuple, structure.margin_noise(x).collect())) for x in (lines, edges))
    assert noise == found and noise
    noise = structure.margin_noise(lines)
    assert sorted(map(tuple, structure.page_headings(lines, noise).collect())) == sorted(map(tuple, structure.page_headings(edges, noise).collect()))


def test_bridge_budget_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(bridges, "SHORT", 10)
    words = [(k, i, (i * 7) % 13) for k, n in (("a", 60), ("b", 9)) for i in range(n)]
    df = spark.createDataFrame(words, "book_id string, pos long, words long")
    found = bridges.within_budget(df, spark.createDataFrame([("a", 900), ("b", 200)], "book_id string, words long"), 0.1)
    want = []
    for k, most in (("a", 90), ("b", 20)):
        used = 0
        for _, i, w in (r for r in words if r[0] == k):
            if used + w <= most:
                used += w
                want.append((k, i))
    assert sorted((r.book_id, r.pos) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_greedy_rounds_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    rows, want = [], []
    for book, total, enough in (("a", 500, None), ("b", 90, 60), ("c", 5, None)):
        own = [(book, f"{book}{i}", i, rng.randint(0, 3), rng.randint(1, 40)) for i in range(60)]
        caps = [rng.choice([None, 50, 120]) for _ in range(4)]
        used, by = 7, [3] * 4
        for r in own:
            if (enough is None or used < enough) and used + r[4] <= total and (caps[r[3]] is None or by[r[3]] + r[4] <= caps[r[3]]):
                used, by[r[3]] = used + r[4], by[r[3]] + r[4]
                want.append((book, r[1]))
            rows.append((*r, total, caps[r[3]], 7, 3, enough))
    schema = "book_id string, block_id string, pos long, section_no long, word_count long, total_limit long, section_limit long, used long, section_used long, enough long"
    assert sorted((r.book_id, r.block_id) for r in greedy.fill(spark.createDataFrame(rows, schema)).collect()) == sorted(want)


def test_requirements_fit_every_section(spark):
    """What names no section is paired with each; a section that nothing fits takes all of its book's; nothing is paired twice."""
    s = spark.createDataFrame([("a", "S1"), ("a", "S2"), ("a", "S2"), ("b", "S1"), ("b", "S2"), ("c", "S1")], "book_id string, section_id string")
    r = spark.createDataFrame([("a", "R1", []), ("a", "R2", ["S2"]), ("a", "R1", ["S1"]), ("b", "R1", ["S1", "S1"]), ("b", "R2", ["S9"])], "book_id string, requirement_id string, sections array<string>")
    got = sorted(tuple(x) for x in graph.section_requirements(s, r).collect())
    assert got == [("a", "S1", "R1"), ("a", "S2", "R1"), ("a", "S2", "R2"), ("b", "S1", "R1"), ("b", "S2", "R1"), ("b", "S2", "R2")]


def test_headings_are_put_in_by_one_reading(spark):
    """Titles come from the numbers in a line's row, not from a join that moves every line."""
    from lapidary import queries

    plan = queries.QUERIES["heading_segments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "section_no#" in plan and not any("Join" in line and "section_no#" in line for line in plan.split("\n"))


def test_pairs_of_books_go_as_lists(spark):
    """More sections and requirements than a list holds are paired in full, and what is broadcast is no exploded table."""
    s = spark.range(600).selectExpr("if(id < 590, 'b', 'c') AS book_id", "concat('S', id) AS section_id")
    r = spark.range(700).selectExpr("if(id < 695, 'b', 'c') AS book_id", "concat('R', id) AS requirement_id", "if(id = 3, array('S7'), cast(array() AS array<string>)) AS sections")
    df = graph.section_requirements(s, r)
    want = {("b", f"S{i}", f"R{j}") for i in range(590) for j in range(695) if j != 3 or i == 7} | {("c", f"S{i}", f"R{j}") for i in range(590, 600) for j in range(695, 700)}
    got = [tuple(x) for x in df.collect()]
    assert len(got) == len(want) and set(got) == want
    depths: list[int] = []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        depths = [d for d in depths if d < at]
        assert not (depths and "Generate" in line), line
        if "BroadcastExchange" in line:
            depths.append(at)
