from __future__ import annotations

import random

from pyspark.sql import functions as F

from lapidary.llm import quotes as Q


def test_parse_levels_and_attributions():
    text = "Hello\n\nAnn wrote:\n> one\n> two\n>\n> three\n>> Bob wrote:\n>>> deep\n> back\nmy answer\n> again"
    body, passages = Q.parse(text)
    assert body == "Hello\n\nmy answer"
    assert [(d, lines) for _, d, lines in passages] == [(1, ["one", "two"]), (1, ["three"]), (3, ["deep"]), (1, ["back"]), (1, ["again"])]
    assert Q.parse("a | b\nno quote") == ("a | b\nno quote", [])
    assert Q.parse("") == ("", [])


def _thread():
    rows = [(1, 0, "First point here.\n\nSecond point."), (1, 1, "> first  POINT here.\n\nI agree"), (1, 2, "> > First point here.\n> I agree\nMe too"), (1, 3, "> Second point.\nNo"), (1, 4, "plain"), (1, 5, "> nobody said this\nhm")]
    return rows


def test_links_and_reply_order(spark):
    rows = [(c, t, x, "user") for c, t, x in _thread()] + [(2, 0, "> First point here.\nOther conversation", "u"), (2, None, "x", "u"), (None, 0, None, "u"), (2, 7, None, "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, branch string")
    out = {(r.conv_id, r.turn): r for r in Q.conversations(df).collect()}
    assert len(out) == len(rows)
    parent = {k: v.parent_turn for k, v in out.items()}
    assert [parent[1, t] for t in range(6)] == [None, 0, 1, 0, 3, 4]
    assert [out[1, t].branch for t in range(6)] == [0, 0, 0, 3, 3, 3]
    assert [out[1, t].n_linked for t in range(6)] == [0, 1, 2, 1, 0, 0]
    assert out[1, 2].max_level == 2 and out[1, 2].body == "Me too"
    assert (out[2, 0].n_quotes, out[2, 0].n_linked, parent[2, 7]) == (1, 0, 0)
    assert out[2, None].place is None and out[None, 0].body == ""


def test_every_message_after_the_one_it_answers(spark):
    """Against a plain reading, over many range partitions, with a hot conversation on sparse turns and turns of several messages."""
    rng = random.Random(3)
    rows, quotes = [], {}
    for c, turns in ((9, sorted(rng.sample(range(10**12), 150))), (10, [0]), (11, sorted(rng.choices(range(20), k=60)))):
        said = []
        for i, t in enumerate(turns):
            earlier = [s for s in said if s[0] < t]
            quote = rng.choice(earlier) if earlier and rng.random() < 0.5 else None
            own = f"message number {c} {i} says {rng.random()}"
            rows.append((c, t, (f"> {quote[1]}\n" if quote else "") + own))
            quotes[c, t, rows[-1][2]] = quote and (quote[0], quote[2])
            said.append((t, own, rows[-1][2]))
    h = {r.t: r.h for r in spark.createDataFrame([(r[2],) for r in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = {(r.conv_id, r.turn, r.message): r for r in Q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(out) == len(rows)
    for c in (9, 10, 11):
        before = branch = place = None
        for t, m, text in sorted((t, h[x], x) for k, t, x in rows if k == c):
            r, quoted = out[c, t, m], quotes[c, t, text] and (quotes[c, t, text][0], h[quotes[c, t, text][1]])
            parent = quoted or before
            if before is None or quoted and quoted != before:
                branch, place = (t, m), parent or (t, m)
            assert (r.parent_turn, r.parent) == (parent or (None, None))
            assert (r.branch, r.branch_message, r.place, r.place_message) == (*branch, *place)
            before = (t, m)
        seen = set()
        for r in sorted((r for k, r in out.items() if k[0] == c), key=lambda r: (r.place, r.place_message, r.branch, r.branch_message, r.turn, r.message)):
            assert r.parent_turn is None or (r.parent_turn, r.parent) in seen
            seen.add((r.turn, r.message))


def test_equal_turns_are_apart(spark):
    df = spark.createDataFrame([(1, 0, "first"), (1, 1, "second"), (1, 2, "> first\nyes"), (1, 2, "> second\nno"), (1, 2, "> > yes\nnot of this turn")], "conv_id long, turn long, text string")
    out = {r.body: r for r in Q.conversations(df).collect()}
    assert (out["yes"].parent_turn, out["no"].parent_turn) == (0, 1)
    assert [out[b].n_linked for b in ("yes", "no", "not of this turn")] == [1, 1, 0]


def test_very_long_texts(spark):
    lines = [f"line {i} of it" for i in range(20_000)]
    df = spark.createDataFrame([(1, 0, "\n".join(lines)), (1, 1, "\n".join(f"> {x}" for x in lines[5_000:9_000]) + "\nquite so")], "conv_id long, turn long, text string")
    out = {r.turn: r for r in Q.conversations(df).collect()}
    assert (out[1].parent_turn, out[1].n_linked, out[1].body) == (0, 1, "quite so")


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "> a\nb"), (1, 1, "> a\nb")], "conv_id long, turn long, text string")
    assert sorted((r.turn, r.n_linked) for r in Q.conversations(df).collect()) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    assert Q.conversations(df.limit(0)).collect() == []
