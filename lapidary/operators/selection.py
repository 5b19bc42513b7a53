"""Budgeted selection. Each step depends on everything chosen before it. A book of up to FOLDED candidates (numbers and tags, no texts) is
folded in one task, books in parallel; larger books are decided in rounds over all their rows at once (greedy.py), with equal results.
Texts are joined back afterwards.

candidates: book_id, block_id, cand_pos, section_no, first_index, word_count, utility, covers, terms, redundant_with;
section table: book_id, section_no, section_pos, cap, cover (must the section be covered), included;
goals: book_id, ord, requirement_id; targets: book_id, target.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import greedy
from .scans import apart, numbered, running, written
from .structure import section_caps

#: How far past the target protected and late additions may go, and when the last pass starts and stops.
PROTECTED, OVERSHOOT, REVIEW_TOTAL, REVIEW_SECTION, START_BELOW, ENOUGH = 1.12, 1.03, 1.12, 1.15, 0.94, 0.97
LEAST_CAP = 600
#: The most candidates of a book that one task folds: numbers and tags, an estimated 1 KB each.
FOLDED = 200_000
CHOSEN = "book_id string, block_id string, step int, protected boolean, protected_for array<string>, target long"


class Budget:
    """Words used so far against a book's target and its sections' caps."""

    def __init__(self, target: int, caps: dict) -> None:
        self.target, self.caps, self.used = target, caps, 0
        self.by_section: dict = {}
        self.chosen: dict[str, dict] = {}

    def fits(self, b: dict, protected: bool = False, late: bool = False) -> bool:
        if b["block_id"] in self.chosen or not protected and self.conflicts(b):
            return False
        factor = PROTECTED if protected else OVERSHOOT if late else 1.0
        if self.used + b["word_count"] > int(self.target * factor):
            return False
        section = self.by_section.get(b["section_no"], 0) + b["word_count"]
        return protected or section <= self.caps.get(b["section_no"], LEAST_CAP)

    def conflicts(self, b: dict) -> bool:
        return any(r in self.chosen for r in b["redundant_with"])

    def take(self, b: dict, protected: bool = False) -> None:
        self.chosen[b["block_id"]] = {"protected": protected, "for": []}
        self.used += b["word_count"]
        self.by_section[b["section_no"]] = self.by_section.get(b["section_no"], 0) + b["word_count"]

    def first(self, blocks: Iterable[dict], goal: str | None = None) -> None:
        """Takes the first block that is chosen already (if it serves a goal) or fits as a protected one."""
        for b in blocks:
            if goal is not None and b["block_id"] in self.chosen:
                break
            if self.fits(b, protected=True):
                self.take(b, protected=True)
                break
        else:
            return
        if goal is not None and goal not in self.chosen[b["block_id"]]["for"]:
            self.chosen[b["block_id"]]["for"].append(goal)


def select_book(blocks: list[dict], goals: list[str], sections: list[dict], target: int) -> dict[str, dict]:
    """Chosen block ids in order: required goals, uncovered sections, value, and what is left of the budget."""
    budget = Budget(target, {s["section_no"]: s["cap"] for s in sections if s["cap"] is not None})
    anchors = sorted(blocks, key=lambda b: (-b["utility"], b["word_count"], b["cand_pos"]))
    tagged: dict[str, list[dict]] = {}
    for b in anchors:
        for tag in b["tags"]:
            tagged.setdefault(tag, []).append(b)
    for goal in goals:
        budget.first(tagged.get(goal, []), goal)
    for s in sections:
        if s["cover"] and not budget.by_section.get(s["section_no"]):
            budget.first(b for b in anchors if b["section_no"] == s["section_no"])
    ranked = sorted(blocks, key=lambda b: (-b["utility"], b["cand_pos"]))
    for b in ranked:
        if budget.fits(b):
            budget.take(b)
    if budget.used < int(target * START_BELOW):
        used = budget.used
        rest = [b for b in ranked if b["block_id"] not in budget.chosen and not budget.conflicts(b)]
        for b in sorted(rest, key=lambda b: (abs(used + b["word_count"] - target), -b["utility"])):
            if budget.fits(b, late=True):
                budget.take(b)
            if budget.used >= int(target * ENOUGH):
                break
    return budget.chosen


def select(candidates: DataFrame, sections: DataFrame, goals: DataFrame, targets: DataFrame, folded: int = FOLDED) -> DataFrame:
    """book_id, block_id, step (order of choice), protected, protected_for, target."""
    c = candidates.select("book_id", "block_id", "cand_pos", "section_no", "word_count", "utility", F.array_union("covers", "terms").alias("tags"), "redundant_with")
    return apart(c, ["book_id"], folded, lambda rows: _select_folded(rows, sections, goals, targets), lambda rows: _select_in_rounds(rows, sections, goals, targets))


def _select_folded(c: DataFrame, sections: DataFrame, goals: DataFrame, targets: DataFrame) -> DataFrame:
    per_book = sections.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("section_pos", "section_no", "cap", "cover", "included"))).alias("sections"))
    listed = goals.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "requirement_id"))).alias("goals"))
    side = targets.join(per_book, "book_id", "left").join(listed, "book_id", "left")

    def run(blocks: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or about.empty:
            return pd.DataFrame({k: [] for k in ("book_id", "block_id", "step", "protected", "protected_for", "target")}, dtype=object)
        row = about.iloc[0]
        sections = [dict(s) for s in (row["sections"] if row["sections"] is not None else []) if s["included"]]
        goals = [g["requirement_id"] for g in (row["goals"] if row["goals"] is not None else [])]
        names = ("block_id", "cand_pos", "section_no", "word_count", "utility", "tags", "redundant_with")
        rows = [dict(zip(names, r, strict=True)) for r in zip(*(blocks[k].tolist() for k in names), strict=True)]
        chosen = select_book(rows, goals, sections, int(row["target"]))
        return pd.DataFrame([{"book_id": row["book_id"], "block_id": k, "step": i, "protected": v["protected"], "protected_for": v["for"], "target": int(row["target"])} for i, (k, v) in enumerate(chosen.items())], columns=["book_id", "block_id", "step", "protected", "protected_for", "target"])

    return c.groupBy("book_id").cogroup(side.groupBy("book_id")).applyInPandas(run, CHOSEN)


def _scaled(words: str, factor: float) -> Column:
    return (F.col(words) * F.lit(factor)).cast("long")


def _used(books: DataFrame, chosen: DataFrame) -> DataFrame:
    """books with used, the words of their chosen blocks."""
    return books.join(chosen.groupBy("book_id").agg(F.sum("word_count").alias("_w")), "book_id", "left").withColumn("used", F.coalesce("_w", F.lit(0)).cast("long")).drop("_w")


def _open_rows(c: DataFrame, chosen: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Candidates not chosen and not redundant with what is chosen, with the words chosen in their section (section_used), and of these the
    pairs (book_id, pos, other_pos) by redundancy."""
    named = c.select("book_id", "block_id", F.explode("redundant_with").alias("other"))
    barred = named.join(chosen.select("book_id", F.col("block_id").alias("other")), ["book_id", "other"], "left_semi").select("book_id", "block_id").distinct()
    here = chosen.groupBy("book_id", "section_no").agg(F.sum("word_count").alias("section_used"))
    rows = c.join(chosen.select("book_id", "block_id"), ["book_id", "block_id"], "left_anti").join(barred, ["book_id", "block_id"], "left_anti")
    rows = rows.join(here, ["book_id", "section_no"], "left").withColumn("section_used", F.coalesce("section_used", F.lit(0)))
    places = rows.select("book_id", F.col("block_id").alias("other"), F.col(order).alias("other_pos"))
    pairs = rows.select("book_id", F.col(order).alias("pos"), F.explode("redundant_with").alias("other")).join(places, ["book_id", "other"]).select("book_id", "pos", "other_pos")
    return rows, pairs


def _select_in_rounds(c: DataFrame, sections: DataFrame, goals: DataFrame, targets: DataFrame) -> DataFrame:
    """The four passes over books of any size."""
    ranked = numbered(c.join(targets, "book_id"), ["book_id"], [F.desc("utility"), F.col("cand_pos")], "rank")
    c = written(numbered(ranked, ["book_id"], [F.desc("utility"), F.col("word_count"), F.col("cand_pos")], "place"), "candidates")
    books = written(c.groupBy("book_id").agg(F.max("target").alias("target")), "targets")
    own = ("book_id", "block_id", "section_no", "word_count")
    included = sections.where("included").join(books.select("book_id"), "book_id", "left_semi")
    caps = included.where("cap IS NOT NULL").groupBy("book_id", "section_no").agg(F.max("cap").alias("cap"))
    c = c.join(caps, ["book_id", "section_no"], "left").withColumn("cap", F.coalesce("cap", F.lit(LEAST_CAP)))
    limits = books.withColumn("total_limit", _scaled("target", PROTECTED))

    wanted = goals.join(books.select("book_id"), "book_id", "left_semi").select("book_id", "ord", "requirement_id")
    options = c.select("book_id", "block_id", "place", "word_count", F.explode("tags").alias("requirement_id")).join(wanted, ["book_id", "requirement_id"])
    met = greedy.first_fits(wanted, options, _used(limits, c.select(*own).limit(0)))
    kept_for = met.join(wanted, ["book_id", "ord"]).groupBy("book_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("ord", "requirement_id"))).alias("all"))
    kept_for = kept_for.select("book_id", "block_id", F.array_distinct("all.requirement_id").alias("protected_for"))
    first = met.where("fresh").select("book_id", "block_id", F.lit(1).alias("phase"), F.col("ord").alias("pos"))
    about = lambda picked: picked.join(c.select(*own), ["book_id", "block_id"])
    chosen = written(about(first), "chosen")

    has = chosen.groupBy("book_id", "section_no").agg(F.sum("word_count").alias("has"))
    bare = included.where("cover").join(has, ["book_id", "section_no"], "left").where(F.coalesce("has", F.lit(0)) == 0)
    bare = written(numbered(bare.select("book_id", "section_no", "section_pos"), ["book_id"], [F.col("section_pos"), F.col("section_no")], "ord"), "bare")
    options = c.join(chosen, ["book_id", "block_id"], "left_anti").join(bare.select("book_id", "section_no", "ord"), ["book_id", "section_no"])
    met = greedy.first_fits(bare, options, _used(limits, chosen))
    second = met.select("book_id", "block_id", F.lit(2).alias("phase"), F.col("ord").alias("pos"))
    chosen = written(chosen.unionByName(about(second)), "chosen")

    rows, pairs = _open_rows(c, chosen, "rank")
    rows = rows.join(_used(books, chosen).select("book_id", "used"), "book_id").withColumns({"pos": F.col("rank"), "total_limit": F.col("target"), "section_limit": F.col("cap"), "enough": F.lit(None).cast("long")})
    third = greedy.fill(rows, pairs).withColumn("phase", F.lit(3))
    chosen = written(chosen.unionByName(about(third)), "chosen")

    late = _used(books, chosen).where(F.col("used") < _scaled("target", START_BELOW)).select("book_id", "used")
    rest, _ = _open_rows(c.join(late, "book_id"), chosen, "rank")
    rest = numbered(rest, ["book_id"], [F.abs(F.col("used") + F.col("word_count") - F.col("target")), F.desc("utility"), F.col("rank")], "late")
    rows, pairs = _open_rows(rest.drop("section_used"), chosen, "late")
    rows = rows.withColumns({"pos": F.col("late"), "total_limit": _scaled("target", OVERSHOOT), "section_limit": F.col("cap"), "enough": _scaled("target", ENOUGH)})
    fourth = greedy.fill(rows, pairs).withColumn("phase", F.lit(4))
    chosen = chosen.unionByName(about(fourth)).join(kept_for, ["book_id", "block_id"], "left")
    out = numbered(chosen, ["book_id"], [F.col("phase"), F.col("pos")], "step").join(books, "book_id")
    safe = F.coalesce("protected_for", F.array().cast("array<string>"))
    return out.select("book_id", "block_id", (F.col("step") - 1).cast("int").alias("step"), (F.col("phase") <= 2).alias("protected"), safe.alias("protected_for"), "target")


def value_pass(candidates: DataFrame, caps: DataFrame, targets: DataFrame, folded: int = FOLDED) -> DataFrame:
    """The value pass alone over each book's ranked rows (no redundancy): book_id, block_id, rank."""
    rows = candidates.join(caps, ["book_id", "section_no"], "left").withColumn("cap", F.coalesce("cap", F.lit(LEAST_CAP).cast("long")))
    zero = F.lit(0).cast("long")
    limits = {"pos": F.col("rank"), "total_limit": F.col("target"), "section_limit": F.col("cap"), "used": zero, "section_used": zero, "enough": F.lit(None).cast("long")}
    large = lambda x: greedy.fill(x.join(targets, "book_id").withColumns(limits)).select("book_id", F.col("pos").alias("rank"), "block_id")
    return apart(rows, ["book_id"], folded, lambda x: _value_folded(x, targets), large)


def _value_folded(rows: DataFrame, targets: DataFrame) -> DataFrame:
    listed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block_id", F.col("section_no").cast("long").alias("section_no"), F.col("word_count").cast("long").alias("word_count"), "cap"))).alias("all")).join(targets, "book_id")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>")).alias("by"), F.array().cast("array<bigint>").alias("ranks"))

    def step(a, x):
        mine = F.coalesce(F.try_element_at(a["by"], x["section_no"]), F.lit(0).cast("long")) + x["word_count"]
        ok = (a["used"] + x["word_count"] <= F.col("target")) & (mine <= x["cap"])
        by = F.map_concat(F.map_filter(a["by"], lambda k, _: k != x["section_no"]), F.map_from_arrays(F.array(x["section_no"]), F.array(mine)))
        return F.struct(F.when(ok, a["used"] + x["word_count"]).otherwise(a["used"]).alias("used"), F.when(ok, by).otherwise(a["by"]).alias("by"), F.when(ok, F.concat(a["ranks"], F.array(x["rank"]))).otherwise(a["ranks"]).alias("ranks"))

    folded = listed.select("book_id", F.explode(F.aggregate("all", start, step)["ranks"]).alias("rank"))
    return folded.join(rows.select("book_id", "rank", "block_id"), ["book_id", "rank"])


def reading_order(chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds reading_pos (from 1): section position, then first paragraph; unknown sections last."""
    rows = chosen.join(sections.select("book_id", "section_no", "section_pos"), ["book_id", "section_no"], "left")
    place = F.row_number().over(W.partitionBy("book_id").orderBy(F.col("section_pos").asc_nulls_last(), "first_index", "cand_pos"))
    return rows.withColumn("reading_pos", place.cast("long")).drop("section_pos")


def review_removals(chosen: DataFrame, asked: DataFrame) -> DataFrame:
    """book_id, block_id: removals asked for (book_id, block_id) that stand: known, protected for nothing, and not the only block
    of its section before the review."""
    alone = F.count("*").over(W.partitionBy("book_id", "section_no"))
    open_ = chosen.withColumn("n", alone).where((F.col("n") > 1) & (F.size("protected_for") == 0))
    return open_.join(asked.select("book_id", "block_id").distinct(), ["book_id", "block_id"], "left_semi").select("book_id", "block_id")


def review_additions(kept: DataFrame, candidates: DataFrame, asked: DataFrame, caps: DataFrame, targets: DataFrame, folded: int = FOLDED) -> DataFrame:
    """book_id, block_id, pos of additions asked for (book_id, pos, block_id) that fit, in order. kept: book_id, block_id, section_no,
    word_count; candidates also protected_for."""
    info = candidates.select("book_id", "block_id", "section_no", "word_count", (F.size("protected_for") > 0).alias("safe"))
    # what did not fit does not fit later, so the first of repeated requests decides
    first = asked.groupBy("book_id", "block_id").agg(F.min("pos").alias("pos"))
    wanted = first.join(info, ["book_id", "block_id"]).join(kept.select("book_id", "block_id"), ["book_id", "block_id"], "left_anti")
    used = kept.groupBy("book_id", "section_no").agg(F.sum("word_count").alias("words"))
    caps = caps.select("book_id", "section_no", "cap")
    return apart(wanted, ["book_id"], folded, lambda x: _additions_folded(x, used, caps, targets), lambda x: _additions_in_rounds(x, used, caps, targets))


def _additions_in_rounds(wanted: DataFrame, used: DataFrame, caps: DataFrame, targets: DataFrame) -> DataFrame:
    rows = wanted.join(targets, "book_id").join(used, ["book_id", "section_no"], "left").join(caps, ["book_id", "section_no"], "left")
    rows = rows.join(used.groupBy("book_id").agg(F.sum("words").alias("used")), "book_id", "left")
    cap = (F.coalesce("cap", F.lit(LEAST_CAP)) * F.lit(REVIEW_SECTION)).cast("long")
    rows = rows.withColumns({"used": F.coalesce("used", F.lit(0)), "section_used": F.coalesce("words", F.lit(0)), "section_limit": F.when(~F.col("safe"), cap), "total_limit": _scaled("target", REVIEW_TOTAL), "enough": F.lit(None).cast("long")})
    return greedy.fill(rows).select("book_id", "block_id", "pos")


def _additions_folded(wanted: DataFrame, used: DataFrame, caps: DataFrame, targets: DataFrame) -> DataFrame:

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not a.empty and not b.empty:
            state = b.iloc[0]
            by = {int(k): int(v) for k, v in state["used"] or []}
            caps_of = {int(k): int(v) for k, v in state["caps"] or []}
            total, done, target = sum(by.values()), set(), int(state["target"])
            for r in a.sort_values("pos").to_dict("records"):
                if r["block_id"] in done:
                    continue
                section = by.get(r["section_no"], 0) + r["word_count"]
                cap = int(caps_of.get(r["section_no"], LEAST_CAP) * REVIEW_SECTION)
                if total + r["word_count"] <= int(target * REVIEW_TOTAL) and (section <= cap or r["safe"]):
                    out.append({"book_id": r["book_id"], "block_id": r["block_id"], "pos": r["pos"]})
                    done.add(r["block_id"])
                    total += r["word_count"]
                    by[r["section_no"]] = section
        return pd.DataFrame(out, columns=["book_id", "block_id", "pos"])

    pairs = lambda df, v, into: df.groupBy("book_id").agg(F.collect_list(F.array(F.col("section_no").cast("long"), F.col(v).cast("long"))).alias(into))
    side = targets.join(pairs(used, "words", "used"), "book_id", "left").join(pairs(caps, "cap", "caps"), "book_id", "left")
    side = side.withColumns({c: F.coalesce(c, F.array().cast("array<array<bigint>>")) for c in ("used", "caps")})
    safe = lambda x: [tuple(p) for p in x]

    def wrapped(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not b.empty:
            b = b.assign(used=b["used"].map(safe), caps=b["caps"].map(safe))
        return run(key, a, b)

    return wanted.groupBy("book_id").cogroup(side.groupBy("book_id")).applyInPandas(wrapped, "book_id string, block_id string, pos long")


def target_words(books: DataFrame, ratio: float) -> DataFrame:
    return books.select("book_id", (F.col("total_words") * F.lit(ratio).cast("double")).cast("long").alias("target"))


def caps_of(sections: DataFrame, targets: DataFrame, priorities: DataFrame | None = None) -> DataFrame:
    return section_caps(sections.join(targets, "book_id"), F.col("target"), priorities)


def balance(sections: DataFrame, chosen: DataFrame) -> DataFrame:
    """sections (book_id, section_no, word_count, ...) with retained (chosen words), of_section and of_edition (shares)."""
    kept = chosen.groupBy("book_id", "section_no").agg(F.sum("word_count").alias("retained"))
    rows = sections.join(kept, ["book_id", "section_no"], "left").withColumn("retained", F.coalesce("retained", F.lit(0)).cast("long"))
    edition = rows.groupBy("book_id").agg(F.sum("retained").alias("_edition"))
    share = lambda whole: F.col("retained") / F.greatest(whole, F.lit(1))
    return rows.join(edition, "book_id").withColumns({"of_section": share(F.col("word_count")), "of_edition": share(F.col("_edition"))}).drop("_edition")


def totals(books: DataFrame, targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """books (book_id, total_words, ...) with target, selected (words), blocks and share; books without passages keep 0."""
    kept = chosen.groupBy("book_id").agg(F.sum("word_count").alias("selected"), F.count("*").alias("blocks"))
    rows = books.join(targets, "book_id").join(kept, "book_id", "left").fillna(0, ["selected", "blocks"])
    return rows.withColumn("share", F.col("selected") / F.greatest("total_words", F.lit(1)))


def overlap(passages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """book_id, selected_words, union_words, overlap_words: words of passages (book_id, section_no, first, last: places of paragraphs), those of
    the paragraphs they cover, and what they hold more than once. A sweep over the passages' ends: at each place, how many have begun and
    not ended. paragraphs: book_id, section_no, idx, words."""
    at = lambda df, place, step: df.select("book_id", "section_no", (F.col(place).cast("long") * 2).alias("_at"), F.lit(step).cast("long").alias("_step"))
    ends = at(passages.where("first <= last"), "first", 1).unionByName(at(passages.where("first <= last").withColumn("last", F.col("last") + 1), "last", -1))
    ends = ends.groupBy("book_id", "section_no", "_at").agg(F.sum("_step").alias("_step")).withColumn("words", F.lit(0).cast("long"))
    rows = paragraphs.select("book_id", "section_no", (F.col("idx").cast("long") * 2 + 1).alias("_at"), F.lit(0).cast("long").alias("_step"), F.col("words").cast("long").alias("words"))
    swept = running(ends.unionByName(rows), ["book_id", "section_no"], "_at", {"open": F.col("_step")})
    sums = {"selected_words": F.col("words") * F.col("open"), "union_words": F.when(F.col("open") > 0, F.col("words")).otherwise(0), "overlap_words": F.col("words") * F.greatest(F.col("open") - 1, F.lit(0))}
    return swept.groupBy("book_id").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
