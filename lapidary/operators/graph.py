"""The requirement graph: one-hop repairs, checks, orders and coverage as joins within a book.

requirements: book_id, pos, requirement_id, kind, description, importance, claims, sections, must (boolean);
relations: book_id, pos, source, target, relation; path: book_id, pos, requirement_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import support_link_score
from .scans import written

SUPPORT_KINDS = ("supporting_argument", "evidence")
#: Ids in a list of tiles(), about. A task holds the rows of a pair of lists at once: so many squared.
TILE = 256


def orphans(requirements: DataFrame, relations: DataFrame) -> DataFrame:
    """Propositions that must be kept and that nothing supports."""
    supported = relations.where("relation = 'supports'").select("book_id", F.col("target").alias("requirement_id"))
    return requirements.where((F.col("kind") == "major_proposition") & F.col("must")).join(supported, ["book_id", "requirement_id"], "left_anti")


def repaired(requirements: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each orphan gets a supports edge: from the support requirement with most shared sections and claims (the first on a tie, even
    with none), or from a new requirement if the book has no support at all. New edges say whether they are weak (no overlap)."""
    alone = orphans(requirements, relations)
    support = requirements.where(F.col("kind").isin(*SUPPORT_KINDS)).select("book_id", F.col("pos").alias("s_pos"), F.col("requirement_id").alias("s_id"), F.col("sections").alias("s_sections"), F.col("claims").alias("s_claims"))
    # distinct (sections, claims) of propositions meet those of supports, the first of each, by what they share; what shares nothing with any
    # support takes the book's first
    like = ["book_id", "s_sections", "s_claims"]
    first = support.groupBy(*like).agg(F.min_by("s_id", "s_pos").alias("s_id"), F.min("s_pos").alias("s_pos"))
    shared = lambda s, c: F.explode(F.array_distinct(F.concat(F.transform(s, lambda x: F.concat(F.lit("s "), x)), F.transform(c, lambda x: F.concat(F.lit("c "), x))))).alias("token")
    sets = alone.select("book_id", "sections", "claims").distinct()
    paired = sets.select("*", shared("sections", "claims")).join(first.select("*", shared("s_sections", "s_claims")), ["book_id", "token"]).drop("token").distinct()
    paired = paired.withColumn("link", support_link_score("sections", "s_sections", "claims", "s_claims")).where("link > 0").select("book_id", "sections", "claims", "s_id", "s_pos", "link")
    least = first.groupBy("book_id").agg(F.min_by("s_id", "s_pos").alias("s_id"), F.min("s_pos").alias("s_pos"))
    paired = paired.unionByName(sets.join(least, "book_id").withColumn("link", F.lit(0)))
    best = paired.groupBy("book_id", "sections", "claims").agg(F.max_by(F.struct("s_id", "link", "s_pos"), F.struct("link", -F.col("s_pos"))).alias("b"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ("book_id", "sections", "claims")], "b")
    met = alone.join(best, (F.col("book_id") == F.col("_book_id")) & F.col("sections").eqNullSafe(F.col("_sections")) & F.col("claims").eqNullSafe(F.col("_claims")))
    best = met.groupBy("book_id", "pos", "requirement_id").agg(F.max_by("b", F.struct("b.link", -F.col("b.s_pos"))).alias("b"))
    edges = best.select("book_id", F.col("pos").alias("p"), F.col("b.s_id").alias("source"), F.col("requirement_id").alias("target"), (F.col("b.link") == 0).alias("weak"))
    bare = alone.join(support.select("book_id").distinct(), "book_id", "left_anti").withColumn("new_id", F.concat(F.lit("auto-support-for-"), "requirement_id"))
    edges = edges.unionByName(bare.select("book_id", F.col("pos").alias("p"), F.col("new_id").alias("source"), F.col("requirement_id").alias("target"), F.lit(False).alias("weak")))
    count = relations.groupBy("book_id").agg(F.max("pos").alias("most"))
    edges = edges.join(count, "book_id", "left").withColumn("pos", F.coalesce("most", F.lit(0)) + F.row_number().over(W.partitionBy("book_id").orderBy("p")))
    all_edges = relations.withColumn("weak", F.lit(False)).unionByName(edges.select("book_id", F.col("pos").cast("long").alias("pos"), "source", "target", F.lit("supports").alias("relation"), "weak"))
    known = requirements.select("book_id", F.col("requirement_id").alias("new_id"))
    made = bare.join(known, ["book_id", "new_id"], "left_anti")
    most = requirements.groupBy("book_id").agg(F.max("pos").alias("most"))
    made = made.join(most, "book_id")
    text = F.concat(F.lit("Reasoning or evidence needed for "), F.col("requirement_id"), F.lit(": "), F.col("description"))
    made = made.select(
        "book_id", (F.col("most") + F.row_number().over(W.partitionBy("book_id").orderBy("pos"))).cast("long").alias("pos"), F.col("new_id").alias("requirement_id"),
        F.lit("supporting_argument").alias("kind"), text.alias("description"), F.lit("essential").alias("importance"), "claims", "sections", F.lit(True).alias("must"),
    )
    return requirements.unionByName(made), all_edges


def violations(requirements: DataFrame, relations: DataFrame, path: DataFrame) -> DataFrame:
    """book_id, violation, item: duplicate ids, unknown path ids, dangling edges, propositions without or with unfit support."""
    ids = requirements.select("book_id", "requirement_id").distinct()
    on = ["book_id", "requirement_id"]

    def named(df: DataFrame, what: str) -> DataFrame:
        return df.select("book_id", F.lit(what).alias("violation"), F.col("requirement_id").alias("item"))

    double = named(requirements.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), "duplicate requirement")
    unknown = named(path.join(ids, on, "left_anti").select(*on).distinct(), "unknown path requirement")
    ends = relations.select("book_id", F.explode(F.array("source", "target")).alias("requirement_id")).distinct()
    dangling = named(ends.join(ids, on, "left_anti"), "dangling relation")
    bare = named(orphans(requirements, relations).select(*on).distinct(), "unsupported proposition")
    essential = requirements.where((F.col("kind") == "major_proposition") & F.col("must")).select("book_id", F.col("requirement_id").alias("target")).distinct()
    sources = relations.where("relation = 'supports'").join(essential, ["book_id", "target"], "left_semi").select("book_id", F.col("source").alias("requirement_id"))
    unfit = named(sources.join(requirements.where(~F.col("kind").isin(*SUPPORT_KINDS)), on, "left_semi").distinct(), "unfit support")
    return double.unionByName(unknown).unionByName(dangling).unionByName(bare).unionByName(unfit)


def promoted(requirements: DataFrame, relations: DataFrame) -> DataFrame:
    """Requirements that support an essential proposition must be kept too, as essential."""
    essential = requirements.where((F.col("kind") == "major_proposition") & F.col("must")).select("book_id", F.col("requirement_id").alias("target"))
    needed = relations.where("relation = 'supports'").join(essential, ["book_id", "target"], "left_semi").select("book_id", F.col("source").alias("requirement_id")).distinct().withColumn("needed", F.lit(True))
    rows = requirements.join(needed, ["book_id", "requirement_id"], "left")
    raised = F.coalesce("needed", F.lit(False)) & ~F.col("must")
    return rows.withColumns({"importance": F.when(raised, "essential").otherwise(F.col("importance")), "must": F.col("must") | raised}).drop("needed").select(*requirements.columns)


def mandatory_order(requirements: DataFrame, path: DataFrame) -> DataFrame:
    """book_id, ord, requirement_id: requirements to keep, first those of the reading path in its order, then the rest in the map's."""
    must = requirements.where("must").select("book_id", "requirement_id", F.col("pos").alias("map_pos"))
    first = path.groupBy("book_id", "requirement_id").agg(F.min("pos").alias("path_pos"))
    rows = must.join(first, ["book_id", "requirement_id"], "left")
    place = F.row_number().over(W.partitionBy("book_id").orderBy(F.col("path_pos").asc_nulls_last(), "map_pos"))
    return rows.select("book_id", place.cast("long").alias("ord"), "requirement_id")


def requirement_classes(sections: DataFrame, requirements: DataFrame) -> DataFrame:
    """book_id, section_id, requirement_id as classes: requirements that name a section; those that name none fit all the book's sections (one
    row, section_id null); a section that none fits takes all of the book's (one row, requirement_id null)."""
    known = sections.select("book_id", "section_id").distinct()
    named = requirements.select("book_id", F.explode(F.array_distinct("sections")).alias("section_id"), "requirement_id").join(known, ["book_id", "section_id"])
    general = requirements.where(F.size("sections") == 0).join(known.select("book_id").distinct(), "book_id", "left_semi").select("book_id", F.lit(None).cast("string").alias("section_id"), "requirement_id")
    bare = known.join(named, ["book_id", "section_id"], "left_anti").join(general.select("book_id").distinct(), "book_id", "left_anti")
    bare = bare.join(requirements.select("book_id").distinct(), "book_id", "left_semi").withColumn("requirement_id", F.lit(None).cast("string"))
    return named.select("book_id", "section_id", "requirement_id").distinct().unionByName(general.distinct()).unionByName(bare)


def section_requirements(sections: DataFrame, requirements: DataFrame) -> DataFrame:
    """book_id, section_id, requirement_id: every section with each requirement that names it or no section, or with all of the book's if that
    leaves none. What fits whole books is paired as lists of some TILE ids, which tasks explode, so that neither a task nor a broadcast holds the pairs."""
    classes = written(requirement_classes(sections, requirements), "classes")
    known = sections.select("book_id", "section_id").distinct()
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = lambda some, wanted: tiles(some, "section_id", wanted, "requirement_id", n)
    bare = classes.where("requirement_id IS NULL").select("book_id", "section_id")
    general = classes.where("section_id IS NULL")
    # a requirement with one row that names sections and one that names none is paired once
    named = classes.where("section_id IS NOT NULL AND requirement_id IS NOT NULL").join(general.hint("merge"), ["book_id", "requirement_id"], "left_anti")
    return named.select("book_id", "section_id", "requirement_id").unionByName(paired(known, general)).unionByName(paired(bare, requirements))


def tiles(left: DataFrame, a: str, right: DataFrame, b: str, parts: int) -> DataFrame:
    """book_id, a, b: all pairs of a book's distinct ids in left and right. Ids are put in lists of about TILE by hash, lists are paired and dealt
    over at least `parts` tasks, and only then do lists become rows: what is shuffled is a list for every TILE rows."""

    def lists(df: DataFrame, column: str) -> DataFrame:
        rows = df.select("book_id", column).distinct()
        per = rows.groupBy("book_id").agg(F.ceil(F.count("*") / TILE).alias("_lists"))
        rows = rows.join(per, "book_id").withColumn(f"_{column}", F.pmod(F.xxhash64(column), F.col("_lists")))
        return rows.groupBy("book_id", f"_{column}").agg(F.collect_list(column).alias(f"{column}s"))

    paired = lists(left, a).join(lists(right, b).hint("merge"), "book_id").repartition(parts, "book_id", f"_{a}", f"_{b}")
    return paired.select("book_id", F.explode(f"{a}s").alias(a), f"{b}s").select("book_id", a, F.explode(f"{b}s").alias(b))


def requirements_of_sections(sections: DataFrame, requirements: DataFrame) -> DataFrame:
    """book_id, section_id, requirements: the list for each section, put together from the classes."""
    classes = requirement_classes(sections, requirements)
    listed = lambda df, *keys: df.groupBy(*keys).agg(F.array_sort(F.collect_set("requirement_id")).alias("ids"))
    named = listed(classes.where("section_id IS NOT NULL AND requirement_id IS NOT NULL"), "book_id", "section_id").withColumnRenamed("ids", "named")
    general = listed(classes.where("section_id IS NULL"), "book_id").withColumnRenamed("ids", "general")
    every = listed(requirements, "book_id").withColumnRenamed("ids", "every")
    rows = sections.select("book_id", "section_id").distinct().join(named, ["book_id", "section_id"], "left").join(general, "book_id", "left").join(every, "book_id")
    none = F.array().cast("array<string>")
    fit = F.array_sort(F.array_union(F.coalesce("named", none), F.coalesce("general", none)))
    return rows.select("book_id", "section_id", F.when(F.size(fit) > 0, fit).otherwise(F.col("every")).alias("requirements"))


def coverage(blocks: DataFrame, requirements: DataFrame) -> DataFrame:
    """book_id, requirement_id, must, block_ids: the blocks (book_id, block_id, ord, covers, terms) that cover each requirement."""
    tags = blocks.select("book_id", "block_id", "ord", F.explode(F.array_distinct(F.concat("covers", "terms"))).alias("requirement_id"))
    found = tags.groupBy("book_id", "requirement_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block_id")))["block_id"].alias("block_ids"))
    rows = requirements.select("book_id", "requirement_id", "must").join(found, ["book_id", "requirement_id"], "left")
    return rows.withColumn("block_ids", F.coalesce("block_ids", F.array().cast("array<string>")))


def missing(blocks: DataFrame, requirements: DataFrame) -> DataFrame:
    """book_id, requirement_id: requirements to keep that no block covers."""
    return coverage(blocks, requirements).where(F.col("must") & (F.size("block_ids") == 0)).select("book_id", "requirement_id")


def proposition_supports(requirements: DataFrame, relations: DataFrame) -> DataFrame:
    """book_id, requirement_id, supports (in edge order) of the major propositions."""
    edges = relations.where("relation = 'supports'").groupBy("book_id", F.col("target").alias("requirement_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "source")))["source"].alias("supports"))
    rows = requirements.where("kind = 'major_proposition'").select("book_id", "requirement_id").join(edges, ["book_id", "requirement_id"], "left")
    return rows.withColumn("supports", F.coalesce("supports", F.array().cast("array<string>")))
