"""A condensing run: parse, gate, analyse, nominate, score, select, review, bridge, render. Every table is Parquet under the output
folder; answers of the provider are written before they are read. All books of the input run together, keyed by book_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules, text
from ..operators import bridges as B
from ..operators import graph, scoring, selection, structure
from ..sources import loaders
from . import files, render
from . import provider as P
from .config import Config, problems

ARTEFACTS = ("paragraphs", "sections", "books", "violations", "structure_report", "overview", "analyses", "requirements", "relations", "path", "map_violations", "candidates", "scored", "chosen", "review", "bridges", "edition", "audit", "guide", "summary")


def _seq():
    """A chunk's place in its book."""
    return (F.col("section_no") * 1_000_000 + F.col("chunk")).cast("long")


class Run:
    def __init__(self, spark: SparkSession, config: Config, provider=None, extract=None) -> None:
        if found := problems(config):
            raise ValueError("; ".join(found))
        hosted = None if config.model == "offline" else P.Hosted(config.model, config.endpoint)
        self.spark, self.config, self.provider, self.extract = spark, config, provider or hosted or P.Offline(), extract

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.config.output}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ask(self, requests: DataFrame, stage: str) -> DataFrame:
        """Parsed answers. What the output folder already holds, of this run or an earlier one, is not asked for again; new answers are
        appended before anything reads them. An answer counts by its request's hash."""
        store = f"{self.config.output}/answers/{stage}"
        requests = self.keep(requests, f"requests/{stage}")
        known = self.spark.read.schema("hash string, answer string, error string").parquet(store) if files.exists(self.spark, store) else None
        P.answers(requests, stage, self.provider, self.config.retries, known).write.mode("append").parquet(store)
        found = P.answered(requests, stage, self.spark.read.schema("hash string, answer string, error string").parquet(store))
        self.keep(P.schema_faults(found, stage), f"schema_faults/{stage}")
        return P.parsed(found, stage)

    # parse

    def parse(self) -> dict[str, DataFrame]:
        """paragraphs, sections, books and violations; the report is written before the gate, so that it can be read if the gate is shut."""
        chapter_map = loaders.read_chapter_map(self.spark, self.config.chapter_map, self.config.input) if self.config.chapter_map else None
        blocks, about = loaders.load_books(self.spark, self.config.input, self.extract, chapter_map)
        about = self.keep(about, "diagnostics")
        paras = self.keep(structure.paragraphs(blocks), "paragraphs")
        secs = self.keep(structure.sections(paras), "sections")
        books = about.select("book_id", F.coalesce(F.lit(self.config.title), "title").alias("title")).join(structure.books(secs), "book_id")
        books = self.keep(books, "books")
        self.keep(render.as_text(render.structure_report(secs, about)), "structure_report")
        gate = self.keep(rules.structure_violations(secs, about.select("book_id", "proceed")), "violations")
        return {"paragraphs": paras, "sections": secs, "books": books, "violations": gate}

    # analyse

    def _rendered(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        one = F.struct("idx", "paragraph_id", "text", "word_count")
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("paragraphs"), F.sum("word_count").alias("words"))

    def analyse(self, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        c = self.config
        shut = t["violations"].where(F.size("violations") > 0).select("book_id")
        t = {k: v.join(shut, "book_id", "left_anti") if k != "violations" else v for k, v in t.items()}
        secs, books = t["sections"], t["books"]
        included = secs.where("kind <> 'exclude'")
        listed = included.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "section_id", "title", "word_count", "kind"))).alias("sections"))
        excerpt = structure.overview_excerpt(t["paragraphs"], secs, c.overview_words).select("book_id", "part", "section_no", "idx").join(t["paragraphs"], ["book_id", "section_no", "idx"])
        excerpt = excerpt.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "section_no", "idx", "paragraph_id", "text"))), lambda x: F.struct(x["paragraph_id"], x["text"])).alias("excerpt"))
        ask = books.join(listed, "book_id").join(excerpt, "book_id", "left").select("book_id", F.lit(0).cast("long").alias("seq"), F.to_json(F.struct("title", F.lit(c.emphasis).alias("emphasis"), "sections", "excerpt")).alias("request"))
        overview = self.keep(self.ask(ask, "overview").select("book_id", "a.*").withColumn("form", F.when(F.col("form").isin(*P.FORMS), F.col("form")).otherwise("mixed")), "overview")
        rows = t["paragraphs"].join(included.select("book_id", "section_no"), ["book_id", "section_no"], "left_semi")
        chunks = self.keep(structure.bins(rows, ["book_id", "section_no"], "idx", "word_count", c.chunk_words), "chunks")
        per = self._rendered(chunks, ["book_id", "section_no", "section_id", "title", "chunk"])
        per = self.keep(per.withColumn("seq", _seq()), "chunk_texts")
        ask = per.select("book_id", "seq", F.to_json(F.struct("section_id", "title", "chunk", "paragraphs")).alias("request"))
        # ids are stamped from the request, whatever the answer says
        analyses = self.ask(ask, "analysis").join(per.select("book_id", "seq", "section_no", "section_id", "chunk"), ["book_id", "seq"])
        analyses = self.keep(analyses.select("book_id", "seq", "section_no", "section_id", F.concat("section_id", F.format_string("-A%02d", "chunk")).alias("analysis_id"), "a.*"), "analyses")
        listed = analyses.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "section_id", "analysis_id", "role", "contribution", "terms", "propositions"))).alias("analyses"))
        ask = books.join(listed, "book_id").select("book_id", F.lit(0).cast("long").alias("seq"), F.to_json(F.struct("title", "analyses")).alias("request"))
        found = self.ask(ask, "map").select("book_id", "a.*")
        reqs = found.select("book_id", "problem", "unity", F.posexplode("requirements").alias("pos", "q")).select("book_id", F.col("pos").cast("long").alias("pos"), "q.*")
        reqs = reqs.where(F.col("kind").isin(*P.KINDS)).select("book_id", "pos", "requirement_id", "kind", "description", "importance", *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in ("claims", "sections")], F.coalesce("must", F.lit(False)).alias("must"))
        rels = found.select("book_id", F.posexplode("relations").alias("pos", "r")).select("book_id", F.col("pos").cast("long").alias("pos"), "r.*").where(F.col("relation").isin(*P.RELATIONS))
        path = self.keep(found.select("book_id", F.posexplode("path").alias("pos", "requirement_id")).withColumn("pos", F.col("pos").cast("long")), "path")
        reqs, rels = graph.repaired(self.keep(reqs, "raw_requirements"), self.keep(rels, "raw_relations"))
        rels = self.keep(rels, "relations")
        reqs = self.keep(graph.promoted(reqs, rels), "requirements")
        self.keep(graph.violations(reqs, rels, path), "map_violations")
        heads = self.keep(found.select("book_id", "problem", "unity"), "map")
        return t | {"overview": overview, "chunks": chunks, "chunk_texts": per, "requirements": reqs, "relations": rels, "path": path, "map": heads}

    # nominate and score

    def nominate(self, t: dict[str, DataFrame]) -> DataFrame:
        fits = graph.requirements_of_sections(t["sections"], t["requirements"])
        per = t["chunk_texts"].join(fits, ["book_id", "section_id"], "left").join(t["overview"].select("book_id", P.guidance(F.col("form")).alias("guidance")), "book_id", "left")
        words = F.greatest(F.lit(100).cast("long"), (F.col("words") * F.lit(self.config.candidate_ratio).cast("double")).cast("long"))
        ask = per.select("book_id", "seq", F.to_json(F.struct("section_id", "title", "requirements", words.alias("words"), "guidance", "paragraphs")).alias("request"))
        found = self.ask(ask, "nominate").select("book_id", "seq", F.posexplode("a.blocks").alias("n", "b")).select("book_id", "seq", "n", "b.*")
        chunk = t["chunks"].withColumn("pos", F.row_number().over(W.partitionBy("book_id", "section_no", "chunk").orderBy("idx")).cast("long"))
        chunk = chunk.select("book_id", "section_no", _seq().alias("seq"), "pos", "idx", "paragraph_id", "text", "word_count")
        wanted = found.select("book_id", "seq", "n", "reason", F.explode("paragraph_ids").alias("paragraph_id")).join(chunk, ["book_id", "seq", "paragraph_id"])
        runs = structure.run_blocks(wanted.where(F.col("n").isNotNull()), ["book_id", "seq", "n"])
        number = F.row_number().over(W.partitionBy("book_id", "seq").orderBy("n", "run"))
        known = t["requirements"].groupBy("book_id").agg(F.collect_set("requirement_id").alias("known"))
        rows = runs.withColumn("k", number).join(found.drop("reason", "paragraph_ids"), ["book_id", "seq", "n"]).join(t["chunk_texts"].select("book_id", "seq", "section_no", "section_id", "title", "chunk"), ["book_id", "seq"]).join(known, "book_id", "left")
        tags = {x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda r: F.coalesce(F.array_contains("known", r), F.lit(False))) for x in ("covers", "terms", "supports", "requires")}
        place = t["paragraphs"].select("book_id", F.col("paragraph_id").alias("first_id"), F.col("idx").alias("first_index"), F.col("page").alias("first_page"))
        last = t["paragraphs"].select("book_id", F.col("paragraph_id").alias("last_id"), F.col("idx").alias("last_index"), F.col("page").alias("last_page"))
        rows = rows.withColumns(tags).withColumns({"block_id": F.concat("section_id", F.format_string("-K%02d-B%02d", "chunk", "k")), "first_id": F.element_at("paragraph_ids", 1), "last_id": F.element_at("paragraph_ids", -1)})
        rows = rows.join(place, ["book_id", "first_id"]).join(last, ["book_id", "last_id"])
        rows = rows.withColumn("cand_pos", F.row_number().over(W.partitionBy("book_id").orderBy("seq", "k")).cast("long"))
        function = F.when(F.col("block_function").isin(*P.FUNCTIONS), F.col("block_function")).otherwise("supporting")
        return self.keep(rows.drop("n", "k", "run", "known").withColumn("block_function", function), "candidates")

    def score(self, t: dict[str, DataFrame], candidates: DataFrame) -> DataFrame:
        rows = structure.batches(candidates, ["book_id"], "cand_pos", self.config.score_batch)
        one = F.struct("cand_pos", "block_id", "section_id", "word_count", "block_function", "covers", "terms", "supports", "reason", text.truncate_words("text", 180).alias("preview"))
        per = rows.groupBy("book_id", "batch").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
        ask = per.select("book_id", F.col("batch").alias("seq"), F.to_json(F.struct("blocks")).alias("request"))
        found = self.ask(ask, "score").select("book_id", "seq", F.posexplode("a.scores").alias("n", "s")).select("book_id", (F.col("seq") * 10_000 + F.col("n")).alias("seq"), "s.*")
        found = P.sound_scores(found).join(t["overview"].select("book_id", "form"), "book_id")
        scores = found.withColumn("score", scoring.rubric(F.col("form")))
        same = scores.groupBy("book_id", "block_id").agg(F.max_by(F.coalesce("redundant_with", F.array().cast("array<string>")), "seq").alias("redundant_with"))
        rows = scoring.with_scores(candidates, scores.select("book_id", "block_id", "seq", "score")).join(same, ["book_id", "block_id"], "left")
        rows = rows.withColumn("redundant_with", F.coalesce("redundant_with", F.array().cast("array<string>")))
        pr = t["overview"].select("book_id", F.posexplode("priorities").alias("seq", "p")).select("book_id", "seq", F.col("p.section_id").alias("section_id"), F.col("p.priority").alias("priority")).join(t["sections"].select("book_id", "section_id", "section_no"), ["book_id", "section_id"])
        self.priorities = self.keep(pr.select("book_id", "section_no", "seq", F.lower("priority").alias("priority")), "priorities")
        rows = scoring.with_priority(rows, self.priorities)
        value = scoring.utility(F.col("score"), F.col("word_count"), F.col("priority"), F.col("block_function"), F.col("covers"), F.col("terms"), F.col("supports"))
        return self.keep(rows.withColumn("utility", value), "scored")

    # select, review, bridge

    def select(self, t: dict[str, DataFrame], scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        targets = self.keep(selection.target_words(t["books"], self.config.target_ratio), "targets")
        last = self.priorities.groupBy("book_id", "section_no").agg(F.max_by("priority", "seq").alias("priority"))
        caps = self.keep(selection.caps_of(t["sections"], targets, last), "caps")
        s = t["sections"].join(last, ["book_id", "section_no"], "left").join(caps, ["book_id", "section_no"], "left")
        s = s.select("book_id", "section_no", F.col("section_no").alias("section_pos"), "cap", rules.coverage_required(self.config.coverage, F.col("kind"), F.col("priority")).alias("cover"), (F.col("kind") != "exclude").alias("included"))
        goals = graph.mandatory_order(t["requirements"], t["path"])
        chosen = selection.select(scored, s, goals, targets).drop("target")
        return self.keep(chosen, "selection"), targets, caps

    def review(self, t: dict[str, DataFrame], scored: DataFrame, chosen: DataFrame, targets: DataFrame, caps: DataFrame) -> DataFrame:
        rows = chosen.join(scored, ["book_id", "block_id"])
        other = scoring.top_alternatives(scored, chosen)
        one = lambda place, words: F.array_sort(F.collect_list(F.struct(place, "block_id", "section_id", "word_count", "score", "covers", "supports", "reason", text.truncate_words("text", words).alias("preview"))))
        ask = targets.join(rows.groupBy("book_id").agg(one("step", 120).alias("chosen")), "book_id").join(other.groupBy("book_id").agg(one("rank", 120).alias("alternatives")), "book_id", "left")
        ask = ask.select("book_id", F.lit(0).cast("long").alias("seq"), F.to_json(F.struct("target", "chosen", F.coalesce("alternatives", F.array()).alias("alternatives"))).alias("request"))
        found = self.keep(self.ask(ask, "review").select("book_id", "a.*"), "review")
        if self.config.apply_qc:
            asked = found.select("book_id", F.explode("remove_ids").alias("block_id"))
            gone = selection.review_removals(rows, asked)
            kept = chosen.join(gone, ["book_id", "block_id"], "left_anti")
            more = found.select("book_id", F.posexplode("add_ids").alias("pos", "block_id")).select("book_id", F.col("pos").cast("long").alias("pos"), "block_id")
            safe = scored.join(chosen.select("book_id", "block_id", "protected_for"), ["book_id", "block_id"], "left").withColumn("protected_for", F.coalesce("protected_for", F.array().cast("array<string>")))
            added = selection.review_additions(kept.join(scored, ["book_id", "block_id"]), safe, more, caps, targets)
            added = added.select("book_id", "block_id", (F.col("pos") + 1_000_000).cast("int").alias("step"), F.lit(False).alias("protected"), F.array().cast("array<string>").alias("protected_for"))
            chosen = kept.unionByName(added)
        places = t["sections"].select("book_id", "section_no", F.col("section_no").alias("section_pos"))
        return self.keep(selection.reading_order(chosen.join(scored, ["book_id", "block_id"]), places), "chosen")

    def bridge(self, t: dict[str, DataFrame], chosen: DataFrame) -> DataFrame:
        c = self.config
        empty = self.spark.createDataFrame([], "book_id string, pos long, before_id string, after_id string, kind string, text string, necessary boolean, grounding_blocks array<string>, grounding_requirements array<string>")
        if c.bridges == "none":
            return self.keep(empty, "bridges")
        pairs = self.keep(B.gaps(chosen), "gaps")
        side = lambda name: chosen.select("book_id", F.col("block_id").alias(f"{name}_id"), text.truncate_words("text", 450).alias(f"{name}_text"))
        shown = pairs.join(side("before"), ["book_id", "before_id"]).join(side("after"), ["book_id", "after_id"])

        def batched(rows: DataFrame, what: str, fields: list[str]) -> DataFrame:
            rows = structure.batches(rows, ["book_id"], "pos", c.bridge_batch)
            per = rows.groupBy("book_id", "batch").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias(what))
            return per.select("book_id", F.col("batch").alias("seq"), F.to_json(F.struct(F.lit(c.bridges).alias("mode"), F.lit(c.bridge_words).alias("most_words"), what)).alias("request"))

        found = self.ask(batched(shown, "pairs", ["before_id", "before_text", "after_id", "after_text"]), "bridge")
        found = found.select("book_id", "seq", F.posexplode("a.bridges").alias("n", "b")).select("book_id", (F.col("seq") * 10_000 + F.col("n")).cast("long").alias("pos"), "b.before_id", "b.after_id", "b.kind", F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.necessary", F.lit(False)).alias("necessary"), "b.grounding_blocks", "b.grounding_requirements")
        proposed = self.keep(B.accepted(found, pairs, t["requirements"]), "proposed_bridges")
        checks = self.ask(batched(proposed.join(shown.select("book_id", "before_id", "after_id", "before_text", "after_text"), ["book_id", "before_id", "after_id"]), "bridges", ["before_id", "before_text", "after_id", "after_text", "text"]), "check")
        checks = checks.select("book_id", "seq", F.posexplode("a.checks").alias("n", "k")).select("book_id", (F.col("seq") * 10_000 + F.col("n")).alias("seq"), "k.*")
        good = B.approved(proposed, checks, c.bridge_words).drop("pos").join(pairs, ["book_id", "before_id", "after_id"])
        good = good.withColumn("words", text.word_count("text"))
        words = chosen.groupBy("book_id").agg(F.sum("word_count").alias("words"))
        return self.keep(B.within_budget(good, words, c.bridge_share).select(*empty.columns), "bridges")

    # render

    def render(self, t: dict[str, DataFrame], chosen: DataFrame, bridges: DataFrame, targets: DataFrame) -> DataFrame:
        secs = t["sections"].withColumn("section_pos", F.col("section_no"))
        titles = t["books"].select("book_id", "title")
        self.keep(render.as_text(render.edition(chosen.select("book_id", "block_id", "section_no", "reading_pos", "text"), secs, bridges, titles)), "edition")
        balance = selection.balance(secs.where("kind <> 'exclude'"), chosen)
        cover = self.keep(graph.coverage(chosen.withColumn("ord", F.col("reading_pos")), t["requirements"]).join(t["requirements"].select("book_id", "requirement_id", "pos", "kind", "description", "importance"), ["book_id", "requirement_id"]), "coverage")
        said = B.bridge_words(bridges)
        spans = chosen.select("book_id", "section_no", F.col("first_index").alias("first"), F.col("last_index").alias("last"))
        twice = selection.overlap(spans, t["paragraphs"].select("book_id", "section_no", "idx", F.col("word_count").alias("words"))).select("book_id", "overlap_words")
        summary = selection.totals(t["books"], targets, chosen).join(said, "book_id", "left").join(twice, "book_id", "left").join(t["overview"].select("book_id", "form", "overview", F.col("central_question").alias("question"), "thesis"), "book_id", "left")
        summary = summary.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("bridge_words", "overlap_words")})
        missing = cover.where(F.col("must") & (F.size("block_ids") == 0)).groupBy("book_id").agg(F.array_sort(F.collect_set("requirement_id")).alias("missing"))
        summary = self.keep(summary.join(missing, "book_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))), "summary")
        place = text.passage_range("section_id", "first_id", "last_id", "first_page", "last_page")
        rows = chosen.withColumns({"pos": F.col("reading_pos"), "range": place})
        review = self.spark.read.parquet(f"{self.config.output}/review")
        self.keep(render.as_text(render.audit(summary, balance, rows, cover, bridges, review)), "audit")
        where = rows.select("book_id", F.col("block_id").alias("b"), F.concat("block_id", F.lit(" ("), "range", F.lit(")")).alias("place"))
        steps = t["path"].join(cover.drop("pos"), ["book_id", "requirement_id"])
        spots = steps.select("book_id", "requirement_id", F.posexplode("block_ids").alias("n", "b")).distinct().join(where, ["book_id", "b"]).groupBy("book_id", "requirement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "place"))), lambda x: x["place"]).alias("places"))
        steps = steps.join(spots, ["book_id", "requirement_id"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))
        edges = t["relations"].where("relation = 'supports'").select("book_id", F.col("pos").alias("n"), "source", F.col("target").alias("requirement_id"))
        info = cover.select("book_id", F.col("requirement_id").alias("source"), "description", "block_ids")
        props = cover.where("kind = 'major_proposition'").select("book_id", "requirement_id", "pos")
        supports = edges.join(props, ["book_id", "requirement_id"]).join(info, ["book_id", "source"])
        heads = titles.join(t["map"], "book_id", "left")
        self.keep(render.as_text(render.guide(heads, steps, cover, supports)), "guide")
        return summary


def run(spark: SparkSession, config: Config, provider=None, extract=None) -> DataFrame:
    """Runs all stages; returns the summary (or, with parse_only, the structure's violations)."""
    r = Run(spark, config, provider, extract)
    t = r.parse()
    if config.parse_only:
        return t["violations"]
    t = r.analyse(t)
    candidates = r.nominate(t)
    scored = r.score(t, candidates)
    chosen, targets, caps = r.select(t, scored)
    chosen = r.review(t, scored, chosen, targets, caps)
    bridges = r.bridge(t, chosen)
    return r.render(t, chosen, bridges, targets)
