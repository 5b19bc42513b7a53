"""Corpus pipeline: language, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and reads it
again for the next. All but the last return the columns of documents. A stage without rows gives an empty table. Rows are
told apart by doc_id and text, so repeated ids are kept apart; null texts are rejected by the first stage, as are texts without letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import jaccard_join, language_id, mixing, packing, suffix_dedup
from lapidary.llm.common import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Up to so many rejected documents (32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: trigrams of the labelled documents, lang as the declared language, source as the host. Those whose best outcome
    over all evidence is no language go; a language that is doubtful between several (a word or two) is no reason. Only keys of the
    rejected documents are joined with the texts."""
    model = language_id.fit(docs)
    keys = {f"_{c}": F.xxhash64(c) for c in ("doc_id", "text", "source", "lang")}
    found = language_id.identify(docs.withColumns(keys), model, F.col("text"), F.col("source"), F.col("lang"), keep=list(keys), least=0.0, into="_id_")
    gone = saved(found.where("_id_language = 'und'").select(*keys).distinct(), "rejected")
    few = gone.count() <= BROADCAST_KEYS
    return docs.withColumns(keys).join(F.broadcast(gone) if few else gone, list(keys), "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return jaccard_join.without_near_copies(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes are cut; documents with no word left go; n_chars follows the text."""
    left = suffix_dedup.without_repeats(docs)
    return left.where(F.trim(F.col("text")) != "").withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded by a hash of its id: some go, some repeat (three times at most)."""
    taken = mixing.taken_words(mixing.mix(docs)).where("size > 0")
    share = F.col("taken") / F.col("size")
    draw = F.pmod(F.xxhash64(F.lit(mixing.SEED), "doc_id"), F.lit(1_000_003)) / 1_000_003
    times = taken.select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place"), F.floor(share + draw).cast("int").alias("_times"))
    times = times.groupBy("_doc", "_place").agg(F.max("_times").alias("_times")).where("_times > 0")
    mixed = docs.withColumn("_at", mixing.place_of()).join(times, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_at") == F.col("_place")))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 4096 tokens."""
    return packing.pack(saved(packing.pieces(docs), "pieces"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit),
]

#: Trigram models, byte strings and tokenizers are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
