"""An inbox of book files: each micro-batch of new files is parsed and appended. (An addition; batch reads are in sources.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import structure
from ..sources import loaders


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parses files that arrive in `inbox` and appends their paragraphs to out/paragraphs, and how they were read, or why not, to
    out/diagnostics. A replayed batch writes its own folder
    again, so files are neither lost nor doubled when a batch is retried."""

    def handle(batch: DataFrame, number: int) -> None:
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
        found = batch.select(F.col("path").alias("book_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.when(suffix.isin(*loaders.FORMATS), suffix).alias("format"), "content")
        blocks, about = loaders.read_books(found)
        structure.paragraphs(blocks).write.mode("overwrite").parquet(f"{out}/paragraphs/batch={number}")
        about.write.mode("overwrite").parquet(f"{out}/diagnostics/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).load(inbox)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
