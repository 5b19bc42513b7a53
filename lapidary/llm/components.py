"""Connected components of a table of links, by least labels with pointer jumping; nothing goes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for every node of links (a, b). Each round takes the least label among the
    neighbours, then the label of the label, and is written to the shared folder; a round without a change is the last."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        step = saved(step.join(up, "to", "left").select("node", "old", F.least("to", "up").alias("comp")), "labels")
        changed = step.where("old <> comp").limit(1).count()
        dropped(labels)
        labels = step.select("node", "comp")
        labels._lapidary_path = step._lapidary_path
        if not changed:
            dropped(both)
            return labels
