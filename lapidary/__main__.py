"""Command line: python -m lapidary BOOKS --output FOLDER ..."""

from __future__ import annotations

import logging
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .plans import config, outputs, pipeline


def main(argv: list[str] | None = None) -> int:
    c = config.parse(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.DEBUG if c.verbose else logging.INFO)
    spark = SparkSession.builder.appName("lapidary").getOrCreate()
    try:
        folder = outputs.run_folder(spark, c.output, c.input, c.reuse_output)
        if c.reset_output:
            outputs.reset(spark, folder)
        found = pipeline.run(spark, replace(c, output=folder))
        found.show(truncate=60)
        if not c.parse_only:
            outputs.export(spark, folder, c.page_size, c.font_size)
        return 0
    except Exception:
        logging.exception("the run failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
