"""Extension: braille files that arrive in a directory, decoded and tagged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.brf import decode_bytes, parsed

FILES = "path string, modificationTime timestamp, length long, content binary"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of new files; every step is stateless, so any sink and trigger will do."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)
    return parsed(files.select(F.col("path").alias("doc_id"), decode_bytes(F.col("content")).alias("text")))
