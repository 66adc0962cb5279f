"""Files as they arrive. The decoders are the batch ones: they look at one file at a time and keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(file, length, content) of new matching files below ``folder``."""
    from chunkloom.sources import files

    df = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.relative(df, folder).select("file", "length", "content")
