"""Tables written to the folder that driver and executors share, so that a plan starts at files that do not change."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only if ``spark.checkpoint.dir`` is unset and the session has no machine but this one.
LOCAL_FOLDER = "/tmp/checkpoints/chunkloom"


def folder(spark: SparkSession) -> str:
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read again. The files go when Python ends, if the session still runs."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the session may be ending
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
