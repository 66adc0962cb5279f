"""What several operators of this subpackage need: written tables that cut lineage, ASCII folding, components.

Tables are written to the shared folder that ``spark.checkpoint.dir`` names, so a lost executor costs only the
tasks it ran. Where that setting is missing, a folder of our own is used if Spark runs on this machine alone, as in
tests; on a cluster that is an error, as its machines do not share such a folder.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only if the session names no shared folder and has no machine but this one.
LOCAL_FOLDER = "/tmp/checkpoints/chunkloom"

#: Rows that go to Python at once where tables are written: texts are long, and both sides hold a batch of them.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    if named := spark.conf.get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


_held: list[tuple[str, Callable]] = []
LARGE = 1 << 20  # bytes; from there on memory goes back to the system when it is freed
TRIM_THRESHOLD, MMAP_THRESHOLD = -1, -3  # fixed values: names of settings in the C library's mallopt


def enter(name: str, clear: Callable = lambda: None) -> None:
    """Called by tasks in Python: what another operator keeps in this worker is given up first."""
    libc = ctypes.CDLL(None)
    if not _held and hasattr(libc, "mallopt"):
        libc.mallopt(MMAP_THRESHOLD, LARGE)
        libc.mallopt(TRIM_THRESHOLD, LARGE)
        pa.set_memory_pool(pa.system_memory_pool())
    if _held and _held[0][0] != name:
        _held.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(libc, "malloc_trim", None):
            trim(0)
    if not _held:
        _held.append((name, clear))


class Store:
    """Tables written below the shared folder under one fresh name.

    ``drop`` removes those no longer read, ``clear`` all of them; results read some until they are done with, so what
    is left goes when Python ends, if the session still runs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy", rows: int = BATCH_ROWS) -> DataFrame:
        """Writes ``df`` and returns the table read back, whose plan starts at its files."""
        path = self.path(name)
        before = self.spark.conf.get(BATCH, None)
        self.spark.conf.set(BATCH, str(rows))
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.unset(BATCH) if before is None else self.spark.conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._store_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_store_path", None):
                self._remove(path)

    def clear(self) -> None:
        """Removes all tables; without a running session does nothing."""
        atexit.unregister(self.clear)
        if self.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the session may be ending
                self._remove(self.root)

    def _remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_ascii(text):
    """Lower-cases A-Z and nothing else. ``lower`` does the same for pure ASCII, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def components(store: Store, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component being the smallest id reached.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond");
    each step is a minimum by node, combined before the shuffle, and a join that AQE may split at hot nodes.
    Ids without an edge are absent. Stops when a round changes no edge.
    """
    now = store.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store.keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = store.keep(small, "small")
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(now, large)
        now = small
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
