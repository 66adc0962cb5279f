"""Near copies among embeddings: Euclidean p-stable hashing, then exact cosines.

Vectors are brought to length one, where a cosine of at least ``COSINE`` means a distance of at most
sqrt(2 - 2 COSINE). A hash is floor((a . x + b) / WIDTH) with a normal and b uniform; a table joins K of them to a
bucket. K grows with the logarithm of the number of vectors, so that unrelated vectors (at distance sqrt(2)) fill a
bucket with about ``CROWD``; the number of tables follows from ``RECALL``, the share of pairs at exactly the
threshold that are to meet in some table, and more above it. Buckets are large, as comparing is a product of matrices
while each table costs a shuffle of the vectors. Every pair that meets is checked with its cosine in double precision,
so no link found is below the threshold.

Equal vectors, component by component, are one node with the number of their rows for a weight, so however many rows
hold one vector, it is hashed and compared once. A pair counts in the first table in which it meets, told from the
buckets that each vector carries; so counts need no list of pairs. A bucket of more than ``BLOCK`` vectors is split
into blocks, and each pair of blocks is compared as a cell of its own: one bucket may hold any share of the rows. A
cell emits, for its vectors, numbers of links and the edges of a spanning forest, never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of different lengths; rows that repeat a vec_id count as one component's node and give a row each, with the
links of all of them to rows of other ids (and to rows of the same id whose vector differs); ids are taken as long, and
null ids have no component. Columns besides the id and the vector are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Store, components

COSINE, WIDTH, CROWD, RECALL, BLOCK = 0.9, 3.0, 1024, 0.98, 2048
MOST_BROADCAST = 200_000  # buckets


def met(distance: float, width: float = WIDTH) -> float:
    """Probability that one hash joins two vectors at ``distance`` (Datar et al. 2004)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(hashes in a table, tables) for n vectors."""
    k = max(4, math.ceil(math.log(max(1, n / CROWD)) / -math.log(met(math.sqrt(2)))))
    near = met(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


def _normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows can link, those of them at length one)."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1)
    ok = np.isfinite(top) & (top > 0)
    x = x[ok] / top[ok, None]
    return ok, x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors), by length; nulls are NaN."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _buckets(x: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k).astype(np.uint64)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for i in range(k):
        h = (h ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _compare(at: int, low: np.ndarray, weight: np.ndarray, x: np.ndarray, h: np.ndarray, split: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a cell of table ``at``: for each vector the rows linked to it here first, and the smallest id of ``low``
    linked to it through the cell. ``split``: rows of the first block, compared with the others; or 0, all with all."""
    a, b = (x[:split], x[split:]) if split else (x, x)
    i, j = np.nonzero(a.astype(np.float32) @ b.astype(np.float32).T >= cosine - 1e-3)  # rounded; checked below
    if split:
        j += split
    else:
        i, j = i[i < j], j[i < j]
    near = np.concatenate([np.einsum("ij,ij->i", x[p], x[q]) for p, q in zip(*(np.array_split(v, len(i) // 100_000 + 1) for v in (i, j)), strict=True)]) >= cosine
    i, j = i[near], j[near]
    new = ~(h[i, :at] == h[j, :at]).any(axis=1) if at else np.ones(len(i), bool)
    n = np.bincount(i[new], weight[j[new]], len(x)) + np.bincount(j[new], weight[i[new]], len(x))
    low = low.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (before == low).all():
            return n.astype(np.int64), low


def nodes(vectors: DataFrame, store: Store, cosine: float, recall: float, seed: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(rows: id, d0, d1; nodes: d0, d1, node, rep, weight, h, x; tables). A node's vector is kept as it came."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    told = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    told = told.select("id", "v", *[F.xxhash64(F.lit(i), F.size("v"), "v").alias(f"d{i}") for i in range(2)])
    k, tables = shape(told.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for which, v in _vectors(b.column(4)):
                ok, x = _normal(v)
                which, v = which[ok], v[ok]
                h = _buckets(x, k, tables, seed)
                rows = pa.array(which)
                cols = [*(b.column(c).take(rows) for c in range(4)), pa.array(number + np.arange(len(which)))]
                number += len(which)
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (h, v))], ["d0", "d1", "rep", "weight", "node", "h", "x"])

    distinct = told.groupBy("d0", "d1").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"))
    made = distinct.mapInArrow(hashed, "d0 long, d1 long, rep long, weight long, node long, h binary, x binary")
    return told.select("id", "d0", "d1"), store.keep(made, "nodes"), tables


def linked(units: DataFrame, tables: int, store: Store, wide: bool, cosine: float = COSINE) -> DataFrame:
    """(node, rep, n, low): of the nodes with links, by cell, rows linked there and the smallest id they reach there."""
    kind = "<f8" if wide else "<f4"
    # four bytes for each table, little-endian
    byte = lambda i: f"conv(hex(substring(h, 4 * t + {i}, 1)), 16, 10)"
    bucket = F.expr(" + ".join(f"cast({byte(i + 1)} as long) * {256**i}" for i in range(4)))
    met_in = units.select("node", "rep", "weight", "h", "x").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("b", bucket)
    sizes = met_in.groupBy("t", "b").agg(F.count("*").alias("n"))
    many = store.keep(sizes.where(f"n > {BLOCK}").select(F.col("t").alias("t2"), F.col("b").alias("b2"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "many")
    few = many.count() <= MOST_BROADCAST
    dealt = met_in.join(F.broadcast(many) if few else many, F.expr("t = t2 and b = b2"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    # of the hashes only those of earlier tables are read
    dealt = dealt.select("t", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "rep", "weight", F.expr("substring(h, 1, 4 * t)").alias("h"), "x")
    dealt = dealt.repartition("t", "b", "i", "j").sortWithinPartitions("t", "b", "i", "j", "second")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                key = list(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True))
                yield from zip(key, *(b.column(c).to_pylist() for c in range(4, 10)), strict=True)

        out, held = [], 0
        for (t, _, i, j), cell in groupby(stream(), key=lambda r: r[0]):
            cell = list(cell)  # two blocks at most
            if len(cell) > 1:
                _, second, node, rep, weight, h, x = zip(*cell, strict=True)
                split = len(cell) - sum(second) if i != j else 0
                if len({len(v) for v in x}) > 1 or (i != j and split in (0, len(cell))):
                    continue
                node, rep, weight = (np.array(v, np.int64) for v in (node, rep, weight))
                x = _normal(np.frombuffer(b"".join(x), kind).reshape(len(cell), -1))[1]
                h = np.frombuffer(b"".join(h), "<i4").reshape(len(cell), -1)
                n, low = _compare(t, rep, weight, x, h, split, cosine)
                has = (n > 0) | (low != rep)
                if has.any():
                    out.append((node[has], rep[has], n[has], low[has]))
                    held += int(has.sum())
            if held > 10_000:
                yield _links(out)
                out, held = [], 0
        if out:
            yield _links(out)

    return store.keep(dealt.mapInArrow(compared, "node long, rep long, n long, low long"), "links")


def _links(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "rep", "n", "low"])


def near_copies(vectors: DataFrame, store: Store, cosine: float = COSINE, recall: float = RECALL, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, units, tables = nodes(vectors, store, cosine, recall, seed, id_col, vector_col)
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    links = linked(units, tables, store, wide, cosine)
    total = links.groupBy("node").agg(F.sum("n").alias("n"))
    each = units.select("d0", "d1", "node", "rep", "weight").join(total, "node", "left").select("d0", "d1", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight")).alias("all"))
    # rows of one id with one vector: linked to all rows of the node and those linked to it, but for themselves
    own = store.keep(rows.groupBy("id", "d0", "d1").agg(F.count("*").alias("own")).join(each, ["d0", "d1"]), "own")
    n = own.groupBy("id").agg(F.sum(F.col("own") * (F.col("all") - F.col("own"))).alias("n_links"))
    same = own.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comp = components(store, links.select(F.col("rep").alias("a"), F.col("low").alias("b")).unionByName(same))
    out = vectors.select(F.col(id_col).alias("vec_id")).join(n.withColumnRenamed("id", "i1"), F.col("vec_id") == F.col("i1"), "left")
    out = out.join(comp.withColumnRenamed("id", "i2"), F.col("vec_id") == F.col("i2"), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.expr("vec_id <=> coalesce(component, vec_id)").alias("kept")
    )
