"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words, its source's target a share of all words by weight, at most ``most`` times
the source's size; what a source can't take is shared by weight among the others until none is above. Within a
source the documents stand in order of size and id; each has target / source size expected copies, their prefix sum
plus one random offset of the source crosses integers, and a document is emitted once for each it crosses. So no
document is emitted more than ``most`` times, and as neighbours in the order are of about one size, the words taken
come within about the largest document of the target. Then, up to ``ROUNDS`` times, the one document of a source
whose copies, one more or one less, bring its words nearest to the target is changed by that; this matters in sources
of few documents.

The prefix sum needs no source in one task: rows are range-partitioned by (source, size, id), numbered within
partitions, and the numbers at which partitions start come from a table of one row per partition and source.

Defined cases: a null text has size 0; null is a source of its own, last in order; a source without words has
target 0; repeated rows count each; an empty table gives an empty result. Equal seeds give equal results. The rows of
one source, but not of one document, are in many tasks; sources themselves are ordered in one, a row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Store

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3.0
ROWS_PER_TASK = 500_000
ROUNDS = 3


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``: one row per source, weights 1, 2, 3 in order.

    The shares are those of water-filling: with sources in order of cap / weight, the first k are at their cap and
    the others at one level; k is the first for which that level exceeds no cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    at = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct("ratio", "level"))).over(Window.partitionBy())
    per = per.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * at), F.col("cap")))
    return per.select("source", "source_size", "n_docs", "target")


def _keys(id_col: str, text_col: str, source_col: str) -> list:
    """Two hashes that tell a row by id, source and text."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"__k{i}") for i in range(2)]


def _offset(seed: int):
    """The random offset of a source, from 0 to 1."""
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source"))), 1, 10)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 40))


def plan(docs: DataFrame, store: Store, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (and two hashes of the row)."""
    rows = store.keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *_keys(id_col, text_col, source_col),
        ),
        "sizes",
    )
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK + 1)
    by = [F.col("source").asc_nulls_last(), "size", "doc_id", "__k0"]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ranged = store.keep(ranged, "ranged")
    store.drop(rows)
    starts = ranged.groupBy("source", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("base", F.coalesce(F.sum("n").over(run), F.lit(0)))
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "base")
    # starts has one row per (source, task that holds it), targets one per source, whatever the rows
    share = targets(ranged).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    placed = ranged.join(starts, F.expr("source <=> s and part = p")).withColumn("place", F.col("at") - F.col("first") + F.col("base"))
    placed = placed.drop("s", "p").join(share.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    own = _offset(seed)
    crossed = F.floor((F.col("place") + 1) * F.col("rate") + own) - F.floor(F.col("place") * F.col("rate") + own)
    out = store.keep(placed.select("at", "doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), "__k0", "__k1"), "copies")
    store.drop(ranged)
    changes: list[DataFrame] = []
    for _ in range(ROUNDS):
        changes.append(store.keep(_nearer(_changed(out, changes)), "change"))
    out = _changed(out, changes)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("at")


def _changed(rows: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """``rows`` with copies as ``changes(__at, __by)`` have them; a change is of one row of a source."""
    if not changes:
        return rows
    every = changes[0]
    for c in changes[1:]:
        every = every.unionByName(c)
    every = every.groupBy("__at").agg(F.sum("__by").alias("__by"))
    return rows.join(every, F.col("at") == F.col("__at"), "left").withColumn("copies", F.col("copies") + F.coalesce("__by", F.lit(0))).drop("__at", "__by")


def _nearer(rows: DataFrame, most: float = MOST) -> DataFrame:
    """Of each source the row whose copies are best changed by one: (__at, __by)."""
    off = rows.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
    near = rows.join(off, F.expr("source <=> s")).withColumn("far", F.abs(F.abs("off") - F.col("size")))
    near = near.where((F.col("far") < F.abs("off")) & F.expr(f"if(off > 0, copies + 1 <= {most}, copies > 0)"))
    best = near.groupBy("source").agg(F.min(F.struct("far", "at", "off")).alias("b"))
    return best.select(F.col("b.at").alias("__at"), F.expr("if(b.off > 0, 1, -1)").alias("__by"))


def mixed(docs: DataFrame, store: Store, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its columns.

    Rows that repeat id, source and text share their copies evenly, what doesn't divide going to one of them. Texts
    are joined to their copies once; a second time only those of such rows, if there are any.
    """
    made = plan(docs, store, seed, id_col, text_col, source_col)
    key = made.groupBy("__k0", "__k1").agg(F.sum("copies").alias("__all"), F.count("*").alias("__m"))
    key = store.keep(key.where("__all > 0").select(F.col("__k0").alias("__a"), F.col("__k1").alias("__b"), F.expr("__all div __m").alias("__n"), F.expr("__all % __m").alias("__more")), "shares")
    hashed = docs.select("*", *_keys(id_col, text_col, source_col))
    on = F.expr("__k0 = __a and __k1 = __b")
    emit = lambda x, n: x.withColumn("__e", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
    out = emit(hashed.join(key.where("__n > 0"), on), "__n")
    over = key.where("__more > 0")
    return out if over.isEmpty() else out.unionByName(emit(hashed.join(over, on).dropDuplicates(["__a", "__b"]), "__more"))


def sql(seed: int = 0) -> str:
    """The same in DuckDB's SQL, over table documents with ids of their own: columns of the query ``op3``."""
    rounds, rows = "", "r0"
    for i in range(ROUNDS):
        rounds += f""",
        off{i} AS (SELECT source, any_value(target) - CAST(sum(copies * size) AS BIGINT) AS off FROM {rows} GROUP BY source),
        near{i} AS (SELECT pos, off, row_number() OVER (PARTITION BY r.source ORDER BY abs(abs(off) - size), pos) AS k
                    FROM {rows} r JOIN off{i} o ON r.source IS NOT DISTINCT FROM o.source
                    WHERE abs(abs(off) - size) < abs(off) AND CASE WHEN off > 0 THEN copies + 1 <= {MOST} ELSE copies > 0 END),
        r{i + 1} AS (SELECT r.* REPLACE (copies + CASE WHEN off IS NULL THEN 0 WHEN off > 0 THEN 1 ELSE -1 END AS copies)
                     FROM {rows} r LEFT JOIN near{i} b ON r.pos = b.pos AND b.k = 1)"""
        rows = f"r{i + 1}"
    words = WORD.replace("'", "''")
    return f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{words}')) AS size FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
                FROM d GROUP BY source),
        caps AS (SELECT *, CAST({MOST} AS DOUBLE) * source_size AS cap, CAST({MOST} AS DOUBLE) * source_size / weight AS ratio FROM per),
        levels AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                              - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                             / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
        share AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1)) AS target,
                         CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', source)), 1, 10) AS BIGINT) AS DOUBLE) / CAST({1 << 40} AS DOUBLE) AS own FROM levels),
        placed AS (SELECT d.*, s.source_size, s.target, s.own, CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0 END AS rate,
                          row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS place,
                          row_number() OVER (ORDER BY d.source NULLS LAST, size, doc_id) AS pos
                   FROM d JOIN share s ON d.source IS NOT DISTINCT FROM s.source),
        r0 AS (SELECT doc_id, source, size, source_size, target, pos,
                      CAST(floor((place + 1) * rate + own) - floor(place * rate + own) AS BIGINT) AS copies FROM placed){rounds}
        SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM {rows}"""
