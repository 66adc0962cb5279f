"""Lookups of linked rows: first or last of a key, ordered fallbacks, existence, positions, next rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """Of rows with the same ``by``, the values of the one with the largest ``order``: a later link overwrites."""
    return df.groupBy(*by).agg(*[F.max_by(v, order).alias(v) for v in values])


def first_of(df: DataFrame, by: list[str], order: Column | str, *values: str) -> DataFrame:
    """Of rows with the same ``by``, the values of the one with the smallest ``order``."""
    return df.groupBy(*by).agg(*[F.min_by(v, order).alias(v) for v in values])


def fallback_chain(df: DataFrame, probes: list[tuple[DataFrame, Column | str]], value: str, step: str) -> DataFrame:
    """Tries the probes in order; adds the first non-null value and the number of the probe that gave it.

    A probe is (table(k, v), key): k is unique and v not null. Without a hit value is null and step one past the last.
    """
    names = []
    for i, (table, key) in enumerate(probes):
        side = table.select(F.col("k").alias(f"__k{i}"), F.col("v").alias(f"__v{i}"))
        df = df.join(side, (F.col(key) if isinstance(key, str) else key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        names.append(f"__v{i}")
    number = F.lit(len(names) + 1)
    for i, n in reversed(list(enumerate(names))):
        number = F.when(F.col(n).isNotNull(), F.lit(i + 1)).otherwise(number)
    return df.withColumn(value, F.coalesce(*names)).withColumn(step, number).drop(*names)


def else_rows(first: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``first``, and for keys it hasn't, ``other``."""
    return first.unionByName(other.join(first.select(*on).distinct(), on, "left_anti"))


def by_priority(parts: list[DataFrame], by: list[str], order: str) -> DataFrame:
    """Of rows of several tables the first by (place of the table in the list from 1, order) for each ``by``."""
    rows = parts[0].withColumn("pr", F.lit(1))
    for i, p in enumerate(parts[1:], 2):
        rows = rows.unionByName(p.withColumn("pr", F.lit(i)))
    return rows.groupBy(*by).agg(F.min(F.struct("pr", order)).alias("__m")).select(*by, F.col(f"__m.{order}").alias(order), F.col("__m.pr").alias("pr"))


def next_of(df: DataFrame, by: str, order: str, where: Column) -> Column:
    """The smallest later ``order`` of the same ``by`` among rows where ``where`` holds: a forward as-of lookup.

    Rows are read from the last on, so that the frame only grows and each row costs the same.
    """
    after = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return F.min(F.when(where, F.col(order))).over(after)


def descend(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, d): what is reached from ``start(root, node)`` over ``edges(parent, child)`` in up to ``depth``
    steps, once for each way; each level is a join with the level before."""
    level = start.select("root", "node", F.lit(0).alias("d"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.lit(d).alias("d"))
        out = out.unionByName(level)
    return out


def top(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows of each ``by``. Spark cuts each task to its own n before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def named(df: DataFrame, key: str, table: DataFrame, code: str, name: str, out: str) -> DataFrame:
    """Adds the name of a code, '#' and the code where the table has none."""
    side = table.select(F.col(code).alias("__c"), F.col(name).alias("__n"))
    return df.join(side, F.col(key) == F.col("__c"), "left").withColumn(out, F.coalesce("__n", F.concat(F.lit("#"), F.col(key).cast("string")))).drop("__c", "__n")
