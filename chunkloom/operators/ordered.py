"""Order-dependent operators over a whole table: positions, running sums, previous values, runs.

A window without a partition would put every row into one task. Here rows are range-partitioned by their whole order,
a tie-breaker included, so that no key's rows have to be in one task, and written with their partition and place. Then
partitions are summed up, the running totals of those few rows are taken, and each partition continues from its own.
Writing keeps both uses of the partitions alike, whatever is sampled for their bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.operators.written import written

#: Rows of a partition, about. They are ordered in one task.
ROWS = 1_000_000


class Ordered:
    """The rows of a table in ``order``; methods add columns. ``table()`` has them."""

    def __init__(self, df: DataFrame, order: list, rows: int = ROWS):
        parts = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1)
        by = [*order, "__tie"]
        dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie")
        dealt = dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        self.rows = written(dealt, "ordered")

    def table(self) -> DataFrame:
        return self.rows.drop("__part", "__at")

    def _joined(self, parts: DataFrame) -> DataFrame:
        return self.rows.join(parts, F.col("__part") == F.col("__p")).drop("__p")

    def positions(self, name: str = "pos") -> Ordered:
        """Each row's position from 1."""
        own = self.rows.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        own = own.select(F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__base"))
        self.rows = self._joined(own).withColumn(name, F.col("__at") + F.col("__base")).drop("__base")
        return self

    def running_sum(self, value: Column, name: str) -> Ordered:
        """The sum of ``value`` over the rows before each."""
        self.rows = self.rows.withColumn("__value", value)
        own = self.rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        own = own.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
        here = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        self.rows = self._joined(own).withColumn(name, F.col("__base") + F.coalesce(F.sum("__value").over(here), F.lit(0))).drop("__value", "__base")
        return self

    def previous(self, value: str, name: str) -> Ordered:
        """The value of the row before, null for the first; values aren't null."""
        last = self.rows.groupBy("__part").agg(F.max_by(value, "__at").alias("__last"))
        last = last.select(F.col("__part").alias("__p"), F.lag("__last").over(Window.orderBy("__part")).alias("__before"))
        here = Window.partitionBy("__part").orderBy("__at")
        self.rows = self._joined(last).withColumn(name, F.coalesce(F.lag(value).over(here), F.col("__before"))).drop("__before")
        return self


def running_sum(df: DataFrame, order: list, value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each, in ``order``."""
    return Ordered(df, order, rows).running_sum(value, name).table()


def positions(df: DataFrame, order: list, name: str = "pos", rows: int = ROWS) -> DataFrame:
    """Adds each row's position from 1."""
    return Ordered(df, order, rows).positions(name).table()


def previous(df: DataFrame, order: list, value: str, name: str, rows: int = ROWS) -> DataFrame:
    """Adds the value of the row before, null for the first; values aren't null."""
    return Ordered(df, order, rows).previous(value, name).table()


def islands(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Runs of consecutive integers among distinct ``key``: s, e, n."""
    placed = positions(df.select(key), [key], "__pos", rows)
    return placed.groupBy((F.col(key) - F.col("__pos")).alias("__g")).agg(F.min(key).alias("s"), F.max(key).alias("e"), F.count("*").alias("n")).drop("__g")


def numbered_runs(df: DataFrame, order: list, value: str, rows: int = ROWS) -> DataFrame:
    """Adds ``pos`` from 1 and ``run``, the number of the run of equal values that the row is in."""
    own = Ordered(df, order, rows).positions("pos").previous(value, "__prev")
    new = F.when(F.col(value).eqNullSafe(F.col("__prev")) & (F.col("pos") > 1), 0).otherwise(1).cast("long")
    return own.running_sum(new, "run").table().withColumn("run", F.col("run") + new).drop("__prev")


def runs(df: DataFrame, order: list, value: str, rows: int = ROWS) -> DataFrame:
    """Run-length encoding in ``order``: first position, length n, value."""
    numbered = numbered_runs(df, order, value, rows)
    return numbered.groupBy("run").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.first(value).alias(value)).drop("run")


def unrun(encoded: DataFrame, value: str) -> DataFrame:
    """Expands runs again: pos, value."""
    return encoded.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos"), value)
