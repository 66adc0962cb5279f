"""Grouped histograms, argmax with a threshold, strided pivots, checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], values: str, bins) -> DataFrame:
    """Counts of the bins of an array column's elements, by ``by``. ``bins`` maps an element to its bin."""
    return df.select(*by, F.explode(values).alias("__x")).groupBy(*by, bins(F.col("__x")).alias("bin")).agg(F.count("*").alias("n"))


def best_cover(counts: DataFrame, colours: DataFrame, by: str, black: int, ref: int) -> DataFrame:
    """The candidate that covers most of a histogram with colours other than black; ties go to the least squared
    distance from ``ref``, then to the first candidate. Kept if it covers at least half of the total.

    counts(by, bin, n), colours(ci, bin, colour): both are bounded by bins; Spark broadcasts by size.
    """
    met = counts.join(colours, "bin")
    sums = met.groupBy(by, "ci").agg(
        F.sum(F.when(F.col("colour") != black, F.col("n")).otherwise(0)).alias("covered"),
        F.sum((F.col("colour") - ref) * (F.col("colour") - ref) * F.col("n")).alias("dist"),
    )
    best = sums.groupBy(by).agg(F.max_by(F.struct("ci", "covered", "dist"), F.struct("covered", -F.col("dist"), -F.col("ci"))).alias("b"))
    total = counts.groupBy(by).agg(F.sum("n").alias("total"))
    out = best.join(total, by).select(by, "b.ci", "b.covered", "b.dist", "total")
    return out.where("total > 0 and covered * 2 >= total")


def strided(df: DataFrame, by: list[str], place: str, value: str, names: list[str]) -> DataFrame:
    """Pivots items in strides: item g * k + i goes to row g, column names[i]."""
    k = len(names)
    cells = [F.max(F.when(F.col(place) % k == i, F.col(value))).alias(n) for i, n in enumerate(names)]
    return df.groupBy(*by, F.expr(f"`{place}` div {k}").alias("g")).agg(*cells)


def checksum32(df: DataFrame, by: str, word) -> DataFrame:
    """Sum of words modulo 2**32, by ``by``. Halves of words are summed apart, so up to 2**47 rows of a group can't
    overflow."""
    low, high = F.sum(word.bitwiseAND(F.lit(0xFFFF))), F.sum(F.shiftrightunsigned(word, 16).bitwiseAND(F.lit(0xFFFF)))
    total = low + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return df.groupBy(by).agg(total.bitwiseAND(F.lit(0xFFFFFFFF)).alias("s"))
