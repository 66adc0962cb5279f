"""Exact deduplication: two passes with a counting Bloom filter, DataFrame functions only.

Pass one reads every text once and hashes it. The filter has one hash and counts to two: rows of a cell are counted,
in each task first, and cells with more than one are set. It has ``BITS`` cells a text, whatever their number, so some
3 % of the unrepeated rows share a cell with another. Pass two probes each row once: where the cell is set the row is
possibly repeated and is shuffled by its digest; all others, whose cell holds one row, pass straight through.

The set cells are written as 64-bit words, counted, and broadcast up to ``MOST_BROADCAST`` of them (some tens of millions
of texts, if a tenth are repeated). Beyond that rows meet their words by a shuffle instead, of ids and digests in
``digests`` and of texts in ``unique``; results are the same.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal
texts the row with the largest doc_id stays (null is smaller than any id; rows repeated with that same id are all
marked in ``digests``, and one of them is kept by ``unique``). An empty table gives an empty result. Columns
besides the id and the text are untouched, whatever their names. Texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Store, fold_ascii

BITS, LEAST_BITS = 32, 1 << 20  # cells for each text; at least
MOST_BROADCAST = 4_000_000  # words


def _folded(text):
    return fold_ascii(F.coalesce(text, F.lit("")))


def _digest(text):
    return F.unhex(F.sha2(_folded(text), 256))


def _cell(hash_col: str, bits: int):
    return F.pmod(F.col(hash_col), F.lit(bits))


def filtered(table: DataFrame, store: Store, hash_col: str = "hash", bits: int | None = None) -> tuple[DataFrame, int]:
    """The filter's words ``(__word, __set)`` that aren't zero, half as many as rows at most; and its cells."""
    if bits is None:
        bits, n = LEAST_BITS, table.count()
        while bits < BITS * n:
            bits *= 2
    cells = table.groupBy(_cell(hash_col, bits).alias("cell")).count().where("count > 1")
    bit = F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = store.keep(cells.groupBy(F.shiftright("cell", 6).alias("__word")).agg(F.bit_or(bit).alias("__set")), "words")
    return F.broadcast(words) if words.count() <= MOST_BROADCAST else words, bits


def probed(table: DataFrame, words: DataFrame, bits: int, hash_col: str = "hash") -> DataFrame:
    """Adds ``__again``: whether the filter says that the row's hash may occur twice."""
    cell = table.withColumn("__cell", _cell(hash_col, bits))
    met = cell.join(words, F.shiftright("__cell", 6) == F.col("__word"), "left")
    again = F.coalesce(F.expr("shiftright(__set, cast(__cell & 63 as int)) & 1"), F.lit(0)) == 1
    return met.withColumn("__again", again).drop("__cell", "__word", "__set")


def digests(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. ``bits``: cells, if others are wanted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("sha"))
    table = store.keep(rows.withColumn("hash", F.xxhash64("sha")), "digests")
    words, bits = filtered(table, store, bits=bits)
    marked = store.keep(probed(table, words, bits).drop("hash"), "probed")
    store.drop(table)
    alone = marked.where("not __again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = marked.where("__again").select("doc_id", "sha")
    groups = again.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = again.join(groups, "sha").select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "sha")
    return alone.unionByName(again).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def unique(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Only rows that may be repeated are shuffled."""
    own = F.xxhash64(_folded(F.col(text_col)))
    words, bits = filtered(store.keep(docs.select(own.alias("hash")), "hashes"), store, bits=bits)
    marked = probed(docs.withColumn("__hash", own), words, bits, "__hash").drop("__hash")
    alone = marked.where("not __again").select(*docs.columns)
    again = marked.where("__again").drop("__again").withColumn("__sha", _digest(F.col(text_col)))
    best = again.groupBy("__sha").agg(F.max(id_col).alias("__best"))
    again = again.join(best.withColumnRenamed("__sha", "__of"), F.expr(f"__sha = __of and `{id_col}` <=> __best")).dropDuplicates(["__sha"])
    return alone.unionByName(again.select(*docs.columns))
