"""Jaccard join on word shingles by parity sketches.

A document's set is its distinct shingles of five words. Its sketch has one word per class of shingles: the XOR of
the hashes of the shingles in that class. A shingle in one set only changes one word, so the number of words in which
two sketches differ, their Hamming distance, is at most the sets' symmetric difference. At a similarity of 3/4 that is
at most (a + b) / 7 for sizes a and b. Sketches are cut by bands of the larger size (64, 128, 256 ..), with a word for
``PER_WORD`` shingles; a document stands in the band of its size, and as a guest in the next one if larger documents
there may link to it. Up to 64 shingles there are 2^32 classes. The words fold to bits: a second sketch, of four bits
or more for each shingle of the band, has the parity of the shingles at each bit, and the same bound holds for it.

1. Screening. Of a sketch's non-empty words all but the bound are words of whatever it links to (pigeonhole). So each
   word of each document is sent, in four bytes, to the task that meets all equal ones, which sends back how many of a
   document's words others have too; a document with too few is alone. Few documents stay.
2. Keys. Of those that stay, the first words up to the bound and one more, the rarest first, are its keys: what links
   has a key in common.
3. Stars. Of the documents with a key one is paired with each other. Pairs whose bit sketches are within the bound are
   checked on their whole sets. While that finds more than a few links, it is done again with other documents in the
   middle, among those not in one component yet, up to ``STARS`` times; what it leaves is for the next step.
4. Rest. Where a key's documents aren't in one component now, those of different components are compared by their bit
   sketches, in blocks, one key for all keys of the same documents. Of the pairs within the bound each task gives a
   spanning forest, so fewer pairs than it has documents; what all forests connect is a cluster. Pairs within the bound
   are in one cluster, so there they are compared again, in blocks and with their whole sets, once instead of by key; of
   the links each task gives as many as join its components, so again fewer than its documents. So no link that joins
   two components is lost.

If a sketch has no more words than its bound (classes hold a few shingles each, so chance would need to put most into
few classes), all is done again with more classes. Equal sets are one node, told by 64-bit digests of their 64-bit
shingle hashes; links are checked on those hashes.

Defined cases: null and blank texts have an empty set and no links; texts under five words have their whole sequence as
one shingle; rows without doc_id take part in nothing and have no component; ids are taken as long; rows repeating a
doc_id count as one node with the links of all; an empty table gives an empty result. Other columns are ignored,
whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Store, components, enter

WORDS, SMALL, PER_WORD = 5, 64, 1.6
SLICE_CHARS, SLICE_ROWS, BUCKET_BYTES = 2 << 20, 30_000, 8 << 20
MOST_BROADCAST = 1_000_000  # ids
CELL, CELL_BYTES = 1024, 16 << 20  # documents of a key compared in one go; bytes of their sets, where those are there
SET_ROWS = 200  # rows with whole sets that go to Python at once
STARS, WORTH = 4, 0.02  # rounds of step 3 at most; share of new links for which another is worth it
BITS, LEAST_BITS = 4, 512  # of the bit sketch, for each shingle of a band's largest set; at least
NOBODY = 0xFFFF  # in the place of a document: needs no answer

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's constants


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets, ascending within each; sizes)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pandas().to_numpy(dtype=object)
    own = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    full = np.fromiter((w != "" for w in words), bool, len(words))[index]
    offsets = np.append(0, np.cumsum(full))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    w = mix(own)[index[full]] if len(words) else own
    n_words = np.diff(offsets)
    n = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    size = np.minimum(n_words, WORDS)[doc]
    padded = np.append(w, np.zeros(WORDS, np.uint64))
    h = size.astype(np.uint64)
    for i in range(WORDS):
        h = h + np.where(i < size, padded[at + i] * _PLACES[i], np.uint64(0))
    h = mix(h)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n)).astype(np.int64)


def bound(n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The most words in which a sketch differs from one that links to it, in the band up to size ``top``."""
    return (n + np.minimum(top, 4 * n // 3)) // 7


def keys(h: np.ndarray, n: np.ndarray, per_word: float | None = None) -> tuple[np.ndarray, ...]:
    """Words of all sketches: (words, unit of each; of the units: document, number of words, guest or not, band).

    A unit is a document in a band; words of different classes and bands are told apart by a salt.
    """
    per_word = per_word or PER_WORD
    out, units = [], 0
    home = np.maximum(SMALL, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.cumsum(n) - n
    value = mix(h + np.uint64(1))
    for guest in (False, True):
        docs = np.flatnonzero((n > 0) & (4 * n // 3 > home if guest else True))
        if not len(docs):
            continue
        top = home[docs] * (2 if guest else 1)
        at = np.repeat(start[docs] - (np.cumsum(n[docs]) - n[docs]), n[docs]) + np.arange(int(n[docs].sum()))
        d = np.repeat(np.arange(len(docs)), n[docs])
        classes = np.where(top <= SMALL, 1 << 32, np.ceil(top / per_word).astype(np.int64)).astype(np.uint64)
        cls = ((h[at] >> np.uint64(32)) * classes[d]) >> np.uint64(32)  # ascending, as h is
        first = np.ones(len(at), bool)
        first[1:] = (cls[1:] != cls[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(first)
        word = np.bitwise_xor.reduceat(value[at], first)
        owner = d[first]
        salt = mix(cls[first] * np.uint64(2) + top[owner].astype(np.uint64) * _B)
        out.append((mix(word + salt), units + owner, docs, np.bincount(owner, minlength=len(docs)), np.full(len(docs), guest), top))
        units += len(docs)
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none.astype(bool), none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parities(h: np.ndarray, top: int) -> np.ndarray:
    """The bit sketch of a set in the band up to ``top``, as words of 64 bits."""
    size = max(LEAST_BITS, BITS * top)
    at = mix(h ^ _B) >> np.uint64(64 - (size - 1).bit_length())
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.uint64)


def digests(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for each set; 0 for empty ones."""
    out = np.zeros(len(n), np.uint64)
    if (some := np.flatnonzero(n)).size:
        start = (np.cumsum(n) - n)[some]
        both = np.add.reduceat(h, start) ^ mix(np.bitwise_xor.reduceat(mix(h), start) + n[some].astype(np.uint64))
        out[some] = mix(both) | np.uint64(1)
    return out.view(np.int64)


def _slices(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    upto, at = np.cumsum(pc.binary_length(x.column(1)).to_numpy(zero_copy_only=False)), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, "right")))
        end = min(end, at + SLICE_ROWS)
        yield x.slice(at, end - at)
        at = end


def _gathered(n: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the shingles of the documents ``which``."""
    start, size = (np.cumsum(n) - n)[which], n[which]
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


MAPPED = {"kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "code": pa.int64(), "slice": pa.int64(), "bucket": pa.int32(), "data": pa.binary()}
DOC, UNITS, KEYS = range(3)


def _batch(kind: int, rows: int, **cols) -> pa.RecordBatch:
    made = [pa.array(np.full(rows, kind, np.int32)) if c == "kind" else pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in MAPPED.items()]
    return pa.RecordBatch.from_arrays(made, list(MAPPED))


def _map(batches: Iterator[pa.RecordBatch], bits: int, per_word: float) -> Iterator[pa.RecordBatch]:
    """Rows of documents; of each slice its units, and their words by bucket."""
    from pyspark import TaskContext

    enter("ngram_join")
    number = TaskContext.get().partitionId() << 32
    for x in itertools.chain.from_iterable(map(_slices, batches)):
        number += 1
        h, n = shingles(x.column(1))
        code = digests(h, n)
        yield _batch(DOC, len(n), doc_id=x.column(0), n=n, code=code)
        _, lead = np.unique(code, return_index=True)  # one document for each set
        lead = lead[n[lead] > 0]
        key, unit, doc, many, _, top = keys(h[_gathered(n, lead)], n[lead], per_word)
        order = np.argsort(key, kind="stable")
        key, unit = key[order], unit[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        each = np.repeat(size := np.diff(np.append(first, len(key))), size)
        here = np.bincount(unit[each > 1], minlength=len(doc))  # known to be shared; one is sent, to tell others
        most = bound(n[lead][doc], top)
        data = code[lead][doc].tobytes() + b"".join(v.astype("<u4").tobytes() for v in (many, most, here))
        yield _batch(UNITS, 1, n=[len(doc)], slice=[number], data=[data])
        key, who = key[first], np.where(size > 1, NOBODY, unit[first]).astype("<u2")
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        rest = (key << np.uint64(bits) >> np.uint64(32)).astype("<u4")
        cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(key) else np.zeros(0, np.int64)
        ends = [*cut[1:].tolist(), len(key)]
        blobs = [rest[a:b].tobytes() + who[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=False)]
        if blobs:
            yield _batch(KEYS, len(blobs), n=np.diff([*cut, len(key)]), slice=np.full(len(blobs), number), bucket=bucket[cut].astype(np.int32), data=blobs)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (tuple(c[i].as_py() for c in x.columns) for x in batches for i in range(x.num_rows))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words of a bucket: for each slice, which of its units have words that others have, and how many."""
    enter("ngram_join")
    for _, blobs in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        _, slices, sizes, data = zip(*blobs, strict=True)
        rest = np.concatenate([np.frombuffer(d, "<u4", m) for d, m in zip(data, sizes, strict=True)])
        who = np.concatenate([np.frombuffer(d, "<u2", m, 4 * m) for d, m in zip(data, sizes, strict=True)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(rest, kind="stable")
        same = rest[order][1:] == rest[order][:-1]
        shared = np.zeros(len(rest), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        shared &= who != NOBODY
        found, count = np.unique(of[shared] << 16 | who[shared], return_counts=True)
        if len(found):
            cut = np.flatnonzero(np.append(True, np.diff(found >> 16) != 0))
            unit, count = (found & 0xFFFF).astype("<u2"), count.astype("<u4")
            blobs = [unit[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(found)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(slices)[found[cut] >> 16]), pa.array(blobs, pa.binary())], ["slice", "data"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of a slice that may link: (code, crowded); the row with units comes first."""
    for _, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
        _, n, raw = next(rows)
        code = np.frombuffer(raw, "<i8", n)
        many, most, here = (np.frombuffer(raw, "<u4", n, 8 * n + 4 * n * i).astype(np.int64) for i in range(3))
        for _, _, data in rows:
            m = len(data) // 6
            here[np.frombuffer(data, "<u2", m)] += np.frombuffer(data, "<u4", m, 2 * m)
        stay = np.flatnonzero(here >= many - most)
        yield pa.RecordBatch.from_arrays([pa.array(code[stay]), pa.array((many <= most)[stay])], ["code", "crowded"])


UNIT = "code long, top long, n long, most long, guest boolean, parity array<long>, `keys` array<long>, members binary"


def _units(batches: Iterator[pa.RecordBatch], per_word: float) -> Iterator[pa.RecordBatch]:
    """Sketches of the documents that stay, by band, and their whole sets."""
    enter("ngram_join")
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))
    for x in itertools.chain.from_iterable(map(_slices, batches)):
        h, n = shingles(x.column(1))
        code = digests(h, n)
        key, unit, doc, many, guest, top = keys(h, n, per_word)
        if not len(doc):
            continue
        key = key[np.argsort(unit, kind="stable")].view(np.int64)
        ends = np.cumsum(n)
        sets = [h[ends[d] - n[d] : ends[d]] for d in doc]
        bits = [parities(s, t) for s, t in zip(sets, top.tolist(), strict=True)]
        whole = [None if g else s.tobytes() for s, g in zip(sets, guest, strict=True)]
        cols = [pa.array(code[doc]), pa.array(top), pa.array(n[doc]), pa.array(bound(n[doc], top)), pa.array(guest), lists([len(b) for b in bits], np.concatenate(bits).view(np.int64)), lists(many, key), pa.array(whole, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["code", "top", "n", "most", "guest", "parity", "keys", "members"])


def _alike(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sets, ascending, have a similarity of 3/4."""
    if not len(s) or not len(t):
        return False
    both = int(np.count_nonzero(s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t))
    return 100 * both >= 75 * (len(s) + len(t) - both)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [_alike(np.frombuffer(s.as_py(), "<u8"), np.frombuffer(t.as_py(), "<u8")) for s, t in zip(b.column(2), b.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["x", "y"]).filter(pa.array(same, pa.bool_()))


def _links(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Those of ``pairs(x, y)`` whose sets have a similarity of 3/4."""
    sets = units.where("not guest")
    for c in "xy":
        pairs = pairs.join(sets.select(F.col("code").alias(f"c{c}"), F.col("members").alias(f"s{c}")), F.col(c) == F.col(f"c{c}"))
    return pairs.select("x", "y", "sx", "sy").mapInArrow(_compared, "x long, y long")


def _within(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Those of ``pairs(x, y, top)`` whose bit sketches are within the bound: (x, y)."""
    for c in "xy":
        part = units.select(F.col("code").alias(f"c{c}"), F.col("top").alias(f"t{c}"), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
        pairs = pairs.join(part, (F.col(c) == F.col(f"c{c}")) & (F.col("top") == F.col(f"t{c}")))
    distance = F.expr("aggregate(zip_with(px, py, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")
    return pairs.where(distance <= F.expr("(nx + ny) div 7")).select("x", "y").distinct()


def linked(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", per_word: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n; (id, component) of those with links)."""
    per_word = per_word or PER_WORD
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.where("doc_id is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(0, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES))))))  # words take as many bytes as texts, at most
    schema = "kind int, doc_id long, n long, code long, slice long, bucket int, data binary"
    mapped = store.keep(named.mapInArrow(lambda x: _map(x, bits, per_word), schema), "mapped", "none")

    per = store.keep(mapped.where(f"kind = {DOC}").select("doc_id", "n", "code"), "sizes")
    told = mapped.where(f"kind = {KEYS}").repartitionById(1 << bits, "bucket").select("bucket", "slice", "n", "data").mapInArrow(_meet, "slice long, data binary")
    told = mapped.where(f"kind = {UNITS}").select("slice", "n", "data").unionByName(told.select("slice", F.lit(None).cast("long").alias("n"), "data"))
    told = told.repartition("slice").sortWithinPartitions("slice", F.col("n").asc_nulls_last())
    stay = store.keep(told.mapInArrow(_decide, "code long, crowded boolean").groupBy("code").agg(F.max("crowded").alias("crowded")), "stay")
    store.drop(mapped)
    if not stay.where("crowded").isEmpty():
        store.drop(per, stay)
        return linked(docs, store, id_col, text_col, per_word / 2)

    reps = per.where("n > 0").groupBy("code").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    same = store.keep(per.join(reps.where("copies > 1"), "code").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "same")
    reps = store.keep(stay.select("code").join(reps, "code").select("code", "rep"), "reps")
    ids = reps.select(F.col("rep").alias("id")).distinct()
    found = named.join(F.broadcast(ids) if reps.count() <= MOST_BROADCAST else ids, F.col("doc_id") == F.col("id")).select("doc_id", "text")
    units = store.keep(found.mapInArrow(lambda x: _units(x, per_word), UNIT).dropDuplicates(["code", "top"]), "units")

    words = units.select("code", "top", "n", "most", "guest", F.explode("keys").alias("key"))
    often = words.groupBy("key").agg(F.count("*").alias("size"))
    of_one = Window.partitionBy("code", "top").orderBy("size", "key")  # a document's words in a band
    used = words.join(often, "key").withColumn("place", F.row_number().over(of_one)).where("place <= most + 1 and size > 1")
    used = store.keep(used.select("key", "code", "top", "n", "guest"), "used")

    tried, n_links, done, comp = None, 0, [], store.keep(used.select(F.col("code").alias("id"), F.col("code").alias("component")).where("false"), "alone")
    for i in range(STARS):
        pairs = _star(used, comp, i)
        pairs = pairs.join(tried, ["x", "y"], "left_anti") if tried else pairs
        within = store.keep(_within(pairs, units), "within")
        links = store.keep(_links(within, units), "links")
        tried = tried.unionByName(within) if tried else within
        done += within, links
        new = links.count()
        n_links += new
        if not new:
            break
        comp = store.keep(components(store, comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links.toDF("a", "b"))), "so_far")
        if new < n_links * WORTH:
            break
    more = _rest(used, units, comp, store)

    edges = more.unionByName(comp.select(F.col("id").alias("x"), F.col("component").alias("y")))
    for c in "xy":
        edges = edges.join(reps.select(F.col("code").alias(f"c{c}"), F.col("rep").alias(f"r{c}")), F.col(c) == F.col(f"c{c}"))
    out = components(store, edges.select(F.col("rx").alias("a"), F.col("ry").alias("b")).unionByName(same))
    store.drop(*done, stay, reps, same, units, used, comp, more)
    return rows_of(per, rows), out


def rows_of(per: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n) of all rows, those without doc_id too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in itertools.chain.from_iterable(map(_slices, batches)):
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(shingles(x.column(1))[1])], ["doc_id", "n"])

    return per.select("doc_id", "n").unionByName(rows.where("doc_id is null").mapInArrow(count, "doc_id long, n long"))


def _placed(used: DataFrame, comp: DataFrame) -> DataFrame:
    """``used`` with the component so far, ``c``."""
    own = comp.select(F.col("id").alias("__i"), "component")
    return used.join(own, F.col("code") == F.col("__i"), "left").withColumn("c", F.coalesce("component", "code")).drop("__i", "component")


def _star(used: DataFrame, comp: DataFrame, i: int) -> DataFrame:
    """Pairs (x, y, top) of one document of a key, another in each round, with those in other components."""
    named = _placed(used, comp)
    first = named.groupBy("key").agg(F.min(F.struct("guest", F.xxhash64("code", F.lit(i)), "code", "n", "c")).alias("l"))
    star = named.join(first, "key").where("c <> l.c and not (guest and l.guest) and 4 * least(n, l.n) >= 3 * greatest(n, l.n)")
    return star.select(F.least("code", "l.code").alias("x"), F.greatest("code", "l.code").alias("y"), "top").distinct()


def _rest(used: DataFrame, units: DataFrame, comp: DataFrame, store: Store) -> DataFrame:
    """Links (x, y) that join what documents with a key in common, in different components so far, are linked to."""
    named = _placed(used, comp)
    members = [F.bit_xor(F.xxhash64("code", F.lit(i))).alias(f"m{i}") for i in range(2)]
    groups = named.groupBy("key", "top").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size"), F.min("guest").alias("all_guests"), *members)
    groups = groups.where("low <> high and not all_guests").groupBy("top", "size", "m0", "m1").agg(F.min("key").alias("key"))
    groups = groups.select("key", F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    rows = named.join(groups, "key").join(units.select("code", "top", "parity"), ["code", "top"])
    near = store.keep(_cut(rows, "parity").mapInArrow(_cells, "x long, y long").distinct(), "near")
    if near.isEmpty():
        return near
    clusters = components(store, near.toDF("a", "b")).toDF("code", "key")
    clusters = clusters.unionByName(clusters.select(F.col("key").alias("code"), "key").distinct())  # the smallest of each has no row
    sets = units.where("not guest").select("code", "n", "guest", "members")
    rows = store.keep(_placed(clusters, comp).join(sets.drop("members"), "code"), "clusters")
    size = F.greatest(F.count("*") / CELL, F.sum(F.col("n") * 8) / CELL_BYTES)
    groups = rows.groupBy("key").agg(F.ceil(size).cast("int").alias("blocks"))
    rows_of_sets = _cut(rows.join(groups, "key").join(sets.select("code", "members"), "code"), "members")
    links = store.keep(rows_of_sets.mapInArrow(lambda x: _cells(x, True), "x long, y long"), "rest", rows=SET_ROWS)
    store.drop(near, rows)
    return links


def _cut(rows: DataFrame, data: str) -> DataFrame:
    """The documents of each key in ``blocks`` blocks, each pair of which is a cell."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("code"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "code", "n", "c", "guest", data)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "second")


def _cells(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Of the pairs of a cell in different components whose bit sketches are within the bound, as many as connect what
    all of them connect. With ``whole`` sets instead of sketches, of those that link: as many as join the components
    that all of them join. Either way a cell of ``k`` documents gives fewer than ``k`` pairs."""

    def stream():
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(8)]
            data = b.column(8)
            for i, row in enumerate(zip(*cols, strict=True)):
                yield row, np.frombuffer(data[i].as_buffer(), "<u8") if whole else data[i].values.to_numpy()

    for (_, i, j), cell in itertools.groupby(stream(), key=lambda r: r[0][:3]):
        cell = list(cell)  # two blocks at most
        code, n, c, guest = (np.array([r[0][k] for r in cell]) for k in (4, 5, 6, 7))
        split = sum(not r[0][3] for r in cell) if i != j else 0
        if i != j and split in (0, len(cell)):
            continue
        sets = [r[1] for r in cell]
        if whole:
            top = 1 << int(np.ceil(np.log2(n.mean())))  # the bound holds for sketches of any length
            bits = np.stack([parities(s, top) for s in sets])
        else:
            bits = np.stack(sets).view(np.uint64)  # of signed numbers numpy would count the absolute values
        a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
        fits = np.not_equal.outer(c[a], c[b]) & ~np.logical_and.outer(guest[a], guest[b])
        fits &= 4 * np.minimum.outer(n[a], n[b]) >= 3 * np.maximum.outer(n[a], n[b])
        x, y = np.nonzero(fits if split else np.triu(fits, 1))
        y += split
        part = np.unique(c, return_inverse=True)[1] if whole else np.arange(len(cell))
        found, step = [], max(1, (1 << 21) // bits.shape[1])
        for low in range(0, len(x), step):
            p, q = x[low : low + step], y[low : low + step]
            apart = part[p] != part[q]
            p, q = p[apart], q[apart]
            near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1) <= (n[p] + n[q]) // 7
            for u, v in zip(p[near].tolist(), q[near].tolist(), strict=True):
                if part[u] != part[v] and (not whole or _alike(sets[u], sets[v])):
                    part[part == part[v]] = part[u]
                    found.append((u, v))
        if found:
            p, q = code[np.array(found).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["x", "y"])


def joined(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    per, comp = linked(docs, store, id_col, text_col)
    out = per.join(comp, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out


def unique(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that a document of smaller id in their component stands for."""
    _, comp = linked(docs, store, id_col, text_col)
    gone = comp.where("id <> component").select(F.col("id").alias("__id"))
    return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")
