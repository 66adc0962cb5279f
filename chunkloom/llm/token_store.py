"""Token ids in files: ids ranked by frequency, one to four bytes each, their lengths in separate control bytes.

Three steps. (1) Texts are encoded; each distinct stretch between blanks goes through the library once and is kept,
within a bound. Tasks write their ids, dealt into ranges of doc_id and compressed, and their counts by id. (2) The
counts are summed over all documents; ids get ranks, 0 for the most frequent. (3) Each range is put in ascending
order and written in blocks; a range holds about ``RANGE_BYTES`` of text, so a task needs bounded memory. If the
slices that step 1 wrote hold ranges of doc_id that don't overlap, step 3 takes each as it is and shuffles nothing.

A block is a header, the documents' ids and lengths, the control bytes (four two-bit lengths each) and the data
bytes (ranks, little-endian without leading zero bytes). Decoding looks control bytes up in a table of 256 x 4
lengths and gathers the data bytes, all with numpy.

Defined cases: null counts as empty; an empty text is the end id alone; equal doc_ids stand beside each other in no
fixed order; rows without doc_id come first; an empty table gives no blocks; a tokenizer file of another make than
``Encoder`` knows is an error.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_machine import Kept
from .shared import Store

RANGE_BYTES, BLOCK_IDS, KEPT, AT_ONCE = 48 << 20, 1 << 20, 500_000, 4096
SLICE_CHARS, MOST_BROADCAST = 12 << 20, 1_000_000
MAGIC = b"VTOK1\0\0\0"
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
NO_ID = -(1 << 63)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at, raw = np.cumsum(size) - size, np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for i in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > i)
        out[more] |= raw[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def pack_block(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ranks), len(control), len(data))
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + control + data


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if block[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, c, d = struct.unpack_from("<QQQQ", block, 8)
    at = 40 + 12 * docs
    if len(block) != at + c + d:
        raise ValueError("a block of another length than its header says")
    ids = np.frombuffer(block, "<i8", docs, 40)
    return ids, np.frombuffer(block, "<u4", docs, 40 + 8 * docs), unpack(block[at : at + c], block[at + c :], n)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1 .. of every stretch, one stretch after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: Characters up to U+017F that stand for themselves until they are lower-cased.
PLAIN = re.compile("[!-~\u00a1-\u017f]+")


class Encoder:
    """Ids of whole texts. Blanks end words here, so what stands between blanks is encoded alone, and once.

    That holds for files of one make (NFC, blanks to one, lower case, split by a regex without blanks, byte level);
    others are refused. Words of plain characters are split here and only their parts go to the library's model; all
    other words go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.kept = self.library.model, Kept(KEPT)
        # ids are kept as bytes: small, and nothing for the garbage collector to walk
        wide = self.library.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.code = ("<u4", "I") if wide else ("<u2", "H")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [(x["type"], x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space")) for x in split]
        known = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        known = known and kinds == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
        self.parts = regex.compile(split[0]["pattern"]["Regex"]).findall if known else None
        if not known or any(" " in x for x in self.parts(" a  1 . a1. ")):
            raise ValueError(f"{path}: not a file whose words blanks end (NFC, blanks to one, lower case, split by a regex, byte level)")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}

    def _word(self, word: str) -> bytes | None:
        """Ids of a new word; None if the library has to see it whole."""
        if "<|" in word or not PLAIN.fullmatch(word):
            return None
        found, put, code, out = self.kept.find, self.kept.put, self.code, []
        for part in self.parts(word.lower()):
            if (ids := found(part)) is None:
                raw = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
                ids = array(code, [t.id for t in self.model.tokenize(raw)]).tobytes()
                if len(part) <= 64:
                    put(part, ids)
            out.append(ids)
        ids = out[0] if len(out) == 1 else b"".join(out)
        if len(word) <= 64 and (len(out) != 1 or word != word.lower()):
            put(word, ids)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        get, slow, word = self.kept.new.get, self.kept.find, self._word
        found = [x if (x := get(w)) is not None or (x := slow(w)) is not None else word(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            made = self.library.encode_batch_fast([words[i] for i in part], add_special_tokens=False)
            for i, x in zip(part, made, strict=True):
                found[i] = np.array(x.ids, self.kind).tobytes()
                if len(words[i]) <= 64:
                    self.kept.put(words[i], found[i])
        flat = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = size[which]
        ids = flat[spread((np.cumsum(size) - size)[which], each)]
        upto = np.append(0, np.cumsum(each))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.diff(upto[offsets])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Batches of bounded text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(x.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(upto):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + SLICE_CHARS, "right")))
        yield x.slice(at, end - at)
        at = end


def _ranges(doc_ids: np.ndarray, bounds: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Range of each doc_id; an id that fills several ranges is spread over them."""
    low, high = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
    return low + spread % (high - low + 1)


def write(docs: DataFrame, store: Store, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes all documents; returns (blocks, ranks): (range, block, before, n_ids, payload) and (id, rank, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, total // RANGE_BYTES)
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts or [0.5], 100 * n_ranges)).first()[0] if cuts else []
    bounds = np.array(bounds or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, counts = encoder(path), TaskContext.get().partitionId(), np.zeros(0, np.int64)
        row = lambda **x: pa.RecordBatch.from_arrays([pa.array([x[c]], kind) for c, kind in ENCODED.items()], list(ENCODED))
        shrink = zstandard.ZstdCompressor(level=1).compress
        for x in itertools.chain.from_iterable(map(_slices, batches)):
            doc_ids = x.column(0).to_numpy(zero_copy_only=False)
            ids, sizes = own.encode(x.column(1))
            starts = np.cumsum(sizes) - sizes
            made = np.insert(ids, starts + sizes, end_id)
            starts, sizes = starts + np.arange(len(sizes)), sizes + 1
            seen = np.bincount(made, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            where = _ranges(doc_ids, bounds, sizes)
            order = np.lexsort((doc_ids, where))
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                if not len(part):
                    continue
                out = made[spread(starts[part], sizes[part])]
                raw = doc_ids[part].astype("<i8").tobytes() + sizes[part].astype("<u4").tobytes()
                raw += out.astype("<u2" if out.max() < 65536 else "<u4").tobytes()
                low, high = int(doc_ids[part[0]]), int(doc_ids[part[-1]])
                yield row(range=int(where[part[0]]), task=task, low=low, high=high, n_docs=len(part), n_ids=len(out), data=shrink(raw))
        used = np.flatnonzero(counts)
        raw = used.astype("<u4").tobytes() + counts[used].astype("<i8").tobytes()
        yield row(range=-1, task=task, low=0, high=0, n_docs=0, n_ids=len(used), data=raw)

    made = store.keep(rows.mapInArrow(encode, "range int, task int, low long, high long, n_docs long, n_ids long, data binary"), "ids", "none")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for n, raw in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                ids, counts = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts)], ["id", "n"])

    counts = made.where("range = -1").select("n_ids", "data").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most the vocabulary
    ranked = counts.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).cast("int"))
    ranks = store.keep(ranked, "ranks")
    table = ranks.toPandas()
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"]] = table["rank"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range come together, in order of range."""
        rows = (tuple(c[i].as_py() for c in x.columns) for x in batches for i in range(x.num_rows))
        for at, group in itertools.groupby(rows, key=lambda r: r[0]):
            docs, sizes, ids = [], [], []
            for _, n_docs, n_ids, data in group:
                raw = zstandard.ZstdDecompressor().decompress(data)
                docs.append(np.frombuffer(raw, "<i8", n_docs))
                sizes.append(np.frombuffer(raw, "<u4", n_docs, 8 * n_docs))
                wide = (len(raw) - 12 * n_docs) // n_ids
                ids.append(np.frombuffer(raw, f"<u{wide}", n_ids, 12 * n_docs))
            docs, sizes, ids = np.concatenate(docs), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
            order, starts = np.argsort(docs, kind="stable"), np.cumsum(sizes) - sizes
            cut = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // BLOCK_IDS)) + 1
            before = 0
            for no, part in enumerate(np.split(order, cut)):
                ranked = rank_of[ids[spread(starts[part], sizes[part])]]
                block = pack_block(docs[part], sizes[part], ranked)
                cols = (pa.array([at], pa.int64()), pa.array([no], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ranked)], pa.int64()), pa.array([block], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(cols), ["range", "block", "before", "n_ids", "payload"])
                before += len(ranked)

    parts = made.where("range >= 0")
    schema = "range long, block int, before long, n_ids long, payload binary"
    if _in_order(parts):
        dealt = parts.select(F.col("low").alias("range"), "n_docs", "n_ids", "data")  # each row is a range of its own
    else:
        dealt = parts.repartitionById(n_ranges, "range").sortWithinPartitions("range", "low")
        dealt = dealt.select(F.col("range").cast("long"), "n_docs", "n_ids", "data")
    return store.keep(dealt.mapInArrow(blocks, schema), "blocks", "zstd"), ranks


ENCODED = {"range": pa.int32(), "task": pa.int32(), "low": pa.int64(), "high": pa.int64(), "n_docs": pa.int64(), "n_ids": pa.int64(), "data": pa.binary()}


def _in_order(parts: DataFrame) -> bool:
    """Whether the rows, each of a slice of one task, hold ranges of doc_id that don't overlap."""
    next_low = F.lead("low").over(Window.orderBy("low", "high"))
    return not parts.select((next_low <= F.col("high")).alias("bad")).agg(F.max("bad")).first()[0]


def read(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row per document, from the blocks: doc_id, start, n_tokens, ids_crc32."""
    table = ranks.toPandas()  # at most the vocabulary
    id_of = np.zeros(max(1, len(table)), "<u4")
    id_of[table["rank"]] = table["id"]
    per = blocks.groupBy("range").agg(F.sum("n_ids").alias("n"))
    run = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("first"))
    few = per.count() <= MOST_BROADCAST  # 16 bytes for each slice of up to SLICE_CHARS
    rows = blocks.join(F.broadcast(per) if few else per, F.col("range") == F.col("r")).select((F.col("first") + F.col("before")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for start, payload in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                docs, sizes, ranked = unpack_block(payload.as_py())
                ids, ends = id_of[ranked], np.cumsum(sizes, dtype=np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(docs, mask=docs == NO_ID), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, store: Store, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read(*write(docs, store, path, end_id, id_col, text_col))
