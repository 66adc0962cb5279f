"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search of ``bpe_machine.StreamCoder`` holds a window bounded by the longest piece and commits ids whenever the
backpointer paths of all places that can still be extended share a boundary. The model file at hand is a BPE model,
for which a path is admissible, and the best one, if each neighbouring pair of pieces encodes to itself; scores alone
would choose other pieces. Where a blank follows a word every path has a boundary, as no piece has a blank after
another symbol; so ids of such stretches are kept, within a bound, and looked up when they come again.

Decoding looks pieces up in one table of their bytes and gathers them with numpy.

Defined cases: null counts as empty and has no ids; a U+2581 in a text comes back as a space, as in the library;
characters without a piece are encoded by bytes, or as unknown where the model has no byte pieces. An empty table
gives an empty result. A model whose ids this search does not give (``PROBES``) is an error.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import Kept, Pairs, StreamCoder
from .shared import enter

MARK = "▁"
KEPT, SLICE_CHARS = 120_000, 2 << 20

#: Texts whose ids tell models of another kind, or with a normaliser, from those this search is for.
PROBES = ("the unbelievable wordiness of 1234 internationalisations", "  Two  blanks ", "\ufb01 \u2163 e\u0301 \uff21\n\tx")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        plain = {p: i for i, p in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        scores = {p: -model.get_score(i) for p, i in plain.items()}
        pairs = Pairs(plain, lambda a, b: scores.get(a + b))
        unk = model.unk_id()
        unknown = (lambda c: [byte_ids[b] for b in c.encode()]) if byte_ids else (lambda c: [unk])
        self.coder = StreamCoder(pairs, unknown)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.whole = any(MARK in p.lstrip(MARK) for p in plain)
        raw = [b""] * n
        for p, i in plain.items():
            raw[i] = p.replace(MARK, " ").encode()
        for b, i in byte_ids.items():
            raw[i] = bytes((b,))
        raw[unk] = " ⁇ ".encode()
        self.size = np.fromiter(map(len, raw), np.int64, n)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.kept = Kept(KEPT)
        for text in PROBES:
            if np.frombuffer(self.encode(text), "<u4").tolist() != model.encode(text):
                raise ValueError(f"{path}: not a BPE model without a normaliser")

    def _piece(self, text: str) -> bytes:
        if (ids := self.kept.find(text)) is None:
            ids = np.array(self.coder.encode(text), "<u4").tobytes()
            if len(text) <= 64:
                self.kept.put(text, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = MARK + text.replace(" ", MARK)
        parts = (text,) if self.whole else self.cut.findall(text)
        get, slow = self.kept.new.get, self._piece
        return b"".join([x if (x := get(p)) is not None else slow(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        """Bytes that aren't UTF-8 come back as U+FFFD."""
        k = np.frombuffer(ids, "<u4")
        n = self.size[k]
        total = int(n.sum())
        at = np.arange(total) + np.repeat(self.start[k] - (np.cumsum(n) - n), n)
        return self.bytes[at].tobytes().decode("utf-8", "replace")[1:]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE_CHARS`` of the last column, its texts: memory is for one, whatever the batch."""
    upto, at = np.cumsum(pc.binary_length(x.columns[-1]).to_numpy(zero_copy_only=False)), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield x.slice(at, end - at)
        at = end


def encoded(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without its text, and n_pieces, ids_crc32, round_trip (decoding the ids gives the text), ids.

    Columns of docs of these names give way.
    """
    made = ("n_pieces", "ids_crc32", "round_trip", "ids")
    rest = [c for c in docs.columns if c not in (*made, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("piece_codec", codec.cache_clear)
        own = codec(path)
        for x in itertools.chain.from_iterable(map(_slices, batches)):
            texts = x.column(len(rest)).to_pylist()
            n, crc, same, all_ids = [], [], [], []
            for t in texts:
                ids = own.encode(t)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(own.decode(ids) == t.replace(MARK, " "))
                if with_ids:
                    all_ids.append(ids)
            cols = [*x.columns[:-1], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                offsets = np.append(0, np.cumsum(n)).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(all_ids), "<i4"))))
            yield pa.RecordBatch.from_arrays(cols, [*rest, *made[: len(cols) - len(rest)]])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    schema += ", n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    rows = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, schema.removeprefix(", "))
