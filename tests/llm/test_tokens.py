"""Token store, token counts and pieces against the libraries, whole and through Spark."""

import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_words import ODD
from tokenizers import Tokenizer

from chunkloom.llm import bpe_machine, piece_codec, token_count, token_store

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = "abcREstdmvl'' \n\t\x0b\x0c\r 12!?é́漢🤷ѓ\u0085\x1c\x1f\x00\xa0·ªⅣ²　ΣİK▁<|>"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = ["".join(rng.choices(LETTERS, k=rng.randint(0, 40))) for _ in range(3000)]
    out += ["".join(rng.choices(LETTERS[:20], k=rng.randint(200, 3000))) for _ in range(60)]
    out += ["x" * 5000, " " * 4000, "'" * 700, "a" * 999 + " " * 33 + "b", "it's we're 'r 're' 'l 'll I'D", "a<|endoftext|>b<|startoftext|> <|endoftext|>'s"]
    return out + [t or "" for t in ODD]


def test_counts_equal_library(texts):
    whole = Tokenizer.from_file(BYTE)
    want = [len(x.ids) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    own = token_count.Counter(BYTE)
    assert own.counts(texts).tolist() == want
    token_count.BATCH_CHARS, before = 100, token_count.BATCH_CHARS
    try:
        assert own.counts(texts[:300]).tolist() == want[:300]
    finally:
        token_count.BATCH_CHARS = before


def test_chunk_maps_compose(monkeypatch, texts):
    """However texts are cut into chunks, pieces start at the same places."""
    joined = "".join(t + "\0" for t in texts[:500])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts[:500]]) - 1
    cls = token_count.char_classes()[code]
    cls[ends] = token_count.END
    starts = np.append(0, ends[:-1] + 1)
    want = token_count.piece_starts(cls, starts)
    for n in (1, 2, 7, 100_000):
        monkeypatch.setattr(token_count, "CHUNK", n)
        assert (token_count.piece_starts(cls, starts) == want).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ", max_size=40))
def test_machines_equal_merging(text):
    ids = {p: i for i, p in enumerate(["a", "b", " ", "ab", "aa", "aab", "ba", " a", "abab", "bb"])}
    order = {("a", "b"): 0, ("a", "a"): 1, ("a", "ab"): 2, ("b", "a"): 3, (" ", "a"): 4, ("ab", "ab"): 5, ("b", "b"): 6}
    pairs = bpe_machine.Pairs(ids, lambda a, b: order.get((a, b)))
    want = [ids[p] for p in pairs.merge(text)]
    assert bpe_machine.StreamCoder(pairs, None).encode(text) == want
    raw = bpe_machine.Pairs({p.encode(): i for p, i in ids.items()}, lambda a, b: order.get((a.decode(), b.decode())))
    assert bpe_machine.CountMachine(raw).count(text.encode()) == len(want)


def test_pieces_equal_library_and_come_back(texts):
    model, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_codec.Codec(PIECE)
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t)
        assert own.decode(ids) == t.replace("▁", " ") == model.decode(model.encode(t))
    assert own.coder.widest <= own.coder.HELD * own.coder.pairs.longest


def test_words_equal_library(texts):
    whole, own = Tokenizer.from_file(WORD), token_store.Encoder(WORD)
    assert own.parts is not None
    words = texts + [chr(i) for i in range(1, 0x250)] + [f"'{chr(i)}S{chr(i)}" for i in range(1, 0x250)]
    ids, n = own.encode(pa.array(words))
    want = whole.encode_batch_fast(words, add_special_tokens=False)
    ends = np.cumsum(n)
    assert [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)] == [x.ids for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_packed_ranks_come_back(ranks):
    control, data = token_store.pack(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_store.unpack(control, data, len(ranks)).tolist() == ranks


def test_broken_blocks_are_told():
    block = token_store.pack_block(np.array([1]), np.array([2]), np.array([3, 300]))
    assert [x.tolist() for x in token_store.unpack_block(block)] == [[1], [2], [3, 300]]
    for bad in (block[:-1], b"x" + block[1:]):
        with pytest.raises(ValueError):
            token_store.unpack_block(bad)


def stored(rows):
    whole, at, out = Tokenizer.from_file(WORD), 0, []
    for i, t in sorted(rows):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("sizes", [None, (3000, 500, 20_000)])
def test_store_in_any_order(spark, store, monkeypatch, texts, sizes):
    """In one piece, and with many ranges, blocks and slices of shuffled rows."""
    rows = [(i * 3, t) for i, t in enumerate([*texts[:400], *ODD])]
    if sizes:
        for name, value in zip(("RANGE_BYTES", "BLOCK_IDS", "SLICE_CHARS"), sizes, strict=True):
            monkeypatch.setattr(token_store, name, value)
        mixed = random.Random(4).sample(rows, len(rows))
    else:
        mixed = rows
    df = spark.createDataFrame(mixed, "doc_id long, text string").coalesce(3 if sizes else 1)
    assert sorted(map(tuple, token_store.stored(df, store, WORD).collect())) == stored(rows)


def test_store_odd_rows(spark, store, odd):
    got = token_store.stored(odd, store, WORD).collect()
    assert len(got) == odd.count() and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert {r.start for r in got if r.doc_id is None} == {0, 1} or min(r.start for r in got) == 0
    assert token_store.stored(odd.limit(0), store, WORD).count() == 0


def test_queries_of_odd_rows(spark, odd):
    counted = token_count.token_counts(odd, BYTE).collect()
    whole = Tokenizer.from_file(BYTE)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counted)
    out = piece_codec.encoded(odd, PIECE)
    assert "text" not in out.columns and out.where("round_trip").count() == odd.count()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert sorted(map(str, (r.ids for r in out.collect()))) == sorted(str(model.encode(r.text or "")) for r in odd.collect())
    assert piece_codec.encoded(odd.limit(0), PIECE).count() == token_count.token_counts(odd.limit(0), BYTE).count() == 0


def test_files_of_another_make_are_refused(tmp_path):
    for make, path in ((token_store.Encoder, BYTE), (token_count.Counter, WORD)):
        with pytest.raises(ValueError, match="not a"):
            make(path)
    other = tmp_path / "lower.json"
    spec = json.loads(Path(BYTE).read_text("utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    other.write_text(json.dumps(spec), "utf-8")
    with pytest.raises(ValueError, match="not a"):
        token_count.Counter(str(other))
