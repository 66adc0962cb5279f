"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary.

Two machines. One splits a text into the pieces within which merges happen: ten states over character classes, whose
transitions say where pieces start. Texts are cut into chunks; for each chunk the map from every entering state to
the state after it is computed, for all chunks at once; the maps are composed by a parallel prefix scan, which gives
every chunk its entering state; then starts are read off, again for all chunks at once. The other is the transducer
of ``bpe_machine``, whose transitions carry emitted-token counts; it reads each distinct piece once and is kept with
its counts, within a bound, between batches.

Defined cases: null counts as empty and has no tokens; the strings of added tokens inside a text count as the library
takes them, one token each, splitting the text around them; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import CountMachine, Kept, Pairs

CHUNK = 256
#: Characters handled at once, and counts kept between batches.
BATCH_CHARS, KEPT = 2_000_000, 350_000

# Character classes and states of the splitting machine.
LETTER, ONE, R, V, L, E, NUMBER, SPACE, BLANK, QUOTE, OTHER, END, PAD = range(13)
(FRESH, IN_LETTERS, IN_NUMBER, IN_OTHER, AT_SPACE, AT_BLANK, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(10)
STATES, CLASSES = 10, 13
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next state and marks by (state, class), for
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|blanks not before a non-blank|blanks."""
    go, mark = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    letters = (LETTER, ONE, R, V, L, E)
    own = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBER, SPACE: AT_SPACE, BLANK: AT_BLANK, QUOTE: AT_QUOTE, OTHER: IN_OTHER}
    for s in range(STATES):
        for c, to in own.items():
            go[s, c], mark[s, c] = to, HERE
        go[s, END], mark[s, END] = FRESH, HERE
        go[s, PAD] = s
    stays = [(IN_LETTERS, c) for c in letters] + [(IN_NUMBER, NUMBER), (IN_OTHER, OTHER), (IN_OTHER, QUOTE)]
    stays += [(s, c) for s in (AT_SPACE, AT_BLANK) for c in (SPACE, BLANK)] + [(AT_QUOTE, OTHER), (AT_QUOTE, QUOTE)]
    for s, c in stays:
        mark[s, c] = 0
    go[IN_OTHER, QUOTE] = go[AT_QUOTE, QUOTE] = IN_OTHER
    for c in (*letters, NUMBER, OTHER, QUOTE):
        mark[AT_SPACE, c] = BEFORE  # the last space goes with what follows
        mark[AT_BLANK, c] = BEFORE | HERE  # another last blank is a piece of its own
    go[AT_SPACE, QUOTE] = IN_OTHER  # " '" is no contraction
    go[AT_QUOTE, ONE], mark[AT_QUOTE, ONE] = FRESH, 0
    for c, s, ends in ((R, QUOTE_R, E), (V, QUOTE_V, E), (L, QUOTE_L, L)):
        go[AT_QUOTE, c], mark[AT_QUOTE, c] = s, 0
        for x in (*own, END):  # no contraction after all: the letter before starts a piece and is read as such
            go[s, x], mark[s, x] = go[IN_LETTERS, x], mark[IN_LETTERS, x] | BEFORE
        go[s, ends], mark[s, ends] = FRESH, 0
    return go, mark


GO, MARK = _machine()


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class by code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, chars):
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1])
            for x, y in ([(a, b)] if b < 0xD800 or a > 0xDFFF else [(a, 0xD7FF), (0xE000, b)]):
                out[x : y + 1] = cls
    for chars, cls in (("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        out[[ord(c) for c in chars]] = cls
    return out


def piece_starts(cls: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces start, by character. ``cls``: classes of all texts, each closed by END; ``texts``: their starts."""
    n = len(cls)
    sizes = np.diff(np.append(texts, n))
    per = -(-sizes // CHUNK)
    first = np.repeat(np.cumsum(per) - per, per)  # of each chunk's text, its first chunk
    within = np.arange(len(first)) - first
    start = np.repeat(texts, per) + within * CHUNK
    length = np.minimum(CHUNK, np.repeat(texts + sizes, per) - start)
    grid = np.full((CHUNK, len(start)), PAD, np.uint8)
    at = np.arange(n) - np.repeat(start, length)
    chunk = np.repeat(np.arange(len(start)), length)
    grid[at, chunk] = cls
    go = GO.ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(start), axis=1)
    for row in grid:
        maps = go[maps * np.uint8(CLASSES) + row]
    step, most = 1, int(per.max(initial=1))
    while step < most:  # compose with the maps of the ``step`` chunks before, where the text has them
        has = np.flatnonzero(within >= step)
        maps[:, has] = maps[maps[:, has - step], has]
        step *= 2
    state = np.full(len(start), FRESH, np.uint8)
    later = np.flatnonzero(within > 0)
    state[later] = maps[FRESH, later - 1]
    marks, mark = np.empty_like(grid), MARK.ravel()
    for i, row in enumerate(grid):
        k = state * np.uint8(CLASSES) + row
        marks[i] = mark[k]
        state = go[k]
    flat = marks[at, chunk]
    starts = (flat & HERE) != 0
    starts[:-1] |= (flat[1:] & BEFORE) != 0
    return starts


class Counter:
    """Counts tokens of texts for a byte-level BPE file of the tokenizers library; files of another make are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        known = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        changed = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not known or model.get("type") != "BPE" or any(model.get(x) for x in changed):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        raw = lambda s: bytes(shown[c] for c in s)
        ids = {raw(p): i for p, i in spec["model"]["vocab"].items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.machine = CountMachine(Pairs(ids, lambda a, b: ranks.get((a, b))))
        added = sorted((x["content"] for x in spec.get("added_tokens", ())), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.sign = "<" if all("<" in x for x in added) else ""  # whatever has none of it has no added token
        self.kept = Kept(KEPT)

    def piece(self, text: str) -> int:
        if (n := self.kept.find(text)) is None:
            n = self.machine.count(text.encode())
            if len(text) <= 64:
                self.kept.put(text, n)
        return n

    def counts(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out[at:end] = self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.added and self.sign in text and self.added.search(text):
                cut = self.added.split(text)
                extra[i] = len(cut) - 1
            else:
                cut = (text,)
            parts += cut
            owner += [i] * len(cut)
        joined = "\0".join(parts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
        cls = char_classes()[code]
        cls[ends] = END
        starts = np.flatnonzero(piece_starts(cls, np.append(0, ends[:-1] + 1)))
        cuts = starts.tolist()
        get, slow = self.kept.new.get, self.piece
        bounds = zip(cuts, [*cuts[1:], len(joined)], strict=True)
        n = np.fromiter(((x if (x := get(t)) is not None else slow(t)) for a, b in bounds for t in (joined[a:b],)), np.int64, len(cuts))
        n[cls[starts] == END] = 0
        total = np.add.reduceat(n, np.searchsorted(starts, np.append(0, ends[:-1] + 1)))
        return extra + np.bincount(owner, total, len(texts)).astype(np.int64)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": counter(path).counts(x["text"].tolist())})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
