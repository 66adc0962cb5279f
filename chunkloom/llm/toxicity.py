"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is logistic in the sum of its words' weights; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Weights are trained from document labels alone by gradient steps on the documents' log-likelihood,
whose gradient for a toxic document goes mostly to the sentences that explain its label; so the same weights then
locate the offending sentences. Words weigh by themselves and by their first 4 and 5 letters; only such of these as are
found in clearly more toxic documents than chance explains have a weight.

A sentence ends after a word that ends in . ! ? | ; or :, or after ``LONGEST`` words. The classifier is fitted on at
most ``MOST`` labelled documents of each class, those with the smallest hash of doc_id (equal ids, as rows, in no
fixed order among themselves); every document is scored, whole.

Defined cases: null counts as empty, whose score is 0, having no sentence; labels that are null, or whose doc_id is
null or not among the documents, teach nothing; without both classes among the labels every score is 0. Columns
besides the id and the text are no inputs. Repeated rows score alike.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_machine import Kept
from .shared import enter
from .token_store import spread

MOST, LONGEST, SLICE_CHARS, KEPT, DOCS_AT_ONCE = 2500, 40, 2 << 20, 60_000, 200
THRESHOLD = 0.7
ENDS = tuple(".!?|;:")
STRIP = ".,;:!?|\"'()[]{}<>*#%-_/\\&=+~`^$@"
STEPS, RATE, DECAY = 500, 0.3, 1e-5


def features(word: str) -> tuple[str, ...]:
    word = word.strip(STRIP).lower()
    return (word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)) if word else ()


class Sentences:
    """Words of texts as indices into the distinct words, and the sentences' starts."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False)
        full = np.fromiter((w != "" for w in self.words), bool, len(self.words))[index]
        self.index = index[full]
        self.docs = np.append(0, np.cumsum(full))[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64)
        stop = np.fromiter((w.endswith(ENDS) for w in self.words), bool, len(self.words))[self.index]
        n = len(self.index)
        first = np.zeros(n + 1, bool)
        first[1:] = stop
        first[self.docs] = True
        at = np.flatnonzero(first[:n])
        size = np.diff(np.append(at, n))
        pieces = -(-size // LONGEST)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        #: first word of each sentence; of each document, its first sentence
        self.starts = np.repeat(at, pieces) + LONGEST * within
        self.of_doc = np.searchsorted(self.starts, self.docs)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.index], self.starts) if len(self.starts) else np.zeros(0)

    def documents(self, values: np.ndarray) -> np.ndarray:
        """Sums over documents."""
        upto = np.append(0.0, np.cumsum(values))
        return upto[self.of_doc[1:]] - upto[self.of_doc[:-1]]


def fit(texts: pa.Array, labels: list[int]) -> tuple[dict[str, float], float]:
    """(weights by feature, bias)."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return {}, -40.0
    bags = Sentences(texts)
    # features of the distinct words as numbers, flat
    numbers: dict[str, int] = {}
    flat, size = array("i"), np.zeros(len(bags.words), np.int64)
    for i, word in enumerate(bags.words):
        own = features(word)
        size[i] = len(own)
        flat.extend([numbers.setdefault(f, len(numbers)) for f in own])
    if not numbers:
        return {}, -40.0
    flat = np.frombuffer(flat, np.int32)
    start = np.cumsum(size) - size
    n_docs = len(texts)
    count = np.zeros((2, len(numbers)), np.int64)
    for low in range(0, n_docs, DOCS_AT_ONCE):  # documents with each feature, by class
        docs = np.arange(low, min(n_docs, low + DOCS_AT_ONCE))
        words = bags.index[bags.docs[low] : bags.docs[docs[-1] + 1]]
        of = np.repeat(docs, np.diff(bags.docs[low : docs[-1] + 2]))
        pairs = np.unique(np.repeat(of, size[words]) * len(numbers) + flat[spread(start[words], size[words])])
        for c in (0, 1):
            count[c] += np.bincount(pairs[y[pairs // len(numbers)] == c] % len(numbers), minlength=len(numbers))
    telling = _telling(count[1], count[0], y.mean())
    names = [f for f, t in zip(numbers, telling, strict=True) if t]
    number = np.full(len(numbers) + 1, -1)
    number[:-1][telling] = np.arange(len(names))
    row, col = np.repeat(np.arange(len(size)), size), number[flat]
    row, col = row[col >= 0], col[col >= 0]
    size = np.bincount(row, minlength=len(size))
    del numbers, flat, start, count
    weights, bias = np.zeros(len(names)), -5.0
    moved, moved_bias = np.full(len(names), 1e-8), 1e-8
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    sentence_doc = np.repeat(np.arange(n_docs), np.diff(bags.of_doc))
    told = np.flatnonzero(size[bags.index] > 0)  # the places of words with weights
    at_word, at_sentence = bags.index[told], np.searchsorted(bags.starts, told, "right") - 1
    for _ in range(STEPS):
        own = np.bincount(row, weights[col], len(size))
        z = np.clip(np.bincount(at_sentence, own[at_word], len(bags.starts)) + bias, -40, 40)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-bags.documents(np.logaddexp(0, z)))  # prod(1 - p)
        pull = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0) * share
        dz = p * pull[sentence_doc]
        by_word = np.bincount(at_word, dz[at_sentence], len(size))
        grad = np.bincount(col, by_word[row], len(names)) + DECAY * weights / len(y)
        moved += grad**2
        weights -= RATE * grad / np.sqrt(moved)
        moved_bias += dz.sum() ** 2
        bias -= RATE * dz.sum() / np.sqrt(moved_bias)
    return {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-6}, float(bias)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict, float]:
    """Fits on at most ``most`` labelled documents of each class, none of them held out."""
    told = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"), F.xxhash64(F.col(id_col)).alias("__h")
    )
    told = told.dropDuplicates(["__id"])
    per = [told.where(f"__y = {y}").orderBy("__h", "__id").limit(most) for y in (0, 1)]
    picked = per[0].unionByName(per[1])
    rows = docs.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    # both sides of the sample are bounded by its size
    found = rows.join(F.broadcast(picked), F.col("__i") == F.col("__id")).dropDuplicates(["__id"]).orderBy("__h", "__id").select("__t", "__y").toArrow()
    return fit(found["__t"].combine_chunks(), found["__y"].to_pylist())


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def _telling(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Features in so many toxic documents that chance would give one such feature in all, by a bound of the tail
    of the binomial distribution (Chernoff)."""
    n = np.maximum(toxic + clean, 1)
    rate = np.clip(toxic / n, 1e-12, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = rate * np.log(rate / share) + np.where(rate < 1, (1 - rate) * np.log((1 - rate) / (1 - share)), 0.0)
    return (rate > share) & (n * far > np.log(max(2, len(n))))


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.kept = weights, bias, Kept(KEPT)

    def word(self, word: str) -> float:
        if (x := self.kept.find(word)) is None:
            x = sum(self.weights.get(f, 0.0) for f in features(word))
            if len(word) <= 64:
                self.kept.put(word, x)
        return x

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sentences]:
        """(document scores, worst sentence of each or -1, sentence scores, sentences)."""
        bags = Sentences(texts)
        get, slow = self.kept.new.get, self.word
        own = np.fromiter((x if (x := get(w)) is not None else slow(w) for w in bags.words), float, len(bags.words))
        z = np.clip(bags.sums(own) + self.bias, -40, 40)
        score = -np.expm1(-bags.documents(np.logaddexp(0, z)))
        worst = np.full(len(texts), -1, np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(bags.of_doc))
        order = np.lexsort((np.arange(len(z)), -z, doc))
        lead = order[np.append(True, np.diff(doc[order]) > 0)] if len(order) else order
        worst[doc[lead]] = lead - bags.of_doc[doc[lead]]
        return np.clip(score, 0.0, 1.0), worst, 1 / (1 + np.exp(-z)), bags


@lru_cache(1)
def _scorer(key: str, of) -> Scorer:
    return Scorer(*of.value)


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    upto, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def scores(docs: DataFrame, model: tuple[dict, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), made: tuple[str, str] = ("score", "worst_sentence")) -> DataFrame:
    """One row per document: doc_id (and columns ``keep``), score, worst_sentence (from 0; -1 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = str(shared._jbroadcast.id())
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity", _scorer.cache_clear)
        own = _scorer(key, shared)
        for x in batches:
            for at, texts in _slices(x.column(len(names))):
                score, worst, _, _ = own.score(texts)
                cols = [c.slice(at, len(texts)) for c in x.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array(worst)], [*names, *made])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names) + f"{made[0]} double, {made[1]} long"
    rows = docs.select(*names, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, schema)


def located(docs: DataFrame, model: tuple[dict, float], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences that score ``threshold`` or more: doc_id, sentence, first_word, n_words, score, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = str(shared._jbroadcast.id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity", _scorer.cache_clear)
        own = _scorer(key, shared)
        for x in batches:
            for i in range(x.num_rows):
                _, _, each, bags = own.score(x.column(1).slice(i, 1))
                ends = np.append(bags.starts[1:], len(bags.index))
                found = np.flatnonzero(each >= threshold)
                cut = [" ".join(bags.words[w] for w in bags.index[bags.starts[k] : ends[k]]) for k in found]
                doc = pa.array([x.column(0)[i].as_py()] * len(found), x.column(0).type)
                cols = [doc, pa.array(found), pa.array(bags.starts[found]), pa.array((ends - bags.starts)[found]), pa.array(each[found]), pa.array(cut, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sentence", "first_word", "n_words", "score", "text"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, sentence long, first_word long, n_words long, score double, text string")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Trains and scores: doc_id, held_out, score, predicted, worst_sentence."""
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with its columns."""
    names = [c for c in docs.columns if c != "text"]
    # the text goes along, so rows need no join: ids may repeat
    out = scores(docs, train(docs, labels), keep=(*[c for c in names if c != "doc_id"], "text"), made=("__score", "__worst"))
    return out.where(F.col("__score") < threshold).select(*docs.columns)
