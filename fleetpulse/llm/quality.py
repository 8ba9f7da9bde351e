"""Quality by ordinal regression: one score from hashed text features, cut by ordered thresholds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import give_back, packed, tokenize, unpacked
from fleetpulse.llm.learning import BUCKETS, FOLDS, PART, Vocabulary, adam, labelled_sample, pooled, sigmoid, spread_back, taken

# A document is selected if it reaches this grade with this probability.
SELECT_GRADE = 1
SELECT_PROBABILITY = 0.5
MIN_DOCUMENTS = 3
STEPS, RATE, L1 = 250, 0.5, 1e-5
SEED = 2
# Every feature is a share of the text's words; the scale lets a rare word matter.
SCALE = 10.0


def graded(quality: Column, toxic: Column) -> Column:
    """Ratings of ``labels``: 0 for poor quality, 1 for good but toxic, 2 for good and clean."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


_KINDS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_REPEATS = re.compile(rb"(.)\1+", re.DOTALL)


def _shape(word: bytes) -> bytes:
    """Kinds of signs of a word in order, repeats left out: letters, capitals, digits, others as they are."""
    return _REPEATS.sub(rb"\1", word.translate(_KINDS))


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of each word's hashed features: itself in lower case, its beginning, its shape."""
    of = xxhash.xxh64_intdigest
    flat = [of(part, SEED) % BUCKETS for w in words for part in (b"w" + w.lower(), b"p" + w[:5].lower(), b"s" + _shape(w))]
    return np.array(flat, np.int32).reshape(-1, 3)


# Features of the text besides its words': words that repeat the one before, and texts without words.
REPEAT, EMPTY = (xxhash.xxh64_intdigest(f, SEED) % BUCKETS for f in (b"*repeat", b"*empty"))


def _counts(texts: list[bytes | None]):
    """Tokens, words per text, and how many repeat the word before."""
    tokens = tokenize(pa.array([t or b"" for t in texts], pa.large_binary()), lower=False)
    sizes = np.diff(tokens.starts)
    same = np.concatenate([[False], tokens.codes[1:] == tokens.codes[:-1]])[: len(tokens.codes)]
    same[tokens.starts[:-1][sizes > 0]] = False
    owner = np.repeat(np.arange(len(texts)), sizes)
    return tokens, owner, sizes, np.bincount(owner, same, len(texts))


@dataclass
class Model:
    """Shared weights of fixed size, and the thresholds between the grades, rising."""

    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, texts: list[bytes | None]) -> np.ndarray:
        tokens, owner, sizes, repeats = _counts(texts)
        known = tokens.vocabulary.cast(pa.binary()).to_pylist()
        word = pooled(self.weights, word_buckets(known))
        total = np.bincount(owner, word[tokens.codes], len(sizes)) + repeats * self.weights[REPEAT]
        return np.where(sizes > 0, SCALE * total / np.maximum(sizes, 1), SCALE * self.weights[EMPTY])

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, a column each."""
        return sigmoid(z[:, None] - self.thresholds)


def fit(grades: np.ndarray, texts: list[bytes], steps: int = STEPS, min_documents: int = MIN_DOCUMENTS, l1: float = L1) -> Model:
    """Cumulative-link (proportional odds) regression: P(grade > k) = sigmoid(w.x - t_k), t rising.

    Grades are 0, 1, 2, ...; grades without a document get a threshold of their own all the same.
    Without documents, or with one grade only, all weights are 0 and the thresholds give the shares.
    """
    top = max(1, int(grades.max())) if len(grades) else 1
    share = np.array([(grades > k).sum() + 0.5 for k in range(top)]) / (len(grades) + 1)
    prior = -np.log(share / (1 - share))
    prior = np.maximum.accumulate(prior + 1e-3 * np.arange(top))
    weights = np.zeros(BUCKETS, np.float32)
    if len(np.unique(grades)) < 2:
        return Model(weights, prior)
    n_docs = len(texts)
    vocabularies, names, docs, times, sizes, repeats = [], [], [], [], [], []
    for k in range(0, n_docs, PART):
        tokens, owner, size, repeat = _counts(texts[k : k + PART])
        known = tokens.vocabulary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        vocabularies.append((hashes, word_buckets(known)))
        wide = np.int64(max(1, len(known)))
        pairs, count = np.unique(owner * wide + tokens.codes, return_counts=True)
        names.append(hashes[pairs % wide])
        docs.append((pairs // wide + k).astype(np.int32))
        times.append(count.astype(np.int32))
        sizes.append(size)
        repeats.append(repeat)
    vocabulary = Vocabulary.of(vocabularies)
    del vocabularies
    # A part at a time: the driver holds no second copy of them all.
    sizes, repeats = np.concatenate(sizes), np.concatenate(repeats)
    value = np.concatenate([SCALE * n / sizes[d] for n, d in zip(times, docs)])
    del times
    doc = np.concatenate(docs)
    del docs
    word = np.concatenate([np.searchsorted(vocabulary.hashes, h).astype(np.int32) for h in names])
    del names
    n_words = len(vocabulary.hashes)
    used = np.union1d(vocabulary.used(np.bincount(word, minlength=n_words), min_documents), [REPEAT, EMPTY])
    column = np.full(BUCKETS + 1, -1, np.int32)
    column[used] = np.arange(len(used))
    at_repeat, at_empty = column[REPEAT], column[EMPTY]
    columns = column[vocabulary.buckets]
    del vocabulary, column
    repeated, empty = SCALE * repeats / np.maximum(sizes, 1), SCALE * (sizes == 0)
    n = len(used)

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[n] + np.concatenate([[0], np.cumsum(np.exp(x[n + 1 :]))])

    def gradient(x: np.ndarray) -> np.ndarray:
        z = np.bincount(doc, value * pooled(x[:n], columns)[word], n_docs) + repeated * x[at_repeat] + empty * x[at_empty]
        above = sigmoid(z[:, None] - thresholds(x))
        whole = np.column_stack([np.ones(n_docs), above, np.zeros(n_docs)])
        slope = whole * (1 - whole)
        row = np.arange(n_docs)
        p = np.maximum(whole[row, grades] - whole[row, grades + 1], 1e-9)
        gz = -(slope[row, grades] - slope[row, grades + 1]) / p / n_docs
        gw = spread_back(np.bincount(word, value * gz[doc], n_words), columns, n)
        gw[at_repeat] += repeated @ gz
        gw[at_empty] += empty @ gz
        gt = np.zeros(top + 2)
        np.add.at(gt, grades, slope[row, grades] / p / n_docs)
        np.add.at(gt, grades + 1, -slope[row, grades + 1] / p / n_docs)
        gt = gt[1:-1]
        tail = np.cumsum(gt[::-1])[::-1]  # a threshold moves all above it
        return np.concatenate([gw + l1 * x[:n] / (np.abs(x[:n]) + 0.01), tail[:1], tail[1:] * np.exp(x[n + 1 :])])

    start = np.concatenate([np.zeros(n), prior[:1], np.log(np.maximum(np.diff(prior), 1e-3))])
    x = adam(start, gradient, steps, RATE)
    weights[used] = x[:n]
    return Model(weights, thresholds(x))


def train(sample: DataFrame) -> Model:
    """``fit`` of (label, text) rows, whose number and length their maker bounds."""
    model = fit(*taken(sample))
    give_back()
    return model


def train_on(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """The model of the graded documents, without the held-out fold."""
    return train(labelled_sample(docs, labels, graded(F.col("quality"), F.col("toxic")), folds))


def score(docs: DataFrame, model: Model, grade: int = SELECT_GRADE, least: float = SELECT_PROBABILITY) -> DataFrame:
    """All rows and columns, plus ``_grade`` (expected), ``_tail`` (probability of ``grade`` or more), ``_selected``.

    * Only the text is scored, all of it. NULL, empty and blank texts have the weight of texts without words.
    * The model is of fixed size and broadcast; rows are judged one by one, repeated rows alike.
    * An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = shared.value.tails(shared.value.latent(batch.column("text").to_pylist()))
            columns = [batch.column("row"), pa.array(tails.sum(axis=1)), pa.array(np.ascontiguousarray(tails[:, min(grade, tails.shape[1]) - 1]))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "grade", "tail"])

    own = packed(docs, text=F.col("text").cast("binary"))
    schema = T.StructType([own.schema["row"], T.StructField("grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])
    scored = own.mapInArrow(run, schema)
    results = {"_grade": F.col("grade"), "_tail": F.col("tail"), "_selected": F.col("tail") >= least}
    return unpacked(scored, docs.columns, **results)


def select(docs: DataFrame, model: Model, grade: int = SELECT_GRADE, least: float = SELECT_PROBABILITY) -> DataFrame:
    """The documents that reach the grade likely enough, all columns kept."""
    scored = score(docs, model, grade, least)
    return unpacked(packed(scored, keep=F.col("_selected")).where("keep"), docs.columns)
