"""Toxicity by multiple-instance learning: sentences are scored, labels are known for documents only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import packed, tokenize, unpacked
from fleetpulse.llm.learning import BUCKETS, FOLDS, PART, Vocabulary, adam, labelled_sample, pooled, sigmoid, softplus, spread_back, taken

THRESHOLD = 0.5
# Words in fewer labelled documents than this have no weight: they would only learn single texts by heart.
MIN_DOCUMENTS = 5
STEPS, RATE, L1 = 250, 0.1, 1e-4
SEED = 1
# A word's features: 0 for the whole word, else so many of its first bytes.
STARTS = (0, 4, 5, 6)
SENTENCE_WORDS = 8
_END = b"\x00"


def _letters() -> bytes:
    """Lower-cases A-Z, ends sentences at . ! ? and line ends, and takes other ASCII signs for blanks."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord("\n") if c in ".!?\n" else ord(c.lower()) if c.isalnum() else ord(" ")
    return bytes(out)


LETTERS = _letters()


@dataclass
class Sentences:
    """Distinct words of each instance of some texts: ``word`` of ``sentence``; the texts' rows; the words.

    An instance is one sentence or several short ones. Every word of the texts, in order, has its ``code``,
    its instance ``place``, and in ``part`` the number of its real sentence in its text; sentences without
    words are not counted.
    """

    word: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    words: list[bytes]
    code: np.ndarray
    place: np.ndarray
    part: np.ndarray


def sentences(texts: list[bytes | None]) -> Sentences:
    """Splits at sentence ends, of which one in SENTENCE_WORDS words counts: shorter sentences go together.

    Else a text that ends every word with a mark would have thousands of instances.
    """
    marked = [(t or b"").translate(LETTERS).replace(b"\n", b" \x00 ") + b" \x00" for t in texts]
    tokens = tokenize(pa.array(marked, pa.large_binary()), lower=False)
    known = tokens.vocabulary.cast(pa.binary()).to_pylist()
    mark = tokens.codes == (known.index(_END) if known else -1)
    owner = np.repeat(np.arange(len(texts)), np.diff(tokens.starts))
    before = np.cumsum(~mark)
    inside = (before - np.concatenate([[0], before])[tokens.starts[:-1]][owner]) // SENTENCE_WORDS
    marks = np.flatnonzero(mark)
    last = np.zeros(len(mark), bool)
    last[tokens.starts[1:] - 1] = True
    row, level = owner[marks], inside[marks]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (level[1:] > level[:-1])]) & (level > 0) if len(marks) else np.empty(0, bool)
    end = np.zeros(len(mark), bool)
    end[marks[fresh]] = True
    end |= last
    number = np.cumsum(end) - end
    size = np.int64(max(1, len(known)))
    pairs = np.unique(number[~mark] * size + tokens.codes[~mark])
    piece, text = np.cumsum(mark)[~mark], owner[~mark]
    nth = np.cumsum(np.concatenate([[False], piece[1:] != piece[:-1]])[: len(piece)])
    part = nth - nth[np.searchsorted(text, text)]
    return Sentences(pairs % size, pairs // size, owner[end], known, tokens.codes[~mark], number[~mark], part)


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of each word's features: the word itself, and its first bytes."""
    of = xxhash.xxh64_intdigest
    flat = [of(w[:n] if n else w + b"$", SEED) % BUCKETS if n <= len(w) else -1 for w in words for n in STARTS]
    return np.array(flat, np.int32).reshape(-1, len(STARTS))


@dataclass
class Model:
    """Weights of hashed word features, of fixed size whatever the corpus."""

    weights: np.ndarray
    bias: float

    def of_words(self, s: Sentences) -> np.ndarray:
        return pooled(self.weights, word_buckets(s.words))

    def logits(self, s: Sentences, word: np.ndarray | None = None) -> np.ndarray:
        word = self.of_words(s) if word is None else word
        return self.bias + np.bincount(s.sentence, word[s.word], len(s.row))

    def located(self, s: Sentences, word: np.ndarray, p: np.ndarray, least: float) -> list[tuple[int, dict]]:
        """(row, entry of ``_offending``) of the real sentences of the instances with ``p`` of at least ``least``.

        Of several sentences in an instance those that reach ``least`` by themselves, and the strongest.
        """
        bad = p >= least
        found = bad[s.place]
        wide, size = np.int64(s.part.max(initial=0) + 1), np.int64(max(1, len(s.words)))
        names, back = np.unique(s.place[found] * wide + s.part[found], return_inverse=True)
        pairs = np.unique(back * size + s.code[found])
        z = self.bias + np.bincount(pairs // size, word[pairs % size], len(names))
        place, part = names // wide, names % wide
        best, low, high = np.full(len(p), -np.inf), np.full(len(p), wide), np.zeros(len(p), np.int64)
        np.maximum.at(best, place, z)
        np.minimum.at(low, place, part)
        np.maximum.at(high, place, part)
        out = []
        for k in np.flatnonzero((sigmoid(z) >= least) | (z == best[place])):
            i = place[k]
            out.append((s.row[i], {"sentence": int(part[k]), "first": int(low[i]), "last": int(high[i]), "score": float(p[i])}))
        # A text without words is one empty sentence.
        filled = np.zeros(int(s.row.max(initial=-1)) + 1, bool)
        filled[s.row[s.place]] = True
        out += [(s.row[i], {"sentence": 0, "first": 0, "last": 0, "score": float(p[i])}) for i in np.flatnonzero(bad & ~filled[s.row])]
        return out


def fit(y: np.ndarray, texts: list[bytes], steps: int = STEPS, min_documents: int = MIN_DOCUMENTS, l1: float = L1) -> Model:
    """Fits sentence weights to document labels: a document is clean if all its sentences are (noisy-or).

    With p a sentence's probability, 1 - P = prod(1 - p).
    Without a document of each label the model is the share of label 1 for every text.
    """
    n_docs = len(texts)
    weights = np.zeros(BUCKETS, np.float32)
    if not y.any() or y.all():
        share = min(max(float(y.mean()) if n_docs else 0.0, 1e-6), 1 - 1e-6)
        return Model(weights, float(np.log(share / (1 - share))))
    known, names, places, owners, n = [], [], [], [], 0
    for k in range(0, n_docs, PART):
        s = sentences(texts[k : k + PART])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in s.words), np.uint64, len(s.words))
        known.append((hashes, word_buckets(s.words)))
        names.append(hashes[s.word])
        places.append((s.sentence + n).astype(np.int32))
        owners.append((s.row + k).astype(np.int32))
        n += len(s.row)
    vocabulary = Vocabulary.of(known)
    word = np.searchsorted(vocabulary.hashes, np.concatenate(names)).astype(np.int32)
    place, owner, size = np.concatenate(places), np.concatenate(owners), np.int64(len(vocabulary.hashes))
    del known, names, places, owners
    # Documents of a word.
    spread = np.bincount(np.unique(owner[place] * size + word) % size, minlength=size)
    used = vocabulary.used(spread, min_documents)
    column = np.full(BUCKETS + 1, -1, np.int32)
    column[used] = np.arange(len(used))
    columns = column[vocabulary.buckets]
    del vocabulary, spread, column

    def gradient(x: np.ndarray) -> np.ndarray:
        z = x[-1] + np.bincount(place, pooled(x[:-1], columns)[word], n)
        clean = np.exp(-np.bincount(owner, softplus(z), n_docs))
        pull = np.where(y, -clean / np.maximum(1 - clean, 1e-12), 1.0)
        g = sigmoid(z) * pull[owner]
        of_word = np.bincount(word, g[place], len(columns))
        w = x[:-1]
        return np.append(spread_back(of_word, columns, len(used)) / n_docs + l1 * w / (np.abs(w) + 0.01), g.sum() / n_docs)

    base = np.log(max(y.mean(), 1e-6) * n_docs / n)
    x = adam(np.append(np.zeros(len(used)), base), gradient, steps, RATE)
    weights[used] = x[:-1]
    return Model(weights, float(x[-1]))


def train(sample: DataFrame) -> Model:
    """``fit`` of (label, text) rows, whose number and length their maker bounds."""
    labels, texts = taken(sample)
    return fit(labels > 0, texts)


def score(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """All rows and columns, plus ``_score`` (0 to 1) and ``_offending``, the sentences of at least ``least``.

    ``_offending`` lists (sentence, first, last, score): the number of the sentence in its text, from 0, where a
    sentence has a word and ends at . ! ? or the end of a line. Short sentences are scored together:
    ``first`` to ``last`` are those that share the score. The model is of fixed size and broadcast.

    * Only the text is scored. NULL, empty and blank texts are one empty sentence.
    * Rows are judged one by one: repeated rows alike, an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.list_(pa.struct([("sentence", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            s = sentences(batch.column("text").to_pylist())
            z = shared.value.logits(s, word := shared.value.of_words(s))
            total = 1 - np.exp(-np.bincount(s.row, softplus(z), batch.num_rows))
            p = sigmoid(z)
            offending: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, entry in shared.value.located(s, word, p, least):
                offending[row].append(entry)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.clip(total, 0, 1)), pa.array(offending, listed)], ["row", "score", "offending"]
            )

    own = packed(docs, text=F.col("text").cast("binary"))
    found = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("sentence", "first", "last")], T.StructField("score", T.DoubleType())]))
    schema = T.StructType([own.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("offending", found)])
    return unpacked(own.mapInArrow(run, schema), docs.columns, _score=F.col("score"), _offending=F.col("offending"))


def train_on(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """The model of the documents that ``labels.toxic`` marks, without the held-out fold."""
    return train(labelled_sample(docs, labels, F.col("toxic"), folds))
