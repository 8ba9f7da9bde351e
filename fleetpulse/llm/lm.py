"""LM scoring: quantised n-gram counts in a log-frequency Bloom filter, probed level by level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import Tokens, give_back, join_unique, stored, text_key, tokenize
from fleetpulse.llm.common import words as words_of

ADD = 0.1
# Share of the pair's relative frequency against the word's own probability, for a word before it that is
# frequent; half of that where it was seen CALM times.
SHARE, CALM = 0.6, 8.0
BASE = 2.0
BITS_PER_ENTRY = 10
PROBES = 6
# N-grams of one section, on average: a task builds it, a worker finds it by its number.
SECTION_TOKENS = 1 << 19
# Bytes of sections that are broadcast at once. More n-grams than these hold are scored in further passes.
MAX_BYTES = 80 << 20
# Words whose exact counts are broadcast: at most so many, of at most so many bytes.
HOT_WORDS, HOT_BYTES = 1 << 19, 64
END = b"\n"  # no word holds white space
_U64 = np.uint64
_PENDING, _KNOWN = 1 << 22, 1 << 20
# N-grams of groups that leave a task in one batch, about.
_SENT = 1 << 18
# Sections that a task builds at once, and words up to so many bytes, whose hash is computed for a whole batch.
GROUP, _BATCHED_BYTES = 2, 64
_KNOWN_BATCH = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word: eight bytes at a time of all words of a batch, long words one by one."""
    words = words.cast(pa.large_binary())
    if words.offset:
        words = words.take(pa.array(np.arange(len(words))))
    if not len(words):
        return np.empty(0, _U64)
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, np.int64)[: len(words) + 1]
    sizes = np.diff(cuts)
    text = np.frombuffer((data.to_pybytes() if data else b"")[: cuts[-1]] + bytes(8), np.uint8)
    eights = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    hashes = _mixed(sizes.astype(_U64) + _U64(0x9E3779B97F4A7C15))
    short = np.flatnonzero(sizes <= _BATCHED_BYTES)
    for at in range(0, _BATCHED_BYTES, 8):
        short = short[sizes[short] > at]
        if not len(short):
            break
        over = np.maximum(at + 8 - sizes[short], 0).astype(_U64) * _U64(8)
        part = eights[cuts[short] + at] << over  # bytes behind the word go
        hashes[short] = _mixed((hashes[short] ^ _mixed(part + _U64(at + 1))) * _U64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(sizes > _BATCHED_BYTES).tolist():
        hashes[i] = xxhash.xxh64_intdigest(text[cuts[i] : cuts[i + 1]])
    return hashes


def level(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    """Quantised counts: 1 for 1, one more for every factor of ``base``; 0 for none."""
    return np.where(counts > 0, np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9) + 1, 0).astype(np.int64)


def level_count(levels: np.ndarray, base: float = BASE) -> np.ndarray:
    """The count that stands for a level: the middle of those it holds."""
    low = base ** (levels - 1.0)
    return np.where(levels > 0, (np.ceil(low - 1e-9) + np.ceil(low * base - 1e-9) - 1) / 2, 0.0)


def section_of(hashes: np.ndarray, sections: int) -> np.ndarray:
    return ((hashes >> _U64(32)) % _U64(sections)).astype(np.int64)


def _walk(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of (n-gram, level) begin, and the step from one to the next."""
    start = _mixed(hashes + _U64(0x9E3779B97F4A7C15 * level % (1 << 64)))
    return start, _mixed(start) | _U64(1)


def _place(at: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    """A place below ``bits`` (32 bits at most) from the upper half of ``at``."""
    return (((at >> _U64(32)) * bits) >> _U64(32)).astype(np.int64)


def build_section(hashes: np.ndarray, counts: np.ndarray, bits: float = BITS_PER_ENTRY, base: float = BASE) -> bytes:
    """Bits of one section: every n-gram is put in once for each level up to its own.

    The section has ``bits`` bits for each of these entries, so the rate of false levels is the
    same in all sections and at every size of the corpus.
    """
    levels = level(counts, base)
    size = 8 * max(8, int(np.ceil(levels.sum() * bits / 8)))
    found = np.zeros(size, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        at, step = _walk(hashes[levels >= j], j)
        for _ in range(PROBES):
            found[_place(at, _U64(size))] = True
            at = at + step
    return np.packbits(found, bitorder="little").tobytes()


@dataclass
class Filter:
    """Sections ``first`` up to ``last`` of the ``total`` of a filter: where each begins and ends in ``data``.

    A section may have no n-grams, and so no bytes. No n-gram of another section is found.
    """

    starts: np.ndarray
    data: bytes | bytearray
    first: int
    last: int
    base: float = BASE
    total: int | None = None

    def sections(self, hashes: np.ndarray) -> np.ndarray:
        """The section of each n-gram, counted from ``first``."""
        return section_of(hashes, self.total or self.last) - self.first

    def owns(self, hashes: np.ndarray) -> np.ndarray:
        section = self.sections(hashes)
        return (section >= 0) & (section < self.last - self.first)

    def levels(self, hashes: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Highest level up to which all levels are found; too high at times, never too low.

        Levels over ``most`` are not looked for.
        """
        data = np.frombuffer(self.data, np.uint8)
        section = self.sections(hashes)
        here = (section >= 0) & (section < self.last - self.first)
        found = np.zeros(len(hashes), np.int64)
        open_ = np.flatnonzero(here if most is None else here & (most > 0))
        first, bits = self.starts[section[open_]], 8 * np.diff(self.starts)[section[open_]].astype(_U64)
        real = bits > 0
        open_, first, bits = open_[real], first[real], bits[real]
        j = 0
        while len(open_) and j < 64:
            j += 1
            at, step = _walk(hashes[open_], j)
            for _ in range(PROBES):
                place = _place(at, bits)
                hit = (data[first + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                open_, first, bits, step, at = open_[hit], first[hit], bits[hit], step[hit], at[hit]
                at = at + step
            found[open_] = j
            if most is not None:
                more = most[open_] > j
                open_, first, bits = open_[more], first[more], bits[more]
        return found


def unigram(ids: np.ndarray) -> np.ndarray:
    return _mixed(ids + _U64(1))


def bigram(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(before + _U64(2)) * _U64(3) + ids)


END_ID = word_hashes(pa.array([END]))


def ids_are_words(tokens: Tokens) -> np.ndarray:
    """Which places of ``sequence`` are words; the others are ends."""
    word = np.ones(len(tokens.codes) + len(tokens.starts) - 1, bool)
    word[np.cumsum(np.diff(tokens.starts) + 1) - 1] = False
    return word


def sequence(tokens: Tokens, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts of a batch with an end after each; what stands before each; text rows.

    ``hashes`` are those of the vocabulary.
    """
    sizes = np.diff(tokens.starts)
    ids = np.full(len(tokens.codes) + len(sizes), END_ID[0], _U64)
    ids[ids_are_words(tokens)] = hashes[tokens.codes]
    # A text begins after an end.
    return ids, np.concatenate([END_ID, ids[:-1]]), np.repeat(np.arange(len(sizes)), sizes + 1)


def _grouped(grams: np.ndarray, counts: np.ndarray, total: int) -> Iterator[pa.RecordBatch]:
    """(grp, grams, counts) of distinct n-grams: those of one group of sections are one row, some groups a batch."""
    group = (section_of(grams, total) // GROUP).astype(np.int32)
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)
    names, first = group[cuts[:-1]], 0
    del group
    while first < len(names):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + _SENT, "right")) - 1)
        spans = [order[a:b] for a, b in zip(cuts[first:last], cuts[first + 1 : last + 1])]
        packed = [pa.array([part[at].astype(kind).tobytes() for at in spans], pa.binary()) for part, kind in ((grams, "<u8"), (counts, "<i8"))]
        yield pa.RecordBatch.from_arrays([pa.array(names[first:last]), *packed], ["grp", "grams", "counts"])
        first = last


def _counted(pending: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, in order, and how often each occurs; ``pending`` is emptied and sorted in one array."""
    grams = np.concatenate(pending)
    pending.clear()
    grams.sort()
    first = np.flatnonzero(np.concatenate([[len(grams) > 0], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(first, append=len(grams)).astype(np.int32)


def pair_grams(docs: DataFrame, total: int) -> DataFrame:
    """(grp, grams, counts) of the pairs, counted within a task before they are shuffled; in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        for batch in batches:
            tokens = tokenize(batch.column("text"), lower=True)
            ids, before, _ = sequence(tokens, word_hashes(tokens.vocabulary))
            pending.append(bigram(before, ids))
            del tokens, ids, before
            if sum(map(len, pending)) > _PENDING:
                yield from _grouped(*_counted(pending), total)
        if pending:
            yield from _grouped(*_counted(pending), total)
        give_back()

    return docs.select("text").mapInArrow(run, "grp int, grams binary, counts binary")


def word_grams(counts: DataFrame, total: int) -> DataFrame:
    """(grp, grams, counts) of the words of the exact counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _grouped(unigram(word_hashes(batch.column("word"))), batch.column("c").to_numpy(), total)

    return counts.select("word", "c").mapInArrow(run, "grp int, grams binary, counts binary")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): exact counts of the words, as bytes, and of the ends of texts.

    Counted within a task first, so a word that every text has is a row for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(pending).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            tokens = tokenize(batch.column("text"), lower=True)
            words = pa.concat_arrays([tokens.vocabulary.cast(pa.large_binary()), pa.array([END], pa.large_binary())])
            times = np.append(np.bincount(tokens.codes, minlength=len(tokens.vocabulary)), batch.num_rows)
            pending.append(pa.table({"word": words, "c": pa.array(times.astype(np.int64))}))
            if sum(t.num_rows for t in pending) > _KNOWN:
                pending[:] = [summed()]
                if pending[0].num_rows > _KNOWN // 2:
                    yield from pending[0].cast(counted).to_batches(_KNOWN_BATCH)
                    pending.clear()
        if pending:
            yield from summed().cast(counted).to_batches(_KNOWN_BATCH)
            pending.clear()
        give_back()

    counted = pa.schema([("word", pa.binary()), ("c", pa.int64())])
    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def section_number(tokens: int, section_tokens: int = SECTION_TOKENS) -> int:
    """It follows the tokens, so a section stays of bounded size."""
    return max(1, -(-tokens // section_tokens))


def sections(grams: DataFrame, total: int, bits: float = BITS_PER_ENTRY, base: float = BASE) -> DataFrame:
    """(section, data) of the filter of (grp, grams, counts) rows.

    The counts of a gram are summed in the task that builds its section: they are shuffled once, packed. Rows
    come in order of their groups, so a task holds one group at a time.
    """

    def build(group: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        gram = np.concatenate([np.frombuffer(g, _U64) for g, _ in group])
        n = np.concatenate([np.frombuffer(c, "<i8") for _, c in group])
        distinct, back = np.unique(gram, return_inverse=True)
        times = np.bincount(back, n).astype(np.int64)
        section = section_of(distinct, total)
        names = np.unique(section)
        data = [build_section(distinct[mine], times[mine], bits, base) for mine in (section == name for name in names)]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(data, pa.binary())], ["section", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            for name, gram, n in zip(*[column.to_pylist() for column in batch.columns]):
                if group and name != now:
                    yield build(group)
                    group = []
                now = name
                group.append((gram, n))
        if group:
            yield build(group)
            group = []
        give_back()

    placed = grams.repartition(-(-total // GROUP), "grp").sortWithinPartitions("grp")
    return stored(placed.mapInArrow(run, "section int, data binary"), "lm-sections")


def passes(made: DataFrame, total: int, most: int = MAX_BYTES, base: float = BASE) -> Iterator[Filter]:
    """The filter, as many sections at a time as ``most`` bytes hold; at least one."""
    sizes = np.zeros(total, np.int64)
    for row in made.select("section", F.octet_length("data").alias("bytes")).collect():
        sizes[row.section] = row.bytes
    first = 0
    while first < total:
        last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), most, "right")) + first)
        starts = np.concatenate([[0], np.cumsum(sizes[first:last])])
        data = bytearray(int(starts[-1]))
        # A partition at a time: the driver never holds the sections twice.
        for row in made.where((F.col("section") >= first) & (F.col("section") < last)).toLocalIterator():
            data[starts[row.section - first] : starts[row.section - first + 1]] = row.data
        yield Filter(starts, data, first, last, base, total)
        first = last


@dataclass
class Exact:
    """Totals of the training tokens, and the exact counts of the most frequent words by their hashes."""

    tokens: int
    distinct: int
    ends: int
    hashes: np.ndarray
    words: pa.Array
    counts: np.ndarray

    def log_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.distinct + 1)))

    def of(self, tokens: Tokens, hashes: np.ndarray) -> np.ndarray:
        """Counts of the vocabulary, 0 for words not at hand; the words themselves decide, not their ``hashes``."""
        found = np.zeros(len(tokens.vocabulary), np.int64)
        if not len(self.words) or not len(found):
            return found
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.asarray(pc.equal(self.words.take(pa.array(at)), tokens.vocabulary.cast(pa.large_binary())))
        found[same] = self.counts[at[same]]
        return found


def frequent_words(counts: DataFrame, totals, most: int = HOT_WORDS) -> Exact:
    """The exact table; its size is bounded by the number of words and their length.

    The words of the greatest counts, as far as there is room. A histogram over the counts' orders of
    magnitude, each in 256 parts by hash, says which; nothing is sorted.
    """
    size, part = F.floor(F.log2(F.col("c").cast("double")) * 4).cast("int"), F.pmod(F.xxhash64("word"), F.lit(256)).cast("int")
    short = counts.where(F.octet_length("word") <= HOT_BYTES)
    histogram = short.groupBy(size.alias("size"), part.alias("part")).agg(F.count("*").alias("words")).collect()
    last, room = None, most
    for row in sorted(histogram, reverse=True):
        room -= row["words"]
        if room < 0:
            break
        last = (row["size"], row["part"])
    least = F.lit(False) if last is None else (size > last[0]) | ((size == last[0]) & (part >= last[1]))
    chosen = short.where(least).toArrow()
    words = chosen["word"].combine_chunks().cast(pa.large_binary())
    hashes = word_hashes(words)
    order = np.argsort(hashes, kind="stable")
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return Exact(totals["n"], totals["v"], ends, hashes[order], words.take(pa.array(order)), chosen["c"].to_numpy()[order])


def score_batch(tokens: Tokens, hashes: np.ndarray, levels: np.ndarray, end: int, exact: Exact, pairs: Filter) -> np.ndarray:
    """Log10 probabilities of the texts, of the tokens whose pair is in the sections at hand.

    ``levels`` has the filter's level of each word, ``end`` that of an end.

    p(w | h) = s c(h w) / c(h) + (1 - s) p(w), s = SHARE c(h) / (c(h) + CALM), with p(w) as in the base but
    all counts from the filters. A pair is looked for up to the level of the rarer of both.
    """
    ids, before, row = sequence(tokens, hashes)
    single = np.full(len(ids), end, np.int64)
    single[ids_are_words(tokens)] = levels
    # A text begins after an end.
    whole = np.concatenate([[end], single[:-1]])
    grams = bigram(before, ids)
    mine = pairs.owns(grams)
    if not mine.all():
        row, grams, single, whole = row[mine], grams[mine], single[mine], whole[mine]
    # Functions of a level are computed once for each of them.
    count = level_count(np.arange(65), pairs.base)
    probability = 10 ** exact.log_probability(count)
    share, rest = SHARE / (count + CALM), 1 - SHARE * count / (count + CALM)
    both = pairs.levels(grams, np.minimum(single, whole))
    mixed = share[whole] * count[both] + rest[whole] * probability[single]
    # Without any token bincount counts in whole numbers.
    return np.bincount(row, np.log10(mixed), len(tokens.starts) - 1).astype(np.float64)


def score(
    docs: DataFrame, train: Column, base: float = BASE, bits: float = BITS_PER_ENTRY, most_bytes: int = MAX_BYTES,
    hot_words: int = HOT_WORDS, section_tokens: int = SECTION_TOKENS,
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` marks the rows to learn from.

    * Counts cover all training rows: summed within tasks, then by word, or by pair in the section of the filter.
    * The filters are broadcast, ``most_bytes`` at a time, with the same bits per entry at every size. More pairs
      are scored in further passes over the documents, each of which owns the tokens of its sections; with more
      words, passes before those note each word's level beside the text, a byte per word.
    * The base is exact. Frequent words are looked up in a broadcast table of bounded size, which also
      keeps them out of the shuffle; all others are joined with the counts of all words.
    * A NULL or empty text is one end. Repeated rows are scored alike, rows that share a doc_id each on its own.
    * Without training rows all counts are 0 and every token has the probability 1 / (V + 1) = 1.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"), train.alias("train"))
    learnt = own.where("train")
    counts = stored(word_counts(learnt), "lm-words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    of_words, of_pairs = section_number(totals["v"], section_tokens), section_number(totals["n"], section_tokens)
    word_sections = sections(word_grams(counts, of_words), of_words, bits, base)
    pair_sections = sections(pair_grams(learnt, of_pairs), of_pairs, bits, base)
    context = docs.sparkSession.sparkContext
    exact = frequent_words(counts, totals, hot_words)
    n, v = exact.tokens, exact.distinct
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def noted(texts: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = tokenize(batch.column("text"), lower=True)
                levels = sent.value.levels(unigram(word_hashes(tokens.vocabulary)))[tokens.codes].astype(np.uint8)
                levels += np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8)
                rows = [levels[a:b].tobytes() for a, b in zip(tokens.starts[:-1], tokens.starts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], ["doc_id", "key", "text", "levels"])

        return texts.mapInArrow(run, f"doc_id {id_type}, key long, text string, levels binary")

    texts, words, end = own.select("doc_id", "key", "text"), None, 0
    for words in passes(word_sections, of_words, most_bytes, base):
        end += int(words.levels(unigram(END_ID))[0])
        if words.last - words.first == of_words:
            break  # one broadcast holds all words: their levels are looked up when they are needed
        if "levels" not in texts.columns:
            count = F.size(words_of(F.col("text")))
            texts = texts.withColumn("levels", F.repeat(F.lit("\0"), count).cast("binary"))
        sent = context.broadcast(words)
        texts, words = stored(noted(texts, sent), "lm-levels"), None
        sent.unpersist()
    shared = context.broadcast((exact, words))
    del exact, words

    def word_levels(batch: pa.RecordBatch, tokens: Tokens, hashes: np.ndarray) -> np.ndarray:
        words = shared.value[1]
        if words is None:
            return np.frombuffer(b"".join(batch.column("levels").to_pylist()), np.uint8)
        return words.levels(unigram(hashes))[tokens.codes]

    def first_pass(pairs):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            exact = shared.value[0]
            names = ["doc_id", "key", "n_tokens", "known", "base", "score", "rare"]
            for batch in batches:
                tokens = tokenize(batch.column("text"), lower=True)
                hashes = word_hashes(tokens.vocabulary)
                size = np.int64(max(1, len(tokens.vocabulary)))
                of = exact.of(tokens, hashes)[tokens.codes]
                sizes = np.diff(tokens.starts)
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                hot = of > 0
                base_sum = np.bincount(owner[hot], exact.log_probability(of[hot]), batch.num_rows) + exact.log_probability(np.float64(exact.ends))
                n_known = np.bincount(owner[hot], minlength=batch.num_rows) + (exact.ends > 0)
                left, times = np.unique(owner[~hot] * size + tokens.codes[~hot], return_counts=True)
                cuts = np.searchsorted(left, np.arange(batch.num_rows + 1) * size).astype(np.int32)
                word = tokens.vocabulary.take(pa.array(left % size)).cast(pa.binary())
                rare = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([word, pa.array(times.astype(np.int64))], ["word", "times"]))
                scores = score_batch(tokens, hashes, word_levels(batch, tokens, hashes), end, exact, pairs.value)
                columns = [batch.column("doc_id"), batch.column("key"), pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(scores), rare]
                yield pa.RecordBatch.from_arrays(columns, names)

        return texts.mapInArrow(run, f"doc_id {id_type}, key long, n_tokens long, known long, base double, score double, rare array<struct<word:binary,times:bigint>>")

    def later_pass(pairs):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = tokenize(batch.column("text"), lower=True)
                hashes = word_hashes(tokens.vocabulary)
                scores = score_batch(tokens, hashes, word_levels(batch, tokens, hashes), end, shared.value[0], pairs.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(scores)], ["doc_id", "key", "more"])

        return texts.mapInArrow(run, f"doc_id {id_type}, key long, more double").groupBy("doc_id", "key").agg(F.first("more").alias("more"))

    rows = None
    for pairs in passes(pair_sections, of_pairs, most_bytes, base):
        sent = context.broadcast(pairs)
        if rows is None:
            rows = stored(first_pass(sent).withColumn("rid", F.monotonically_increasing_id()), "lm-rows")
        else:
            more = stored(later_pass(sent), "lm-pass")
            met = join_unique(rows, more, ["doc_id", "key"], "left")
            rows = stored(met.withColumn("score", F.col("score") + F.col("more")).drop("more"), "lm-rows")
        sent.unpersist()

    # The words that are not broadcast.
    seen = rows.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.times")
    met = seen.join(counts.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    c = F.coalesce("c", F.lit(0))
    part = F.log10((c + ADD) / F.lit(n + ADD * (v + 1))) * F.col("times")
    rest = met.groupBy("rid").agg(F.sum(part).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    full = rows.drop("rare", "key").join(rest.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left")
    return full.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
