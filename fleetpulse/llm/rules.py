"""Quality rules as a ledger: measured once, failures kept as bits, policies applied to the bits afterwards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import packed, tokenize, unpacked

WINDOW = 8
# Text bytes that are measured together; a longer text is measured alone.
PART_BYTES = 1 << 23

MEASURES = ["n_words", "word_chars", "n_symbols", "n_repeat_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_letterless"]
_STRUCT = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"

# Kinds of bytes. In UTF-8 a byte from 0x80 to 0xBF continues a character, and none below 0x80 is part of a longer one.
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
_WORD_CHAR = ~_BLANK & ((_BYTES < 0x80) | (_BYTES > 0xBF))
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_LETTER = (_BYTES >= 0x80) | ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))


def _pairs_ranked(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for every pair, equal for equal pairs."""
    wide = np.int64(right.max(initial=0)) + 1
    return np.unique(left * wide + right, return_inverse=True)[1].astype(np.int64)


def window_ranks(codes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A number for every run of ``window`` codes, equal for equal runs: exact, by doubling the length."""
    ranks, length = np.asarray(codes, np.int64), 1
    while length < window:
        step = min(length, window - length)
        if len(ranks) <= step:
            return np.empty(0, np.int64)
        ranks = _pairs_ranked(ranks[:-step], ranks[step:])
        length += step
    return ranks


def repeated_words(codes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text: how many words lie in windows that occur twice or more in it."""
    n_texts, n = len(starts) - 1, len(codes)
    ranks = window_ranks(codes, window)
    owner = np.repeat(np.arange(n_texts), np.diff(starts))
    whole = np.flatnonzero(np.arange(len(ranks)) + window <= starts[1:][owner[: len(ranks)]])
    _, group, count = np.unique(ranks[whole] * np.int64(max(1, n_texts)) + owner[whole], return_inverse=True, return_counts=True)
    again = whole[count[group] > 1]
    edges = np.bincount(again, minlength=n + 1) - np.bincount(again + window, minlength=n + 1)
    return np.bincount(owner[np.cumsum(edges[:n]) > 0], minlength=n_texts)


def _measured(texts: pa.LargeStringArray) -> np.ndarray:
    """A row per text, a column per measure."""
    n = len(texts)
    tokens = tokenize(texts, lower=False)
    known = tokens.vocabulary.cast(pa.binary()).to_pylist()
    letterless = np.fromiter((not _LETTER[np.frombuffer(w, np.uint8)].any() for w in known), bool, len(known))
    sizes = np.diff(tokens.starts)
    owner = np.repeat(np.arange(n), sizes)

    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    flat = lines.flatten()
    bare = pc.ascii_trim_whitespace(flat)
    real = np.asarray(pc.greater(pc.binary_length(bare), 0))
    flat, bare, line_owner = flat.filter(pa.array(real)), bare.filter(pa.array(real)), line_owner[real]
    encoded = np.asarray(flat.dictionary_encode().indices, np.int64)
    distinct = np.unique(encoded * np.int64(max(1, n)) + line_owner) % max(1, n)
    n_lines = np.bincount(line_owner, minlength=n)
    starts_as = np.any([np.asarray(pc.starts_with(bare, s)) for s in BULLETS], axis=0)
    ends_as = np.any([np.asarray(pc.ends_with(bare, s)) for s in CUTS], axis=0)

    of_bytes = np.zeros((n, 2), np.int64)
    for i, text in enumerate(texts):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        of_bytes[i] = np.count_nonzero(_WORD_CHAR[data]), np.count_nonzero(_SYMBOL[data])
    return np.column_stack(
        [
            sizes,
            of_bytes,
            repeated_words(tokens.codes, tokens.starts),
            n_lines,
            n_lines - np.bincount(distinct, minlength=n),
            np.bincount(line_owner[starts_as], minlength=n),
            np.bincount(line_owner[ends_as], minlength=n),
            np.bincount(owner[letterless[tokens.codes]], minlength=n) if len(known) else np.zeros(n, np.int64),
        ]
    ).astype(np.int64)


def measure(texts: pa.Array) -> pa.Array:
    """All measures of a batch of texts, in parts of bounded bytes."""
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(whole), np.int64)) if len(whole) else np.empty(0, np.int64)
    rows, at = [np.empty((0, len(MEASURES)), np.int64)], 0
    while at < len(whole):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        rows.append(_measured(whole.take(pa.array(np.arange(at, stop)))))
        at = stop
    table = np.concatenate(rows)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(MEASURES))], names=MEASURES)


# Signs that begin a list item, and ends of a line that was cut off.
BULLETS = ("-", "*", "•", "‣", "▪")
CUTS = ("...", "…")


@dataclass(frozen=True)
class Rule:
    """One question to the measures. ``bit`` never changes its meaning, so that stored ledgers stay readable."""

    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule(0, "too_few_words", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "too_many_words", lambda m: m("n_words") > 100_000),
    Rule(3, "short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule(4, "long_words", lambda m: m("word_chars") > 12 * m("n_words")),
    Rule(5, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(6, "duplicate_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule(7, "bullet_lines", lambda m: 10 * m("n_bullet_lines") > 9 * m("n_lines")),
    Rule(8, "cut_lines", lambda m: 10 * m("n_cut_lines") > 3 * m("n_lines")),
    Rule(9, "letterless_words", lambda m: 10 * m("n_letterless") > 3 * m("n_words")),
)
BITS = {r.name: 1 << r.bit for r in RULES}


def mask(*names: str) -> int:
    return sum(BITS[n] for n in names)


BASE = mask("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: no ``hard`` rule may fail, and of the ``soft`` ones at most ``tolerated``."""

    version: str
    hard: int
    soft: int = 0
    tolerated: int = 0

    def keeps(self, bits: Column) -> Column:
        return (bits.bitwiseAND(F.lit(self.hard)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(self.soft))) <= self.tolerated)


POLICIES = (
    Policy("v1", BASE),
    Policy("v2", BASE | mask("too_many_words", "symbols", "duplicate_lines")),
    Policy(
        "v3",
        BASE | mask("symbols", "letterless_words"),
        mask("too_many_words", "short_words", "long_words", "duplicate_lines", "bullet_lines", "cut_lines"),
        1,
    ),
)
CURRENT = POLICIES[-1]


def failure_bits(measures: Column) -> Column:
    """Every rule's answer as one bit of a long."""
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        failed = F.coalesce(rule.fails(lambda name: measures.getField(name)), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << rule.bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """All rows and columns, plus ``_measures`` (struct of longs) and ``_bits`` (the rules that fail).

    Every rule is evaluated here, once; store the result to apply policies to it, also ones written later.

    * Whole texts are measured, each row by itself; only the text goes to Python.
    * NULL is an empty text: all measures 0; it fails ``too_few_words`` only.
    * Repeated rows have the same entry. An empty table gives no rows.
    * Windows and lines are compared by the words and lines themselves, not by hashes.
    """
    measured = F.arrow_udf(measure, _STRUCT)
    own = packed(docs, text=F.col("text")).select("row", measured("text").alias("measures"))
    return unpacked(own, docs.columns, _measures=F.col("measures"), _bits=failure_bits(F.col("measures")))


def judged(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with ``_kept`` under a policy and the names of its rules that fail (``_failed``)."""
    rows = packed(entries, bits=F.col("_bits"))
    considered = [r for r in RULES if (policy.hard | policy.soft) & BITS[r.name]]
    failed = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(BITS[r.name])) != 0, r.name) for r in considered]).cast("array<string>"))
    return unpacked(rows, entries.columns, _kept=policy.keeps(F.col("bits")), _failed=failed)


def select(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The documents that a policy keeps, all columns as they were."""
    entries = judged(ledger(docs), policy)
    return unpacked(packed(entries, keep=F.col("_kept")).where("keep"), docs.columns)


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """(policy, rule, n_documents, n_kept, n_failed, n_sole, n_kept_without, words_without) per rule of each policy.

    ``n_sole`` counts documents that fail no other rule of the policy, ``n_kept_without`` those that it would
    keep without the rule, ``words_without`` their words. No text is read and no rule evaluated again: the
    ledger is summed up by its bits first, at most a row for each combination, and every answer is
    taken from those few rows. An empty ledger gives no rows.
    """
    told = entries.groupBy(F.col("_bits").alias("bits")).agg(F.count("*").alias("n"), F.sum("_measures.n_words").alias("words"))
    bits, n = F.col("bits"), F.col("n")
    asked = []
    for policy in policies:
        for rule in RULES:
            bit = BITS[rule.name]
            if not (policy.hard | policy.soft) & bit:
                continue
            without = Policy(policy.version, policy.hard & ~bit, policy.soft & ~bit, policy.tolerated)
            failed = bits.bitwiseAND(F.lit(bit)) != 0
            sole = bits.bitwiseAND(F.lit(policy.hard | policy.soft)) == bit
            asked.append(
                F.struct(
                    F.lit(policy.version).alias("policy"),
                    F.lit(rule.name).alias("rule"),
                    policy.keeps(bits).alias("kept"),
                    failed.alias("failed"),
                    sole.alias("sole"),
                    without.keeps(bits).alias("without"),
                )
            )
    sums = lambda c, what=n: F.coalesce(F.sum(F.when(F.col(c), what)), F.lit(0))
    return (
        told.select("n", "words", F.inline(F.array(*asked)))
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_documents"),
            sums("kept").alias("n_kept"),
            sums("failed").alias("n_failed"),
            sums("sole").alias("n_sole"),
            sums("without").alias("n_kept_without"),
            sums("without", F.col("words")).alias("words_without"),
        )
    )


def drift(entries: DataFrame, before: Policy, after: Policy) -> DataFrame:
    """(kept_before, kept_after, n_documents, any_bits, all_bits): what a change of the policy moves.

    ``any_bits`` and ``all_bits`` are the rules that some, and that all, documents of a row fail.
    """
    keep = {"kept_before": before.keeps(F.col("_bits")), "kept_after": after.keeps(F.col("_bits"))}
    return entries.groupBy(*[c.alias(name) for name, c in keep.items()]).agg(
        F.count("*").alias("n_documents"), F.bit_or("_bits").alias("any_bits"), F.bit_and("_bits").alias("all_bits")
    )


_WORDS_SQL = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{_WORDS_SQL}') AS words FROM texts),
starts AS (
  SELECT r, p, list_slice(words, p, p + {WINDOW - 1}) AS run
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM worded)),
again AS (SELECT r, p FROM starts QUALIFY count(*) OVER (PARTITION BY r, run) > 1),
covered AS (SELECT r, count(DISTINCT p + o) AS n_repeat_words FROM again, range({WINDOW}) t(o) GROUP BY r),
lines AS (
  SELECT r, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)),
lined AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(bare, '^[-*\x{{2022}}\x{{2023}}\x{{25aa}}]')) AS n_bullet_lines,
    count(*) FILTER (regexp_matches(bare, '(\.\.\.|\x{{2026}})$')) AS n_cut_lines
  FROM lines WHERE bare <> '' GROUP BY r),
measures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines,
    coalesce(n_cut_lines, 0) AS n_cut_lines, len(list_filter(words, lambda w: NOT regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letterless
  FROM worded LEFT JOIN covered USING (r) LEFT JOIN lined USING (r)),
answers AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR 10 * n_letterless > 3 * n_words AS hard_failed,
    (n_words > 100000)::INT + (word_chars < 2 * n_words)::INT + (word_chars > 12 * n_words)::INT + (10 * n_dup_lines > 3 * n_lines)::INT
      + (10 * n_bullet_lines > 9 * n_lines)::INT + (10 * n_cut_lines > 3 * n_lines)::INT AS soft_failed
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT hard_failed AND soft_failed <= 1 AS kept
FROM answers
"""
