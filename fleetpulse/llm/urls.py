"""URL filters: a sorted array of rule digests, probed by binary search, matches confirmed by text."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import UPPER, ascii_lower, packed, unpacked

ALLOW, BLOCK = "allow", "block"
# What the registered query judges by.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
# A rule set beyond this is refused: cut it by top-level domain and judge each part's pages.
MAX_INDEX_BYTES = 256 * 1024 * 1024
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_key(text: str) -> bytes:
    """A rule as it is stored: host in lower case, then its path from the first slash."""
    name, slash, rest = text.partition("/")
    return (name.translate(str.maketrans(UPPER, UPPER.lower())) + slash + rest).encode()


class DigestIndex:
    """Rules in the order of their 64-bit digests: digests, then ends of the texts, then the texts."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        verdicts: dict[bytes, str] = {}
        for verdict, text in rules:
            key = rule_key(text)
            verdicts[key] = BLOCK if BLOCK in (verdict, verdicts.get(key)) else ALLOW
        order = sorted(verdicts, key=lambda k: (digest(k), k))
        self.n = len(order)
        self.mapped = None
        self.path_sizes = sorted({len(k) - len(k.partition(b"/")[0]) for k in order})
        self.blocks = np.array([verdicts[k] == BLOCK for k in order], bool)
        ends = np.cumsum([0, *map(len, order)]).astype(np.int64)
        self.data = np.array([digest(k) for k in order], np.uint64).tobytes() + ends.tobytes() + b"".join(order)
        if len(self.data) > MAX_INDEX_BYTES:
            raise ValueError(f"rules take {len(self.data)} bytes; the limit is {MAX_INDEX_BYTES}")

    def open(self) -> MappedIndex:
        """The mapping; made once per worker."""
        if self.mapped is None:
            self.mapped = MappedIndex(self)
        return self.mapped

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": None}


class MappedIndex:
    """The index, memory-mapped from a scratch file of this worker that has no name and ends with it."""

    def __init__(self, index: DigestIndex):
        self.index = index
        self.file = tempfile.TemporaryFile()
        self.file.write(index.data or b"\0")
        self.file.flush()
        whole = np.memmap(self.file, np.uint8, "r")
        n = index.n
        self.digests = whole[: 8 * n].view(np.uint64)
        self.ends = whole[8 * n : 8 * n + 8 * (n + 1)].view(np.int64)
        self.texts = whole[8 * n + 8 * (n + 1) :]

    def text(self, at: int) -> bytes:
        return self.texts[self.ends[at] : self.ends[at + 1]].tobytes()

    def longest(self, hosts: Sequence[str], paths: Sequence[str]) -> list[int]:
        """Place of the longest rule that fits each url, of equally long ones that of the longer host; -1 for none."""
        keys, owner = [], []
        for row, (name, rest) in enumerate(zip(hosts, paths)):
            for key in candidates(name.encode(), rest.encode(), self.index.path_sizes):
                keys.append(key)
                owner.append(row)
        best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)
        probes = np.fromiter(map(digest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, probes, "left")
        last = np.searchsorted(self.digests, probes, "right")
        for k in np.flatnonzero(first < last):
            for at in range(first[k], last[k]):  # all with this digest: only the stored text decides
                if self.text(at) == keys[k]:
                    best[owner[k]] = max(best[owner[k]], (len(keys[k]), len(keys[k].partition(b"/")[0]), at))
        return [at for _, _, at in best]


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def candidates(name: bytes, rest: bytes, path_sizes: Sequence[int]) -> list[bytes]:
    """Every rule that could fit: the host and its parent domains, with the path's prefixes of the sizes in use."""
    if not name:
        return []
    labels = name.split(b".")
    prefixes = [rest[:n] for n in path_sizes if n <= len(rest)]
    return [b".".join(labels[i:]) + p for i in range(len(labels)) for p in prefixes]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = ALLOW) -> DataFrame:
    """All rows and columns, plus ``_host``, ``_path``, ``_rule`` and ``_verdict``.

    ``rules`` are (verdict, "host/path"): each fits its host and all subdomains, where the
    url's path starts with the rule's. The longest decides, no rule gives ``default``.

    * The index is bounded by MAX_INDEX_BYTES and broadcast; pages are not shuffled, and only
      host and path reach Python.
    * The host is what lies between the first :// and the next /, ? or #, with a port or user if there
      is one; A-Z are lower-cased. The path goes on to ? or #.
    * A NULL url and one without :// have an empty host and path, which no rule fits.
    * A rule given twice blocks if one of them does. Without rules all is ``default``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(DigestIndex(rules))

    @F.pandas_udf("rule string, block boolean")
    def decide(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        index = shared.value.open()
        places = index.longest(hosts, paths)
        told = [(index.text(at).decode(), bool(index.index.blocks[at])) if at >= 0 else (None, None) for at in places]
        return pd.DataFrame({"rule": pd.Series([r for r, _ in told], dtype=object), "block": pd.Series([b for _, b in told], dtype=object)})

    parts = packed(pages, host=host(F.col("url")), path=path(F.col("url")))
    judged = parts.withColumn("told", decide("host", "path"))
    verdict = F.when(F.col("told.block").isNull(), F.lit(default)).when(F.col("told.block"), BLOCK).otherwise(ALLOW)
    results = {"_host": F.col("host"), "_path": F.col("path"), "_rule": F.col("told.rule"), "_verdict": verdict}
    return unpacked(judged, pages.columns, **results)


ORACLE_SQL = (
    r"""
WITH rules(verdict, rule) AS (VALUES """
    + ", ".join(f"('{v}', '{r}')" for v, r in RULES)
    + r"""),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT p.page_id, r.rule, r.verdict
  FROM parts p JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
    AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))),
best AS (
  SELECT page_id, rule, verdict FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""
)
