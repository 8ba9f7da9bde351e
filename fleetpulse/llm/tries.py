"""Prefix trie of conversations: double-array tries of shards, joined by the aggregates of the nodes above them.

The turns of a conversation are digests of 128 bits, in rows of up to ``BLOCK`` turns. What
follows one prefix at a block's start is a trie of its own, so a conversation of any length is many
rows. Such a trie is cut into shards by the first turns; a prefix that many turns follow is cut
further down. A shard is packed into BASE and CHECK arrays and walked; the nodes above
the cuts, which shards share, get their figures from the sums of the shards below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import WORD, join_unique, stored

BLOCK = 512
# Turns a shard is meant to hold, and turns behind one prefix from which on it is cut further down.
SHARD_TURNS = 1024
HOT_TURNS = 1024
# Conversation c begins with the turns of c - c % FAMILY, up to a number below HEADS.
FAMILY, HEADS = 20, 4
# Ids that are hashed as one piece.
PIECE = 4096
ROOT = "0" * 32
_DIGITS = 32
_NO_CONV = np.iinfo(np.int64).max


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, _DIGITS)


def turn_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, words): what a turn says as a digest, and the words of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = _short(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    known = conversations.where(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within a conversation's rows of one partition, which come in order."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv, n = np.asarray(batch.column("conv_id")), batch.num_rows
        if not n:
            continue
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        if conv[0] == last:
            place[: begins[1] if len(begins) > 1 else n] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        columns = [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(place), batch.column("key"), batch.column("words")]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "pos", "key", "words"])


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) of ``turn_keys``: places from 0 by turn, NULL first, then by key.

    Rows are dealt by ranges of all three, so a long conversation is counted by many tasks. A partition has at
    most one conversation that began before it; where it goes on there is a row, and those are broadcast.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    dealt = stored(turns, "trie-turns").repartitionByRange(*order).sortWithinPartitions(*order)
    local = stored(dealt.mapInArrow(_numbered, "conv_id long, part int, pos long, key string, words long"), "trie-places")
    sizes = local.groupBy("conv_id", "part").agg((F.max("pos") + 1).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = stored(sizes.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before > 0"), "trie-across")
    met = local.join(F.broadcast(across), ["conv_id", "part"], "left")
    return met.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of another: their turns as ``positions`` has them, and (conv_id, length) of all.

    Conversation c is the first h turns of c - c % family, all if it has fewer and none if there is no such
    conversation, then its own turns after its first h; h is crc32 of the decimal c, modulo ``heads``.
    """
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", own_head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    own = stored(own, "trie-sizes")
    met = own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    lead = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = stored(met.select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    taken = convs.where("lead > 0").select("conv_id", "base", "h").join(first, "base").where("pos < h").select("conv_id", "pos", "key", "words")
    short = convs.where("lead < h").select("conv_id", (F.col("h") - F.col("lead")).alias("less"))
    rest = join_unique(turns.withColumn("h", own_head).where("pos >= h"), short, ["conv_id"], "left")
    kept = rest.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "key", "words")
    return taken.unionByName(kept), convs.select("conv_id", "length")


def _after(prefix: Column, keys: Column) -> Column:
    """Digest of the node that ``keys`` lead to from the node of a block's start."""
    return F.when(F.length(keys) == 0, prefix).otherwise(_short(F.concat(prefix, _short(keys))))


def _leading(n: Column) -> Column:
    return F.substring(F.col("keys"), F.lit(1), (n * _DIGITS).cast("int"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the prefix before each block, from the digests of a conversation's blocks in order."""
    short = lambda s: hashlib.sha256(s.encode()).hexdigest()[:_DIGITS]
    last, prefix = None, ROOT
    for batch in batches:
        told = []
        for conv, block in zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist()):
            if conv != last:
                last, prefix = conv, ROOT
            told.append(prefix)
            prefix = short(prefix + block)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("level"), pa.array(told, pa.string())], ["conv_id", "level", "prefix"])


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, level, prefix, keys, words, n): the turns in rows of ``block`` from depth level * block on.

    A conversation's last row has less than ``block`` turns, none if need be.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "key", "words")))
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / block).cast("long").alias("level")).agg(ordered.alias("t"))
    full = cut.select("conv_id", "level", F.array_join("t.key", "").alias("keys"), F.col("t.words").alias("words"), F.size("t").alias("n"))
    none = convs.where(F.col("length") % block == 0).select(
        "conv_id", F.floor(F.col("length") / block).cast("long").alias("level"), F.lit("").alias("keys"), F.array().cast("array<long>").alias("words"), F.lit(0).alias("n")
    )
    rows = stored(full.unionByName(none), "trie-blocks")
    above = rows.where("level = 0").withColumn("prefix", F.lit(ROOT))
    if rows.where("level > 0").isEmpty():
        return above
    long = rows.join(convs.where(F.col("length") >= block).select("conv_id"), "conv_id", "left_semi")
    chain = long.select("conv_id", "level", _short(F.col("keys")).alias("block")).repartition("conv_id").sortWithinPartitions("conv_id", "level")
    prefixes = chain.mapInArrow(_chained, "conv_id long, level long, prefix string").where("level > 0")
    return stored(above.unionByName(rows.where("level > 0").join(prefixes, ["conv_id", "level"])), "trie-prefixes")


@dataclass
class DoubleArray:
    """A trie over whole numbers: the child of slot s by symbol c is slot t = base[s] + c, if check[t] = s. Slot 0 is the root."""

    base: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> DoubleArray:
        """Packs sequences of dense symbols: large families of children first, each to the first place where all of it fits."""
        children: list[list[int]] = [[]]
        symbols, path, before = [-1], [0], np.empty(0, np.int64)
        for s in sorted(sequences, key=lambda s: s.tolist()):
            shared = min(len(s), len(before))
            differ = np.flatnonzero(s[:shared] != before[:shared])
            del path[(int(differ[0]) if len(differ) else shared) + 1 :]
            for c in s[len(path) - 1 :].tolist():
                children[path[-1]].append(len(symbols))
                path.append(len(symbols))
                symbols.append(c)
                children.append([])
            before = s
        symbol = np.array(symbols, np.int64)
        slot, base = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        free = np.ones(2 * len(symbols) + int(symbol.max(initial=0)) + 2, bool)
        free[0] = False
        lowest = 1
        for node in sorted((k for k, c in enumerate(children) if c), key=lambda k: -len(children[k])):
            own = symbol[children[node]]
            least = own.min()
            at = lowest
            while True:
                at += int(free[at:].argmax())
                places = at + own - least
                if places.max() >= len(free):
                    free = np.concatenate([free, np.ones(len(free) + int(places.max()), bool)])
                if free[places].all():
                    break
                at += 1
            free[places] = False
            slot[children[node]] = places
            base[node] = at - least
            lowest += int(free[lowest:].argmax())
        end = int(slot.max()) + 1
        out = cls(np.zeros(end, np.int64), np.full(end, -1, np.int64))
        out.base[slot] = base
        for node, own in enumerate(children):
            out.check[slot[own]] = slot[node]
        return out

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of slots by symbols; -1 where there is none."""
        at = self.base[slots] + symbols
        inside = (at >= 0) & (at < len(self.check)) & (slots >= 0)
        return np.where(inside & (self.check[np.where(inside, at, 0)] == slots), at, -1)


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end string"
_SHARD = f"{NODE}, prefix string, level long, cut int, keys string, words array<long>"


def _shard(rows: pa.Table, block: int) -> pa.Table:
    """All nodes of a shard below its cuts, with the figures of their subtrees."""
    rows = rows.take(pa.array(np.arange(rows.num_rows))).combine_chunks()
    column = lambda name: np.asarray(rows.column(name))
    n, cut, level, conv, members = (column(c).astype(np.int64) for c in ("n", "cut", "level", "conv_id", "members"))
    flat = np.frombuffer("".join(rows.column("keys").to_pylist()).encode(), f"S{_DIGITS}")
    words = np.concatenate([np.empty(0, np.int64), *[np.asarray(w.values, np.int64) for w in rows.column("words").combine_chunks()]])
    ends = np.cumsum(n)
    # Dense numbers: first the cut prefixes, which stand for the turns up to them, then the turns.
    groups, group = np.unique(rows.column("group").to_pylist(), return_inverse=True)
    below = np.repeat(cut, n) <= np.arange(len(flat)) - np.repeat(ends - n, n)
    turn = np.zeros(len(flat), np.int64)
    turn[below] = np.unique(flat[below], return_inverse=True)[1] + len(groups)
    sequences = [np.concatenate([[group[i]], turn[ends[i] - n[i] + cut[i] : ends[i]]]) for i in range(len(n))]
    trie = DoubleArray.of(sequences)

    size = len(trie.check)
    n_convs, least, depth, word = np.zeros(size, np.int64), np.full(size, _NO_CONV), np.zeros(size, np.int64), np.zeros(size, np.int64)
    slots, at_depth = np.zeros(len(n), np.int64), []
    for j in range(int((n - cut).max(initial=-1)) + 1):
        on = np.flatnonzero(n - cut >= j)
        slots[on] = trie.step(slots[on], group[on] if j == 0 else turn[ends[on] - n[on] + cut[on] + j - 1])
        reached = slots[on]
        np.add.at(n_convs, reached, members[on])
        np.minimum.at(least, reached, conv[on])
        depth[reached] = level[on] * block + cut[on] + j
        word[reached] = words[ends[on] - n[on] + cut[on] + j - 1]
        at_depth.append(np.unique(reached))
    nodes = np.flatnonzero(n_convs)
    n_children = np.bincount(trie.check[nodes], minlength=size)
    n_children[slots] += column("more_children")
    saved, leaves = (n_convs - 1) * word, np.zeros(size, np.int64)
    leaves[nodes] = n_children[nodes] == 0
    saved[slots] += column("more_saved")
    leaves[slots] += column("more_leaves")
    for reached in reversed(at_depth[1:]):
        np.add.at(saved, trie.check[reached], saved[reached])
        np.add.at(leaves, trie.check[reached], leaves[reached])

    end = np.full(size, None, object)
    end[slots] = rows.column("next").to_pylist()
    top = trie.check[nodes] == 0
    one = np.zeros(size, np.int64)
    one[trie.step(np.zeros(len(n), np.int64), group)] = np.arange(len(n))
    source = [int(k) if t else None for k, t in zip(one[nodes], top)]
    own = lambda name: rows.column(name).to_pylist()
    prefixes, keys, lists = own("prefix"), own("keys"), own("words")
    told = lambda f: [None if k is None else f(k) for k in source]
    return pa.Table.from_arrays(
        [
            pa.array(least[nodes]),
            pa.array(depth[nodes]),
            pa.array(least[trie.check[nodes]], mask=top),
            *[pa.array(x[nodes]) for x in (n_convs, n_children, leaves, saved)],
            pa.array(end[nodes].tolist(), pa.string()),
            pa.array(told(lambda k: prefixes[k]), pa.string()),
            pa.array(told(lambda k: int(level[k])), pa.int64()),
            pa.array(told(lambda k: int(cut[k])), pa.int32()),
            pa.array(told(lambda k: keys[k][: int(cut[k]) * _DIGITS]), pa.string()),
            pa.array(told(lambda k: lists[k][: int(cut[k])]), pa.list_(pa.int64())),
        ],
        names=[c.split()[0] for c in _SHARD.split(", ")],
    )


def _cut(segments: DataFrame, block: int, hot_turns: int) -> DataFrame:
    """Adds ``cut``, how many turns name the shard: 1, or twice as many while more than ``hot_turns`` turns follow them."""
    found, k = segments.withColumn("cut", F.lit(1)), 1
    while k < block:
        group = _after(F.col("prefix"), _leading(F.lit(k)))
        here = (F.col("cut") == k) & (F.col("n") >= k)
        sums = found.where(here).groupBy(group.alias("group")).agg(F.count("*").alias("rows"), F.sum("n").alias("turns"))
        hot = stored(sums.where((F.col("rows") > 1) & (F.col("turns") > hot_turns)).select("group", F.lit(True).alias("hot")), "trie-hot")
        if hot.isEmpty():
            break
        met = join_unique(found.withColumn("group", group), hot, ["group"], "left")
        deeper = F.when(F.col("hot"), F.lit(2 * k)).otherwise(F.col("cut"))
        found = met.withColumn("cut", deeper.cast("int")).drop("group", "hot")
        k *= 2
    return found


def _upper_nodes(visits: DataFrame) -> DataFrame:
    """The nodes above the cuts: (prefix, level, keys, conv_id, n_convs, n_children, n_leaves, saved_tokens).

    A visit has the turns ``keys`` below ``prefix`` and counts for all nodes before ``upto`` of them.
    """
    steps = F.explode(F.sequence(F.lit(0), F.col("upto") - 1))
    seen = visits.withColumn("j", steps).select(
        "prefix",
        "level",
        _leading(F.col("j")).alias("keys"),
        F.when(F.col("j") > 0, F.get("words", F.col("j") - 1)).otherwise(F.lit(0)).alias("word"),
        (F.col("inner") & (F.col("j") == F.col("upto") - 1)).cast("long").alias("child"),
        *["conv_id", "n_convs", "n_leaves", "saved_tokens"],
    )
    sums = [F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(a) for c, a in (("n_convs", "n_convs"), ("child", "n_children"), ("n_leaves", "n_leaves"), ("saved_tokens", "saved_tokens"))]]
    upper = stored(seen.groupBy("prefix", "level", "keys", "word").agg(*sums), "trie-upper")
    j = F.length("keys") / _DIGITS
    inner = upper.where(F.length("keys") > 0)
    kids = inner.groupBy("prefix", _leading(j - 1).alias("keys")).agg(F.count("*").alias("kids"))
    counted = join_unique(upper, kids, ["prefix", "keys"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    # What an upper node has of its own counts for itself and for those above it.
    leaf = (F.col("n_children") == 0).cast("long")
    counted = stored(counted.withColumns({"own": (F.col("n_convs") - 1) * F.col("word"), "leaf": leaf}), "trie-counted")
    spread = counted.where(F.length("keys") > 0).withColumn("i", F.explode(F.sequence(F.lit(0), j.cast("int"))))
    added = spread.groupBy("prefix", _leading(F.col("i")).alias("keys")).agg(F.sum("own").alias("more"), F.sum("leaf").alias("more_leaves"))
    whole = join_unique(counted, added, ["prefix", "keys"], "left")
    leaves = F.col("n_leaves") + F.coalesce("more_leaves", F.when(F.length("keys") == 0, F.col("leaf")))
    saved = F.col("saved_tokens") + F.coalesce("more", F.lit(0))
    return stored(whole.select("prefix", "level", "keys", "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens")), "trie-nodes-above")


def _tries(segments: DataFrame, block: int, shard_turns: int, hot_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the cuts, and those above (``_upper_nodes``), of distinct segments."""
    turns = segments.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    cut = stored(_cut(segments, block, hot_turns), "trie-cut")
    group = _after(F.col("prefix"), _leading(F.col("cut")))
    inside = cut.where("n >= cut").withColumn("group", group)
    dealt = inside.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards)))
    below = stored(dealt.groupBy("shard").applyInArrow(lambda rows: _shard(rows, block), _SHARD), "trie-nodes")
    tops = below.where("prefix IS NOT NULL")
    visits = tops.select("prefix", "level", "keys", "words", F.col("cut").alias("upto"), "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(True).alias("inner"))
    zero = F.lit(0).cast("long")
    ending = cut.where("n < cut").select(
        "prefix", "level", "keys", "words", (F.col("n") + 1).alias("upto"), "conv_id",
        F.col("members").alias("n_convs"), zero.alias("n_leaves"), zero.alias("saved_tokens"), F.lit(False).alias("inner"),
    )
    return below, _upper_nodes(visits.unionByName(ending))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each end, joined in pieces of up to ``PIECE``; the rows come in order."""
    end, held, told = None, [], []

    def close():
        if held:
            told.append((end, held[0], ",".join(map(str, held))))
            held.clear()

    for batch in batches:
        for e, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
            if e != end or len(held) == PIECE:
                close()
                end = e
            held.append(conv)
        yield _three(told)
        told.clear()
    close()
    yield _three(told)


def _three(told: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], kinds[i]) for i in range(3)], ["end", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each end, which come in order."""
    end, state = None, None
    for batch in batches:
        told = []
        for e, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if e == end:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    told.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256(ids.encode())
        yield _two(told)
    yield _two([(end, state.hexdigest())] if state is not None else [])


def _two(told: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], pa.string()) for i in range(2)], ["end", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, conv_id): the ids that end at a node, joined in order and hashed.

    The ids of an end that many conversations share are put in order and joined by many tasks; one task
    then reads the pieces, a row for thousands of ids, and keeps the state of the hash only.
    """
    sorted_ = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = stored(sorted_.mapInArrow(_pieces, "end string, first long, ids string"), "trie-pieces")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_hashed, "end string, ends_sha256 string")


def _carried(rows: DataFrame, upper: DataFrame, block: int) -> DataFrame:
    """(next, more_saved, more_leaves): what follows the end of a full block, in all later blocks.

    ``upper`` has the tries of later blocks; each counts once, for the conversation with the least id in it.
    """
    owned = upper.where("keys = ''").select("conv_id", "level", "prefix", "n_children", "n_leaves", "saved_tokens")
    below = owned.withColumn("n_leaves", F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(F.lit(0)))
    met = rows.join(below.select("conv_id", "level", "n_leaves", "saved_tokens"), ["conv_id", "level"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(later), F.lit(0)) for c in ("saved_tokens", "n_leaves")}
    full = met.withColumns(sums).where(F.col("n") == block).select("next", *sums)
    return full.groupBy("next").agg(F.sum("saved_tokens").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, shard_turns: int = SHARD_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv_id, pos, key, words) of ``convs`` (conv_id, length).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.
    ``conv_id`` is the least of the conversations that begin with the node's turns; with ``depth`` it names the node.

    * Copies of a conversation are one sequence that counts its members, whatever their number.
    * A prefix shared by more than ``hot_turns`` turns is cut further down, by 2, 4, 8, ... turns.
    * A conversation of more than ``block`` turns is several rows; what is below a block's end is
      added to it from the tries of the later blocks.
    * Conversations without turns are members of the root. Without conversations there is no node.
    """
    rows = blocks(turns, convs, block).withColumn("next", _after(F.col("prefix"), F.col("keys")))
    own = rows.groupBy("prefix", "level", "keys", "words", "n", "next").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id"))
    segments = stored(own, "trie-segments")
    nothing = {c: F.lit(0).cast("long") for c in ("more_saved", "more_leaves")}
    if segments.where("level > 0").isEmpty():
        whole = segments.withColumns(nothing | {"more_children": F.lit(0).cast("long")})
    else:
        begun = segments.where("level > 0 AND n > 0").select(F.col("prefix").alias("next"), _leading(F.lit(1)).alias("first")).distinct()
        children = begun.groupBy("next").agg(F.count("*").alias("more_children"))
        met = join_unique(segments, stored(children, "trie-begun"), ["next"], "left").withColumn("more_children", F.coalesce("more_children", F.lit(0)))
        _, later = _tries(met.where("level > 0").withColumns(nothing), block, shard_turns, hot_turns)
        long = rows.join(convs.where(F.col("length") >= block).select("conv_id"), "conv_id", "left_semi").select("conv_id", "level", "n", "next")
        more = join_unique(met, stored(_carried(long, later, block), "trie-carried"), ["next"], "left")
        whole = more.withColumns({c: F.coalesce(c, F.lit(0)) for c in nothing})
    below, upper = _tries(whole, block, shard_turns, hot_turns)

    parents = upper.select("prefix", "keys", F.col("conv_id").alias("above"))
    tops = below.where("prefix IS NOT NULL")
    linked = join_unique(tops.withColumn("keys", _leading(F.col("cut") - 1)), parents, ["prefix", "keys"])
    columns = [c.split()[0] for c in NODE.split(", ")]
    linked = linked.withColumn("parent_conv_id", F.col("above")).select(*columns)
    j = (F.length("keys") / _DIGITS).cast("long")
    # The start of a later block is the end of the block before, which has its row.
    own_rows = upper.where((F.col("level") == 0) | (F.length("keys") > 0)).withColumns({"depth": F.col("level") * block + j, "end": _after(F.col("prefix"), F.col("keys"))})
    parent_keys = F.when(j > 0, _leading(j - 1))
    above = join_unique(own_rows.withColumn("keys", parent_keys), parents, ["prefix", "keys"], "left")
    nodes = below.where("prefix IS NULL").select(*columns).unionByName(linked).unionByName(above.withColumn("parent_conv_id", F.col("above")).select(*columns))
    hashes = stored(end_hashes(rows.where(F.col("n") < block).select(F.col("next").alias("end"), "conv_id")), "trie-ends")
    ending = join_unique(nodes.where(F.col("end").isNotNull()), hashes, ["end"], "left")
    passing = nodes.where(F.col("end").isNull()).withColumn("ends_sha256", F.lit(None).cast("string"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return ending.unionByName(passing, allowMissingColumns=True).withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("end")


def conversation_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, **sizes: int) -> DataFrame:
    """``trie`` of the rebuilt conversations (``rebuilt``) of a table with ``conv_id``, ``turn``, ``role``, ``text``.

    * Turns are in order of ``turn``, NULL first; equal ones in order of the digest of what they say. Repeated
      rows are turns of their own. A NULL role or text is empty.
    * Rows without a conv_id belong to no conversation and are left out. Other columns are ignored.
    * Turns are told apart by 128 bits of SHA-256 over role and text. An empty table gives no rows.
    """
    return trie(*rebuilt(stored(positions(turn_keys(conversations)), "trie-positions"), family, heads), **sizes)


_WORDS_SQL = r"[^\x20\x09-\x0D]+"
# crc32 of an id's decimal digits, bit by bit.
_CRC_SQL = """xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), lambda c, b:
  list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""
ORACLE_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (
  SELECT conv_id, turn, len(regexp_extract_all(text, '{_WORDS_SQL}')) AS words, sha256(strlen(role) || ':' || role || text) AS key FROM said),
turns AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM keyed),
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC_SQL} % {HEADS} AS h FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, key, words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, key, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, coalesce(list({{'key': key, 'words': words}} ORDER BY part, pos) FILTER (key IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT list_slice(path, 1, depth) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
children AS (SELECT list_slice(node, 1, depth - 1) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
figures AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * n.node[depth].words ELSE 0 END AS own
  FROM nodes n LEFT JOIN children c ON n.node = c.node),
subtrees AS (
  SELECT list_slice(node, 1, i) AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS i FROM figures) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM figures f JOIN subtrees s ON s.node = f.node LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.node = list_slice(f.node, 1, f.depth - 1)
"""
