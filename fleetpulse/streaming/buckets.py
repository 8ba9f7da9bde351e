"""Keyed state for very many small keys, a row of the state store for each bucket of them.

Spark hands a group to Python at a price of milliseconds, whatever it holds. So keys are dealt to a fixed number of
buckets by their hash: a micro-batch costs that price once per bucket it touches, and little per key and row. What
it writes follows the buckets it touches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed for the life of a checkpoint: another number would look for a key in another bucket.
BUCKETS = 4096

# (key, its new rows, what is known of it or None, the watermark in milliseconds) ->
# (what is known of it now or None, when to look again or None, output rows without the key).
Judge = Callable[[tuple, list[tuple], Any, int], tuple[Any, int | None, list[tuple]]]


def judged(key: list[str], values: list[str], judge: Judge, output: dict[str, str], timed: bool):
    """State function of one bucket: ``judge`` for every key that has rows or whose time has come."""
    names = [*key, *values]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lives = {tuple(k): (life, wake) for k, life, wake in json.loads(state.get[0])} if state.exists else {}
        watermark = state.getCurrentWatermarkMs() if timed else 0
        rows: dict[tuple, list[tuple]] = {k: [] for k, (_, wake) in lives.items() if wake is not None and wake <= watermark}
        for frame in frames:
            for row in zip(*(frame[c].tolist() for c in names)):
                rows.setdefault(row[: len(key)], []).append(row[len(key) :])
        told = []
        for k, new in rows.items():
            life, wake, out = judge(k, new, lives.pop(k, (None, None))[0], watermark)
            if life is not None:
                lives[k] = (life, wake)
            told += [(*k, *o) for o in out]
        if lives:
            state.update((json.dumps([(k, *v) for k, v in lives.items()], separators=(",", ":")),))
            wakes = [wake for _, wake in lives.values() if wake is not None]
            if wakes:
                state.setTimeoutTimestamp(max(min(wakes), watermark + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=list(output)).astype(output)

    return run


_KINDS = {"string": "object", "long": "Int64", "double": "float64", "boolean": "object"}


def by_bucket(
    rows: DataFrame, key: list[str], values: list[str], judge: Judge, output: str, timed: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The ``output`` columns, the key's first, that ``judge`` tells of a stream's rows.

    ``key`` has strings only, without NULLs. What a judge knows of a key is kept as JSON. With a ``timed`` column, which has
    the watermark, it is asked again once the watermark has reached the time that it named.
    """
    kinds = {c.split()[0]: _KINDS[c.split()[1]] for c in output.split(", ")}
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")
    placed = rows.select(bucket, *key, *values, *([timed] if timed else [])).groupBy("bucket")
    wait = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return placed.applyInPandasWithState(judged(key, values, judge, kinds, timed is not None), output, "lives string", "append", wait)
