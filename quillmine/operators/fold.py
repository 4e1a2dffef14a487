"""Ordered folds: steps that depend on all rows before them in their group.

Rows are partitioned by key and sorted, and a task streams them, so it holds the state of one group
and never the group itself.  A group with a third of all rows takes long, as the order demands, but
needs no more memory than a small one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, fresh: Callable[[], Callable[[tuple | None], Iterable[tuple]]]) -> DataFrame:
    """Fold the rows of each group in order.

    ``fresh()`` gives a step for a new group; it takes a row's ``columns`` as a tuple, or None at the
    group's end, and returns result rows, to which the keys are put in front.  Null keys form a group.
    """
    kinds = {f.name: f for f in df.schema.fields}
    target = T.StructType([kinds[k] for k in keys] + list(T.StructType.fromDDL(schema).fields))
    arrow = to_arrow_schema(target)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step, out = None, None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key = row[:width]
                if step is None or key != current:
                    if step is not None:
                        out += [(*current, *r) for r in step(None)]
                    current, step = key, fresh()
                out += [(*key, *r) for r in step(row[width:])]
            if len(out) > 5_000:
                yield flush()
                out = []
        if step is not None:
            out += [(*current, *r) for r in step(None)]
        if out:
            yield flush()

    rows = df.select(*keys, *columns, *(c for c in order if c not in columns and c not in keys))
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)
    return sorted_rows.mapInArrow(run, target)


def sliding_limit(limit: int, window_s: float):
    """At most ``limit`` accepted hits in a window; refused hits leave no trace.  Row: (id, seconds)."""

    def fresh():
        times: list[float] = []

        def step(row):
            if row is None:
                return ()
            rid, at = row
            while times and at - times[0] > window_s:
                times.pop(0)
            ok = len(times) < limit
            if ok:
                times.append(at)
            return ((rid, ok),)

        return step

    return fresh


def greedy_clusters(threshold: float):
    """Join the nearest centroid at ``threshold`` or more, else open a cluster.  Row: (id, vector)."""

    def fresh():
        bank = np.zeros((16, 1))
        sizes: list[int] = []

        def step(row):
            nonlocal bank
            if row is None:
                return ()
            rid, vector = row
            v = np.asarray(vector, np.float64)
            if bank.shape[1] != len(v):
                bank = np.zeros((16, len(v)))
            k = len(sizes)
            if k:
                near = bank[:k] @ v
                best = int(np.argmax(near))
                if near[best] >= threshold:
                    sizes[best] += 1
                    moved = bank[best] + (v - bank[best]) / sizes[best]
                    norm = np.linalg.norm(moved)
                    bank[best] = moved / norm if norm > 0 else moved
                    return ((rid, best),)
            if k == len(bank):
                bank = np.concatenate([bank, np.zeros_like(bank)])
            bank[k] = v
            sizes.append(1)
            return ((rid, k),)

        return step

    return fresh


def ballots(votes: DataFrame, topic: list[str]) -> DataFrame:
    """(topic, votes): votes (topic, ``stable_key``, ``label``, ``n``, ``first``) as claim_keys takes them; equal counts by the first question."""
    vote = F.struct((-F.col("n")).alias("n"), "first", F.col("stable_key").alias("old_key"), "label")
    return votes.groupBy(*topic).agg(F.sort_array(F.collect_list(vote)).alias("votes"))


def claim_keys():
    """Give each topic its most voted old key that no topic before it took.  Row: (topic, votes by falling count)."""

    def fresh():
        taken: set[str] = set()

        def step(row):
            if row is None:
                return ()
            topic, votes, own = row
            for vote in votes or ():
                if vote["old_key"] not in taken:
                    taken.add(vote["old_key"])
                    return ((topic, vote["old_key"], vote["label"]),)
            taken.add(own)
            return ((topic, own, None),)

        return step

    return fresh
