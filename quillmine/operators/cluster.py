"""Questions grouped around centroids: an ordered greedy pass, then one reassignment.

The first pass depends on order and streams a group's rows, holding only its centroids.  The second is
a map: blocks of rows are multiplied with their group's centroids, and a group of any size is spread
over ``SPREAD`` tasks.  No pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmine.functions.vectors import unit
from quillmine.operators.fold import greedy_clusters, ordered_fold
from quillmine.session import materialize

SPREAD, BLOCK = 16, 4_096


def nearest_centres(rows: DataFrame, centres: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, id, cluster): the nearest centre of each row's group, the first on ties, or null below ``threshold``.

    ``rows``: keys, ``id``, ``vector``; ``centres``: keys, ``cluster``, ``vector``.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    held = centres.select(*keys, spread.alias("part"), F.lit(False).alias("member"), F.col("cluster").cast("long").alias("id"), "vector")
    asked = rows.select(*keys, F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("part"), F.lit(True).alias("member"), "id", "vector")
    both = held.unionByName(asked).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "member", "id")
    kinds = {f.name: f for f in both.schema.fields}
    target = T.StructType([*(kinds[k] for k in keys), T.StructField("id", T.LongType()), T.StructField("cluster", T.IntegerType())])
    arrow, width = to_arrow_schema(target), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, numbers, bank = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(i).to_pylist() for i in range(width + 2)), strict=True))
            ids = batch.column(width + 2).to_numpy()
            ends = batch.column(width + 3).offsets.to_numpy()
            flat = batch.column(width + 3).values.to_numpy(zero_copy_only=False).astype(np.float64)
            low = 0
            while low < len(names):
                high = low
                while high < len(names) and high - low < BLOCK and names[high] == names[low]:
                    high += 1
                block = flat[ends[low] : ends[high]].reshape(high - low, -1)
                if names[low][:-1] != current:
                    current, numbers, bank = names[low][:-1], [], []
                if not names[low][-1]:
                    numbers += ids[low:high].tolist()
                    bank.append(block)
                else:
                    best = np.full(high - low, -1)
                    if numbers:
                        bank = [np.concatenate(bank)]
                        near = block @ bank[0].T
                        at = near.argmax(axis=1)
                        best = np.where(near[np.arange(len(at)), at] >= threshold, np.asarray(numbers)[at], -1)
                    found = pa.array(best, pa.int32(), mask=best < 0)
                    yield pa.RecordBatch.from_arrays([*(pa.array([n[k] for n in names[low:high]], arrow.field(k).type) for k in range(width)), pa.array(ids[low:high]), found], schema=arrow)
                low = high

    return both.select(*keys, "part", "member", "id", "vector").mapInArrow(run, target)


def clusters(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, id, cluster) of rows (keys, ``id``, ``vector``), clustered within each group of keys in order of id."""
    rows = rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    first = materialize(ordered_fold(rows, keys, ["id"], ["id", "vector"], "id long, cluster int", greedy_clusters(threshold)), "greedy")
    long = first.join(rows, [*keys, "id"]).select(*keys, "cluster", F.posexplode("vector").alias("dim", "x"))
    means = long.groupBy(*keys, "cluster", "dim").agg(F.avg("x").alias("m"))
    centres = means.groupBy(*keys, "cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    centres = materialize(centres.select(*keys, "cluster", unit(F.transform("v", lambda s: s["m"])).alias("vector")), "centres")
    found = materialize(nearest_centres(rows, centres, keys, threshold), "nearest")
    # a row that is near to no centre is a cluster of its own, numbered after the others in order of id
    many = centres.groupBy(*keys).agg(F.count("*").cast("int").alias("many"))
    alone = found.filter("cluster is null").join(many, keys)
    alone = alone.select(*keys, "id", (F.col("many") - 1 + F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).cast("int").alias("cluster"))
    return found.filter("cluster is not null").select(*keys, "id", "cluster").unionByName(alone)
