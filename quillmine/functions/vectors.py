"""Vectors as array columns: products, norms, means, and a deterministic text encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, members, centroid): mean of each group's vectors at length 1, as two partial aggregates."""
    long = df.select(F.col(key).alias("key"), F.posexplode(vector).alias("dim", "x"))
    means = long.groupBy("key", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("members"))
    packed = means.groupBy("key").agg(F.max("members").alias("members"), F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("v"))
    return packed.select(F.col("key").alias(key), "members", unit(F.transform("v", lambda s: s["m"])).alias("centroid"))


def encoder(dims: int = 64):
    """A pandas UDF that encodes texts by signed hashing of words and letter triples, at length 1.

    Deterministic and without a model; any UDF of the same signature can stand in for it.
    """
    import zlib

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for text in batch:
                v = np.zeros(dims, np.float32)
                words = (text or "").lower().split()
                for w in words:
                    for part in (w, *(f"^{w}$"[i : i + 3] for i in range(len(w)))):
                        h = zlib.crc32(part.encode())
                        v[h % dims] += 1.0 if h & 0x10000 else -1.0
                norm = float(np.linalg.norm(v))
                out.append(v / norm if norm > 1e-12 else v)
            yield pd.Series(out)

    return encode
