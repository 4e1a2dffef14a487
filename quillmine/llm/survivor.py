"""Best representative of each duplicate group, field by field (problem 3).

Fields are unpivoted to long rows (key, field, value).  Each row votes for its normalised value
with trust times a recency decay; votes are summed per normalised value, the winner of each field
is taken with ``max_by``, and the fields are pivoted back.  Both steps are partial aggregates, so a
key that holds a third of all rows is reduced before it is shuffled.

Defined results: rows with a null key take no part; a null or unusable value casts no vote; a null
date weighs nothing but the value still stands against no value at all; equal votes follow the
field's order expressions and then the smallest id; a field without a usable value has null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """How one field is chosen: ``prefer`` lists further criteria (larger wins) after the votes."""

    name: str
    value: Column
    usable: Column
    normalised: Column
    trust: Column
    prefer: Sequence[Column] = field(default_factory=tuple)


def survivors(df: DataFrame, key: Column, row_id: Column, year: Column, fields: Sequence[Field], decay: float = 0.5, reference_year: int = 2025, least_rows: int = 2) -> DataFrame:
    """One row per key with at least ``least_rows`` rows: for each field the winning value and the id it came from.

    Result columns: ``key``, ``copies``, then ``<name>`` and ``<name>_id`` per field.
    """
    longest = max(len(f.prefer) for f in fields)
    unpivoted = F.array(
        *(
            F.struct(
                F.lit(f.name).alias("field"),
                f.value.cast("string").alias("value"),
                F.coalesce(f.usable, F.lit(False)).alias("usable"),
                f.normalised.cast("string").alias("norm"),
                (f.trust.cast("double") * F.coalesce(F.pow(F.lit(decay), F.lit(reference_year) - year), F.lit(0.0))).alias("vote"),
                *((f.prefer[i] if i < len(f.prefer) else F.lit(None)).cast("long").alias(f"prefer{i}") for i in range(longest)),
            )
            for f in fields
        )
    )
    rows = df.select(key.alias("key"), row_id.cast("long").alias("id"), F.explode(unpivoted).alias("f")).filter(F.col("key").isNotNull()).select("key", "id", "f.*")
    order = F.struct(*(F.coalesce(F.col(f"prefer{i}"), F.lit(-(2**62))) for i in range(longest)), -F.col("id"))
    usable = F.col("usable") & F.col("value").isNotNull()
    voted = rows.groupBy("key", "field", F.when(usable, F.col("norm")).alias("norm")).agg(
        F.count("*").alias("n"),
        # rounded, as the order in which doubles are added is not fixed
        F.round(F.sum(F.when(usable, F.coalesce("vote", F.lit(0.0)))), 9).alias("votes"),
        F.max(F.when(usable, order)).alias("best"),
        F.max_by(F.when(usable, F.struct("value", "id")), F.when(usable, order)).alias("winner"),
    )
    stands = F.when(F.col("winner").isNotNull(), F.struct("votes", "best"))
    chosen = voted.groupBy("key").agg(
        F.sum(F.when(F.col("field") == fields[0].name, F.col("n"))).alias("copies"),
        *(F.max_by(F.when(F.col("field") == f.name, F.col("winner")), F.when(F.col("field") == f.name, stands)).alias(f"w_{i}") for i, f in enumerate(fields)),
    )
    chosen = chosen.filter(F.col("copies") >= least_rows)
    return chosen.select("key", "copies", *(c for i, f in enumerate(fields) for c in (F.col(f"w_{i}.value").alias(f.name), F.col(f"w_{i}.id").alias(f"{f.name}_id"))))
