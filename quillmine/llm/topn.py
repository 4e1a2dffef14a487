"""Top N rows within every group, by statistics-guided skipping (problem 2).

A ``Clustered`` table is kept in a folder: range-partitioned and sorted by group and falling score, in
row groups of a given number of rows, so that the footers say which groups a row group holds and
their highest score.  A group of any size is spread over many files, because the score is part of
the range key.  ``append`` clusters a new batch beside the former ones; nothing is sorted again.

``top`` reads row groups in waves of falling maximum: first those that hold several groups and the
first of each group, then, group by group, the following ones, twice as many each time.  A row group
is skipped when its maximum is strictly below the N-th score that its group has so far (ties are
always read).  A task keeps N rows per group, so neither a task nor the driver ever holds a whole
group.

Defined results: rows with a null group column, or a null or NaN score, take no part; equal
scores follow the tie columns, nulls last; repeated rows are separate rows; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.session import drop, materialize, qualified, remove_path, work_path

#: A table is cut into some ``ROW_GROUPS`` row groups, of this many rows at least and at most.
ROW_GROUPS, LEAST_ROWS, MOST_ROWS = 2_000, 256, 1_000_000
KEPT_AT_ONCE = 50_000


def _open(uri: str):
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(files.open_input_file(path))


def _footers(names: list[str], score: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["file"]:
                meta = _open(uri).metadata
                at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
                for number in range(meta.num_row_groups):
                    group = meta.row_group(number)
                    stats = {n: group.column(at[n]).statistics for n in (*names, score)}
                    known = all(s is not None and s.has_min_max for s in stats.values())
                    single = known and all(stats[n].min == stats[n].max for n in names)
                    top = float(stats[score].max) if known else float("inf")
                    rows.append((uri, number, group.num_rows, [str(stats[n].min) for n in names] if single else None, top))
            yield pd.DataFrame(rows, columns=["file", "number", "n_rows", "only", "top"])

    return read


def _read_top(n: int, names: list[str], order: list[tuple[str, bool]], columns: list[str]):
    """Read the listed row groups and keep the first ``n`` rows of every group among them."""

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([c for c, _ in order], ascending=[up for _, up in order], na_position="last", kind="stable")
        return part.groupby(names, sort=False, dropna=False).head(n)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        held = 0
        for batch in batches:
            for uri, numbers in batch.groupby("file")["number"]:
                source = _open(uri)
                for number in numbers:
                    # each row group is cut down by itself; what is left is merged when enough has come together
                    kept.append(first(source.read_row_group(int(number), columns=columns).to_pandas()))
                    held += len(kept[-1])
                    if held > KEPT_AT_ONCE:
                        kept = [first(pd.concat(kept, ignore_index=True))]
                        held = 0
        if kept:
            yield first(pd.concat(kept, ignore_index=True))[columns]

    return read


class Clustered:
    """Rows clustered by group and falling score below a folder, named by a manifest."""

    def __init__(self, spark: SparkSession, path: str, state: dict) -> None:
        self.spark, self.path, self.state = spark, path, state
        #: Row groups that the last ``top`` read, and those it skipped.
        self.read = self.skipped = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Clustered:
        """The table below ``path`` as its manifest says, or a new one."""
        path = qualified(spark, path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        numbers = [int(f[9:-5]) for f in names if f.startswith("manifest-") and f.endswith(".json")]
        if not numbers:
            return cls(spark, path, {"version": 0, "runs": [], "schema": None, "names": []})
        return cls(spark, path, json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest-{max(numbers)}.json").collect())))

    def append(self, df: DataFrame, group: dict[str, Column], score: Column, ties: Sequence[tuple[str, Column, bool]], row_group_rows: int | None = None) -> None:
        """Cluster the rows of a batch; the columns must be those of the batches before."""
        names = list(group)
        rows = df.select(*(c.alias(k) for k, c in group.items()), score.cast("double").alias("score"), *(c.alias(t) for t, c, _ in ties))
        rows = rows.filter(F.col("score").isNotNull() & ~F.isnan("score"))
        for name in names:
            rows = rows.filter(F.col(name).isNotNull())
        row_group_rows = row_group_rows or min(MOST_ROWS, max(LEAST_ROWS, df.count() // ROW_GROUPS))
        by = [*(F.col(c).asc() for c in names), F.col("score").desc()]
        run = f"run-{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.row.count.limit", str(row_group_rows)).parquet(f"{self.path}/{run}")
        state = self.state | {"version": self.state["version"] + 1, "runs": [*self.state["runs"], run], "schema": rows.schema.json(), "names": names, "ties": [(t, up) for t, _, up in ties]}
        out_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']}.json")
        out = out_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(out_path, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state

    def top(self, n: int) -> DataFrame:
        """The first ``n`` rows of each group, with ``rank_no`` from 1."""
        from pyspark.sql.types import StructType

        spark, names = self.spark, self.state["names"]
        schema = StructType.fromJson(json.loads(self.state["schema"]))
        files = spark.read.schema(schema).parquet(*(f"{self.path}/{r}" for r in self.state["runs"])).inputFiles()
        self.read = self.skipped = 0
        if not files:
            return spark.createDataFrame([], schema).withColumn("rank_no", F.lit(0).cast("int"))
        order = [("score", False), *((t, up) for t, up in self.state["ties"])]
        read = _read_top(n, names, order, schema.names)
        listing = spark.createDataFrame(pd.DataFrame({"file": files}), "file string").repartition(min(len(files), 4096))
        footers = materialize(listing.mapInPandas(_footers(names, "score"), "file string, number int, n_rows long, only array<string>, top double"), "footers")
        place = F.row_number().over(Window.partitionBy("only").orderBy(F.desc("top"), "file", "number"))
        # row groups with several groups hold the beginning of one at least, so they are read at once
        mixed = footers.filter("only is null").withColumn("place", F.lit(0))
        stats = materialize(footers.filter("only is not null").withColumn("place", place).unionByName(mixed), "places")
        ranked = Window.partitionBy(*names).orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order))

        def wave(chosen: DataFrame, before: DataFrame | None) -> DataFrame:
            parts = chosen.select("file", "number").repartition("file", "number").mapInPandas(read, schema)
            parts = parts if before is None else parts.unionByName(before)
            return materialize(parts.withColumn("rank_no", F.row_number().over(ranked)).filter(F.col("rank_no") <= n).drop("rank_no"), "wave")

        chosen = stats.filter("place <= 1")
        self.read, total = chosen.count(), stats.count()
        best = wave(chosen, None)
        done, step = 1, 1
        while self.read < total:
            held = best.groupBy(*names).agg(F.min("score").alias("nth"), F.count("*").alias("held"))
            held = held.select(F.array(*(F.col(c).cast("string") for c in names)).alias("only"), F.when(F.col("held") >= n, F.col("nth")).alias("nth"))
            left = stats.filter(F.col("place") > done).join(held, "only", "left")
            left = materialize(left.filter(F.col("nth").isNull() | (F.col("top") >= F.col("nth"))).select("file", "number", "place"), "left")
            if left.isEmpty():
                break
            chosen = left.filter(F.col("place") <= done + step)
            self.read += chosen.count()
            former, best = best, wave(chosen, best)
            drop(former)
            done, step = done + step, step * 2
        self.skipped = total - self.read
        drop(footers)
        drop(stats)
        return best.withColumn("rank_no", F.row_number().over(ranked).cast("int"))

    def drop(self) -> None:
        """Remove the table."""
        remove_path(self.spark, self.path)


def top_n(df: DataFrame, group: dict[str, Column], score: Column, ties: Sequence[tuple[str, Column, bool]], n: int, row_group_rows: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group, by falling ``score`` and then ``ties`` (name, column, ascending).

    The last tie column should be a unique id; the result has the group columns, ``score``, the
    tie columns and ``rank_no`` from 1.
    """
    kept = Clustered.open(df.sparkSession, work_path(df.sparkSession, "clustered"))
    kept.append(df, group, score, ties, row_group_rows)
    out = kept.top(n)
    kept.drop()
    return out
