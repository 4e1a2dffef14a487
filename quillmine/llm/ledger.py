"""Duplicates hidden by formatting, by an incremental ledger of canonical keys (problem 6).

The ledger is a table of (key, copies, first id), split into buckets by key.  A batch is reduced
to one row per key, the buckets it touches are full-outer-joined with it, counts are added and the
earliest representative is kept; untouched buckets stay as they are.  Each step writes new bucket
versions and only then names them in a numbered manifest, so a lost executor or driver leaves the
former version valid, and another process opens the ledger where this one left it.

Defined results: null texts have no key and take no part; texts without letters or digits share
the key of the empty cell list; repeated rows count as copies; an empty batch changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import qualified, remove_path, work_path

SCHEMA = "key binary, copies long, first_id long"


def canonical_key(text: Column) -> Column:
    """Key of a text: its cells between ``|``, lower case, letters and digits only, in sorted order."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}|]+", "")
    cells = F.array_join(F.array_sort(F.filter(F.split(plain, r"\|"), lambda c: c != "")), "|")
    return F.unhex(F.md5(F.when(F.contains(plain, F.lit("|")), cells).otherwise(plain)))


class Ledger:
    """Bucketed counts of canonical keys below a folder; ``add`` takes a batch with columns ``key`` and ``id``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, state: dict | None = None) -> None:
        self.spark, self.path = spark, path
        self.state = state or {"version": 0, "buckets": buckets, "at": {}}

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int = 16) -> Ledger:
        """The ledger below ``path`` as its last manifest says, or a new one."""
        path = qualified(spark, path)
        numbers = [int(f[9:-5]) for f in _names(spark, path) if f.startswith("manifest-") and f.endswith(".json")]
        if not numbers:
            return cls(spark, path, buckets)
        lines = spark.read.text(f"{path}/manifest-{max(numbers)}.json").collect()
        return cls(spark, path, state=json.loads("".join(r[0] for r in lines)))

    def _read(self, buckets: list[int]) -> DataFrame:
        # one folder holds many buckets of one version; only the wanted ones are listed
        listed = [f"{self.path}/{run}/bucket={b}" for b, run in self.state["at"].items() if int(b) in set(buckets)]
        return self.spark.read.schema(SCHEMA).parquet(*listed) if listed else self.spark.createDataFrame([], SCHEMA)

    def table(self) -> DataFrame:
        """The whole ledger."""
        return self._read(list(range(self.state["buckets"])))

    def add(self, batch: DataFrame) -> None:
        """Merge a batch into the buckets that it touches."""
        new = batch.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).alias("low"))
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.state["buckets"])).cast("int")
        run = f"run-{self.state['version'] + 1}-{uuid.uuid4().hex[:8]}"
        if not self.state["at"]:
            written = new.select("key", F.col("n").alias("copies"), F.col("low").alias("first_id"), bucket.alias("bucket"))
        else:
            part = f"{self.path}/batch-{uuid.uuid4().hex[:8]}"
            new.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(part)
            touched = [int(x.split("=")[1]) for x in _names(self.spark, part) if x.startswith("bucket=")]
            if not touched:
                remove_path(self.spark, part)
                return
            new = self.spark.read.schema("key binary, n long, low long").parquet(*(f"{part}/bucket={b}" for b in touched))
            merged = self._read(touched).join(new, "key", "full_outer")
            written = merged.select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "low").alias("first_id"), bucket.alias("bucket"))
        written.write.partitionBy("bucket").parquet(f"{self.path}/{run}")
        if self.state["at"]:
            remove_path(self.spark, part)
        there = [x.split("=")[1] for x in _names(self.spark, f"{self.path}/{run}") if x.startswith("bucket=")]
        self._publish(self.state | {"version": self.state["version"] + 1, "at": self.state["at"] | dict.fromkeys(there, run)})

    def _publish(self, state: dict) -> None:
        """Name the new bucket versions, after they are all written; a number can be taken once only."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']}.json")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/draft-{uuid.uuid4().hex}")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"version {state['version']} of the ledger was written by another process")
        self.state = state


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def ledger_of(rows: DataFrame, batches: list[Column], buckets: int = 16) -> Ledger:
    """A ledger that took ``rows`` (``key``, ``id`` and what the batch conditions need) batch by batch."""
    ledger = Ledger.open(rows.sparkSession, work_path(rows.sparkSession, "ledger"), buckets)
    for condition in batches:
        ledger.add(rows.filter(condition))
    return ledger
