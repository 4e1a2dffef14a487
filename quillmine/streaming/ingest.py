"""The ingest life cycle as streams: uploads once per content, limits per uploader, one publish per subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLICE = 10_000


def first_uploads(uploads: DataFrame, delay: str = "2 days") -> DataFrame:
    """Uploads (``content_hash``, ``ts``) whose content did not come before within the delay."""
    return uploads.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_hash"])


class _Limiter(StatefulProcessor):
    """Accepted times of one uploader; refused hits leave no trace."""

    def __init__(self, limit: int, window_s: float) -> None:
        self.limit, self.window_s = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # hits arrive in any order, and the limit needs theirs: 16 bytes a hit are held, results go out in slices
        parts = [(r["event_id"].to_numpy(np.int64), r["at"].to_numpy(np.float64)) for r in rows]
        events, moments = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((events, moments))
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        for i in range(0, len(order), SLICE):
            out = []
            for event, at in zip(events[order[i : i + SLICE]].tolist(), moments[order[i : i + SLICE]].tolist(), strict=True):
                times = [t for t in times if at - t <= self.window_s]
                ok = len(times) < self.limit
                if ok:
                    times.append(at)
                out.append((key[0], event, ok))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "accepted"])
        self.times.put([(t,) for t in times])

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: int, window_s: float) -> DataFrame:
    """(user_id, event_id, accepted) of a stream of hits (``user_id``, ``event_id``, ``at`` in seconds)."""
    return hits.groupBy("user_id").transformWithStateInPandas(statefulProcessor=_Limiter(limit, window_s), outputStructType="user_id long, event_id long, accepted boolean", outputMode="Append", timeMode="None")


def publishes(jobs: DataFrame, publish, checkpoint: str):
    """Run ``publish(codes)`` once per micro-batch with the subjects that it names, each once."""

    def batch(df: DataFrame, _: int) -> None:
        publish(df.select("code").distinct())

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain a stream into a parquet folder."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
