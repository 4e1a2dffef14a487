"""Vectors compared: nearest rows, paper comparison and the decision on an upload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.operators.scoring import half_up
from quillmine.session import bounded, work_path

BLOCK, TILE = 4_096, 2_048


def nearest(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, best_id, sim): for each of a stated set of queries the nearest other row of ``base``.

    Both have ``id`` and ``vector``.  The queries are written to the shared folder and read by each task
    a block at a time; a task returns one candidate per query, so nothing grows with the base.
    """
    spark = base.sparkSession
    path = work_path(spark, "queries")
    queries.select("id", "vector").write.option("maxRecordsPerFile", BLOCK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        files, root = fs.FileSystem.from_uri(path)
        names = sorted(i.path for i in files.get_file_info(fs.FileSelector(root)) if i.path.endswith(".parquet"))
        best: dict[int, tuple[float, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            rows = np.asarray(batch.column(1).to_pylist(), np.float64)
            for name in names:
                part = pq.ParquetFile(files.open_input_file(name)).read()
                if not part.num_rows:
                    continue
                wanted = part.column(0).to_numpy()
                sims = np.asarray(part.column(1).to_pylist(), np.float64) @ rows.T
                sims[wanted[:, None] == ids[None, :]] = -np.inf
                sims = np.floor(sims * 1e6 + 0.5) / 1e6
                top = sims.max(axis=1)
                low = np.where(sims == top[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
                for q, s, i in zip(wanted.tolist(), top.tolist(), low.tolist(), strict=True):
                    if s > -np.inf and (q not in best or (-s, i) < (-best[q][0], best[q][1])):
                        best[q] = (s, i)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b for _, b in best.values()], pa.int64()), pa.array([s for s, _ in best.values()], pa.float64())], names=["query_id", "best_id", "sim"])

    found = base.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, best_id long, sim double")
    return found.groupBy("query_id").agg(F.max(F.struct("sim", -F.col("best_id"))).alias("m")).select("query_id", (-F.col("m.col2")).alias("best_id"), F.col("m.sim").alias("sim"))


def best_per_paper(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_paper, query_id, paper, sim): each stated query's best similarity in every other paper.

    ``queries``: ``id``, ``paper``, ``vector``; ``base``: ``paper``, ``vector``.  Queries are read block by block; a task
    returns one row per query and paper that it holds.
    """
    path = work_path(base.sparkSession, "queries")
    queries.select("id", "paper", "vector").write.option("maxRecordsPerFile", BLOCK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        files, root = fs.FileSystem.from_uri(path)
        names = sorted(i.path for i in files.get_file_info(fs.FileSelector(root)) if i.path.endswith(".parquet"))
        for batch in batches:
            if not batch.num_rows:
                continue
            papers = batch.column(0).to_numpy()
            rows = np.asarray(batch.column(1).to_pylist(), np.float64)
            order = np.argsort(papers, kind="stable")
            papers, rows = papers[order], rows[order]
            starts = np.flatnonzero(np.r_[True, papers[1:] != papers[:-1]])
            for name in names:
                part = pq.ParquetFile(files.open_input_file(name)).read()
                if not part.num_rows:
                    continue
                sims = np.maximum.reduceat(np.asarray(part.column(2).to_pylist(), np.float64) @ rows.T, starts, axis=1)
                own, ids = part.column(1).to_numpy(), part.column(0).to_numpy()
                q, k = np.nonzero(own[:, None] != papers[starts][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q]), pa.array(papers[starts][k]), pa.array(sims[q, k])], names=["query_paper", "query_id", "paper", "sim"])

    found = base.select(F.col("paper").cast("long"), "vector").mapInArrow(run, "query_paper long, query_id long, paper long, sim double")
    return found.groupBy("query_paper", "query_id", "paper").agg(F.max("sim").alias("sim"))


def compare_papers(queries: DataFrame, base: DataFrame, same: float = 0.85) -> DataFrame:
    """(query_paper, paper, score): share of a paper's questions that another paper has; not symmetric."""
    best = best_per_paper(queries.select(F.col("id").cast("long").alias("id"), F.col("paper").cast("long").alias("paper"), "vector"), base)
    return best.groupBy("query_paper", "paper").agg(half_up(F.avg((half_up(F.col("sim"), 3) >= same).cast("double")), 3).alias("score"))


def best_match(scores: DataFrame) -> DataFrame:
    """(query_paper, paper, score): the paper with the highest score, the lowest id on ties."""
    best = scores.groupBy("query_paper").agg(F.max(F.struct("score", -F.col("paper"))).alias("m"))
    return best.select("query_paper", (-F.col("m.col2")).alias("paper"), F.col("m.score").alias("score"))


def best_live(queries: DataFrame, live: DataFrame, same: float = 0.85) -> DataFrame:
    """(query_paper, paper, score): for each paper the live paper of the same subject that has the largest share of its questions, the lowest id on ties.

    Both have ``subject``, ``paper`` and ``vector``.  Live questions are written ordered by subject; a task reads those of a
    subject tile by tile and holds, for a tile of questions, which of the subject's papers have them.
    """
    path = work_path(live.sparkSession, "live")

    def ordered(df: DataFrame) -> DataFrame:
        rows = df.select("subject", F.col("paper").cast("long").alias("paper"), "vector")
        return rows.repartitionByRange("subject", "paper").sortWithinPartitions("subject", "paper")

    ordered(live).write.option("parquet.block.size", 1 << 22).parquet(path)

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return batch.column("paper").to_numpy(), rows.reshape(batch.num_rows, -1)

    def starts(ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        files, root = fs.FileSystem.from_uri(path)
        base = dataset.dataset(root, filesystem=files, format="parquet")

        def held(subject: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ids, hits = [], []
            for part in base.to_batches(columns=["paper", "vector"], filter=dataset.field("subject") == subject, batch_size=TILE, batch_readahead=1, fragment_readahead=1, use_threads=False):
                if part.num_rows:
                    papers, theirs = flat(part)
                    at = starts(papers)
                    ids.append(papers[at])
                    hits.append(np.floor(np.maximum.reduceat(rows @ theirs.T, at, axis=1) * 1e3 + 0.5) / 1e3 >= same)
            if not ids:
                return np.empty(0, np.int64), np.empty((len(rows), 0), bool)
            found = np.concatenate(ids)
            order = np.argsort(found, kind="stable")
            at = starts(found[order])
            return found[order][at], np.logical_or.reduceat(np.concatenate(hits, axis=1)[:, order], at, axis=1)

        current, others, counts, total, out = None, np.empty(0, np.int64), np.empty(0), 0, []

        def close() -> None:
            score = np.where(others == current[1], -1.0, np.floor(counts / total * 1e3 + 0.5) / 1e3)
            if len(score) and (most := score.max()) >= 0:
                out.append((current[1], int(others[score == most].min()), float(most)))

        for batch in batches:
            subjects = np.asarray(batch.column("subject").to_pylist(), object)
            cuts = [*starts(subjects).tolist(), len(subjects)] if len(subjects) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                for i in range(low, high, TILE):
                    own, rows = flat(batch.slice(i, min(TILE, high - i)))
                    names, hits = held(subjects[low], rows)
                    at = starts(own)
                    sums = np.add.reduceat(hits, at, axis=0, dtype=np.int64) if len(names) else np.zeros((len(at), 0), np.int64)
                    for k, n, more in zip(own[at].tolist(), np.diff([*at, len(own)]).tolist(), sums, strict=True):
                        if current != (subjects[low], k):
                            if current is not None:
                                close()
                            current, others, counts, total = (subjects[low], k), names, np.zeros(len(names), np.int64), 0
                        counts, total = counts + more, total + n
            if len(out) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_paper", "paper", "score"])
                out.clear()
        if current is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_paper", "paper", "score"])

    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return ordered(queries).mapInArrow(run, "query_paper long, paper long, score double")


#: Centres that are sent to every task.
CENTRES = 10_000


def assign(rows: DataFrame, centres: DataFrame, key: str, threshold: float) -> DataFrame:
    """(id, cluster, sim): the nearest centre, the lowest key on ties, or none where it is below ``threshold``.

    ``centres`` (``key``, ``centroid``) are few, which is checked; blocks of rows are multiplied with all of them.
    """
    held = sorted((r[0], r[1]) for r in bounded(centres.select(F.col(key).cast("long"), "centroid"), CENTRES, "the centres").collect())
    names, bank = np.array([k for k, _ in held], np.int64), np.array([v for _, v in held], np.float64)
    kind = dict(centres.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(names):
                block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                near = np.floor(block @ bank.T * 1e6 + 0.5) / 1e6
                at = near.argmax(axis=1)
                top = near[np.arange(len(at)), at]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[at], mask=top < threshold), pa.array(top)], names=["id", "cluster", "sim"])

    found = rows.select(F.col("id").cast("long"), "vector").mapInArrow(run, "id long, cluster long, sim double")
    return found.select("id", F.col("cluster").cast(kind).alias("cluster"), "sim")


def decision(known: Column, questions: Column, modules: Column, clash: Column, best: Column) -> Column:
    """Reasons that send a paper to review, joined; empty when it may be published."""
    reasons = F.array(
        F.when(~known, F.lit("The subject is not in the catalogue.")),
        F.when((questions < 8) | (modules < 4), F.lit("Few questions or modules were found.")),
        F.when(clash, F.lit("The session has a paper already.")),
        F.when((best >= 0.9) & ~clash, F.lit("It closely matches another paper.")),
    )
    return F.array_join(F.array_compact(reasons), " ")
