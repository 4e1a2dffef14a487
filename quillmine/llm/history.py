"""New batches held against all accepted history (problem 1).

The history is a set of tables in a folder: a chunk-to-record table cut into buckets by chunk, the
records' words cut into buckets by record, and a manifest that names their files.  ``open`` reads the
manifest; ``take`` judges a batch and appends what is accepted of it.  Neither reads the whole history.

A record's words, as one stream of bytes, are cut where a rolling hash of ``WINDOW`` bytes is 0 under
a mask, so that an insertion moves no later boundary.  The chunks go to the tasks of their buckets;
these read their buckets of the table only, give out the bytes that each pair of a new and an old
record has in common, and write the chunks of accepted records as new files of the buckets.  The
bytes of a pair are added up, and a record covered by at least one part in ``COVERED`` is compared
exactly, with words that are fetched for such pairs only.

Byte chunks can't decide by themselves: two questions with 70 % of their words in common may share
no chunk.  And a chunk that more than ``LISTED`` records hold (the same instruction, a stock phrase)
has no list that could be looked up.  The table therefore has chunks of a second kind, of the stream of
a record's distinct words, rare ones first: such a chunk closes as soon as it is rare, so a rare word
is one, and frequent words close one as a pair or as three.  By the prefix bound of ``similarity.py``
they miss no near-duplicate.  README has the share that byte chunks find alone.

The number of buckets grows fourfold when a bucket would hold more than ``bucket_rows`` rows, so a
small batch reads as much of a long history as of a short one.  A manifest is written after the
files it names, and files of tasks that failed are in no manifest, so a lost executor or driver leaves
the former version valid.

Defined results: null texts, texts of fewer than ``least`` words, records without a known batch
and hashes that are null or not 64 hex digits match nothing; repeated rows are judged one by one;
an empty history finds nothing; an empty batch adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import similarity
from quillmine.session import drop, materialize, qualified, remove_path, work_path

WINDOW, MASK = 12, 31
COVERED, LISTED = 4, 8
#: Chunks that one task looks up.
ROWS_A_TASK = 250_000
READ_IN = "spark.sql.files.minPartitionNum"
#: Record of a byte chunk that is too frequent to have a list.
MARK = -(2**63)
#: Kinds of files: chunks of bytes, chunks of words, records, and the order of words.
BYTES, WORDS, RECORD, ORDER = 0, 1, 2, 3
#: Flag of an accepted record, beside those of the matrix of ``similarity``.
ACCEPTED = np.uint32(16 << 24)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def hash_digits(value: Column) -> Column:
    """The 64 hex digits that a written content hash stands for, else null."""
    digits = F.regexp_extract(F.lower(value), r"^[\W_]*(?:[a-z]+[-_]?\d*[\W_]*)?([0-9a-f]{64})[\W_]*$", 1)
    return F.when(digits != "", digits)


def month_of(created: Column) -> Column:
    """Calendar month as one number."""
    return (F.year(created) * 12 + F.month(created)).cast("int")


def seen_hashes(papers: DataFrame) -> DataFrame:
    """``id`` of papers (``id``, ``digits``, ``batch``, ``accepted``) whose digits an accepted earlier batch holds."""
    rows = papers.filter(F.col("digits").isNotNull() & F.col("batch").isNotNull())
    since = rows.filter("accepted").groupBy("digits").agg(F.min("batch").alias("since"))
    return rows.join(since, "digits").filter("batch > since").select("id")


def cut(texts: list[bytes], window: int = WINDOW, mask: int = MASK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, chunk hash, bytes) of the content-defined chunks of texts.

    All hashes are differences of one running sum: a window's is of the window only, a chunk's of the chunk only.
    """
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    n = len(data)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.r_[0, ends[:-1]].astype(np.int64)
    power, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * power[:n], out=total[1:])
    at = np.empty(0, np.int64)
    if n > window:
        rolled = (total[window:] - total[:-window]) * back[: n - window + 1]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(mask) == 0) + window
        # a window must lie inside one text
        text = np.searchsorted(starts, at - 1, side="right") - 1
        at = at[at - window >= starts[text]]
    stop = np.unique(np.r_[at, ends]).astype(np.int64)
    stop = stop[stop > 0]
    begin = np.r_[0, stop[:-1]].astype(np.int64)[: len(stop)]
    h = (total[stop] - total[begin]) * back[begin]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return np.searchsorted(ends, stop - 1, side="right"), h.view(np.int64), stop - begin


def chunk_table(rows: DataFrame, window: int = WINDOW, mask: int = MASK) -> DataFrame:
    """(id, chunk, bytes) of rows (``id``, ``text``): content-defined chunks with their sizes."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
                owner, chunk, size = cut(texts, window, mask)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(chunk), pa.array(size)], names=["id", "chunk", "bytes"])

    return rows.select("id", "text").mapInArrow(run, f"id {kind}, chunk long, bytes long")


def coverage(chunks: DataFrame, batch_of: DataFrame) -> DataFrame:
    """(id, bytes, shared) per record: its bytes, and those in chunks that an accepted earlier batch holds.

    ``batch_of``: ``id``, ``batch``, ``accepted``.
    """
    rows = chunks.join(batch_of.select("id", "batch", "accepted"), "id").filter(F.col("batch").isNotNull())
    held = rows.filter("accepted").groupBy("chunk").agg(F.min("batch").alias("since"))
    judged = rows.join(held, "chunk", "left")
    return judged.groupBy("id").agg(F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("batch") > F.col("since"), F.col("bytes")).otherwise(0)).alias("shared"))


def bucket_of(chunk: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of chunks or records, both of which are hashes."""
    unsigned = chunk.astype(np.uint64) if chunk.dtype == np.uint32 else chunk.view(np.uint64)
    return (unsigned % np.uint64(buckets)).astype(np.int64)


def _met(new: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values; ``old`` is sorted."""
    low, high = np.searchsorted(old, new, "left"), np.searchsorted(old, new, "right")
    times = high - low
    i = np.repeat(np.arange(len(new)), times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    return i, j


#: Packed columns of the two kinds of chunks: chunk, record, size with flags, and the bytes of the whole or a sketch.
PACKED = {BYTES: (np.uint64, np.int64, np.uint32, np.uint32), WORDS: (np.uint32, np.int64, np.uint32, np.uint64)}


def _byte_chunks(uid: np.ndarray, texts: list[bytes], accepted: np.ndarray) -> list[np.ndarray]:
    """The different chunks of each text with their bytes."""
    owner, chunk, size = cut(texts)
    whole = np.fromiter(map(len, texts), np.int64, len(texts))[owner]
    by = np.lexsort((chunk, owner))
    owner, chunk, size, whole = owner[by], chunk[by], size[by], whole[by]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])][: len(owner)])
    sums = np.minimum(np.add.reduceat(size, first) if len(first) else size, similarity.MOST_WORDS).astype(np.uint32)
    flags = np.where(accepted[owner[first]], ACCEPTED, np.uint32(0))
    return [chunk[first].view(np.uint64), uid[owner[first]], sums | flags, np.minimum(whole[first], 2**32 - 1).astype(np.uint32)]


def _emit(order: StoredOrder, tenths: int, buckets: int):
    """Rows (bucket, kind, block) of a batch of new records: their chunks of both kinds, and the records that were accepted."""

    def packed(kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
        out = similarity._pack(bucket_of(held[0], buckets), buckets, held)
        return pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(out.num_rows, kind, np.int32)), out.column(1)], names=["bucket", "kind", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid, accepted = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            yield packed(BYTES, _byte_chunks(uid, batch.column(3).cast(pa.binary()).to_pylist(), accepted))
            held = similarity.entries(batch, order, tenths)
            held[2] = held[2] | np.where(np.isin(held[1], uid[accepted]), ACCEPTED, np.uint32(0))
            yield packed(WORDS, held)
            _, first = np.unique(np.where(accepted, uid, MARK), return_index=True)
            kept = first[accepted[first]]
            if len(kept):
                took = batch.take(pa.array(kept))
                records = pa.table([took.column(0), took.column(5), *similarity.coded_words(took.column(2), order)], names=["uid", "uid2", "known", "rest"])
                where = bucket_of(uid[kept], buckets)
                names = np.unique(where)
                blocks = [_ipc(records.take(pa.array(np.flatnonzero(where == b)))) for b in names.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(np.full(len(names), RECORD, np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "kind", "block"])

    return run


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read_files(folder: str, names: list[str], columns: list[str] | None = None) -> pa.Table | None:
    from pyarrow import fs
    from pyarrow import parquet as pq

    parts = []
    files, root = fs.FileSystem.from_uri(folder)
    for name in names:
        with files.open_input_file(f"{root}/{name}") as source:
            parts.append(pq.ParquetFile(source).read(columns=columns))
    return pa.concat_tables(parts) if parts else None


def _write_file(folder: str, kind: int, bucket: int, table: pa.Table) -> str:
    """Write a file of a bucket; its name is unlike that of any other attempt."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    name = f"{('bytes', 'words', 'records', 'order')[kind]}-{bucket}-{uuid.uuid4().hex}.parquet"
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_output_stream(f"{root}/{name}") as sink:
        pq.write_table(table, sink, use_dictionary=["known"] if kind == RECORD else False, write_statistics=False)
    return name


def _chunks_table(kind: int, held: list[np.ndarray]) -> pa.Table:
    """Accepted chunks as they are kept: sorted, each record of a chunk once, and of a frequent byte chunk one mark only."""
    chunk, uid, size, more = held
    by = np.lexsort((uid, chunk))
    by = by[np.r_[True, (chunk[by][1:] != chunk[by][:-1]) | (uid[by][1:] != uid[by][:-1])][: len(by)]]
    chunk, uid, size, more = chunk[by], uid[by], size[by] & ~ACCEPTED, more[by]
    if kind == BYTES:
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)])
        length = np.diff(np.r_[first, len(chunk)])
        frequent = length > LISTED
        keep = ~np.repeat(frequent, length)
        keep[first[frequent]] = True
        uid[first[frequent]] = MARK
        return pa.table({"chunk": chunk[keep], "uid": uid[keep]})
    return pa.table({"chunk": chunk, "uid": uid, "size": size, "sketch": more})


def _shared_bytes(held: list[np.ndarray], old: list[pa.Table]) -> list[np.ndarray]:
    """(new, old, bytes, whole): the bytes that pairs share within a bucket, whose files are each sorted by chunk."""
    by = np.argsort(held[0], kind="stable")
    chunk, own, size, whole = (x[by] for x in held)
    spans, length, dead = [], np.zeros(len(chunk), np.int64), np.zeros(len(chunk), bool)
    for table in old:
        kept, uid = table.column("chunk").to_numpy(), table.column("uid").to_numpy()
        low, high = np.searchsorted(kept, chunk, "left"), np.searchsorted(kept, chunk, "right")
        # a mark, the least of all handles, stands first
        dead |= (high > low) & (uid[np.minimum(low, len(uid) - 1)] == MARK)
        length += high - low
        spans.append((uid, low, high - low))
    live = ~dead & (length <= LISTED)
    rows, theirs = [], []
    for uid, low, times in spans:
        times = np.where(live, times, 0)
        i = np.repeat(np.arange(len(chunk)), times)
        rows.append(i)
        theirs.append(uid[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)])
    i, b = np.concatenate(rows), np.concatenate(theirs)
    a = own[i]
    by = np.lexsort((i, b, a))
    i, a, b = i[by], a[by], b[by]
    # a record that was accepted twice has its chunks in two files
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (chunk[i][1:] != chunk[i][:-1])][: len(a)]
    i, a, b = i[once], a[once], b[once]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    bytes_ = (size[i] & np.uint32(similarity.MOST_WORDS)).astype(np.int64)
    return [a[first], b[first], np.add.reduceat(bytes_, first) if len(first) else bytes_, whole[i[first]].astype(np.int64)]


def _shared_words(held: list[np.ndarray], old: list[pa.Table], tenths: int) -> list[np.ndarray]:
    """(new, old, 0, 0): pairs that share a chunk of words and may be alike by their sizes and sketches."""
    by = np.argsort(held[0], kind="stable")
    chunk, a, own, drawn = (x[by] for x in held)
    most, late_flag = np.uint32(similarity.MOST_WORDS), np.uint32(similarity.LATE << 24)
    out = []
    for table in old:
        kept, uid, size, sketch = (table.column(c).to_numpy() for c in ("chunk", "uid", "size", "sketch"))
        longest = int(np.diff(np.flatnonzero(np.r_[True, kept[1:] != kept[:-1], True])).max()) if len(kept) else 1
        step = max(1, similarity.PAIRS_AT_ONCE // longest)
        for k in range(0, len(chunk), step):
            i, j = _met(chunk[k : k + step], kept)
            i += k
            n, m = own[i] & most, size[j] & most
            late, late2 = own[i] & late_flag != 0, size[j] & late_flag != 0
            keep = similarity.alike_in_size(n, m, drawn[i], sketch[j], tenths)
            keep &= ~(late & late2) & (~late | (n > m) | (n == most)) & (~late2 | (m > n) | (m == most))
            if keep.any():
                out.append(np.stack([a[i[keep]], uid[j[keep]]], axis=1))
    pairs = similarity._distinct(np.concatenate(out)) if out else [np.empty(0, np.int64)] * 2
    return [*pairs, np.zeros(len(pairs[0]), np.int64), np.zeros(len(pairs[0]), np.int64)]


_PAIRED = "kind int, bucket int, new long, old long, bytes long, whole long, file string"


def _look_up(folder: str, at: dict[str, list[str]], tenths: int, read):
    """Look the chunks of new records up in the buckets of a task, and write those of accepted records beside."""

    def rows(kind: int, bucket: int, pairs: list[np.ndarray] | None = None, name: str | None = None) -> pa.RecordBatch:
        n = 1 if pairs is None else len(pairs[0])
        columns = [pa.nulls(1, pa.int64())] * 4 if pairs is None else [pa.array(x, pa.int64()) for x in pairs]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int32)), *columns, pa.array([name] * n, pa.string())], names=["kind", "bucket", "new", "old", "bytes", "whole", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], list[pa.RecordBatch]] = {}
        for batch in batches:
            for k, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                blocks.setdefault((bucket, kind), []).append(batch.slice(k, 1))
        for (bucket, kind), held in sorted(blocks.items()):
            if kind == RECORD:
                table = pa.concat_tables(pa.ipc.open_stream(b.column("block")[0].as_buffer()).read_all() for b in held)
                yield rows(kind, bucket, name=_write_file(folder, kind, bucket, table.sort_by("uid")))
                continue
            new = similarity._unpack(held, PACKED[kind])
            if names := at.get(f"{kind}-{bucket}"):
                old = [_read_files(folder, [name]).combine_chunks() for name in names]
                read.add(sum(x.num_rows for x in old))
                yield rows(kind, bucket, _shared_bytes(new, old) if kind == BYTES else _shared_words(new, old, tenths))
            own = new[2] & ACCEPTED != 0
            if own.any():
                yield rows(kind, bucket, name=_write_file(folder, kind, bucket, _chunks_table(kind, [x[own] for x in new])))

    return run


class StoredOrder:
    """A word order in a history's folder: only its path goes to the tasks, and a worker reads it once."""

    def __init__(self, path: str, n_rows: int) -> None:
        self.path, self.n_rows = path, n_rows

    def places_of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _stored(self.path, self.n_rows).places_of(flat)


@lru_cache(maxsize=2)
def _stored(path: str, n_rows: int) -> similarity.WordOrder:
    folder, name = path.rsplit("/", 1)
    rows = _read_files(folder, [name])
    w, place, n = (rows.column(c).to_numpy() for c in ("w", "place", "n"))
    return similarity.WordOrder(w, place, n, n_rows)


class History:
    """Accepted records of earlier batches below a folder.  ``take`` judges a batch and appends what is accepted of it.

    ``read`` counts the rows that the look-ups of this object read from the history's tables.
    """

    def __init__(self, spark: SparkSession, path: str, tenths: int = 7, bucket_rows: int = 2_000_000, state: dict | None = None) -> None:
        self.spark, self.path, self.tenths, self.bucket_rows = spark, path, tenths, bucket_rows
        self.state = state or {"version": 0, "buckets": 16, "at": {}, "rows": 0, "order": None, "ordered": 0}
        self.read = spark.sparkContext.accumulator(0)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> History:
        """The history below ``path`` as its last manifest says, or a new one."""
        path = qualified(spark, path)
        numbers = [int(f[9:-5]) for f in _names(spark, path) if f.startswith("manifest-") and f.endswith(".json")]
        if not numbers:
            return cls(spark, path, **options)
        lines = spark.read.text(f"{path}/manifest-{max(numbers)}.json").collect()
        return cls(spark, path, state=json.loads("".join(r[0] for r in lines)), **options)

    def check(self, rows: DataFrame) -> DataFrame:
        """``id`` of the batch rows (``id``, ``text``) that the history already holds, exactly or nearly; nothing is appended."""
        new = prepared(rows.select("id", "text", F.lit(False).alias("accepted")))
        return self.take(new, new.count(), publish=False)

    def append(self, rows: DataFrame) -> None:
        """Add the batch rows (``id``, ``text``)."""
        new = prepared(rows.select("id", "text", F.lit(True).alias("accepted")))
        self.take(new, new.count())

    def take(self, new: DataFrame, n: int, publish: bool = True, only: int | None = None) -> DataFrame:
        """``id`` of the rows of a prepared batch of ``n`` rows that the history holds; what is accepted of it is appended.

        ``only`` judges by one kind of chunks, for measurements.
        """
        if not self.state["order"]:
            first = new.filter("accepted")
            if not publish or first.isEmpty():
                return materialize(new.select("id").limit(0), "seen")
            self._set_order(first, n)
        # a record has some 20 chunks
        state = json.loads(json.dumps(self.state)) | {"version": self.state["version"] + 1, "rows": self.state["rows"] + 20 * n}
        if publish and state["rows"] > state["buckets"] * self.bucket_rows:
            self._grow(state)
        order, buckets, tenths = StoredOrder(f"{self.path}/{state['order']}", state["ordered"]), state["buckets"], self.tenths
        tasks = min(buckets, 1 + 20 * n // ROWS_A_TASK)
        blocks = new.select("uid", "space", "words", "stream", "accepted", "uid2").mapInArrow(_emit(order, tenths, buckets), "bucket int, kind int, block binary")
        looked = blocks.repartitionById(tasks, F.col("bucket") % tasks).mapInArrow(_look_up(self.path, state["at"], tenths, self.read), _PAIRED)
        # a batch is read in as many tasks as it needs, not in one a file
        least = self.spark.conf.get(READ_IN, None)
        self.spark.conf.set(READ_IN, str(tasks))
        try:
            paired = materialize(looked, "paired")
            former = dict(state["at"])
            pairs = self._candidates(paired, only)
            seen = materialize(self._confirmed(pairs, new, order, former, buckets, n), "seen") if former else materialize(new.select("id").limit(0), "seen")
        finally:
            self.spark.conf.unset(READ_IN) if least is None else self.spark.conf.set(READ_IN, least)
        files = paired.filter("file is not null").select("kind", "bucket", "file").collect()
        drop(paired)
        if publish and files:
            for f in files:
                state["at"].setdefault(f"{f['kind']}-{f['bucket']}", []).append(f["file"])
            self._publish(state)
        return seen

    def _candidates(self, paired: DataFrame, only: int | None) -> DataFrame:
        """(new, old): handles of records that are covered by chunks of bytes, or share one of words."""
        rows = paired.filter("file is null")
        covered = rows.filter(F.col("kind") == BYTES).groupBy("new", "old").agg(F.sum("bytes").alias("bytes"), F.max("whole").alias("whole")).filter(F.col("bytes") * COVERED >= F.col("whole"))
        by_words = rows.filter(F.col("kind") == WORDS).select("new", "old")
        if only is not None:
            return (covered.select("new", "old") if only == BYTES else by_words).distinct()
        return covered.select("new", "old").unionByName(by_words).distinct()

    def _confirmed(self, pairs: DataFrame, new: DataFrame, order: StoredOrder, at: dict, buckets: int, n: int) -> DataFrame:
        """``id`` of new rows with a near-duplicate among the old records that they were paired with."""
        folder, read = self.path, self.read

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                uid = np.unique(batch.column(0).to_numpy())
                where = bucket_of(uid, buckets)
                for bucket in np.unique(where).tolist():
                    wanted.setdefault(bucket, []).append(uid[where == bucket])
            for bucket, held in sorted(wanted.items()):
                if not (names := at.get(f"{RECORD}-{bucket}")):
                    continue
                old = _read_files(folder, names, ["uid", "uid2", "known", "rest"]).combine_chunks()
                read.add(old.num_rows)
                took = old.filter(pa.array(np.isin(old.column("uid").to_numpy(), np.concatenate(held)))).combine_chunks()
                keys = np.stack([took.column("uid").to_numpy(), took.column("uid2").to_numpy()], axis=1)
                first = np.sort(np.unique(keys, axis=0, return_index=True)[1])
                for batch in took.take(pa.array(first)).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3)], names=["old", "known_b", "rest_b"])

        tasks = min(buckets, 1 + n // ROWS_A_TASK)
        wanted = pairs.select("old").distinct().repartitionById(tasks, (F.pmod("old", F.lit(buckets)) % tasks).cast("int"))
        old = wanted.mapInArrow(fetch, "old long, known_b array<smallint>, rest_b array<bigint>")
        mine = similarity.coded(new, order).dropDuplicates(["uid", "uid2"])
        mine = mine.select(F.col("uid").alias("new"), F.col("uid2").alias("new2"), F.col("known").alias("known_a"), F.col("rest").alias("rest_a"))
        sure = pairs.join(mine, "new").join(old, "old").filter(similarity.reaches(self.tenths)).select(F.col("new").alias("uid"), F.col("new2").alias("uid2")).distinct()
        return new.select("id", "uid", "uid2").join(sure, ["uid", "uid2"], "left_semi").select("id")

    def _set_order(self, first: DataFrame, n: int) -> None:
        """Frequent words as they are when the history begins; they decide how words close chunks, not what is found."""
        order = similarity.word_order(first, n)
        _make_folder(self.spark, self.path)
        self.state |= {"order": _write_file(self.path, ORDER, 0, pa.table({"w": order.hashes, "place": order.places, "n": order.counts})), "ordered": n}

    def _grow(self, state: dict) -> None:
        """Four times the buckets, or more: each old bucket is read once and cut into its new ones, without a shuffle.

        The files of a bucket become one, sorted as each of them was.
        """
        before = state["buckets"]
        while state["rows"] > state["buckets"] * self.bucket_rows:
            state["buckets"] *= 4
        folder, after, at = self.path, state["buckets"], state["at"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    for kind in (BYTES, WORDS, RECORD):
                        if not (names := at.get(f"{kind}-{b}")):
                            continue
                        rows = _read_files(folder, names)
                        rows = rows.sort_by([(c, "ascending") for c in (("uid",) if kind == RECORD else ("chunk", "uid"))])
                        where = bucket_of(rows.column(0).to_numpy(), after)
                        out = [(kind, bucket, _write_file(folder, kind, bucket, rows.filter(pa.array(where == bucket)))) for bucket in np.unique(where).tolist()]
                        columns = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], names=["kind", "bucket", "file"])

        if at:
            found = materialize(self.spark.range(0, before, 1, min(before, 512)).mapInArrow(run, "kind int, bucket int, file string"), "grown")
            state["at"] = {}
            for f in found.collect():
                state["at"].setdefault(f"{f['kind']}-{f['bucket']}", []).append(f["file"])
            drop(found)

    def _publish(self, state: dict) -> None:
        """Name a new version: written under another name first, so no reader ever meets half a manifest."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{state['version']}.json")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"version {state['version']} of the history was written by another process")
        if state["buckets"] != self.state["buckets"]:
            # files of the former buckets are named by no manifest from now on
            named = {f for names in state["at"].values() for f in names}
            for f in (f for names in self.state["at"].values() for f in names if f not in named):
                files.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}"), False)
        self.state = state

    def drop(self) -> None:
        """Remove the tables."""
        remove_path(self.spark, self.path)


def prepared(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows (``id``, ``text``, ``accepted`` and the columns ``parts``) with names, words and stream, written once, in folders by ``parts``."""
    return similarity.hashed_rows(rows.select("id", "accepted", *parts, "text", F.lit(0).alias("space")), parts=parts, stream=True)


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def seen_texts(rows: DataFrame, batches: DataFrame, tenths: int = 7, path: str | None = None, **options) -> DataFrame:
    """``id`` of rows near-duplicate to a row of an accepted paper of an earlier batch.

    ``rows``: ``id`` long, ``paper_id``, ``text``; ``batches``: ``paper_id``, ``batch`` int, ``accepted`` boolean.
    Batch by batch in their order: held against the history, then what was accepted is appended.
    """
    spark = rows.sparkSession
    dated = rows.select("id", "paper_id", "text").join(batches.select("paper_id", "batch", "accepted").filter(F.col("batch").isNotNull()), "paper_id")
    new = prepared(dated.select("id", "text", "batch", F.coalesce("accepted", F.lit(False)).alias("accepted")), "batch")
    sizes = {r["batch"]: r["count"] for r in new.groupBy("batch").count().collect()}
    kept = History.open(spark, path or work_path(spark, "history"), tenths=tenths, **options)
    out = None
    for batch in sorted(sizes):
        found = kept.take(new.filter(F.col("batch") == batch), sizes[batch])
        out = found if out is None else out.unionByName(found)
    drop(new)
    if path is None and sizes:
        kept.drop()
    return out if out is not None else rows.select("id").limit(0)
