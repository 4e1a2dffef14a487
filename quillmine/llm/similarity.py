"""Near-duplicate pairs by a blocked sparse product of records and words (problem 5).

Records with the same words form a class, and only classes are compared.  The incidence matrix of
classes and words is multiplied with its transpose block by block, but only where a result can
reach the threshold: words are ordered from rare to frequent, and two classes that are similar
enough must share a word among the first ``p = n - ceil(t n) + 1`` of each, two among the first
``p + 1`` and three among the first ``p + 2``.  Rare words are therefore columns of their own,
frequent words count only in pairs, and the most frequent only in threes, which bounds the length
of a column.  What is frequent follows from the number of rows (``levels``).  Pairs and threes are
made of texts with fewer than ``WIDE`` words only, longer ones have one entry a word, and as sizes
of similar texts differ by the threshold at most, each pair meets in one of the two forms: no
record has more than some 3,300 entries in pairs and threes, whatever the frequencies.

A column that proves longer than ``LONG`` entries is cut into blocks where it is met, and each pair
of its blocks is a piece of work for another task.  Inside a block, pairs are dropped by the bound
that their sizes give for the number of differing words, against a lower bound of that number from
64-bit parity sketches; the remaining pairs are counted exactly.

Words are compared by 64-bit hashes, the ``KNOWN_WORDS`` most frequent of them by their places.  A
class is named by 128 bits; the search takes the first 64 of them as a handle, and the exact count
is made for every class of a handle.

Defined results: null texts and texts with fewer than ``least`` words are similar to nothing;
repeated rows are copies of one class; an empty table gives no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import drop, materialize

#: Words whose frequency is known to every task; a fixed bound of what is sent to them (1 MB).
KNOWN_WORDS = 65_536
#: Up to a million rows, a word in so many rows is a column alone, or with a second word; beyond, both grow with the root of the rows.
ALONE_UP_TO, PAIRED_UP_TO = 2_000, 50_000
#: Texts below ``WIDE`` words have pairs and threes, texts from ``NARROW`` words on have single words; in between both.
WIDE, NARROW = 86, 60
#: A longer column is cut into blocks of this many entries.
LONG = 8_192
LEAST_WORDS = 8
PAIRS_AT_ONCE = 1_000_000


def word_hashes(words: Column) -> Column:
    """Sorted distinct 64-bit hashes of words."""
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def levels(n_rows: int) -> tuple[int, int]:
    """Frequencies up to which a word is a column alone, and with a second word."""
    growth = max(1.0, n_rows / 1e6) ** 0.5
    return int(ALONE_UP_TO * growth), int(PAIRED_UP_TO * growth)


def hashed_rows(rows: DataFrame, least: int = LEAST_WORDS, parts: tuple[str, ...] = (), stream: bool = False) -> DataFrame:
    """Rows (``space``, ``id``, ``text`` and more) with ``uid``, ``uid2`` and ``words`` for ``text``; rows with equal words have one uid.

    Rows of different spaces are never compared.  The result is written in folders by ``parts``;
    with ``stream`` it has the words of the text in their order, too, each with a blank behind it.
    """
    kept = [c for c in rows.columns if c != "text"]
    # runs of letters and digits in lower case; the words are taken once, so they go through a generator and not through several expressions
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    found = [word_hashes, *((lambda ws: F.concat(F.array_join(ws, " "), F.lit(" ")),) if stream else ())]
    each = F.transform(F.array(words), lambda ws: F.struct(*(f(ws).alias(n) for f, n in zip(found, ("words", "stream"), strict=False))))
    hashed = rows.filter(F.col("text").isNotNull()).select(*kept, F.explode(F.filter(each, lambda x: F.size(x["words"]) >= least)).alias("found"))
    hashed = hashed.select(*kept, "found.*")
    # words recur, so a dictionary of a whole file's words pays
    uid = F.xxhash64("space", "words").alias("uid"), F.xxhash64(F.lit("second"), "space", "words").alias("uid2")
    return materialize(hashed.select(*kept, *(["stream"] if stream else []), *uid, "words"), "words", parts, **{"parquet.dictionary.page.size": str(16 << 20)})


def _pack(part: np.ndarray, parts: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row per part with the bytes of its entries: a shuffle moves blocks instead of single entries."""
    by = np.argsort(part, kind="stable")
    arrays = [a[by] for a in arrays]
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(ends))
    blobs = [b"".join(a[ends[i] : ends[i + 1]].tobytes() for a in arrays) for i in used]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "block"])


def _unpack(batches: Iterator[pa.RecordBatch], kinds: tuple[type, ...]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in kinds]
    for batch in batches:
        for block in batch.column("block"):
            data = block.as_buffer()
            n, at = data.size // width, 0
            for held, kind in zip(out, kinds, strict=True):
                held.append(np.frombuffer(data, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _parts(spark: SparkSession, entries: int) -> int:
    """Number of shuffle parts: the session's, or more so that a task holds less than a million entries."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // 750_000)


@dataclass(frozen=True)
class WordOrder:
    """Known frequent words by hash, with their place in the order from rare to frequent, and their frequency."""

    hashes: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    n_rows: int = 0

    def places_of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place from 1 on, 0 for an unknown word; frequency) of hashes."""
        if not len(self.hashes):
            return np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, flat), len(self.hashes) - 1)
        known = self.hashes[at] == flat
        return np.where(known, self.places[at], 0), np.where(known, self.counts[at], 0)


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """Rows of (..., ``n``) from the greatest counts down, at most ``limit``; equal counts stay together.

    The bound is found in a histogram of the counts, so no task or driver ever sorts candidates of all partitions.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    steps = counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for step in steps:
        total += step["rows"]
        if total > limit:
            break
        least = step["least"]
    return counted.filter(F.col("n") >= least) if least is not None else counted.limit(0)


def word_order(hashed: DataFrame, n_rows: int) -> WordOrder:
    """Frequencies of the words over all rows; the most frequent ``KNOWN_WORDS`` go to the driver."""
    parts = _parts(hashed.sparkSession, 5 * n_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        held: list[np.ndarray] = []
        for batch in (*batches, None):
            if batch is not None:
                held.append(batch.column(0).flatten().to_numpy())
            if held and (batch is None or sum(map(len, held)) > PAIRS_AT_ONCE):
                new, times = np.unique(np.concatenate(held), return_counts=True)
                words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, times]), len(words)).astype(np.int64)
                held = []
        if len(words):
            yield _pack((words.view(np.uint64) % np.uint64(parts)).astype(np.int64), parts, [words, counts])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = _unpack(batches, (np.int64, np.int64))
        words, at = np.unique(words, return_inverse=True)
        sums = np.bincount(at, counts, len(words)).astype(np.int64)
        keep = sums > 50
        yield pa.RecordBatch.from_arrays([pa.array(words[keep]), pa.array(sums[keep])], names=["w", "n"])

    counted = hashed.select("words").mapInArrow(count, "part int, block binary").repartitionById(parts, F.col("part")).mapInArrow(total, "w long, n long")
    counted = materialize(counted, "word-counts")
    top = most_frequent(counted, KNOWN_WORDS).toPandas().sort_values(["n", "w"], kind="stable")
    drop(counted)
    hashes, counts = top["w"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    by = np.argsort(hashes)
    return WordOrder(hashes[by], np.arange(1, len(by) + 1)[by], counts[by], n_rows)


def _first_share(n: np.ndarray, tenths: int) -> np.ndarray:
    return n - (n * tenths + 9) // 10 + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=64)
def _threes(k: int) -> np.ndarray:
    return np.array(list(combinations(range(k), 3)), np.int64).reshape(-1, 3).T


def _columns(space: np.ndarray, offsets: np.ndarray, flat: np.ndarray, order: WordOrder, tenths: int):
    """Matrix columns of a batch of classes: (column, class number, sketch of the class, late)."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    place, count = order.places_of(flat)
    alone_to, paired_to = levels(order.n_rows)
    level = np.where(count > paired_to, 3, np.where(count > alone_to, 2, 1))
    by = np.argsort(row * (KNOWN_WORDS + 2) + place, kind="stable")
    word, level = _mix(flat[by].view(np.uint64)), level[by]
    rank = np.arange(len(row)) - offsets[row]
    p = _first_share(n, tenths)[row]
    short, long = (n < WIDE)[row], (n >= NARROW)[row]

    # parity sketch: bits of shared words cancel, so no more bits differ than words do
    sketch = np.bitwise_xor.reduceat(np.uint64(1) << (word >> np.uint64(58)), offsets[:-1])

    seed = _mix(space.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    # of two classes, the smaller has the shared word among its first ``middle`` ones
    middle = (n - (n * 2 * tenths + tenths + 9) // (10 + tenths) + 1)[row]
    alone = np.flatnonzero((level == 1) & (rank < p) & short)
    every = np.flatnonzero((rank < p) & long)
    late = [rank[alone] >= middle[alone], rank[every] >= middle[every]]
    keys, rows = [word[alone] ^ seed[row[alone]], _mix(word[every] ^ seed[row[every]])], [row[alone], row[every]]
    second = (level == 2) & short
    for gap in range(1, WIDE):
        i = np.flatnonzero(second[:-gap] & (rank[gap:] <= p[gap:]) & (row[:-gap] == row[gap:])) if gap < len(row) else np.empty(0, int)
        if len(i) == 0:
            if not (second & (rank + gap <= p)).any():
                break
            continue
        keys.append(_mix(word[i] + np.uint64(1)) ^ (word[i + gap] * np.uint64(0x9E3779B97F4A7C15)) ^ seed[row[i]])
        rows.append(row[i])
    third = (level == 3) & (rank <= p + 1) & short
    common = np.bincount(row[third], minlength=len(n))
    for r in np.flatnonzero(common >= 3):
        own = np.arange(offsets[r], offsets[r + 1])
        own = own[third[own]]
        a, b, c = own[_threes(len(own))]
        keys.append(_mix(_mix(word[a] + np.uint64(2)) ^ (word[b] * np.uint64(0x9E3779B97F4A7C15))) ^ (word[c] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ seed[r])
        rows.append(np.full(len(a), r))
    key, row = np.concatenate(keys), np.concatenate(rows)
    late = np.concatenate([*late, np.zeros(len(key) - len(late[0]) - len(late[1]), bool)])
    return (key >> np.uint64(32)).astype(np.uint32), row, sketch, late


#: Flags of an entry beside its side in a pair of blocks: not among the first words that a smaller class needs.
LATE = 4
#: An entry of the matrix: column, class, number of words with flags in the upper 8 bits, sketch.
ENTRY = (np.uint32, np.int64, np.uint32, np.uint64)
MOST_WORDS = (1 << 24) - 1


def entries(batch: pa.RecordBatch, order: WordOrder, tenths: int) -> list[np.ndarray]:
    """Matrix entries (column, class, size with flags, sketch) of a batch of (``uid``, ``space``, ``words``)."""
    uid, first = np.unique(batch.column(0).to_numpy(), return_index=True)
    space, words = batch.column(1).to_numpy()[first], batch.column(2).take(pa.array(first))
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    col, row, sketch, late = _columns(space, offsets, np.ascontiguousarray(flat), order, tenths)
    n = np.minimum(np.diff(offsets), MOST_WORDS).astype(np.uint32)
    return [col, uid[row], n[row] | (late.astype(np.uint32) * np.uint32(LATE << 24)), sketch[row]]


def matrix(hashed: DataFrame, order: WordOrder, tenths: int, parts: int) -> DataFrame:
    """The sparse matrix by column, as packed blocks (``part``, ``block``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = entries(batch, order, tenths)
                yield _pack(held[0].astype(np.int64) % parts, parts, held)

    return hashed.select("uid", "space", "words").mapInArrow(run, "part int, block binary")


def alike_in_size(n: np.ndarray, other: np.ndarray, sketch: np.ndarray, other_sketch: np.ndarray, tenths: int) -> np.ndarray:
    """Whether sizes and sketches leave a similarity of ``tenths`` / 10 possible; sizes at ``MOST_WORDS`` may be greater still."""
    low, high = np.minimum(n, other).astype(np.int64), np.maximum(n, other).astype(np.int64)
    # of 10 + t tenths of all words, at most 10 - t tenths may differ
    apart = np.bitwise_count(sketch ^ other_sketch)
    return (high == MOST_WORDS) | ((apart <= (low + high) * (10 - tenths) // (10 + tenths)) & (low * 10 >= high * tenths))


def _pairs_of(sizes: np.ndarray, starts: np.ndarray, early: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside runs, a bounded number at a time; the first of a pair is an early entry."""
    # one step pairs each entry with the one ``gap`` places further in the same run
    ends, ok = starts + sizes, np.flatnonzero(early)
    for gap in range(1, int(sizes.max()) if len(sizes) else 0):
        ok = ok[ends[ok] > ok + gap]
        if not len(ok):
            return
        for i in range(0, len(ok), PAIRS_AT_ONCE):
            yield ok[i : i + PAIRS_AT_ONCE], ok[i : i + PAIRS_AT_ONCE] + gap


def _product(held: list[np.ndarray], tenths: int, long: int) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Pairs ("pairs", [a, b]) of the columns; and columns longer than ``long`` as entries of block pairs ("blocks", entries)."""
    col, uid, size, sketch = held
    side = (size >> np.uint32(24)).astype(np.uint8)
    # early entries stand first in a column
    by = np.lexsort((uid, side & LATE, col))
    col, uid, side = col[by], uid[by], side[by]
    # copies of a class from several batches are one entry
    new = np.r_[True, (col[1:] != col[:-1]) | (uid[1:] != uid[:-1]) | (side[1:] != side[:-1])][: len(by)]
    by = by[new]
    col, uid, side, n, sketch = col[new], uid[new], side[new], (size[by] & np.uint32(MOST_WORDS)).astype(np.int32), sketch[by]
    first = np.flatnonzero(np.r_[True, col[1:] != col[:-1]][: len(col)])
    length = np.diff(np.r_[first, len(col)])
    wide = np.repeat(length > long, length)
    if wide.any():
        for at, m in zip(first[wide[first]].tolist(), length[wide[first]].tolist(), strict=True):
            yield from _block_pairs([x[at : at + m] for x in (col, uid, side, n, sketch)], long)
        col, uid, side, n, sketch = (x[~wide] for x in (col, uid, side, n, sketch))
        first = np.flatnonzero(np.r_[True, col[1:] != col[:-1]][: len(col)])
        length = np.diff(np.r_[first, len(col)])
    sizes, starts = np.repeat(length, length), np.repeat(first, length)
    seen: list[np.ndarray] = []
    waiting = 0
    for i, j in _pairs_of(sizes, starts, side & LATE == 0):
        keep = alike_in_size(n[i], n[j], sketch[i], sketch[j], tenths) & ((side[j] & LATE == 0) | (n[j] > n[i]) | (n[j] == MOST_WORDS))
        i, j = i[keep], j[keep]
        one, two = side[i] & 3, side[j] & 3
        keep = (uid[i] != uid[j]) & ((one == 0) & (two == 0) | (one + two == 3))
        i, j = i[keep], j[keep]
        if len(i):
            seen.append(np.stack([np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j])], axis=1))
            waiting += len(i)
        if waiting > PAIRS_AT_ONCE:
            yield "pairs", _distinct(np.concatenate(seen))
            seen, waiting = [], 0
    if seen:
        yield "pairs", _distinct(np.concatenate(seen))


def _distinct(pairs: np.ndarray) -> list[np.ndarray]:
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)][: len(pairs)]]
    return [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])]


def _block_pairs(column: list[np.ndarray], long: int) -> Iterator[tuple[str, list[np.ndarray]]]:
    """A long column as one column per pair of its blocks: side 1 meets side 2, and a block meets itself on side 0."""
    col, uid, side, n, sketch = column
    count = -(-len(uid) // long)
    cuts = [slice(k * long, (k + 1) * long) for k in range(count)]
    for i in range(count):
        for j in range(i, count):
            name = _mix(np.array([int(col[0]) * 1_000_003 + i * count + j + 1], np.uint64))[0] >> np.uint64(32)
            parts = [(cuts[i], 0)] if i == j else [(cuts[i], 1), (cuts[j], 2)]
            take = np.concatenate([np.arange(c.start, min(c.stop, len(uid))) for c, _ in parts])
            flag = np.concatenate([np.full(min(c.stop, len(uid)) - c.start, f, np.uint32) for c, f in parts])
            size = n[take].astype(np.uint32) | ((side[take].astype(np.uint32) | flag) << np.uint32(24))
            yield "blocks", [np.full(len(take), name, np.uint32), uid[take], size, sketch[take]]


def candidates(columns: DataFrame, tenths: int, parts: int, long: int = LONG) -> DataFrame:
    """Pairs (``a`` < ``b``) that share a column and pass the bounds; pairs of cut columns may come twice."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, out in _product(_unpack(batches, ENTRY), tenths, long):
            if kind == "pairs":
                part = (_mix(out[0].view(np.uint64) ^ _mix(out[1].view(np.uint64))) % np.uint64(parts)).astype(np.int64)
            else:
                part = np.full(len(out[0]), int(out[0][0]) % parts, np.int64)
            packed = _pack(part, parts, out)
            yield pa.RecordBatch.from_arrays([packed.column(0), pa.array(np.full(packed.num_rows, kind == "pairs")), packed.column(1)], names=["part", "done", "block"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        for batch in batches:
            done = batch.column("done").to_numpy(zero_copy_only=False)
            for ready, rows in ((True, batch.filter(pa.array(done))), (False, batch.filter(pa.array(~done)))):
                if not rows.num_rows:
                    continue
                if ready:
                    pairs.append(np.stack(_unpack([rows], (np.int64, np.int64)), axis=1))
                    continue
                # a block holds one pair of blocks of a long column
                for k in range(rows.num_rows):
                    pairs += [np.stack(out, axis=1) for _, out in _product(_unpack([rows.slice(k, 1)], ENTRY), tenths, 4 * long)]
        if pairs:
            a, b = _distinct(np.concatenate(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    multiplied = columns.repartitionById(parts, F.col("part")).mapInArrow(multiply, "part int, done boolean, block binary")
    return multiplied.repartitionById(parts, F.col("part")).mapInArrow(gather, "a long, b long")


def coded_words(words: pa.ListArray, order: WordOrder) -> tuple[pa.ListArray, pa.ListArray]:
    """Lists of word hashes as lists of places of the known ones and of hashes of the rest."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place, _ = order.places_of(flat)
    known = place > 0
    upto = np.r_[0, np.cumsum(known)]
    short = pa.array((place[known] - 1).astype(np.uint16).view(np.int16))
    return pa.ListArray.from_arrays(pa.array(upto[offsets].astype(np.int32)), short), pa.ListArray.from_arrays(pa.array((offsets - upto[offsets]).astype(np.int32)), pa.array(flat[~known]))


def coded(hashed: DataFrame, order: WordOrder, *more: str) -> DataFrame:
    """(``uid``, ``uid2``, ``known``, ``rest``, more columns): words as places of frequent ones and hashes of the others."""
    kept = ["uid", "uid2", *more]
    schema = ", ".join(f"{c} {dict(hashed.dtypes)[c]}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *coded_words(batch.column(len(kept)), order)], names=[*kept, "known", "rest"])

    return hashed.select(*kept, "words").mapInArrow(run, f"{schema}, known array<smallint>, rest array<bigint>")


def reaches(tenths: int) -> Column:
    """Whether the coded words ``known_a``, ``rest_a`` and ``known_b``, ``rest_b`` have a similarity of ``tenths`` / 10."""
    shared = F.size(F.array_intersect("known_a", "known_b")) + F.size(F.array_intersect("rest_a", "rest_b"))
    sizes = sum((F.size(c) for c in ("rest_a", "known_b", "rest_b")), F.size("known_a"))
    return shared * 10 >= (sizes - shared) * tenths


def confirmed(pairs: DataFrame, words: DataFrame, tenths: int) -> DataFrame:
    """The pairs of classes (``a``, ``a2``, ``b``, ``b2``) whose exact similarity reaches ``tenths`` / 10.  ``words``: as of ``coded``."""
    once = words.groupBy("uid", "uid2").agg(F.first("known").alias("known"), F.first("rest").alias("rest"))

    def of(side: str) -> DataFrame:
        return once.select(F.col("uid").alias(side), F.col("uid2").alias(f"{side}2"), F.col("known").alias(f"known_{side}"), F.col("rest").alias(f"rest_{side}"))

    return pairs.join(of("a"), "a").join(of("b"), "b").filter(reaches(tenths)).select("a", "a2", "b", "b2")


def near_classes(hashed: DataFrame, tenths: int = 7) -> DataFrame:
    """All pairs (``a``, ``a2``, ``b``, ``b2``) of different classes that are near-duplicates, each once."""
    n = hashed.count()
    parts = _parts(hashed.sparkSession, 12 * n)
    order = word_order(hashed, n)
    maybe = materialize(candidates(matrix(hashed, order, tenths, parts), tenths, parts), "candidates")
    out = materialize(confirmed(maybe, coded(hashed, order), tenths).distinct(), "pairs")
    drop(maybe)
    return out


def _members(hashed: DataFrame) -> DataFrame:
    return materialize(hashed.select("uid", "uid2", "space", "id"), "members")


def near_duplicates(rows: DataFrame, tenths: int = 7) -> DataFrame:
    """All pairs (``space``, ``id_a`` < ``id_b``) of near-duplicate rows, copies included.

    ``rows``: ``space`` int, ``id`` long, ``text`` string.
    """
    hashed = hashed_rows(rows.select("space", "id", "text"))
    members = _members(hashed)
    between = near_classes(hashed, tenths)
    drop(hashed)
    own = members.groupBy("uid", "uid2").agg(F.count("*").alias("n")).filter("n > 1")
    own = own.select(F.col("uid").alias("a"), F.col("uid2").alias("a2"), F.col("uid").alias("b"), F.col("uid2").alias("b2"))
    left = members.select(F.col("uid").alias("a"), F.col("uid2").alias("a2"), "space", F.col("id").alias("x"))
    right = members.select(F.col("uid").alias("b"), F.col("uid2").alias("b2"), F.col("id").alias("y"))
    pairs = between.unionByName(own).join(left, ["a", "a2"]).join(right, ["b", "b2"])
    pairs = pairs.filter((F.col("a") != F.col("b")) | (F.col("a2") != F.col("b2")) | (F.col("x") < F.col("y")))
    return pairs.select("space", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_groups(rows: DataFrame, tenths: int = 7) -> DataFrame:
    """The class form: (``space``, ``id``, ``class_id``, ``links``) of every row with words enough.

    ``class_id`` is the least id with the same words and ``links`` the number of other classes that are near-duplicates of it.
    """
    hashed = hashed_rows(rows.select("space", "id", "text"))
    members = _members(hashed)
    between = near_classes(hashed, tenths)
    drop(hashed)
    ends = F.array(F.struct(F.col("a").alias("uid"), F.col("a2").alias("uid2")), F.struct(F.col("b").alias("uid"), F.col("b2").alias("uid2")))
    links = between.select(F.explode(ends).alias("e")).select("e.*").groupBy("uid", "uid2").agg(F.count("*").alias("links"))
    heads = members.groupBy("uid", "uid2").agg(F.min("id").alias("class_id")).join(links, ["uid", "uid2"], "left")
    return members.join(heads, ["uid", "uid2"]).select("space", "id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
