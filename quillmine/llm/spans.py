"""Long exact spans shared between records (problem 10).

1. Every text gives anchors: the hashes of ``KEY`` characters that are least in some window of
   ``length - KEY + 1`` positions.  Any run of ``length`` characters that two texts have in common
   holds such a window, so both texts have an anchor there.
2. Anchors of two or more different texts are confirmed as recurring passages.  Their phrases are
   compiled into Aho-Corasick automata, sharded by the text that a phrase was first met in, and
   each text with a recurring anchor is streamed through its shards to find every occurrence.
3. Occurrences of one phrase are extended by up to ``length - KEY`` characters to both sides; two
   that agree on ``length`` characters in all share a span.  Phrases met in very many texts
   are not compared pair by pair: their texts are grouped by each run of ``length`` characters
   around the phrase, so that only pairs which do share a run are ever formed; of the runs that the
   same texts share only one forms them, and shared lengths need no pairs at all.  Both ways give
   the same rows.

Texts that are copies of one another are searched once, and their rows are put back at the end.

Defined results: null texts and texts shorter than ``length`` share nothing; a character is a code
point; a passage that recurs only inside one text isn't shared; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.session import drop, materialize, work_path

LENGTH, KEY = 200, 100
PHRASES_A_SHARD = 15_000
COMPARED_UP_TO = 64
CHARS_AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(texts: list[str], length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the anchors of texts, each of at least ``length`` characters."""
    width = length - key + 1
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(data)
    power = np.full(n, _BASE, np.uint64)
    power[:1] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    back = np.full(n - key + 1, _INVERSE, np.uint64)
    back[:1] = 1
    np.cumprod(back, out=back)
    h = (total[key:] - total[:-key]) * back
    del power, total, back
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    least = _slide(h, width, np.minimum)
    # windows that reach into the next text choose nothing
    for end in ends[:-1].tolist():
        least[max(0, end - length + 1) : end] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((_slide(padded, width, np.maximum) == h) & (h != 0))
    text = np.searchsorted(ends, at, side="right")
    return text, at - (ends - lengths)[text], h[at]


def _pieces(texts: list[str], length: int) -> tuple[list[str], list[int], list[int]]:
    """(pieces, text number, offset): long texts in overlapping pieces that between them hold every window."""
    pieces, owner, offset = [], [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHARS_AT_ONCE):
            pieces.append(text[at : at + CHARS_AT_ONCE + length - 1])
            owner.append(i)
            offset.append(at)
    return pieces, owner, offset


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHARS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _anchor_rows(length: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owner, offset = _pieces(batch.column(1).to_pylist(), length)
            uid, begin = batch.column(0).to_numpy()[owner], np.array(offset, np.int64)
            for a, b in _slices(texts):
                text, at, h = anchors(texts[a:b], length, key)
                # the same phrase again in one text says nothing new
                order = np.lexsort((at, h, text))
                text, at, h = text[order], at[order], h[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(text)]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(uid[a + text[new]]), pa.array(begin[a + text[new]] + at[new])], names=["phrase", "uid", "at"])

    return run


@lru_cache(maxsize=2)
def _automaton(path: str, shard: int):
    import ahocorasick
    from pyarrow import fs
    from pyarrow import parquet as pq

    files, root = fs.FileSystem.from_uri(f"{path}/shard={shard}")
    found = ahocorasick.Automaton()
    for info in files.get_file_info(fs.FileSelector(root)):
        if info.path.endswith(".parquet"):
            rows = pq.ParquetFile(files.open_input_file(info.path)).read(columns=["phrase", "words", "many"])
            for phrase, words, many in zip(*(rows.column(c).to_pylist() for c in ("phrase", "words", "many")), strict=True):
                found.add_word(words, (phrase, many))
    if len(found):
        found.make_automaton()
    return found


def _occurrences(path: str, length: int, key: int):
    reach = length - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for shard, uid, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                automaton = _automaton(path, shard)
                if not len(automaton):
                    continue
                for end, (phrase, many) in automaton.iter(text):
                    at = end + 1 - key
                    out.append((phrase, many, uid, at, text[max(0, at - reach) : at], text[end + 1 : end + 1 + reach], text[at : end + 1] if many else None))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["phrase", "many", "uid", "at", "left", "right", "words"])

    return run


def _agree(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _shared(length: int, key: int):
    reach = length - key
    names = ["a", "b", "low_a", "high_a", "low_b", "high_b"]

    def pairs(rows: list[tuple]) -> Iterator[tuple]:
        for i, (uid, at, left, right) in enumerate(rows):
            for other, there, left2, right2 in rows[i + 1 :]:
                if uid != other:
                    before, after = _agree(left, left2), _agree(right, right2)
                    if before + after >= reach:
                        one, two = (uid, at - before, at + key + after), (other, there - before, there + key + after)
                        if uid > other:
                            one, two = two, one
                        yield one[0], two[0], *one[1:], *two[1:]

    def by_runs(rows: list[tuple]) -> Iterator[tuple]:
        """The same for a phrase that comes very often inside few texts: occurrences meet by equal surroundings."""
        met: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for uid, at, left, right in rows:
            for before in range(max(0, reach - len(right)), min(len(left), reach) + 1):
                met.setdefault((left[:before], right[: reach - before]), []).append((uid, at - before))
        for places in met.values():
            firsts = dict(reversed(places))
            if len(firsts) > 1:
                one, two = sorted(firsts)[:2]
                links = [(x, low, y, firsts[y]) for x, low in places for y in ((one if x != one else two),)]
                links += [(x, firsts[x], y, firsts[y]) for x in firsts for y in firsts if x < y]
                for x, low, y, other in links:
                    yield (x, y, low, low + length, other, other + length) if x < y else (y, x, other, other + length, low, low + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*set(pairs(rows) if len(rows) <= 4 * COMPARED_UP_TO else by_runs(rows)), strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        current, rows, held = None, [], []
        for batch in batches:
            for phrase, uid, at, left, right in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if phrase != current:
                    if len(rows) > 1:
                        held.append(group(rows))
                    current, rows = phrase, []
                rows.append((uid, at, left[::-1], right))
            if len(held) > 500:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if len(rows) > 1:
            held.append(group(rows))
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _runs(length: int, key: int):
    """Every run of ``length`` characters around an occurrence, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for uid, at, left, words, right in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                around, low = left + words + right, at - len(left)
                data = around.encode("utf-32-le", "surrogatepass")
                out += [(xxhash.xxh3_64_intdigest(data[4 * i : 4 * (i + length)]) - 2**63, uid, low + i) for i in range(len(around) - length + 1)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["run", "uid", "low"])

    return run


def shared_spans(members: DataFrame, texts: DataFrame, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, DataFrame]:
    """(pairs, runs) that different texts share.

    Pairs (a, b, low_a, high_a, low_b, high_b) are of phrases in few texts, runs (run, uid, low) of those in many: each run
    of ``length`` characters around such a phrase that more than one text has.  Pieces of one shared run overlap or touch.
    ``members``: ``doc_id``, ``uid``; ``texts``: ``doc_id``, ``uid``, ``text`` of at least ``length`` characters.
    """
    spark = texts.sparkSession
    found = materialize(texts.select("uid", "text").mapInArrow(_anchor_rows(length, key), "phrase long, uid long, at long").dropDuplicates(["phrase", "uid"]), "anchors")
    recurring = found.groupBy("phrase").agg(F.count("*").alias("n"), F.min(F.struct("uid", "at")).alias("first")).filter("n > 1")
    recurring = materialize(recurring.select("phrase", "n", F.col("first.uid").alias("source"), F.col("first.at").alias("at")), "recurring")
    shards = 1 + recurring.count() // PHRASES_A_SHARD
    shard = F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int")
    once = members.groupBy("uid").agg(F.min("doc_id").alias("doc_id"))

    # a text goes to the shards of its recurring anchors; its own phrases are cut out on the way
    routed = found.select("phrase", "uid").join(recurring.select("phrase", shard.alias("shard")), "phrase").select("uid", "shard").distinct()
    sent = materialize(routed.groupBy("uid").agg(F.collect_set("shard").alias("shards")).join(once, "uid").join(texts.select("doc_id", "text"), "doc_id").select("uid", "shards", "text"), "sent")
    cut = recurring.join(sent.select(F.col("uid").alias("source"), "text"), "source")
    cut = cut.select("phrase", F.expr(f"substring(text, cast(at as int) + 1, {key})").alias("words"), (F.col("n") > COMPARED_UP_TO).alias("many"), shard.alias("shard"))
    path = work_path(spark, "phrases")
    cut.repartition("shard").write.partitionBy("shard").parquet(path)

    stream = sent.select(F.explode("shards").alias("shard"), "uid", "text")
    stream = stream.repartition("shard", F.pmod("uid", F.lit(32))).sortWithinPartitions("shard")
    kinds = "phrase long, many boolean, uid long, at long, left string, right string, words string"
    met = materialize(stream.mapInArrow(_occurrences(path, length, key), kinds), "occurrences")
    few = met.filter("not many").select("phrase", "uid", "at", "left", "right").repartition("phrase").sortWithinPartitions("phrase")
    piece = "a long, b long, low_a long, high_a long, low_b long, high_b long"
    near = few.mapInArrow(_shared(length, key), piece)
    runs = materialize(met.filter("many").select("uid", "at", "left", "words", "right").mapInArrow(_runs(length, key), "run long, uid long, low long").distinct(), "runs")
    for used in (found, recurring, sent):
        drop(used)
    return near, runs


def _run_pairs(runs: DataFrame) -> DataFrame:
    """(a, b) of texts that have a run in common.  Of runs with the same texts only one is crossed."""
    once = runs.select("run", "uid").distinct()
    texts = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "uid")).alias("y"))
    sets = once.groupBy("run").agg(texts.alias("texts")).filter("texts.n > 1").groupBy("texts").agg(F.min("run").alias("run"))
    kept = once.join(sets.select("run"), "run")
    return kept.select("run", F.col("uid").alias("a")).join(kept.select("run", F.col("uid").alias("b")), "run").filter("a < b").select("a", "b")


#: Texts whose first 64 bits are those of another; some three are expected among 10^10.
CLASHES = 1_000


def _texts(df: DataFrame, doc_id: Column, text: Column, length: int) -> tuple[DataFrame, DataFrame]:
    """(members, texts): ``uid`` names the text.  It has 64 bits; texts that clash in them are named by other ones."""
    rows = df.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).filter(F.length("text") >= length)
    again = F.xxhash64(F.lit("second"), "text")
    rows = rows.select("doc_id", F.xxhash64("text").alias("uid"), again.alias("again"), F.length("text").alias("n"), "text")
    clash = rows.groupBy("uid").agg(F.min("again").alias("low"), F.max("again").alias("high")).filter("low <> high").select("uid").limit(CLASHES + 1).collect()
    if len(clash) > CLASHES:
        raise ValueError(f"more than {CLASHES} texts clash in 64 bits")
    if clash:
        rows = rows.withColumn("uid", F.when(F.col("uid").isin([r["uid"] for r in clash]), F.col("again")).otherwise(F.col("uid")))
    return rows.select("doc_id", "uid", "n"), rows.select("doc_id", "uid", "text")


def sharing_pairs(df: DataFrame, doc_id: Column, text: Column, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of all documents that share a run of at least ``length`` characters."""
    members, texts = _texts(df, doc_id, text, length)
    near, runs = shared_spans(members, texts, length, key)
    pairs = near.select("a", "b").unionByName(_run_pairs(runs)).distinct()
    copies = members.groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b"))
    left, right = members.select(F.col("uid").alias("a"), F.col("doc_id").alias("x")), members.select(F.col("uid").alias("b"), F.col("doc_id").alias("y"))
    every = pairs.unionByName(copies).join(left, "a").join(right, "b").filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return every.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def shared_share(df: DataFrame, doc_id: Column, text: Column, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every row: characters in runs of ``length`` that another row has too."""
    members, texts = _texts(df, doc_id, text, length)
    spans, runs = shared_spans(members, texts, length, key)
    sides = F.array(F.struct(F.col("a").alias("uid"), F.col("low_a").alias("low"), F.col("high_a").alias("high")), F.struct(F.col("b").alias("uid"), F.col("low_b").alias("low"), F.col("high_b").alias("high")))
    # a run needs another text, not the pair of every two texts that have it
    met = runs.groupBy("run").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).filter("first <> last").select("run")
    far = runs.join(met, "run", "left_semi").select("uid", "low", (F.col("low") + length).alias("high"))
    pieces = spans.select(F.explode(sides).alias("p")).select("p.*").unionByName(far).distinct()
    # union of intervals: a text's pieces fold into maximal runs in order of their beginning
    folded = pieces.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("s"))
    covered = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["sum"] + F.greatest(x["high"] - F.greatest(x["low"], acc["to"]), F.lit(0))).alias("sum"), F.greatest(acc["to"], x["high"]).alias("to")),
        lambda acc: acc["sum"],
    )
    folded = folded.select("uid", covered.alias("shared"))
    copies = members.groupBy("uid").agg(F.count("*").alias("copies"))
    judged = members.join(copies, "uid").join(folded, "uid", "left").select("doc_id", F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("shared", F.lit(0))).cast("long").alias("shared_chars"))
    rows = df.select(doc_id.cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return rows.join(judged, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0).cast("long")).alias("shared_chars"))
