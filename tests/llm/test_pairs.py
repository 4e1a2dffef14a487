"""Operators on pairs and copies against brute force on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmine.llm import history, ledger, similarity, spans
from quillmine.session import work_path

WORD = re.compile(r"[^\W_]+")


def words(text):
    return set(WORD.findall(text.lower()))


def alike(a, b):
    a, b = words(a), words(b)
    return min(len(a), len(b)) >= 8 and len(a & b) * 10 >= len(a | b) * 7


def texts(seed, n=160):
    rng = random.Random(seed)
    bank = ["the", "of", "and", "a", "state", "explain"] + [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(bank)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(bank) for _ in range(rng.randint(0, 25))))
    return [*out, "", "  ", "ONE two, three four five six seven EIGHT", "one two three four five six seven eight"]


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "space int, id long, text string").withColumn("uid", F.lit("clash"))
    return {tuple(r) for r in similarity.near_duplicates(df).select("space", "id_a", "id_b").collect()}


@pytest.mark.parametrize("alone, paired", [(2_000, 50_000), (3, 8), (0, 2)])
def test_near_duplicates(spark, monkeypatch, alone, paired):
    # low limits send words through pairs and threes as well
    monkeypatch.setattr(similarity, "ALONE_UP_TO", alone)
    monkeypatch.setattr(similarity, "PAIRED_UP_TO", paired)
    found = [(s, i, t) for s in (0, 1) for i, t in enumerate(texts(s))] + [(0, 999, None)]
    want = {(s, i, j) for s, i, a in found for z, j, b in found if s == z and i < j and a and b and alike(a, b)}
    assert pairs_of(spark, found) == want and want


def test_near_duplicates_of_nothing(spark):
    assert pairs_of(spark, []) == set()


@pytest.mark.parametrize("alone", [2_000, 0])
def test_long_columns_in_blocks(spark, monkeypatch, alone):
    monkeypatch.setattr(similarity, "ALONE_UP_TO", alone)
    rows = [(0, i, t) for i, t in enumerate(texts(5))]
    hashed = similarity.hashed_rows(spark.createDataFrame(rows, "space int, id long, text string"))
    order = similarity.word_order(hashed, len(rows))
    sure = []
    for long in (similarity.LONG, 3):
        pairs = similarity.candidates(similarity.matrix(hashed, order, 7, 4), 7, 4, long)
        sure.append({tuple(r) for r in similarity.confirmed(pairs, similarity.coded(hashed, order), 7).collect()})
    assert sure[0] == sure[1] and sure[0]


def test_one_handle_for_two_classes(spark):
    """Classes whose first 64 bits collide are still told apart."""
    a, b = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(10))
    rows = [(0, 1, a), (0, 2, a + " more"), (0, 3, b), (0, 4, b + " other")]
    hashed = similarity.hashed_rows(spark.createDataFrame(rows, "space int, id long, text string"))
    same = hashed.withColumn("uid", F.when(F.col("id").isin(1, 3), 7).otherwise(F.col("id")).cast("long"))
    order = similarity.word_order(hashed, 4)
    pairs = spark.createDataFrame([(2, 7), (4, 7)], "a long, b long")
    assert {(r["a"], r["b"]) for r in similarity.confirmed(pairs, similarity.coded(same, order), 7).collect()} == {(2, 7), (4, 7)}
    names = {r["uid2"]: r["id"] for r in same.collect()}
    assert {(names[r["a2"]], names[r["b2"]]) for r in similarity.confirmed(pairs, similarity.coded(same, order), 7).collect()} == {(2, 1), (4, 3)}


def test_words_with_one_32_bit_hash(spark):
    """Words that a 32-bit hash can't tell apart are different words."""
    df = spark.range(400_000).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.hash("w").alias("h"))
    one, two = df.groupBy("h").agg(F.collect_list("w").alias("ws")).filter("size(ws) > 1").first()["ws"][:2]
    base = "a1 a2 a3 a4 a5 a6 a7"
    # with the words taken for one, 7 of 10 words would be shared
    rows = [(0, 1, f"{base} x1 {one}"), (0, 2, f"{base} {two} y1 y2")]
    assert not alike(rows[0][2], rows[1][2]) and len(words(rows[0][2]) & words(rows[1][2])) == 7
    assert pairs_of(spark, rows) == set()


def test_entries_per_record_stay_bounded():
    """Frequencies a hundred times as great, and long texts, don't blow up the matrix."""
    for times in (1, 100, 10_000):
        vocabulary = np.arange(1, 401, dtype=np.int64) * 7_919
        order = similarity.WordOrder(vocabulary, np.arange(1, 401), np.full(400, 60_000 * times), 800_000 * times)
        for n in (8, 30, 85, 86, 400):
            held = similarity._columns(np.zeros(1, np.int32), np.array([0, n]), vocabulary[:n], order, 7)
            assert len(held[0]) <= 3_276 + 60, (times, n, len(held[0]))


def test_long_and_short_texts_meet(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ALONE_UP_TO", 0)
    monkeypatch.setattr(similarity, "PAIRED_UP_TO", 3)
    rng = random.Random(8)
    found = []
    for k in range(12):
        base = [f"t{rng.randrange(150)}" for _ in range(rng.randint(40, 140))]
        for _ in range(4):
            found.append((0, len(found), " ".join(w for w in base if rng.random() < 0.92) + f" own{k}"))
    want = {(0, i, j) for _, i, a in found for _, j, b in found if i < j and alike(a, b)}
    assert pairs_of(spark, found) == want and len(want) > 20


def test_class_form(spark):
    rows = [(s, i, t) for s in (0, 1) for i, t in enumerate(texts(s))]
    df = spark.createDataFrame(rows, "space int, id long, text string")
    groups = {(r["space"], r["id"]): (r["class_id"], r["links"]) for r in similarity.near_groups(df).collect()}
    sets = {(s, i): frozenset(words(t)) for s, i, t in rows if len(words(t)) >= 8}
    classes = {}
    for (s, i), w in sorted(sets.items()):
        classes.setdefault((s, w), i)
    for (s, i), w in sets.items():
        links = sum(1 for z, v in classes if z == s and v != w and len(v & w) * 10 >= 7 * len(v | w))
        assert groups[s, i] == (classes[s, w], links)
    assert groups.keys() == sets.keys()


def test_history_in_one_pass_and_batch_by_batch(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 30), t) for i, t in enumerate(texts(9))] + [(900, 1, None), (901, 99, "x " * 30)]
    papers = [(p, p % 4, p % 3 != 0) for p in range(1, 31)]
    df = spark.createDataFrame(rows, "id long, paper_id int, text string").withColumn("words", F.lit(1))
    batches = spark.createDataFrame(papers, "paper_id int, batch int, accepted boolean")
    got = sorted(r[0] for r in history.seen_texts(df, batches).collect())
    of = {p: (b, a) for p, b, a in papers}
    known = [(i, *of[p], t) for i, p, t in rows if p in of and t]
    assert got == sorted(i for i, b, _, t in known if any(a and c < b and alike(t, u) for _, c, a, u in known)) and got

    # batch by batch, the history opened anew each time
    folder, seen = work_path(spark, "history"), []
    for month in range(4):
        batch = df.join(batches.filter(F.col("batch") == month), "paper_id")
        new = history.prepared(batch.select("id", "text", "accepted"))
        seen += [r["id"] for r in history.History.open(spark, folder).take(new, new.count()).collect()]
    assert sorted(seen) == got
    history.History.open(spark, folder).drop()


@pytest.mark.parametrize("alone, listed", [(0, 0), (2_000, 1)])
def test_history_by_words_alone(spark, monkeypatch, alone, listed):
    """Where no byte chunk may be looked up, chunks of words find all; the buckets grow on the way."""
    monkeypatch.setattr(similarity, "ALONE_UP_TO", alone)
    monkeypatch.setattr(history, "LISTED", listed)
    rows = [(i, t) for i, t in enumerate(texts(11))]
    kept = history.History.open(spark, work_path(spark, "history"), bucket_rows=40)
    df = spark.createDataFrame(rows, "id long, text string")
    for low, high in ((0, 40), (40, 80)):
        kept.append(df.filter(F.col("id").between(low, high - 1)))
    assert kept.state["buckets"] == 64
    late = df.filter("id >= 80")
    want = {i for i, t in rows[80:] if any(alike(t, u) for _, u in rows[:80])}
    assert {r["id"] for r in kept.check(late).collect()} == want and want
    version = kept.state["version"]
    kept.append(df.limit(0))
    assert kept.state["version"] == version
    new = history.prepared(late.select("id", "text", F.lit(False).alias("accepted")))
    by_bytes = {r["id"] for r in kept.take(new, 90, publish=False, only=history.BYTES).collect()}
    assert by_bytes < want
    kept.drop()


def test_history_grows_over_several_batches(spark):
    """Where buckets with several files are cut into more, all is found as before."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(3_000)}" for _ in range(12))) for i in range(160)]
    again = spark.createDataFrame([(1_000 + i, t if i % 2 else t.rsplit(" ", 1)[0]) for i, t in rows], "id long, text string")
    df = spark.createDataFrame(rows, "id long, text string")
    for bucket_rows, buckets in ((150, 64), (10**6, 16)):
        kept = history.History.open(spark, work_path(spark, "history"), bucket_rows=bucket_rows)
        for low in range(0, 160, 40):
            kept.append(df.filter(F.col("id").between(low, low + 39)))
        assert kept.state["buckets"] == buckets
        assert sorted(r["id"] for r in kept.check(again).collect()) == [1_000 + i for i, _ in rows]
        kept.drop()


def test_history_reads_touched_buckets_only(spark):
    """A batch reads as much of a long history as of a short one."""
    rng = random.Random(1)
    read = []
    batch = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12)))], "id long, text string")
    for n in (150, 2_400):
        kept = history.History.open(spark, work_path(spark, "history"), bucket_rows=200)
        for k in range(3):
            part = [(k * n + i, " ".join(f"{rng.randrange(10**6)}" for _ in range(12))) for i in range(n // 3)]
            kept.append(spark.createDataFrame(part, "id long, text string"))
        kept = history.History.open(spark, kept.path)
        assert kept.check(batch).collect() == []
        read.append(kept.read.value)
        kept.drop()
    assert 0 < read[1] <= 2 * read[0], read


def test_history_versions(spark):
    """A version can be written once; what a failed attempt wrote is in no manifest."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(4))], "id long, text string")
    kept = history.History.open(spark, work_path(spark, "history"))
    kept.append(df)
    stale = history.History(spark, kept.path, state=kept.state | {"version": 0})
    with pytest.raises(RuntimeError):
        stale.append(df)
    again = history.History.open(spark, kept.path)
    assert again.state == kept.state
    kept.drop()


def test_hashes(spark):
    h = "ab" * 32
    rows = [(1, f" SHA256:{h.upper()}\n", 1, True), (2, h, 2, False), (3, h, 1, True), (4, "", 3, True), (5, None, 3, True), (6, h + "0", 3, True), (7, f"sha-256={h}", 3, True), (8, h, None, True)]
    df = spark.createDataFrame(rows, "id int, h string, batch int, accepted boolean").withColumn("digits", history.hash_digits(F.col("h")))
    assert sorted(r[0] for r in history.seen_hashes(df).collect()) == [2, 7]


def test_byte_chunks(spark):
    long = " ".join(f"token{i * 7919 % 1009}" for i in range(400))
    rows = [(1, long), (2, long[:1000] + "CHANGED" + long[1000:]), (3, ""), (4, None), (5, "short")]
    df = spark.createDataFrame(rows, "id int, text string")
    batches = spark.createDataFrame([(i, 1 if i == 1 else 2, True) for i in range(1, 6)], "id int, batch int, accepted boolean")
    got = {r["id"]: (r["bytes"], r["shared"]) for r in history.coverage(history.chunk_table(df), batches).collect()}
    assert got[1] == (len(long), 0) and got[5] == (5, 0) and 3 not in got and 4 not in got
    # an insertion spoils the chunk it falls in, and no later one
    assert got[2][0] == len(long) + 7 and got[2][1] > 0.85 * len(long)


def test_ledger_opened_anew(spark):
    """A ledger outlives the object that wrote it; a batch rewrites the buckets it touches only."""
    path = work_path(spark, "ledger")
    for rows in ([(1, "a"), (2, "b"), (3, "a"), (4, None)], [(0, "a"), (9, "c")], []):
        df = spark.createDataFrame(rows, "id int, key string").withColumn("key", F.col("key").cast("binary"))
        ledger.Ledger.open(spark, path, buckets=64).add(df)
    kept = ledger.Ledger.open(spark, path)
    assert {(bytes(r["key"]), r["copies"], r["first_id"]) for r in kept.table().collect()} == {(b"a", 3, 0), (b"b", 1, 2), (b"c", 1, 9)}
    assert kept.state["buckets"] == 64 and len(set(kept.state["at"].values())) == 2
    stale = ledger.Ledger(spark, kept.path, state=kept.state | {"version": 0})
    with pytest.raises(RuntimeError):
        stale.add(spark.createDataFrame([(7, b"z")], "id int, key binary"))
    assert ledger.Ledger.open(spark, path).table().count() == 3


def test_ledger(spark):
    def key(t):
        return sorted(c for c in ("".join(WORD.findall(c.lower())) for c in t.split("|")) if c)

    rows = [(1, "A b | L2"), (2, "l2|ab."), (3, "ab"), (4, None), (5, "|"), (6, ""), (7, "AB"), (8, "ab"), (9, "É|e"), (10, "e | é")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("key", ledger.canonical_key(F.col("text"))).withColumn("copies", F.lit(9))
    want = {}
    for i, t in rows:
        if t is not None:
            want.setdefault(tuple(key(t)), []).append(i)
    want = sorted((min(v), len(v)) for v in want.values())
    for batches in ([F.lit(True)], [F.col("id") > 5, F.col("id") <= 5], [F.lit(False), F.col("id") % 2 == 0, F.col("id") % 2 == 1]):
        got = ledger.ledger_of(df, batches, buckets=4).table()
        assert sorted((r["first_id"], r["copies"]) for r in got.collect()) == want
    assert ledger.ledger_of(df.limit(0), [F.lit(True)]).table().count() == 0


def brute_spans(rows, length):
    runs = {}
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            runs.setdefault(t[k : k + length], set()).add(i)
    pairs = {(a, b) for v in runs.values() for a in v for b in v if a < b}
    share = {}
    for i, t in rows:
        hit = bytearray(len(t or ""))
        for k in range(len(t or "") - length + 1):
            if len(runs[t[k : k + length]]) > 1:
                hit[k : k + length] = b"\1" * length
        share[i] = sum(hit)
    return pairs, share


@pytest.mark.parametrize("compared", [64, 1])
def test_spans(spark, monkeypatch, compared):
    monkeypatch.setattr(spans, "COMPARED_UP_TO", compared)
    monkeypatch.setattr(spans, "CHARS_AT_ONCE", 150)
    rng = random.Random(1)
    letters = "abc dé字😀"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(15, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.4 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "a" * 45), (104, rows[0][1]), (105, "b" * 29), (106, "b" * 29)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])).withColumn("uid", F.lit("clash")).withColumn("n", F.lit(0))
    pairs, share = brute_spans(rows, 30)
    got = [tuple(r) for r in spans.sharing_pairs(df, F.col("doc_id"), F.col("text"), 30, 15).collect()]
    assert sorted(got) == sorted(pairs) and pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(df, F.col("doc_id"), F.col("text"), 30, 15).collect()} == share


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.sharing_pairs(df, F.col("doc_id"), F.col("text")).count() == 0
    assert spans.shared_share(df, F.col("doc_id"), F.col("text")).count() == 0
