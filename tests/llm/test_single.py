"""Operators on single records and groups: nulls, empties, ties, repeats, extra columns."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmine.llm import mapping, packing, scans, survivor, tokenizer, topn
from quillmine.session import work_path

# ------------------------------------------------------------- top n

TOPN = "subject string, module int, score double, year int, id int, rank_no int, only string"


def top(spark, rows, n, **options):
    df = spark.createDataFrame(rows, TOPN)
    out = topn.top_n(df, {"subject": F.upper(F.trim("subject")), "module": F.col("module")}, F.col("score"), [("year", F.col("year"), False), ("id", F.col("id"), True)], n, **options)
    return sorted((r["subject"], r["module"], r["rank_no"], r["id"]) for r in out.collect())


def brute_top(rows, n):
    groups = {}
    for s, m, x, y, i, *_ in rows:
        if s is not None and m is not None and x is not None and not math.isnan(x):
            groups.setdefault((s.strip().upper(), m), []).append((-x, y is None, -(y or 0), i))
    return sorted((*g, k + 1, r[3]) for g, v in groups.items() for k, r in enumerate(sorted(v)[:n]))


def test_top_n(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3_000):
        hot = rng.random() < 0.4
        s = "hot" if hot else rng.choice([" a", "A", "b ", None, "c%d" % rng.randint(0, 40)])
        rows.append((s, 1 if hot else rng.choice([1, 2, None]), rng.choice([None, float("nan"), 1.0, 2.0, 2.0, rng.random()]), rng.choice([None, 2020, 2021]), i, 0, "x"))
    for size in (None, 20):
        assert top(spark, rows, 5, row_group_rows=size) == brute_top(rows, 5)
    assert top(spark, rows[:50] * 2, 3) == brute_top(rows[:50] * 2, 3)
    assert top(spark, [], 5) == []


def test_top_n_skips_and_is_kept(spark):
    """A group of many row groups is read from its top only; a second batch is clustered beside the first."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"s{rng.randint(0, 3)}", 1, round(rng.random(), 3), None, i, 0, "x") for i in range(6_000)]
    path = work_path(spark, "kept")
    group, ties = {"subject": F.upper(F.trim("subject")), "module": F.col("module")}, [("year", F.col("year"), False), ("id", F.col("id"), True)]
    for part in (rows[:4_000], rows[4_000:]):
        topn.Clustered.open(spark, path).append(spark.createDataFrame(part, TOPN), group, F.col("score"), ties, row_group_rows=100)
    kept = topn.Clustered.open(spark, path)
    assert sorted((r["subject"], r["module"], r["rank_no"], r["id"]) for r in kept.top(5).collect()) == brute_top(rows, 5)
    assert kept.skipped > kept.read > 0
    kept.drop()


# ------------------------------------------------------------- survivors


def test_survivors(spark):
    rows = [("k", 1, 2020, "old but gold", 1), ("k", 2, 2022, "new", 5), ("k", 3, 2022, "newer text", 5), ("k", 4, None, "the longest text of all", 9), ("k", 4, None, "the longest text of all", 9), ("n", 5, None, None, 1), ("n", 6, None, "x", 1), (None, 7, 2024, "lost", 1), ("one", 8, 2024, "alone", 1)]
    df = spark.createDataFrame(rows, "key string, id int, year int, text string, votes int").withColumn("value", F.lit("clash"))

    def choose(norm, trust, decay, least=2):
        field = survivor.Field("text", F.col("text"), F.length("text") >= 2, norm, trust, (F.col("year"), F.length("text")))
        out = survivor.survivors(df, F.col("key"), F.col("id"), F.col("year"), [field], decay, 2025, least)
        return {r["key"]: (r["copies"], r["text"], r["text_id"]) for r in out.collect()}

    assert choose(F.col("id"), F.lit(1.0), 0.5) == {"k": (5, "newer text", 3), "n": (2, None, None)}
    # two older rows with one wording outvote a newer one when trust says so
    assert choose(F.substring("text", 1, 3), F.col("votes"), 0.99, 1)["k"] == (5, "newer text", 3)
    assert choose(F.col("id"), F.lit(1.0), 0.5, 1)["one"] == (1, "alone", 8)


# ------------------------------------------------------------- mapping


@pytest.fixture(scope="module")
def mappers():
    codes = [("BMT203", "Spatial Lattice Laboratory"), ("BEL406", "Eager Bus Theory"), ("BEL407", "Two Names"), ("BAR101", "Two Names"), ("BAR204A", "Wide Word Works")]
    months = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
    return (
        mapping.Mapper([(c, c) for c, _ in codes], [(n, c) for c, n in codes], [], {}),
        mapping.Mapper([(m, m) for m in months], [], [(m[:3], m) for m in months] + [("sept", "September")], {i + 1: m for i, m in enumerate(months)}),
    )


@pytest.mark.parametrize("value, code", [
    ("bmt 203", "BMT203"), ("B.M.T203", "BMT203"), ("8MTZO3", "BMT203"), ("code=BMT203", "BMT203"), ("BMT203 (22 scheme)", "BMT203"), ("BMTX03", "BMT203"), ("MBT203", "BMT203"),
    ("spatial latice laboratory", "BMT203"), ("BEL407 - Two Names", "BEL407"), ("Two Names", "unmatched"), ("BAR204", "BAR204A"), ("KXW4737T", "unmatched"), ("", "unmatched"), ("?? ", "unmatched"),
    ("BE1406", "BEL406"), ("BEL40", "unmatched"), ("code=BMT23 x", "BMT203"), (" ".join("spatial lattice laboratory".replace(" ", "")), "BMT203"), ("x" * 10_000, "unmatched"),
])
def test_codes(mappers, value, code):
    assert mappers[0](value) == code


@pytest.mark.parametrize("value, month", [
    ("JUL.", "July"), ("ju1y", "July"), ("09", "September"), ("13", "unmatched"), ("00", "unmatched"), ("Mrach", "March"), ("Jan'2024", "January"), ("(May)", "May"), ("Odd sem", "unmatched"),
    ("not known", "unmatched"), ("Winter session", "unmatched"), ("Sept 2021", "September"), ("Dec/Jan", "unmatched"), ("05/2024", "May"),
])
def test_months(mappers, value, month):
    assert mappers[1](value) == month


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abc", max_size=6), st.integers(0, 3))
def test_automaton(entries, word, limit):
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    trie = mapping.Trie()
    for e in entries:
        trie.add(e, e)
    assert trie.within(word, limit) == {e: far(word, e) for e in entries if far(word, e) <= limit}


def test_map_values(spark, mappers):
    df = spark.createDataFrame([(1, "bmt203", None), (2, "BMT203", "May"), (3, None, "x"), (3, None, "x")], "id int, code string, month string").withColumn("field", F.lit(1))
    out = mapping.map_values(df, F.col("id"), {"code": (F.col("code"), mappers[0], frozenset(["BMT203"])), "month": (F.col("month"), mappers[1], frozenset(["May"]))})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "code", "BMT203"), (3, "month", "unmatched"), (3, "month", "unmatched")]


# ------------------------------------------------------------- tokenizer


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    return tokenizer.Transducer.load(), library


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab the ing'sll 12\n\t<|endoftext|>éಬ😀", max_size=80))
def test_tokens(both, text):
    mine, library = both
    text = text.encode("utf-8", "ignore").decode()
    ids = mine.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids and mine.decode(ids) == text and mine.count(text) == len(ids)


def test_long_words(both):
    mine, library = both
    for text in ("a" * 5_000, "ab" * 3_000, "ಬ" * 900, " " * 3_000, "<|endoftext|>"):
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_corpus(spark):
    df = spark.createDataFrame([(1, "hello hello"), (2, ""), (3, None), (1, "hello hello")], "doc_id long, text string").withColumn("ids", F.lit(1))
    out = sorted((r["doc_id"], r["ids"]) for r in tokenizer.encode_corpus(df, F.col("doc_id"), F.col("text")).collect())
    assert [len(x) for _, x in out] == [2, 2, 0, 0]
    assert tokenizer.encode_corpus(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_broken_bytes():
    assert "".join(tokenizer.decode_stream(iter([b"a\xc3", b"\xa9\xff", b"\xe0\xb2", b"x", b"\xf0\x9f"]))) == "aé��x�"


# ------------------------------------------------------------- packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_evolve(sizes, capacity):
    bins = packing.evolve(sizes, capacity, 7, None)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= len(packing.best_fit(list(range(len(sizes))), sizes, capacity, []))


def test_evolve_beats_best_fit():
    """Containers cut at random have a perfect packing, which best fit misses and the islands find."""
    rng, capacity = random.Random(1), 2_048
    sizes = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, capacity), rng.randint(2, 7)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, capacity], strict=True)]
    rng.shuffle(sizes)
    assert len(packing.best_fit(list(range(len(sizes))), sizes, capacity, [])) == 61
    islands = [packing.evolve(sizes, capacity, k, None) for k in range(packing.ISLANDS)]
    for epoch in range(1, packing.EPOCHS):
        islands = [packing.evolve(sizes, capacity, 100 * epoch + k, islands[k - 1]) for k in range(packing.ISLANDS)]
    assert min(map(len, islands)) == 60


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "DISTRICT", 40)
    rng = random.Random(4)
    rows = [(i, rng.choice([0, rng.randint(1, 100), rng.randint(1, 30), 100, 250])) for i in range(300)] + [(1, 35), (1, 35), (None, 9), (900, None)]
    df = spark.createDataFrame(rows, "item long, size long").withColumn("piece", F.lit("clash"))
    out = packing.pack(df, 100).collect()
    fill, of = {}, {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        of[r["item"]] = of.get(r["item"], 0) + r["size"]
    want = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert of == want and max(fill.values()) <= 100
    assert len({(r["item"], r["piece"]) for r in out}) == len(out)
    assert len(fill) <= 1.05 * math.ceil(sum(want.values()) / 100) + 1
    # nothing is cut unless it is longer than a container
    assert sorted(r["size"] for r in out if r["item"] == 1) == sorted(x for i, n in rows if i == 1 and n for x in [100] * (n // 100) + [n % 100] * (n % 100 > 0))
    assert packing.pack(df.limit(0), 100).count() == 0


# ------------------------------------------------------------- scans

CLEAN = ["Explain the high-pass filter and the state of the memory in detail.", "Describe how the switch works when the table is full.", "With example define the tree."] * 5


HEADED = [
    ("BPC101 / 2022 scheme", "The memory of the switch is"), ("BPC101 / 2022 scheme 3", "Describe a table and"), ("USN: ________   BGM102 4", "Explain the"), ("USN: ________   BGM102", "With example the tree"),
]


@pytest.mark.parametrize("text, kinds", [
    ("Explain the fil-\nter and the memory", {"hyphen"}), ("Explain the high-\npass filter", set()), ("Explain the mem¬\nPg. 3\nory", {"hyphen", "page_no"}), ("Explain fhe filter", {"misread"}),
    ("Explain the filter\nBPC101 / 2022 scheme", {"header"}), ("USN: ________   BPC101 4\nExplain the filter", {"header", "page_no"}), ("Explain the filter |\n7", set()), ("Explain th@t", {"misread"}),
    ("Explain the\nfilter and the\nmemory", set()), ("", set()), (None, set()), ("Describe the filter\nExplain the high-pass filter", set()), ("Explain w1th the filter", {"misread"}), ("Explain K1 and RS8", set()),
    ("1 of 2\nExplain", {"page_no"}), ("word " * 20_000, set()), ("Explain the fil-\nten and", {"hyphen", "misread"}), ("Define ex@mp1e", {"misread"}),
])
def test_noise(spark, text, kinds):
    others = [(7, 10 + i, f"{b}\n{h}" if i % 2 else f"{b} {i}\n{h}\nmemory {i}", "BPC101", None) for i, (h, b) in enumerate(HEADED)]
    scanned = spark.createDataFrame([(3, 1, text, "BPC101", None), *others], "paper_id int, id int, text string, code string, name string").withColumn("word", F.lit("clash"))
    clean = spark.createDataFrame([(t,) for t in [*CLEAN, "that with word", "a copy is it", None, ""]], "text string")
    found = {r["id"]: set(r["kinds"]) for r in scans.decoded(scanned, clean).collect()}
    assert found[1] == kinds


def test_headers_recur(spark):
    """A line is a header if it recurs between different neighbours and isn't running text; a question set again is none."""
    rows = [(1, i, f"Explain tree {i}\nLine Of The House\nand memory {i}") for i in range(3)] + [(2, 10 + i, "Define Pudim and\nSikon Of Welkos\nwith a table") for i in range(3)]
    rows = [(p, i, t.replace("and memory", f"m{i} and")) for p, i, t in rows]
    rows += [(3, 20 + i, f"Alone a{i}\nWith example define the tree\nb{i} switch") for i in range(3)] + [(4, 30, "State why, with example define the tree.")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "paper_id int, id int, text string, code string, name string")
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    assert {r["id"]: r["headers"] for r in scans.header_lines(df, clean).collect()} == {0: [1], 1: [1], 2: [1]}


def test_repair(spark):
    rows = [(1, "Explain fhe fil-\nter and the mem\xad\n- 2 -\nory in\ndetail."), (2, None), (3, ""), (4, "Explain the me mory and theswitch"), (5, "Describe the high-\npass fi1ter in\ndeta¬\nil.")]
    scanned = spark.createDataFrame([(1, *r, None, None) for r in rows], "paper_id int, id int, text string, code string, name string")
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    out = {r["id"]: r["text"] for r in scans.decoded(scanned, clean).collect()}
    assert out == {1: "Explain the filter and the memory in detail.", 2: None, 3: "", 4: "Explain the memory and the switch", 5: "Describe the high-pass filter in detail."}
    assert scans.decoded(scanned.limit(0), clean).count() == 0


def test_repair_of_planted_noise(spark):
    """Clean texts with planted noise come back as they were, and so do the kinds."""
    rng = random.Random(5)
    words = ["explain", "memory", "filter", "switching", "describe", "structure", "hierarchy", "compiler", "register", "diagram", "pipeline", "scheduler", "translation", "boundary", "the", "of", "and", "with"]
    clean, noisy = [], []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(24))
        clean.append(text)
        parts, kinds = text.split(), set()
        if rng.random() < 0.5:
            at = next((k for k in rng.sample(range(24), 24) if parts[k].find("e") > 0), None)
            if at is not None:
                parts[at], kinds = parts[at].replace("e", "c", 1) if not parts[at].startswith("e") else parts[at], kinds | {"misread"} if not parts[at].startswith("e") else kinds
        if rng.random() < 0.5:
            k = next((k for k in rng.sample(range(8, 16), 8) if len(parts[k]) > 6 and parts[k] in words), None)
            if k:
                parts[k], kinds = parts[k][:3] + rng.choice("-¬\xad‐") + "\n" + parts[k][3:], kinds | {"hyphen"}
        stream = " ".join(parts)
        if rng.random() < 0.3:
            stream, kinds = stream + "\n- 3 -", kinds | {"page_no"}
        noisy.append((1, i, stream, None, None, kinds))
    scanned = spark.createDataFrame([r[:5] for r in noisy], "paper_id int, id int, text string, code string, name string")
    out = {r["id"]: r for r in scans.decoded(scanned, spark.createDataFrame([(t,) for t in clean], "text string")).collect()}
    assert {i: set(r["kinds"]) for i, r in out.items()} == {r[1]: r[5] for r in noisy}
    assert {i: r["text"] for i, r in out.items()} == dict(enumerate(clean))


def test_paragraphs():
    lines = ["The first paragraph runs on over", "two lines.", "", "The second one starts after a gap and", "ends here."]
    assert [len(p) for p in scans.paragraphs(lines)] == [2, 2]
    assert scans.paragraphs([]) == []
    assert len(scans.paragraphs(["A full line that ends with a stop."] * 5_000)) == 1


def test_scan_words_and_edges_once(monkeypatch):
    """Words split through tables are those of the pattern, triples those spelled out; a word's edges are made once."""
    for text in ("Don't re-use_it: CO2 @ 5%\n-the END", "Größe naïve x²", "", "\x1c_a\x00b"):
        assert scans.plain_words(text, scans.AS_WRITTEN) == scans.PLAIN.findall(text)
        low = text.lower()
        assert scans.plain_words(low, scans.IN_LOWER) == scans.PLAIN.findall(low)
        if text.isascii():
            assert scans.plain_words(text, scans.FOLDED) == scans.PLAIN.findall(low.translate(scans._FOLD_LETTERS))
    words = ["banana", "the", "aaaa"]
    rows = next(scans._count_triples(iter([pa.RecordBatch.from_arrays([pa.array([w])], names=["word"]) for w in words])))
    got = {scans.SIGNS[t // 784] + scans.SIGNS[t // 28 % 28] + scans.SIGNS[t % 28]: n for t, n in zip(*(c.to_pylist() for c in rows.columns), strict=True)}
    assert got == Counter(f"^{w}$"[i : i + 3] for w in words for i in range(len(w)))
    made, edges = [], scans.word_edges
    monkeypatch.setattr(scans, "word_edges", lambda *a: made.append(a[0]) or edges(*a))
    lexicon = scans.Lexicon({"state": 50, "the": 90}, 1_000)
    told = {"thcorem": {"theorem": (7, 0)}}
    for _ in range(3):
        assert scans.decode(scans.pieces_of("State the thcorem, the thcorem."), lexicon, told) == ("State the theorem, the theorem.", {"misread"})
    assert made == ["thcorem"]
