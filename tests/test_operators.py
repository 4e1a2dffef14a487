"""Core operators against plain Python on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmine.functions import vectors as V
from quillmine.operators import browse, cluster, fold, headers, labels, layout, lifecycle, match, parse, scoring
from quillmine.plans import catalogue, rebuild, snapshot
from quillmine.session import qualified, work_path
from quillmine.sources import tables

# ------------------------------------------------------------- ordered folds


def test_sliding_limit(spark):
    rng = random.Random(1)
    hits = [(u, i, float(rng.randint(0, 400))) for i, u in enumerate(rng.choices([1, 2, 3, None], k=200))]
    df = spark.createDataFrame(hits, "user long, id long, at double")
    got = {r["id"]: r["ok"] for r in fold.ordered_fold(df, ["user"], ["at", "id"], ["id", "at"], "id long, ok boolean", fold.sliding_limit(2, 60.0)).collect()}
    want, times = {}, {}
    for u, i, at in sorted(hits, key=lambda h: (h[2], h[1])):
        kept = times[u] = [t for t in times.get(u, []) if at - t <= 60]
        want[i] = len(kept) < 2
        if want[i]:
            kept.append(at)
    assert got == want


def unit_rows(n, dims, seed, spaces=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(5)] + 0.4 * rng.normal(size=dims)
        rows.append((int(i % spaces), i, [float(x) for x in v / np.linalg.norm(v)]))
    return rows


def plain_clusters(vectors, threshold):
    centres, members = [], []
    for i, v in enumerate(vectors):
        sims = [c @ v for c in centres]
        best = int(np.argmax(sims)) if sims else -1
        if sims and sims[best] >= threshold:
            members[best].append(i)
            c = centres[best] + (v - centres[best]) / len(members[best])
            centres[best] = c / np.linalg.norm(c)
        else:
            centres.append(v)
            members.append([i])
    means = [np.mean([vectors[i] for i in m], axis=0) for m in members]
    bank = np.stack([m / np.linalg.norm(m) for m in means])
    out, extra = [], len(bank)
    for v in vectors:
        sims = bank @ v
        if sims.max() >= threshold:
            out.append(int(np.argmax(sims)))
        else:
            out.append(extra)
            extra += 1
    return out


def test_clusters(spark):
    rows = unit_rows(120, 8, 3)
    df = spark.createDataFrame(rows, "space int, id long, vector array<double>")
    got = {r["id"]: r["cluster"] for r in cluster.clusters(df, ["space"], 0.8).collect()}
    for space in (0, 1):
        own = [r for r in rows if r[0] == space]
        assert [got[i] for _, i, _ in own] == plain_clusters([np.array(v) for *_, v in own], 0.8)
    assert cluster.clusters(df.limit(0), ["space"], 0.8).count() == 0


def test_papers_compared(spark):
    rows = unit_rows(60, 8, 5, spaces=4)
    df = spark.createDataFrame([(i, s, v) for s, i, v in rows], "id long, paper long, vector array<double>")
    got = {(r["query_paper"], r["paper"]): r["score"] for r in match.compare_papers(df, df, 0.85).collect()}
    for a in range(4):
        for b in set(range(4)) - {a}:
            hits = [max(float(np.dot(v, w)) for t, _, w in rows if t == b) for s, _, v in rows if s == a]
            assert abs(got[a, b] - sum(np.floor(h * 1000 + 0.5) / 1000 >= 0.85 for h in hits) / len(hits)) < 0.001
    best = {r["query_paper"]: r["paper"] for r in match.best_match(match.compare_papers(df, df, 0.85)).collect()}
    assert best == {a: min((-s, b) for (x, b), s in got.items() if x == a)[1] for a in range(4)}
    near = {r["query_id"]: r["best_id"] for r in match.nearest(df.filter("id < 5"), df).collect()}
    assert near == {q: max((float(np.floor(np.dot(rows[q][2], v) * 1e6 + 0.5)), -i) for _, i, v in rows if i != q)[1] * -1 for q in range(5)}


def test_best_live_paper(spark):
    rows = [("s" if s < 40 else "t", s, v) for s, _, v in unit_rows(400, 8, 7, spaces=50)]
    df = spark.createDataFrame(rows, "subject string, paper int, vector array<double>")
    live = df.filter("paper % 3 <> 0")
    got = {r["query_paper"]: (r["paper"], r["score"]) for r in match.best_live(df, live, 0.9).collect()}
    want = {(r["query_paper"], r["paper"]): r["score"] for r in match.compare_papers(df.withColumn("id", F.monotonically_increasing_id()), live, 0.9).collect()}
    kind = {p: s for s, p, _ in rows}
    assert got == {a: (-i, s) for a in kind for s, i in [max((s, -b) for (x, b), s in want.items() if x == a and kind[b] == kind[a])]}


def test_copy_of_a_live_paper(spark, tmp_path):
    words = "paging routing caching hashing sorting queueing coding linking".split()
    papers = [(1, "approved", "S1", "a"), (2, "review", "S1", "b"), (3, "review", "S1", "a"), (4, "review", "S2", "c"), (5, "review", "S1", None)]
    spark.createDataFrame(papers, "id int, status string, subject_code string, session_key string").write.parquet(f"{tmp_path}/papers.parquet")
    asked = [(p, 1 + i % 4, f"Explain the {w} unit" if p < 5 else f"Derive some {w[::-1]} formula anew") for p, *_ in papers for i, w in enumerate(words)]
    spark.createDataFrame(asked, "paper_id int, module_no int, text string").write.parquet(f"{tmp_path}/sub_questions.parquet")
    spark.createDataFrame([("S1",), ("S2",)], "code string").write.parquet(f"{tmp_path}/subjects.parquet")
    got = {r["id"]: r["reasons"] for r in catalogue.QUERIES["paper_decisions"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "It closely matches another paper.", 3: "The session has a paper already.", 4: "", 5: ""}


# ------------------------------------------------------------- parsing and layout


def test_parse(spark):
    rows = [
        (1, ["", "", "Page 1"]), (1, ["Module – 2"]), (1, ["Q.3", "a.", "Explain the bus and its parts in detail", "08", "L2", "CO1"]), (1, ["", "", "with a neat sketch"]),
        (1, ["", "", "OR"]), (1, ["", "", "Describe the protocol stack in some depth", "", "", ""]), (1, ["", "b", "short"]), (1, None), (1, ["USN", "x"]),
        (2, ["", "", "Compare paging and segmentation with one example"]), (2, ["O22", "c", "Discuss the scheduler of a real time system", "(06—", "L 3", "CQ 2"]),
    ]
    df = spark.createDataFrame([(p, i, c) for i, (p, c) in enumerate(rows)], "paper_id int, row_no int, cells array<string>")
    got = sorted(tuple(r) for r in parse.parse_papers(df).collect())
    assert got == [
        (1, 2, 3, "a", 0, "Explain the bus and its parts in detail with a neat sketch", 8, "L2", "CO1"),
        (1, 2, 3, "b", 0, "Describe the protocol stack in some depth", None, None, None),
        (2, 1, 1, "a", 0, "Compare paging and segmentation with one example", None, None, None),
        (2, 1, 2, "c", 1, "Discuss the scheduler of a real time system", 6, "L3", "CO2"),
    ]
    assert parse.parse_papers(df.limit(0)).count() == 0


def test_layout(spark):
    words = [(1, i, t, left, top, 10, 10, "90") for i, (t, left, top) in enumerate([("Q.1", 10, 5), ("a", 140, 15), ("Explain", 200, 16), ("it", 300, 5), ("L2", 850, 45), ("x", 5, 100)])]
    words += [(1, 90, "bad", 1, 1, 1, 1, "-1"), (1, 91, " ", 1, 1, 1, 1, "5")]
    df = spark.createDataFrame(words, "page_id int, word_no int, text string, left int, top int, width int, height int, conf string")
    got = [r["cells"] for r in layout.cells(layout.centred(df), 1000).orderBy("anchor").collect()]
    assert got == [["Q.1", "a", "Explain it"], ["", "", "", "", "L2"], ["x"]]
    # the anchor is a band's first word, not the one before
    heights = spark.createDataFrame([(1, i, "w", 0, y, 0, 0, "1") for i, y in enumerate([10, 20, 26, 50])], df.schema)
    assert [r["anchor"] for r in layout.bands(layout.centred(heights)).orderBy("word_no").collect()] == [10, 10, 26, 50]


def test_headers(spark):
    known = spark.createDataFrame([("BCS502", "Computer Networks"), ("BIS502", "Computer Networks"), ("BCS501", "Software Engineering")], "code string, name string")
    rows = [
        (1, "Fifth Semester Degree Examination, Dec.2024/Jan.2025"), (1, "Computer Networks"), (2, "BCS502"), (2, "Degree Examination, Dec.2024/Jan.2025"), (2, "Software Engineering"),
        (3, "Model Question Paper"), (3, "B.E. Examination 2023"), (3, "Time: 3 hours"), (3, "Software Engineering"), (4, ""), (4, None),
    ]
    df = spark.createDataFrame([(p, i, [t]) for i, (p, t) in enumerate(rows)], "paper_id int, row_no int, cells array<string>")
    got = {r["paper_id"]: tuple(r)[1:] for r in headers.header_metadata(df, known).collect()}
    assert got[1] == (None, "Computer Networks", "January", 2025, "regular")
    assert got[2] == ("BCS502", "Computer Networks", "January", 2025, "regular")
    assert got[3] == ("BCS501", "Software Engineering", None, 2023, "mqp")
    names = spark.createDataFrame([(1, "a.pdf", "BCS501", None, 2020, "regular"), (3, "b.pdf", "UNKNOWN", "July", None, "regular"), (9, "sample.pdf", "UNKNOWN", None, None, "regular")], "paper_id int, filename string, code string, month string, year int, exam_type string")
    both = {r["paper_id"]: tuple(r)[1:] for r in headers.merged(names, headers.header_metadata(df, known)).collect()}
    assert both == {1: ("BCS501", "Computer Networks", "January", 2020, "see"), 3: ("BCS501", "Software Engineering", "July", 2023, "model"), 9: (None, None, None, None, "model")}


# ------------------------------------------------------------- scores and snapshots


def test_ladder_and_ranks(spark):
    rows = [("S", 1, t, 2, 0.5, 8.0, w, e, "label", f"text {t}", 2) for t, w, e in [(1, 1.0, 9.0), (2, 3.0, 8.0), (3, 1.0, 7.0), (4, 0.5, 6.0), (5, 0.4, 5.0)]]
    df = spark.createDataFrame(rows, "subject string, module_no int, topic_id int, total int, share double, avg_marks double, weighted_score double, expected double, label string, representative_text string, frequency int")
    ranks = scoring.ranked(df)
    assert [r["topic_id"] for r in ranks.orderBy("rank_no").collect()] == [2, 1, 3, 4, 5]
    assert [r["label"] for r in scoring.ladder(ranks.withColumn("label", F.when(F.col("rank_no") > 1, "  ")), 30.0, 2).orderBy("rank_no").collect()] == ["text 2", "text 1", "text 3", "text 4"]
    export = [tuple(r)[2:] for r in scoring.ladder(ranks, 30.0, 2).drop("label").orderBy("rank_no").collect()]
    assert export == [(1, 2, 8.0, 8.0, False), (2, 1, 9.0, 17.0, False), (3, 3, 7.0, 20.0, True), (4, 4, 6.0, 20.0, True)]
    assert scoring.ladder(ranks, 20.0, 1).count() == 3
    sheet = scoring.sheet_rows(ranks, scoring.ladder(ranks, 30.0, 2)).orderBy("rank_no").collect()
    assert [r["rank_no"] for r in sheet] == [1, 2, 3] and sheet[0]["full_at"] == 3


def test_snapshot_document(spark, small):
    rows = catalogue.QUERIES["snapshot_json"](spark, small).limit(3).collect()
    for r in rows:
        doc = json.loads(r["data"])
        assert len(doc["sessions"]) == r["paper_count"]
        assert sum(len(m["topics"]) for m in doc["modules"]) == r["topic_count"]
        assert all([t["rank_no"] for t in m["topics"]] == list(range(1, len(m["topics"]) + 1)) for m in doc["modules"])


def test_rebuild_keeps_keys(spark):
    texts = ["Explain the paging unit of the memory", "Describe the routing table of a switch"]
    questions = [(i, 1 + i % 3, 1, texts[i % 2], 8 if i % 4 else None) for i in range(12)]
    q = spark.createDataFrame(questions, "id int, paper_id int, module_no int, text string, marks int")
    p = spark.createDataFrame([(i, "approved" if i < 3 else "review", "s1", 2020 + i) for i in (1, 2, 3)], "id int, status string, subject_code string, exam_year int")
    topics, members = rebuild.topics_of(q, p)
    assert {r["representative_text"] for r in topics.collect()} == set(texts) and members.count() == 8
    old = members.select("sub_question_id", F.concat(F.lit("key"), F.col("cluster").cast("string")).alias("stable_key"))
    assert {r["stable_key"] for r in rebuild.carried(topics, members, old).collect()} == {"key0", "key1"}
    fresh = {r["stable_key"] for r in rebuild.carried(topics, members, old.limit(0)).collect()}
    assert len(fresh) == 2 and all(len(k) == 12 for k in fresh)


def test_labels_carried_by_rank(spark):
    texts = ["Explain the paging unit of the memory", "Describe the routing table of a switch"]
    # the first topic is met once, long ago; the second in two papers, so it ranks first and claims the key that both want
    q = spark.createDataFrame([(1, 1, 1, texts[0], 8), (2, 1, 1, texts[1], 8), (3, 2, 1, texts[1], 8)], "id int, paper_id int, module_no int, text string, marks int")
    p = spark.createDataFrame([(1, "approved", "s1", 2018), (2, "approved", "s1", 2025)], "id int, status string, subject_code string, exam_year int")
    topics, members = rebuild.topics_of(q, p)
    old = spark.createDataFrame([(1, "k1", "Old label"), (2, "k1", "Old label"), (3, "k1", "Old label")], "sub_question_id long, stable_key string, label string")
    got = {r["representative_text"]: (r["rank_no"], r["stable_key"], r["label"]) for r in rebuild.carried(topics, members, old).collect()}
    assert got[texts[1]] == (1, "k1", "Old label")
    assert got[texts[0]][0] == 2 and got[texts[0]][1] != "k1" and got[texts[0]][2] == "Paging Unit of the Memory"


def test_labels_of_all_wordings(spark):
    texts = {
        1: ["memory paging unit of a machine", "Explain the paging unit in detail", "Describe the paging unit with a neat diagram"],  # well-formed, then shortest
        2: ["b) ?", "a. Explain the CRC encoder"],  # a fragment isn't tried beside a question
        3: ["Explain with example. Define the", "Explain with example. Define the, Explain"],  # no phrase and no word
        4: ["??", "(of) the (of)"],
        5: ["Explain, define; of: in; the. of"],
        6: ["  "],
    }
    df = spark.createDataFrame([(t, 10 * t + i, w) for t, ws in texts.items() for i, w in enumerate(ws)], "id int, sub_question_id long, text string")
    got = {r["id"]: r["label"] for r in labels.topic_labels(df, ["id"]).collect()}
    assert got[1] == "Paging Unit" and got[2] == "CRC Encoder" and got[6] == "Untitled topic"
    assert got[4] == "??" and got[5] == texts[5][0]
    words = {1: ["paging unit", "unit paging", "unit paging"], 2: ["CRC the encoder", "crc"], 3: ["token bucket", "bucket list"], 4: ["12 of"], 5: ["alpha. beta", "gamma"], 6: ["list paging"], 7: ["cat", "dog"], 8: ["beta"] * 4 + ["alpha"] * 5 + ["alpha beta"]}
    df = spark.createDataFrame([(t, 10 * t + i, w) for t, ws in words.items() for i, w in enumerate(ws)], "id int, sub_question_id long, text string")
    got = {r["id"]: r["leaders"] for r in labels.keyword_labels(df, ["id"]).collect()}
    assert got == {1: "Unit Paging", 2: "CRC Encoder", 3: "Token Bucket & Bucket", 4: "12 of", 5: "Alpha Beta", 6: "Paging", 7: "Cat & Dog", 8: "Alpha Beta"}


def test_claims_carry_labels(spark, small):
    old = {(r["stable_key"], r["label"]) for r in catalogue.table(spark, small, "topics").collect()}
    taken = [(r["key"], r["label"]) for r in catalogue.QUERIES["carry_claims"](spark, small).collect() if r["key"] in {k for k, _ in old}]
    assert any(label for _, label in taken) and set(taken) <= old


def test_encoder(spark):
    df = spark.createDataFrame([("paging in memory",), ("Paging  in memory",), ("",), (None,)], "t string")
    a, b, c, d = (np.array(r[0]) for r in df.select(V.encoder(32)(F.col("t"))).collect())
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-5 and not c.any() and not d.any()


# ------------------------------------------------------------- life cycle


def test_life_cycle(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    more = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, lifecycle.upsert(table, more, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, lifecycle.insert_new(table, more, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    changes = spark.createDataFrame([(1, 1, "x"), (1, 3, None), (1, 2, "y")], "id int, at int, v string")
    assert [tuple(r) for r in lifecycle.latest(changes, ["id"], ["at"]).collect()] == [(1, 3, None)]
    hops = spark.createDataFrame([("a, b ", "p"), ("", "p"), (None, None)], "h string, p string")
    assert [r[0] for r in hops.select(lifecycle.client_address(F.col("h"), F.col("p"))).collect()] == ["b", "p", "unknown"]
    content = spark.createDataFrame([(b"x%PDF-1.7",), (b"no",), (b" " * 1024 + b"%PDF-",)], "c binary")
    assert [r[0] for r in content.select(lifecycle.looks_like_pdf(F.col("c"))).collect()] == [True, False, False]


def test_browsing(spark):
    topics = spark.createDataFrame([(1, "S", 1, "Paging Unit", 9.4), (2, "S", 1, "Routing", 8.0), (3, "S", 2, "Paging Table", 5.0)], "topic_id int, subject string, module_no int, label string, expected double")
    assert sorted(map(tuple, browse.edges(topics).collect())) == [(1, 2, 0.15)]
    assert sorted((r["topic_id"], r["first"], r["kin"]) for r in browse.family_members(topics).collect()) == [(1, 1, 1), (2, 2, 0), (3, 1, 1)]
    studied = spark.createDataFrame([(1,), (2,), (9,)], "topic_id int")
    assert [tuple(r) for r in browse.coverage(topics, studied, 16.0).collect()] == [("S", 1, 16)]
    shown = spark.createDataFrame([(2020, 2024, 1), (2024, 2024, 2), (None, None, 0)], "a int, b int, n int")
    assert [tuple(r) for r in shown.select(browse.year_range(F.col("a"), F.col("b")), browse.counted(F.col("n"), "paper")).collect()] == [("2020–2024", "1 paper"), ("2024", "2 papers"), ("", "0 papers")]
    chosen = spark.createDataFrame([("a.PDF", 5, 1), ("a.txt", 5, 2), (None, 5, 3), ("b.pdf", 99 << 20, 4), ("c.pdf", 5, 11)], "f string, s int, n int")
    assert [r[0] for r in chosen.select(browse.upload_refusal(F.col("f"), F.col("s"), F.col("n"))).collect()] == [None, "not a pdf", "not a pdf", "too large", "too many files"]
    cards = spark.createDataFrame([("B", 1, 5), ("A", 1, None), ("C", 3, 4)], "code string, papers int, changed int")
    assert [[r["code"] for r in browse.ordered_cards(cards, by).collect()] for by in ("papers", "changed", "code")] == [["C", "A", "B"], ["B", "C", "A"], ["A", "B", "C"]]


def test_review_edit_and_jobs(spark):
    papers = spark.createDataFrame(
        [(1, "review", "k", None), (2, "review", "k", None), (3, "approved", "m", None), (4, "review", "m", None), (5, "rejected", None, None), (6, "approved", None, None), (7, None, None, None)],
        "id int, status string, session_key string, status_reason string",
    )
    orders = spark.createDataFrame([(1, "approve"), (2, "approve"), (4, "approve"), (5, "reprocess"), (6, "reject"), (7, "reject")], "id int, action string")
    got = {r["id"]: tuple(r)[1:] for r in lifecycle.reviewed(papers, orders).collect()}
    assert got == {1: ("approved", "k", None), 2: ("review", "k", "session"), 3: ("approved", "m", None), 4: ("review", "m", "session"), 5: ("processing", None, None), 6: ("approved", None, "state"), 7: (None, None, "state")}
    jobs = spark.createDataFrame([(1, "process", "boom"), (3, "publish", "boom"), (4, "match", None)], "id int, job string, error string")
    assert {r["id"]: (r["status"], r["status_reason"]) for r in lifecycle.after_jobs(papers, jobs).collect() if r["id"] in (1, 3, 4)} == {1: ("failed", "boom"), 3: ("approved", None), 4: ("review", None)}
    known = papers.selectExpr("id", "status", "session_key", "'A' as subject_code", "2020 as exam_year", "'May' as exam_month", "'see' as paper_type")
    edits = spark.createDataFrame([(1, "B", 2024, "July", "see"), (3, "B", 2024, "July", "see")], "id int, subject_code string, exam_year int, exam_month string, paper_type string")
    after = {r["id"]: (r["subject_code"], r["session_key"]) for r in lifecycle.edited(known, edits, F.concat_ws(":", "subject_code", "exam_year")).collect()}
    assert after[1] == ("B", "B:2024") and after[3] == ("A", "m") and after[2] == ("A", "k")


def test_upload_check_and_keyed_hash(spark):
    pdf = b"%PDF-1"
    rows = [(pdf, 6, False, True), (pdf, 6, True, True), (pdf, 6, False, False), (pdf, 99 << 20, False, True), (b"x", 1, False, True), (None, None, False, True)]
    df = spark.createDataFrame(rows, "c binary, n long, blocked boolean, within boolean")
    assert [r[0] for r in df.select(lifecycle.upload_check(F.col("c"), F.col("n"), F.col("blocked"), F.col("within"))).collect()] == [None, "blocked", "too often", "too large", "not a pdf", "not a pdf"]
    hashes = [r[0] for r in spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), (None,)], "a string").select(lifecycle.keyed_hash("s")(F.col("a"))).collect()]
    assert len(hashes[0]) == 16 and hashes[0] != hashes[1] and hashes[2] is None


def test_rebuild_to_documents(spark, tmp_path):
    """Questions to published documents; keys survive a replaced paper, and a subject without live papers goes."""
    stems = ["explain the paging unit and its page table", "describe the routing protocol of the network layer", "derive the normal form of the relation schema", "discuss the scheduling of processes with priorities", "compare the stack and the heap of a program"]
    papers = [(p, s, "approved", 2020 + p, "January", "see") for p, s in ((1, "AAA"), (2, "AAA"), (3, "BBB"))]
    asked = [(10 * p + k, p, 1 + k % 5, f"{stem} {'in detail' if p == 2 else ''}", 8, 1, "a") for p, *_ in papers for k, stem in enumerate(stems)]
    kinds = "id int, paper_id int, module_no int, text string, marks int, q_no int, sub_q string"
    questions, names = spark.createDataFrame(asked, kinds), "id int, subject_code string, status string, exam_year int, exam_month string, paper_type string"
    nothing = spark.createDataFrame([], "sub_question_id long, stable_key string, label string")
    documents, topics = rebuild.published(questions, spark.createDataFrame(papers, names), nothing, 2025)
    folder = str(tmp_path / "docs")
    rebuild.publish(documents, spark.createDataFrame(papers, names), folder)
    said = {r["subject"]: json.loads(r["data"]) for r in spark.read.parquet(folder).collect()}
    assert said.keys() == {"AAA", "BBB"} and [s["id"] for s in said["AAA"]["sessions"]] == [2, 1]
    assert len(said["AAA"]["modules"]) == 5 and all(m["topics"][0]["label"] for m in said["AAA"]["modules"])
    before = {r["stable_key"] for r in topics.filter("subject = 'AAA'").collect()}

    # paper 2 is replaced by paper 4, and the only paper of the other subject is rejected
    links = questions.join(topics.select("subject", "module_no", "stable_key", F.lit("Kept Label").alias("label")), "module_no").filter("subject = 'AAA' and paper_id < 3").select(F.col("id").cast("long").alias("sub_question_id"), "stable_key", "label")
    papers = [papers[0], (2, "AAA", "rejected", 2022, "January", "see"), (3, "BBB", "rejected", 2023, "January", "see"), (4, "AAA", "approved", 2024, "July", "see")]
    more = spark.createDataFrame([(40 + k, 4, 1 + k % 5, stem, 8, 1, "a") for k, stem in enumerate(stems)], kinds)
    live = spark.createDataFrame(papers, names)
    documents, topics = rebuild.published(questions.unionByName(more), live, links, 2025)
    rebuild.publish(documents, live, folder)
    assert {r["subject"] for r in spark.read.parquet(folder).collect()} == {"AAA"}
    after = {r["stable_key"] for r in topics.collect()}
    assert len(before & after) * 2 >= len(before) and {r["label"] for r in topics.collect() if r["stable_key"] in before} == {"Kept Label"}


# ------------------------------------------------------------- sources and sinks


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-x" + b"word " * 40)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-scan")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = tables.read_files(spark, str(tmp_path))
    assert sorted(r["filename"] for r in files.select("filename").collect()) == ["a.pdf", "b.pdf"]
    read = lambda b: [[b.decode()[6:], None], ["", " "]]
    def fails(b):
        raise OSError("no such font")

    broken = {r["failed"] for r in tables.extract_rows(files, fails, fails).collect()}
    assert broken == {"native: OSError: no such font; scanned: OSError: no such font"}
    rows = tables.extract_rows(files, read, lambda b: [["seen", "by scan"]]).collect()
    assert sorted((r["pdf_type"], len(r["cells"])) for r in rows) == [("native", 2), ("scanned", 2)]
    (tmp_path / "cat.yaml").write_text("# head\nbcs501: Software Engineering\nBCS502: \"Computer: Networks\"  # note\n\n")
    assert sorted(map(tuple, tables.read_catalogue(spark, str(tmp_path / "cat.yaml")).collect())) == [("BCS501", "Software Engineering"), ("BCS502", "Computer: Networks")]
    pages = spark.createDataFrame([(1, "x\n\n y \r\nz"), (2, None)], "paper_id int, text string")
    assert [r["cells"] for r in tables.header_rows(pages, 2).collect()] == [["x"], ["y"]]
    tables.write_store(files, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    store, kept = str(tmp_path / "store"), {r["filename"]: r["content_hash"] for r in files.collect()}
    assert tables.get_stored(spark, store, kept["b.pdf"]) == b"%PDF-scan" and tables.get_stored(spark, store, "0" * 64) is None
    with pytest.raises(ValueError):
        tables.get_stored(spark, store, "../" + kept["b.pdf"])
    tables.delete_stored(spark, store, spark.createDataFrame([(kept["b.pdf"],), ("x",)], "content_hash string"))
    assert tables.get_stored(spark, store, kept["b.pdf"]) is None and tables.get_stored(spark, store, kept["a.pdf"]) is not None
    first = spark.createDataFrame([(1, None, None, "May", None), (2, "BCS501", None, None, None), (3, None, None, None, None)], "paper_id int, code string, name string, month string, year int")
    second = spark.createDataFrame([(1, "BCS502", "Networks", "June", 2024), (2, "X", "Y", "July", 2020)], "paper_id int, code string, name string, month string, year int")
    assert sorted(map(tuple, tables.merged_headers(first, second).collect())) == [(1, "BCS502", "Networks", "May", 2024), (2, "BCS501", None, None, None), (3, None, None, None, None)]
    assert tables.stretch(np.array([[0, 10, 20], [30, 200, 255]]), 0).tolist() == [[0, 10, 20], [30, 200, 255]]


def test_sinks(spark, small, tmp_path):
    snaps = catalogue.QUERIES["snapshot_json"](spark, small)
    folder = str(tmp_path / "snaps")
    tables.write_snapshots(snaps, folder)
    n = spark.read.parquet(folder).count()
    subject = snaps.first()["subject"]
    tables.write_snapshots(snaps.filter(F.col("subject") == subject).withColumn("data", F.lit("{}")), folder)
    assert spark.read.parquet(folder).count() == n and tables.read_snapshot(spark, folder, subject).first()[0] == "{}"
    bank = str(tmp_path / "bank")
    tables.write_bank(catalogue.QUERIES["csv_bank"](spark, small), bank)
    assert spark.read.option("header", True).csv(bank).count() > 0


# ------------------------------------------------------------- streams


def test_stream_is_the_batch(spark, small):
    limits = [{(r["event_id"], r["accepted"]) for r in catalogue.QUERIES[q](spark, small).collect()} for q in ("rate_limit", "stream_limit")]
    assert limits[0] == limits[1] and {ok for _, ok in limits[0]} == {True, False}


def test_shared_folder(spark):
    assert work_path(spark, "x").startswith("file:///") and work_path(spark, "x") != work_path(spark, "x")
    assert {qualified(spark, p) for p in ("file:///tmp/elsewhere/", "/tmp/elsewhere")} == {"file:///tmp/elsewhere"}


@pytest.mark.parametrize("values", [[1, 2], []])
def test_centroids(spark, values):
    df = spark.createDataFrame([(1, [float(v), 0.0]) for v in values], "k int, v array<double>")
    assert [tuple(r) for r in V.centroids(df, "k", "v").collect()] == ([(1, 2, [1.0, 0.0])] if values else [])
