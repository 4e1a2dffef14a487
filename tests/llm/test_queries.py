"""Every query of the training-data operators over the small tables, against SQL or brute force."""

import duckdb
import pytest

from quillmine.llm import queries
from tests.llm.test_pairs import brute_spans, words
from tools import compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    said = compare.compare(spark, small, name)
    assert "DIFFER" not in said and "TYPES" not in said, said


def rows_of(small, sql):
    db = duckdb.connect()
    for t in ("papers", "sub_questions", "topics", "documents"):
        db.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return db.execute(sql).fetchall()


def near(a, b):
    return len(a & b) * 10 >= 7 * len(a | b)


def test_near_duplicates(spark, small):
    want = set()
    for name, sql in (("sub_questions", "SELECT id, text FROM sub_questions"), ("topics", "SELECT id, representative_text FROM topics")):
        sets = sorted((i, w) for i, t in rows_of(small, sql) if t and len(w := words(t)) >= 8)
        want |= {(name, i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if near(a, b)}
    assert {tuple(r) for r in queries.QUERIES["p5_found"](spark, small).collect()} == want


def test_history(spark, small):
    sets = [(i, m, s, words(t)) for i, m, s, t in rows_of(small, "SELECT s.id, month(p.created_at), p.status, s.text FROM sub_questions s JOIN papers p ON p.id = s.paper_id")]
    old = [(m, w) for _, m, s, w in sets if s == "approved" and len(w) >= 8]
    want = {i for i, m, _, w in sets if len(w) >= 8 and any(n < m and near(w, v) for n, v in old)}
    assert {r["id"] for r in queries.QUERIES["p1_found"](spark, small).collect() if r["kind"] == "sub_question"} == want


def test_spans(spark, small):
    pairs, share = brute_spans(rows_of(small, "SELECT doc_id, text FROM documents"), 200)
    assert {tuple(r) for r in queries.QUERIES["p10_found"](spark, small).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in queries.QUERIES["p10_shared"](spark, small).collect()} == share


def test_row_groups_are_skipped(spark):
    """On groups of some thousand rows most row groups are never read."""
    seen = queries.QUERIES["p2_skipped"](spark, "/root/testdata/sf0.01").first()
    assert seen["row_groups_skipped"] > seen["row_groups_read"] > 0
