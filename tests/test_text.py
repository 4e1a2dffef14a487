"""Column functions on text against plainly stated cases."""

import pytest
from pyspark.sql import functions as F

from quillmine.functions import catalog as C
from quillmine.functions import text as X

KNOWN = ["BCS502", "BAI515B", "BESCK104A", "BCS501", "BAD502"]


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


@pytest.mark.parametrize("text, code", [
    ("JAN 2025 BCS502.pdf", "BCS502"), ("JAN_2025_BCS502.pdf", "BCS502"), ("bai515b Dec 2024.pdf", "BAI515B"), ("BESCK104A-2024.pdf", "BESCK104A"),
    ("BCSS02.pdf", "BCS502"), ("8CS5O2.pdf", "BCS502"), ("B.E. Examination 2025.pdf", None), ("BCSS501.pdf", "BCS501"), ("BXYZ999.pdf", "BXYZ999"),
    ("BAD502 and BCS502.pdf", "BAD502"), (None, None), ("", None),
])
def test_codes_in_names(spark, text, code):
    known = F.array(*map(F.lit, KNOWN))
    assert apply(spark, [text], lambda c: X.find_code(X.stem(c), known)) == [code]


def test_years_and_months(spark):
    names = ["BCS502_Dec2024.pdf", "JuneJuly_2025.pdf", "Marks Mayank BCS502 2024.pdf", "BCS503 mqp 2022-2023.pdf", "x 24 y.pdf", "x 99 y.pdf", "July BCS 25.pdf"]
    assert apply(spark, names, lambda c: X.month_in(X.stem(c))) == ["December", None, None, None, None, None, "July"]
    assert apply(spark, names, lambda c: X.year_of(X.stem(c))) == [2024, 2025, 2024, 2023, 2024, None, 2025]
    assert apply(spark, names, lambda c: X.exam_type(X.stem(c))) == ["regular"] * 3 + ["mqp"] + ["regular"] * 3


def test_cells(spark):
    assert apply(spark, ["Q.1", "O22", "Q11", "0.7", "Qa", "7", "oO6", "", None], X.question_number) == [1, 2, 1, 7, None, None, 6, None, None]
    assert apply(spark, ["be", " C.", "rh", ""], X.sub_label) == ["b", "c", None, None]
    assert apply(spark, ["(06—", "} 10", "110", "7 8", "5", "21"], X.marks_in) == [6, 10, None, 8, 5, None]
    assert apply(spark, ["L 3 CO2", "l7"], X.bloom_in) == ["L3", None]
    assert apply(spark, ["L3 CQ2", "co 4", "c"], X.outcome_in) == ["CO2", "CO4", None]


def test_cleaning(spark):
    assert apply(spark, ["Q.3 Explain | the L2 bus CO1 .", "a. Define x;"], X.clean_question) == ["Explain the bus", "Define x"]
    assert apply(spark, ["_b. AWith a diagram explain --", "Q.3 a. Describe   it"], X.clean_for_embedding) == ["With a diagram explain", "Describe it"]


def test_labels(spark):
    texts = ["What is data communication? List its parts.", "Explain with a neat diagram the TCP/IP model in detail.", "Define and explain paging."]
    assert apply(spark, texts, X.phrase_label) == ["Data Communication", "TCP/IP Model", "Paging"]
    assert apply(spark, ["Explain the paging unit", "of"], X.label_family) == ["paging", None]


def test_plain_text(spark):
    assert apply(spark, ["a“b” → c • d☃"], X.latin_only) == ['a"b" -> c * d?']
    assert apply(spark, ["..\\x/é a*b?.pdf", "y" * 130 + ".pdf"], X.safe_filename) == ["é a_b_.pdf", "y" * 116 + ".pdf"]
    assert apply(spark, ["word " * 50], X.shorten)[0].endswith("...")


def test_sessions(spark):
    rows = [("November", 2024), ("February", 2025), ("May", 2025), ("March", 2025), ("Dec", 2025), (None, 2025), ("June", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, y int").orderBy("i")
    got = [(r[0], r[1]) for r in df.select(C.session_month(F.col("m"), F.col("y")), C.session_year(F.col("m"), F.col("y"))).collect()]
    assert got == [("January", 2025), ("January", 2025), ("July", 2025), ("March", 2025), ("Dec", 2025), (None, 2025), ("June", None)]
    keys = [r[0] for r in df.select(C.session_key(F.lit("B1"), F.lit("see"), F.col("m"), F.col("y"))).collect()]
    assert keys[0] == "B1:see:2024:nov" and keys[5] is None and keys[6] is None


def test_branches(spark):
    assert apply(spark, ["BCS502", "BCSL504", "BMATS101", "nonsense"], C.branch_of) == ["CSE", "CSE", "Common", "Common"]
    assert apply(spark, ["BCS502", "nonsense"], C.semester_of) == [5, None]
    assert apply(spark, [" bcs502 ", "BCS5", None], C.normal_code) == ["BCS502", None, None]
