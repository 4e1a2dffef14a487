"""Paper metadata read from the first rows of a paper, and merged with what its file name says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as X
from quillmine.session import bounded

#: Entries of a catalogue at most, as its codes and names go to every task.
CATALOGUE = 100_000
#: How many rows are looked at, and words that no subject name has.
ROWS = 15
NOT_A_NAME = "time|note|max|marks|answer|module|hours|hrs|bloom|course|outcome"
MODEL = "model question paper|model q. paper|model q paper"


def header_metadata(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(paper_id, code, name, month, year, exam_type) of raw rows (``paper_id``, ``row_no``, ``cells``).

    ``catalogue`` (``code``, ``name``) is a fixed dimension; names that several codes share decide nothing.
    """
    catalogue = bounded(catalogue, CATALOGUE, "the catalogue")
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("row_no"))
    known = catalogue.agg(F.collect_set("code").alias("known"))
    lines = rows.withColumn("n", place).filter(F.col("n") <= ROWS)
    text = F.trim(F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " "))
    lines = lines.select("paper_id", "n", text.alias("text")).filter("text <> ''").withColumn("low", F.lower("text"))
    exam = F.contains("low", F.lit("examination")) | F.contains("low", F.lit("degree exam"))
    lines = lines.withColumn("exam", exam).crossJoin(F.broadcast(known))
    first_exam = F.min(F.when(F.col("exam"), F.col("n"))).over(Window.partitionBy("paper_id"))
    years = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"\b((?:20|19)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    lines = lines.select(
        "paper_id", "n", "text",
        F.col("low").rlike(MODEL.replace(".", r"\.")).alias("model"),
        F.when(F.col("exam"), years).alias("year"),
        F.when(F.col("exam"), X.month_in(F.col("text"), whole_word=True)).alias("month"),
        (~F.col("exam") & (F.col("n") > first_exam) & F.length("text").between(4, 64) & ~F.col("text").rlike(r"\d") & ~F.col("low").rlike(NOT_A_NAME)).alias("named"),
        F.when(~F.col("exam"), X.find_code(F.col("text"), F.col("known"))).alias("code"),
    )

    def first(value: Column, ok: Column) -> Column:
        return F.min_by(F.when(ok, value), F.when(ok, F.col("n")))

    per = lines.groupBy("paper_id").agg(
        first(F.col("year"), F.col("year").isNotNull()).alias("year"), first(F.col("month"), F.col("month").isNotNull()).alias("month"),
        first(F.col("text"), F.col("named")).alias("title"), first(F.col("code"), F.col("code").isNotNull()).alias("explicit"), F.max("model").alias("model"),
    )
    return _named(per, catalogue)


def _named(per: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Code and name: an explicit code first, else the one code of the first catalogue name that fits the title."""
    names = catalogue.groupBy(F.lower("name").alias("low")).agg(F.min("code").alias("code"), F.count("*").alias("codes"))
    listed = names.agg(F.array_sort(F.collect_list(F.struct("code", "low", "codes"))).alias("names"))
    title = F.lower("title")
    fits = F.get(F.filter("names", lambda e: F.contains(title, e["low"]) | F.contains(e["low"], title)), F.lit(0))
    guess = per.crossJoin(F.broadcast(listed)).withColumn("fit", fits)
    code = F.coalesce("explicit", F.when(F.col("fit")["codes"] == 1, F.col("fit")["code"]))
    official = catalogue.select(F.col("code").alias("explicit"), F.col("name").alias("official"))
    out = guess.withColumn("code", code).join(official, "explicit", "left")
    name = F.when(F.col("explicit").isNotNull(), F.coalesce("official", "title", "explicit")).otherwise(F.col("title"))
    return out.select("paper_id", "code", name.alias("name"), "month", "year", F.when(F.col("model"), "mqp").otherwise("regular").alias("exam_type"))


def merged(from_name: DataFrame, from_rows: DataFrame) -> DataFrame:
    """What the file name says wins over the rows; a model hint in either makes a model paper.

    ``from_name``: paper_id, filename, code (or UNKNOWN), month, year, exam_type.
    """
    rows = from_rows.select("paper_id", *(F.col(c).alias(f"r_{c}") for c in ("code", "name", "month", "year", "exam_type")))
    both = from_name.join(rows, "paper_id", "left")
    model = F.lower("filename").rlike("model|mqp|sample") | (F.col("exam_type") == "mqp") | (F.coalesce("r_exam_type", F.lit("")) == "mqp")
    code = F.coalesce(F.when(F.col("code") != "UNKNOWN", F.col("code")), F.col("r_code"))
    return both.select("paper_id", code.alias("code"), F.col("r_name").alias("name"), F.coalesce("month", "r_month").alias("month"), F.coalesce("year", "r_year").alias("year"), F.when(model, "model").otherwise("see").alias("paper_type"))
