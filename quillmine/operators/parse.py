"""Table rows of a paper parsed into questions, as an ordered fold over its rows.

What can be read off a single row is computed as columns before the fold (numbers, labels, marks,
levels, kinds of row); the fold keeps only what runs on from row to row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.functions import text as T
from quillmine.operators.fold import ordered_fold

#: How a module header may read after a scan.
MODULE_FORMS = (
    r"(?i)module\s*[-–—=~]*\s*(\d)",
    r"(?i)(?:Mod(?:u|v|ul|ule)?|M[aeiouv][dg]|Mfod)\w*\s*[-–—=~P]+\s*([1-5])",
    r"(?i)M[0oO][dD][uUvV]?\w{0,3}\s*[-–—=~|P]+\s*([1-5])",
)
ASKING = r"(?i)\b(?:" + "|".join(T.QUESTION_WORDS) + r")\b"
LABELS = "abcd"


def module_header(full: Column) -> Column:
    """Module number if the row is a module header, else null."""
    named = [T.blank_to_null(F.regexp_extract(full, form, 1)).cast("int") for form in MODULE_FORMS]
    marks = F.exists(F.transform(F.regexp_extract_all(full, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(4, 20))
    digits = F.regexp_extract_all(full, F.lit(r"\b([1-5])\b"), F.lit(1))
    plain = (F.length(full) <= 20) & ~full.rlike(ASKING) & ~full.rlike(r"\b[a-cA-C]\s*[.)]\s") & ~full.rlike(r"[QqOo0]\s*[.\s]?\s*\d") & ~marks & ~F.contains(full, F.lit("?"))
    found = F.coalesce(*named, F.when(plain & (F.size(digits) == 1), F.get(digits, F.lit(0)).cast("int")))
    return F.when(found != 0, found)


def read_rows(rows: DataFrame) -> DataFrame:
    """Per-row readings of ``paper_id``, ``row_no``, ``cells``; blank, furniture and OR rows are left out."""
    cell = [F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))) for i in range(3)]
    full = F.trim(F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " "))
    right = F.array_join(F.slice("cells", 4, 1_000), " ")
    read = rows.select("paper_id", "row_no", *(c.alias(n) for c, n in zip(cell, ("c0", "c1", "text"), strict=True)), full.alias("full"), right.alias("right"))
    read = read.filter((F.col("full") != "") & ~F.col("full").rlike(T.SKIP_ROW))
    alternative = r"(?i)^\s*(?:P?OR|0R)\s*$"
    header = module_header(F.col("full"))
    read = read.withColumn("module", header).filter(F.col("module").isNotNull() | ~(F.col("text").rlike(alternative) | F.col("full").rlike(alternative)))
    return read.select(
        "paper_id", "row_no", "module", "text",
        ((F.length("text") > 20) & F.col("text").rlike(ASKING)).alias("asks"),
        T.question_number(F.col("c0")).alias("number"), T.sub_label(F.col("c1")).alias("label"),
        T.marks_in(F.col("right")).alias("marks"), T.bloom_in(F.col("right")).alias("bloom"), T.outcome_in(F.col("right")).alias("outcome"),
    )


@dataclass
class _Open:
    """The question being collected, and where the paper stands."""

    module: int = 0
    number: int = 0
    last: int = -1
    label: str | None = None
    lines: list[str] = field(default_factory=list)
    values: list = field(default_factory=lambda: [None, None, None])

    def close(self):
        """The finished question, if it is one."""
        module = self.module or (min(5, (self.number + 1) // 2) if self.number > 0 else 0)
        text, label, values = " ".join(self.lines).strip(), self.label, self.values
        self.label, self.lines, self.values = None, [], [None, None, None]
        return ((module, self.number, label, text, *values),) if text and module > 0 and self.number > 0 and label else ()

    def take(self, values) -> None:
        """Fill in what isn't known yet."""
        self.values = [old or new for old, new in zip(self.values, values, strict=True)]


def _parser():
    at = _Open()

    def step(row):
        if row is None:
            return at.close()
        module, text, asks, number, label, *values = row
        if module:
            done = at.close()
            at.module, at.number, at.last = module, 2 * (module - 1), -1
            return done
        if asks:
            done = at.close()
            at.last = LABELS.index(label) if label else (at.last + 1) % len(LABELS)
            at.label = LABELS[at.last]
            at.number = number or at.number + (at.label == "a")
            if at.number > 0:
                at.module = max(at.module, min(5, (at.number + 1) // 2))
            at.lines, at.values = [text], list(values)
            return done
        if label and text:
            at.number = (number or at.number) + (label == "a")
            at.label, at.last = label, LABELS.index(label)
            at.values = [new or old for old, new in zip(at.values, values, strict=True)]
        elif len(text) > 8 and at.label is not None:
            at.lines.append(text)
            at.take(values)
        return ()

    return step


def parse_papers(rows: DataFrame) -> DataFrame:
    """Questions of papers from raw rows (``paper_id``, ``row_no``, ``cells``)."""
    schema = "module_no int, q_no int, sub_q string, raw string, marks int, bloom_level string, course_outcome string"
    columns = ["module", "text", "asks", "number", "label", "marks", "bloom", "outcome"]
    found = ordered_fold(read_rows(rows), ["paper_id"], ["row_no"], columns, schema, _parser)
    cleaned = found.withColumn("text", T.clean_question(F.col("raw"))).filter(F.length("text") > 10)
    return cleaned.select("paper_id", "module_no", "q_no", "sub_q", (F.col("q_no") % 2 == 0).cast("int").alias("is_or_alt"), "text", "marks", "bloom_level", "course_outcome")
