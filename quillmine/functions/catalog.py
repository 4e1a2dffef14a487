"""Column functions on subject codes and exam sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmine.functions.text import MONTHS

#: Branch names by the letters of a code.
BRANCHES = {"CS": "CSE", "IS": "ISE", "AI": "AIML", "AD": "AIDS", "CM": "CCE", "CB": "CSBS", "CI": "CSE (AI&ML)", "CD": "CSE (DS)", "CY": "CSE (CY)", "CO": "CSE (IoT)"}
_PARTS = r"^B([A-Z]+?)L?(\d)(\d{2})[A-Z]?$"


def normal_code(code: Column) -> Column:
    """Trimmed upper-case code if it is well-formed, else null."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike(r"^B[A-Z]{1,5}\d{3}[A-Z]?$"), c)


def branch_of(code: Column) -> Column:
    """Branch of a code, ``Common`` where it has none of its own."""
    letters = F.regexp_extract(code, _PARTS, 1)
    out = F.lit("Common")
    for key, name in BRANCHES.items():
        out = F.when(letters == key, F.lit(name)).otherwise(out)
    return out


def semester_of(code: Column) -> Column:
    """Semester digit of a code, else null."""
    digit = F.regexp_extract(code, _PARTS, 2)
    return F.when(digit != "", digit.cast("int"))


def month_index(month: Column) -> Column:
    """0 for January to 11 for December, -1 else."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), month), F.lit(0)) - 1).cast("int")


def session_month(month: Column, year: Column) -> Column:
    """Exam month folded onto the session it belongs to; unchanged without a year."""
    known = month.isin(MONTHS) & year.isNotNull() & (year != 0)
    return F.when(known & month.isin("November", "December", "February"), F.lit("January")).when(known & month.isin("May", "June", "August"), F.lit("July")).otherwise(month)


def session_year(month: Column, year: Column) -> Column:
    """Year of the session: exams of November and December count to the next."""
    return F.when(month.isin("November", "December") & (year != 0), year + 1).otherwise(year)


def session_key(code: Column, paper_type: Column, month: Column, year: Column) -> Column:
    """Key of a semester-end exam session, null for other papers."""
    ok = (paper_type == "see") & (month != "") & (year != 0)
    return F.when(ok, F.concat_ws(":", F.coalesce(code, F.lit("None")), F.lit("see"), year.cast("string"), F.lower(F.substring(month, 1, 3))))


def session_label(paper_type: Column, month: Column, year: Column, short: bool = False) -> Column:
    """Readable session: model paper, month and year, year, or undated."""
    y = F.when(year != 0, F.substring(year.cast("string"), -2, 2) if short else year.cast("string"))
    model = F.trim(F.concat_ws(" ", F.lit("Model" if short else "Model paper"), y))
    return F.when(paper_type == "model", model).when((month != "") & y.isNotNull(), F.concat_ws(" ", F.substring(month, 1, 3), y)).otherwise(F.coalesce(F.when(year != 0, year.cast("string")), F.lit("Undated")))
