"""Scores, ranks, ladders and exports of topics.

A topic's appearances are counted once per paper; each is worth ``decay`` to the power of its age
in years, an unknown year counts as current.  Ranks are gapless; ladders run down the ranking until
a module's marks are covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY, MODULE_MARKS = 0.85, 20.0


def half_up(c: Column, digits: int) -> Column:
    """Rounding by plain double arithmetic, the same in every engine."""
    return F.floor(c * 10.0**digits + 0.5) / F.lit(10.0**digits)


def appearances(links: DataFrame, questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic_id, sub_question_id, paper_id, exam_year, marks, text): links to questions of accepted papers, each once."""
    live = papers.filter("status = 'approved'").select(F.col("id").alias("paper_id"), "exam_year")
    asked = questions.select(F.col("id").alias("sub_question_id"), "paper_id", "q_no", "sub_q", "marks", "text")
    return links.select("topic_id", "sub_question_id").distinct().join(asked, "sub_question_id").join(live, "paper_id")


def scores(met: DataFrame, topics: DataFrame, papers: DataFrame, year: int) -> DataFrame:
    """One row per topic that was met: frequency, share, weighted score, average and expected marks, last year."""
    first = Window.partitionBy("topic_id", "paper_id").orderBy("sub_question_id")
    once = met.withColumn("n", F.row_number().over(first))
    age = F.greatest(F.lit(0), F.lit(year) - F.coalesce("exam_year", F.lit(year)))
    per = once.groupBy("topic_id").agg(
        F.count_if(F.col("n") == 1).alias("frequency"),
        F.sum(F.when(F.col("n") == 1, F.pow(F.lit(DECAY), age))).alias("score"),
        F.max("exam_year").alias("last_year"),
        F.coalesce(F.avg(F.when(F.col("marks") != 0, F.col("marks"))), F.lit(0.0)).alias("avg_marks"),
    )
    total = papers.filter("status = 'approved'").groupBy(F.upper(F.trim("subject_code")).alias("subject")).agg(F.count("*").alias("total"))
    named = topics.select(F.col("id").alias("topic_id"), F.upper(F.trim("subject_code")).alias("subject"), "module_no", "label", "representative_text")
    joined = per.join(named, "topic_id").join(total, "subject", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)))
    share = F.col("frequency") / F.col("total")
    return joined.select(
        "topic_id", "subject", "module_no", "label", "representative_text", "frequency", "total", "last_year", "avg_marks",
        share.alias("share"), half_up(F.col("score") + 1e-9, 4).alias("weighted_score"), half_up(share * F.col("avg_marks"), 2).alias("expected"),
    )


def ranked(scored: DataFrame) -> DataFrame:
    """``rank_no`` in subject and module: by score, or by marks where the subject has one paper; ties by id."""
    single = F.when(F.col("total") == 1, F.col("avg_marks"))
    order = Window.partitionBy("subject", "module_no").orderBy(F.desc_nulls_last(single), F.desc("weighted_score"), "topic_id")
    return scored.withColumn("rank_no", F.row_number().over(order).cast("int"))


def ladder(ranks: DataFrame, stop: float, digits: int, cap: float = MODULE_MARKS) -> DataFrame:
    """Running expected marks by rank; rows end after the first that reaches ``stop``."""
    upto = Window.partitionBy("subject", "module_no").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0)
    run = ranks.withColumn("run", F.sum("expected").over(upto))
    # a topic without a label is named by the beginning of its text
    named = F.coalesce(F.when(F.trim("label") != "", F.trim("label")), F.substring("representative_text", 1, 50))
    return run.filter(F.col("run") - F.col("expected") < stop).select(
        "subject", "module_no", "rank_no", "topic_id", named.alias("label"), "expected", half_up(F.least("run", F.lit(cap)), digits).alias("cumulative"), (F.col("run") >= cap).alias("full")
    )


def tier(share: Column, total: Column) -> Column:
    """How regularly a topic returns; unknown from a single paper."""
    return F.when(total <= 1, F.lit("unranked")).when(share >= 0.8, F.lit("always")).when(share >= 0.5, F.lit("often")).otherwise(F.lit("sometimes"))


def csv_rows(ranks: DataFrame, steps: DataFrame, years: DataFrame) -> DataFrame:
    """The question bank's columns in text form.  ``years``: topic_id, years (text)."""
    kept = steps.select("topic_id", "full")
    return ranks.join(kept, "topic_id").join(years, "topic_id", "left").select(
        "subject",
        F.col("module_no").alias("module"),
        F.col("rank_no").alias("priority"),
        F.coalesce("label", F.lit("")).alias("label"),
        F.col("representative_text").alias("question"),
        F.col("avg_marks").cast("int").alias("avg_marks"),
        F.col("frequency").alias("times"),
        F.col("total").alias("papers"),
        F.concat(F.bround(F.col("share") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("frequency_pct"),
        F.coalesce("years", F.lit("—")).alias("years"),
        (F.rint(F.col("expected") * 10) / 10).alias("expected"),
        F.when(F.col("full"), "YES").otherwise("").alias("full_coverage"),
    )


def sheet_rows(ranks: DataFrame, steps: DataFrame, rows: int = 3) -> DataFrame:
    """Rows of the one-page sheet: down to full coverage, at most ``rows`` per module."""
    whole = Window.partitionBy("subject", "module_no")
    full_at = F.min(F.when(F.col("full"), F.col("rank_no"))).over(whole)
    shown = steps.filter(F.col("rank_no") <= rows).withColumn("full_at", full_at).filter(F.col("rank_no") <= F.least(F.coalesce("full_at", F.lit(rows)), F.lit(rows)))
    return shown.join(ranks.select("topic_id", "representative_text"), "topic_id").select("subject", "module_no", "rank_no", "topic_id", "full_at", "representative_text")
