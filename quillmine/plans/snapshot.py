"""The published document of every subject: topics, ladders and sessions nested into one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import catalog as C
from quillmine.operators import scoring as S


def live_order(papers: DataFrame) -> DataFrame:
    """Accepted papers with ``session_no`` in their subject: newest year, latest month, exams before models."""
    live = papers.filter("status = 'approved'").withColumn("subject", F.upper(F.trim("subject_code")))
    order = Window.partitionBy("subject").orderBy(F.desc(F.coalesce("exam_year", F.lit(0))), F.desc(C.month_index(F.col("exam_month"))), F.desc(F.coalesce((F.col("paper_type") == "see").cast("int"), F.lit(0))), "id")
    return live.withColumn("session_no", F.row_number().over(order).cast("int"))


def snapshots(met: DataFrame, ranks: DataFrame, papers: DataFrame) -> DataFrame:
    """(subject, paper_count, topic_count, min_year, max_year, data): ``data`` is the nested document as JSON."""
    order = live_order(papers)
    sessions = order.groupBy("subject").agg(
        F.count("*").alias("paper_count"), F.min("exam_year").alias("min_year"), F.max("exam_year").alias("max_year"),
        F.array_sort(F.collect_list(F.struct("session_no", "id", C.session_label(F.col("paper_type"), F.col("exam_month"), F.col("exam_year")).alias("label")))).alias("sessions"),
    )
    placed = met.join(order.select(F.col("id").alias("paper_id"), "session_no"), "paper_id")
    wordings = placed.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("session_no", "sub_question_id", "paper_id", "marks", "text"))).alias("wordings"))
    topic = ranks.join(wordings, "topic_id").select(
        "subject", "module_no",
        F.struct("rank_no", "topic_id", "label", F.col("representative_text").alias("text"), "frequency", S.half_up(F.col("share"), 4).alias("share"), S.half_up(F.col("avg_marks"), 1).alias("avg_marks"), "expected", "wordings").alias("t"),
    )
    steps = S.ladder(ranks, S.MODULE_MARKS, 1)
    steps = steps.groupBy("subject", "module_no").agg(F.array_sort(F.collect_list(F.struct("rank_no", "cumulative", "full"))).alias("ladder"), F.min(F.when(F.col("full"), F.col("rank_no"))).alias("full_at"))
    modules = topic.groupBy("subject", "module_no").agg(F.array_sort(F.collect_list("t"), lambda a, b: a["rank_no"] - b["rank_no"]).alias("topics")).join(steps, ["subject", "module_no"])
    nested = modules.groupBy("subject").agg(F.sum(F.size("topics")).alias("topic_count"), F.array_sort(F.collect_list(F.struct("module_no", "full_at", "ladder", "topics")), lambda a, b: a["module_no"] - b["module_no"]).alias("modules"))
    out = sessions.join(nested, "subject")
    return out.select("subject", "paper_count", "topic_count", "min_year", "max_year", F.to_json(F.struct("subject", "sessions", "modules")).alias("data"))
