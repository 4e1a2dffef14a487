"""All subjects rebuilt in one job: live questions to clusters to topics with carried keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmine.functions import text as X
from quillmine.functions import vectors as V
from quillmine.operators import cluster, fold, labels, scoring
from quillmine.plans import snapshot
from quillmine.session import materialize
from quillmine.sources import tables

SHORTEST = 12


def topics_of(questions: DataFrame, papers: DataFrame, threshold: float = 0.7, encode=None, year: int = 2025) -> tuple[DataFrame, DataFrame]:
    """(topics, members): ``members`` links each question to its topic; ``rank_no`` counts topics within a module as of ``year``."""
    live = papers.filter("status = 'approved'").select(F.col("id").alias("paper_id"), F.upper(F.trim("subject_code")).alias("subject"), "exam_year")
    rows = questions.select(F.col("id").cast("long").alias("id"), "paper_id", "module_no", "text", "marks").join(live, "paper_id")
    rows = rows.filter(F.col("subject").isNotNull() & F.col("module_no").between(1, 5) & (F.length(F.trim("text")) >= SHORTEST))
    rows = rows.withColumn("clean", X.clean_for_embedding(F.col("text"))).filter(F.length("clean") >= SHORTEST)
    encoded = rows.select("subject", "module_no", "id", (encode or V.encoder())(F.col("clean")).alias("vector"))
    found = materialize(cluster.clusters(materialize(encoded, "encoded"), ["subject", "module_no"], threshold), "clusters")
    members = found.join(rows.select("id", "paper_id", "text", "marks", "exam_year"), "id")
    newest = F.struct(F.coalesce("exam_year", F.lit(0)), F.length("text"), -F.col("id"))
    topics = members.groupBy("subject", "module_no", "cluster").agg(
        F.max_by("text", newest).alias("representative_text"),
        F.coalesce(F.avg(F.when(F.col("marks") != 0, F.col("marks"))), F.lit(0.0)).alias("avg_marks"),
        F.countDistinct("paper_id").alias("frequency"), F.max("exam_year").alias("last_seen_year"), F.min("id").alias("first_id"),
    )
    asked = F.least(F.lit(year), F.when(F.col("exam_year") != 0, F.col("exam_year")))
    once = members.groupBy("subject", "module_no", "cluster", "paper_id").agg(F.max("exam_year").alias("exam_year"))
    score = once.groupBy("subject", "module_no", "cluster").agg(F.sum(F.pow(F.lit(scoring.DECAY), F.lit(year) - asked)).alias("score"))
    total = live.groupBy("subject").agg(F.count("*").alias("total"))
    topics = topics.join(score, ["subject", "module_no", "cluster"]).join(total, "subject").withColumn("weighted_score", scoring.half_up(F.col("score") + 1e-9, 4))
    topics = scoring.ranked(topics.withColumn("topic_id", F.col("cluster"))).drop("topic_id", "score", "total")
    own = F.substring(F.sha2(F.concat_ws("|", "subject", "module_no", "first_id"), 256), 1, 12)
    topics = topics.withColumn("own", own)
    return topics, members.select("subject", "module_no", "cluster", F.col("id").alias("sub_question_id"), "text")


def carried(topics: DataFrame, members: DataFrame, previous: DataFrame) -> DataFrame:
    """Topics with ``stable_key`` and ``label``: the most voted old key that is free and its label, else new ones made from the topic itself.

    ``previous``: sub_question_id, stable_key and, where there are any, label.  Topics claim in order of module and rank.
    """
    topic = ["subject", "module_no", "cluster"]
    if "label" not in previous.columns:
        previous = previous.withColumn("label", F.lit(None).cast("string"))
    votes = members.join(previous, "sub_question_id").groupBy(*topic, "stable_key", "label").agg(F.count("*").alias("n"), F.min("sub_question_id").alias("first"))
    rows = topics.select(*topic, "rank_no", "own").join(fold.ballots(votes, topic), topic, "left").withColumn("topic", F.struct("module_no", "cluster"))
    claimed = fold.ordered_fold(rows, ["subject"], ["module_no", "rank_no"], ["topic", "votes", "own"], "topic struct<module_no: int, cluster: int>, stable_key string, old_label string", fold.claim_keys())
    keys = claimed.select("subject", F.col("topic.module_no").alias("module_no"), F.col("topic.cluster").alias("cluster"), "stable_key", X.blank_to_null(F.col("old_label")).alias("old_label"))
    keys = materialize(keys, "claimed")
    new = labels.topic_labels(members.join(keys.filter("old_label is null").select(*topic), topic), topic)
    label = X.clean_label(F.coalesce("old_label", "label"))
    return topics.drop("own", "first_id").join(keys, topic).join(new, topic, "left").withColumn("label", label).drop("old_label")


def published(questions: DataFrame, papers: DataFrame, previous: DataFrame, year: int = 2025, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(documents, topics) of all subjects with live papers: questions to clusters, scores, ranks, claimed keys, labels, ladders and documents.

    Topics are named by their keys.  ``previous``: former links of questions to keys and labels.
    """
    topics, members = topics_of(questions, papers, threshold, year=year)
    topics, members = materialize(topics, "topics"), materialize(members, "members")
    total = papers.filter("status = 'approved'").groupBy(F.upper(F.trim("subject_code")).alias("subject")).agg(F.count("*").alias("total"))
    keyed = carried(topics, members, previous).join(total, "subject")
    share = F.col("frequency") / F.col("total")
    ranks = keyed.withColumn("share", share).withColumn("expected", scoring.half_up(share * F.col("avg_marks"), 2)).withColumn("topic_id", F.col("stable_key"))
    ranks = materialize(ranks, "ranks")
    live = papers.filter("status = 'approved'").select(F.col("id").alias("paper_id"), "exam_year")
    asked = questions.select(F.col("id").cast("long").alias("sub_question_id"), "paper_id", "marks")
    met = members.join(ranks.select("subject", "module_no", "cluster", "topic_id"), ["subject", "module_no", "cluster"]).select("topic_id", "sub_question_id", "text")
    met = met.join(asked, "sub_question_id").join(live, "paper_id")
    return snapshot.snapshots(met, ranks, papers), ranks


def publish(documents: DataFrame, papers: DataFrame, folder: str) -> None:
    """Replace the documents of the subjects in hand, and remove those of subjects without a live paper."""
    tables.write_snapshots(documents, folder)
    live = papers.filter("status = 'approved'").select(F.upper(F.trim("subject_code")).alias("subject"))
    tables.keep_subjects(documents.sparkSession, folder, live.distinct())
