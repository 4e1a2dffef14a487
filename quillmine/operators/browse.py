"""What readers look up: search, facets, coverage, presence and the topic graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.text import label_family


def matches(words: str, *fields: Column) -> Column:
    """Whether every word of a search stands somewhere in the fields."""
    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(True)
    for word in words.lower().split():
        out = out & F.contains(hay, F.lit(word))
    return out


def facet(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count per stated value, zero where none, and ``all``."""
    fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    each = F.broadcast(fixed).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return each.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("all").alias(column), "n"))


def missing(catalogue: DataFrame, bank: DataFrame, words: str, most: int = 6) -> DataFrame:
    """First catalogue entries that a search finds and the bank lacks."""
    return catalogue.filter(matches(words, F.col("code"), F.col("name"))).join(bank, "code", "left_anti").orderBy("code").limit(most)


def coverage(topics: DataFrame, studied: DataFrame, cap: float) -> DataFrame:
    """(subject, module_no, covered): expected marks of studied topics, rounded and at most ``cap``."""
    kept = topics.join(studied, "topic_id", "left_semi")
    return kept.groupBy("subject", "module_no").agg(F.floor(F.least(F.sum("expected"), F.lit(cap)) + 0.5).cast("long").alias("covered"))


def presence(topics: DataFrame, sessions: DataFrame, met: DataFrame) -> DataFrame:
    """(topic_id, paper_id, present) for every session of a topic's subject."""
    every = topics.select("topic_id", "subject").join(sessions.select("subject", "paper_id"), "subject")
    seen = met.select("topic_id", "paper_id", F.lit(True).alias("hit")).distinct()
    return every.join(seen, ["topic_id", "paper_id"], "left").select("topic_id", "paper_id", F.coalesce("hit", F.lit(False)).alias("present"))


def edges(topics: DataFrame) -> DataFrame:
    """(a, b, weight): neighbours in a module in order of id, 0.6 where they are of one label family and 0.15 else.

    All topics of a family are kin with 0.6, wherever they stand; ``family_members`` has that as one row per topic, not as all pairs.
    """
    named = topics.withColumn("family", label_family(F.col("label")))
    row = Window.partitionBy("subject", "module_no").orderBy("topic_id")
    near = named.select(F.col("topic_id").alias("a"), F.lead("topic_id").over(row).alias("b"), (F.col("family") == F.lead("family").over(row)).alias("kin"))
    return near.filter(F.col("b").isNotNull()).select("a", "b", F.when(F.col("kin"), 0.6).otherwise(0.15).alias("weight"))


def family_members(topics: DataFrame) -> DataFrame:
    """(subject, topic_id, family, first, kin): each topic's label family, its least topic, and how many others are kin."""
    named = topics.withColumn("family", label_family(F.col("label"))).filter(F.col("family").isNotNull())
    sizes = named.groupBy("subject", "family").agg((F.count("*") - 1).alias("kin"), F.min("topic_id").alias("first"))
    return named.select("subject", "topic_id", "family").join(sizes, ["subject", "family"])


def ordered_cards(cards: DataFrame, by: str) -> DataFrame:
    """Subject cards (``code``, ``papers``, ``changed``) by number of papers, by latest change, or by code."""
    orders = {"papers": [F.desc("papers"), F.asc("code")], "changed": [F.desc_nulls_last("changed"), F.asc("code")], "code": [F.asc("code")]}
    return cards.orderBy(*orders[by])


def year_range(low: Column, high: Column) -> Column:
    """Years as readers see them: one year, a range, or nothing."""
    return F.when(low.isNull() | high.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def counted(n: Column, one: str) -> Column:
    """A number with its noun in singular or plural."""
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(one + "s"))


def upload_refusal(filename: Column, size: Column, number: Column, most: int = 10 << 20, files: int = 10) -> Column:
    """Why a chosen file isn't sent, else null; ``number`` counts the chosen files from 1."""
    return F.when(number > files, "too many files").when(~F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)), "not a pdf").when(size > most, "too large")
