"""Labels of topics from all their wordings: a phrase of a good wording, else leading words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions import text as X
from quillmine.session import materialize

#: Wordings that are tried for a phrase, and the length from which one counts as a question.
TRIED, SHORTEST = 3, 12


def topic_labels(wordings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label) of wordings (keys, ``sub_question_id``, ``text``).

    Well-formed wordings are tried first, then short ones; short fragments only where there is nothing else.
    """
    rows = wordings.filter("text is not null").select(*keys, "sub_question_id", "text")
    bare = rows.withColumn("bare", X.bare_wording(F.col("text"))).withColumn("short", F.length("bare") < SHORTEST)
    whole = ~F.col("short")
    order = Window.partitionBy(*keys).orderBy("short", F.when(whole, ~X.well_formed(F.col("bare"))), F.when(whole, F.length("bare")), "sub_question_id")
    tried = bare.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TRIED).select(*keys, "n", "short", X.phrase_of(F.col("bare")).alias("phrase"))
    best = F.min(F.when(F.col("phrase").isNotNull(), F.struct("short", "n", "phrase")))
    phrases = tried.groupBy(*keys).agg(best.alias("best"), F.min("short").alias("short"))
    phrases = materialize(phrases.select(*keys, F.when(F.col("best.short") == F.col("short"), F.col("best.phrase")).alias("phrase")), "phrases")
    others = rows.join(phrases.filter("phrase is null").select(*keys), keys)
    labels = phrases.join(keyword_labels(others, keys), keys, "left")
    return labels.select(*keys, X.clean_label(F.coalesce("phrase", "leaders")).alias("label"))


def keyword_labels(wordings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaders): the leading words of each topic, a neighbouring pair counting double.

    Two leading words that are neighbours are merged, two of equal score joined by '&'; without any word the first text is cut.
    """
    words = F.transform(F.filter(F.regexp_extract_all("text", F.lit(r"(?U)\b([a-zA-Z]{3,})\b"), F.lit(1)), lambda w: ~F.lower(w).isin(X.STOP_WORDS)), X.shown_word)
    rows = wordings.select(*keys, "sub_question_id", words.alias("ws"))
    single = F.transform("ws", lambda w, i: F.struct(w.alias("term"), F.lit(1).alias("weight"), i.alias("at")))
    pairs = F.transform("ws", lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(F.col("ws"), i + 1)).alias("term"), F.lit(2).alias("weight"), i.alias("at")))
    terms = rows.select(*keys, "sub_question_id", F.explode(F.concat(single, pairs)).alias("t")).select(*keys, "sub_question_id", "t.*").filter("term is not null")
    counted = materialize(terms.groupBy(*keys, "term", "weight").agg(F.sum("weight").alias("score"), F.min(F.struct("sub_question_id", "at")).alias("first")), "terms")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(F.length("term")), "weight", "first")
    top = counted.withColumn("n", F.row_number().over(order)).filter("n <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("n") == 1, F.struct("term", "score"))).alias("a"), F.max(F.when(F.col("n") == 2, F.struct("term", "score"))).alias("b")
    )
    top = top.select(*keys, "a", "b", F.concat("a.term", F.lit(" "), "b.term").alias("term"))
    merged = top.join(counted.filter("weight = 2").select(*keys, "term", F.lit(True).alias("met")), [*keys, "term"], "left")
    leaders = F.when(F.col("met"), F.col("term")).when(F.col("a.score") == F.col("b.score"), F.concat("a.term", F.lit(" & "), "b.term")).otherwise(F.col("a.term"))
    first = wordings.groupBy(*keys).agg(F.substring(F.min_by("text", "sub_question_id"), 1, 40).alias("cut"))
    return first.join(merged.select(*keys, leaders.alias("leaders")), keys, "left").select(*keys, F.coalesce("leaders", "cut").alias("leaders"))
