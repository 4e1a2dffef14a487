"""Words with places on a page put into rows and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of the six cells as shares of the page width.
EDGES = (0.0, 0.13, 0.17, 0.74, 0.83, 0.89, 1.0)
BAND = 14


def centred(words: DataFrame) -> DataFrame:
    """Readable words with their centres."""
    ok = ~F.coalesce(F.col("conf"), F.lit("")).isin("-1", "") & (F.trim("text") != "")
    return words.filter(ok).select("page_id", "word_no", F.trim("text").alias("text"), (F.col("left") + F.floor(F.col("width") / 2)).cast("int").alias("cx"), (F.col("top") + F.floor(F.col("height") / 2)).cast("int").alias("cy"))


def bucket(cx: Column, width: Column) -> Column:
    """Cell 0 to 5 that a centre falls in; beyond the page it is the last."""
    out = F.lit(5)
    for i in range(5, -1, -1):
        low, high = (F.floor(width * e).cast("int") for e in EDGES[i : i + 2])
        out = F.when((cx >= low) & (cx < high), i).otherwise(out)
    return out.cast("int")


def bands(words: DataFrame) -> DataFrame:
    """Words with the height of their band: a word joins while it is near the band's first word.

    The fold runs over one page's words, whose number a page bounds.
    """
    page = words.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cy", "word_no", "cx", "text"))).alias("ws"))
    start = F.struct(F.lit(None).cast("int").alias("anchor"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, w: Column) -> Column:
        anchor = F.when(acc["anchor"].isNull() | (w["cy"] - acc["anchor"] > BAND), w["cy"]).otherwise(acc["anchor"])
        return F.struct(anchor.alias("anchor"), F.concat(acc["all"], F.array(anchor)).alias("all"))

    folded = page.select("page_id", "ws", F.aggregate("ws", start, step)["all"].alias("anchors"))
    each = folded.select("page_id", F.explode(F.arrays_zip("ws", "anchors")).alias("z"))
    return each.select("page_id", F.col("z.ws.word_no").alias("word_no"), F.col("z.ws.text").alias("text"), F.col("z.ws.cx").alias("cx"), F.col("z.ws.cy").alias("cy"), F.col("z.anchors").alias("anchor"))


def cells(words: DataFrame, width: int) -> DataFrame:
    """(page_id, anchor, cells): the words of each band joined per cell, blank cells at the end left out."""
    placed = bands(words).withColumn("cell", bucket(F.col("cx"), F.lit(width)))
    joined = placed.groupBy("page_id", "anchor", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "cy", "word_no", "text"))), lambda s: s["text"]), " ").alias("text"))
    rows = joined.groupBy("page_id", "anchor").agg(F.map_from_entries(F.collect_list(F.struct("cell", "text"))).alias("m"), F.max("cell").alias("last"))
    return rows.select("page_id", "anchor", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("cells"))
