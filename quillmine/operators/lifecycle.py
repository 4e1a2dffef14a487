"""Ingest life cycle on tables: updates as latest versions, swaps, cascades, gates and guards."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key, as one partial aggregate."""
    rest = [c for c in changes.columns if c not in keys]
    picked = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return picked.select(*keys, "v.*")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows replace those with their keys; the others stay."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def insert_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows are added unless their key is there already; of several with one key the least in column order."""
    rest = [c for c in table.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("v")).select(*keys, "v.*") if rest else rows.select(*keys).distinct()
    fresh = one.join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def cascade(papers: DataFrame, questions: DataFrame, links: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers without those that ``gone`` holds for, and what hangs on them taken along."""
    kept = papers.filter(~F.coalesce(gone, F.lit(False)))
    asked = questions.join(kept.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    linked = links.join(asked.select(F.col("id").alias("sub_question_id")), "sub_question_id", "left_semi")
    return kept, asked, linked


def swap(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """New papers take the place and session of old ones (``new_id``, ``old_id``) in one rewrite."""
    old = pairs.select(F.col("old_id").alias("id"), F.lit("rejected").alias("s"))
    taken = pairs.join(papers.select(F.col("id").alias("old_id"), F.col("session_key").alias("k")), "old_id")
    new = taken.select(F.col("new_id").alias("id"), F.lit("approved").alias("s"), "k")
    both = papers.join(old.withColumn("k", F.lit(None).cast("string")).unionByName(new), "id", "left")
    return both.withColumn("session_key", F.when(F.col("s") == "approved", F.col("k")).otherwise(F.col("session_key"))).withColumn("status", F.coalesce("s", "status")).select(*papers.columns)


def one_per_session(papers: DataFrame) -> DataFrame:
    """Of approved papers with one session, the first stays approved and the others go to review; null keys are free."""
    first = Window.partitionBy("session_key").orderBy("reviewed_at", "id")
    contested = papers.filter((F.col("status") == "approved") & F.col("session_key").isNotNull())
    later = contested.withColumn("n", F.row_number().over(first)).filter("n > 1").select("id", F.lit("review").alias("to"))
    return papers.join(later, "id", "left").withColumn("status", F.coalesce("to", "status")).select(*papers.columns)


def gate(questions: Column, modules: Column) -> Column:
    """What becomes of a paper after reading."""
    return F.when((F.coalesce(questions, F.lit(0)) < 5) | (F.coalesce(modules, F.lit(0)) < 3), "rejected").otherwise("awaiting_confirmation")


def violations(code: Column, paper_type: Column, year: Column, month: Column, known_months: Sequence[str], this_year: int) -> Column:
    """What speaks against a confirmed entry, as an array."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.upper(F.trim(code)).rlike(r"^B[A-Z]{1,5}\d{3}[A-Z]?$"), F.lit(False)), F.lit("code")),
            F.when(~F.coalesce(paper_type.isin("see", "model"), F.lit(False)), F.lit("type")),
            F.when(year.isNotNull() & ~year.between(2015, this_year + 1), F.lit("year range")),
            F.when((paper_type == "see") & (year.isNull() | month.isNull()), F.lit("session")),
            F.when(month.isNotNull() & ~month.isin(list(known_months)), F.lit("month")),
        )
    )


def page_guard(encrypted: Column, pages: Column, side: Column, most: int = 6) -> Column:
    """Why a file isn't read, else null."""
    return F.when(encrypted, "encrypted").when(pages < 1, "empty").when(pages > most, "too many pages").when(side > 2_000, "page too large")


def looks_like_pdf(content: Column) -> Column:
    """Whether the first KiB has the signature."""
    return F.locate("%PDF-", F.decode(F.substring(content, 1, 1024), "ISO-8859-1")) > 0


def client_address(forwarded: Column, peer: Column) -> Column:
    """Last hop of a forwarded header, else the peer."""
    hop = F.trim(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.when(hop != "", hop), F.when(peer != "", peer), F.lit("unknown"))


def duplicate_message(status: Column) -> Column:
    """What an uploader of a known file is told."""
    return F.when(status == "approved", "This paper is already published.").when(status == "rejected", "This file was reviewed and rejected.").otherwise("This file is already being processed.")


def requeue(papers: DataFrame) -> DataFrame:
    """(id, job) of work that a restart takes up again."""
    open_ = papers.filter(F.col("status").isin("processing", "approved") & (F.col("stage") != "done"))
    return open_.select("id", F.when(F.col("status") == "approved", "publish").when(F.col("stage") == "matching", "match").otherwise("process").alias("job"))


#: From which states an action may be taken, and the state it leads to.
ACTIONS = {"approve": (("review", "awaiting_confirmation"), "approved"), "reject": (("review", "awaiting_confirmation", "processing", "failed"), "rejected"), "reprocess": (("review", "rejected", "failed"), "processing")}


def reviewed(papers: DataFrame, orders: DataFrame) -> DataFrame:
    """(id, status, session_key, refused): papers after review orders (``id``, ``action``), one per paper.

    An order that the state doesn't allow is refused, and so is an approval whose session has a live paper; of several
    approvals for one session the least id is carried out.  Rejected papers give their session free.
    """
    rows = papers.select("id", "status", "session_key").join(orders.groupBy("id").agg(F.min("action").alias("action")), "id", "left")
    allowed = F.lit(False)
    for action, (states, _) in ACTIONS.items():
        allowed = allowed | ((F.col("action") == action) & F.col("status").isin(*states))
    rows = rows.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
    taken = rows.filter("status = 'approved' and session_key is not null").select("session_key", F.lit(True).alias("taken")).distinct()
    first = rows.filter("allowed and action = 'approve' and session_key is not null").groupBy("session_key").agg(F.min("id").alias("first"))
    rows = rows.join(taken, "session_key", "left").join(first, "session_key", "left")
    clash = (F.col("action") == "approve") & F.col("session_key").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("id") > F.col("first")))
    refused = F.when(F.col("action").isNull(), None).when(~F.col("allowed"), "state").when(clash, "session")
    to = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("processing")
    done = F.col("action").isNotNull() & refused.isNull()
    return rows.select(
        "id", F.when(done, to).otherwise(F.col("status")).alias("status"), F.when(done & (F.col("action") == "reject"), None).otherwise(F.col("session_key")).alias("session_key"), refused.alias("refused")
    )


def edited(papers: DataFrame, edits: DataFrame, session: Column) -> DataFrame:
    """Papers with confirmed entries (``id``, ``subject_code``, ``exam_year``, ``exam_month``, ``paper_type``) put in and ``session`` computed anew.

    A live paper is not edited.
    """
    fields = ["subject_code", "exam_year", "exam_month", "paper_type"]
    new = edits.select("id", F.struct(*fields).alias("e"))
    both = papers.join(new, "id", "left").withColumn("open", F.col("e").isNotNull() & ~F.coalesce(F.col("status") == "approved", F.lit(False)))
    for f in fields:
        both = both.withColumn(f, F.when(F.col("open"), F.col(f"e.{f}")).otherwise(F.col(f)))
    return both.withColumn("session_key", F.when(F.col("open"), session).otherwise(F.col("session_key"))).select(*papers.columns)


def after_jobs(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Papers after jobs (``id``, ``job``, ``error``): a failed reading or matching leaves the paper failed with the reason, a failed publish leaves it live."""
    bad = results.filter(F.col("error").isNotNull() & F.col("job").isin("process", "match")).groupBy("id").agg(F.min("error").alias("error"))
    both = papers.join(bad, "id", "left")
    failed = F.col("error").isNotNull()
    return both.withColumns({"status": F.when(failed, "failed").otherwise(F.col("status")), "status_reason": F.when(failed, F.substring("error", 1, 300)).otherwise(F.col("status_reason"))}).select(*papers.columns)


def upload_check(content: Column, declared: Column, blocked: Column, within: Column, most: int = 10 << 20, slack: int = 64 << 10) -> Column:
    """Why an upload is refused, else null: uploader, rate, declared size, size, signature, in this order."""
    size = F.length(content)
    return (
        F.when(blocked, "blocked").when(~within, "too often").when(declared > most + slack, "too large").when(size > most, "too large").when(~F.coalesce(looks_like_pdf(content), F.lit(False)), "not a pdf")
    )


def keyed_hash(secret: str):
    """A pandas UDF: the first 16 hex digits of the keyed hash of an address; null stays null."""
    import hashlib
    import hmac

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest()[:16])

    return run
