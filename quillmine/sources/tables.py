"""Readers and writers: files of pages, the catalogue, parsed rows, question banks and published documents."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import materialize, remove_path

#: The stored tables, as schema strings.
PAPERS = (
    "id int, status string, stage string, status_reason string, subject_code string, subject_name string, exam_year int, exam_month string, paper_type string, "
    "session_key string, detected string, filename string, content_hash string, storage_key string, pdf_type string, page_count int, question_count int, modules_found int, "
    "upload_token_hash string, uploader_hash string, reviewed_by string, reviewed_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)
SUB_QUESTIONS = "id int, paper_id int, module_no int, q_no int, sub_q string, is_or_alt int, text string, marks int, bloom_level string, course_outcome string"
TOPICS = "id int, subject_code string, module_no int, stable_key string, label string, representative_text string, avg_marks double, frequency int, weighted_score double, last_seen_year int"
STORE = "content_hash string, content binary, part string"
RAW_ROWS = "paper_id int, row_no int, cells array<string>"

Extractor = Callable[[bytes], list[list[str]]]


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder with content, hash and size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", F.sha2("content", 256).alias("content_hash"), "content")


def stream_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", at_once: int = 1_000) -> DataFrame:
    """The same folder as a stream of arriving files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) of a ``CODE: name`` text file; comments and blank lines left out, codes in upper case."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    name = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("v", r"^[^:]+:(.*)$", 1), r"\s+#.*$", "")), r"^[\"']|[\"']$", "")
    return lines.select(F.upper(F.trim(F.regexp_replace(F.split("v", ":")[0], "[\"']", ""))).alias("code"), name.alias("name")).filter("name <> ''")


def extract_rows(files: DataFrame, native: Extractor, scanned: Extractor | None = None, least_text: int = 100) -> DataFrame:
    """(path, pdf_type, row_no, cells, failed) of files: the native reader first, the scan reader where that finds too little text.

    Readers are passed in, as none is installed with this package; a file no reader can read has one row
    without cells, and ``failed`` says what went wrong.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, kind, failed = [], "native", []
                for kind, reader in (("native", native), ("scanned", scanned)):
                    if reader is None:
                        continue
                    try:
                        rows = [[(c or "").strip() for c in r] for r in reader(bytes(content))]
                    except Exception as e:  # noqa: BLE001
                        rows = []
                        failed.append(f"{kind}: {type(e).__name__}: {str(e)[:200]}")
                    rows = [r for r in rows if any(r)]
                    if kind == "scanned" or sum(len(c) for r in rows for c in r) >= least_text:
                        break
                why = "; ".join(failed) or None
                out += [(path, kind, i, r, why) for i, r in enumerate(rows)] or [(path, None, None, None, why or "no text")]
            yield pd.DataFrame(out, columns=["path", "pdf_type", "row_no", "cells", "failed"])

    return files.select("path", "content").mapInPandas(run, "path string, pdf_type string, row_no int, cells array<string>, failed string")


def header_rows(pages: DataFrame, most: int = 20) -> DataFrame:
    """(paper_id, row_no, cells) of the first non-blank lines of page texts (``paper_id``, ``text``)."""
    lines = F.slice(F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x) != ""), 1, most)
    return pages.select("paper_id", F.posexplode(lines).alias("row_no", "line")).select("paper_id", "row_no", F.array(F.trim("line")).alias("cells"))


def stretch(pixels, cutoff: float = 2.0):
    """Grey values spread over the full range after ``cutoff`` percent are clipped at both ends (numpy in and out)."""
    import numpy as np

    flat = np.asarray(pixels)
    low, high = np.percentile(flat, [cutoff, 100 - cutoff], method="nearest")
    if high <= low:
        return flat.astype(np.uint8)
    return np.clip((flat.astype(float) - low) * 255.0 / (high - low), 0, 255).round().astype(np.uint8)


def write_store(files: DataFrame, folder: str) -> None:
    """Files kept by content, in folders by the first signs of their hash; a hash is stored once."""
    kept = files.dropDuplicates(["content_hash"]).withColumn("part", F.substring("content_hash", 1, 2))
    kept.select("part", "content_hash", "content").write.mode("append").partitionBy("part").parquet(folder)


def write_bank(rows: DataFrame, folder: str) -> None:
    """The question bank as CSV, one folder per subject, in order of module and priority."""
    rows.repartition("subject").sortWithinPartitions("subject", "module", "priority").write.mode("overwrite").partitionBy("subject").option("header", True).csv(folder)


def write_snapshots(snapshots: DataFrame, folder: str) -> None:
    """Published documents; only the subjects in hand are replaced."""
    snapshots.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(folder)


def keep_subjects(spark: SparkSession, folder: str, live: DataFrame) -> int:
    """Remove the documents of subjects that are not in ``live`` (``subject``); returns how many were removed."""
    stored = spark.read.schema("subject string").parquet(folder).select("subject").distinct().join(live, "subject", "left_anti")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = {r[0] for r in stored.collect()}
    removed = 0
    for status in files.listStatus(path):
        name = unquote(status.getPath().getName())
        if name.startswith("subject=") and name[8:] in gone:
            files.delete(status.getPath(), True)
            removed += 1
    return removed


def get_stored(spark: SparkSession, folder: str, content_hash: str) -> bytes | None:
    """The content kept under a hash, else none; a name that is no hash is refused, so no path leads out of the store."""
    part = _part(content_hash)
    rows = spark.read.schema(STORE).parquet(folder).filter((F.col("part") == part) & (F.col("content_hash") == content_hash)).select("content").limit(1).collect()
    return bytes(rows[0][0]) if rows else None


def delete_stored(spark: SparkSession, folder: str, hashes: DataFrame) -> DataFrame:
    """The store without the given hashes (``content_hash``); only folders that hold one of them are written anew."""
    touched = [r[0] for r in hashes.filter(F.col("content_hash").rlike("^[0-9a-f]{64}$")).select(F.substring("content_hash", 1, 2)).distinct().collect()]
    rest = materialize(spark.read.schema(STORE).parquet(folder).filter(F.col("part").isin(touched)).join(hashes, "content_hash", "left_anti").select("part", "content_hash", "content"), "store")
    for part in touched:
        remove_path(spark, f"{folder}/part={part}")
    rest.write.mode("append").partitionBy("part").parquet(folder)
    return rest


def _part(content_hash: str) -> str:
    if not re.fullmatch("[0-9a-f]{64}", content_hash):
        raise ValueError("not a content hash")
    return content_hash[:2]


def read_database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A table of a relational database over JDBC, in ranges of a numeric key read side by side."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def merged_headers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Metadata (``paper_id``, ``code``, ``name``, ``month``, ``year``) of a scan's second header reading put in where the first has none.

    Code and name come together, and only where the first reading has no code.
    """
    other = second.select("paper_id", *(F.col(c).alias(f"{c}_2") for c in ("code", "name", "month", "year")))
    both = first.join(other, "paper_id", "left")
    lost = F.col("code").isNull()
    named = {c: F.when(lost, F.coalesce(f"{c}_2", c)).otherwise(F.col(c)) for c in ("code", "name")}
    dated = {c: F.when(lost, F.coalesce(c, f"{c}_2")).otherwise(F.col(c)) for c in ("month", "year")}
    chosen = named | dated
    return both.select(*(chosen[c].alias(c) if c in chosen else c for c in first.columns))


def read_snapshot(spark: SparkSession, folder: str, subject: str) -> DataFrame:
    """One subject's document; other subjects' folders aren't read."""
    return spark.read.parquet(folder).filter(F.col("subject") == subject).select("data")
