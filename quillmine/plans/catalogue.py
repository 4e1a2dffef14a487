"""The query catalogue: every operator applied to whole tables, with the SQL that states the same.

Each query takes the session and the folder of tables.  ``SQL`` has the equivalent for those that
SQL can state on whole tables; the others are tested against plain Python on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.functions import catalog as C
from quillmine.functions import text as X
from quillmine.functions import vectors as V
from quillmine.operators import browse, fold, headers, labels, layout, lifecycle, match, parse, scoring
from quillmine.plans import rebuild, snapshot
from quillmine.session import bounded, materialize, table, work_path
from quillmine.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
YEAR = 2025


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- lookups, filters, sorts, counts


@query("SELECT id, status, stage, subject_code FROM papers WHERE id = 7")
def paper_by_id(spark, sf):
    return table(spark, sf, "papers").filter("id = 7").select("id", "status", "stage", "subject_code")


@query("SELECT p.id FROM papers p WHERE EXISTS (SELECT 1 FROM papers q WHERE q.content_hash = p.content_hash AND q.id < p.id)")
def hash_probe(spark, sf):
    papers = table(spark, sf, "papers").filter("content_hash is not null").select("id", "content_hash")
    first = papers.groupBy("content_hash").agg(F.min("id").alias("first"))
    return papers.join(first, "content_hash").filter("id > first").select("id")


@query("""SELECT paper_id, id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY module_no, q_no, sub_q, id) AS INTEGER) AS place FROM sub_questions""")
def paper_questions(spark, sf):
    order = Window.partitionBy("paper_id").orderBy("module_no", "q_no", F.asc_nulls_last("sub_q"), "id")
    return table(spark, sf, "sub_questions").select("paper_id", "id", F.row_number().over(order).alias("place"))


_MONTHS_SQL = "['January','February','March','April','May','June','July','August','September','October','November','December']"


@query(f"""SELECT upper(trim(subject_code)) AS subject, id, CAST(row_number() OVER (PARTITION BY upper(trim(subject_code))
    ORDER BY coalesce(exam_year, 0) DESC, coalesce(list_position({_MONTHS_SQL}, exam_month), 0) DESC, CASE WHEN paper_type = 'see' THEN 1 ELSE 0 END DESC, id) AS INTEGER) AS session_no
    FROM papers WHERE status = 'approved'""")
def live_order(spark, sf):
    return snapshot.live_order(table(spark, sf, "papers")).select("subject", "id", "session_no")


@query("""SELECT p.id, count(*) AS others FROM papers p JOIN papers q ON p.session_key = q.session_key AND p.id <> q.id
    WHERE q.status = 'approved' GROUP BY p.id""")
def session_clash(spark, sf):
    papers = table(spark, sf, "papers").filter("session_key is not null").select("id", "session_key", (F.col("status") == "approved").cast("int").alias("live"))
    per = papers.groupBy("session_key").agg(F.sum("live").alias("live_all"))
    return papers.join(per, "session_key").select("id", (F.col("live_all") - F.col("live")).alias("others")).filter("others > 0")


@query("""SELECT p.id, (SELECT count(*) FROM papers q WHERE q.status = 'approved' AND q.subject_code = p.subject_code AND q.id <> p.id) AS peers FROM papers p""")
def subject_peers(spark, sf):
    papers = table(spark, sf, "papers").select("id", "subject_code", F.coalesce(F.col("status") == "approved", F.lit(False)).cast("int").alias("live"))
    per = papers.groupBy("subject_code").agg(F.sum("live").alias("live_all"))
    return papers.join(per, "subject_code", "left").select("id", F.coalesce(F.col("live_all") - F.col("live"), F.lit(0)).cast("long").alias("peers"))


@query("SELECT s.id, s.paper_id, p.exam_year FROM sub_questions s JOIN papers p ON p.id = s.paper_id WHERE p.status = 'approved'")
def live_questions(spark, sf):
    live = table(spark, sf, "papers").filter("status = 'approved'").select(F.col("id").alias("paper_id"), "exam_year")
    return table(spark, sf, "sub_questions").select("id", "paper_id").join(live, "paper_id").select("id", "paper_id", "exam_year")


@query("""SELECT id, CASE WHEN status = 'approved' THEN 'publish' WHEN stage = 'matching' THEN 'match' ELSE 'process' END AS job
    FROM papers WHERE status IN ('processing', 'approved') AND stage <> 'done'""")
def requeue(spark, sf):
    return lifecycle.requeue(table(spark, sf, "papers"))


@query("SELECT DISTINCT a.sub_question_id, t.stable_key, t.label FROM topic_appearances a JOIN topics t ON t.id = a.topic_id")
def previous_keys(spark, sf):
    topics = table(spark, sf, "topics").select(F.col("id").alias("topic_id"), "stable_key", "label")
    return table(spark, sf, "topic_appearances").join(topics, "topic_id").select("sub_question_id", "stable_key", "label").distinct()


@query("SELECT status, count(*) AS n FROM papers GROUP BY status")
def status_counts(spark, sf):
    return table(spark, sf, "papers").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM papers WHERE status = 'approved') AS live, (SELECT count(*) FROM topics) AS topics, (SELECT max(updated_at) FROM papers) AS changed")
def stats(spark, sf):
    papers = table(spark, sf, "papers").agg(F.count_if(F.col("status") == "approved").alias("live"), F.max("updated_at").alias("changed"))
    return papers.crossJoin(table(spark, sf, "topics").agg(F.count("*").alias("topics"))).select("live", "topics", "changed")


@query("SELECT DISTINCT subject_code FROM papers WHERE status = 'approved'")
def distinct_subjects(spark, sf):
    return table(spark, sf, "papers").filter("status = 'approved'").select("subject_code").distinct()


@query("SELECT id, subject_code, reviewed_at FROM papers WHERE status = 'approved' AND reviewed_at IS NOT NULL ORDER BY reviewed_at DESC, id LIMIT 20")
def recent(spark, sf):
    papers = table(spark, sf, "papers").filter("status = 'approved' and reviewed_at is not null")
    return papers.select("id", "subject_code", "reviewed_at").orderBy(F.desc("reviewed_at"), "id").limit(20)


@query("SELECT id, status, subject_code, created_at FROM papers WHERE status = 'review' ORDER BY created_at DESC, id LIMIT 500")
def admin_list(spark, sf, status="review", subject=None, most=500):
    papers = table(spark, sf, "papers").select("id", "status", "subject_code", "created_at")
    if status:
        papers = papers.filter(F.col("status") == status)
    if subject:
        papers = papers.filter(F.col("subject_code") == subject)
    return papers.orderBy(F.desc("created_at"), "id").limit(most)


@query("""WITH f AS (SELECT paper_id, module_no, id, row_number() OVER (PARTITION BY paper_id, module_no ORDER BY q_no, sub_q, id) AS n FROM sub_questions),
    m AS (SELECT paper_id, module_no, id, row_number() OVER (PARTITION BY paper_id ORDER BY module_no) AS place FROM f WHERE n = 1)
    SELECT paper_id, module_no, id FROM m WHERE place <= 3""")
def preview(spark, sf):
    first = table(spark, sf, "sub_questions").groupBy("paper_id", "module_no").agg(F.min(F.struct(F.col("q_no").isNull(), "q_no", F.col("sub_q").isNull(), "sub_q", "id")).alias("f"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.asc_nulls_last("module_no")))
    return first.withColumn("place", place).filter("place <= 3").select("paper_id", "module_no", F.col("f.id").alias("id"))


@query("SELECT session_key, count(*) AS n FROM papers WHERE status = 'approved' AND session_key IS NOT NULL GROUP BY session_key HAVING count(*) > 1")
def unique_violations(spark, sf):
    live = table(spark, sf, "papers").filter("status = 'approved' and session_key is not null")
    return live.groupBy("session_key").agg(F.count("*").alias("n")).filter("n > 1")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'approved' AND session_key IS NOT NULL
    AND row_number() OVER (PARTITION BY session_key, status ORDER BY reviewed_at NULLS FIRST, id) > 1 THEN 'review' ELSE status END AS status FROM papers) GROUP BY status""")
def one_per_session(spark, sf):
    return lifecycle.one_per_session(table(spark, sf, "papers")).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT uploader_hash FROM papers WHERE status = 'rejected' AND uploader_hash IS NOT NULL GROUP BY uploader_hash HAVING count(*) >= 2)
    SELECT p.id, p.uploader_hash FROM papers p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.uploader_hash = p.uploader_hash)""")
def allowed_uploads(spark, sf):
    papers = table(spark, sf, "papers")
    blocked = papers.filter("status = 'rejected' and uploader_hash is not null").groupBy("uploader_hash").count().filter("count >= 2")
    return papers.select("id", "uploader_hash").join(blocked, "uploader_hash", "left_anti").select("id", "uploader_hash")


@query("""SELECT (SELECT count(*) FROM papers WHERE status <> 'rejected') AS papers,
    (SELECT count(*) FROM sub_questions s JOIN papers p ON p.id = s.paper_id WHERE p.status <> 'rejected') AS questions,
    (SELECT count(*) FROM topic_appearances a JOIN sub_questions s ON s.id = a.sub_question_id JOIN papers p ON p.id = s.paper_id WHERE p.status <> 'rejected') AS links""")
def cascade_delete(spark, sf):
    tables = lifecycle.cascade(table(spark, sf, "papers").filter("status is not null"), table(spark, sf, "sub_questions"), table(spark, sf, "topic_appearances"), F.col("status") == "rejected")
    counts = [t.agg(F.count("*").alias(n)) for t, n in zip(tables, ("papers", "questions", "links"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("""WITH o AS (SELECT session_key, max(id) AS new_id FROM papers WHERE status = 'review' AND session_key IS NOT NULL GROUP BY session_key),
    l AS (SELECT session_key, min(id) AS old_id FROM papers WHERE status = 'approved' AND session_key IS NOT NULL GROUP BY session_key),
    s AS (SELECT new_id, old_id, session_key FROM o JOIN l USING (session_key))
    SELECT p.id, CASE WHEN a.new_id IS NOT NULL THEN 'approved' WHEN b.old_id IS NOT NULL THEN 'rejected' ELSE p.status END AS status, p.session_key
    FROM papers p LEFT JOIN s a ON a.new_id = p.id LEFT JOIN s b ON b.old_id = p.id""")
def replace_papers(spark, sf):
    papers = table(spark, sf, "papers")
    keyed = papers.filter("session_key is not null")
    new = keyed.filter("status = 'review'").groupBy("session_key").agg(F.max("id").alias("new_id"))
    old = keyed.filter("status = 'approved'").groupBy("session_key").agg(F.min("id").alias("old_id"))
    return lifecycle.swap(papers, new.join(old, "session_key")).select("id", "status", "session_key")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def lifecycle_latest(spark, sf):
    return lifecycle.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def keep_last_day(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    last = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))
    return events.crossJoin(F.broadcast(last)).filter("ts >= since").select("event_id", "ts")


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, user_id, count(*) AS jobs FROM events GROUP BY 1, 2""")
def publish_coalesce(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "user_id").agg(F.count("*").alias("jobs"))


# ---------------------------------------------------------------- codes and sessions

_BRANCH_SQL = "CASE letters " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.BRANCHES.items()) + " ELSE 'Common' END"
_LETTERS_SQL = "regexp_extract(code, '^B([A-Z]+?)L?([0-9])([0-9]{2})[A-Z]?$', 1)"


@query(f"""SELECT code, name, {_BRANCH_SQL} AS branch, CAST(nullif(regexp_extract(code, '^B([A-Z]+?)L?([0-9])([0-9]{{2}})[A-Z]?$', 2), '') AS INTEGER) AS semester
    FROM (SELECT *, {_LETTERS_SQL} AS letters FROM subjects)""")
def catalogue(spark, sf):
    code = F.col("code")
    return table(spark, sf, "subjects").select("code", "name", C.branch_of(code).alias("branch"), C.semester_of(code).alias("semester")).orderBy("code")


@query("""SELECT p.id, CASE WHEN regexp_full_match(upper(trim(p.subject_code)), 'B[A-Z]{1,5}[0-9]{3}[A-Z]?') THEN upper(trim(p.subject_code)) END AS code, s.name
    FROM papers p LEFT JOIN subjects s ON s.code = upper(trim(p.subject_code))""")
def normal_codes(spark, sf):
    names = table(spark, sf, "subjects").select("code", "name")
    return table(spark, sf, "papers").select("id", C.normal_code(F.col("subject_code")).alias("code")).join(names, "code", "left").select("id", "code", "name")


@query(f"""SELECT id, CASE WHEN known AND exam_month IN ('November','December','February') THEN 'January' WHEN known AND exam_month IN ('May','June','August') THEN 'July' ELSE exam_month END AS month,
    CAST(CASE WHEN exam_month IN ('November','December') THEN exam_year + 1 ELSE exam_year END AS INTEGER) AS year,
    CASE WHEN paper_type = 'see' AND exam_month <> '' AND exam_year <> 0 THEN concat(coalesce(subject_code, 'None'), ':see:', exam_year, ':', lower(substring(exam_month, 1, 3))) END AS session_key,
    CASE WHEN paper_type = 'model' THEN trim(concat('Model paper ', coalesce(CAST(exam_year AS VARCHAR), ''))) WHEN exam_month <> '' AND exam_year IS NOT NULL THEN concat(substring(exam_month, 1, 3), ' ', exam_year)
         ELSE coalesce(CAST(exam_year AS VARCHAR), 'Undated') END AS label
    FROM (SELECT *, list_contains({_MONTHS_SQL}, exam_month) AND exam_year IS NOT NULL AND exam_year <> 0 AS known FROM papers)""")
def sessions(spark, sf):
    month, year, kind = F.col("exam_month"), F.col("exam_year"), F.col("paper_type")
    return table(spark, sf, "papers").select(
        "id", C.session_month(month, year).alias("month"), C.session_year(month, year).cast("int").alias("year"),
        C.session_key(F.col("subject_code"), kind, month, year).alias("session_key"), C.session_label(kind, month, year).alias("label"),
    )


# ---------------------------------------------------------------- metadata from names and headers

_STEM_SQL = "translate(regexp_replace(regexp_extract(filename, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '_-', '  ')"
_MONTH_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(stem), '(^|[^a-z]){m[:3].lower()}([^a-z]|$)') THEN '{m}'" for m in X.MONTHS) + " WHEN regexp_matches(lower(stem), '(^|[^a-z])june([^a-z]|$)') THEN 'June' WHEN regexp_matches(lower(stem), '(^|[^a-z])july([^a-z]|$)') THEN 'July' END"


@query(f"""SELECT id, {_MONTH_SQL} AS month,
    CAST(coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(stem, '([^0-9])', '\\1\\1', 'g'), '(^|[^0-9])((19|20)[0-9]{{2}})($|[^0-9])', 2), lambda x: CAST(x AS INTEGER))),
         CASE WHEN CAST(nullif(regexp_extract(stem, '\\b([2-9][0-9])\\b', 1), '') AS INTEGER) BETWEEN 20 AND 50 THEN 2000 + CAST(nullif(regexp_extract(stem, '\\b([2-9][0-9])\\b', 1), '') AS INTEGER) END) AS INTEGER) AS year,
    CASE WHEN regexp_matches(lower(stem), '\\b(mqp|model)\\b') THEN 'mqp' ELSE 'regular' END AS exam_type
    FROM (SELECT id, {_STEM_SQL} AS stem FROM papers)""")
def filename_metadata(spark, sf):
    stem = X.stem(F.col("filename"))
    return table(spark, sf, "papers").select("id", X.month_in(stem).alias("month"), X.year_of(stem).alias("year"), X.exam_type(stem).alias("exam_type"))


@query()
def filename_codes(spark, sf):
    """Subject code of each file name; the catalogue's codes (a fixed list) are one array column."""
    known = bounded(table(spark, sf, "subjects"), headers.CATALOGUE, "the catalogue").agg(F.collect_set("code").alias("known"))
    papers = table(spark, sf, "papers").select("id", "filename").crossJoin(F.broadcast(known))
    return papers.select("id", F.coalesce(X.find_code(X.stem(F.col("filename")), F.col("known")), F.lit("UNKNOWN")).alias("code"))


@query("""SELECT doc_id, list_extract(list_filter(list_transform(l, lambda x: CASE WHEN contains(lower(x), 'max. marks') THEN CAST(nullif(regexp_extract(lower(x), 'max\\. marks: ?([0-9]{1,6})', 1), '') AS INTEGER) END), lambda x: x IS NOT NULL), 1) AS max_marks,
    list_extract(list_filter(list_transform(l, lambda x: nullif(regexp_extract(x, '^ *([A-Z]{2,5}[0-9]{3}[A-Z]?)\\b', 1), '')), lambda x: x IS NOT NULL), 1) AS code
    FROM (SELECT doc_id, list_slice(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1, 15) AS l FROM documents WHERE text IS NOT NULL)""")
def header_first_match(spark, sf):
    """First hits over the first fifteen lines of each text, in line order."""
    lines = F.slice(F.split("text", r"\r\n|\r|\n"), 1, 15)
    marks = F.filter(F.transform(lines, lambda x: X.blank_to_null(F.regexp_extract(F.lower(x), r"max\. marks: ?([0-9]{1,6})", 1)).cast("int")), lambda x: x.isNotNull())
    codes = F.filter(F.transform(lines, lambda x: X.blank_to_null(F.regexp_extract(x, r"^ *([A-Z]{2,5}[0-9]{3}[A-Z]?)\b", 1))), lambda x: x.isNotNull())
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.get(marks, F.lit(0)).alias("max_marks"), F.get(codes, F.lit(0)).alias("code"))


# ---------------------------------------------------------------- cells and cleaning

_NUMBERS_SQL = "list_filter(list_transform(regexp_extract_all(text, '\\b([0-9]{1,2})\\b', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 4 AND 20)"


@query(f"""SELECT id, coalesce(list_extract(list_filter(n, lambda x: x % 2 = 0), 1), list_extract(n, 1)) AS marks,
    CASE WHEN b <> '' THEN concat('L', b) END AS bloom, CASE WHEN o <> '' THEN concat('CO', o) END AS outcome,
    nullif(lower(regexp_extract(trim(text), '^([a-cA-C])', 1)), '') AS label
    FROM (SELECT id, text, {_NUMBERS_SQL} AS n, regexp_extract(text, '(?i)L\\s*([1-6])', 1) AS b, regexp_extract(text, '(?i)C[oq]q?\\s*([0-9])', 1) AS o FROM sub_questions)""")
def cell_values(spark, sf):
    text = F.col("text")
    return table(spark, sf, "sub_questions").select("id", X.marks_in(text).alias("marks"), X.bloom_in(text).alias("bloom"), X.outcome_in(text).alias("outcome"), X.sub_label(text).alias("label"))


@query("SELECT id, CAST(CASE WHEN q_no >= 1 THEN least(5, ceil(q_no / 2.0)) END AS INTEGER) AS module FROM sub_questions")
def module_of_question(spark, sf):
    return table(spark, sf, "sub_questions").select("id", F.when(F.col("q_no") >= 1, X.module_of_question(F.col("q_no"))).alias("module"))


@query("""SELECT id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '^(?i:Q\\.?\\s*[0-9]{1,2}|[a-c]\\.)\\s*', ''), '(?i)\\b(?:L[1-6]|CO[0-9]+|col)\\b', '', 'g'), '|', ' '), '\\s+', ' ', 'g'),
    '^[ .,;:]+|[ .,;:]+$', '', 'g') AS clean FROM sub_questions""")
def clean_text(spark, sf):
    return table(spark, sf, "sub_questions").select("id", X.clean_question(F.col("text")).alias("clean"))


@query()
def embed_text(spark, sf):
    """Texts as they go to the encoder; too short ones are left out."""
    rows = table(spark, sf, "sub_questions").filter(F.length(F.trim("text")) >= 12)
    return rows.select("id", X.clean_for_embedding(F.col("text")).alias("clean")).filter(F.length("clean") >= 12)


@query()
def encoded(spark, sf):
    rows = table(spark, sf, "sub_questions").select("id", X.clean_for_embedding(F.col("text")).alias("clean"))
    return rows.select("id", V.encoder()(F.col("clean")).alias("vector"))


@query()
def phrase_labels(spark, sf):
    """Label of each topic from all its wordings, or from its representative text where it has none."""
    met = _met(spark, sf).filter("text <> ''").select(F.col("topic_id").alias("id"), F.col("sub_question_id").cast("long").alias("sub_question_id"), "text")
    topics = table(spark, sf, "topics").select("id", "representative_text")
    alone = topics.join(met.select("id").distinct(), "id", "left_anti").select("id", F.lit(0).cast("long").alias("sub_question_id"), F.col("representative_text").alias("text"))
    return labels.topic_labels(met.unionByName(alone.withColumn("text", F.coalesce("text", F.lit("")))), ["id"])


_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""WITH w AS (SELECT id, list_filter(list_transform(regexp_extract_all(label, '\\b[a-zA-Z]{{3,}}\\b'), lambda x: lower(x)), lambda x: NOT list_contains([{_STOP_SQL}], x)) AS ws FROM topics WHERE label IS NOT NULL),
    u AS (SELECT unnest(ws) AS term, 1 AS weight FROM w UNION ALL
          SELECT unnest(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS term, 2 AS weight FROM w)
    SELECT term, CAST(sum(weight) AS BIGINT) AS score FROM u GROUP BY term HAVING sum(weight) >= 3""")
def keyword_scores(spark, sf):
    """Words and neighbouring pairs of labels, a pair counting double."""
    words = F.filter(F.transform(F.regexp_extract_all("label", F.lit(r"(?<![A-Za-z0-9_])([a-zA-Z]{3,})(?![A-Za-z0-9_])"), F.lit(1)), lambda x: F.lower(x)), lambda x: ~x.isin(X.STOP_WORDS))
    rows = table(spark, sf, "topics").filter("label is not null").select(words.alias("ws"))
    pairs = F.filter(F.transform("ws", lambda x, i: F.concat_ws(" ", x, F.get(F.col("ws"), i + 1))), lambda x: F.contains(x, F.lit(" ")))
    terms = rows.select(F.explode(F.concat(F.transform("ws", lambda x: F.struct(x.alias("term"), F.lit(1).alias("weight"))), F.transform(pairs, lambda x: F.struct(x.alias("term"), F.lit(2).alias("weight"))))).alias("t")).select("t.*")
    return terms.groupBy("term").agg(F.sum("weight").alias("score")).filter("score >= 3")


@query("""SELECT id, regexp_replace(replace(replace(replace(replace(replace(replace(translate(label, '‘’“”–—•·★☆âé', '''''""--****ae'), '®', '(R)'), '©', '(C)'), '…', '...'), '°', 'deg'), '→', '->'), '←', '<-'), '[^\\x00-\\x{FF}]', '?', 'g') AS plain FROM topics""")
def latin_labels(spark, sf):
    return table(spark, sf, "topics").select("id", X.latin_only(F.col("label")).alias("plain"))


@query("SELECT id, right(trim(regexp_replace(regexp_extract(replace(filename, '\\', '/'), '([^/]*)$', 1), '[^\\p{L}\\p{N}_ .()\\-]+', '_', 'g')), 120) AS safe FROM papers")
def safe_filenames(spark, sf):
    return table(spark, sf, "papers").select("id", X.safe_filename(F.col("filename")).alias("safe"))


# ---------------------------------------------------------------- topics: scores, ranks, ladders


def _met(spark, sf):
    return scoring.appearances(table(spark, sf, "topic_appearances"), table(spark, sf, "sub_questions"), table(spark, sf, "papers"))


def _scores(spark, sf):
    return scoring.scores(_met(spark, sf), table(spark, sf, "topics"), table(spark, sf, "papers"), YEAR)


_SCORES_SQL = f"""
    m AS (SELECT DISTINCT a.topic_id, a.sub_question_id, s.paper_id, p.exam_year, s.marks FROM topic_appearances a
          JOIN sub_questions s ON s.id = a.sub_question_id JOIN papers p ON p.id = s.paper_id WHERE p.status = 'approved'),
    o AS (SELECT *, row_number() OVER (PARTITION BY topic_id, paper_id ORDER BY sub_question_id) AS n FROM m),
    g AS (SELECT topic_id, count(*) FILTER (WHERE n = 1) AS frequency, sum(pow(0.85, greatest(0, {YEAR} - coalesce(exam_year, {YEAR})))) FILTER (WHERE n = 1) AS score,
                 max(exam_year) AS last_year, coalesce(avg(marks) FILTER (WHERE marks <> 0), 0.0) AS avg_marks FROM o GROUP BY topic_id),
    c AS (SELECT upper(trim(subject_code)) AS subject, count(*) AS total FROM papers WHERE status = 'approved' GROUP BY 1),
    sc AS (SELECT g.topic_id, upper(trim(t.subject_code)) AS subject, t.module_no, t.label, t.representative_text, g.frequency, greatest(coalesce(c.total, 0), 1) AS total, g.last_year, g.avg_marks,
                  g.frequency / greatest(coalesce(c.total, 0), 1) AS share, floor((g.score + 1e-9) * 10000.0 + 0.5) / 10000.0 AS weighted_score,
                  floor(g.frequency / greatest(coalesce(c.total, 0), 1) * g.avg_marks * 100.0 + 0.5) / 100.0 AS expected
           FROM g JOIN topics t ON t.id = g.topic_id LEFT JOIN c ON c.subject = upper(trim(t.subject_code)))"""
_RANKS_SQL = (
    _SCORES_SQL
    + """,
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject, module_no ORDER BY CASE WHEN total = 1 THEN avg_marks END DESC NULLS LAST, weighted_score DESC, topic_id) AS INTEGER) AS rank_no FROM sc)"""
)


def _ladder_sql(stop: float, digits: int) -> str:
    return (
        _RANKS_SQL
        + f""",
    w AS (SELECT *, sum(expected) OVER (PARTITION BY subject, module_no ORDER BY rank_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
    l AS (SELECT subject, module_no, rank_no, topic_id, coalesce(nullif(trim(label), ''), substring(representative_text, 1, 50)) AS label, expected, floor(least(run, 20.0) * {10.0**digits} + 0.5) / {10.0**digits} AS cumulative, run >= 20.0 AS "full" FROM w WHERE run - expected < {stop})"""
    )


@query(f"WITH {_SCORES_SQL} SELECT topic_id, subject, module_no, frequency, total, last_year, avg_marks, share, weighted_score, expected FROM sc")
def topic_scores(spark, sf):
    return _scores(spark, sf).drop("label", "representative_text")


@query(f"WITH {_RANKS_SQL} SELECT subject, module_no, topic_id, weighted_score, rank_no FROM r")
def topic_rank(spark, sf):
    return scoring.ranked(_scores(spark, sf)).select("subject", "module_no", "topic_id", "weighted_score", "rank_no")


@query(f"WITH {_ladder_sql(30.0, 2)} SELECT * FROM l")
def marks_ladder(spark, sf):
    return scoring.ladder(scoring.ranked(_scores(spark, sf)), 30.0, 2)


@query(f"WITH {_ladder_sql(20.0, 1)} SELECT * FROM l")
def snapshot_ladder(spark, sf):
    return scoring.ladder(scoring.ranked(_scores(spark, sf)), 20.0, 1)


@query(f"WITH {_SCORES_SQL} SELECT topic_id, CASE WHEN total <= 1 THEN 'unranked' WHEN share >= 0.8 THEN 'always' WHEN share >= 0.5 THEN 'often' ELSE 'sometimes' END AS tier FROM sc")
def tiers(spark, sf):
    return _scores(spark, sf).select("topic_id", scoring.tier(F.col("share"), F.col("total")).alias("tier"))


def _ranked_once(spark, sf):
    """(appearances, ranked topics), each computed once."""
    met = materialize(_met(spark, sf).select("topic_id", "sub_question_id", "paper_id", "exam_year", "marks", "text"), "met")
    scores = scoring.scores(met, table(spark, sf, "topics"), table(spark, sf, "papers"), YEAR)
    return met, materialize(scoring.ranked(scores), "ranks")


@query(f"""WITH {_ladder_sql(30.0, 2)},
    y AS (SELECT topic_id, array_to_string(list_sort(list(DISTINCT exam_year), 'DESC'), ', ') AS years FROM m WHERE exam_year IS NOT NULL GROUP BY topic_id)
    SELECT r.subject, r.module_no AS module, r.rank_no AS priority, coalesce(r.label, '') AS label, r.representative_text AS question, CAST(trunc(r.avg_marks) AS INTEGER) AS avg_marks, r.frequency AS times, r.total AS papers,
           concat(CAST(round_even(r.share * 100, 0) AS INTEGER), '%') AS frequency_pct, coalesce(y.years, '—') AS years, round_even(r.expected * 10.0, 0) / 10.0 AS expected, CASE WHEN l."full" THEN 'YES' ELSE '' END AS full_coverage
    FROM r JOIN l ON l.topic_id = r.topic_id LEFT JOIN y ON y.topic_id = r.topic_id""")
def csv_bank(spark, sf):
    met, ranks = _ranked_once(spark, sf)
    years = met.filter("exam_year is not null").groupBy("topic_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("exam_year"), asc=False), lambda y: y.cast("string")), ", ").alias("years"))
    return scoring.csv_rows(ranks, scoring.ladder(ranks, 30.0, 2), years)


@query(f"""WITH {_ladder_sql(30.0, 2)},
    f AS (SELECT *, min(CASE WHEN "full" THEN rank_no END) OVER (PARTITION BY subject, module_no) AS full_at FROM l WHERE rank_no <= 3)
    SELECT f.subject, f.module_no, f.rank_no, f.topic_id, f.full_at, t.representative_text FROM f JOIN topics t ON t.id = f.topic_id WHERE f.rank_no <= least(coalesce(f.full_at, 3), 3)""")
def cheat_rows(spark, sf):
    ranks = materialize(scoring.ranked(_scores(spark, sf)), "ranks")
    return scoring.sheet_rows(ranks, scoring.ladder(ranks, 30.0, 2))


@query("""WITH m AS (SELECT DISTINCT a.topic_id, s.id, s.text, s.marks, p.exam_year FROM topic_appearances a JOIN sub_questions s ON s.id = a.sub_question_id JOIN papers p ON p.id = s.paper_id WHERE p.status = 'approved')
    SELECT topic_id, arg_max(id, (coalesce(exam_year, 0), length(text), -id)) AS best_id, coalesce(avg(marks) FILTER (WHERE marks <> 0), 0.0) AS avg_marks FROM m GROUP BY topic_id""")
def representatives(spark, sf):
    met = _met(spark, sf)
    order = F.struct(F.coalesce("exam_year", F.lit(0)), F.length("text"), -F.col("sub_question_id"))
    return met.groupBy("topic_id").agg(F.max_by("sub_question_id", order).alias("best_id"), F.coalesce(F.avg(F.when(F.col("marks") != 0, F.col("marks"))), F.lit(0.0)).alias("avg_marks"))


@query(f"""WITH {_RANKS_SQL}, s AS (SELECT upper(trim(subject_code)) AS subject, count(*) AS paper_count, min(exam_year) AS min_year, max(exam_year) AS max_year FROM papers WHERE status = 'approved' GROUP BY 1)
    SELECT s.subject, s.paper_count, s.min_year, s.max_year, count(*) AS topic_count FROM s JOIN r ON r.subject = s.subject WHERE r.module_no IS NOT NULL GROUP BY ALL""")
def snapshot_header(spark, sf):
    met, ranks = _ranked_once(spark, sf)
    out = snapshot.snapshots(met, ranks.filter("module_no is not null"), table(spark, sf, "papers"))
    return out.select("subject", "paper_count", "min_year", "max_year", "topic_count")


@query()
def snapshot_json(spark, sf):
    met, ranks = _ranked_once(spark, sf)
    return snapshot.snapshots(met, ranks.filter("module_no is not null"), table(spark, sf, "papers"))


@query("""SELECT upper(trim(subject_code)) AS subject, count(*) AS paper_count, min(exam_year) AS min_year, max(exam_year) AS max_year FROM papers p WHERE status = 'approved' AND subject_code IS NOT NULL
    GROUP BY 1 HAVING bool_or(EXISTS (SELECT 1 FROM sub_questions s WHERE s.paper_id = p.id AND s.module_no BETWEEN 1 AND 5 AND length(s.text) >= 60))""")
def rebuilt_header(spark, sf):
    """The whole rebuild, questions to published documents, by what SQL can state of a document: its subject and sessions."""
    return rebuilt_documents(spark, sf).select("subject", "paper_count", "min_year", "max_year")


@query()
def rebuilt_documents(spark, sf):
    """All subjects with live papers rebuilt: questions to clusters, scores, ranks, claimed keys, labels, ladders and documents."""
    documents, _ = rebuild.published(table(spark, sf, "sub_questions"), table(spark, sf, "papers"), previous_keys(spark, sf), YEAR)
    return documents


# ---------------------------------------------------------------- vectors and clusters


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("space"))


_DOT_SQL = "floor(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1000000.0 + 0.5) / 1000000.0"


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS best_id, {_DOT_SQL} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query_id, best_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, best_id) AS n FROM s) WHERE n = 1""")
def cosine_top1(spark, sf):
    """Searches: the rows whose id is divisible by 100, against all rows."""
    rows = _vectors(spark, sf)
    return match.nearest(rows.filter("id % 100 = 0"), rows)


_CENTRES_SQL = """e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS dim FROM embeddings),
    m AS (SELECT label, dim, avg(x) AS m, count(*) AS members FROM e GROUP BY label, dim),
    c AS (SELECT label, max(members) AS members, list(m ORDER BY dim) AS v FROM m GROUP BY label),
    u AS (SELECT label, members, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS centroid FROM c)"""


@query(f"WITH {_CENTRES_SQL} SELECT label, members, list_transform(centroid, lambda x: floor(x * 1000000.0 + 0.5) / 1000000.0) AS centroid FROM u")
def centroids(spark, sf):
    out = V.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", "members", F.transform("centroid", lambda x: scoring.half_up(x, 6)).alias("centroid"))


@query(f"""WITH {_CENTRES_SQL}, s AS (SELECT e.vec_id, u.label, floor(list_inner_product(CAST(e.embedding AS DOUBLE[]), u.centroid) * 1000000.0 + 0.5) / 1000000.0 AS sim FROM embeddings e, u)
    SELECT vec_id AS id, CASE WHEN sim >= 0.3 THEN label END AS cluster, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS n FROM s) WHERE n = 1""")
def refine_assign(spark, sf):
    return match.assign(_vectors(spark, sf), V.centroids(table(spark, sf, "embeddings"), "label", "embedding"), "label", 0.3)


@query()
def greedy_clusters(spark, sf):
    """Clusters in order of id within each label, at a threshold this data can reach."""
    return fold.ordered_fold(_vectors(spark, sf), ["space"], ["id"], ["id", "vector"], "id long, cluster int", fold.greedy_clusters(0.35))


_COMPARE_SQL = f"""b AS (SELECT a.label AS query_paper, a.vec_id AS query_id, b.label AS paper, max(floor(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) * 1000.0 + 0.5) / 1000.0) AS sim
    FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3),
    s AS (SELECT CAST(query_paper AS BIGINT) AS query_paper, CAST(paper AS BIGINT) AS paper, floor(avg(CASE WHEN sim >= 0.35 THEN 1.0 ELSE 0.0 END) * 1000.0 + 0.5) / 1000.0 AS score FROM b GROUP BY 1, 2)"""


def _comparison(spark, sf):
    rows = _vectors(spark, sf).select("id", F.col("space").alias("paper"), "vector")
    # a stated query set: the rows whose id is divisible by 100, against all rows
    return match.compare_papers(rows.filter("id % 100 = 0"), rows, 0.35)


@query(f"WITH {_COMPARE_SQL} SELECT query_paper, paper, score FROM s")
def compare_papers(spark, sf):
    return _comparison(spark, sf)


@query(f"WITH {_COMPARE_SQL} SELECT query_paper, paper, score FROM (SELECT *, row_number() OVER (PARTITION BY query_paper ORDER BY score DESC, paper) AS n FROM s) WHERE n = 1")
def best_match(spark, sf):
    return match.best_match(_comparison(spark, sf))


@query()
def question_clusters(spark, sf):
    """All live questions of all subjects as topics, with keys carried over from the former topics."""
    topics, members = rebuild.topics_of(table(spark, sf, "sub_questions"), table(spark, sf, "papers"), year=YEAR)
    return rebuild.carried(topics, members, previous_keys(spark, sf))


@query()
def header_metadata(spark, sf):
    """Metadata of every document from its first lines and, as a file would have it, its source."""
    docs = table(spark, sf, "documents").filter("text is not null")
    rows = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.slice(F.split("text", r"\r\n|\r|\n"), 1, headers.ROWS)).alias("row_no", "line")).select("paper_id", "row_no", F.array("line").alias("cells"))
    stem = X.stem(F.col("source"))
    names = docs.select(F.col("doc_id").alias("paper_id"), F.coalesce("source", F.lit("")).alias("filename"), F.lit("UNKNOWN").alias("code"), X.month_in(stem).alias("month"), X.year_of(stem).alias("year"), F.coalesce(X.exam_type(stem), F.lit("regular")).alias("exam_type"))
    return headers.merged(names, headers.header_metadata(rows, table(spark, sf, "subjects")))


@query("""WITH m AS (SELECT DISTINCT a.topic_id, s.id, s.q_no, s.sub_q, p.exam_year FROM topic_appearances a JOIN sub_questions s ON s.id = a.sub_question_id JOIN papers p ON p.id = s.paper_id WHERE p.status = 'approved')
    SELECT topic_id, string_agg(concat('Q', coalesce(CAST(q_no AS VARCHAR), '?'), coalesce(sub_q, '?'), '(', coalesce(CAST(exam_year AS VARCHAR), '?'), ')'), ' · ' ORDER BY coalesce(exam_year, 0) DESC, id) AS appearances FROM m GROUP BY topic_id""")
def appearance_text(spark, sf):
    unknown = F.lit("?")
    asked = table(spark, sf, "sub_questions").select(F.col("id").alias("sub_question_id"), "q_no", "sub_q")
    met = _met(spark, sf).select("topic_id", "sub_question_id", "exam_year").join(asked, "sub_question_id")
    shown = F.concat(F.lit("Q"), F.coalesce(F.col("q_no").cast("string"), unknown), F.coalesce("sub_q", unknown), F.lit("("), F.coalesce(F.col("exam_year").cast("string"), unknown), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.coalesce("exam_year", F.lit(0))).alias("y"), F.col("sub_question_id").alias("i"), shown.alias("s"))))
    return met.groupBy("topic_id").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), " · ").alias("appearances"))


@query("""WITH q AS (SELECT paper_id, count(*) AS n, count(DISTINCT module_no) AS m FROM sub_questions GROUP BY paper_id)
    SELECT p.id, CASE WHEN coalesce(q.n, 0) < 5 OR coalesce(q.m, 0) < 3 THEN 'rejected' ELSE 'awaiting_confirmation' END AS gate,
      concat_ws(' ', CASE WHEN s.code IS NULL THEN 'The subject is not in the catalogue.' END, CASE WHEN coalesce(q.n, 0) < 8 OR coalesce(q.m, 0) < 4 THEN 'Few questions or modules were found.' END,
        CASE WHEN p.session_key IS NOT NULL AND EXISTS (SELECT 1 FROM papers o WHERE o.session_key = p.session_key AND o.status = 'approved' AND o.id <> p.id) THEN 'The session has a paper already.' END) AS reasons
    FROM papers p LEFT JOIN q ON q.paper_id = p.id LEFT JOIN subjects s ON s.code = p.subject_code""")
def gate_and_reasons(spark, sf):
    """Gate and reasons as far as SQL states them, without the comparison of questions; ``paper_decisions`` has all reasons."""
    return _decided(spark, sf, None)


def _decided(spark, sf, best):
    papers = table(spark, sf, "papers")
    asked = table(spark, sf, "sub_questions").groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("module_no").alias("m"))
    live = papers.filter("status = 'approved' and session_key is not null").groupBy("session_key").agg(F.count("*").alias("live"))
    known = table(spark, sf, "subjects").select(F.col("code").alias("subject_code"), F.lit(True).alias("known"))
    rows = papers.select("id", "subject_code", "session_key", "status").join(asked, "id", "left").join(live, "session_key", "left").join(known, "subject_code", "left")
    rows = rows.join(best, "id", "left") if best is not None else rows.withColumn("score", F.lit(0.0))
    clash = F.coalesce(F.col("live") - F.when(F.col("status") == "approved", 1).otherwise(0), F.lit(0)) > 0
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return rows.select("id", lifecycle.gate(n, m).alias("gate"), match.decision(F.coalesce("known", F.lit(False)), n, m, clash, F.coalesce("score", F.lit(0.0))).alias("reasons"))


@query()
def paper_decisions(spark, sf):
    """Gate and all reasons of every paper, its questions compared with those of each other live paper of its subject."""
    papers = table(spark, sf, "papers").select(F.col("id").alias("paper"), F.col("subject_code").alias("subject"), "status").filter("subject is not null")
    asked = table(spark, sf, "sub_questions").select(F.col("paper_id").alias("paper"), V.encoder()(F.col("text")).alias("vector"))
    rows = materialize(asked.join(papers, "paper"), "asked")
    best = match.best_live(rows, rows.filter("status = 'approved'"))
    return _decided(spark, sf, best.select(F.col("query_paper").alias("id"), "score"))


@query(f"""SELECT id, concat_ws(',', CASE WHEN NOT coalesce(regexp_full_match(upper(trim(subject_code)), 'B[A-Z]{{1,5}}[0-9]{{3}}[A-Z]?'), false) THEN 'code' END, CASE WHEN NOT coalesce(paper_type IN ('see', 'model'), false) THEN 'type' END,
    CASE WHEN exam_year NOT BETWEEN 2015 AND 2026 THEN 'year range' END, CASE WHEN paper_type = 'see' AND (exam_year IS NULL OR exam_month IS NULL) THEN 'session' END,
    CASE WHEN NOT list_contains({_MONTHS_SQL}, exam_month) THEN 'month' END) AS violations FROM papers""")
def confirm_violations(spark, sf):
    found = lifecycle.violations(F.col("subject_code"), F.col("paper_type"), F.col("exam_year"), F.col("exam_month"), X.MONTHS, YEAR)
    return table(spark, sf, "papers").select("id", F.array_join(found, ",").alias("violations"))


@query("""SELECT n.topic_id, o.stable_key, count(*) AS votes FROM (SELECT DISTINCT * FROM topic_appearances) n JOIN (SELECT DISTINCT * FROM topic_appearances) x ON x.sub_question_id = n.sub_question_id AND x.topic_id <> n.topic_id
    JOIN topics o ON o.id = x.topic_id GROUP BY 1, 2""")
def carry_votes(spark, sf):
    return _votes(spark, sf).groupBy("topic_id", "stable_key").agg(F.count("*").alias("votes"))


def _votes(spark, sf):
    links = table(spark, sf, "topic_appearances").distinct()
    keys = table(spark, sf, "topics").select(F.col("id").alias("old_id"), "stable_key", "label")
    old = links.select(F.col("topic_id").alias("old_id"), "sub_question_id").join(keys, "old_id")
    return links.join(old, "sub_question_id").filter("topic_id <> old_id")


@query()
def carry_claims(spark, sf):
    """Old keys and their labels claimed by topics in order of module and rank, each key once per subject; topics without a rank come last."""
    votes = _votes(spark, sf).groupBy("topic_id", "stable_key", "label").agg(F.count("*").alias("n"), F.min("sub_question_id").alias("first"))
    ranks = scoring.ranked(_scores(spark, sf)).select("topic_id", "rank_no")
    topics = table(spark, sf, "topics").select(F.col("id").alias("topic_id"), F.upper(F.trim("subject_code")).alias("subject"), "module_no", F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12).alias("own"))
    rows = topics.join(ranks, "topic_id", "left").join(fold.ballots(votes, ["topic_id"]), "topic_id", "left").withColumn("unranked", F.col("rank_no").isNull())
    return fold.ordered_fold(rows, ["subject"], ["module_no", "unranked", "rank_no", "topic_id"], ["topic_id", "votes", "own"], "topic_id int, key string, label string", fold.claim_keys())


# ---------------------------------------------------------------- page layout and parsing


def _page_words(spark, sf):
    """Words of the questions laid out on pages of 1000 units: place follows from the word's number."""
    words = table(spark, sf, "sub_questions").select(F.col("id").alias("page_id"), F.posexplode(F.split("text", r"\s+")).alias("word_no", "text"))
    n = F.col("word_no")
    return words.select("page_id", "word_no", "text", ((n * 173) % 980).alias("left"), (F.floor(n / 6) * 21 + (n * 7) % 11).cast("int").alias("top"), F.length("text").alias("width"), F.lit(10).alias("height"), F.lit("90").alias("conf"))


@query()
def word_bands(spark, sf):
    return layout.bands(layout.centred(_page_words(spark, sf))).select("page_id", "word_no", "anchor")


@query()
def row_cells(spark, sf):
    return layout.cells(layout.centred(_page_words(spark, sf)), 1_000)


@query("""SELECT id, CAST(CASE WHEN x < 130 THEN 0 WHEN x < 170 THEN 1 WHEN x < 740 THEN 2 WHEN x < 830 THEN 3 WHEN x < 890 THEN 4 ELSE 5 END AS INTEGER) AS cell FROM (SELECT id, (id * 173) % 1100 AS x FROM sub_questions)""")
def word_buckets(spark, sf):
    return table(spark, sf, "sub_questions").select("id", layout.bucket((F.col("id") * 173) % 1100, F.lit(1_000)).alias("cell"))


@query()
def parsed_rows(spark, sf):
    """Documents' lines as table rows of one cell each beside number and label, parsed as papers are."""
    docs = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("row_no", "line"))
    cells = F.array(F.regexp_extract("line", r"^\s*([QO]\.?\s?\d{1,2})", 1), F.regexp_extract("line", r"^\s*[QO]\.?\s?\d{1,2}\s+([a-d])\)", 1), F.regexp_replace("line", r"^\s*[QO]\.?\s?\d{1,2}\s+[a-d]\)\s*|\s*\[[^\]]*\]\s*$", ""), F.regexp_extract("line", r"\[([^\]]*)\]\s*$", 1))
    return parse.parse_papers(docs.select("paper_id", "row_no", cells.alias("cells")))


# ---------------------------------------------------------------- limits and streams


def _hits(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")).withColumn("at", F.col("micros") / 1e6)


_WITHIN_SQL = "list_filter(r.times, lambda t: e.secs - t <= 21600.0)"
_LIMIT_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, [secs] AS times, true AS accepted FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN len({_WITHIN_SQL}) < 2 THEN list_append({_WITHIN_SQL}, e.secs) ELSE {_WITHIN_SQL} END, len({_WITHIN_SQL}) < 2
          FROM r JOIN e ON e.n = r.n + 1 AND e.user_id IS NOT DISTINCT FROM r.user_id)
    SELECT user_id, event_id, accepted FROM r"""


@query(_LIMIT_SQL)
def rate_limit(spark, sf):
    return fold.ordered_fold(_hits(spark, sf), ["user_id"], ["at", "event_id"], ["event_id", "at"], "event_id long, accepted boolean", fold.sliding_limit(2, 6 * 3600.0))


@query(_LIMIT_SQL)
def stream_limit(spark, sf):
    """The same limits kept by a stream over the events, drained."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    hits = stream.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = work_path(spark, "limited")
    try:
        ingest.run_to_table(ingest.limited(hits, 2, 6 * 3600.0), out, work_path(spark, "limits"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("user_id long, event_id long, accepted boolean").parquet(out)


@query("SELECT content_hash, count(*) AS n FROM (SELECT DISTINCT content_hash FROM papers WHERE content_hash IS NOT NULL) GROUP BY content_hash")
def stream_dedup(spark, sf):
    """Uploads by content, each once, through a stream over the papers."""
    schema = table(spark, sf, "papers").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/papers.parquet*").filter("content_hash is not null").select("content_hash", F.col("created_at").alias("ts"))
    out = work_path(spark, "uploads")
    ingest.run_to_table(ingest.first_uploads(stream, "400 days"), out, work_path(spark, "seen"))
    return spark.read.schema("content_hash string, ts timestamp").parquet(out).groupBy("content_hash").agg(F.count("*").alias("n"))


@query("SELECT upper(trim(subject_code)) AS code, 1 AS times FROM papers WHERE status = 'approved' AND subject_code IS NOT NULL GROUP BY 1")
def publish_stream(spark, sf):
    """Publish jobs of live papers through a stream: a subject is published once, however many jobs name it."""
    schema = table(spark, sf, "papers").schema
    jobs = spark.readStream.schema(schema).parquet(f"{sf}/papers.parquet*").filter("status = 'approved' and subject_code is not null").select(F.upper(F.trim("subject_code")).alias("code"))
    out = work_path(spark, "published")
    ingest.publishes(jobs, lambda codes: codes.write.mode("append").parquet(out), work_path(spark, "publishing")).awaitTermination()
    return spark.read.schema("code string").parquet(out).groupBy("code").agg(F.count("*").cast("int").alias("times"))


@query("""WITH o AS (SELECT id, CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'reprocess' END AS action FROM papers),
    a AS (SELECT p.id, p.status, p.session_key, o.action, coalesce((o.action = 'approve' AND p.status IN ('review', 'awaiting_confirmation')) OR (o.action = 'reject' AND p.status IN ('review', 'awaiting_confirmation', 'processing', 'failed'))
            OR (o.action = 'reprocess' AND p.status IN ('review', 'rejected', 'failed')), false) AS ok FROM papers p JOIN o ON o.id = p.id),
    r AS (SELECT *, CASE WHEN action IS NULL THEN NULL WHEN NOT ok THEN 'state'
            WHEN action = 'approve' AND session_key IS NOT NULL AND (EXISTS (SELECT 1 FROM a b WHERE b.session_key = a.session_key AND b.status = 'approved')
              OR a.id > (SELECT min(b.id) FROM a b WHERE b.session_key = a.session_key AND b.ok AND b.action = 'approve')) THEN 'session' END AS refused FROM a)
    SELECT id, CASE WHEN action IS NOT NULL AND refused IS NULL THEN CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'processing' END ELSE status END AS status,
      CASE WHEN action = 'reject' AND refused IS NULL THEN NULL ELSE session_key END AS session_key, refused FROM r""")
def review_actions(spark, sf):
    """Approve, reject and reprocess with their guards, one order for three papers of four."""
    papers = table(spark, sf, "papers")
    turn = F.col("id") % 4
    orders = papers.select("id", F.when(turn == 0, "approve").when(turn == 1, "reject").when(turn == 2, "reprocess").alias("action")).filter("action is not null")
    return lifecycle.reviewed(papers, orders)


@query("SELECT id, substring(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), 1, 2000) AS text FROM sub_questions")
def normal_texts(spark, sf):
    """Question texts as they are stored: white space collapsed, at most 2,000 characters."""
    return table(spark, sf, "sub_questions").select("id", F.substring(F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")), 1, 2_000).alias("text"))


# ---------------------------------------------------------------- browsing


@query("SELECT code, name FROM subjects WHERE contains(lower(code || ' ' || name), 'systems') AND contains(lower(code || ' ' || name), 'b')")
def search(spark, sf):
    return table(spark, sf, "subjects").filter(browse.matches("systems B", F.col("code"), F.col("name"))).select("code", "name")


@query(f"SELECT {_BRANCH_SQL} AS branch, count(*) AS n FROM (SELECT *, {_LETTERS_SQL} AS letters FROM subjects) GROUP BY 1")
def branch_facet(spark, sf):
    return table(spark, sf, "subjects").groupBy(C.branch_of(F.col("code")).alias("branch")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "branch")


@query("""WITH s(status) AS (VALUES ('processing'), ('awaiting_confirmation'), ('review'), ('approved'), ('rejected'), ('failed'), ('withdrawn')) SELECT s.status, count(p.id) AS n FROM s LEFT JOIN papers p ON p.status = s.status GROUP BY s.status
    UNION ALL SELECT 'all', count(*) FROM papers""")
def zero_filled_facet(spark, sf):
    return browse.facet(table(spark, sf, "papers"), "status", ["processing", "awaiting_confirmation", "review", "approved", "rejected", "failed", "withdrawn"])


@query("SELECT s.code, s.name FROM subjects s WHERE contains(lower(s.code || ' ' || s.name), 'the') AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.status = 'approved' AND p.subject_code = s.code) ORDER BY s.code LIMIT 6")
def catalogue_missing(spark, sf):
    bank = table(spark, sf, "papers").filter("status = 'approved'").select(F.col("subject_code").alias("code")).distinct()
    return browse.missing(table(spark, sf, "subjects"), bank, "the").select("code", "name")


@query("""WITH n AS (SELECT subject_code, count(*) AS papers, max(updated_at) AS changed FROM papers WHERE status = 'approved' GROUP BY 1)
    SELECT s.code, coalesce(n.papers, 0) AS papers, n.changed, coalesce(n.papers, 0) >= 2 AS ready FROM subjects s LEFT JOIN n ON n.subject_code = s.code""")
def subject_cards(spark, sf):
    counts = table(spark, sf, "papers").filter("status = 'approved'").groupBy(F.col("subject_code").alias("code")).agg(F.count("*").alias("papers"), F.max("updated_at").alias("changed"))
    cards = table(spark, sf, "subjects").select("code").join(counts, "code", "left").withColumn("papers", F.coalesce("papers", F.lit(0).cast("long")))
    return cards.withColumn("ready", F.col("papers") >= 2).orderBy(F.desc("papers"), "code")


_STUDIED_SQL = "st AS (SELECT DISTINCT value_id AS topic_id FROM (SELECT user_id % 1000 AS value_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'view')"


def _studied(spark, sf):
    last = lifecycle.latest(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return last.filter("event_type <> 'view'").select((F.col("user_id") % 1000).alias("topic_id")).distinct()


@query(f"WITH {_SCORES_SQL}, {_STUDIED_SQL} SELECT subject, module_no, CAST(floor(least(sum(expected), 20.0) + 0.5) AS BIGINT) AS covered FROM sc WHERE topic_id IN (SELECT topic_id FROM st) GROUP BY subject, module_no")
def coverage(spark, sf):
    return browse.coverage(_scores(spark, sf), _studied(spark, sf), 20.0)


@query(f"""WITH {_SCORES_SQL}, {_STUDIED_SQL}, cv AS (SELECT subject, module_no, floor(least(sum(expected), 20.0) + 0.5) AS covered FROM sc WHERE topic_id IN (SELECT topic_id FROM st) GROUP BY subject, module_no),
    md AS (SELECT subject, count(DISTINCT module_no) AS modules FROM sc GROUP BY subject)
    SELECT m.subject, CAST(coalesce(sum(cv.covered), 0) AS BIGINT) AS covered, CAST(m.modules * 20 AS BIGINT) AS most FROM md m LEFT JOIN cv ON cv.subject = m.subject GROUP BY m.subject, m.modules""")
def subject_coverage(spark, sf):
    scored = materialize(_scores(spark, sf).select("subject", "module_no", "topic_id", "expected"), "scores")
    covered = browse.coverage(scored, _studied(spark, sf), 20.0).groupBy("subject").agg(F.sum("covered").alias("covered"))
    modules = scored.groupBy("subject").agg((F.countDistinct("module_no") * 20).alias("most"))
    return modules.join(covered, modules["subject"].eqNullSafe(covered["subject"]) & modules["subject"].isNotNull(), "left").select(modules["subject"], F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), "most")


@query("""WITH m AS (SELECT DISTINCT a.topic_id, s.paper_id FROM topic_appearances a JOIN sub_questions s ON s.id = a.sub_question_id JOIN papers p ON p.id = s.paper_id WHERE p.status = 'approved')
    SELECT t.id AS topic_id, p.id AS paper_id, m.topic_id IS NOT NULL AS present FROM (SELECT id, upper(trim(subject_code)) AS subject FROM topics WHERE id IN (SELECT topic_id FROM m)) t
    JOIN papers p ON upper(trim(p.subject_code)) = t.subject AND p.status = 'approved' LEFT JOIN m ON m.topic_id = t.id AND m.paper_id = p.id""")
def presence_matrix(spark, sf):
    met = _met(spark, sf).select("topic_id", "paper_id")
    topics = table(spark, sf, "topics").select(F.col("id").alias("topic_id"), F.upper(F.trim("subject_code")).alias("subject")).join(met.select("topic_id").distinct(), "topic_id", "left_semi")
    live = table(spark, sf, "papers").filter("status = 'approved'").select(F.col("id").alias("paper_id"), F.upper(F.trim("subject_code")).alias("subject"))
    return browse.presence(topics, live, met)


@query("""SELECT a.topic_id, a.sub_question_id, CASE WHEN p.id IS NULL THEN 'Paper' WHEN p.paper_type = 'model' THEN 'Model' ELSE coalesce(CAST(p.exam_year AS VARCHAR), 'Undated') END AS session
    FROM (SELECT DISTINCT * FROM topic_appearances) a JOIN sub_questions s ON s.id = a.sub_question_id LEFT JOIN papers p ON p.id = s.paper_id AND p.status = 'approved'""")
def lookup_default(spark, sf):
    label = F.when(F.col("paper_type") == "model", "Model").otherwise(F.coalesce(F.col("exam_year").cast("string"), F.lit("Undated")))
    live = table(spark, sf, "papers").filter("status = 'approved'").select(F.col("id").alias("paper_id"), label.alias("session"))
    asked = table(spark, sf, "sub_questions").select(F.col("id").alias("sub_question_id"), "paper_id")
    return table(spark, sf, "topic_appearances").distinct().join(asked, "sub_question_id").join(live, "paper_id", "left").select("topic_id", "sub_question_id", F.coalesce("session", F.lit("Paper")).alias("session"))


@query("""SELECT subject_code, arg_min(id, (exam_year, id)) AS first_id, arg_max(id, (exam_year, -id)) AS last_id FROM papers WHERE status = 'approved' AND exam_year IS NOT NULL GROUP BY subject_code""")
def session_span(spark, sf):
    dated = table(spark, sf, "papers").filter("status = 'approved' and exam_year is not null")
    return dated.groupBy("subject_code").agg(F.min_by("id", F.struct("exam_year", "id")).alias("first_id"), F.max_by("id", F.struct(F.col("exam_year"), -F.col("id"))).alias("last_id"))


_FAMILY_SQL = f"""fam AS (SELECT id AS topic_id, upper(trim(subject_code)) AS subject, module_no,
    list_extract(list_filter(regexp_split_to_array(lower(regexp_replace(label, '^(?i:{'|'.join(X.VERBS)})\\s+', '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2 AND NOT list_contains([{_STOP_SQL}], w)), 1) AS family
    FROM topics WHERE subject_code IS NOT NULL)"""


@query(f"""WITH {_FAMILY_SQL}, nb AS (SELECT topic_id AS a, lead(topic_id) OVER w AS b, family AS f, lead(family) OVER w AS g FROM fam WINDOW w AS (PARTITION BY subject, module_no ORDER BY topic_id))
    SELECT a, b, CAST(CASE WHEN f = g THEN 0.6 ELSE 0.15 END AS DOUBLE) AS weight FROM nb WHERE b IS NOT NULL""")
def graph_edges(spark, sf):
    """Neighbours within a module, weighted by whether they are kin; ``graph_kin`` has all kin."""
    return browse.edges(_graph_topics(spark, sf))


@query(f"""WITH {_FAMILY_SQL} SELECT subject, topic_id, family, min(topic_id) OVER f AS first, count(*) OVER f - 1 AS kin FROM fam WHERE family IS NOT NULL WINDOW f AS (PARTITION BY subject, family)""")
def graph_kin(spark, sf):
    """Every topic's label family: all topics of a subject with the same ``first`` are kin (0.6), as one row per topic instead of all pairs."""
    return browse.family_members(_graph_topics(spark, sf))


def _graph_topics(spark, sf):
    return table(spark, sf, "topics").select(F.col("id").alias("topic_id"), F.upper(F.trim("subject_code")).alias("subject"), "module_no", "label").filter("subject is not null")


@query(f"WITH {_SCORES_SQL}, {_STUDIED_SQL} SELECT subject, module_no, count(*) AS topics, count(*) FILTER (WHERE topic_id IN (SELECT topic_id FROM st)) AS studied FROM sc GROUP BY subject, module_no")
def studied_counts(spark, sf):
    """Topics of each module, and how many of them were studied."""
    seen = _scores(spark, sf).select("subject", "module_no", "topic_id").join(_studied(spark, sf).withColumn("seen", F.lit(True)), "topic_id", "left")
    return seen.groupBy("subject", "module_no").agg(F.count("*").alias("topics"), F.count("seen").alias("studied"))


@query(f"SELECT DISTINCT CAST(nullif(regexp_extract(code, '^B([A-Z]+?)L?([0-9])([0-9]{{2}})[A-Z]?$', 2), '') AS INTEGER) AS semester FROM subjects WHERE regexp_extract(code, '^B([A-Z]+?)L?([0-9])([0-9]{{2}})[A-Z]?$', 2) <> '' ORDER BY 1")
def semesters(spark, sf):
    return table(spark, sf, "subjects").select(C.semester_of(F.col("code")).alias("semester")).filter("semester is not null").distinct().orderBy("semester")


@query("""SELECT upper(trim(subject_code)) AS subject, CASE WHEN min(exam_year) IS NULL THEN '' WHEN min(exam_year) = max(exam_year) THEN CAST(min(exam_year) AS VARCHAR) ELSE concat(min(exam_year), '–', max(exam_year)) END AS years,
    concat(count(*), CASE WHEN count(*) = 1 THEN ' paper' ELSE ' papers' END) AS papers FROM papers WHERE status = 'approved' GROUP BY 1""")
def subject_lines(spark, sf):
    """Years and number of papers of each subject as readers see them."""
    live = table(spark, sf, "papers").filter("status = 'approved'").groupBy(F.upper(F.trim("subject_code")).alias("subject")).agg(F.min("exam_year").alias("low"), F.max("exam_year").alias("high"), F.count("*").alias("n"))
    return live.select("subject", browse.year_range(F.col("low"), F.col("high")).alias("years"), browse.counted(F.col("n"), "paper").alias("papers"))


@query("""SELECT id, CASE WHEN n > 10 THEN 'too many files' WHEN NOT coalesce(ends_with(lower(filename), '.pdf'), false) THEN 'not a pdf' WHEN page_count * 2000000 > 10485760 THEN 'too large' END AS refused
    FROM (SELECT *, row_number() OVER (PARTITION BY uploader_hash, CAST(created_at AS DATE) ORDER BY created_at, id) AS n FROM papers)""")
def upload_precheck(spark, sf):
    """What is refused before it is sent: more than ten files of an uploader and day, other files, large ones (2 MB a page)."""
    number = F.row_number().over(Window.partitionBy("uploader_hash", F.to_date("created_at")).orderBy("created_at", "id"))
    return table(spark, sf, "papers").select("id", browse.upload_refusal(F.col("filename"), F.col("page_count") * 2_000_000, number).alias("refused"))


@query("""WITH n AS (SELECT subject_code AS code, count(*) AS papers, max(updated_at) AS changed FROM papers WHERE status = 'approved' GROUP BY 1)
    SELECT s.code, CAST(row_number() OVER (ORDER BY n.changed DESC NULLS LAST, s.code) AS BIGINT) AS place FROM subjects s LEFT JOIN n ON n.code = s.code""")
def cards_by_change(spark, sf):
    """Subject cards, the last changed first, with their place."""
    counts = table(spark, sf, "papers").filter("status = 'approved'").groupBy(F.col("subject_code").alias("code")).agg(F.count("*").alias("papers"), F.max("updated_at").alias("changed"))
    cards = browse.ordered_cards(table(spark, sf, "subjects").select("code").join(counts, "code", "left"), "changed")
    # the catalogue is a fixed list
    return cards.select("code", F.row_number().over(Window.orderBy(F.desc_nulls_last("changed"), "code")).cast("long").alias("place"))


@query(f"WITH {_SCORES_SQL} SELECT topic_id, 7 + 20 * share AS radius, total > 1 AND expected >= 0.5 AS worth, CAST(floor(expected + 0.5) AS BIGINT) AS marks FROM sc")
def topic_nodes(spark, sf):
    return _scores(spark, sf).select("topic_id", (F.lit(7) + F.lit(20) * F.col("share")).alias("radius"), ((F.col("total") > 1) & (F.col("expected") >= 0.5)).alias("worth"), F.floor(F.col("expected") + 0.5).alias("marks"))


@query("""SELECT id, coalesce(nullif(status_reason, ''), CASE status WHEN 'approved' THEN 'Published' WHEN 'rejected' THEN 'Rejected' WHEN 'failed' THEN 'Failed' WHEN 'review' THEN 'In review' ELSE 'Working' END) AS said,
    status IN ('approved', 'rejected', 'failed', 'review') AS settled,
    CAST(CASE WHEN status = 'approved' THEN 4 WHEN stage = 'queued' THEN 0 WHEN stage = 'reading' THEN 1 WHEN stage = 'confirm' THEN 2 ELSE 3 END AS INTEGER) AS step,
    strftime(created_at + INTERVAL 330 MINUTE, '%d %b %Y') AS shown FROM papers""")
def upload_status(spark, sf):
    status = F.col("status")
    said = F.when(status == "approved", "Published").when(status == "rejected", "Rejected").when(status == "failed", "Failed").when(status == "review", "In review").otherwise("Working")
    step = F.when(status == "approved", 4).when(F.col("stage") == "queued", 0).when(F.col("stage") == "reading", 1).when(F.col("stage") == "confirm", 2).otherwise(3)
    local = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), "Asia/Kolkata")
    return table(spark, sf, "papers").select("id", F.coalesce(X.blank_to_null(F.col("status_reason")), said).alias("said"), status.isin("approved", "rejected", "failed", "review").alias("settled"), step.alias("step"), F.date_format(local, "dd MMM yyyy").alias("shown"))


@query("""SELECT id, CASE status WHEN 'approved' THEN 'This paper is already published.' WHEN 'rejected' THEN 'This file was reviewed and rejected.' ELSE 'This file is already being processed.' END AS message,
    CASE WHEN pdf_type IS NULL THEN 'encrypted' WHEN page_count < 1 THEN 'empty' WHEN page_count > 6 THEN 'too many pages' WHEN question_count * 60 > 2000 THEN 'page too large' END AS guard, sha256(upload_token_hash) AS token FROM papers""")
def upload_answers(spark, sf):
    return table(spark, sf, "papers").select("id", lifecycle.duplicate_message(F.col("status")).alias("message"), lifecycle.page_guard(F.col("pdf_type").isNull(), F.col("page_count"), F.col("question_count") * 60).alias("guard"), F.sha2("upload_token_hash", 256).alias("token"))
