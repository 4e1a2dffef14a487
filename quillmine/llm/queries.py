"""Queries of the training-data operators, and their SQL where SQL can state them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOP_N = 5
LEAST_LETTERS = 12


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Near pairs within each space of t (space, id, text): candidates share one of their rarest words, then all words are counted.
_NEAR_SQL = """
    l AS (SELECT space, id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS ws FROM t WHERE text IS NOT NULL),
    n AS (SELECT * FROM l WHERE len(ws) >= 8),
    w AS (SELECT space, id, len(ws) AS n, unnest(ws) AS w FROM n),
    f AS (SELECT space, w, count(*) AS f FROM w GROUP BY space, w),
    r AS (SELECT w.space, w.id, w.w, w.n, row_number() OVER (PARTITION BY w.space, w.id ORDER BY f.f, w.w) AS k FROM w JOIN f ON f.space = w.space AND f.w = w.w),
    x AS (SELECT * FROM r WHERE k <= n - CAST(ceil(n * 7 / 10.0) AS BIGINT) + 1),
    c AS (SELECT DISTINCT a.space, a.id AS id_a, b.id AS id_b FROM x a JOIN x b ON a.space = b.space AND a.w = b.w AND a.id < b.id),
    s AS (SELECT c.space, c.id_a, c.id_b, len(list_intersect(a.ws, b.ws)) AS shared, len(a.ws) + len(b.ws) AS sizes
          FROM c JOIN n a ON a.space = c.space AND a.id = c.id_a JOIN n b ON b.space = c.space AND b.id = c.id_b),
    near AS (SELECT space, id_a, id_b FROM s WHERE shared * 10 >= (sizes - shared) * 7)"""


# ---------------------------------------------------------------- problem 1


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.history import hash_digits, month_of

    return table(spark, sf, "papers").select("id", hash_digits(F.col("content_hash")).alias("digits"), month_of(F.col("created_at")).alias("batch"), (F.col("status") == "approved").alias("accepted"))


@query(f"""
    WITH p AS (SELECT id, year(created_at) * 12 + month(created_at) AS batch, coalesce(status = 'approved', false) AS accepted,
                      nullif(regexp_extract(lower(content_hash), '([0-9a-f]{{64}})[^0-9a-z]*$', 1), '') AS digits FROM papers),
    t AS (SELECT 0 AS space, id, text FROM sub_questions), {_NEAR_SQL},
    d AS (SELECT s.id, p.batch, p.accepted FROM sub_questions s JOIN p ON p.id = s.paper_id),
    links AS (SELECT id_a AS later, id_b AS earlier FROM near UNION ALL SELECT id_b, id_a FROM near)
    SELECT 'paper' AS kind, id FROM p WHERE digits IS NOT NULL AND EXISTS (SELECT 1 FROM p q WHERE q.accepted AND q.digits = p.digits AND q.batch < p.batch)
    UNION ALL
    SELECT DISTINCT 'sub_question', a.id FROM links JOIN d a ON a.id = links.later JOIN d b ON b.id = links.earlier WHERE b.accepted AND b.batch < a.batch""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.history import seen_hashes, seen_texts

    papers = _papers(spark, sf)
    rows = table(spark, sf, "sub_questions").select("id", "paper_id", "text")
    texts = seen_texts(rows, papers.select(F.col("id").alias("paper_id"), "batch", "accepted"))
    return seen_hashes(papers).select(F.lit("paper").alias("kind"), "id").unionByName(texts.select(F.lit("sub_question").alias("kind"), "id"))


@query("""
    WITH p AS (SELECT id, year(created_at) * 12 + month(created_at) AS batch, status = 'approved' AS accepted,
                      nullif(regexp_extract(lower(content_hash), '([0-9a-f]{64})[^0-9a-z]*$', 1), '') AS digits FROM papers)
    SELECT id FROM p WHERE digits IS NOT NULL AND EXISTS (SELECT 1 FROM p q WHERE q.accepted AND q.digits = p.digits AND q.batch < p.batch)""")
def p1_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose file an accepted paper of an earlier month holds."""
    from quillmine.llm.history import seen_hashes

    return seen_hashes(_papers(spark, sf))


@query("""
    SELECT s.id, CAST(strlen(s.text) AS BIGINT) AS bytes FROM sub_questions s JOIN papers p ON p.id = s.paper_id WHERE p.created_at IS NOT NULL AND s.text <> ''""")
def p1_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes in the chunks of each question: the chunks of a text cover it, once."""
    return p1_coverage(spark, sf).select("id", "bytes")


@query()
def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each question, and those in byte chunks that accepted papers of earlier months hold."""
    from quillmine.llm.history import chunk_table, coverage

    questions = table(spark, sf, "sub_questions")
    papers = _papers(spark, sf).select(F.col("id").alias("paper_id"), "batch", "accepted")
    batches = questions.select("id", "paper_id").join(papers, "paper_id").select("id", "batch", "accepted")
    return coverage(chunk_table(questions.select("id", "text")), batches)


# ---------------------------------------------------------------- problem 2


@query("""
    SELECT subject_code, module_no, CAST(rank_no AS INTEGER) AS rank_no, id FROM (
      SELECT upper(trim(subject_code)) AS subject_code, module_no, id,
             row_number() OVER (PARTITION BY upper(trim(subject_code)), module_no
                                ORDER BY weighted_score DESC, last_seen_year DESC NULLS LAST, id) AS rank_no
      FROM topics WHERE subject_code IS NOT NULL AND module_no IS NOT NULL AND weighted_score IS NOT NULL AND NOT isnan(weighted_score))
    WHERE rank_no <= 5""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.topn import top_n

    top = top_n(
        table(spark, sf, "topics"),
        {"subject_code": F.upper(F.trim("subject_code")), "module_no": F.col("module_no")},
        F.col("weighted_score"),
        [("last_seen_year", F.col("last_seen_year"), False), ("id", F.col("id"), True)],
        TOP_N,
    )
    return top.select("subject_code", "module_no", "rank_no", "id")


@query("""
    SELECT event_type, event_id, CAST(rank_no AS INTEGER) AS rank_no FROM (
      SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank_no
      FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)) WHERE rank_no <= 5""")
def p2_events(spark: SparkSession, sf: str) -> DataFrame:
    """Few groups of many row groups each: the greatest values of every type of event."""
    return _event_top(spark, sf)[0].select("event_type", "event_id", "rank_no")


@query()
def p2_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups of the clustered events that ``p2_events`` reads, and those it skips by their footers."""
    _, kept = _event_top(spark, sf)
    return spark.createDataFrame([(kept.read, kept.skipped)], "row_groups_read int, row_groups_skipped int")


def _event_top(spark: SparkSession, sf: str):
    from quillmine.llm.topn import Clustered
    from quillmine.session import work_path

    kept = Clustered.open(spark, work_path(spark, "events"))
    kept.append(table(spark, sf, "events"), {"event_type": F.col("event_type")}, F.col("value"), [("event_id", F.col("event_id"), True)])
    top = kept.top(TOP_N)
    kept.drop()
    return top, kept


# ---------------------------------------------------------------- problem 3


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def _topic_fields(by_row: bool):
    from quillmine.llm.survivor import Field

    text, label, year = F.col("representative_text"), F.col("label"), F.col("last_seen_year").cast("long")
    norm = (lambda c: F.col("id")) if by_row else (lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    usable_label = (_letters(label) >= LEAST_LETTERS) & ~F.coalesce(text.startswith(label), F.lit(False))
    weight = F.lit(1.0) if by_row else F.coalesce(F.col("frequency"), F.lit(0)) + F.lit(1.0)
    return [
        Field("text", text, _letters(text) >= LEAST_LETTERS, norm(text), weight, (year, F.length(text))),
        Field("label", label, usable_label, norm(label), weight, (year, F.col("frequency"))),
    ]


@query("""
    WITH t AS (SELECT *, length(regexp_replace(representative_text, '[^A-Za-z]', '', 'g')) >= 12 AS text_ok,
                      length(regexp_replace(label, '[^A-Za-z]', '', 'g')) >= 12 AND NOT coalesce(starts_with(representative_text, label), false) AS label_ok
               FROM topics),
    k AS (SELECT stable_key FROM t GROUP BY stable_key HAVING count(*) >= 2),
    a AS (SELECT stable_key, id, row_number() OVER (PARTITION BY stable_key ORDER BY last_seen_year DESC NULLS LAST, length(representative_text) DESC, id) AS n FROM t WHERE text_ok),
    b AS (SELECT stable_key, id, row_number() OVER (PARTITION BY stable_key ORDER BY last_seen_year DESC NULLS LAST, frequency DESC, id) AS n FROM t WHERE label_ok)
    SELECT k.stable_key, CAST(coalesce(a.id, -1) AS INTEGER) AS text_id, CAST(coalesce(b.id, -1) AS INTEGER) AS label_id
    FROM k LEFT JOIN a ON a.stable_key = k.stable_key AND a.n = 1 LEFT JOIN b ON b.stable_key = k.stable_key AND b.n = 1""")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.survivor import survivors

    won = survivors(table(spark, sf, "topics"), F.col("stable_key"), F.col("id"), F.col("last_seen_year"), _topic_fields(by_row=True))
    return won.select(F.col("key").alias("stable_key"), *(F.coalesce(f"{c}_id", F.lit(-1)).cast("int").alias(f"{c}_id") for c in ("text", "label")))


_GOLDEN = """SELECT stable_key, arg_max(v, (votes, best)) AS v FROM (
      SELECT stable_key, regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS norm, max((coalesce(last_seen_year, -4611686018427387904), coalesce({then}, -4611686018427387904), -id)) AS best,
             arg_max(v, (coalesce(last_seen_year, -4611686018427387904), coalesce({then}, -4611686018427387904), -id)) AS v,
             round(sum((coalesce(frequency, 0) + 1.0) * coalesce(pow(0.85, 2025 - last_seen_year), 0.0)), 9) AS votes
      FROM (SELECT *, {value} AS v FROM t WHERE {ok}) GROUP BY stable_key, norm) GROUP BY stable_key"""


@query(f"""
    WITH t AS (SELECT *, length(regexp_replace(representative_text, '[^A-Za-z]', '', 'g')) >= 12 AS text_ok,
                      length(regexp_replace(label, '[^A-Za-z]', '', 'g')) >= 12 AND NOT coalesce(starts_with(representative_text, label), false) AS label_ok
               FROM topics),
    k AS (SELECT stable_key, count(*) AS copies FROM t WHERE stable_key IS NOT NULL GROUP BY stable_key),
    a AS ({_GOLDEN.format(value="representative_text", ok="text_ok", then="length(representative_text)")}),
    b AS ({_GOLDEN.format(value="label", ok="label_ok", then="frequency")})
    SELECT k.stable_key, k.copies, a.v AS representative_text, b.v AS label FROM k LEFT JOIN a ON a.stable_key = k.stable_key LEFT JOIN b ON b.stable_key = k.stable_key""")
def p3_golden(spark: SparkSession, sf: str) -> DataFrame:
    """One built record per key: the values with most weight, equal wordings voting together."""
    from quillmine.llm.survivor import survivors

    won = survivors(table(spark, sf, "topics"), F.col("stable_key"), F.col("id"), F.col("last_seen_year"), _topic_fields(by_row=False), decay=0.85, least_rows=1)
    return won.select(F.col("key").alias("stable_key"), "copies", F.col("text").alias("representative_text"), "label")


# ---------------------------------------------------------------- problem 6


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of all questions; the papers of the latest month are a batch of their own, the rest was there before."""
    from quillmine.llm.history import month_of
    from quillmine.llm.ledger import canonical_key

    rows = materialize(table(spark, sf, "sub_questions").select("id", "paper_id", canonical_key(F.col("text")).alias("key")), "keyed")
    papers = table(spark, sf, "papers").select(F.col("id").alias("paper_id"), month_of(F.col("created_at")).alias("month"))
    last = papers.agg(F.max("month")).first()[0] or 0
    return materialize(rows.join(papers, "paper_id", "left").select("id", "key", (F.coalesce("month", F.lit(0)) == last).alias("latest")), "batched")


_P6_KEY = """list_sort(list_filter(list_transform(string_split(text, '|'), lambda c: regexp_replace(lower(c), '[^\\p{L}\\p{N}]+', '', 'g')), lambda c: c <> ''))"""


@query(f"""
    WITH k AS (SELECT id, {_P6_KEY} AS key FROM sub_questions),
    f AS (SELECT key, min(id) AS first_id FROM k GROUP BY key)
    SELECT CAST(f.first_id AS INTEGER) AS first_id, k.id AS copy_id FROM k JOIN f ON k.key = f.key WHERE k.id <> f.first_id""")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.ledger import ledger_of

    rows = _keyed(spark, sf)
    ledger = ledger_of(rows, [~F.col("latest"), F.col("latest")])
    firsts = ledger.table().filter("copies > 1").select("key", "first_id")
    return rows.select("id", "key").join(firsts, "key").filter("id <> first_id").select(F.col("first_id").cast("int").alias("first_id"), F.col("id").alias("copy_id"))


@query(f"""
    SELECT CAST(min(id) AS BIGINT) AS first_id, count(*) AS copies FROM (SELECT id, {_P6_KEY} AS key FROM sub_questions) GROUP BY key""")
def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per different text with the number of its copies."""
    from quillmine.llm.ledger import ledger_of

    ledger = ledger_of(_keyed(spark, sf), [~F.col("latest"), F.col("latest")])
    return ledger.table().select("first_id", "copies")


# ---------------------------------------------------------------- problem 7

REFERENCE_LIMIT = 100_000


def _reference(df: DataFrame, what: str) -> list:
    rows = df.limit(REFERENCE_LIMIT + 1).collect()
    if len(rows) > REFERENCE_LIMIT:
        raise ValueError(f"{what}: a reference list may have {REFERENCE_LIMIT} entries; of a longer one, map against each part and take the least distance over all parts, unmatched where two parts have it")
    return rows


@query()
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.mapping import EXTRA_SHORT, Mapper, map_values

    subjects = _reference(table(spark, sf, "subjects").select("code", "name"), "subjects")
    months = _reference(table(spark, sf, "exam_months").select("month_no", "name"), "exam_months")
    codes = Mapper([(r.code, r.code) for r in subjects if r.code], [(r.name, r.code) for r in subjects if r.name and r.code], [], {})
    names = [r.name for r in months if r.name]
    short = [(n[:3], n) for n in names] + [(s, n) for n in names for s in EXTRA_SHORT.get(n, [])]
    month = Mapper([(n, n) for n in names], [], short, {r.month_no: r.name for r in months if r.name})
    fields = {
        "subject_code": (F.col("subject_code"), codes, frozenset(r.code for r in subjects)),
        "exam_month": (F.col("exam_month"), month, frozenset(names)),
    }
    return map_values(table(spark, sf, "papers"), F.col("id"), fields)


# ---------------------------------------------------------------- problem 8


@query()
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.tokenizer import encode_corpus

    return encode_corpus(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts encoded and decoded again; null texts come back empty."""
    from quillmine.llm.tokenizer import decode_corpus, encode_corpus

    ids = encode_corpus(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))
    return decode_corpus(ids, F.col("doc_id"), F.col("ids"))


# ---------------------------------------------------------------- problem 5


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "sub_questions").select(F.lit(0).alias("space"), F.col("id").cast("long").alias("id"), "text")
    topics = table(spark, sf, "topics").select(F.lit(1).alias("space"), F.col("id").cast("long").alias("id"), F.col("representative_text").alias("text"))
    return questions.unionByName(topics)


_P5_TEXTS = "t AS (SELECT 0 AS space, id, text FROM sub_questions UNION ALL SELECT 1, id, representative_text FROM topics)"


@query(f"WITH {_P5_TEXTS}, {_NEAR_SQL} SELECT CASE space WHEN 0 THEN 'sub_questions' ELSE 'topics' END AS source_table, id_a, id_b FROM near")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.similarity import near_duplicates

    pairs = near_duplicates(_texts(spark, sf))
    return pairs.select(F.when(F.col("space") == 0, "sub_questions").otherwise("topics").alias("source_table"), F.col("id_a").cast("int").alias("id_a"), F.col("id_b").cast("int").alias("id_b"))


@query(f"""WITH {_P5_TEXTS}, {_NEAR_SQL},
    g AS (SELECT space, id, min(id) OVER (PARTITION BY space, list_sort(ws)) AS class_id FROM n),
    k AS (SELECT space, id_a AS id, id_b AS other FROM near UNION ALL SELECT space, id_b, id_a FROM near),
    links AS (SELECT k.space, k.id, count(DISTINCT g.class_id) AS links FROM k JOIN g ON g.space = k.space AND g.id = k.other JOIN g own ON own.space = k.space AND own.id = k.id WHERE g.class_id <> own.class_id GROUP BY 1, 2)
    SELECT CASE g.space WHEN 0 THEN 'sub_questions' ELSE 'topics' END AS source_table, g.id, g.class_id, coalesce(links, 0) AS links FROM g LEFT JOIN links ON links.space = g.space AND links.id = g.id""")
def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The class form: each text with the least id of its copies and the number of other wordings near to it."""
    from quillmine.llm.similarity import near_groups

    groups = near_groups(_texts(spark, sf))
    return groups.select(F.when(F.col("space") == 0, "sub_questions").otherwise("topics").alias("source_table"), F.col("id").cast("int").alias("id"), F.col("class_id").cast("int").alias("class_id"), "links")


# ---------------------------------------------------------------- problem 10


@query()
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.spans import sharing_pairs

    return sharing_pairs(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


@query()
def p10_shared(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document, how many of its characters stand in long runs that another document has too."""
    from quillmine.llm.spans import shared_share

    return shared_share(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


# ---------------------------------------------------------------- problem 4


PAPERS_SENT = 1_000_000


def _scans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions of scanned papers with what their headers may say, and the texts of all others."""
    questions = table(spark, sf, "sub_questions").select("id", "paper_id", "text")
    papers = table(spark, sf, "papers").filter("pdf_type = 'scanned'").select(F.col("id").alias("paper_id"), F.col("subject_code").alias("code"), F.col("subject_name").alias("name"))
    few = papers.limit(PAPERS_SENT + 1).count() <= PAPERS_SENT
    if few:
        scanned = questions.join(F.broadcast(papers), "paper_id")
        clean = questions.join(F.broadcast(papers.select("paper_id")), "paper_id", "left_anti")
    else:
        # one paper may hold a tenth of the rows, so its rows go to 32 tasks
        salts = F.explode(F.array(*(F.lit(i) for i in range(32)))).alias("salt")
        salted, spread = questions.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int")), papers.select("*", salts)
        scanned = salted.join(spread, ["paper_id", "salt"]).drop("salt")
        clean = salted.join(spread.select("paper_id", "salt"), ["paper_id", "salt"], "left_anti")
    return scanned, clean.select("text")


@query()
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.scans import decoded

    return decoded(*_scans(spark, sf)).select("id", F.explode("kinds").alias("kind"))


@query()
def p4_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every scanned question as continuous readable text."""
    from quillmine.llm.scans import decoded

    return decoded(*_scans(spark, sf)).select("id", "text")


# ---------------------------------------------------------------- problem 9


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    from quillmine.llm.packing import pack
    from quillmine.llm.tokenizer import count_corpus

    tokens = materialize(count_corpus(table(spark, sf, "documents"), F.col("doc_id"), F.col("text")), "tokens")
    return pack(tokens.select(F.col("doc_id").alias("item"), F.col("tokens").alias("size")))


@query()
def p9_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Container of every piece of every document."""
    return _packed(spark, sf).select(F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("size").alias("tokens"), "container")


@query("SELECT count(DISTINCT doc_id) AS documents FROM documents WHERE text IS NOT NULL AND text <> ''")
def p9_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed with all their tokens, in containers none of which is overfull and into which only full pieces were cut."""
    from quillmine.llm.packing import CAPACITY, pack
    from quillmine.llm.tokenizer import count_corpus

    tokens = materialize(count_corpus(table(spark, sf, "documents"), F.col("doc_id"), F.col("text")), "tokens")
    packed = materialize(pack(tokens.select(F.col("doc_id").alias("item"), F.col("tokens").alias("size"))), "packed")
    overfull = packed.groupBy("container").agg(F.sum("size").alias("n")).filter(F.col("n") > CAPACITY).select("container")
    bad = packed.join(overfull, "container", "left_semi").select("item").distinct()
    parts = packed.groupBy("item").agg(F.sum("size").alias("size"), F.count_if(F.col("size") < CAPACITY).alias("rests"))
    whole = parts.join(tokens.select(F.col("doc_id").alias("item"), "tokens"), "item").filter((F.col("size") == F.col("tokens")) & (F.col("rests") <= 1)).join(bad, "item", "left_anti")
    return whole.agg(F.count("*").alias("documents"))


@query()
def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by fill in hundredths: the space that was left over."""
    fill = _packed(spark, sf).groupBy("container").agg(F.sum("size").alias("tokens"))
    return fill.groupBy(F.floor(F.col("tokens") * 100 / 2048).cast("int").alias("hundredths")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
