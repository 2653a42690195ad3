"""Registered queries over the driver's tables and the SQL that checks them.

The tables hold no citations, so queries that need markers build them from each row's own columns, in the
same way in Spark and SQL. Every query reads its whole tables and whole texts; a text's first line stands for a title, its last
line for the title it cites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations, identifiers, similarity, text
from ..operators import audit, curation, evaluation, listings, release, retrieval, sampling, trajectories
from ..staging import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 20_260_816

SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TITLE = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
#: The documents as candidates: excerpt, source and target titles, venue, split by hash.
CANDIDATES_SQL = rf"""
candidates AS (
  SELECT doc_id, lang AS venue, source, text, lower({SPACES.format("text")}) AS excerpt_key, {TITLE.format("string_split(text, chr(10))[1]")} AS source_key, {TITLE.format("string_split(text, chr(10))[-1]")} AS target_key,
    sha256('{SEED}' || chr(31) || lang || chr(31) || source || chr(31) || doc_id::varchar) AS score,
    CASE WHEN substr(sha256(doc_id::varchar), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split FROM documents)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def first_line(x: Column) -> Column:
    return F.substring_index(x, "\n", 1)


def last_line(x: Column) -> Column:
    return F.substring_index(x, "\n", -1)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", F.col("lang").alias("venue"), "source", "text", text.text_key(F.col("text")).alias("excerpt_key"), text.title_key(first_line(F.col("text"))).alias("source_key"), text.title_key(last_line(F.col("text"))).alias("target_key"),
        text.stable_score(SEED, F.col("lang"), F.col("source"), F.col("doc_id")).alias("score"), F.when(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(1)) < "8", "train").otherwise("test").alias("split"),
    )


@query(
    "flagship_balanced_sample",
    rf"""
WITH {CANDIDATES_SQL},
items AS (SELECT DISTINCT lower({SPACES.format("text")}) AS k FROM benchmark),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY excerpt_key ORDER BY doc_id) AS rn FROM candidates) WHERE rn = 1 AND excerpt_key NOT IN (SELECT k FROM items)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY score, doc_id) AS q FROM kept) WHERE q <= 20)
SELECT doc_id, venue, score, (row_number() OVER (ORDER BY score, doc_id) - 1 + 1000000)::bigint AS id FROM top""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Deduplicate, exclude texts that equal a benchmark item (not those that contain one), take 20 of each venue in hash order, number the sample."""
    items = table(spark, d, "benchmark").select(text.text_key(F.col("text")).alias("excerpt_key"))
    kept = curation.without_leakage(curation.first_wins(candidates(spark, d), ["excerpt_key"], ["doc_id"]), items, ["excerpt_key"])
    top = curation.balanced_top(kept, "venue", ["score", "doc_id"], 20)
    return curation.numbered(top.select("doc_id", "venue", "score"), ["score", "doc_id"], 1_000_000)


CONTAMINATION_SQL = f"""
SELECT doc_id, item_id FROM (SELECT doc_id, lower({SPACES.format("text")}) AS k FROM documents) d
JOIN (SELECT item_id, lower({SPACES.format("text")}) AS item FROM benchmark) b ON item <> '' AND contains(k, item)"""


@query("benchmark_contamination", CONTAMINATION_SQL)
def benchmark_contamination(spark, d):
    """Documents and the benchmark items that their whole texts contain."""
    docs = table(spark, d, "documents").select("doc_id", text.text_key(F.col("text")).alias("k"))
    items = table(spark, d, "benchmark").select("item_id", text.text_key(F.col("text")).alias("item"))
    return curation.contained_items(docs, items, "k", "item").select("doc_id", "item_id")


@query(
    "decontaminated_balanced_sample",
    rf"""
WITH {CANDIDATES_SQL},
found AS ({CONTAMINATION_SQL}),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY excerpt_key ORDER BY doc_id) AS rn FROM candidates) WHERE rn = 1 AND doc_id NOT IN (SELECT doc_id FROM found)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY score, doc_id) AS q FROM kept) WHERE q <= 20)
SELECT doc_id, venue, score, (row_number() OVER (ORDER BY score, doc_id) - 1 + 1000000)::bigint AS id FROM top""",
)
def decontaminated_balanced_sample(spark, d):
    """The flagship's sample of the documents that contain no benchmark item."""
    kept = curation.first_wins(candidates(spark, d), ["excerpt_key"], ["doc_id"]).join(benchmark_contamination(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")
    top = curation.balanced_top(kept, "venue", ["score", "doc_id"], 20)
    return curation.numbered(top.select("doc_id", "venue", "score"), ["score", "doc_id"], 1_000_000)


@query("normalize_text_keys", rf"SELECT doc_id, lower({SPACES.format('text')}) AS text_key, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS compare_key FROM documents")
def normalize_text_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_key(F.col("text")).alias("text_key"), text.compare_text(F.col("text")).alias("compare_key"))


@query("title_key_ascii", f"SELECT doc_id, {TITLE.format('text')} AS title_key FROM documents")
def title_key_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key(F.col("text")).alias("title_key"))


@query("folded_keys")
def folded_keys(spark, d):
    """Case folding and NFKC, which SQL lacks; tests compare with str.casefold and unicodedata."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", similarity.casefold("text").alias("folded"), similarity.entity_title("text").alias("entity"))


@query("passage_fingerprint", f"SELECT doc_id, sha256({SPACES.format('text')}) AS passage_sha256 FROM documents")
def passage_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("passage_sha256"))


@query("release_ids", "SELECT page_id, url, substr(sha256(url || '|' || page_id::varchar), 1, 20) AS release_id FROM pages")
def release_ids(spark, d):
    return table(spark, d, "pages").select("page_id", "url", text.release_id(F.col("url"), F.col("page_id")).alias("release_id"))


@query("exact_dedup_first_wins", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower({SPACES.format('text')}) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup(spark, d):
    return curation.first_wins(table(spark, d, "documents").withColumn("k", text.text_key(F.col("text"))), ["k"], ["doc_id"]).select("doc_id", "source")


@query("duplicate_report", f"SELECT count(*) AS n_rows, count(DISTINCT lower({SPACES.format('text')})) AS n_distinct, count(*) - count(DISTINCT lower({SPACES.format('text')})) AS n_removed FROM documents")
def duplicate_report(spark, d):
    return curation.duplicate_counts(table(spark, d, "documents").select(F.sha2(text.text_key(F.col("text")), 256).alias("k")), ["k"])


FLAGS_SQL = f"""
WITH {CANDIDATES_SQL},
train AS (SELECT * FROM candidates WHERE split = 'train'),
flags AS (
  SELECT c.*, excerpt_key <> '' AND excerpt_key IN (SELECT excerpt_key FROM train) AS e, source_key <> '' AND source_key IN (SELECT source_key FROM train) AS s, target_key <> '' AND target_key IN (SELECT target_key FROM train) AS t
  FROM candidates c WHERE split = 'test')"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    rows = candidates(spark, d)
    return curation.leakage_flags(rows.filter("split = 'test'"), rows.filter("split = 'train'"))


@query("leakage_exclusion_reasons", FLAGS_SQL + " SELECT doc_id, CASE WHEN e THEN 'excerpt_leakage' WHEN s THEN 'source_leakage' WHEN t THEN 'target_leakage' END AS reason FROM flags")
def leakage_reasons(spark, d):
    return _flags(spark, d).select("doc_id", curation.leakage_reason().alias("reason"))


@query("leakage_counts", FLAGS_SQL + " SELECT count(*) FILTER (e) AS n_excerpt_key, count(*) FILTER (s) AS n_source_key, count(*) FILTER (t) AS n_target_key, count(*) FILTER (e OR s OR t) AS n_any FROM flags")
def leakage_counts(spark, d):
    return curation.leakage_counts(_flags(spark, d))


@query("leakage_free_test", FLAGS_SQL + " SELECT doc_id FROM flags WHERE NOT (e OR s OR t)")
def leakage_free(spark, d):
    rows = candidates(spark, d)
    return curation.without_leakage(rows.filter("split = 'test'"), rows.filter("split = 'train'")).select("doc_id")


@query("rejected_by_venue_and_reason", FLAGS_SQL + " SELECT venue, CASE WHEN e THEN 'excerpt_leakage' WHEN s THEN 'source_leakage' WHEN t THEN 'target_leakage' END AS reason, count(*) AS n FROM flags WHERE e OR s OR t GROUP BY ALL")
def rejected_by_venue(spark, d):
    return curation.reason_counts(_flags(spark, d).withColumn("reason", curation.leakage_reason()), "venue")


SENTENCES_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '\b(et al)\.', '\1<prd>', 'gi'), '([.!?])\s+([A-Z0-9"''(\[])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda s: trim(regexp_replace(replace(s, '<prd>', '.'), '\s+', ' ', 'g'))), lambda s: s <> '')"""
BODY_SQL = r"trim(regexp_replace(replace(replace({}, '-' || chr(10), ''), chr(10), ' '), '\s+', ' ', 'g'))"


@query("sentence_split_index", f"WITH s AS (SELECT doc_id, {SENTENCES_SQL.format(BODY_SQL.format('text'))} AS l FROM documents) SELECT doc_id, unnest(range(len(l)))::int AS sentence_index, unnest(l) AS sentence FROM s")
def sentence_split_index(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(text.body_text(F.col("text")))).alias("sentence_index", "sentence"))


@query(
    "benchmark_shared_sentences",
    f"""
WITH a AS (SELECT DISTINCT doc_id, lower(unnest({SENTENCES_SQL.format(BODY_SQL.format('text'))})) AS k FROM documents),
b AS (SELECT DISTINCT item_id, lower(unnest({SENTENCES_SQL.format(BODY_SQL.format('text'))})) AS k FROM benchmark)
SELECT doc_id, item_id, count(*) AS n_shared FROM a JOIN b USING (k) GROUP BY ALL""",
)
def shared_sentences(spark, d):
    keys = lambda name, i: table(spark, d, name).select(i, F.explode(F.array_distinct(F.transform(text.sentences(text.body_text(F.col("text"))), F.lower))).alias("k"))
    return keys("documents", "doc_id").join(keys("benchmark", "item_id"), "k").groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))


@query("stable_hash_order_ids", f"WITH {CANDIDATES_SQL} SELECT doc_id, split, score, (row_number() OVER (ORDER BY score, doc_id) - 1 + 2000000)::bigint AS id FROM candidates")
def stable_ids(spark, d):
    return curation.numbered(candidates(spark, d).select("doc_id", "split", "score"), ["score", "doc_id"], 2_000_000)


@query(
    "waterfill_quota",
    """
WITH c AS (SELECT lang AS venue, (row_number() OVER (ORDER BY lang) - 1)::int AS idx, (count(*) // 50)::int AS initial, count(*)::int AS capacity FROM documents GROUP BY lang),
slots AS (SELECT venue, idx, unnest(range(initial, capacity)) AS level FROM c),
taken AS (SELECT venue, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY level, idx) AS rn FROM slots) WHERE rn <= 400 - (SELECT sum(initial) FROM c) GROUP BY venue)
SELECT venue, (initial + coalesce(n, 0))::bigint AS target FROM c LEFT JOIN taken USING (venue)""",
)
def waterfill(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("venue")).agg(F.count("*").cast("int").alias("capacity"))
    capacity = counts.select("venue", (F.row_number().over(Window.orderBy("venue")) - 1).alias("venue_idx"), F.expr("int(capacity div 50)").alias("initial"), "capacity")
    return sampling.waterfill(capacity, 400)


@query(
    "split_summary",
    f"""
WITH {CANDIDATES_SQL},
s AS (SELECT split, max(n) AS m FROM (SELECT split, source_key, count(*) AS n FROM candidates GROUP BY ALL) GROUP BY split),
t AS (SELECT split, max(n) AS m FROM (SELECT split, target_key, count(*) AS n FROM candidates GROUP BY ALL) GROUP BY split)
SELECT c.split, count(*) AS n_rows, count(DISTINCT excerpt_key) AS distinct_excerpt, count(DISTINCT source_key) AS distinct_source, count(DISTINCT target_key) AS distinct_target, any_value(s.m) AS max_per_source, any_value(t.m) AS max_per_target
FROM candidates c JOIN s USING (split) JOIN t USING (split) GROUP BY c.split""",
)
def split_summary(spark, d):
    return curation.split_summary(candidates(spark, d), "split")


@query(
    "split_overlap_matrix",
    f"WITH {CANDIDATES_SQL} "
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM (SELECT {k}_key FROM candidates WHERE split = 'train' INTERSECT SELECT {k}_key FROM candidates WHERE split = 'test')" for k in ("excerpt", "source", "target")),
)
def split_overlap(spark, d):
    rows = candidates(spark, d)
    return curation.overlap_counts(rows.filter("split = 'train'"), rows.filter("split = 'test'"))


GATE_SQL = """
WITH rows AS (
  SELECT doc_id, CASE WHEN n_chars % 17 = 0 THEN '' ELSE (n_chars % 211)::varchar END AS id, CASE WHEN n_chars % 13 = 0 THEN '20x5' ELSE (2024 + n_chars % 2)::varchar END AS year,
    text || CASE WHEN n_chars % 5 = 0 THEN '' ELSE ' [CITATION]' END AS excerpt FROM documents),
marked AS (SELECT *, trim(id) = '' OR trim(excerpt) = '' AS missing FROM rows),
gated AS (
  SELECT doc_id, CASE WHEN missing THEN 'missing_required_value' WHEN row_number() OVER (PARTITION BY missing, id ORDER BY doc_id) > 1 THEN 'duplicate_id' WHEN try_cast(year AS int) IS NULL THEN 'invalid_year'
    WHEN try_cast(year AS int) <> 2024 THEN 'wrong_year' WHEN len(string_split(excerpt, '[CITATION]')) - 1 <> 1 THEN 'citation_marker_count' END AS reason FROM marked)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(n % 17 == 0, "").otherwise((n % 211).cast("string")).alias("id"), F.when(n % 13 == 0, "20x5").otherwise((2024 + n % 2).cast("string")).alias("year"),
        F.concat("text", F.when(n % 5 == 0, "").otherwise(" [CITATION]")).alias("excerpt"),
    )
    return curation.candidate_gate(rows, ["id", "excerpt"], "year", 2024, "excerpt", "id", "doc_id")


@query("quality_gate_first_reason", GATE_SQL + " SELECT doc_id, reason FROM gated")
def quality_gate(spark, d):
    return _gated(spark, d).select("doc_id", "reason")


@query("quality_gate_counts", GATE_SQL + " SELECT reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY reason")
def quality_gate_counts(spark, d):
    return curation.reason_counts(_gated(spark, d))


MARKED_SQL = "'[' || (doc_id % 7 + 1) || ', ' || (doc_id % 5 + 8) || '-' || (doc_id % 5 + 10) || ']'"


@query(
    "numeric_citation_expand",
    rf"""
WITH m AS (SELECT doc_id, {MARKED_SQL} AS marker, {SPACES.format('text')} || ' ' || {MARKED_SQL} || ' follows.' AS sentence, [(doc_id % 7 + 1)::varchar, (doc_id % 5 + 8)::varchar, (doc_id % 5 + 9)::varchar, (doc_id % 5 + 10)::varchar] AS keys FROM documents),
e AS (SELECT *, unnest(keys) AS reference_key FROM m)
SELECT doc_id, marker, reference_key, replace(sentence, marker, '[' || array_to_string(list_transform(keys, lambda k: CASE WHEN k = reference_key THEN 'CITATION' ELSE k END), ', ') || ']') AS excerpt FROM e""",
)
def numeric_expand(spark, d):
    i = F.col("doc_id")
    marker = F.concat(F.lit("["), (i % 7 + 1).cast("string"), F.lit(", "), (i % 5 + 8).cast("string"), F.lit("-"), (i % 5 + 10).cast("string"), F.lit("]"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(text.spaces(F.col("text")), F.lit(" "), marker, F.lit(" follows.")).alias("sentence"))
    groups = rows.select("doc_id", "sentence", F.explode(citations.numeric_groups(F.col("sentence"))).alias("g"))
    each = groups.select("doc_id", "sentence", "g", F.explode("g.keys").alias("reference_key"))
    return each.select("doc_id", F.col("g.marker").alias("marker"), "reference_key", citations.excerpt(F.col("sentence"), F.col("g.marker"), citations.numeric_rendering(F.col("g.keys"), F.col("reference_key"))).alias("excerpt"))


@query(
    "reference_entries_islands",
    rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls)))::int AS i, unnest(ls) AS raw FROM l),
y AS (SELECT doc_id, i, {SPACES.format('raw')} AS chunk, i % 3 = 1 AS opens, (i // 3 % 4 + 1)::varchar AS number FROM x),
z AS (SELECT *, sum(opens::int) OVER (PARTITION BY doc_id ORDER BY i) AS entry FROM y WHERE chunk <> '' OR opens),
e AS (SELECT doc_id, entry, max(number) FILTER (opens) AS reference_key, {SPACES.format("string_agg(chunk, ' ' ORDER BY i)")} AS reference_text FROM z WHERE entry > 0 GROUP BY doc_id, entry)
SELECT doc_id, reference_key, arg_max(reference_text, entry) AS reference_text FROM e WHERE reference_text <> '' GROUP BY doc_id, reference_key""",
)
def reference_islands(spark, d):
    """Every third line of a document opens a numbered entry; numbers repeat."""
    mark = lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("["), (F.floor(i / 3) % 4 + 1).cast("string"), F.lit("] "), x)).otherwise(x)
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("refs"))
    return citations.numeric_reference_map(docs, "doc_id", "refs")


@query(
    "author_year_ambiguity",
    rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(len(ls)))::int AS i, unnest(ls) AS raw FROM l),
e AS (SELECT doc_id, chr((65 + i % 3)::int) || 'son, A. and Other, B. ' || (1990 + i % 2) || '. ' || trim(regexp_replace(lower(raw), '[^a-z]+', ' ', 'g')) || '.' AS t, chr((97 + i % 3)::int) || 'son-' || (1990 + i % 2) AS reference_key FROM x)
SELECT doc_id, reference_key, max({SPACES.format('t')}) AS reference_text FROM e GROUP BY ALL HAVING count(DISTINCT {SPACES.format('t')}) = 1""",
)
def author_year_ambiguity(spark, d):
    """Each line of a document is an entry; authors and years repeat, and keys with two different entries go."""
    name = lambda i: F.concat(F.char(65 + i % 3), F.lit("son, A. and Other, B. "), (1990 + i % 2).cast("string"), F.lit(". "))
    entry = lambda x, i: F.concat(name(i), F.trim(F.regexp_replace(F.lower(x), "[^a-z]+", " ")), F.lit("."))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), entry), "\n").alias("refs"))
    return citations.reference_map(docs, "doc_id", "refs", "author_year")


CITING_SQL = f"""
WITH s AS (SELECT doc_id, {SENTENCES_SQL.format(BODY_SQL.format('text'))} AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l)))::int AS i, unnest(l) AS s FROM s)"""
LENGTH_SQL = r"len(regexp_extract_all(sentence, '[^\s]+')) BETWEEN 8 AND 80"


@query(
    "citing_sentences_author_year",
    CITING_SQL
    + f""", y AS (SELECT doc_id, i, unnest(CASE i % 3 WHEN 0 THEN ['smith-2019'] WHEN 1 THEN ['jones-2020', 'miller-2018'] ELSE [] END) AS k, CASE i % 3 WHEN 0 THEN 'Smith et al. (2019) say ' ELSE 'Others (Jones, 2020; Miller and Lee, 2018) say ' END || s AS sentence FROM x)
SELECT doc_id AS paper_key, i AS body_sentence_index, sentence, CASE k WHEN 'smith-2019' THEN replace(sentence, 'Smith et al. (2019)', '[CITATION]') WHEN 'jones-2020' THEN replace(sentence, '(Jones, 2020;', '([CITATION];') ELSE replace(sentence, '; Miller and Lee, 2018)', '; [CITATION])') END AS excerpt,
  k AS reference_key, CASE i % 3 WHEN 0 THEN 'Smith et al. (2019)' ELSE '(Jones, 2020; Miller and Lee, 2018)' END AS citation_marker, CASE i % 3 WHEN 0 THEN 1 ELSE 2 END AS citation_count, 'Entry of ' || k AS reference_text FROM y WHERE {LENGTH_SQL}""",
)
def citing_author_year(spark, d):
    """Every sentence of every document with a narrative, a parenthetical or an unknown marker before it, through splitting, matching and masking."""
    said = lambda i: F.when(i % 3 == 0, "Smith et al. (2019) say ").when(i % 3 == 1, "Others (Jones, 2020; Miller and Lee, 2018) say ").otherwise("Unknown (2001) says ")
    body = F.array_join(F.transform(text.sentences(text.body_text(F.col("text"))), lambda s, i: F.concat(said(i), s)), " ")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_key"), body.alias("body"))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f"Entry of {k}").alias("t")) for k in ("smith-2019", "jones-2020", "miller-2018")]))
    refs = docs.select("paper_key", keys.alias("r")).select("paper_key", F.col("r.k").alias("reference_key"), F.col("r.t").alias("reference_text"))
    return citations.citing_sentences(docs, refs, "paper_key", "body", "author_year", "any")


@query(
    "citing_sentences_numeric",
    CITING_SQL
    + f""", y AS (SELECT doc_id, i, 'Claim [' || (i % 7 + 1) || CASE WHEN i % 4 = 0 THEN ', 2' ELSE '' END || '] says: ' || s AS sentence, '[' || (i % 7 + 1) || CASE WHEN i % 4 = 0 THEN ', 2' ELSE '' END || ']' AS marker, CASE WHEN i % 4 = 0 THEN [i % 7 + 1, 2] ELSE [i % 7 + 1] END AS ks FROM x WHERE i % 7 < 6),
z AS (SELECT *, unnest(ks) AS k FROM y WHERE {LENGTH_SQL})
SELECT doc_id AS paper_key, i AS body_sentence_index, replace(sentence, marker, '[' || array_to_string(list_transform(ks, lambda x: CASE WHEN x = k THEN 'CITATION' ELSE x::varchar END), ', ') || ']') AS excerpt, k::varchar AS reference_key, len(ks)::int AS citation_count, 'Entry ' || k || ' of ' || doc_id || ' goes on' AS reference_text FROM z""",
)
def citing_numeric(spark, d):
    """From a document with a bibliography to masked sentences: headings, numbered entries over two lines, markers, and sentences void by an unknown key."""
    said = lambda i: F.concat(F.lit("Claim ["), (i % 7 + 1).cast("string"), F.when(i % 4 == 0, ", 2").otherwise(""), F.lit("] says: "))
    body = F.array_join(F.transform(text.sentences(text.body_text(F.col("text"))), lambda s, i: F.concat(said(i), s)), " ")
    entries = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("] Entry "), k.cast("string"), F.lit(" of "), F.col("doc_id").cast("string"), F.lit("\n goes on"))), "\n")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_key"), citations.body_and_references(F.concat(body, F.lit("\nReferences\n"), entries)).alias("s")).select("paper_key", "s.body", "s.refs")
    refs = citations.reference_map(docs, "paper_key", "refs", "numeric")
    return citations.citing_sentences(docs, refs, "paper_key", "body", "numeric", "any").select("paper_key", "body_sentence_index", "excerpt", "reference_key", "citation_count", "reference_text")


@query(
    "body_reference_split",
    r"""
WITH t AS (SELECT doc_id, text || chr(10) || 'References' || chr(10) || '[1] An entry.' || chr(10) || 'more of it' AS t FROM documents)
SELECT doc_id, length(t) - length(chr(10) || 'References' || chr(10) || '[1] An entry.' || chr(10) || 'more of it') AS n_body, '[1] An entry.' || chr(10) || 'more of it' AS refs
FROM t WHERE NOT regexp_matches(lower(t), '\n\s*(\d+(\.\d+)*)?\s*(references|bibliography)\s*\n(.|\n)*\n\s*(\d+(\.\d+)*)?\s*(references|bibliography)\s*\n')""",
)
def body_split(spark, d):
    tail = "\nReferences\n[1] An entry.\nmore of it"
    rows = table(spark, d, "documents").select("doc_id", citations.body_and_references(F.concat(F.col("text"), F.lit(tail))).alias("s"), F.rtrim(F.col("text"), F.lit(" \n")).alias("head"))
    return rows.select("doc_id", F.char_length("s.body").cast("long").alias("n_body"), "s.refs")


@query(
    "discoverability_queries",
    rf"""
WITH f AS (SELECT doc_id, {SPACES.format('text')} AS t FROM documents),
s AS (SELECT doc_id, substr(t, 1, length(t) // 2) AS a, substr(t, length(t) // 2 + 1) AS b FROM f),
t AS (SELECT doc_id, regexp_extract_all(lower(a || '   ' || b), '[a-z0-9]+') AS w, regexp_extract_all(lower(a), '[a-z0-9]+') AS wa, regexp_extract_all(lower(b), '[a-z0-9]+') AS wb FROM s),
c AS (SELECT *, list_filter(w, lambda x: x NOT IN ({{stop}})) AS cw, list_filter(wa, lambda x: x NOT IN ({{stop}})) AS ca, list_filter(wb, lambda x: x NOT IN ({{stop}})) AS cb FROM t),
q AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[1:14], ' ') END AS q1, CASE WHEN len(cw) >= 3 THEN array_to_string(cw[1:8], ' ') END AS q2,
  CASE WHEN least(len(ca), 6) + least(len(cb), 6) >= 3 THEN array_to_string(list_concat(ca[greatest(len(ca) - 5, 1):len(ca)], cb[1:6]), ' ') END AS q3 FROM c)
SELECT doc_id, concat_ws(' | ', q1, CASE WHEN q2 IS DISTINCT FROM q1 THEN q2 END, CASE WHEN q3 IS DISTINCT FROM q1 AND q3 IS DISTINCT FROM q2 THEN q3 END) AS queries FROM q""".replace(
        "{stop}", ", ".join(f"'{w}'" for w in text.STOPWORDS)
    ),
)
def discoverability(spark, d):
    """Queries of each whole text with its citation in the middle."""
    flat = table(spark, d, "documents").select("doc_id", text.spaces(F.col("text")).alias("t"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    excerpt = F.concat(F.substring("t", F.lit(1), half), F.lit(" [CITATION] "), F.substring("t", half + 1, F.char_length("t")))
    return flat.select("doc_id", F.array_join(text.discoverability_queries(excerpt), " | ").alias("queries"))


WORDS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")))"


@query(
    "paper_search_topk",
    rf"""
WITH papers AS (SELECT doc_id::varchar AS paper_id, text AS title FROM documents),
qt AS (SELECT item_id AS query_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
pt AS (SELECT paper_id, unnest({WORDS_SQL.format('title')}) AS token FROM papers),
hits AS (SELECT query_id, paper_id, any_value(len(w)) AS n, count(*) AS shared FROM (SELECT query_id, w, unnest(w) AS token FROM qt) JOIN pt USING (token) GROUP BY query_id, paper_id)
SELECT * FROM (SELECT query_id, paper_id, shared / n AS score, row_number() OVER (PARTITION BY query_id ORDER BY shared / n DESC, paper_id)::int AS rank FROM hits) WHERE rank <= 3""",
)
def paper_search(spark, d):
    """The three papers nearest to each whole benchmark item; papers are all documents with their whole texts as titles."""
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paperId"), F.col("text").alias("title"), F.lit("").alias("abstract"))
    return retrieval.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), papers, 3)


@query("reference_resolution")
def reference_resolution(spark, d):
    """Entries that cite benchmark items, resolved among these and all documents' first lines; every third item is its own source. The ratio is Python's, see its test."""
    items = table(spark, d, "benchmark")
    papers = items.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("paperId"), F.col("text").alias("title"), F.lit(None).cast("string").alias("abstract"), (2000 + F.col("item_id") % 25).cast("int").alias("year")).unionByName(
        table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paperId"), first_line(F.col("text")).alias("title"), F.lit(None).cast("string").alias("abstract"), (2000 + F.col("n_chars") % 25).cast("int").alias("year"))
    )
    entry = F.concat(F.lit("Smith, A. and Lee, B. "), (2000 + F.col("item_id") % 25).cast("string"), F.lit(". "), F.col("text"))
    refs = items.select(F.col("item_id").alias("reference_id"), entry.alias("reference_text"), text.resolution_queries(entry).alias("queries"))
    own = items.filter("item_id % 3 = 0").select(F.col("item_id").alias("reference_id"), F.col("text").alias("source_title"))
    return retrieval.resolve(refs, papers, own)


@query("title_ratio")
def title_ratio(spark, d):
    """difflib's ratio of each document's first and last line."""
    docs = table(spark, d, "documents").select("doc_id", first_line(F.col("text")).alias("a"), last_line(F.col("text")).alias("b"))
    return docs.select("doc_id", similarity.sequence_ratio("a", "b").alias("ratio"), similarity.is_similar(F.col("a"), F.col("b"), 0.5).alias("similar"))


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    flat, first, last = text.spaces(F.col("text")), text.spaces(first_line(F.col("text"))), text.spaces(last_line(F.col("text")))
    return table(spark, d, "documents").select(
        i, i.cast("string").alias("id"), F.concat(F.col("lang"), F.lit(".csv")).alias("source_file"), first.alias("source_paper_title"), F.concat(F.lit("https://papers.example.org/paper/2024/"), i.cast("string")).alias("source_paper_url"),
        F.when(n % 11 == 0, "[4]").otherwise("[3]").alias("citation_marker"), F.when(n % 6 == 0, F.concat(F.lit("smith-"), (1995 + n % 30).cast("string"))).alias("reference_key"), F.concat(flat, F.lit(" [3]"), F.when(n % 3 == 0, "").otherwise(".")).alias("raw_sentence"),
        F.concat(F.lit("A. Author. "), last, F.lit(". doi url "), F.when(n % 9 == 0, "doi arxiv").otherwise("")).alias("raw_reference"), F.concat(F.lit("ARXIV:"), i.cast("string")).alias("resolved_paper_id"),
        F.when(n % 4 == 0, last).when(n % 4 == 1, first).otherwise(F.concat(F.lit("Title "), (n % 7).cast("string"))).alias("resolved_title"), (2000 + n % 25).cast("int").alias("resolved_year"), F.when(n % 5 == 0, F.when(n % 4 == 0, last).when(n % 4 == 1, first).otherwise(F.concat(F.lit("Title "), (n % 7).cast("string")))).alias("resolution_query"),
        ((n % 100) / 100.0).alias("resolution_score"), F.when(n % 10 == 0, 2).otherwise(1).alias("sentence_citation_count"),
    )


AUDIT_SQL = rf"""
WITH f AS (SELECT doc_id, lang, n_chars AS n, {SPACES.format('text')} AS t, {SPACES.format("string_split(text, chr(10))[1]")} AS first, {SPACES.format("string_split(text, chr(10))[-1]")} AS last FROM documents),
a AS (SELECT doc_id, n, lang || '.csv' AS source_file, first AS src, CASE WHEN n % 11 = 0 THEN '[4]' ELSE '[3]' END AS marker, CASE WHEN n % 6 = 0 THEN 1995 + n % 30 END AS ky,
  {SPACES.format("t || ' [3]' || CASE WHEN n % 3 = 0 THEN '' ELSE '.' END")} AS sentence, 'A. Author. ' || last || '. doi url ' || CASE WHEN n % 9 = 0 THEN 'doi arxiv' ELSE '' END AS reference,
  CASE n % 4 WHEN 0 THEN last WHEN 1 THEN first ELSE 'Title ' || (n % 7) END AS title, 2000 + n % 25 AS y, (n % 100) / 100.0 AS score, n % 10 = 0 AS multi FROM f),
k AS (SELECT *, {TITLE.format('src')} AS sk, {TITLE.format('title')} AS tk, length(reference) > 1200 OR len(regexp_extract_all(lower(reference), '\b(doi|url|arxiv)\b')) >= 4 AS spill, length({SPACES.format('reference')}) > 1200 AS long_reference, {TITLE.format('substr(reference, 1, 900)')} AS prefix FROM a),
g AS (SELECT *, list_filter([CASE WHEN {SPACES.format('src')} = '' THEN 'missing_source_paper_title' END, CASE WHEN {SPACES.format('title')} = '' THEN 'missing_resolved_title' END, CASE WHEN NOT contains(sentence, marker) THEN 'citation_marker_absent_from_raw_sentence' END, CASE WHEN multi THEN 'not_single_citation_context' END], lambda x: x IS NOT NULL) AS failures,
  list_filter([CASE WHEN spill THEN 'bibliography_span_spillover' END, CASE WHEN abs(ky - y) > 1 THEN 'citation_year_disagreement' END, CASE WHEN score < 0.65 THEN 'low_resolution_score' END, CASE WHEN long_reference THEN 'reference_span_likely_contains_multiple_entries' END, CASE WHEN sentence[-1] NOT IN ('.', '!', '?', ')', ']', '}}', '”', '’', '"', '''') THEN 'possibly_truncated_passage' END,
    CASE WHEN sk <> '' AND sk = tk THEN 'resolved_to_source_paper' END, CASE WHEN spill AND score < 0.80 THEN 'spillover_with_weak_match' END, CASE WHEN length(sentence) < 40 THEN 'very_short_passage' END], lambda x: x IS NOT NULL) AS flags,
  tk <> '' AND tk <> sk AND contains(prefix, tk) AND coalesce(abs(ky - y) <= 1, true) AS evidence, tk <> '' AND tk <> sk AND n % 5 = 0 AND coalesce(abs(ky - y) <= 1, true) AS by_query FROM k)"""


UNSAFE_SQL = "list_has_any(flags, ['resolved_to_source_paper', 'citation_year_disagreement'])"


@query(
    "audit_decisions",
    AUDIT_SQL
    + f""", v AS (SELECT *, CASE WHEN n % 13 = 0 THEN 1 WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 2 WHEN n % 17 = 0 THEN 3 WHEN len(failures) > 0 THEN 4 WHEN len(flags) > 0 AND (evidence OR by_query) AND NOT {UNSAFE_SQL} THEN 5 WHEN len(flags) > 0 THEN 6 ELSE 7 END AS level FROM g)
SELECT doc_id, CASE level WHEN 1 THEN CASE WHEN n % 2 = 0 THEN 'reject' ELSE 'revise' END WHEN 2 THEN 'reject' WHEN 3 THEN 'revise' WHEN 4 THEN 'reject' WHEN 6 THEN 'review' ELSE 'accept' END AS action,
  CASE level WHEN 1 THEN CASE WHEN n % 4 = 0 THEN 'checked' ELSE 'external_adjudication' END WHEN 2 THEN 'confirmed_invalid_context' WHEN 3 THEN 'wrong_target' WHEN 4 THEN array_to_string(failures, ',') WHEN 5 THEN CASE WHEN evidence THEN 'exact_resolved_title_in_reference_prefix' ELSE 'resolution_query_matches_resolved_title' END || ',citation_year_consistent' WHEN 6 THEN array_to_string(list_sort(flags), ',') ELSE '' END AS reasons,
  CASE level WHEN 1 THEN 'external_adjudication' WHEN 2 THEN 'confirmed_manual_audit' WHEN 3 THEN 'confirmed_manual_audit' WHEN 5 THEN 'deterministic_cross_check' ELSE 'automatic_policy' END AS authority,
  CASE WHEN level = 1 AND n % 2 = 1 THEN 'A' || doc_id WHEN level = 3 THEN 'C' || doc_id END AS revised_id FROM v""",
)
def audit_decisions(spark, d):
    """All six levels and both kinds of revision: adjudications and corrections stand for every 13th and 17th length."""
    n = F.col("n_chars")
    rows = audit_rows(spark, d)
    keyed = table(spark, d, "documents").select("doc_id", "n_chars", F.concat("lang", F.lit(".csv")).alias("source_file"), F.col("doc_id").cast("string").alias("id"))
    exclusions = table(spark, d, "labels").filter("quality = 0").select("doc_id").join(keyed, "doc_id").select("source_file", "id")
    adjudications = keyed.filter(n % 13 == 0).select(
        "source_file", "id", F.when(n % 2 == 0, "reject").otherwise("revise").alias("action"), F.when(n % 4 == 0, F.array(F.lit("checked"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(n % 2 == 1, F.create_map(F.lit("resolved_paper_id"), F.concat(F.lit("A"), "id"))).alias("revision"), F.lit("").alias("authority"),
    )
    corrections = keyed.filter(n % 17 == 0).select("source_file", "id", F.lit("wrong_target").alias("reason"), F.concat(F.lit("C"), "id").alias("paper_id"), F.lit("Title").alias("title"), F.lit(2020).alias("year"))
    out = audit.decide(rows, adjudications, exclusions, corrections)
    return out.select("doc_id", "decision.action", F.array_join("decision.reasons", ",").alias("reasons"), "decision.authority", F.try_element_at("decision.revision", F.lit("resolved_paper_id")).alias("revised_id"))


@query(
    "review_flag_counts",
    AUDIT_SQL + """ SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter(flags, lambda x: x NOT IN ('very_short_passage', 'possibly_truncated_passage', 'reference_span_likely_contains_multiple_entries'))) AS flag FROM g) GROUP BY flag""",
)
def review_flag_counts(spark, d):
    return audit.flag_counts(audit_rows(spark, d))


@query("href_extract", r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>.*?</a>', 1) AS h FROM pages) SELECT page_id, unnest(range(len(h)))::int AS place, unnest(h) AS href FROM l""")
def href_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(listings.raw_hrefs(F.col("html"))).alias("place", "href"))


@query("link_targets", r"SELECT page_id, regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1), '/+$', '')), '\.pdf$', '') AS target FROM pages")
def link_targets(spark, d):
    return table(spark, d, "pages").select("page_id", identifiers.link_target(F.col("url")).alias("target"))


@query(
    "conversation_role_tokens",
    r"""WITH n AS (SELECT conv_id, role, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, coalesce(sum(n) FILTER (role IS DISTINCT FROM 'assistant'), 0)::bigint AS input_tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::bigint AS output_tokens FROM n GROUP BY conv_id""",
)
def role_tokens(spark, d):
    return evaluation.tokens_by_role(table(spark, d, "conversations"))


@query("last_turn_state", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def last_turn_state(spark, d):
    return evaluation.last_turn(table(spark, d, "conversations"))


RUNS_SQL = """
WITH r AS (SELECT (conv_id % 4) / 10.0 AS temperature, turn AS run, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE role = 'assistant' END AS is_correct, CASE WHEN length(text) % 4 > 0 THEN text END AS selected, CASE WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM conversations),
m AS (SELECT temperature, run, count(*) AS examples, count(*) FILTER (is_correct) AS correct, count(selected) AS selected, count(*) FILTER (status = 'error') AS errors FROM r GROUP BY ALL),
s AS (SELECT *, correct / examples AS accuracy, selected / examples AS selection_rate FROM m)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text")
    rows = table(spark, d, "conversations").select(
        ((F.col("conv_id") % 4) / 10.0).alias("temperature"), F.col("turn").alias("run"), F.when(n % 3 != 0, F.col("role") == "assistant").alias("is_correct"), F.when(n % 4 > 0, F.col("text")).alias("selected"), F.when(n % 7 == 0, "error").otherwise("ok").alias("status")
    )
    return evaluation.run_metrics(rows, "temperature", "run")


@query("run_metrics", RUNS_SQL + " SELECT temperature, run, examples, correct, selected, errors, round(accuracy, 9) AS accuracy, round(selection_rate, 9) AS selection_rate FROM s")
def run_metrics(spark, d):
    return _runs(spark, d).withColumns({c: F.round(c, 9) for c in ("accuracy", "selection_rate")})


@query(
    "sweep_summary",
    RUNS_SQL
    + " SELECT temperature, count(*) AS runs, round(avg(accuracy), 9) AS mean_accuracy, round(coalesce(stddev_samp(accuracy), 0), 9) AS stdev_accuracy, round(min(accuracy), 9) AS min_accuracy, round(max(accuracy), 9) AS max_accuracy, round(avg(selection_rate), 9) AS mean_selection_rate, sum(errors)::bigint AS errors FROM s GROUP BY temperature",
)
def sweep_summary(spark, d):
    out = evaluation.sweep_summary(_runs(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_accuracy", "stdev_accuracy", "min_accuracy", "max_accuracy", "mean_selection_rate")})


@query(
    "citation_count_topk",
    rf"""
WITH d AS (SELECT doc_id, sha256(text) AS title, CASE WHEN n_chars % 11 <> 0 THEN n_chars % 1000 END AS citations, {WORDS_SQL.format('text')} AS w FROM documents),
qt AS (SELECT item_id AS query_id, {WORDS_SQL.format('text')} AS w FROM benchmark),
hits AS (SELECT query_id, doc_id, any_value(len(qw)) AS n, count(*) AS shared FROM (SELECT query_id, w AS qw, unnest(w) AS token FROM qt) JOIN (SELECT doc_id, unnest(w) AS token FROM d) USING (token) GROUP BY query_id, doc_id),
found AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared / n DESC, doc_id::varchar) AS rank FROM hits) JOIN d USING (doc_id) WHERE rank <= 100),
skip AS (SELECT query_id, title FROM found WHERE (doc_id + query_id) % 4 = 0)
SELECT query_id, doc_id, citations, place FROM (
  SELECT query_id, doc_id, citations, row_number() OVER (PARTITION BY query_id ORDER BY citations DESC NULLS LAST, rank)::int AS place FROM found f WHERE NOT EXISTS (SELECT 1 FROM skip s WHERE s.query_id = f.query_id AND s.title = f.title)) WHERE place <= 5""",
)
def citation_topk(spark, d):
    """Each benchmark item's five most cited of its first hundred documents, a quarter of whose titles (digests, as no two others are alike) are skipped by an altered form."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), F.sha2("text", 256).alias("title"), F.when(F.col("n_chars") % 11 != 0, F.col("n_chars") % 1000).alias("citationCount"))
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paperId"), F.col("text").alias("title"), F.lit("").alias("abstract"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = written(retrieval.search(queries, papers, 100).join(docs, "paper_id"), "found-papers")
    skip = found.filter((F.col("doc_id") + F.col("query_id")) % 4 == 0).select("query_id", F.concat(F.upper(F.left("title", F.lit(63))), F.lit("Z")).alias("title"))
    return retrieval.citation_count_topk(found, skip, 5).select("query_id", "doc_id", F.col("citationCount").alias("citations"), "place")


RELEASED_SQL = rf"""
WITH f AS (SELECT doc_id, n_chars AS n, lang, {SPACES.format('text')} AS t, text, 'https://papers.example.org/paper/2024/' || doc_id AS url FROM documents),
g AS (SELECT *, {SPACES.format("t || ' [3]' || CASE WHEN n % 3 = 0 THEN '' ELSE '.' END")} AS passage, CASE n % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS split FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
r AS (SELECT doc_id::varchar AS id, substr(sha256(url || '|' || doc_id), 1, 20) AS release_id, coalesce(CASE WHEN n % 3 = 0 THEN 2000 + n % 25 END, 2024)::int AS year, sha256(passage) AS passage_sha256, CASE WHEN n % 7 = 0 THEN n % 5 WHEN n % 2 = 0 THEN n % 9 END AS body_sentence_index, split AS experimental_split,
  CASE WHEN n % 3 = 0 THEN 'https://pdf.example.org/' || doc_id END AS source_pdf_url, CASE WHEN n % 11 = 0 THEN '[4]' ELSE '[3]' END AS citation_marker FROM g WHERE n % 5 <> 0 OR split IS NOT NULL)"""


@query("public_release_projection", RELEASED_SQL + " SELECT id, release_id, year, passage_sha256, body_sentence_index, CASE WHEN body_sentence_index IS NULL THEN 'passage_sha256' ELSE 'body_sentence_index' END AS locator_type, experimental_split, source_pdf_url, citation_marker FROM r")
def release_projection(spark, d):
    return _released(spark, d).select("id", "release_id", "year", "passage_sha256", "body_sentence_index", "locator_type", "experimental_split", "source_pdf_url", "citation_marker")


def _released(spark: SparkSession, d: str) -> DataFrame:
    """Each document's passage as a record, with exclusions, biomedical records, splits, a manifest and an index of sentences."""
    n = F.col("n_chars")
    rows = audit_rows(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    bad = table(spark, d, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("manual_exclusion", F.lit("low quality"))
    manifest = rows.filter(n % 3 == 0).select("source_paper_url", "source_paper_title", F.concat(F.lit("https://pdf.example.org/"), "id").alias("pdf_url"), (2000 + n % 25).cast("int").alias("year"))
    members = rows.filter(n % 4 < 2).select("source_file", F.col("id").alias("original_id"), F.when(n % 4 == 0, "train").otherwise("test").alias("split"))
    index = rows.filter(n % 2 == 0).select("source_paper_url", (n % 9).cast("int").alias("body_sentence_index"), text.fingerprint(F.col("raw_sentence")).alias("passage_sha256"))
    rows = rows.join(bad, "doc_id", "left").withColumns({"domain": F.when(n % 5 == 0, "Biomedical Research").otherwise("Computer Science"), "body_sentence_index": F.when(n % 7 == 0, (n % 5).cast("int"))})
    return release.release_records(rows, manifest, members, index)


@query(
    "release_report",
    RELEASED_SQL
    + " SELECT count(*) AS n_records, count(*) - count(DISTINCT release_id) AS n_duplicate_ids, 0::bigint AS n_missing_url, count(*) FILTER (body_sentence_index IS NULL) AS n_fingerprint_locators, count(body_sentence_index) AS n_index_locators, count(experimental_split) AS n_in_splits, 0 AS n_forbidden_fields FROM r",
)
def release_report(spark, d):
    return release.release_report(_released(spark, d))


@query("release_counts", RELEASED_SQL + " SELECT year, experimental_split, count(*) AS n FROM r GROUP BY ALL")
def release_counts(spark, d):
    return release.counts_by(_released(spark, d), "year", "experimental_split")


JOINED_SQL = f"""
WITH s AS (SELECT doc_id, n_chars AS n, {SENTENCES_SQL.format(BODY_SQL.format('text'))} AS l FROM documents),
x AS (SELECT doc_id, n, unnest(range(len(l)))::int AS i, unnest(l) AS sentence FROM s),
y AS (SELECT *, min(i) OVER (PARTITION BY doc_id, sentence) AS found FROM x),
r AS (SELECT doc_id || '/' || i AS id, 'https://papers.example.org/p/' || chr((97 + doc_id % 26)::int) || '/' || doc_id AS url, n, CASE WHEN i % 3 = 0 THEN i WHEN n % 2 = 0 THEN found END AS body_sentence_index, CASE i % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS experimental_split,
  CASE WHEN n % 3 = 0 THEN 'https://pdf.example.org/' || doc_id END AS manifest_pdf FROM y WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND (n % 5 <> 0 OR i % 3 < 2))"""


@query("public_release_joined", JOINED_SQL + " SELECT id, body_sentence_index, experimental_split, manifest_pdf FROM r")
def release_joined(spark, d):
    return _joined(spark, d).select("id", "body_sentence_index", "experimental_split", F.col("source_pdf_url").alias("manifest_pdf"))


@query(
    "release_report_joined",
    JOINED_SQL
    + """ SELECT count(*) AS n_records, count(*) - count(DISTINCT substr(sha256(url || '|' || id), 1, 20)) AS n_duplicate_ids, count(*) FILTER (url = '') AS n_missing_url, count(*) FILTER (body_sentence_index IS NULL) AS n_fingerprint_locators,
  count(body_sentence_index) AS n_index_locators, count(experimental_split) AS n_in_splits, 0 AS n_forbidden_fields FROM r""",
)
def release_report_joined(spark, d):
    return release.release_report(_joined(spark, d))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence as a record, with exclusions, splits, a manifest and an index of sentences that are not empty."""
    i, n = F.col("i"), F.col("n_chars")
    url = F.concat(F.lit("https://papers.example.org/p/"), F.char(97 + F.col("doc_id") % 26), F.lit("/"), F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").withColumns({"source_paper_url": url, "source_paper_title": F.concat(F.lit("Paper "), F.col("doc_id").cast("string")), "source_file": F.concat("lang", F.lit(".csv"))})
    bad = table(spark, d, "labels").filter("quality = 0").select("doc_id").distinct().withColumn("manual_exclusion", F.lit("low quality"))
    each = docs.select("doc_id", "n_chars", "source_file", "source_paper_url", "source_paper_title", F.posexplode(text.sentences(text.body_text(F.col("text")))).alias("i", "raw_sentence")).withColumn("id", F.concat_ws("/", F.col("doc_id").cast("string"), i.cast("string")))
    rows = each.join(bad, "doc_id", "left").withColumns({
        "domain": F.when(n % 5 == 0, "Biomedical Research").otherwise("Computer Science"), "body_sentence_index": F.when(i % 3 == 0, i), "citation_marker": F.left("raw_sentence", F.lit(1)), "resolved_paper_id": F.lit(""), "resolved_title": F.lit(""),
    })
    members = each.filter(i % 3 < 2).select("source_file", F.col("id").alias("original_id"), F.when(i % 3 == 0, "train").otherwise("test").alias("split"))
    manifest = docs.filter(n % 3 == 0).select("source_paper_url", "source_paper_title", F.concat(F.lit("https://pdf.example.org/"), F.col("doc_id").cast("string")).alias("pdf_url"), (2000 + n % 25).cast("int").alias("year"))
    index = each.filter(n % 2 == 0).select("source_paper_url", F.col("i").alias("body_sentence_index"), text.fingerprint(F.col("raw_sentence")).alias("passage_sha256"))
    return release.release_records(rows, manifest, members, index)


@query(
    "reconstruct_verify",
    f"""
WITH s AS (SELECT doc_id, {SENTENCES_SQL.format(BODY_SQL.format('text'))} AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l)))::int AS i, unnest(l) AS sentence FROM s),
n AS (SELECT doc_id, sentence, count(*) AS c FROM x GROUP BY ALL)
SELECT doc_id || '/' || i AS id, CASE WHEN i % 2 = 0 OR c = 1 THEN 'ok' ELSE 'error' END AS status, CASE WHEN i % 2 = 0 OR c = 1 THEN '[CITATION]' || substr(sentence, 2) END AS excerpt,
  CASE WHEN i % 2 = 1 AND c <> 1 THEN 'expected one matching sentence, found ' || c END AS error FROM x JOIN n USING (doc_id, sentence)""",
)
def reconstruct_verify(spark, d):
    """Each sentence is a record, by index if that is even, else by fingerprint; its marker is its first character."""
    each = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_paper_url"), F.posexplode(text.sentences(text.body_text(F.col("text")))).alias("body_sentence_index", "sentence"))
    records = each.select(
        F.concat_ws("/", "source_paper_url", F.col("body_sentence_index").cast("string")).alias("id"), "source_paper_url", F.when(F.col("body_sentence_index") % 2 == 0, F.col("body_sentence_index")).alias("locator_index"), text.fingerprint(F.col("sentence")).alias("passage_sha256"), F.left("sentence", F.lit(1)).alias("citation_marker")
    )
    return release.reconstruct(records, each)


@query(
    "training_record_nested",
    f"""WITH {CANDIDATES_SQL} SELECT doc_id AS row_id, venue, text AS excerpt, sha256(target_key) AS ground_truth FROM candidates""",
)
def training_records(spark, d):
    rows = candidates(spark, d).select(F.col("doc_id").alias("id"), "venue", F.col("text").alias("excerpt"), F.lit(2024).alias("year"), first_line(F.col("text")).alias("source_paper_title"), last_line(F.col("text")).alias("target_paper_title"), F.col("source_key").alias("title_key"), "target_key")
    targets = rows.select("id", "title_key", F.sha2("target_key", 256).alias("target_id"))
    out = evaluation.training_records(rows, targets, "Find the cited paper.")
    return out.select("extra_info.row_id", "extra_info.venue", F.col("prompt")[1]["content"].alias("excerpt"), F.col("reward_model.ground_truth").alias("ground_truth"))


@query(
    "paper_urls_and_pdfs",
    r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ARXIV:' WHEN 1 THEN 'DOI:' WHEN 2 THEN 'URL:' ELSE '' END || page_id AS pid,
  CASE page_id % 3 WHEN 0 THEN 'https://openaccess.thecvf.com/content/C2024/html/' || page_id || '.html' WHEN 1 THEN 'https://papers.nips.cc/paper_files/paper/2023/hash/' || page_id || '-Abstract-Main.html' ELSE url END AS u FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || page_id WHEN 1 THEN 'https://doi.org/' || page_id WHEN 2 THEN page_id::varchar ELSE 'https://www.semanticscholar.org/paper/' || page_id END AS paper_url,
  CASE page_id % 3 WHEN 0 THEN 'https://openaccess.thecvf.com/content/C2024/papers/' || page_id || '.pdf' WHEN 1 THEN 'https://papers.nips.cc/paper_files/paper/2023/hash/' || page_id || '-Paper-Main.pdf' END AS pdf_url,
  CASE page_id % 3 WHEN 0 THEN 'https://openaccess.thecvf.com/content/C2024/papers/' || page_id || '.pdf' WHEN 1 THEN 'https://papers.nips.cc/paper_files/paper/2023/file/' || page_id || '-Paper-Main.pdf' END AS derived_url,
  coalesce(nullif(regexp_extract(u, '(?:19|20)\d{2}'), '')::int) AS year FROM u""",
)
def paper_urls(spark, d):
    i = F.col("page_id").cast("string")
    rows = table(spark, d, "pages").select(
        "page_id",
        F.concat(F.element_at(F.array(*[F.lit(p) for p in ("ARXIV:", "DOI:", "URL:", "")]), (F.col("page_id") % 4 + 1).cast("int")), i).alias("pid"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://openaccess.thecvf.com/content/C2024/html/"), i, F.lit(".html"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://papers.nips.cc/paper_files/paper/2023/hash/"), i, F.lit("-Abstract-Main.html"))).otherwise(F.col("url")).alias("u"),
    )
    return rows.select("page_id", identifiers.paper_url(F.col("pid")).alias("paper_url"), identifiers.infer_pdf_url(F.col("u"), F.lit(None).cast("string")).alias("pdf_url"), identifiers.derived_pdf_url(F.col("u")).alias("derived_url"), identifiers.infer_year(F.col("u"), F.lit(None).cast("int")).alias("year"))


@query(
    "identifier_match",
    """
WITH k AS (SELECT c_custkey, c_custkey::varchar AS k, CASE c_custkey % 4 WHEN 0 THEN 'P' || c_custkey WHEN 1 THEN 'DOI:10.1/' || c_custkey WHEN 2 THEN 'URL:https://x.example/' || c_custkey || '/' ELSE 'CorpusId:none' END AS t FROM customer)
SELECT c_custkey, lower(t) = 'p' || k OR (contains(t, ':') AND (lower(t) = 'doi:10.1/' || k OR (starts_with(lower(t), 'url:') AND rtrim(lower(substr(t, 5)), '/') = 'https://x.example/' || k))) AS matches FROM k""",
)
def identifier_match(spark, d):
    k, s = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    target = F.when(k == 0, F.concat(F.lit("P"), s)).when(k == 1, F.concat(F.lit("DOI:10.1/"), s)).when(k == 2, F.concat(F.lit("URL:https://x.example/"), s, F.lit("/"))).otherwise(F.lit("CorpusId:none"))
    return table(spark, d, "customer").select("c_custkey", identifiers.identifier_matches(F.concat(F.lit("p"), s), F.create_map(F.lit("DOI"), F.concat(F.lit("10.1/"), s)), F.concat(F.lit("https://X.example/"), s), target).alias("matches"))


@query("next_id_report", "SELECT coalesce(max(o_orderkey), 99999) + 1 AS next_id FROM orders")
def next_id_report(spark, d):
    return curation.next_id(table(spark, d, "orders"), "o_orderkey")


@query("diverse_sample_greedy")
def diverse_sample(spark, d):
    """A quota of 10 from each venue; sequential, so compared with a plain loop in the tests."""
    rows = curation.first_wins(candidates(spark, d), ["excerpt_key"], ["doc_id"])
    return sampling.diverse_sample(rows.withColumn("source_key", F.col("source")), "venue", 10, "doc_id")


@query("holdout_disjoint")
def holdout_disjoint(spark, d):
    """6 rows of each venue held out; sequential, see diverse_sample_greedy."""
    return sampling.hold_out(candidates(spark, d).withColumn("source_key", F.col("source")), "venue", 6, "doc_id")


@query(
    "trajectory_replay",
    """
WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role FROM conversations),
s AS (SELECT conv_id, min(i) FILTER (role = 'assistant' AND i <= 5) AS chosen, count(*) AS n, min(i) FILTER (role = 'user') AS searched FROM a GROUP BY conv_id)
SELECT conv_id AS trajectory_id, n::int AS n_actions, coalesce(first_pick IS NOT NULL, false) AS correct FROM s LEFT JOIN (
  SELECT a.conv_id, min(a.i) AS first_pick FROM a JOIN s USING (conv_id) WHERE a.role = 'assistant' AND a.i <= 5 AND searched < a.i GROUP BY a.conv_id) USING (conv_id)""",
)
def trajectory_replay(spark, d):
    """User turns search and find one paper, assistant turns select it; system turns ask."""
    i = F.col("conv_id").cast("string")
    paper = F.struct(i.alias("paperId"), F.lit("t").alias("title"), F.create_map().cast("map<string,string>").alias("externalIds"), F.lit("u").alias("url"))
    name = F.when(F.col("role") == "user", "search_relevance").when(F.col("role") == "assistant", "select").otherwise("ask_for_more_context")
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("trajectory_id"), "turn", name.alias("name"), F.lit("q").alias("query"), i.alias("paper_id"), F.when(F.col("role") == "user", F.array(paper)).alias("results"))
    targets = log.select("trajectory_id", F.col("paper_id").alias("target_id")).distinct()
    return evaluation.replay(log, targets).select("trajectory_id", "n_actions", "correct")


@query("trajectory_observations")
def trajectory_observations(spark, d):
    """What each turn of each conversation is told: user turns search for two documents, assistant turns read them, look for a word in them or select one. Compared with plain Python, see its test."""
    n, i = F.col("turn"), F.col("conv_id")
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paperId"), F.when(F.col("doc_id") % 7 != 0, F.lit("https://pdf.example.org/x")).alias("pdf_url"), "text")
    paper = lambda x: F.struct(x.cast("string").alias("paperId"), F.concat(F.lit("Title "), x.cast("string")).alias("title"), F.lit(None).cast("string").alias("abstract"), (n % 9).cast("int").alias("citationCount"), F.create_map().cast("map<string,string>").alias("externalIds"), F.lit(None).cast("string").alias("url"))
    called = F.when(F.col("role") == "user", "search_relevance").when(F.col("role") != "assistant", "ask_for_more_context").when((i + n) % 3 == 0, "read").when((i + n) % 3 == 1, "find_in_text").otherwise("select")
    log = table(spark, d, "conversations").filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).select(
        i.alias("trajectory_id"), "turn", called.alias("name"), F.when(i % 5 != 0, F.lit("th")).otherwise("").alias("query"), (i + n % 2).cast("string").alias("paper_id"), F.lit("T").alias("paper_title"), F.when(F.col("role") == "user", F.array(paper(i), paper(i + n % 2))).alias("results")
    )
    return trajectories.told(log, papers).select("trajectory_id", "turn", "place", "name", "status", "observation", F.col("selected.paperId").alias("selected_id"))


@query("snippet_search", f"WITH s AS (SELECT item_id, {SENTENCES_SQL.format('text')} AS l FROM benchmark), x AS (SELECT item_id, unnest(range(len(l)))::int AS sentence_index, unnest(l) AS snippet FROM s) SELECT item_id::varchar AS \"paperId\", sentence_index, snippet FROM x WHERE contains(lower(snippet), 'en')")
def snippet_search(spark, d):
    papers = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("paperId"), F.col("text").alias("abstract"))
    return retrieval.snippets(papers, "EN")



@query(
    "leakage_verdicts",
    f"WITH {CANDIDATES_SQL}, o AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM (SELECT {k}_key FROM candidates WHERE split = 'train' INTERSECT SELECT {k}_key FROM candidates WHERE split = 'test')" for k in ("excerpt", "source", "target"))
    + ") SELECT kind, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o",
)
def leakage_verdicts(spark, d):
    rows = candidates(spark, d)
    return curation.leakage_table(curation.overlap_counts(rows.filter("split = 'train'"), rows.filter("split = 'test'")))


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    """A page of results is the feature: rows 41 to 60."""
    return curation.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("k")), ["k", "o_orderkey"], 40, 20).drop("k")


@query("service_batches", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 200 AS batch FROM orders")
def service_batches(spark, d):
    return curation.batch_numbers(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "batch")


@query("running_ids", "SELECT conv_id, turn, role, (row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 + 100000)::bigint AS id FROM conversations")
def running_ids(spark, d):
    """A running id over all rows in their order, which is of several columns that are no text."""
    return curation.numbered(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"], 100_000).drop("text")


@query(
    "biomedical_gate_counts",
    """
WITH r AS (SELECT doc_id::varchar AS id, CASE WHEN n_chars % 3 = 0 THEN ' ' ELSE lang END AS venue, CASE WHEN n_chars % 17 = 0 THEN '' ELSE source END AS target, text || CASE WHEN n_chars % 5 = 0 THEN '' ELSE ' [CITATION]' END AS excerpt, CASE WHEN n_chars % 4 = 0 THEN '2024' ELSE '2025' END AS year FROM documents),
g AS (SELECT *, CASE WHEN trim(target) = '' OR trim(excerpt) = '' THEN 'missing_required_value' WHEN len(string_split(excerpt, '[CITATION]')) <> 2 THEN 'citation_marker_count' WHEN year <> '2025' THEN 'wrong_year' END AS reason FROM r)
SELECT count(*) AS n_rows, count(*) FILTER (reason = 'missing_required_value') AS n_missing_required_value, count(*) FILTER (reason = 'citation_marker_count') AS n_citation_marker_count, count(*) FILTER (reason = 'wrong_year') AS n_wrong_year,
  count(*) FILTER (reason IS NULL AND trim(venue) = '') AS n_missing_venue_kept, count(*) FILTER (reason IS NULL) AS n_kept FROM g""",
)
def biomedical_gate_counts(spark, d):
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(n % 3 == 0, " ").otherwise(F.col("lang")).alias("venue"), F.when(n % 17 == 0, "").otherwise(F.col("source")).alias("target"), F.concat("text", F.when(n % 5 == 0, "").otherwise(" [CITATION]")).alias("excerpt"),
        F.when(n % 4 == 0, "2024").otherwise("2025").alias("year"),
    )
    audit_table = table(spark, d, "labels").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.max("quality").alias("quality"))
    return curation.biomedical_gate(rows, audit_table, ["id", "target", "excerpt"])[1]


@query(
    "proceedings_papers",
    """
WITH p AS (SELECT url, page_id AS i, unnest([1, 2, 3]) AS k, CASE page_id % 4 WHEN 0 THEN '/v/' WHEN 1 THEN '/content/C/html/' WHEN 2 THEN '/p/' ELSE '/paper_files/paper/2023/hash/' END AS folder FROM (SELECT page_id, 'https://papers.example.org/list/' || page_id AS url FROM pages))
SELECT url AS page, 'The title number ' || k || ' of page ' || i AS title, 'https://papers.example.org' || folder || i || '-' || k || CASE i % 4 WHEN 1 THEN '.html' WHEN 3 THEN '-Abstract-Main.html' ELSE '' END AS source_paper_url,
  'https://papers.example.org' || CASE i % 4 WHEN 0 THEN '/v/' || i || '-' || k WHEN 1 THEN '/content/C/papers/' || i || '-' || k WHEN 2 THEN '/p/' || i || '-' || k ELSE '/paper_files/paper/2023/file/' || i || '-' || k || '-Paper-Main' END || '.pdf' AS pdf_url FROM p""",
)
def proceedings_papers(spark, d):
    """Three papers on each listing page, in one of four layouts, behind the page's own markup."""
    i = F.col("page_id").cast("string")

    def entry(k: Column) -> Column:
        name, title = F.concat(i, F.lit("-"), k.cast("string")), F.concat(F.lit("The title number "), k.cast("string"), F.lit(" of <i>page</i> "), i)
        kind = F.col("page_id") % 4
        return (
            F.when(kind == 0, F.concat(F.lit('<div class="paper"><p class="title">'), title, F.lit('</p><a href="/v/'), name, F.lit('">abs</a> <a href="/v/'), name, F.lit('-supp.pdf">supp</a> <a href="/v/'), name, F.lit('.pdf">pdf</a></div>')))
            .when(kind == 1, F.concat(F.lit("<a href='/content/C/html/"), name, F.lit(".html'>"), title, F.lit("</a>")))
            .when(kind == 2, F.concat(F.lit('<a href="/p/'), name, F.lit('">'), title, F.lit('</a> <a href="/p/'), name, F.lit('.pdf">pdf</a>')))
            .otherwise(F.concat(F.lit("<a href=/paper_files/paper/2023/hash/"), name, F.lit("-Abstract-Main.html>"), title, F.lit("</a>")))
        )

    pages = table(spark, d, "pages").select(F.concat(F.lit("https://papers.example.org/list/"), i).alias("url"), F.concat(F.col("html"), F.array_join(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), entry), " ")).alias("html"))
    return listings.papers(pages).select("page", "title", "source_paper_url", "pdf_url")
