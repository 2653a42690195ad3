"""Small tests of the findings of round 3."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import citations, similarity, text
from marginalia.llm import jaccard, urls
from marginalia.operators import release, retrieval

#: The contract's rules as it words them.
CONTRACT = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}


@pytest.fixture
def duck():
    with duckdb.connect() as con:
        yield con


def test_rules_of_the_contract(spark, duck):
    """Each rule's word in the code, in a verdict and in the SQL; a host that ends in a rule's one without a dot is judged by the model."""
    assert {(h, p): v for v, h, p in urls.RULES} == CONTRACT
    pages = [(i, f"https://www.{h}{p}0") for i, (h, p) in enumerate(CONTRACT)] + [(5, "http://example.net/de/9"), (6, "http://casino-net/de/9")]
    got = {r["page_id"]: r for r in urls.op9_url_filter(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert [got[i]["verdict"] for i in range(6)] == [*CONTRACT.values(), "allow"] and got[6]["rule"] is None
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    assert sorted(duck.sql(urls.op9_sql()).fetchall()) == sorted(tuple(r) for r in got.values())


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_markers_are_found_once(spark):
    """A text is split at its headings and a sentence's markers are looked for once, however often they are asked for; entries travel with their document's keys."""
    docs = spark.range(3).selectExpr("cast(id AS string) AS k", "concat('Others have said so in many words before [1] now. ', id, '\n2 References\n[1] An entry') AS t")
    cut = docs.select("k", citations.body_and_references(F.col("t")).alias("s")).select("k", "s.body", "s.refs")
    assert optimized(cut).count("split(") <= 2 and sorted(r["refs"] for r in cut.collect()) == ["[1] An entry"] * 3
    for style, pattern in (("numeric", citations.NUMERIC_MARKER), ("author_year", citations.NARRATIVE)):
        refs = spark.createDataFrame([("0", "1", "e")], "k string, reference_key string, reference_text string")
        plan = optimized(citations.citing_sentences(docs, refs, "k", "t", style, "any"))
        assert plan.count(f", {pattern}, 0)") == 1 and plan.count("Join ") == 1, style


def test_citing_sentences_of_odd_bibliographies(spark):
    """Repeated entries give a row each, more columns stay, entries without a key and documents without entries cite nothing, a key twice in a marker counts twice."""
    said = "This is what many people have said in one sentence before [2, 2]."
    docs = spark.createDataFrame([("p", said), ("q", said), ("r", said), (None, said)], "k string, body string")
    refs = spark.createDataFrame([("p", "2", "a", 7), ("p", "2", "b", 8), ("p", None, "c", 9), ("q", None, "d", 1)], "k string, reference_key string, reference_text string, more int")
    got = citations.citing_sentences(docs, refs, "k", "body", mode="any")
    assert got.columns == ["k", "reference_key", "body_sentence_index", "sentence", "excerpt", "citation_marker", "citation_count", "reference_text", "more"]
    masked = said.replace("[2, 2]", "[CITATION, CITATION]")
    assert sorted(tuple(r) for r in got.collect()) == sorted(("p", "2", 0, said, masked, "[2, 2]", 2, t, n) for t, n in (("a", 7), ("b", 8)) for _ in range(2))


def test_reconstructed_rows_are_spread(spark):
    """With joins by shuffle no task gets most rows: records that have their sentence, or go by index, do not share a null key. Results of all errors stay."""
    sentences = spark.range(4000).selectExpr("concat('u', id div 8) AS source_paper_url", "cast(id % 8 AS int) AS body_sentence_index", "concat('Same words ', id % 2) AS sentence")
    sha = lambda i: text.fingerprint(F.concat(F.lit("Same words "), (F.col(i) % 2).cast("string")))
    records = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.expr("concat('u', id div 8)").alias("source_paper_url"), F.expr("cast(id % 8 AS int)").alias("locator_index"), sha("id").alias("passage_sha256"), F.lit("S").alias("citation_marker"))
    odd = [("a", None, 0, "x", "S"), ("b", "", None, "x", "S"), ("c", "gone", 0, "x", "S"), ("d", "u1", None, "x", "S"), ("e", "u1", 99, "x", "S"), ("u1", None, None, "x", "S"), (None, "u1", 0, "x", "S")]
    records = records.union(spark.createDataFrame(odd, "id string, source_paper_url string, locator_index int, passage_sha256 string, citation_marker string"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = release.reconstruct(records, sentences).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    tasks = Counter(r["task"] for r in rows)
    assert len(rows) == 4007 and max(tasks.values()) < 2000, tasks
    errors = {r["id"]: r["error"] for r in rows if r["status"] == "error"}
    assert errors == {"a": "missing source URL", "b": "missing source URL", "c": "source text unavailable", "d": "expected one matching sentence, found 0", "e": "sentence index out of range", "u1": "missing source URL", None: "passage digest mismatch"}


def test_folded_texts_are_objects_in_slices(spark):
    """Of a batch of 40 MB a few slices are Python objects at once; nulls, empty texts, long texts and empty batches as ever."""
    texts = [None, "", "ΑΣ  ß\u00a0x", "A" * 5_000_000, *["Long Text " * 100] * 35_000, None]
    tracemalloc.start()
    got = similarity.casefold.func(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000 and got.to_pylist() == [None if t is None else " ".join(t.split()).casefold() for t in texts]
    assert similarity.entity_title.func(pa.array([], pa.string())).to_pylist() == similarity.unescaped.func(pa.array([None], pa.string())).to_pylist()[:0] == []
    rows = spark.createDataFrame([(t,) for t in texts[:3]], "t string").select(similarity.entity_title("t").alias("e")).collect()
    assert [r["e"] for r in rows] == [None, "", "ασ ss x"]


def test_search_tasks_follow_papers(spark, monkeypatch):
    """More papers are more tasks, not larger ones, and the first papers stay the same."""
    papers = spark.range(1000).selectExpr("cast(id AS string) AS paperId", "concat('common w', id % 7, ' w', id % 11) AS title", "cast(null AS string) AS abstract")
    queries = spark.createDataFrame([("a", "common w3 w5"), ("b", "w1")], "query_id string, query string")
    want = sorted(retrieval.search(queries, papers).collect())
    monkeypatch.setattr(retrieval, "TASK_PAPERS", 90)
    found = retrieval.search(queries, papers)
    assert "hashpartitioning(paper_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 12), REPARTITION_BY_NUM" in plan
    assert sorted(found.collect()) == want and len(want) == 20


def tile_of(spark, n, monkeypatch):
    """(components, rows that went to each turn's pairs) of a tile of n sets: 15 of 16 are near copies of the first, the others of each other in fours."""
    rng = np.random.default_rng(n)
    fresh = lambda k: rng.integers(0, 1 << 62, k, dtype=np.int64)
    base, sets, turns = fresh(60), [], []
    for i in range(n):
        if i % 16 == 15 and i % 64 == 15:
            four = fresh(60)
        sets.append(np.unique(np.concatenate([(four if i % 16 == 15 else base)[:58], fresh(2)])).view(np.uint64))
    flat, offsets = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    columns = [pa.array(range(n), pa.int64()), pa.array(np.diff(offsets)), jaccard._lists(*jaccard.bitmaps(flat, offsets)), jaccard._packed(flat, offsets)]
    rows = spark.createDataFrame(pa.Table.from_arrays(columns, names=["id", "n", "bits", "shingles"]))
    name = "_part_pairs" if hasattr(jaccard, "_part_pairs") else "_block_pairs"
    real = getattr(jaccard, name)

    def counting(percent):
        seen, run = spark.sparkContext.accumulator(0), real(percent)
        turns.append(seen)

        def counted(batches):
            def each():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch

            yield from run(each())

        return counted

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, name, counting)
    tiles = spark.range(n).selectExpr("7L AS tile", "id AS rep", "0L AS first")
    found = {r["vertex"]: r["component"] for r in jaccard._links_by_tiles(tiles, rows, 80).collect()}
    monkeypatch.undo()
    return found, [t.value for t in turns if t.value]


def test_rows_of_a_tile_follow_its_members(spark, monkeypatch):
    """However many near copies a tile has, a turn sends about two rows for each; few others need few turns, and all links are found."""
    for n, most in ((256, 1), (512, 4)):
        found, turns = tile_of(spark, n, monkeypatch)
        assert found == {i: (i - i % 64 + 15 if i % 16 == 15 else 0) for i in range(n)}
        assert len(turns) <= most and max(turns) <= 2.5 * n, (n, turns)


def test_cheaper_patterns_find_the_same(spark):
    """No pattern is compiled for each text of a key; spaces, sentences, keys and places of marks are those of the plain patterns, on odd texts too."""
    rng = random.Random(7)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", ".", "!", "(", ")", ",", ";", "&", "and", "et al.", "ET AL.", "xet al.", "́et al.", "Smith", "Lee (2019)", "xLee (2019)", "(Lee, 2019; Wu, 2020b)", "1999", "é", "\U0001f600", "[3]", "De and Vu 2001"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randrange(0, 14))),) for _ in range(3000)] + [(None,)], "s string")
    s = F.col("s")
    plain_spaces = lambda x: F.trim(F.regexp_replace(x, rf"(?U){text.WS}+", " "))
    kept = F.split(F.regexp_replace(s, r"(?iU)\b(et al)\.", "$1<prd>"), rf"""(?U)(?<=[.!?]){text.WS}+(?=[A-Z0-9"'(\[])""")
    plain_sentences = F.filter(F.transform(kept, lambda x: plain_spaces(F.replace(x, F.lit("<prd>"), F.lit(".")))), lambda x: x != "")
    before = F.substring(s, F.lit(1), F.greatest(F.regexp_instr(s, F.lit(citations.YEAR)) - 1, F.lit(0)))
    names = F.filter(F.regexp_extract_all(F.split(before, r"\s*(?:,|;|\band\b|&)\s*", 2)[0], F.lit(r"[A-Za-z][A-Za-z'`-]*"), F.lit(0)), lambda n: ~F.lower(n).isin("et", "al"))
    plain_key = F.concat(F.when(F.regexp_instr(s, F.lit(citations.YEAR)) > 0, F.lower(F.try_element_at(names, F.lit(-1)))), F.lit("-"), F.lower(F.regexp_extract(s, citations.YEAR, 0)))
    pairs = [(plain_spaces(s), text.spaces(s)), (plain_sentences, text.sentences(s)), (plain_key, citations.author_year_key(s)), (text.word_count(text.spaces(s)), F.when(text.spaces(s) == "", 0).otherwise(text.spaced_word_count(text.spaces(s))))]
    for a, b in pairs:
        assert df.filter(~a.eqNullSafe(b)).count() == 0
    for pattern in (citations.NARRATIVE, citations.PARENTHETICAL):
        for r in df.select(s, citations.marks(s, pattern).alias("m")).collect():
            found = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, r["s"], re.ASCII)] if r["s"] is not None else None
            assert (None if r["m"] is None else [tuple(m) for m in r["m"]]) == found or not r["s"].isascii(), r
    assert "split(" not in optimized(df.select(citations.author_year_key(s)))
    refs = spark.createDataFrame([("0", "1", "e")], "k string, reference_key string, reference_text string")
    assert r"[^\s\x1c-\x1f]+" not in optimized(citations.citing_sentences(df.select(s.alias("k"), s.alias("t")), refs, "k", "t", "author_year", "any"))


def test_documents_meet_their_entries_before_they_are_split(spark):
    """Documents are sent and sorted for the join, not their sentences."""
    docs = spark.createDataFrame([("0", "a")], "k string, t string")
    refs = spark.createDataFrame([("0", "1", "e")], "k string, reference_key string, reference_text string")
    for style in ("numeric", "author_year"):
        plan = optimized(citations.citing_sentences(docs, refs, "k", "t", style, "any"))
        assert plan.index("Generate posexplode") < plan.index("Join "), style
