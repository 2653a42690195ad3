"""Sources, releases, audits and small functions on tables of a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import identifiers, similarity, text
from marginalia.operators import audit, curation, listings, release
from marginalia.sources import boundary, files, sinks
from marginalia.streaming import resume


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids_of_two_tables(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (("1", "2", "3"), ("2", "4", "5", "5")))
    assert {r["kind"]: r["n"] for r in files.id_differences(a, b).collect()} == {"without_audit": 2, "without_candidate": 2}
    assert {r["id"] for r in files.unprocessed(a, b).collect()} == {"1", "3"}
    assert [r["id"] for r in curation.missing_rows(a, b, ["id"]).orderBy("id").collect()] == ["1", "3"]


def test_audit_metadata_keeps_the_last_row(spark):
    rows = spark.createDataFrame([("1", "v", "Physics", 1), ("1", "w", "", 2), ("2", None, "Law", 1)], "id string, venue string, domain string, _ord int")
    assert {tuple(r) for r in files.audit_metadata(rows).collect()} == {("1", "w", "Biomedical Research"), ("2", None, "Law")}


def test_adjudications(spark, tmp_path):
    def written(*rows):
        (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
        return files.adjudications(spark, str(tmp_path / "a.jsonl"))

    good = {"source_file": "f", "id": "1", "action": "revise", "revision": {"resolved_paper_id": "p"}}
    assert written(good, good | {"id": "2", "action": "reject", "revision": None}).count() == 2
    for bad in (good | {"action": "perhaps"}, good | {"revision": {}}, good | {"action": None}):
        with pytest.raises(files.SourceError):
            written(bad)
    with pytest.raises(files.SourceError):
        written(good, good)


def test_confirmed_accepts(spark):
    annotations = spark.createDataFrame([(1, " Yes"), (2, "no"), (3, "YES"), (4, "yes")], "sample_id int, valid string")
    sample = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "sample_id int, split_id string")
    split = spark.createDataFrame([("a", "f.csv", "10"), ("b", "f.csv", "11")], "id string, source_file string, original_id string")
    assert [tuple(r) for r in files.confirmed_accepts(annotations, sample, split).collect()] == [("f.csv", "10")]


def test_result_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"id": 1}, {"id": 2}]}))
    assert files.latest_result(spark, str(tmp_path / "r.json")).first()["id"] == 2
    for name, content in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"<html>"), ("c.pdf", b" " * 2000 + b"%PDF-")):
        (tmp_path / "pdfs").mkdir(exist_ok=True)
        (tmp_path / "pdfs" / name).write_bytes(content)
    assert [r["path"].rsplit("/", 1)[1] for r in files.pdf_files(spark, str(tmp_path / "pdfs")).collect()] == ["a.pdf"]


def test_source_keys(spark):
    rows = spark.createDataFrame([("u", 2024, "T"), ("", 2024, "T"), (None, 2023, "S")], "source_paper_url string, year int, source_paper_title string")
    assert [r["source_key"] for r in files.with_source_key(rows).collect()] == ["u", "2024::T", "2023::S"]


def test_manifests_and_eligible_rows(spark):
    rows = spark.createDataFrame([("u", "t", "old", 1), ("u", "t", "new", 2), ("v", "t", None, 1)], "source_paper_url string, source_paper_title string, pdf_url string, _ord int")
    assert {(r["source_paper_url"], r["pdf_url"]) for r in release.manifests(rows).collect()} == {("u", "new"), ("v", None)}
    table = spark.createDataFrame([("f", "1", None, None), ("f", "2", "bad", None), ("f", "3", None, "Biomedical Research"), ("f", "4", None, "Biomedical Research")], "source_file string, id string, manual_exclusion string, domain string")
    members = spark.createDataFrame([("f", "4", "test")], "source_file string, original_id string, split string")
    assert {(r["id"], r["experimental_split"]) for r in release.eligible(table, members).collect()} == {("1", None), ("4", "test")}


def test_repairs_of_releases(spark):
    candidates = spark.createDataFrame([("1", "https://h/paper/2024/a", "t", "u"), ("2", "https://h/paper/2023/b", "t", "u"), ("3", "https://h/other", "t", "u")], "id string, source_paper_url string, target_paper_title string, target_paper_url string")
    table = spark.createDataFrame([("1", "New", "ARXIV:1"), ("2", "x", "y"), ("4", "z", "w")], "id string, resolved_title string, resolved_paper_id string")
    kept, rest = release.wrong_year_repair(candidates, table, 2024)
    assert [r["id"] for r in kept.collect()] == ["1"] and [r["id"] for r in rest.collect()] == ["1"]
    assert [tuple(r) for r in release.revised_candidates(candidates, rest).collect()] == [("1", "https://h/paper/2024/a", "New", "https://arxiv.org/abs/1")]
    private = spark.createDataFrame([("a", "", 1), (None, "b", 2), ("c", "d", 3)], "raw_sentence string, excerpt string, n int")
    assert release.removed_private_fields(private).first().asDict() == {"n_raw_sentence": 2, "n_excerpt": 2}
    assert {tuple(r) for r in release.counts_by(private.withColumn("odd", F.col("n") % 2), "odd").collect()} == {(0, 1), (1, 2)}


def test_revisions_and_counts(spark):
    revision = "struct<action:string,revision:map<string,string>>"
    rows = [("1", "old", 2000, ("revise", {"resolved_paper_id": "new", "resolved_year": "2021"})), ("2", "kept", 2001, ("accept", None)), ("3", "gone", 2002, ("reject", None)), ("4", "open", 2003, ("review", None))]
    decided = spark.createDataFrame(rows, f"id string, resolved_paper_id string, resolved_year int, decision {revision}")
    assert {(r["id"], r["resolved_paper_id"], r["resolved_year"]) for r in audit.apply_revisions(decided).collect()} == {("1", "new", 2021), ("2", "kept", 2001)}
    counts = audit.decision_counts(decided).first()
    assert (counts["n_rows"], counts["n_accept"], counts["n_revise"], counts["n_reject"], counts["n_review"], counts["release_ready"]) == (4, 1, 1, 1, 1, False)
    assert audit.decision_counts(decided.filter("id < '4'")).first()["release_ready"]
    known = spark.createDataFrame([("f", "1")], "source_file string, id string")
    assert [r["id"] for r in audit.unused_adjudications(known.union(spark.createDataFrame([("g", "1"), ("f", "2")], known.schema)), known).orderBy("id").collect()] == ["1", "2"]


def test_entries_used_as_passages_leave_both_tables(spark):
    table = spark.createDataFrame([("1", "[3] Smith John, Doe Jane. Title.", "x"), ("2", "We show that it holds [3].", "Other entry."), ("3", None, None)], "id string, raw_sentence string, raw_reference string")
    candidates = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "id string")
    left, right = audit.cleaned_pair(candidates, table)
    assert [r["id"] for r in left.orderBy("id").collect()] == ["2", "3", "9"] and [r["id"] for r in right.orderBy("id").collect()] == ["2", "3"]


def test_review_candidates(spark):
    row = dict(source_paper_title="Source", resolved_title="Other", raw_reference="r", resolution_score=0.9, citation_marker="[1]", reference_key=None, resolved_year=2000)
    rows = [row | {"id": "good"}, row | {"id": "same", "resolved_title": "source!"}, row | {"id": "spill", "raw_reference": "doi url arxiv doi"}, row | {"id": "low", "resolution_score": 0.1}]
    names = ["id", *row]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "id string, source_paper_title string, resolved_title string, raw_reference string, resolution_score double, citation_marker string, reference_key string, resolved_year int")
    assert {r["id"] for r in audit.review_candidates(df).collect()} == {"same", "low"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", "train", [1]), ("a", "train", [2]), ("c", None, []), ("d", "test", None)], "release_id string, experimental_split string, v array<int>")
    sinks.write_ids(rows, str(tmp_path / "ids"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "ids" / "experimental_split=train")).collect()] == ["a", "b"]
    sinks.write_nested(rows, str(tmp_path / "nested"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_nested(rows, str(tmp_path / "nested"))
    assert spark.read.parquet(str(tmp_path / "nested")).count() == 4
    assert json.loads(sinks.report(rows.agg(F.count("*").alias("n"))).first()["report"]) == {"n": 4}
    split = sinks.write_split(rows.select(F.col("release_id").alias("id")), "train", ["original_id"], 7)
    assert sorted((r["id"], r["original_id"], r["split"]) for r in split.collect()) == [(7, "a", "train"), (8, "b", "train"), (9, "c", "train"), (10, "d", "train")]


def test_service_manifests(spark):
    pmc = spark.createDataFrame([("12", " A  title", "J", [("pmc", "PMC9")]), ("13", "B", "J", []), ("x", "C", "J", None), ("14", " ", "J", [])], "uid string, title string, fulljournalname string, articleids array<struct<idtype:string,value:string>>")
    assert sorted((r["source_paper_title"], r["pdf_url"]) for r in listings.pmc_manifest(pmc, 2025).collect()) == [("A title", "https://pmc.ncbi.nlm.nih.gov/articles/PMC9/pdf/"), ("B", "https://pmc.ncbi.nlm.nih.gov/articles/PMC13/pdf/")]
    url = "fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,availabilityCode:string,url:string>>>"
    europe = spark.createDataFrame([("PMC1", "T", (("J",),), ([("html", "OA", "h"), ("pdf", "S", "s"), ("pdf", "OA", "p"), ("pdf", "OA", "q")],)), ("PMC2", "T", (("J",),), ([("html", "OA", "h")],)), (None, "T", None, None)], f"pmcid string, title string, journalInfo struct<journal:struct<title:string>>, {url}")
    assert [(r["source_paper_url"], r["pdf_url"], r["venue"]) for r in listings.europe_pmc_manifest(europe, 2025).collect()] == [("https://europepmc.org/article/PMC/PMC1", "p", "J")]


def test_small_expressions(spark):
    assert values(spark, ["abc", "abcdef", None], "string", lambda x: text.bounded(x, 4, "+")) == ["abc", "abcd+", None]
    assert values(spark, ["One fox. Two. A FOX?"], "string", lambda x: text.sentences_with(x, F.lit("Fox"))) == [["One fox.", "A FOX?"]]
    assert values(spark, ["A  b/C", "--", None], "string", text.slug)[:2] == ["a-b-c", "paper"]
    assert values(spark, ["a\x00b"], "string", text.without_nul) == ["ab"]
    assert values(spark, ["Based on the text: yes", "My guess is: A: b", "plain"], "string", text.without_guess_prefix) == ["yes", "A: b", "plain"]
    assert values(spark, ["https://h/paper/2021/x", "https://h/x"], "string", identifiers.url_year) == [2021, None]
    assert values(spark, ["https://h/2019/x", "https://h/x"], "string", lambda x: identifiers.infer_year(x, F.lit(0))) == [2019, None]
    assert values(spark, ["Straße: 2"], "string", similarity.folded_title_key) == ["strasse 2"]
    assert values(spark, ["a &amp; b"], "string", similarity.unescaped) == ["a & b"]
    assert values(spark, ['x {"action": {"name": "a"}} y {"z": 1}', "none"], "string", similarity.last_action) == ['{"action": {"name": "a"}}', None]
    assert values(spark, ["x {a {b} c} y", "} no"], "string", similarity.last_json_block) == ["{a {b} c}", None]
    paper = spark.createDataFrame([(("p", "T", "abcdef", None),)], "p struct<paperId:string,title:string,abstract:string,citationCount:int>")
    assert paper.select(text.paper_line(F.col("p"), 3).alias("x")).first()["x"] == "- Paper ID: p\n  Title: T\n  Abstract: abc\n  Citation Count: 0"
    key = spark.range(1).select(text.candidate_key(F.lit(" A  B "), F.lit("C: d"), F.lit(None).cast("string")).alias("k")).first()["k"]
    assert tuple(key) == ("a b", "c d", "")
    assert len(spark.range(1).select(text.stable_score(7, F.lit("a"), F.lit(None).cast("string")).alias("s")).first()["s"]) == 64


def test_offline_stand_ins(spark):
    papers = spark.createDataFrame([("p1", "Counting sheep", "Sheep sleep. Goats do not."), ("p2", "Counting goats", "")], "paperId string, title string, abstract string")
    index = boundary.LocalIndex(papers)
    asked = spark.createDataFrame([(1, "sheep counting")], "query_id int, query string")
    assert [(r["paper_id"], r["rank"]) for r in index.search(asked, 1).collect()] == [("p1", 1)]
    assert [r["snippet"] for r in index.snippets("GOATS").collect()] == ["Goats do not."]
    policy = boundary.Recorded([{"name": "a"}])
    assert [policy.act([])["name"] for _ in range(2)] == ["a", "stop"]
    pages = {"*": ([{"n": 1}, {"n": 2}], "x"), "x": ([{"n": 3}], "x")}
    assert [r["n"] for r in boundary.cursor_pages(pages.__getitem__, 9)] == [1, 2, 3] and [r["n"] for r in boundary.cursor_pages(pages.__getitem__, 2)] == [1, 2]
    assert list(boundary.batches(list("abcde"), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    calls = []
    known = spark.createDataFrame([("a", 1)], "k string, v int")

    def call(keys):
        calls.append(sorted(r["k"] for r in keys.collect()))
        return keys.withColumn("v", F.lit(9))

    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    joined, answers = resume.memoised(rows, "k", call, known)
    assert calls == [["b"]] and answers.count() == 2
    assert sorted(((r["k"] or ""), r["v"] or 0) for r in joined.collect()) == [("", 0), ("a", 1), ("b", 9), ("b", 9)]
