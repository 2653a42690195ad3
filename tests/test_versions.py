"""Tables that change together, corrections over three of them, first-wins over several runs."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import corrections, curation
from marginalia.sources.versions import VersionError, Versions
from marginalia.streaming import resume


def test_versions_fail_whole(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "base"))
    assert v.current() is None and v.entries() == {}
    with pytest.raises(VersionError):
        v.read("a")
    assert v.commit({"a": spark.range(1), "b": spark.range(2)}) == 1
    with pytest.raises(RuntimeError, match="disk"):

        def broken(df, path):
            raise RuntimeError("disk full")

        v.commit({"a": spark.range(5), "b": spark.range(6)}, {"b": broken})
    assert v.current() == 1 and (v.read("a").count(), v.read("b").count()) == (1, 2)
    (tmp_path / "base" / "log" / "00000002").write_text("data-half")  # a writer died in its log entry
    assert v.current() == 1
    assert v.commit({"a": v.read("a").union(spark.range(1)), "b": spark.range(3)}, after=1) == 3
    with pytest.raises(VersionError, match="stands where 1 was read"):
        v.commit({"a": spark.range(9)}, after=1)
    assert (v.read("a").count(), v.read("a", 1).count()) == (2, 1)
    assert v.rollback(1) == 4 and v.read("a").count() == 1 and v.read("b", 3).count() == 3
    assert len(v.vacuum(2)) == 2 and v.read("a").count() == 1 and v.read("b", 3).count() == 3


AUDIT = "source_file string, id string, year int, source_paper_title string, resolved_paper_id string, resolved_title string, resolved_year int, resolution_query string, resolution_score double, discoverability_rank int"


def tables(spark):
    candidates = spark.createDataFrame([("f.csv", "9", "1", "T1", "u1"), ("f.csv", "2", "", "T2", "u2"), ("f.csv", "3", None, "T3", "u3"), ("g.csv", "1", None, "T4", "u4"), (None, "1", None, "T5", "u5")], "source_file string, id string, original_id string, target_paper_title string, target_paper_url string")
    audit = spark.createDataFrame([("f.csv", i, 2025, f"S{i}", f"p{i}", f"T{i}", 2000, "q", 0.5, 3) for i in "123"] + [("g.csv", "1", 2024, "S1", "p4", "T4", 2001, "q4", 0.6, 4)], AUDIT)
    release = audit.withColumns({"venue": F.when(F.col("source_file") == "f.csv", "V").otherwise("W"), "experimental_split": F.when(F.col("source_file") == "f.csv", "test").otherwise("train"), "release_id": F.concat("source_file", "id")}).drop("source_file")
    fixes = spark.createDataFrame([("f.csv", "1", "A1", "wrong target", "n1", "New", 2020)], "source_file string, id string, audit_id string, reason string, paper_id string, title string, year int")
    out = spark.createDataFrame([("f.csv", "2", "A2", "no citation")], "source_file string, id string, audit_id string, reason string")
    return candidates, audit, release, fixes, out


def test_corrections_reach_three_tables(spark, tmp_path):
    candidates, audit, release, fixes, out = tables(spark)
    v = Versions(spark, str(tmp_path / "base"))
    v.commit({"candidates": candidates, "audit": audit, "release": release})
    for number in (2, 3):  # applied twice: the first originals stay
        assert corrections.apply_corrections(v, fixes, out, {"V": "f.csv"}) == number
        rows = {(r["source_file"], r["id"]): r for r in v.read("candidates").collect()}
        assert set(rows) == {("f.csv", "9"), ("f.csv", "3"), ("g.csv", "1"), (None, "1")}
        assert rows["f.csv", "9"]["target_paper_title"] == "New" and rows["f.csv", "9"]["target_paper_url"].endswith("n1") and rows["g.csv", "1"]["target_paper_title"] == "T4"
        rows = {(r["source_file"], r["id"]): r for r in v.read("audit").collect()}
        one = rows["f.csv", "1"]
        assert (one["resolved_paper_id"], one["resolved_year"], one["resolution_score"], one["resolution_method"]) == ("n1", 2020, None, "confirmed_manual_audit")
        assert (one["manual_correction"]["original_resolved_title"], one["manual_correction"]["original_resolution_score"], one["manual_correction"]["audit_id"]) == ("T1", 0.5, "A1")
        assert rows["f.csv", "2"]["manual_exclusion"]["release_status"] == "excluded_invalid_citation_context" and rows["f.csv", "3"]["manual_correction"] is None
        rows = {r["release_id"]: r for r in v.read("release").collect()}
        assert set(rows) == {"f.csv1", "f.csv3", "g.csv1"} and rows["f.csv1"]["resolved_title"] == "New" and rows["g.csv1"]["resolved_title"] == "T4"
    assert v.read("candidates", 1).count() == 5


def test_rows_that_an_equal_id_had_reached_are_restored(spark):
    _, audit, release, fixes, out = tables(spark)
    found = corrections.verdicts(fixes, out)
    wrong = corrections.corrected_release(release.withColumn("experimental_split", F.lit("test")), audit, found, {"V": "f.csv", "W": "f.csv"})
    wrong = wrong.withColumn("experimental_split", F.when(F.col("venue") == "W", "train").otherwise("test"))
    assert {r["release_id"]: r["resolved_title"] for r in wrong.collect()}["g.csv1"] == "New"
    back = {r["release_id"]: r for r in corrections.corrected_release(wrong, audit, found, {"V": "f.csv"}).collect()}
    assert (back["g.csv1"]["resolved_title"], back["g.csv1"]["resolution_score"], back["g.csv1"]["manual_correction"], back["g.csv1"]["resolution_method"]) == ("T4", 0.6, None, None)
    assert back["f.csv1"]["resolved_title"] == "New"
    with pytest.raises(Exception, match="no audit row to restore release row g.csv1"):
        corrections.corrected_release(wrong, audit.filter("source_file = 'f.csv'"), found, {"V": "f.csv"}).collect()


def test_first_wins_over_several_runs(spark, tmp_path, monkeypatch):
    """Three runs keep what one keeps; a run that fails between rows and keys doubles nothing."""
    files = [[("a", 1), ("b", 2), ("a", 3), (None, 4)], [("b", 5), ("c", 6), (None, 7), ("x", -1)], [("c", 8), ("d", 9), ("x", 10)]]
    schema = "k string, n int"
    curate = lambda df: df.filter("n > 0")
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if i == 1:
            monkeypatch.setattr(resume, "first_wins", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(Exception, match="lost"):
                resume.process_new_files(spark, src, schema, curate, out, state, keys=["k"], order=["n"]).awaitTermination()
            monkeypatch.setattr(resume, "first_wins", curation.first_wins)
            kept = spark.createDataFrame([("b", 5), ("c", 6)], schema)
            kept.write.parquet(f"{out}/batch=1")  # as a batch that failed after its write leaves it
            assert resume.committed(spark, out, state, kept.schema).count() == 3
        resume.process_new_files(spark, src, schema, curate, out, state, keys=["k"], order=["n"]).awaitTermination()
    whole = curation.first_wins(curate(spark.createDataFrame([r for f in files for r in f], schema)), ["k"], ["n"])
    want = sorted((r["k"] or "", r["n"]) for r in whole.collect())
    assert sorted((r["k"] or "", r["n"]) for r in resume.committed(spark, out, state, whole.schema).collect()) == want
    assert sorted((r["k"] or "", r["n"]) for r in spark.read.parquet(out).collect()) == want == [("", 4), ("a", 1), ("b", 2), ("c", 6), ("d", 9), ("x", 10)]
