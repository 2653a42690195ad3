"""Small tests of the findings of round 4."""

import hashlib
from pathlib import Path

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from marginalia.operators import release

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark):
    """A session whose joins go by shuffle, as those of large tables do."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(held, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def shuffle_bytes(spark, df) -> int:
    """Bytes of shuffle files that running df writes."""
    spark.sparkContext.setJobGroup("shuffle_bytes", "")
    df.write.format("noop").mode("overwrite").save()
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("shuffle_bytes") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def test_reconstruction_shuffles_a_text_once(shuffled):
    """The registered query sends each sentence and each digest through one shuffle, keeps no copy of the sentences and writes less than thrice the texts' bytes."""
    texts = shuffled.read.parquet(f"{DATA}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    kept = lambda: {*Path(shuffled.conf.get("spark.checkpoint.dir")).rglob("*.parquet")}
    before = kept()
    df = entry.queries()["reconstruct_verify"](shuffled, DATA)
    written = shuffle_bytes(shuffled, df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Sort [") == 1 and "Join" not in plan
    assert 0 < written < 3 * texts and kept() == before


def test_reconstruction_of_odd_records(shuffled):
    """Digests that are none, in upper case or null, an id that is a URL, and papers whose records ask by index and by digest at once."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sentences = [("u", 0, "A [1]."), ("u", 1, "B  [2]."), ("u", 2, "B [2]."), ("u", 3, None), ("w", 0, "A [1]."), (None, 0, "A [1].")]
    rows = [
        ("index", "u", 1, sha("B [2]."), "[2]"), ("digest", "u", None, sha("A [1]."), "[1]"), ("digest", "u", None, sha("A [1]."), "[1]"), ("other", "w", None, sha("B [2]."), "[2]"), ("twice", "u", None, sha("B [2]."), "[2]"),
        ("upper", "u", None, sha("A [1].").upper(), "[1]"), ("line", "u", 0, sha("A [1].") + "\n", "[1]"), ("none", "u", None, None, "[1]"), ("empty", "w", 0, "", "[1]"), ("null", "u", 3, sha("A [1]."), "[1]"), ("0", "u", None, "0", "[1]"), ("u", None, 0, sha("A [1]."), "[1]"), (None, "v", None, sha("A [1]."), "[1]"),
    ]
    records = shuffled.createDataFrame(rows, "id string, source_paper_url string, locator_index bigint, passage_sha256 string, citation_marker string")
    got = release.reconstruct(records, shuffled.createDataFrame(sentences, "source_paper_url string, body_sentence_index int, sentence string"))
    ok = lambda i, t: (i, "ok", t, None)
    no = lambda i, e: (i, "error", None, e)
    found = "expected one matching sentence, found "
    want = [
        ok("index", "B [CITATION]."), ok("digest", "A [CITATION]."), ok("digest", "A [CITATION]."), no("other", found + "0"), no("twice", found + "2"), no("upper", found + "0"), no("line", "passage digest mismatch"), no("none", found + "0"), no("empty", "passage digest mismatch"),
        no("null", "sentence index out of range"), no("0", found + "0"), no("u", "missing source URL"), no(None, "source text unavailable"),
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
