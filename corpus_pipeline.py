"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, documents with
benchmark passages go, the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, jaccard, toxicity
from marginalia.llm.common import dropped, staged, table
from marginalia.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that go to a Python worker at once while the pipeline runs: documents are long, and a worker and the JVM hold a batch each.
BATCH_ROWS = 1000


def bounded(stage: Stage) -> Stage:
    """The stage with Arrow batches of BATCH_ROWS rows in the session, unless it asks for smaller ones itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score below 0.5, learnt from the labels outside the held-out fifth.

    Null and empty texts and texts without words are scored like others (by the curve at zero) and stay. Rows are judged one
    by one, so repeated rows share their fate and order does not matter. An empty table gives an empty table; extra columns stay.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.without_toxic(docs, model)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component by 5-word shingles and a Jaccard similarity of 0.8 or more: the smallest doc_id.

    Rows without a doc_id, without text or without words link with nothing and stay. Of several rows with the doc_id that stays, one
    with words stays, the first by a hash of its columns. An empty table gives an empty table; extra columns stay.
    """
    return jaccard.near_distinct(docs, size=5, percent=80)


@bounded
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item.

    Null and empty texts, and all rows if the benchmark is empty or without words, stay. Rows are judged one by one, repeated
    rows alike. An empty table gives an empty table; extra columns stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the decoded ids give the text again.

    Null and empty texts have no ids and are their own decoding. A row for each row, repeated ones too; an empty table gives an
    empty table; columns beside these are left out.
    """
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path("byte_bpe_50k.json"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark), ("encoding", encode)]

#: SQL cannot express the first, third and fourth stage; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and reread; a stage's table goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
