"""Incremental curation: new source files pass once, results and the record of what is done are committed together.

Structured Streaming's checkpoint takes the place of a state file: a batch that failed is run again as the same batch, and
its output directory is overwritten, so nothing is doubled or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.curation import digest, first_wins
from ..sources.sinks import _path, exists


def process_new_files(
    spark: SparkSession, folder: str, schema: str, curate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100, keys: Sequence[str] = (), order: Sequence[str] = ()
) -> StreamingQuery:
    """Runs curate over all parquet files of the folder that no earlier run has committed, then stops.

    With keys, of all rows that curate keeps, in all runs, the first of each key stays: within a batch by `order`, an earlier batch's row before
    a later one's. The digests of kept keys are a table beside the output, written batch by batch after it; a batch that is run again
    overwrites its rows and its keys and looks only at those of batches before it, so a failure between the two doubles and loses nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = curate(batch)
        if not keys:
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return
        key = digest(*[F.col(k) for k in keys])
        first = first_wins(rows, keys, order)
        if batch_id:
            seen = batch.sparkSession.read.schema("key string, batch long").parquet(f"{out}.keys").filter(F.col("batch") < batch_id).select(F.col("key").alias("__seen"))
            first = first.join(seen, key == F.col("__seen"), "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept = batch.sparkSession.read.schema(first.schema).parquet(f"{out}/batch={batch_id}")
        kept.select(key.alias("key")).write.mode("overwrite").parquet(f"{out}.keys/batch={batch_id}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, out: str, checkpoint: str, schema: StructType) -> DataFrame:
    """The rows of committed batches only: what a failed batch has left behind is not read."""
    fs, path = _path(spark, f"{checkpoint}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    folders = [f"{out}/batch={n}" for n in names if n.isdigit()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def memoised(df: DataFrame, key: str, call: Callable[[DataFrame], DataFrame], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df joined with the answers, all answers): each distinct key that is not known is asked once."""
    wanted = df.select(key).filter(F.col(key).isNotNull()).distinct()
    if known is not None:
        wanted = wanted.join(known.select(key), key, "left_anti")
    answers = call(wanted)
    if known is not None:
        answers = answers.unionByName(known)
    return df.join(answers, key, "left"), answers


class ResumeError(ValueError):
    """A state that another run has written, or whose outputs are gone."""


STATE = "starting_id long, split string, citation_mode string, citation_style string, fields_of_study string"


def resumed(spark: SparkSession, state: str, parameters: dict, outputs: dict[str, str] | None = None) -> bool:
    """Whether a state stands at the path already; if none does, one with the run's parameters (see STATE) is written.

    Parameters that differ from the state's are an error, and so is an output (name: path) that an earlier run has written to and that is gone.
    """
    names = [f.split()[0] for f in STATE.split(", ")]
    if unknown := set(parameters) ^ set(names):
        raise ResumeError(f"parameters missing or unknown: {', '.join(sorted(unknown))}")
    if not exists(spark, state):
        spark.createDataFrame([Row(**{n: parameters[n] for n in names})], STATE).coalesce(1).write.json(state, ignoreNullFields=False)
        return False
    had = spark.read.schema(STATE).json(state).first()
    if other := [f"{n}={had[n]} (expected {parameters[n]})" for n in names if had[n] != parameters[n]]:
        raise ResumeError(f"the state at {state} does not fit this run: {', '.join(other)}")
    if gone := [p for p in (outputs or {}).values() if not exists(spark, p)]:
        raise ResumeError(f"the state at {state} expects outputs that are gone: {', '.join(gone)}")
    return True
