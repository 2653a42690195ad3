"""Sinks: CSV, JSON lines, id lists, nested parquet. A sink writes a new directory; inputs are never overwritten."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma, minimal quotes, quotes doubled, read back by sources.files.csv as written."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def with_sorted_keys(x: Column, kind: DataType) -> Column:
    """A struct with its fields in the order of their names, at every depth."""
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[with_sorted_keys(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(x, lambda e: with_sorted_keys(e, kind.elementType))
    return x


def ascii_escaped(x: Column) -> Column:
    """JSON text with what is not ASCII as \\uXXXX, beyond the basic plane as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def char(c: Column) -> Column:
        n = F.ascii(c)
        rest = n - 0x10000
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(rest, 10)), unit(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(pair)

    return F.when(F.rlike(x, F.lit(r"^[\x00-\x7f]*$")), x).otherwise(F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), char), ""))


def json_lines(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    """value: one JSON object for each row with sorted keys at every depth and nulls kept; ASCII only if asked for."""
    row = F.to_json(F.struct(*[with_sorted_keys(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})
    return df.select((ascii_escaped(row) if ascii_only else row).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", ascii_only: bool = False) -> None:
    json_lines(df, ascii_only).write.mode(mode).text(path)


def write_split(df: DataFrame, split: str, order: list[str], start: int, path: str | None = None) -> DataFrame:
    """df with ids from `start` by order, split, and the former id as original_id."""
    from ..operators.curation import numbered

    out = numbered(df.withColumnRenamed("id", "original_id"), order, start).withColumn("split", F.lit(split))
    if path:
        write_csv(out, path)
    return out


def write_ids(records: DataFrame, path: str, split: str = "experimental_split", row_id: str = "release_id") -> None:
    records.filter(F.col(split).isNotNull()).select(row_id, split).repartition(split).sortWithinPartitions(split, row_id).write.partitionBy(split).text(path)


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def report(df: DataFrame) -> DataFrame:
    """A one-row table as JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


class OutputError(RuntimeError):
    """Outputs that do not belong to this run."""


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def deleted(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, found = _path(spark, path)
        fs.delete(found, True)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    fs, found = _path(spark, old)
    if not fs.rename(found, _path(spark, new)[1]):
        raise OutputError(f"{old} cannot be renamed to {new}")


def fresh_outputs(spark: SparkSession, outputs: Sequence[str], state: str, restart: bool = False) -> None:
    """Before a run: a restart deletes outputs and state; outputs without a state are an error, as nobody knows what they hold."""
    if restart:
        deleted(spark, *outputs, state)
    elif not exists(spark, state) and (orphans := [p for p in outputs if exists(spark, p)]):
        raise OutputError(f"outputs without a state: {', '.join(orphans)}; restart, or choose other paths")


def replaced(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> str:
    """Rewrites what stands at path, which df may read: written beside it, then put in its place. The first version stays as a backup, whose path comes back.

    The version before is deleted only when the new one stands; after a crash in between, `recovered` or the next call puts it back. Several
    tables that must change together are versions, see sources.versions.
    """
    spark, new, old, backup = df.sparkSession, f"{path}.new", f"{path}.old", f"{path}.backup"
    deleted(spark, new)
    write(df, new)
    recovered(spark, path)
    if exists(spark, path):
        renamed(spark, path, old if exists(spark, backup) else backup)
    renamed(spark, new, path)
    deleted(spark, old)
    return backup


def recovered(spark: SparkSession, path: str) -> bool:
    """Puts the last version back where a crash has left nothing at path; whether it did."""
    if exists(spark, path):
        return False
    for kept in (f"{path}.old", f"{path}.backup"):
        if exists(spark, kept):
            renamed(spark, kept, path)
            return True
    return False
