"""Two tables rewritten as co-bucketed sorted files, one for each table and bucket, by a distributed sorted-key index.

1. Both tables are written as numbered files, each sorted, as they may have come.
2. The index: the left table's distinct keys with their counts, as sorted arrays of at most INDEX_ROWS keys, stored as files by bucket.
3. The right table is dealt by the bucket of its key and sorted together with the index's arrays, so a row stands behind the array that
   holds its key if any does: batches probe the array at hand by binary search. Rows without a match are orphans, rows without a key are
   apart; neither needs a row of the left table.
4. Files that already hold just a bucket's rows stay; the others' rows are written anew, and the old files go.
5. What a file holds is read back from the files: keys with counts, sorted, go by in a stream that is hashed and, for the right table,
   probes the index again for the rows of a join.

Between steps only counts by file and bucket reach the driver: at most (buckets + 2) rows for a table. A bucket's file is written by one
task, which sorts with spills and streams; the bucket's keys are counted before they are shuffled, so a frequent key is one row there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_folder
from .common import freeing, fresh

#: Keys in one array of the index at most, and repeats of a key that are hashed at once.
INDEX_ROWS, REPEATS = 50_000, 65_536
#: A sorted array of the index: ids and counts are 64-bit integers one after the other, as binary columns cost rows that have none nothing.
INDEX = "bucket int, first long, ids binary, counts binary"


@dataclass
class Files:
    """A folder's numbered files of one table: number to path."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def under(self, folder: str) -> list[str]:
        """Names in a folder, none if it is not there."""
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not become {target}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def sorted_files(df: DataFrame, number: Column, files: Files, name: str) -> dict[int, str]:
    """One file `name`-number.parquet for each number that has rows, sorted by all columns from left to right, nulls first. Paths by number."""
    columns = df.columns
    at = fresh("number", columns)
    dealt = df.withColumn(at, number.cast("int")).repartition(at)
    return _written(dealt.sortWithinPartitions(at, *(F.asc_nulls_first(F.col(f"`{c}`")) for c in columns)), at, files, name)


def _written(dealt: DataFrame, at: str, files: Files, name: str) -> dict[int, str]:
    """The files of rows that are sorted by the column `at` first, if each of its values lies in one partition; else parts remain and are merged."""
    work = f"{files.folder}-{uuid.uuid4().hex}"
    dealt.write.option("maxRecordsPerFile", 0).partitionBy(at).parquet(work)
    out = {}
    schema = dealt.drop(at).schema
    files.fs.mkdirs(files.path(files.folder))
    for part in sorted(d for d in files.under(work) if d.startswith(f"{at}=")):
        number, target = int(part.rpartition("=")[2]), f"{files.folder}/{name}-{int(part.rpartition('=')[2]):05d}.parquet"
        found = [f for f in files.under(f"{work}/{part}") if f.endswith(".parquet")]
        if len(found) > 1:  # from several tasks: one task merges them
            whole = files.spark.read.schema(schema).parquet(*(f"{work}/{part}/{f}" for f in found)).repartition(1)
            whole.sortWithinPartitions(*(F.asc_nulls_first(F.col(f"`{c}`")) for c in whole.columns)).write.option("maxRecordsPerFile", 0).parquet(f"{work}/merged-{number}")
            part = f"merged-{number}"
            found = [f for f in files.under(f"{work}/{part}") if f.endswith(".parquet")]
        files.move(f"{work}/{part}/{found[0]}", target)
        out[number] = target
    files.delete(work)
    return out


def read(files: Files, paths: list[str], like: DataFrame) -> DataFrame:
    return files.spark.read.schema(like.schema).parquet(*paths) if paths else files.spark.createDataFrame([], like.schema)


def sorted_keys(rows: DataFrame) -> DataFrame:
    """The index of rows (bucket, k, n) with distinct k: bucket, first (the smallest key), ids and counts of each sorted array. Rows without a key have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
        held: list[pa.RecordBatch] = []

        def arrays() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            bucket, ids, counts = (whole.column(i).to_numpy() for i in range(3))
            cuts = np.nonzero((np.diff(bucket, prepend=-1) != 0) | (np.arange(len(ids)) % INDEX_ROWS == 0))[0].tolist()
            spans = list(zip(cuts, [*cuts[1:], len(ids)], strict=True))
            return pa.RecordBatch.from_pylist([{"bucket": bucket[a], "first": ids[a], "ids": ids[a:z].tobytes(), "counts": counts[a:z].tobytes()} for a, z in spans], schema=schema)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= INDEX_ROWS:
                yield arrays()
                held = []
        if held:
            yield arrays()

    dealt = rows.filter("k IS NOT NULL").select("bucket", "k", "n").repartition("bucket").sortWithinPartitions("bucket", "k")
    return dealt.mapInArrow(freeing(run), INDEX)


def behind_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (bucket, k, ...) and the index's arrays, dealt by bucket and sorted so that an array comes right before the rows that may be in it."""
    rest = [f for f in rows.schema.fields if f.name not in ("bucket", "k")]
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "counts")]
    both = rows.select("bucket", "k", F.lit(1).alias("kind"), *none, *(f.name for f in rest)).unionByName(
        index.select("bucket", F.col("first").alias("k"), F.lit(0).alias("kind"), "ids", "counts", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rest))
    )
    return both.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("k"), "kind")


class Probe:
    """The array of the index at hand, and what keys find in it."""

    def __init__(self) -> None:
        self.bucket, self.ids, self.counts = -1, np.empty(0, np.int64), np.empty(0, np.int64)

    def counted(self, batch: pa.RecordBatch) -> np.ndarray:
        """For each row of a batch of `behind_index`: how often the index has its key; 0 for the index's own rows."""
        bucket, kind = (batch.column(i).to_numpy() for i in (0, 2))
        keys = pc.fill_null(batch.column(1), 0).to_numpy()
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(keys), np.int64)
        arrays = np.nonzero(kind == 0)[0].tolist()
        for a, z in zip([-1, *arrays], [*arrays, len(keys)], strict=True):
            if a >= 0:
                self.bucket, self.ids, self.counts = int(bucket[a]), *(np.frombuffer(batch.column(i)[a].as_py(), np.int64) for i in (3, 4))
            own = slice(a + 1, z)
            if len(self.ids) and a + 1 < z:
                at = np.minimum(np.searchsorted(self.ids, keys[own]), len(self.ids) - 1)
                out[own] = np.where((self.ids[at] == keys[own]) & (bucket[own] == self.bucket) & known[own], self.counts[at], 0)
        return out


def _final(rows: DataFrame, index: DataFrame, buckets: int, names: list[str], at: str) -> DataFrame:
    """The columns c0, c1, ... of right rows under their names, and as `at` their final bucket: `buckets` for orphans, one more without a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe()
        for batch in batches:
            found = probe.counted(batch)
            home = batch.column(0).to_numpy()
            kept = batch.filter(pa.array(batch.column(2).to_numpy() == 1))
            to = np.where((found > 0) | (home > buckets), home, buckets)[batch.column(2).to_numpy() == 1]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *kept.columns[5:]], names=["final", *kept.schema.names[5:]])

    stream = behind_index(rows, index)
    fields = stream.schema.fields[5:]
    placed = stream.mapInArrow(freeing(run), stream.select(F.lit(0).alias("final"), *(f.name for f in fields)).schema)
    return placed.select(F.col("final").alias(at), *(F.col(f.name).alias(n) for f, n in zip(fields, names, strict=True)))


def digests(rows: DataFrame, index: DataFrame) -> DataFrame:
    """bucket, ids_sha256, n_rows and n_joined of rows (bucket, k, n) with distinct k: keys repeated n times, ascending, nulls (empty) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("ids_sha256", pa.string()), ("n_rows", pa.int64()), ("n_joined", pa.int64())])
        probe, now, sha, n_rows, n_joined = Probe(), None, hashlib.sha256(), 0, 0
        for batch in batches:
            found = probe.counted(batch)
            use = np.nonzero(batch.column(2).to_numpy() == 1)[0]
            bucket, n = batch.column(0).to_numpy()[use], batch.column(5).take(pa.array(use)).to_numpy()
            keys = [b"," if k is None else b",%d" % k for k in batch.column(1).take(pa.array(use)).to_pylist()]
            joined = found[use] * n
            cuts = np.nonzero(np.diff(bucket, prepend=-1))[0].tolist()
            for a, z in zip(cuts, [*cuts[1:], len(use)], strict=True):
                if now != bucket[a]:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([{"bucket": now, "ids_sha256": sha.hexdigest(), "n_rows": n_rows, "n_joined": n_joined}], schema=schema)
                    now, sha, n_rows, n_joined = int(bucket[a]), hashlib.sha256(), 0, 0
                for k, many in zip(keys[a:z], n[a:z].tolist(), strict=True):
                    if not n_rows:  # no comma before the first
                        sha.update(k[1:])
                        n_rows, many = 1, many - 1
                    for _ in range(many // REPEATS):
                        sha.update(k * REPEATS)
                    sha.update(k * (many % REPEATS))
                    n_rows += many
                n_joined += int(joined[a:z].sum())
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"bucket": now, "ids_sha256": sha.hexdigest(), "n_rows": n_rows, "n_joined": n_joined}], schema=schema)

    return behind_index(rows, index).mapInArrow(freeing(run), "bucket int, ids_sha256 string, n_rows long, n_joined long")


def lineages(rows: DataFrame) -> list:
    """By bucket of rows (bucket, start, n): sha256 of its starting files with their counts, and the file that holds just its rows (null: none)."""
    pairs = rows.groupBy("bucket", "start").agg(F.sum("n").alias("n"))
    spread = pairs.groupBy("start").agg(F.count("*").alias("n_buckets"))
    listed = pairs.join(spread, "start").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("start", "n", "n_buckets"))).alias("all"))  # as many as starting files at most
    text = F.array_join(F.transform("all", lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    alone = (F.size("all") == 1) & (F.col("all")[0]["n_buckets"] == 1)
    return listed.select("bucket", F.sha2(text, 256).alias("lineage_sha256"), F.when(alone, F.col("all")[0]["start"]).alias("stays")).collect()


RESULT = pa.schema([("table_name", pa.string()), ("path", pa.string()), ("columns", pa.string()), ("ids_sha256", pa.string()), ("lineage_sha256", pa.string()), ("bucket", pa.int64()), ("n_rows", pa.int64()), ("n_joined", pa.int64()), ("rewritten", pa.bool_())])


def co_bucketed(left: tuple[str, DataFrame, Column], right: tuple[str, DataFrame, Column], key: str, bucket: Column, buckets: int, folder: str) -> DataFrame:
    """Writes (name, table, number of a row's starting file) twice below folder and returns a row for each final file; see RESULT.

    bucket is a row's bucket by its key (from 0 to buckets - 1). Rows of the right table whose key the left one has not are in bucket
    `buckets`, rows without a key of either table in the one after it. Files have the table's columns in order and are sorted by all of
    them, nulls first; key must be the first column. Repeated rows are kept; an empty table has no files; other columns may have any names.
    """
    spark = left[1].sparkSession
    home = F.when(F.col(key).isNull(), buckets + 1).otherwise(bucket).cast("int")
    tables, starts = [], []
    for name, df, number in (left, right):
        if df.columns[0].lower() != key.lower():
            raise ValueError(f"{key} is not the first column of {name}")
        files = Files(spark, f"{folder.rstrip('/')}/{name}")
        tables.append(files)
        starts.append(sorted_files(df, number, files, "start"))
    first, second = (read(files, list(s.values()), t[1]) for files, s, t in zip(tables, starts, (left, right), strict=True))

    work = f"{folder.rstrip('/')}-index-{uuid.uuid4().hex}"
    sorted_keys(first.groupBy(F.col(key).alias("k"), home.alias("bucket")).agg(F.count("*").alias("n"))).write.parquet(work)
    index = spark.read.schema(INDEX).parquet(work)

    # left: a file stays or its rows move, as counts by file and bucket tell
    lineage = [lineages(first.groupBy(home.alias("bucket"), left[2].cast("int").alias("start")).agg(F.count("*").alias("n")))]
    stay = {r["stays"] for r in lineage[0]}
    moving = read(tables[0], [p for s, p in starts[0].items() if s not in stay], left[1])
    final = [sorted_files(moving, home, tables[0], "bucket")]

    # right: final buckets come from probing the index
    names = right[1].columns
    at = fresh("number", names)
    rows = second.select(home.alias("bucket"), F.col(key).cast("long").alias("k"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    placed = _final(rows, index, buckets, names, at).sortWithinPartitions(at, *(F.asc_nulls_first(F.col(f"`{c}`")) for c in names))
    final.append(_written(placed, at, tables[1], "bucket"))
    written = read(tables[1], list(final[1].values()), right[1])
    number = F.regexp_extract("file", r"-(\d+)\.parquet$", 1).cast("int")
    lineage.append(lineages(written.groupBy(F.col("_metadata.file_name").alias("file"), right[2].cast("int").alias("start")).agg(F.count("*").alias("n")).withColumn("bucket", number)) if final[1] else [])

    out: list[dict] = []
    joined: dict[int, int] = {}
    for side in (1, 0):
        files, name, df = tables[side], (left, right)[side][0], (left, right)[side][1]
        stays = {r["bucket"]: r["stays"] for r in lineage[side] if r["stays"] is not None}
        for b, s in stays.items():  # the same rows: the file that was there is kept
            if b in final[side]:
                files.delete(final[side][b])
            final[side][b] = starts[side][s]
        for s, path in starts[side].items():
            if s not in stays.values():
                files.delete(path)
        if not final[side]:
            continue
        back = {s: b for b, s in stays.items()}
        of_start = F.array(*(F.lit(back.get(s)) for s in range(max(back, default=0) + 1))).cast("array<int>")
        home_of = F.when(F.col("file").startswith("start-"), F.get(of_start, number)).otherwise(number)
        keys = read(files, list(final[side].values()), df).groupBy(F.col("_metadata.file_name").alias("file"), F.col(key).cast("long").alias("k")).agg(F.count("*").alias("n"))
        got = {r["bucket"]: r for r in digests(keys.select(home_of.alias("bucket"), "k", "n"), index).collect()}
        if side:
            joined = {b: r["n_joined"] for b, r in got.items()}
        lines = {r["bucket"]: r["lineage_sha256"] for r in lineage[side]}
        for b, path in sorted(final[side].items()):
            out.append({"table_name": name, "path": path, "columns": ",".join(df.columns), "ids_sha256": got[b]["ids_sha256"], "lineage_sha256": lines[b], "bucket": b, "n_rows": got[b]["n_rows"], "n_joined": joined.get(b, 0), "rewritten": b not in stays})
    for files in tables:  # as the checksums beside moved files name them
        for f in files.under(files.folder):
            if not f.endswith((".parquet", ".crc")):
                files.delete(f"{files.folder}/{f}")
    tables[0].delete(work)
    return spark.createDataFrame(pa.Table.from_pylist(out, schema=RESULT))


BUCKETS = 300


def op12_co_buckets(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """sales and sale_lines in a new folder below spark.checkpoint.dir, co-bucketed by sale_id; a row for each final file.

    Buckets are crc32 of `line` and the decimal sale_id, modulo BUCKETS. Null keys, repeated rows and empty tables: see `co_bucketed`.
    """
    spark = sales.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/marginalia/cobuckets-{uuid.uuid4().hex}"
    crc = lambda text: F.crc32(text.cast("binary")) % BUCKETS
    bucket = crc(F.concat(F.lit("line"), F.col("sale_id").cast("string")))
    home = F.coalesce(bucket, F.lit(BUCKETS + 1))
    start = home - F.when(home % 3 == 1, 1).otherwise(0)
    item = F.coalesce(crc(F.col("item_id").cast("string")), F.lit(0))
    return co_bucketed(("sales", sales, start), ("sale_lines", lines, item), "sale_id", bucket, BUCKETS, folder)
