"""Sharding by a Hilbert curve over several metadata dimensions.

Each dimension is quantised to a cell of a cube, cells are ordered along the curve, and the
ordered rows are cut into runs of equal length. Rows of a shard are close in every dimension,
so the minima and maxima of a shard's dimensions prune files for predicates on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, staged


@dataclass(frozen=True)
class Dimension:
    """A metadata column; numeric ones get bins of equal depth, others bins of as many neighbouring distinct values each."""

    column: str
    numeric: bool = False


def hilbert_index(coords: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of cells with len(coords) coordinates of `bits` bits each."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in coords]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each subcube
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0]) ^ swap
            x[i] = np.where(turned & (i == 0), x[0], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | (((c ^ flip) >> b) & 1)
    return out


def curve_column(cells: Sequence[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def curve(cell: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cell[c].to_numpy() for c in cell.columns], bits))

    return curve(F.struct(*[c.cast("long").alias(f"c{i}") for i, c in enumerate(cells)]))


def _below(edges: Column, value: Column) -> Column:
    return F.filter(edges, lambda e: e < value)


def value_cuts(df: DataFrame, column: str, n: int) -> list[str]:
    """At most n - 1 values that cut the sorted distinct values of a column into runs of about equal length; sorted as UTF-8 bytes."""
    values = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    ends = values.repartitionByRange(n, "v").groupBy(F.spark_partition_id()).agg(F.max("v").alias("v"))
    cuts = [r["v"] for r in ends.orderBy("v").collect()][:-1]  # a row for each range
    return cuts if len(cuts) < n else [cuts[len(cuts) * i // (n - 1)] for i in range(n - 1)]


def quantised(df: DataFrame, dims: Sequence[Dimension], bits: int) -> list[Column]:
    """One cell column per dimension, in the order of its values. Nulls: cell 0. Cut points come from all rows.

    A dimension with fewer cells than the cube has is spread over the whole side, so that it takes part in the curve's first turns.
    """
    n = 1 << bits
    numeric = [d.column for d in dims if d.numeric]
    cuts: dict[str, list] = {d.column: value_cuts(df, d.column, n) for d in dims if not d.numeric}
    if numeric:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / n for i in range(1, n)], 1000).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        cuts |= {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(numeric)}
    out = []
    for d in dims:
        kind = "double" if d.numeric else "string"
        edges = F.array(*[F.lit(float(e) if d.numeric else e) for e in cuts[d.column]]) if cuts[d.column] else F.array().cast(f"array<{kind}>")
        place = F.coalesce(F.size(_below(edges, F.col(d.column).cast(kind))), F.lit(0))
        out.append(F.floor(place * n / (len(cuts[d.column]) + 1)).cast("int"))
    return out


def hilbert_shards(df: DataFrame, dims: Sequence[Dimension], shards: int, ties: Sequence[str], bits: int = 5) -> DataFrame:
    """df with curve long, shard int and slot long: runs of the curve's order, equal to one row.

    Rows of one cell are ordered by `ties` (nulls first), so equal rows, hot cells and hot values
    are cut like any others. An empty table gives an empty table; null dimensions count as cell 0.
    Existing columns named curve, shard or slot are replaced; others may have any names.

    The rank is global without a global sort in one task: rows are dealt by ranges of (curve, ties),
    written with their place in their range, and the ranges' sizes (a row each) give the offsets.
    """
    keep = [c for c in df.columns if c.lower() not in ("curve", "shard", "slot")]
    src = df.select(*keep)
    mark = "_"
    while any(c.lower().startswith(mark) for c in keep):  # names that no column has
        mark += "_"
    at, place, before, total, count = (f"{mark}{x}" for x in ("range", "place", "before", "total", "count"))
    base = staged(src, "shard-input")
    placed = base.withColumn("curve", curve_column(quantised(base, dims, bits), bits))
    order = ["curve", *ties]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(placed.withColumns({at: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "shard-ranges")
    dropped(base)
    sizes = placed.groupBy(at).agg(F.count("*").alias(count))
    ahead = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(at, F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias(before), F.sum(count).over(every).alias(total))
    rank = F.col(before) + F.col(place)
    ranked = placed.join(F.broadcast(offsets), at).withColumn("shard", F.expr(f"int((({before} + {place}) * {shards}) div {total})"))
    first = F.expr(f"((bigint(shard) * {total}) + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", (rank - first).cast("long")).select(*keep, "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str, dims: Sequence[Dimension]) -> DataFrame:
    """Writes one folder per shard in slot order; returns the manifest: rows, minimum and maximum of each dimension.

    Nulls count in no minimum or maximum; a dimension without a value has null for both. An empty table gives an empty manifest.
    """
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    stats = [F.count("*").alias("n_rows")]
    for d in dims:
        stats += [F.min(d.column).alias(f"min_{d.column}"), F.max(d.column).alias(f"max_{d.column}")]
    return sharded.groupBy("shard").agg(*stats)


def shards_to_read(manifest: DataFrame, column: str, low, high) -> DataFrame:
    """Shards of a manifest that can hold a row with low <= column <= high; a shard without a value of the column holds none, nulls match nothing."""
    return manifest.filter((F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high))).select("shard")


def op1_hilbert_sharding(documents: DataFrame) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`. Null text: size 1, checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source")
    dims = [Dimension("source"), Dimension("lang"), Dimension("size", numeric=True)]
    out = hilbert_shards(slim, dims, 8, ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
