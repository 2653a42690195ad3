"""Titles that are alike by difflib's ratio, as a join of two tables.

The ratio is 2 M / (a + b) for M matched characters of titles of a and b characters, and the matched ones stand in the same order in
both. So a pair that reaches a threshold t

- has lengths whose quotient is at least t / (2 - t),
- shares M >= t (a + b) / 2 characters as multisets,
- differs by d <= (1 - t)(a + b) insertions and deletions, each of which destroys at most q runs of q characters: at least
  max(a, b) - q + 1 - q d of them are shared.

The second and third are overlaps of sets (a run and how often it came before), so of each set only the rarest members need to be
join keys: enough that whatever is left out of both cannot make up the overlap alone. Bands of lengths are part of the key. Candidates are
then bounded by their multisets of characters, and what remains is compared by difflib itself, first title first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, sequence_ratio

#: Added before a bound is rounded down, so that rounding never makes a set of keys too small.
SLACK = 1e-9


def run_length(threshold: float) -> tuple[int, float]:
    """(characters in a run, shortest longer title of a pair for which a shared run is certain); infinite if runs say nothing at this threshold."""
    for q in (3, 2):
        rate = 1 - 2 * q * (1 - threshold)
        if rate >= 0.15:
            return q, q / rate
    return 2, math.inf


def _members(titles: DataFrame, on: Sequence[str], q: int) -> DataFrame:
    """on, t, part: each title's runs of q characters with the number of equal ones up to it, so that multisets are sets."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length("t") - q + 1), lambda i: F.substring(F.col("t"), i, F.lit(q)))
    each = titles.filter(F.char_length("t") >= q).select(*on, "t", F.explode(runs).alias("run")).groupBy(*on, "t", "run").agg(F.count("*").cast("int").alias("n"))
    return each.select(*on, "t", "run", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(*on, "t", F.concat_ws("\u0001", "run", F.col("i").cast("string")).alias("part"))


def _rarest(sides: tuple[DataFrame, DataFrame], on: Sequence[str], q: int, share: float, most: float) -> list[DataFrame]:
    """on, t, part of both sides: of titles of up to `most` characters the rarest share of their members and one more, in one order for both sides."""
    parts = [_members(s.filter(F.char_length("t") <= most) if most < math.inf else s, on, q) for s in sides]
    seen = parts[0].select("part").unionAll(parts[1].select("part")).groupBy("part").agg(F.count("*").alias("df"))
    w = Window.partitionBy(*on, "t").orderBy("df", "part")  # as many rows as a title has characters
    return [p.join(seen, "part").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= F.floor(share * F.char_length("t") + SLACK) + 1).drop("place", "df") for p in parts]


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8, strict: bool = True, on: Sequence[str] = ()) -> DataFrame:
    """on, left_title, right_title, ratio: distinct lower-cased pairs whose ratio, the left title first, is above (strict) or at least the threshold.

    Both tables have a column `title` and the columns `on`, whose values must be equal (nulls are equal to nothing). Equal titles meet once
    however often they are repeated; null titles meet nothing, empty ones each other. The threshold is over 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not in (0, 1]")
    sides = tuple(s.filter(F.col("title").isNotNull()).select(*on, F.lower("title").alias("t")).distinct() for s in (left, right))
    q, least = run_length(threshold)
    step = math.log(max(2 / threshold - 1, 1.05))  # titles of a pair lie in one band of lengths or in neighbouring ones
    band = F.floor(F.log(F.char_length("t").cast("double")) / step).cast("int")
    kinds = [(1, 1 - threshold / (2 - threshold), least)] + ([(q, 2 * q * (1 - threshold), math.inf)] if least < math.inf else [])
    found = None
    for size, share, most in kinds:
        a, b = (p.withColumn("band", band) for p in _rarest(sides, on, size, share, most))
        near = b.withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
        pairs = a.withColumnRenamed("t", "left_title").join(near.withColumnRenamed("t", "right_title"), [*on, "band", "part"]).select(*on, "left_title", "right_title")
        found = pairs if found is None else found.unionByName(pairs)
    found = found.filter(may_reach(F.col("left_title"), F.col("right_title"), threshold)).distinct()
    # the multisets of characters bound what is left
    letters = [_members(s, on, 1).groupBy(*on, "t").agg(F.collect_set("part").alias(f"{side}_parts")).withColumnRenamed("t", f"{side}_title") for s, side in zip(sides, ("left", "right"), strict=True)]
    for parts, side in zip(letters, ("left", "right"), strict=True):
        found = found.join(parts, [*on, f"{side}_title"])
    total = F.char_length("left_title") + F.char_length("right_title")
    found = found.filter(2.0 * F.size(F.array_intersect("left_parts", "right_parts")) >= threshold * total - SLACK)
    scored = found.select(*on, "left_title", "right_title", sequence_ratio("left_title", "right_title").alias("ratio"))
    scored = scored.filter(F.col("ratio") > threshold if strict else F.col("ratio") >= threshold)
    empty = [s.filter("t = ''").select(*on, F.col("t").alias(f"{side}_title")) for s, side in zip(sides, ("left", "right"), strict=True)]
    both = empty[0].join(empty[1], list(on)) if on else empty[0].join(empty[1], F.col("left_title") == F.col("right_title"))
    return scored.unionByName(both.filter(F.lit(1.0) > threshold if strict else F.lit(True)).select(*on, "left_title", "right_title", F.lit(1.0).alias("ratio")))


def without_similar_titles(rows: DataFrame, skip: DataFrame, threshold: float = 0.9, on: Sequence[str] = ()) -> DataFrame:
    """Rows whose `title` has a ratio above the threshold with no title of `skip` (among those of the same `on`). Rows with null titles or null `on` stay."""
    hits = similar_pairs(rows.select(*on, "title"), skip.select(*on, "title"), threshold, on=on).select(*on, F.col("left_title").alias("hit_title")).distinct()
    same = F.lower(rows["title"]) == hits["hit_title"]
    for c in on:
        same &= rows[c] == hits[c]
    return rows.join(hits, same, "left_anti")
