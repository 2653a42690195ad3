"""Deterministic quotas and greedy samples.

The greedy ones are sequential by nature: each pick depends on the counts of those before. So each group is first cut
down to the rows that can be picked at all, whose number follows from the quota.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waterfill(capacity: DataFrame, total: int) -> DataFrame:
    """venue, target: raises the lowest initial counts first (ties by venue_idx) until the targets sum to `total`.

    capacity: venue, venue_idx, initial, capacity. With S(l) the places below level l that are free, all venues are raised to the
    highest level whose S still fits, and what is left goes to the first venues at it. S is linear between the venues' own
    counts, so it is known from one row for each such count.
    """
    bent = capacity.filter("capacity > initial").select(F.explode(F.array(F.struct(F.col("initial").cast("long").alias("level"), F.lit(1).alias("d")), F.struct(F.col("capacity").cast("long").alias("level"), F.lit(-1).alias("d")))).alias("e"))
    bent = bent.groupBy("e.level").agg(F.sum("e.d").alias("d"))  # one row for each distinct count, not for each venue or place
    w = Window.orderBy("level")
    slope = bent.withColumn("slope", F.sum("d").over(w)).withColumn("below", F.lag("slope").over(w) * (F.col("level") - F.lag("level").over(w)))
    steps = slope.withColumn("free", F.coalesce(F.sum("below").over(w), F.lit(0)))
    wanted = capacity.agg(F.coalesce(F.sum("initial"), F.lit(0)).alias("s")).first()["s"]
    left = total - wanted
    at = steps.filter(F.col("free") <= max(left, 0)).orderBy(F.desc("level")).first() if left > 0 else None
    if at is None:
        return capacity.select("venue", F.col("initial").cast("long").alias("target"))
    rise, rest = divmod(left - at["free"], at["slope"]) if at["slope"] else (0, 0)
    level = at["level"] + rise
    open_ = (F.col("initial") <= level) & (F.col("capacity") > level)
    one_more = capacity.filter(open_).orderBy("venue_idx").limit(int(rest)).select("venue", F.lit(1).alias("__more"))
    reached = F.greatest(F.col("initial"), F.least(F.col("capacity"), F.lit(level)))
    return capacity.join(one_more, "venue", "left").select("venue", (reached + F.coalesce("__more", F.lit(0))).cast("long").alias("target"))


def _slim(df: DataFrame, by: str, row_id: str, score: str, source: str, target: str) -> DataFrame:
    return df.select(F.col(by).alias("by"), F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.col(target).alias("target"), F.col(score).alias("score"))


def _first(df: DataFrame, keys: Sequence[str], most: int, *order: str) -> DataFrame:
    """The first rows of each key; Spark keeps that many in each task, so a hot key stays small."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= most).drop("__rn")


def _pickable(slim: DataFrame, quota: int) -> DataFrame:
    """The rows that `quota` greedy picks of a group can fall on: a number that follows the quota, not the group.

    At any time fewer than quota sources and targets have been used. A pick's rivals of its own (source, target) with a lower
    score are picked before it, so it is among the quota first of them. Of its source, rivals with a lower score and
    another target were passed over for a used target, so its target is among the source's quota first, and likewise its source among
    the target's. Where a group has quota sources or more, each pick has an unused one: it is the first of its pair, and rivals
    passed over lie in used sources or used targets, at most quota**2 rows each.

    All this holds for counters that do not start at zero if quota is at least the picks and the rows counted before together: so many
    sources and targets are used at most at any time, a rival of a pick's source is passed over only for a target that is used more, and a group
    of quota sources still has an unused one for each pick.
    """
    pairs = slim.groupBy("by", "source", "target").agg(F.min(F.struct("score", "row_id")).alias("least"))
    ordered = ["least"]
    of_source = _first(pairs, ["by", "source"], quota, *ordered).select("by", "source", "target")
    of_target = _first(pairs, ["by", "target"], quota, *ordered).select("by", "source", "target")
    kept = of_source.intersect(of_target)
    many = slim.select("by", "source").distinct().groupBy("by").agg((F.count("*") >= quota).alias("many"))
    rows = _first(slim, ["by", "source", "target"], quota, "score", "row_id")
    same = (F.col("r.by") == F.col("k.by")) & F.col("r.source").eqNullSafe(F.col("k.source")) & F.col("r.target").eqNullSafe(F.col("k.target"))
    rows = rows.alias("r").join(kept.alias("k"), same, "left_semi").join(many, "by")
    few = rows.filter("NOT many").drop("many")
    firsts = _first(_first(rows.filter("many").drop("many"), ["by", "source", "target"], 1, "score", "row_id"), ["by"], 2 * quota * quota + quota, "score", "row_id")
    return few.union(firsts)


def greedy_picks(rows: Sequence[tuple[str, str, str]], quota: int, sources: Counter | None = None, targets: Counter | None = None) -> list[int]:
    """Positions of `quota` rows (source, target, score): always the least used source, then target, then score.

    Keys only grow, so a heap whose top is refreshed when it is stale gives the exact minimum.
    """
    if len(rows) < quota:
        raise ValueError(f"{len(rows)} rows for a quota of {quota}")
    sources, targets = Counter(sources or {}), Counter(targets or {})
    heap = [(sources[s], targets[t], score, i) for i, (s, t, score) in enumerate(rows)]
    heapq.heapify(heap)
    picked: list[int] = []
    while len(picked) < quota:
        *key, i = heap[0]
        s, t, score = rows[i]
        if tuple(key) != (sources[s], targets[t], score):
            heapq.heapreplace(heap, (sources[s], targets[t], score, i))
            continue
        heapq.heappop(heap)
        sources[s] += 1
        targets[t] += 1
        picked.append(i)
    return picked


def diverse_sample(df: DataFrame, by: str, quota: int, row_id: str, score: str = "score", source: str = "source_key", target: str = "target_key") -> DataFrame:
    """by, row_id, pick (0, 1, ... in the order of selection) of `quota` rows for each group; a smaller group is an error.

    Only rows that can be picked at all meet in a task (see _pickable).
    """
    id_type = df.schema[row_id].dataType.simpleString()
    slim = _slim(df, by, row_id, score, source, target)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "row_id"], ignore_index=True)
        got = greedy_picks(list(zip(pdf["source"], pdf["target"], pdf["score"], strict=True)), quota)
        return pd.DataFrame({by: pdf["by"].iloc[got].to_numpy(), row_id: pdf["row_id"].iloc[got].to_numpy(), "pick": range(quota)})

    short = slim.groupBy("by").count().filter(F.col("count") < quota).first()
    if short:
        raise ValueError(f"{short['count']} rows for a quota of {quota}")
    return _pickable(slim, quota).groupBy("by").applyInPandas(pick, f"{by} {df.schema[by].dataType.simpleString()}, {row_id} {id_type}, pick int")


def fill_venue(existing: DataFrame, pool: DataFrame, targets: DataFrame, by: str, row_id: str, score: str = "score", source: str = "source_key", target: str = "target_key") -> DataFrame:
    """by, row_id, pick: the existing rows first, then greedy picks from the pool up to each group's target, counting the existing ones.

    Of the pool only rows that can be picked meet in a task (see _pickable), a number that follows the largest target.
    """
    id_type = pool.schema[row_id].dataType.simpleString()
    old = _slim(existing, by, row_id, score, source, target)
    wanted = targets.select(F.col("venue").alias("by"), F.col("target").alias("wanted"))
    most = targets.agg(F.max("target")).first()[0] or 0  # targets count the existing rows, so no group has more of both
    new = _pickable(_slim(pool, by, row_id, score, source, target).join(wanted, "by", "left_semi"), max(most, 1)).join(wanted, "by")

    def fill(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["score", "row_id"], ignore_index=True), b.sort_values(["score", "row_id"], ignore_index=True)
        need = max(int(b["wanted"].iloc[0]) - len(a), 0) if len(b) else 0
        got = greedy_picks(list(zip(b["source"], b["target"], b["score"], strict=True)), need, Counter(a["source"]), Counter(a["target"]))
        ids = [*a["row_id"], *b["row_id"].iloc[got]]
        name = a["by"].iloc[0] if len(a) else b["by"].iloc[0]
        return pd.DataFrame({by: [name] * len(ids), row_id: ids, "pick": range(len(ids))})

    return old.groupBy("by").cogroup(new.groupBy("by")).applyInPandas(fill, f"{by} string, {row_id} {id_type}, pick int")


def hold_out(df: DataFrame, by: str, n: int, row_id: str, score: str = "score", source: str = "source_key", target: str = "target_key") -> DataFrame:
    """by, row_id, split: for each group n rows as `validation`, rare sources and targets first and each used once while that lasts; the rest `train`.

    A group of n rows or fewer is an error. The choice is one expression over a bounded list for each group: a row that is
    chosen for its new source and target is the first of its pair, among the n first pairs of either, and rows passed over before it lie in
    at most n used sources or targets, so it is among the first 2 n n + n of those; what is then still wanted is among the first n + n rows.
    """
    slim = _slim(df, by, row_id, score, source, target)
    short = slim.groupBy("by").count().filter(F.col("count") <= n).first()
    if short:
        raise ValueError(f"{short['count']} rows cannot hold out {n}")
    sources, targets = (slim.groupBy("by", c).agg(F.count("*").alias(f"n_{c}")) for c in ("source", "target"))
    rows = slim.join(sources, ["by", "source"]).join(targets, ["by", "target"])
    rows = rows.withColumn("at", F.struct("n_source", "n_target", "score", "row_id")).select("by", "source", "target", "at")
    new = _first(rows, ["by", "source", "target"], 1, "at")
    new = _first(new, ["by", "source"], n, "at").intersect(_first(new, ["by", "target"], n, "at"))
    new = _first(new, ["by"], 2 * n * n + n, "at").groupBy("by").agg(F.sort_array(F.collect_list(F.struct("at", "source", "target"))).alias("new"))
    most = _first(rows, ["by"], 2 * n, "at").groupBy("by").agg(F.sort_array(F.collect_list("at")).alias("first"))

    def none_of(field: str) -> Column:
        return F.filter(F.transform("new", lambda r: r[field]), lambda _: F.lit(False)).alias(field)

    nothing = F.struct(*[none_of(c) for c in ("at", "source", "target")])

    def take(held: Column, r: Column) -> Column:
        fits = (F.size(held["at"]) < n) & ~F.coalesce(F.array_contains(held["source"], r["source"]), F.lit(False)) & ~F.coalesce(F.array_contains(held["target"], r["target"]), F.lit(False))
        return F.when(fits, F.struct(*[F.concat(held[c], F.array(r[c])).alias(c) for c in ("at", "source", "target")])).otherwise(held)

    chosen = new.join(most, "by").select("by", F.aggregate("new", nothing, take)["at"].alias("held"), "first")
    filled = F.concat("held", F.slice(F.array_except("first", "held"), F.lit(1), F.lit(n) - F.size("held")))
    picked = chosen.select("by", F.explode(filled).alias("at")).select("by", F.col("at.row_id").alias("row_id"), F.lit("validation").alias("__split"))
    return slim.select("by", "row_id").join(picked, ["by", "row_id"], "left").select(F.col("by").alias(by), F.col("row_id").alias(row_id), F.coalesce("__split", F.lit("train")).alias("split"))
