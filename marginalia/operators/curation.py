"""First-wins deduplication, gates with one reason, leakage exclusion and the counts over them.

Order is always a column: first and last mean by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

KEYS = ("excerpt_key", "source_key", "target_key")
#: Characters of a table's texts that go to all executors at most; a larger one is joined by a shuffle.
BROADCAST_CHARS = 32_000_000


def digest(*keys: Column) -> Column:
    """What stands for keys of any length in shuffles and sorts; equal for equal keys, nulls included."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]), 256)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever its case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`; null keys are keys. One shuffle by the keys' digest; a row for each key and task goes through it."""
    key, place = unused(df, "__key"), unused(df, "__rn")
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(key, digest(*[F.col(k) for k in keys])).withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place, key)


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, as a dictionary keeps it; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(*keys, "_s.*")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    distinct = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return distinct.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"), (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("n_removed"))


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])


def candidate_gate(df: DataFrame, required: Sequence[str], year: str, wanted_year: int, excerpt: str, row_id: str, order: str) -> DataFrame:
    """df with `reason`: missing value, then repeated id among rows that miss none, bad year, wrong year, not one marker; null for good rows.

    `order` tells rows apart. The first row of an id is a minimum, combined before the shuffle, and rows that miss a value have none,
    so neither they nor a hot id meet in one task's window.
    """
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    marked = df.withColumn("__missing", missing)
    first = marked.filter(~F.col("__missing")).groupBy(F.col(row_id).alias("__id")).agg(F.min(order).alias("__first"))
    marked = marked.join(written(first, "gate-first"), ~F.col("__missing") & F.col(row_id).eqNullSafe(F.col("__id")), "left")
    as_int = F.col(year).try_cast("int")
    markers = F.size(F.split(F.col(excerpt), r"\[CITATION\]")) - 1
    rules = [
        ("missing_required_value", F.col("__missing")),
        ("duplicate_id", F.col(order) != F.col("__first")),
        ("invalid_year", as_int.isNull()),
        ("wrong_year", as_int != wanted_year),
        ("citation_marker_count", markers != 1),
    ]
    return marked.withColumn("reason", first_reason(rules)).select(*df.columns, "reason")


def biomedical_gate(df: DataFrame, audit: DataFrame, required: Sequence[str], year: str = "2025", row_id: str = "id", venue: str = "venue") -> tuple[DataFrame, DataFrame]:
    """(df with `reason` and the audit's columns, its counts): missing value, then not one marker, then another year as text.

    A missing venue is counted and the row is kept; rows without an audit row keep nulls there.
    """
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    rules = [("missing_required_value", missing), ("citation_marker_count", F.size(F.split("excerpt", r"\[CITATION\]")) != 2), ("wrong_year", F.coalesce(F.trim(F.col("year").cast("string")), F.lit("")) != year)]
    gated = df.withColumn("reason", first_reason(rules)).join(audit, row_id, "left")
    no_venue = F.trim(F.coalesce(F.col(venue).cast("string"), F.lit(""))) == ""
    counts = gated.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("reason") == n).alias(f"n_{n}") for n, _ in rules], F.count_if(F.col("reason").isNull() & no_venue).alias("n_missing_venue_kept"), F.count_if(F.col("reason").isNull()).alias("n_kept"))
    return gated, counts


def reason_counts(gated: DataFrame, *by: str) -> DataFrame:
    return gated.filter("reason IS NOT NULL").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def _known(other: DataFrame, key: str) -> DataFrame:
    """Digests of the other table's values of a key; empty and null ones never match."""
    return other.filter(F.coalesce(F.col(key), F.lit("")) != "").select(digest(F.col(key)).alias("__key")).distinct()


def leakage_flags(df: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with a flag `in_<key>` for each key that stands in the other table; empty and null keys never match."""
    out = df
    for k in keys:
        out = out.withColumn("__key", digest(F.col(k))).join(_known(other, k).withColumn(f"in_{k}", F.lit(True)), "__key", "left").withColumn(f"in_{k}", F.coalesce(f"in_{k}", F.lit(False)))
    return out.select(*df.columns, *[f"in_{k}" for k in keys])


def without_leakage(df: DataFrame, other: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows none of whose keys stands in the other table: an anti-join for each key, as one OR would need nested loops."""
    out = df
    for k in keys:
        out = out.withColumn("__key", digest(F.col(k))).join(_known(other, k), "__key", "left_anti")
    return out.select(*df.columns)


def contained_items(df: DataFrame, items: DataFrame, key: str, item_key: str) -> DataFrame:
    """Pairs of a row and an item whose key stands anywhere in the row's key (both with single spaces); empty item keys match nothing.

    An item's longest word that is neither its first nor its last is a whole word of every key that contains the item. Items of
    BROADCAST_CHARS characters at most meet each row by that word where it is; of more, rows send the digests of their distinct words, the
    candidates' keys follow, and both are compared. Items of fewer than three words have no such word: they are compared with all rows,
    in parts of BROADCAST_CHARS characters.
    """
    words = F.split(item_key, " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    seeds = items.filter(F.col(item_key) != "").withColumn("__seed", F.array_max(inner)["w"])
    seeds = seeds.withColumn("__seed", F.nullif("__seed", F.lit("")))
    long, short = seeds.filter("__seed IS NOT NULL"), seeds.filter("__seed IS NULL").drop("__seed")
    chars = seeds.agg(*[F.coalesce(F.sum(F.when(c, F.length(item_key))), F.lit(0)).alias(n) for n, c in (("long", F.col("__seed").isNotNull()), ("short", F.col("__seed").isNull()))]).first()
    holds = F.contains(F.col(key), F.col(item_key))
    if chars["long"] <= BROADCAST_CHARS:
        rows = df.withColumn("__seed", F.explode(F.array_distinct(F.split(key, " "))))
        found = rows.join(F.broadcast(long), "__seed").filter(holds).drop("__seed")
    else:
        found = _contained_by_digest(df, long, key, item_key)
    for part in _parts(short, item_key, chars["short"]):
        found = found.unionByName(df.join(F.broadcast(part), holds))
    return found


def _contained_by_digest(df: DataFrame, items: DataFrame, key: str, item_key: str) -> DataFrame:
    """Pairs by the digests of words: keys are sent once, to the pairs that share a digest, not with each of their words."""
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "contained-rows")
    items = written(items.withColumn("__item", F.monotonically_increasing_id()), "contained-items")
    words = rows.select("__row", F.explode(F.transform(F.array_distinct(F.split(key, " ")), lambda w: F.xxhash64(w))).alias("__seed"))
    pairs = words.join(items.select(F.xxhash64("__seed").alias("__seed"), "__item"), "__seed").select("__row", "__item")
    return pairs.join(rows, "__row").join(items, "__item").filter(F.contains(F.col(key), F.col(item_key))).drop("__row", "__item", "__seed")


def _parts(items: DataFrame, item_key: str, chars: int) -> list[DataFrame]:
    """items in parts of about BROADCAST_CHARS characters at most; none of no items."""
    n = -(-2 * chars // max(BROADCAST_CHARS, 1)) if chars > BROADCAST_CHARS else 1
    return [items.filter(F.pmod(F.xxhash64(item_key), F.lit(n)) == i) for i in range(n)] if chars else []


def leakage_reason(keys: Sequence[str] = KEYS) -> Column:
    return first_reason([(f"{k.removesuffix('_key')}_leakage", F.col(f"in_{k}")) for k in keys])


def leakage_counts(flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows by each reason (all that hold are counted) and rows with any."""
    any_of = F.greatest(*[F.col(f"in_{k}") for k in keys])
    return flags.agg(*[F.count_if(F.col(f"in_{k}")).alias(f"n_{k}") for k in keys], F.count_if(any_of).alias("n_any"))


def split_summary(df: DataFrame, by: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each `by`: rows, distinct keys, and most rows of one source and of one target."""
    tops = []
    for k in keys[1:]:
        tops.append(df.groupBy(by, k).agg(F.count("*").alias("_n")).groupBy(by).agg(F.max("_n").alias(f"max_per_{k.removesuffix('_key')}")))
    out = df.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count_distinct(k).alias(f"distinct_{k.removesuffix('_key')}") for k in keys])
    for t in tops:
        out = out.join(t, by)
    return out


def overlap_counts(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """kind, n: distinct values of each key that both tables have."""
    values = lambda t, k: t.select(digest(F.col(k)).alias("__key"))
    parts = [values(a, k).intersect(values(b, k)).agg(F.count("*").alias("n")).select(F.lit(k.removesuffix("_key")).alias("kind"), "n") for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(df: DataFrame, order: Sequence[str | Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the rank (0, 1, ...) of each row by `order`, over all rows or within each group `by`; nulls first, ties in any fixed order.

    Not by one task, whatever the groups: rows are dealt by ranges of (by, order), sampled from the data, and written with their
    place in their range; the ranges' sizes (a row for each range and group) give the offsets. `order` may be of any type.
    """
    names = {f"__o{i}": (o if isinstance(o, Column) else F.col(o)) for i, o in enumerate(order)}
    keys = [*by, *names]
    # the partitions number the ranges in the order of their rows
    dealt = df.withColumns(names).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = dealt.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop(*names)
    placed = written(placed, "ranges")
    groups = {f"__g{i}": F.col(c) for i, c in enumerate(by)}
    sizes = placed.withColumns(groups).groupBy("__range", *groups).agg(F.count("*").alias("__n"), F.min("__place").alias("__first")) if groups else placed.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__range").alias("__r"), *groups, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__before"))
    same = F.col("__range") == F.col("__r")
    for g, c in groups.items():
        same = same & c.eqNullSafe(F.col(g))
    return placed.join(offsets, same).withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).select(*[c for c in df.columns if c != name], name)


def numbered(df: DataFrame, order: Sequence[str | Column], start: int, name: str = "id") -> DataFrame:
    """df with ids start, start + 1, ... by `order`, of any types; nulls first."""
    return ranked(df, order, name).withColumn(name, F.col(name) + F.lit(start))


def first_rows(df: DataFrame, order: Sequence[str | Column], most: int) -> DataFrame:
    """The first `most` rows by order, as a writer that stops there keeps them; a group that the limit cuts is still one that was read."""
    return df.orderBy(*order).limit(most)


def pooled_keys(tables: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys of several tables, as a reference for leakage."""
    out = tables[0].select(*keys)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys))
    return out.distinct()


def first_in_venue_order(df: DataFrame, keys: Sequence[str], venues: Sequence[str], venue: str, order: Sequence[str]) -> DataFrame:
    """first_wins across venues in a stated order of venues, then by `order`; other venues come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in venues]), F.col(venue))
    place = F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(len(venues) + 1))
    return first_wins(df.withColumn("__venue", place), keys, ["__venue", *order]).drop("__venue")


def balanced_top(df: DataFrame, by: str, order: Sequence[str], quota: int) -> DataFrame:
    """The first `quota` rows of each group; Spark keeps a group limit in each task, so hot groups stay small."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= quota).drop("_rn")


def missing_rows(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that must exist but do not: an empty result is the assertion."""
    return expected.join(found.select(*keys).distinct(), list(keys), "left_anti")


def next_id(df: DataFrame, row_id: str = "id", default: int = 99_999) -> DataFrame:
    return df.agg((F.coalesce(F.max(F.col(row_id).cast("long")), F.lit(default)) + 1).alias("next_id"))


def leakage_table(overlaps: DataFrame) -> DataFrame:
    """kind, n, verdict: PASS where two splits share nothing."""
    return overlaps.withColumn("verdict", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"))


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit by order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def batch_numbers(df: DataFrame, order: Sequence[str], by: str, size: int = 200) -> DataFrame:
    """df with batch: the number of its run of `size` rows within each group by order, as a batched service is asked."""
    return ranked(df, order, "batch", [by]).withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
