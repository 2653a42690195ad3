"""Confirmed corrections and exclusions, applied to candidates, audit and release and committed together.

Both are keyed by (source_file, id). corrections: audit_id, reason, paper_id, title, year; exclusions: audit_id, reason. They are joined as one
table, so each of the three tables is joined once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.identifiers import paper_url
from ..sources.versions import Versions

#: What a corrected or excluded row says of itself.
METHOD, VERIFIED, EXCLUDED = "confirmed_manual_audit", "canonical_target_confirmed_by_manual_audit", "excluded_invalid_citation_context"
#: What a correction replaces and the first correction keeps, as original_*.
REPLACED = ("resolved_paper_id", "resolved_title", "resolved_year", "resolution_query", "resolution_score", "discoverability_rank")
TYPES = {"resolved_year": "int", "resolution_score": "double", "discoverability_rank": "int"}


def verdicts(corrections: DataFrame, exclusions: DataFrame) -> DataFrame:
    """_file, _id and _v struct<kind, audit_id, reason, paper_id, title, year>; an exclusion comes before a correction, of several the first audit_id."""
    fields = lambda kind, *rest: F.struct(F.lit(kind).alias("kind"), "audit_id", "reason", *rest).alias("_v")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("paper_id", "string"), ("title", "string"), ("year", "int"))]
    c = corrections.select(F.col("source_file").alias("_file"), F.col("id").cast("string").alias("_id"), fields("revise", "paper_id", "title", F.col("year").cast("int").alias("year")))
    x = exclusions.select(F.col("source_file").alias("_file"), F.col("id").cast("string").alias("_id"), fields("exclude", *none))
    return c.unionByName(x).groupBy("_file", "_id").agg(F.min("_v").alias("_v"))


def _judged(df: DataFrame, found: DataFrame, file: Column, row_id: Column) -> DataFrame:
    return df.join(found, (file == F.col("_file")) & (row_id.cast("string") == F.col("_id")), "left").drop("_file", "_id")


def _is(kind: str) -> Column:
    return F.coalesce(F.col("_v.kind") == kind, F.lit(False))


def corrected_candidates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates without the excluded ones, corrected ones with their new target. Split files name the former id as original_id, which counts if it is there and not empty."""
    row_id = F.coalesce(F.nullif("original_id", F.lit("")), F.col("id")) if "original_id" in candidates.columns else F.col("id")
    rows = _judged(candidates, found, F.col("source_file"), row_id).filter(~_is("exclude"))
    new = {"target_paper_title": F.col("_v.title"), "target_paper_url": paper_url(F.col("_v.paper_id"))}
    return rows.withColumns({c: F.when(_is("revise"), x).otherwise(F.col(c)) for c, x in new.items()}).select(*candidates.columns)


def _corrected(rows: DataFrame, when: Column) -> DataFrame:
    """Corrected rows keep what they were in manual_correction, unless an earlier correction has."""
    missing = {c: F.lit(None).cast(TYPES.get(c, "string")) for c in (*REPLACED, "resolution_method", "discoverability_verification") if c not in rows.columns}
    rows = rows.withColumns(missing)
    kept = F.struct(F.col("_v.audit_id").alias("audit_id"), F.col("_v.reason").alias("reason"), *[F.col(c).alias(f"original_{c}") for c in REPLACED])
    if "manual_correction" in rows.columns and isinstance(rows.schema["manual_correction"].dataType, StructType):
        had = F.col("manual_correction")
    else:
        had = F.lit(None).cast(rows.select(kept.alias("x")).schema["x"].dataType)
    new = {
        "resolved_paper_id": F.col("_v.paper_id"), "resolved_title": F.col("_v.title"), "resolved_year": F.col("_v.year"), "resolution_query": F.col("_v.title"), "resolution_score": F.lit(None),
        "resolution_method": F.lit(METHOD), "discoverability_rank": F.lit(None), "discoverability_verification": F.lit(VERIFIED),
    }
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    changed = {c: F.when(when, x.cast(kinds[c])).otherwise(F.col(c)) for c, x in new.items()}
    return rows.withColumns({"manual_correction": F.when(when & had.isNull(), kept).otherwise(had), **changed})


def corrected_audit(audit: DataFrame, found: DataFrame) -> DataFrame:
    """All audit rows; excluded ones say so in manual_exclusion, corrected ones have the new target and manual_correction."""
    rows = _corrected(_judged(audit, found, F.col("source_file"), F.col("id")), _is("revise"))
    said = F.struct(F.col("_v.audit_id").alias("audit_id"), F.col("_v.reason").alias("reason"), F.lit(EXCLUDED).alias("release_status"))
    had = F.col("manual_exclusion") if "manual_exclusion" in audit.columns else F.lit(None).cast("struct<audit_id:string,reason:string,release_status:string>")
    return rows.withColumn("manual_exclusion", F.when(_is("exclude"), said).otherwise(had)).drop("_v")


def corrected_release(release: DataFrame, audit: DataFrame, found: DataFrame, file_of_venue: Mapping[str, str]) -> DataFrame:
    """Test rows without the excluded ones and with corrections; other rows that a correction had reached by an equal id are restored from the audit before it.

    A row's source file follows from its venue. A row that should be restored and has no audit row of its year, id and source title is an error.
    """
    files = F.create_map(*(F.lit(x) for pair in file_of_venue.items() for x in pair)) if file_of_venue else F.create_map().cast("map<string,string>")
    test = F.coalesce(F.col("experimental_split") == "test", F.lit(False))
    rows = _judged(release, found, F.coalesce(F.element_at(files, F.col("venue")), F.lit("")), F.col("id")).filter(~(test & _is("exclude")))
    out = _corrected(rows, test & _is("revise"))
    if "manual_correction" not in release.columns:
        return out.drop("_v")
    ids = found.filter("_v.kind = 'revise'").select(F.col("_v.audit_id").alias("_audit")).distinct().withColumn("_hit", F.lit(True))
    key = ["year", "id", "source_paper_title"]
    was = audit.groupBy(*(F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(key))).agg(F.max_by(F.struct(*REPLACED), F.col("_ord") if "_ord" in audit.columns else F.lit(0)).alias("_was"))
    out = out.withColumn("_prior", ~test & F.col("manual_correction").isNotNull())
    out = out.join(ids, F.col("_prior") & (F.col("manual_correction.audit_id") == F.col("_audit")), "left")
    back = F.coalesce(F.col("_hit"), F.lit(False))
    for i, c in enumerate(key):
        out = out.withColumn(f"_r{i}", F.when(back, F.col(c).cast("string")))
    out = out.join(was, [F.col(f"_r{i}") == F.col(f"_k{i}") for i in range(len(key))], "left")
    lost = F.raise_error(F.concat(F.lit("no audit row to restore release row "), F.coalesce(F.col("release_id"), F.lit("?"))))
    kinds = {f.name: f.dataType for f in out.schema.fields}
    restored = {c: F.when(back, F.when(F.col("_was").isNull(), lost.cast(kinds[c])).otherwise(F.col(f"_was.{c}").cast(kinds[c]))).otherwise(F.col(c)) for c in REPLACED}
    cleared = {c: F.when(~back, F.col(c)) for c in ("manual_correction", "resolution_method", "discoverability_verification")}
    names = [c for c in out.columns if not c.startswith("_") or c in release.columns]
    return out.withColumns(restored | cleared).select(*names)


def apply_corrections(versions: Versions, corrections: DataFrame, exclusions: DataFrame, file_of_venue: Mapping[str, str]) -> int:
    """The next version of `candidates`, `audit` and `release`: all three or, whatever fails, none."""
    now = versions.current()
    candidates, audit, release = (versions.read(t, now) for t in ("candidates", "audit", "release"))
    found = verdicts(corrections, exclusions)
    tables = {"candidates": corrected_candidates(candidates, found), "audit": corrected_audit(audit, found), "release": corrected_release(release, audit, found, file_of_venue)}
    return versions.commit(tables, after=now)
