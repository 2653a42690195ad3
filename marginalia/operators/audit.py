"""Rule-based audit of extracted contexts: structural failures, review flags, evidence, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import reference_leakage
from ..functions.similarity import sequence_ratio
from ..functions.text import title_key, trimmed

#: Fixed values.
REQUIRED = "id source_paper_title source_paper_url citation_marker raw_sentence raw_reference resolved_paper_id resolved_title".split()
ENTRY_SIGNALS = (
    r"^(?:\[[0-9]+\]\s*)?[A-Z][\w'’-]+(?:,|\s+[A-Z]\.)",
    r"(?i)\b(?:arXiv|doi|Proceedings of|pp?\.|vol\.|volume)\b",
    r"\b(?:19|20)\d{2}\b",
    r"(?i)\[citation\]",
)
SENTENCE_ENDS = ".!?)]}”’\"'"
MARKER_YEARS = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
UNSAFE = ("resolved_to_source_paper", "citation_year_disagreement")


def _named(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def text_of(name: str) -> Column:
    return trimmed(F.col(name).cast("string"))


def looks_like_entry(sentence: Column) -> Column:
    out = sentence != ""
    for p in ENTRY_SIGNALS:
        out = out & F.rlike(sentence, F.lit(p))
    return out


def blank(name: str) -> Column:
    """Whether text_of is empty; looks no further than the first character that is no white space."""
    return ~F.rlike(F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit(r"(?U)[^\s\x1c-\x1f]"))


def structural_failures(sentence: Column | None = None) -> Column:
    """sentence: text_of("raw_sentence"), where it is computed already."""
    sentence = text_of("raw_sentence") if sentence is None else sentence
    marker = text_of("citation_marker")
    return _named(
        *[(f"missing_{c}", blank(c)) for c in REQUIRED],
        ("citation_marker_absent_from_raw_sentence", (sentence != "") & (marker != "") & ~F.contains(sentence, marker)),
        ("not_single_citation_context", F.coalesce(F.col("sentence_citation_count") != 1, F.lit(True))),
        ("bibliography_entry_used_as_passage", looks_like_entry(sentence)),
    )


def marker_years() -> Column:
    marker = F.concat_ws(" ", F.coalesce("citation_marker", F.lit("")), F.coalesce("reference_key", F.lit("")))
    return F.transform(F.regexp_extract_all(marker, F.lit(MARKER_YEARS), F.lit(0)), lambda y: y.cast("int"))


def year_distance() -> Column:
    """Years between the resolved paper and the nearest year of the marker; null if either has none."""
    return F.array_min(F.transform(marker_years(), lambda y: F.abs(y - F.col("resolved_year"))))


def common_failures() -> Column:
    source, resolved = title_key(F.col("source_paper_title")), title_key(F.col("resolved_title"))
    raw = F.coalesce("raw_reference", F.lit(""))
    spill = (F.char_length(raw) > 1200) | (F.size(F.regexp_extract_all(raw, F.lit(r"(?i)\b(?:doi|url|arxiv)\b"), F.lit(0))) >= 4)
    return _named(
        ("resolved_to_source_paper", (source != "") & (source == resolved)),
        ("citation_year_disagreement", year_distance() > 1),
        ("low_resolution_score", F.col("resolution_score") < 0.65),
        ("bibliography_span_spillover", spill),
        ("spillover_with_weak_match", spill & (F.col("resolution_score") < 0.80)),
    )


def review_flags(sentence: Column | None = None) -> Column:
    """sentence: text_of("raw_sentence"), where it is computed already."""
    sentence = text_of("raw_sentence") if sentence is None else sentence
    reference = text_of("raw_reference")
    more = _named(
        ("very_short_passage", F.char_length(sentence) < 40),
        ("possibly_truncated_passage", (sentence != "") & ~F.contains(F.lit(SENTENCE_ENDS), F.right(sentence, F.lit(1)))),
        ("reference_span_likely_contains_multiple_entries", F.char_length(reference) > 1200),
    )
    return F.array_sort(F.array_distinct(F.concat(common_failures(), more)))


def acceptance_evidence() -> Column:
    """Names of evidence that outweighs flags about a noisy reference; empty without."""
    title, source = title_key(F.col("resolved_title")), title_key(F.col("source_paper_title"))
    prefix = title_key(F.substring(F.coalesce("raw_reference", F.lit("")), 1, 900))
    agrees = F.coalesce(year_distance() <= 1, F.lit(True))
    query = title_key(F.col("resolution_query"))
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("citation_marker", F.lit(""))), "[^a-z]+", " ")), " "), lambda w: (F.char_length(w) > 2) & ~w.isin("and", "etal"))
    author = (F.size(words) == 0) | F.contains(prefix, F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    other = (title != "") & (title != source) & agrees
    near = F.when((query != "") & (title != ""), sequence_ratio(query, title)).otherwise(0.0) >= 0.93
    return (
        F.when(other & F.contains(prefix, title), F.array(F.lit("exact_resolved_title_in_reference_prefix"), F.lit("citation_year_consistent")))
        .when(other & near & author, F.array(F.lit("resolution_query_matches_resolved_title"), F.lit("citation_year_consistent")))
        .otherwise(F.array().cast("array<string>"))
    )


def decide(audit: DataFrame, adjudications: DataFrame, exclusions: DataFrame, corrections: DataFrame) -> DataFrame:
    """audit with decision struct<action, reasons, revision, authority>.

    Precedence: adjudication, exclusion, correction, structural failure, flags (accepted on evidence unless unsafe), accept.
    The three tables are keyed by (source_file, id); the optimizer broadcasts those that are small.
    """
    key = ["source_file", "id"]
    kinds = {"_a": F.struct("action", "reasons", "revision", "authority"), "_x": F.lit(True), "_c": F.struct("reason", "paper_id", "title", "year")}
    stated = [t.select(*key, kinds[n].alias(n)).groupBy(*key).agg(F.first(n, ignorenulls=True).alias(n)) if n == "_x" else t.select(*key, kinds[n].alias(n)) for n, t in (("_a", adjudications), ("_x", exclusions), ("_c", corrections))]
    # a row for each key that any of the three has, so that the audit is joined once
    said = stated[0].join(stated[1], key, "full").join(stated[2], key, "full")
    # texts are read once and below the join, so that rows without them go through it
    rows = audit.withColumn("_sentence", text_of("raw_sentence"))
    sentence = F.col("_sentence")
    rows = rows.withColumns({"_fail": structural_failures(sentence), "_flags": review_flags(sentence), "_evidence": acceptance_evidence()}).drop("_sentence").join(said, key, "left")
    none = F.lit(None).cast("map<string,string>")

    def verdict(action: str, reasons: Column, authority: str, revision: Column = none) -> Column:
        return F.struct(F.lit(action).alias("action"), reasons.alias("reasons"), revision.alias("revision"), F.lit(authority).alias("authority"))

    corrected = F.create_map(F.lit("resolved_paper_id"), F.col("_c.paper_id"), F.lit("resolved_title"), F.col("_c.title"), F.lit("resolved_year"), F.col("_c.year").cast("string"), F.lit("resolution_query"), F.col("_c.title"), F.lit("resolution_method"), F.lit("confirmed_manual_audit"))
    unsafe = F.arrays_overlap("_flags", F.array(*[F.lit(u) for u in UNSAFE]))
    external = F.struct(
        F.col("_a.action").alias("action"),
        F.when(F.size(F.coalesce("_a.reasons", F.array().cast("array<string>"))) > 0, F.col("_a.reasons")).otherwise(F.array(F.lit("external_adjudication"))).alias("reasons"),
        F.col("_a.revision").alias("revision"),
        F.coalesce(F.nullif("_a.authority", F.lit("")), F.lit("external_adjudication")).alias("authority"),
    )
    decision = (
        F.when(F.col("_a").isNotNull(), external)
        .when(F.col("_x"), verdict("reject", F.array(F.lit("confirmed_invalid_context")), "confirmed_manual_audit"))
        .when(F.col("_c").isNotNull(), verdict("revise", F.array("_c.reason"), "confirmed_manual_audit", corrected))
        .when(F.size("_fail") > 0, verdict("reject", F.col("_fail"), "automatic_policy"))
        .when((F.size("_flags") > 0) & (F.size("_evidence") > 0) & ~unsafe, verdict("accept", F.col("_evidence"), "deterministic_cross_check"))
        .when(F.size("_flags") > 0, verdict("review", F.col("_flags"), "automatic_policy"))
        .otherwise(verdict("accept", F.array().cast("array<string>"), "automatic_policy"))
    )
    return rows.withColumn("decision", decision).select(*audit.columns, "decision")


def apply_revisions(decided: DataFrame) -> DataFrame:
    """Accepted and revised rows, the latter with the revision's values."""
    out = decided.filter(F.col("decision.action").isin("accept", "revise"))
    for c in ("resolved_paper_id", "resolved_title", "resolved_year", "resolution_query"):
        if c in decided.columns:
            out = out.withColumn(c, F.coalesce(F.try_element_at("decision.revision", F.lit(c)).cast(decided.schema[c].dataType), F.col(c)))
    return out


def decision_counts(decided: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("decision.action") == a)
    return decided.agg(F.count("*").alias("n_rows"), *[n(a).alias(f"n_{a}") for a in ("accept", "revise", "reject", "review")], (n("review") == 0).alias("release_ready"))


def flag_counts(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode(common_failures()).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def review_candidates(audit: DataFrame) -> DataFrame:
    """Rows with a flag other than spillover."""
    return audit.withColumn("flags", common_failures()).filter(F.size(F.array_remove("flags", "bibliography_span_spillover")) > 0)


def unused_adjudications(adjudications: DataFrame, audit: DataFrame) -> DataFrame:
    return adjudications.join(audit.select("source_file", "id").distinct(), ["source_file", "id"], "left_anti")


def cleaned_pair(candidates: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows whose passage is the bibliography entry itself."""
    bad = audit.filter(reference_leakage(F.coalesce("raw_sentence", F.lit("")), F.coalesce("raw_reference", F.lit("")))).select("id").distinct()
    return candidates.join(bad, "id", "left_anti"), audit.join(bad, "id", "left_anti")
