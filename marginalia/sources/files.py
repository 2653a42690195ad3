"""Scans of CSV, JSONL and text; all paths may be anything that Spark reads. `_ord` is (path, place) order where order counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import source_key, without_nul
from ..staging import written

MANIFEST = "source_paper_title string, source_paper_url string, year int, pdf_url string, pdf_path string, venue string, domain string"
DATASET = "id string, excerpt string, target_paper_title string, target_paper_url string, source_paper_title string, source_paper_url string, year string, split string"
ADJUDICATION = "source_file string, id string, action string, reasons array<string>, revision map<string,string>, authority string"
BOM = "\ufeff"
ACTIONS = ("accept", "revise", "reject", "review")


class SourceError(ValueError):
    """An input that breaks its contract."""


def csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, required: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """CSV with a header, quotes doubled inside quotes and line breaks in fields; a byte order mark and NUL characters are removed.

    ordered: also source_file (the file's name) and _ord, see `csv_records`; files may then have their columns in different orders.
    """
    if ordered:
        df = _ordered_csv(spark, path)
    else:
        df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        df = df.toDF(*[c.lstrip(BOM) for c in df.columns])
        df = df.select(*[without_nul(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    if schema is None:
        return df
    fields = spark.createDataFrame([], schema).schema
    places = [c for c in ("source_file", "_ord") if ordered and c not in fields.names]
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields], *places)


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, source_file and _ord of each record of CSV files, header included, as raw text with its line breaks.

    Files are read in blocks, wherever a block may begin. A line opens a record where an even number of quotes stands before it in its file: quotes
    are summed within each block and then over a file's blocks, a row for each, so that neither a file nor its lines meet in one task. A line
    whose record began in an earlier block is sent to it. Lines end with LF; a CR before it goes with the record's end.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines_ = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines_ = written(lines_.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))), "csv-lines")
    of_block = Window.partitionBy("path", "block").orderBy("n")
    before = F.coalesce(F.sum("quotes").over(of_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines_ = lines_.withColumn("before", before)
    # a block's own lines open records at even or at odd counts, as the quotes of the blocks before it say
    blocks = lines_.groupBy("path", "block").agg(F.sum("quotes").alias("quotes"), *[F.max(F.when(F.col("before") % 2 == p, F.col("n"))).alias(f"last{p}") for p in (0, 1)])
    of_file = Window.partitionBy("path").orderBy("block")
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("parity", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("open", F.last(F.when(F.col("parity") == 0, F.col("last0")).otherwise(F.col("last1")), ignorenulls=True).over(earlier)).select("path", "block", "parity", "open")
    placed = lines_.join(blocks, ["path", "block"]).withColumn("opens", (F.col("before") + F.col("parity")) % 2 == 0)
    first = F.coalesce(F.last(F.when(F.col("opens"), F.col("n")), ignorenulls=True).over(of_block), F.col("open"))
    whole = placed.withColumn("first", first).groupBy("path", "source_file", "first").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("all"))
    text = F.regexp_replace(F.array_join(F.transform("all", lambda x: x["value"]), "\n"), r"\r$", "")
    return whole.select(text.alias("value"), "source_file", F.struct("path", F.col("all")[0]["block"].alias("block"), F.col("all")[0]["n"].alias("n")).alias("_ord"))


def _ordered_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    records = written(csv_records(spark, path).withColumn("value", without_nul(F.col("value"))), "csv-records")
    heads = records.groupBy("_ord.path").agg(F.min(F.struct("_ord", "value")).alias("h")).select("path", F.regexp_replace("h.value", f"^{BOM}", "").alias("head"), F.col("h._ord").alias("_first"))
    options, out = {"quote": '"', "escape": '"'}, None
    for row in heads.select("head").distinct().orderBy("head").collect():  # a row for each form of the header
        one = spark.createDataFrame([(row["head"],)], "value string")
        # as many columns as the header has separators at most
        kinds = ", ".join(f"c{i} string" for i in range(row["head"].count(",") + 1))
        names = [v for v in one.select(F.from_csv("value", F.lit(kinds), options).alias("r")).first()["r"] if v is not None]
        if len(set(names)) < len(names):
            raise SourceError(f"repeated columns: {', '.join(names)}")
        rows = records.join(heads.filter(F.col("head") == row["head"]).select("path", "_first"), F.col("_ord.path") == F.col("path")).filter((F.col("_ord") > F.col("_first")) & (F.col("value") != ""))
        parsed = rows.withColumn("r", F.from_csv("value", F.lit(", ".join(f"c{i} string" for i in range(len(names)))), options))
        own = [n for n in names if n not in ("source_file", "_ord")]  # a file's own column of these names gives way
        df = parsed.select(*[F.col(f"r.c{names.index(n)}").alias(n) for n in own], "source_file", "_ord")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return records.select("source_file", "_ord").limit(0) if out is None else out


def manifest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Manifest rows, trimmed, empty as null; the PDF address falls back to a source URL that ends in .pdf."""
    df = csv(spark, path, MANIFEST, ("source_paper_title", "source_paper_url", "year"))
    for c in ("source_paper_title", "source_paper_url", "pdf_url", "pdf_path", "venue", "domain"):
        df = df.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    return df.withColumn("pdf_url", F.coalesce("pdf_url", F.when(F.lower("source_paper_url").endswith(".pdf"), F.col("source_paper_url"))))


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    df = spark.read.text(path, wholetext=False).select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return df.withColumn("_ord", F.struct(F.col("_path").alias("path"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("n"))).drop("_block", "_path")


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """value, source_file and _ord of the non-blank lines of text files, NUL removed."""
    return _numbered_lines(spark, path).withColumn("value", without_nul(F.col("value"))).filter(F.trim("value") != "")


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON lines with source_file and _ord. Strict: the first line that is no object is an error; else such lines go."""
    parsed = lines(spark, path).withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    if strict:
        bad = parsed.filter("r IS NULL OR r._corrupt IS NOT NULL").agg(F.min(F.struct("_ord", "value")).alias("b")).first()["b"]
        if bad:
            file, before = bad["_ord"]["path"], F.struct(*[F.lit(bad["_ord"][c]).alias(c) for c in ("path", "block", "n")])
            # lines of its file up to it, blank ones too
            at = _numbered_lines(spark, path).filter((F.col("_ord.path") == file) & (F.col("_ord") <= before)).count()
            raise SourceError(f"{file.rpartition('/')[2]}:{at}: {bad['value'][:200]}")
    good = parsed.filter("r IS NOT NULL AND r._corrupt IS NULL")
    file = [] if "source_file" in good.schema["r"].dataType.names else ["source_file"]  # a record's own column of that name counts
    return good.select("r.*", *file, "_ord").drop("_corrupt")


def invalid_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """n_invalid: lines that are no records."""
    parsed = lines(spark, path).withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.agg(F.count_if(F.expr("r IS NULL OR r._corrupt IS NOT NULL")).alias("n_invalid"))


def id_differences(candidates: DataFrame, audit: DataFrame, row_id: str = "id") -> DataFrame:
    """kind, n: ids that only one of the tables has."""
    a, b = candidates.select(row_id), audit.select(row_id)
    one = lambda x, y, kind: x.subtract(y).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(a, b, "without_audit").unionByName(one(b, a, "without_candidate"))


def audit_metadata(audit: DataFrame) -> DataFrame:
    """id, venue, domain of the last row for each id; domain defaults to Biomedical Research."""
    last = audit.groupBy("id").agg(F.max_by(F.struct("venue", "domain"), "_ord").alias("m"))
    return last.select("id", "m.venue", F.coalesce(F.nullif("m.domain", F.lit("")), F.lit("Biomedical Research")).alias("domain"))


def adjudications(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Adjudications; a repeated key, an unknown action or a revision without values is an error."""
    df = jsonl(spark, path, ADJUDICATION, strict=True).drop("_ord").select(*[f.split()[0] for f in ADJUDICATION.split(", ")])
    bad = df.filter(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | ((F.col("action") == "revise") & (F.size(F.coalesce("revision", F.create_map().cast("map<string,string>"))) == 0))).first()
    twice = df.groupBy("source_file", "id").count().filter("count > 1").first()
    if bad or twice:
        raise SourceError(f"invalid adjudication: {bad or twice}")
    return df


def confirmed_accepts(annotations: DataFrame, sample: DataFrame, split: DataFrame) -> DataFrame:
    """source_file, id of annotated rows judged valid: annotations (sample_id, valid) x sample (sample_id, split_id) x split (id, source_file, original_id)."""
    good = annotations.filter(F.lower(F.trim("valid")) == "yes").select("sample_id")
    return good.join(sample.select("sample_id", "split_id"), "sample_id").join(split.select(F.col("id").alias("split_id"), "source_file", "original_id"), "split_id").select("source_file", F.col("original_id").alias("id")).distinct()


def latest_result(spark: SparkSession, path: str) -> DataFrame:
    """The last element of a result file's `results`."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.element_at("results", -1).alias("r")).select("r.*")


def unprocessed(rows: DataFrame, done: DataFrame, row_id: str = "id") -> DataFrame:
    return rows.join(done.select(row_id).distinct(), row_id, "left_anti")


#: The place of the format instructions in a template, and what stands before titles to be skipped.
INSTRUCTIONS, SKIP = "<FORMAT_INSTRUCTIONS>", "The following paper titles should be skipped during search:"


def prompt(spark: SparkSession, path: str, instructions: str, skip: Sequence[str] = ()) -> str:
    """A prompt template with its format instructions filled in and titles to be skipped at its end; one small file. A template without their place is an error."""
    template = spark.read.text(path, wholetext=True).first()["value"]
    if INSTRUCTIONS not in template:
        raise SourceError(f"{path}: {INSTRUCTIONS} is missing")
    listed = "\n".join(["", *(f"- {title}" for title in skip)]) if skip else ""
    return template.replace(INSTRUCTIONS, instructions) + (SKIP + listed if skip else "")


def with_source_key(manifest_rows: DataFrame) -> DataFrame:
    return manifest_rows.withColumn("source_key", source_key(F.col("source_paper_url"), F.col("year"), F.col("source_paper_title")))


PDF_BYTES = 100 * 1024 * 1024


def is_pdf(content: Column, max_bytes: int = PDF_BYTES) -> Column:
    """Whether bytes hold the PDF mark in their first kilobyte and keep the size limit; false for null."""
    return F.coalesce((F.length(content) <= max_bytes) & (F.instr(F.hex(F.substring(content, 1, 1024)), "255044462D") > 0), F.lit(False))


def pdf_addresses(pdf_url: Column) -> Column:
    """Where a PDF may be fetched, in order: its address, then for an article of PMC the mirror's rendering."""
    article = F.upper(F.regexp_extract(pdf_url, r"(?i)/articles/(PMC\d+)/", 1))
    return F.array_compact(F.array(F.nullif(pdf_url, F.lit("")), F.when(article != "", F.concat(F.lit("https://europepmc.org/articles/"), article, F.lit("?pdf=render")))))


def acquired_pdfs(rows: DataFrame, files: DataFrame, cached: DataFrame, fetched: DataFrame, max_bytes: int = PDF_BYTES) -> DataFrame:
    """rows with content, origin (`path`, `cache`, `url` or `fallback`) and error of each row's PDF; one is null.

    rows: id, pdf_path, pdf_url; files: path, content; cached: id, content; fetched: address, content of whatever was fetched.
    A stated path decides alone; a cached file that is no PDF is passed over, one that is too large is an error, as is a fetched one.
    """
    at = pdf_addresses(F.col("pdf_url"))
    wide = rows.withColumns({"__first": F.get(at, F.lit(0)), "__second": F.get(at, F.lit(1))})
    wide = wide.join(files.select(F.col("path").alias("pdf_path"), F.col("content").alias("__path")), "pdf_path", "left").join(cached.select("id", F.col("content").alias("__cache")), "id", "left")
    for name in ("first", "second"):
        wide = wide.join(fetched.select(F.col("address").alias(f"__{name}"), F.col("content").alias(f"__{name}_content")), f"__{name}", "left")
    stated = F.coalesce("pdf_path", F.lit("")) != ""
    large = lambda c: F.coalesce(F.length(c) > max_bytes, F.lit(False))
    choice = (
        F.when(stated, F.when(F.col("__path").isNotNull(), F.lit("path")))
        .when(large("__cache"), None)
        .when(is_pdf(F.col("__cache"), max_bytes), F.lit("cache"))
        .when(large("__first_content"), None)
        .when(is_pdf(F.col("__first_content"), max_bytes), F.lit("url"))
        .when(is_pdf(F.col("__second_content"), max_bytes), F.lit("fallback"))
    )
    error = F.when(choice.isNull(), F.when(stated, "PDF path does not exist").when(F.coalesce("pdf_url", F.lit("")) == "", "no pdf_url or pdf_path").when(large("__cache") | large("__first_content") | large("__second_content"), "PDF exceeds the size limit").otherwise("download did not return a PDF"))
    content = F.when(choice == "path", F.col("__path")).when(choice == "cache", F.col("__cache")).when(choice == "url", F.col("__first_content")).when(choice == "fallback", F.col("__second_content"))
    return wide.select(*rows.columns, content.alias("content"), choice.alias("origin"), error.alias("error"))


def run_results(spark: SparkSession, path: str, schema: str = "results array<struct<is_correct:boolean,selected:string,status:string>>") -> DataFrame:
    """temperature, run and the result rows of files named `..._temp0p7_run3.json`; other files are passed over."""
    whole = spark.read.schema(schema).option("multiLine", True).json(path).select("results", F.col("_metadata.file_name").alias("name"))
    named = F.regexp_extract_all("name", F.lit(r"_temp(\d+p\d+)_run\d+\.json$"), F.lit(1))
    runs = whole.filter(F.size(named) == 1).select(F.replace(named[0], F.lit("p"), F.lit(".")).cast("double").alias("temperature"), F.regexp_extract("name", r"_run(\d+)\.json$", 1).cast("int").alias("run"), F.explode("results").alias("r"))
    return runs.select("temperature", "run", "r.*")


def pdf_files(spark: SparkSession, path: str, max_bytes: int = PDF_BYTES) -> DataFrame:
    """path, content of the PDF files within the size limit, which is the source's contract."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path)
    return df.filter((F.col("length") <= max_bytes) & is_pdf(F.col("content"), max_bytes)).select("path", "content")
