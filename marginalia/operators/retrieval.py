"""Search over a local paper index, reference resolution and discoverability.

The index is a DataFrame of papers (paperId, title, abstract, year, citationCount, ...). Candidates come from shared tokens
by an equi-join, never from a product of queries and papers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import YEAR
from ..functions.similarity import is_similar, sequence_ratio
from ..functions.text import compare_text, content_tokens, query_tokens, sentences
from ..staging import removed, written
from .titles import without_similar_titles

#: Tokens of all queries that go to all executors at most (a megabyte or two); more are looked up by rarity, see `candidates`.
FEW_TERMS = 20_000
#: Papers that a task counts hits for at most, about: its memory is that of their pairs with queries, whatever the number of papers.
TASK_PAPERS = 5000
#: First candidates of a query for each paper that it asks for: of more, the lower bound is closer and costs more.
FIRST = 20


def eligible(papers: DataFrame, fields: Sequence[str] | None = None, open_access: bool = False) -> DataFrame:
    """Papers of one of the fields of study (array fieldsOfStudy) and, if asked for, with an open copy (struct openAccessPdf with a url). Nulls have neither."""
    if fields is not None:
        papers = papers.filter(F.coalesce(F.arrays_overlap("fieldsOfStudy", F.array(*map(F.lit, fields))), F.lit(False)) if fields else F.lit(False))
    if open_access:
        papers = papers.filter(F.coalesce(F.col("openAccessPdf.url"), F.lit("")) != "")
    return papers


def _tokens(text: Column) -> Column:
    return F.array_distinct(content_tokens(query_tokens(text)))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """query_id, max_year (null: any) and the distinct tokens of each query."""
    year = F.col("max_year").cast("int") if "max_year" in queries.columns else F.lit(None).cast("int")
    return queries.select("query_id", year.alias("max_year"), _tokens(F.col("query")).alias("all_tokens"))


def ranked_terms(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, max_year, token, place (1: the query's rarest token among papers), before (papers with a rarer one, summed), n_known (tokens that any paper has; the others have no row)."""
    terms = asked.select("query_id", "max_year", F.explode("all_tokens").alias("token"))
    held = papers.select(F.explode("tokens").alias("token")).join(terms.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("query_id")  # as many rows as a query has tokens
    w = own.orderBy("df", "token")
    before = F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return terms.join(held, "token").withColumns({"place": F.row_number().over(w), "before": before, "n_known": F.count("*").over(own).cast("int")}).drop("df")


def _met(terms: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, paper_id and met: how many of the given terms a paper has. Papers of a later or unknown year are left out where a query has a max_year."""
    posted = papers.select("paper_id", "year", F.explode("tokens").alias("token"))
    hits = posted.join(terms, "token").filter(F.col("max_year").isNull() | (F.col("year") <= F.col("max_year")))
    return hits.groupBy("query_id", "paper_id").agg(F.count("*").cast("int").alias("met"))


def _shared(pairs: DataFrame, asked: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, paper_id and how many of the query's tokens the paper has."""
    both = pairs.select("query_id", "paper_id").join(papers.select("paper_id", "tokens"), "paper_id").join(asked.select("query_id", "all_tokens"), "query_id")
    return both.select("query_id", "paper_id", F.size(F.array_intersect("all_tokens", "tokens")).alias("shared"))


def least_shared(terms: DataFrame, asked: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """query_id, least: so many tokens the last of a query's first `limit` papers shares at least, by those that have its rarest tokens. Queries with fewer papers have no row."""
    first = _met(terms.filter(F.col("before") < FIRST * limit).select("query_id", "max_year", "token"), papers)
    w = Window.partitionBy("query_id").orderBy(F.desc("met"), "paper_id")
    some = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * limit)
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"))
    return _shared(some, asked, papers).withColumn("r", F.row_number().over(w)).filter(F.col("r") == limit).select("query_id", F.col("shared").alias("least"))


def candidates(terms: DataFrame, asked: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """query_id, paper_id, met, whole: all papers that can be among a query's first `limit`.

    A paper that shares `least` of a query's n known tokens lacks at most n - least of them. So it has one of the n - least + 1 rarest
    tokens, and of any e more than that at least e + 1: only those are looked up, never the most frequent ones. whole: all were.
    """
    known = terms.join(least_shared(terms, asked, papers, limit), "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    extra = F.floor(F.greatest(F.col("least") - 1, F.lit(0)) / 2).cast("int")
    known = known.withColumn("upto", F.least("n_known", F.col("n_known") - F.col("least") + 1 + extra))
    looked = known.filter(F.col("place") <= F.col("upto"))
    need = F.greatest(F.col("upto") - F.col("n_known") + F.col("least"), F.lit(1))
    bound = looked.filter("place = 1").select("query_id", need.alias("need"), (F.col("upto") == F.col("n_known")).alias("whole"))
    met = _met(looked.select("query_id", "max_year", "token"), papers)
    return met.join(bound, "query_id").filter(F.col("met") >= F.col("need")).drop("need")


def search(queries: DataFrame, papers: DataFrame, limit: int = 10, fields: Sequence[str] | None = None, open_access: bool = False) -> DataFrame:
    """query_id, paper_id, score, rank: papers by the share of the query's distinct tokens they have; ties by paper_id.

    queries: query_id (distinct), query and optionally max_year; papers: paperId (distinct), title, abstract, year and what `eligible` looks at.
    The number of papers that come back is the feature: they are the exact first ones.

    FEW_TERMS tokens at most go to all executors: papers are dealt by their id once, as arrays of tokens, so their hits are counted where they
    are and only each task's first papers of a query travel. Of more, only papers that can be among a query's first are scored, see
    `candidates`; the tables between are deleted when the result stands.
    """
    year = F.col("year").cast("int") if "year" in papers.columns else F.lit(None).cast("int")
    whole = F.concat_ws(" ", F.col("title"), F.col("abstract"))
    own = eligible(papers, fields, open_access).select(F.col("paperId").alias("paper_id"), year.alias("year"), _tokens(whole).alias("tokens"))
    asked = asked_tokens(queries)
    terms = asked.select("query_id", "max_year", F.explode("all_tokens").alias("token"))
    n_tokens = asked.select("query_id", F.size("all_tokens").alias("n_tokens"))
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        tasks = max(-(-own.count() // TASK_PAPERS), int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shared = _met(F.broadcast(terms), own.repartition(tasks, "paper_id")).withColumnRenamed("met", "shared")
        return _first_papers(shared, F.broadcast(n_tokens), limit)
    own, asked = written(own, "search-papers"), written(asked, "search-queries")
    terms = written(ranked_terms(asked, own), "search-terms")
    found = written(candidates(terms, asked, own, limit), "search-candidates")
    shared = found.filter("whole").select("query_id", "paper_id", F.col("met").alias("shared")).unionByName(_shared(found.filter("NOT whole"), asked, own))
    out = written(_first_papers(shared, n_tokens, limit), "search-found")
    removed(own, asked, terms, found)
    return out


def _first_papers(shared: DataFrame, n_tokens: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "paper_id")
    first = shared.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return first.join(n_tokens, "query_id").select("query_id", "paper_id", (F.col("shared") / F.col("n_tokens")).alias("score"), "rank")


def citation_count_topk(found: DataFrame, skip: DataFrame | None, k: int, fetch: int = 100) -> DataFrame:
    """For each query the k most cited of its first `fetch` papers by rank, without titles like a skipped one; unknown counts last, ties by rank.

    found: query_id, rank, title, citationCount; skip: query_id, title.
    """
    rows = found.filter(F.col("rank") <= fetch)
    if skip is not None:
        rows = without_similar_titles(rows, skip, 0.9, ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("citationCount"), "rank")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def relevance_topk(found: DataFrame, skip: DataFrame | None, k: int, refill: bool = False) -> DataFrame:
    """For each query the first k by rank, then without titles like a skipped one, so fewer may be left; with refill the next ranks take their places."""
    rows = found if refill else found.filter(F.col("rank") <= k)
    if skip is not None:
        rows = without_similar_titles(rows, skip, 0.9, ["query_id"])
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def overlap_score(reference: Column, title: Column) -> Column:
    """Share of the title's distinct tokens longer than two that the reference has."""
    words = lambda x: F.filter(F.array_distinct(F.split(compare_text(x), " ")), lambda t: t != "")
    own = F.filter(words(title), lambda t: F.char_length(t) > 2)
    return F.size(F.array_intersect(own, words(reference))) / F.greatest(F.size(own), F.lit(1))


def match_score(reference: Column, title: Column, year: Column) -> Column:
    """0.7 overlap + 0.3 ratio, and the year: 0.05 more if it stands in the reference, else less with the distance."""
    found = F.regexp_extract(reference, YEAR, 0)
    delta = F.abs(year - F.substring(found, 1, 4).try_cast("int"))
    stated = (F.coalesce(year, F.lit(0)) != 0) & F.contains(reference, year.cast("string"))
    adjust = F.when(stated, F.lit(0.05)).when((F.coalesce(year, F.lit(0)) != 0) & (delta > 1), -F.least(F.lit(0.10), 0.02 * (delta - 1))).otherwise(0.0)
    score = 0.7 * overlap_score(reference, title) + 0.3 * sequence_ratio(compare_text(title), compare_text(reference)) + adjust
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).otherwise(score)


def resolve(references: DataFrame, papers: DataFrame, source_titles: DataFrame | None = None, least: float = 0.55, limit: int = 10) -> DataFrame:
    """reference_id, paper_id, title, year, query, score of the best paper over all queries; the earliest wins ties; below `least` none.

    references: reference_id, reference_text, queries array. Equal queries are searched once.
    """
    asked = references.select("reference_id", "reference_text", F.posexplode("queries").alias("query_idx", "query"))
    distinct = asked.select("query").distinct().withColumn("query_id", F.sha2("query", 256))
    found = search(distinct, papers, limit).join(distinct, "query_id")
    rows = asked.join(found, "query").join(papers.select(F.col("paperId").alias("paper_id"), "title", "year"), "paper_id")
    if source_titles is not None:
        rows = rows.join(source_titles.select("reference_id", compare_text(F.col("source_title")).alias("_own")), "reference_id", "left").filter(~(F.coalesce("_own", F.lit("")) == compare_text(F.col("title"))))
    rows = rows.withColumn("score", match_score(F.col("reference_text"), F.col("title"), F.col("year")))
    best = rows.groupBy("reference_id").agg(F.max_by(F.struct("paper_id", "title", "year", "query", "score"), F.struct("score", (-F.col("query_idx")).alias("q"), (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("reference_id", "b.*").filter(F.col("score") >= least)


def discoverable(asked: DataFrame, papers: DataFrame, limit: int = 20, least: float = 0.9) -> DataFrame:
    """row_id, query, rank: the first query in order that finds a paper titled like the target, and its first rank.

    asked: row_id, target_title, queries array.
    """
    each = asked.select("row_id", "target_title", F.posexplode("queries").alias("query_idx", "query"))
    distinct = each.select("query").distinct().withColumn("query_id", F.sha2("query", 256))
    found = search(distinct, papers, limit).join(distinct, "query_id").join(papers.select(F.col("paperId").alias("paper_id"), "title"), "paper_id")
    hits = each.join(found, "query").filter(is_similar(compare_text(F.col("title")), compare_text(F.col("target_title")), least, strict=False))
    return hits.groupBy("row_id").agg(F.min(F.struct("query_idx", "rank", "query")).alias("h")).select("row_id", "h.query", "h.rank")


def snippets(papers: DataFrame, needle: str, text: str = "abstract") -> DataFrame:
    """paperId, sentence_index, snippet: sentences with the needle, whatever its case."""
    each = papers.select("paperId", F.posexplode(sentences(F.col(text))).alias("sentence_index", "snippet"))
    return each.filter(F.contains(F.lower("snippet"), F.lower(F.lit(needle))))
