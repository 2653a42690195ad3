"""Trajectories of tool calls replayed over paper texts: what each call is told, and how the trajectory ends.

Only the first `max_actions` calls of a trajectory change its state, so windows over them, a bounded number of rows, are the ordered
state: the latest search before a call, all papers found before it, the first selection that is known. Texts are joined only to calls that
read one, by the paper's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_matches
from ..functions.text import bounded
from .evaluation import MAX_ACTIONS, find_observation, read_observation

#: Calls by what they need, and what they are told.
SEARCHES, SNIPPETS = ("search_relevance", "search_citation_count"), "search_text_snippet"
READS = ("read", "find_in_text")
SELECT, ASK = "select", "ask_for_more_context"
BEYOND, DONE = "Max actions reached.", "A paper was already selected; stop."
NO_QUERY, NO_ASK, UNKNOWN = "A non-empty query is required.", "Both query and paper_title are required.", "Unknown action."
NOTHING = "No papers were found for the given search query. Please use a different query."
NO_CONTEXT = ("No additional context was provided by the user. Paper title: ", ". Focus query: ", ". Continue using only the original excerpt.")
ABSENT = ("Paper ", " not found in the ", ".")
SELECTED = ("Selection recorded: ", ". Stop now.")
PAPER_LINES = ("- Paper ID: ", "\n   Title: ", "\n   Abstract: ", "\n   Citation Count: ")
FOUND = "array<struct<paperId:string,title:string,abstract:string,citationCount:int,externalIds:map<string,string>,url:string>>"
MAX_ABSTRACT = 1_000


def shown(papers: Column) -> Column:
    """A list of found papers as text."""

    def one(p: Column) -> Column:
        abstract = F.substring(F.coalesce(p["abstract"], F.lit("")), 1, MAX_ABSTRACT)
        return F.concat(F.lit(PAPER_LINES[0]), F.coalesce(p["paperId"], F.lit("")), F.lit(PAPER_LINES[1]), F.coalesce(p["title"], F.lit("")), F.lit(PAPER_LINES[2]), abstract, F.lit(PAPER_LINES[3]), F.coalesce(p["citationCount"].cast("string"), F.lit("None")))

    return F.when(F.size(papers) == 0, F.lit(NOTHING)).otherwise(bounded(F.array_join(F.transform(papers, one), "\n\n")))


def told(actions: DataFrame, papers: DataFrame, max_actions: int = MAX_ACTIONS) -> DataFrame:
    """trajectory_id, turn, place (1, 2, ...), name, status (ok, invalid or refused), observation, selected_id of each call.

    actions: trajectory_id, turn (distinct in a trajectory), name, query, paper_id, paper_title, results FOUND; papers: paperId (distinct), pdf_url, text. A call
    counts before it is judged; calls beyond the budget or after a selection are refused. Searches replace the latest papers; read and
    find_in_text need one of these, select one of any search. Null names are unknown calls; null results are empty.
    """
    by_turn = Window.partitionBy("trajectory_id").orderBy("turn")
    calls = actions.select("trajectory_id", "turn", "name", F.trim(F.coalesce("query", F.lit(""))).alias("query"), F.coalesce("paper_id", F.lit("")).alias("paper_id"), F.trim(F.coalesce("paper_title", F.lit(""))).alias("paper_title"), F.coalesce(F.col("results").cast(FOUND), F.array().cast(FOUND)).alias("results"))
    first = calls.withColumn("place", F.row_number().over(by_turn)).filter(F.col("place") <= max_actions)
    name = F.coalesce("name", F.lit(""))
    searched = name.isin(*SEARCHES) & (F.col("query") != "")
    earlier = by_turn.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast(FOUND)
    state = first.withColumns({
        "latest": F.coalesce(F.last(F.when(searched, F.col("results")), ignorenulls=True).over(earlier), none),
        "known": F.coalesce(F.flatten(F.collect_list(F.when(searched, F.col("results"))).over(earlier)), none),
    })
    here = F.filter("known", lambda p: p["paperId"] == F.col("paper_id"))
    state = state.withColumn("chosen", F.when(name == SELECT, F.try_element_at(here, F.lit(-1))))
    state = state.withColumn("ends", F.min(F.when(F.col("chosen").isNotNull(), F.col("place"))).over(Window.partitionBy("trajectory_id")))
    latest = F.exists("latest", lambda p: p["paperId"] == F.col("paper_id"))
    over = F.col("place") > F.coalesce("ends", F.lit(max_actions))
    reads = ~over & name.isin(*READS) & latest & ((name == "read") | (F.col("query") != ""))
    state = state.withColumns({"over": over, "_reads": F.when(reads, F.col("paper_id"))})
    text = papers.select(F.col("paperId").alias("_reads"), "pdf_url", "text")
    state = state.join(text, "_reads", "left")
    absent = lambda where: F.concat(F.lit(ABSENT[0]), F.col("paper_id"), F.lit(f"{ABSENT[1]}{where}{ABSENT[2]}"))
    ok, invalid = (lambda x: F.struct(F.lit("ok").alias("status"), x.alias("observation"))), (lambda x: F.struct(F.lit("invalid").alias("status"), x.alias("observation")))
    no_context = F.concat(F.lit(NO_CONTEXT[0]), "paper_title", F.lit(NO_CONTEXT[1]), "query", F.lit(NO_CONTEXT[2]))
    answer = (
        F.when(F.col("over"), F.struct(F.lit("refused").alias("status"), F.lit(DONE).alias("observation")))
        .when(name.isin(*SEARCHES) & ~searched, invalid(F.lit(NO_QUERY)))
        .when(searched, ok(shown(F.col("results"))))
        .when((name == SNIPPETS) & (F.col("query") == ""), invalid(F.lit(NO_QUERY)))
        .when(name == SNIPPETS, ok(shown(F.col("results"))))
        .when((name == ASK) & ((F.col("query") == "") | (F.col("paper_title") == "")), invalid(F.lit(NO_ASK)))
        .when(name == ASK, ok(no_context))
        .when(name.isin(*READS) & ~latest, invalid(absent("latest search buffer")))
        .when((name == "find_in_text") & (F.col("query") == ""), invalid(F.lit(NO_QUERY)))
        .when(name == "read", ok(read_observation(F.col("pdf_url"), F.col("text"))))
        .when(name == "find_in_text", ok(find_observation(F.col("pdf_url"), F.col("text"), F.col("query"))))
        .when((name == SELECT) & F.col("chosen").isNull(), invalid(absent("search buffer")))
        .when(name == SELECT, ok(F.concat(F.lit(SELECTED[0]), F.coalesce("chosen.title", F.lit("")), F.lit(SELECTED[1]))))
        .otherwise(invalid(F.lit(UNKNOWN)))
    )
    selected = F.when(F.col("place") == F.col("ends"), F.col("chosen"))
    judged = state.withColumn("a", answer).select("trajectory_id", "turn", "place", "name", "a.status", "a.observation", selected.alias("selected"))
    rest = calls.withColumn("place", F.row_number().over(by_turn)).filter(F.col("place") > max_actions)
    beyond = rest.select("trajectory_id", "turn", "place", "name", F.lit("refused").alias("status"), F.lit(BEYOND).alias("observation"), F.lit(None).cast(judged.schema["selected"].dataType).alias("selected"))
    return judged.unionByName(beyond)


def ended(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """trajectory_id, n_actions, n_refused, n_invalid, selected_id, correct, reward from what `told` returns; targets: trajectory_id, target_id."""
    n = lambda s: F.count_if(F.col("status") == s).cast("int").alias(f"n_{s}")
    sums = calls.groupBy("trajectory_id").agg(F.count("*").cast("int").alias("n_actions"), n("refused"), n("invalid"), F.first("selected", ignorenulls=True).alias("selected"))
    right = F.coalesce(F.col("selected").isNotNull() & identifier_matches(F.col("selected.paperId"), F.col("selected.externalIds"), F.col("selected.url"), F.col("target_id")), F.lit(False))
    return sums.join(targets, "trajectory_id", "left").select("trajectory_id", "n_actions", "n_refused", "n_invalid", F.col("selected.paperId").alias("selected_id"), right.alias("correct"), right.cast("double").alias("reward"))


def guessed_title(answer: Column) -> Column:
    """The title that an agent without tools names: what follows the first colon where the words before it only introduce it, else all of it."""
    head = F.substring_index(answer, ":", 1)
    intro = F.startswith(F.lower(head), F.lit("based on")) | F.contains(head, F.lit("guess")) | F.contains(head, F.lit("most likely"))
    return F.when(intro, F.trim(F.substring(answer, F.char_length(head) + 2, F.char_length(answer)))).otherwise(answer)


def without_search(answers: DataFrame, targets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, selected_title, is_correct of agents without tools: answers (id, answer), targets (id, target_titles array)."""
    from .evaluation import title_matches

    named = answers.select("id", guessed_title(F.col("answer")).alias("selected_title"))
    hits = title_matches(named.join(targets, "id").select("id", F.array("selected_title").alias("found_titles"), "target_titles"), threshold).select("id", F.lit(True).alias("_hit"))
    return named.join(hits, "id", "left").select("id", "selected_title", F.coalesce("_hit", F.lit(False)).alias("is_correct"))
