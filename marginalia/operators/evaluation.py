"""Replay of tool-using trajectories, rewards and roll-ups of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_matches
from ..functions.similarity import entity_title, is_similar, may_reach, sequence_ratio
from ..functions.text import bounded, sentences_with, word_count

#: Fixed values.
MAX_ACTIONS = 5
WITH_QUERY = ("search_relevance", "search_citation_count", "search_snippet", "find_in_text")
WITH_PAPER = ("read", "select")
WITHOUT = ("ask_for_more_context",)
PAPER = "struct<paperId:string,title:string,externalIds:map<string,string>,url:string>"


def valid_action(name: Column, query: Column, paper_id: Column) -> Column:
    filled = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return F.coalesce((name.isin(*WITH_QUERY) & filled(query)) | (name.isin(*WITH_PAPER) & filled(paper_id)) | name.isin(*WITHOUT), F.lit(False))


def replay(actions: DataFrame, targets: DataFrame, max_actions: int = MAX_ACTIONS) -> DataFrame:
    """trajectory_id, n_actions, n_refused, n_invalid, selected_id, correct, reward of recorded trajectories.

    actions: trajectory_id, turn, name, query, paper_id, results array<PAPER>; targets: trajectory_id, target_id. A call counts before
    it is judged; calls beyond the budget or after a selection are refused. Searches replace the latest ids and add to
    all papers; read and find need a latest id, select any known id. Reward 1 for a selected target, else 0.
    """
    turn = F.struct("turn", "name", "query", "paper_id", "results")
    logs = actions.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(turn), lambda a, b: F.when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).otherwise(0)).alias("log")).join(targets, "trajectory_id", "left")
    none = F.array().cast("array<string>")
    start = F.struct(
        F.lit(0).alias("actions"), F.lit(0).alias("refused"), F.lit(0).alias("invalid"), none.alias("latest"), F.array().cast(f"array<{PAPER}>").alias("papers"), F.lit(None).cast(PAPER).alias("selected")
    )

    def step(s: Column, a: Column) -> Column:
        refuse = (s["actions"] + 1 > max_actions) | s["selected"].isNotNull()
        good = valid_action(a["name"], a["query"], a["paper_id"])
        results = F.coalesce(a["results"], F.array().cast(f"array<{PAPER}>"))
        searches = a["name"].startswith("search_") & good & ~refuse
        wanted = F.filter(s["papers"], lambda p: p["paperId"] == a["paper_id"])
        chosen = F.try_element_at(wanted, F.lit(-1))
        reads = a["name"].isin("read") & good & ~refuse
        missing = (reads & ~F.array_contains(s["latest"], F.coalesce(a["paper_id"], F.lit("")))) | ((a["name"] == "select") & good & ~refuse & chosen.isNull())
        return F.struct(
            (s["actions"] + 1).alias("actions"),
            (s["refused"] + refuse.cast("int")).alias("refused"),
            (s["invalid"] + (~refuse & (~good | F.coalesce(missing, F.lit(False)))).cast("int")).alias("invalid"),
            F.when(searches, F.transform(results, lambda p: p["paperId"])).otherwise(s["latest"]).alias("latest"),
            F.when(searches, F.concat(s["papers"], results)).otherwise(s["papers"]).alias("papers"),
            F.when((a["name"] == "select") & good & ~refuse, chosen).otherwise(s["selected"]).alias("selected"),
        )

    done = logs.withColumn("s", F.aggregate("log", start, step))
    correct = F.coalesce(F.col("s.selected").isNotNull() & identifier_matches(F.col("s.selected.paperId"), F.col("s.selected.externalIds"), F.col("s.selected.url"), F.col("target_id")), F.lit(False))
    return done.select(
        "trajectory_id", F.col("s.actions").alias("n_actions"), F.col("s.refused").alias("n_refused"), F.col("s.invalid").alias("n_invalid"), F.col("s.selected.paperId").alias("selected_id"), correct.alias("correct"), correct.cast("double").alias("reward")
    )


def result_reward(data_source: Column, expected: str, correct: Column, rewards: Column) -> Column:
    """1 or 0 by the tool's own verdict where there is one, else the best of its rewards; another data source is an error."""
    score = F.when(correct.isNotNull(), correct.cast("double")).otherwise(best_reward(rewards))
    return F.when(data_source.eqNullSafe(F.lit(expected)), score).otherwise(F.raise_error(F.concat(F.lit("unexpected data source: "), F.coalesce(data_source, F.lit("null")))))


def title_matches(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, target (its place), place, title: for the first target title that some found title is like, the most alike of these, the first of equals.

    results: id, found_titles array, target_titles array. A ratio must lie above the threshold; ids without a match have no row.
    """
    pairs = results.select("id", F.posexplode("target_titles").alias("target", "wanted"), "found_titles").select("id", "target", "wanted", F.posexplode("found_titles").alias("place", "title"))
    ratio = F.when(may_reach(F.lower("wanted"), F.lower("title"), threshold), sequence_ratio(F.lower("wanted"), F.lower("title")))
    near = pairs.withColumn("ratio", ratio).filter(F.col("ratio") > threshold)
    return near.groupBy("id").agg(F.min(F.struct("target", (-F.col("ratio")).alias("apart"), "place", "title")).alias("m")).select("id", "m.target", "m.place", "m.title")


#: What a trajectory is told.
NO_ACCESS = "This paper does not have an open access PDF."
NO_TEXT = "There was an error reading the PDF. Please try a different paper. "


def read_observation(pdf_url: Column, text: Column) -> Column:
    """What reading a paper shows: its bounded text, or that it has no open PDF, or that nothing could be read."""
    none = F.coalesce(pdf_url, F.lit("")) == ""
    return F.when(none, F.lit(NO_ACCESS)).when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit(NO_TEXT), pdf_url)).otherwise(bounded(text))


def find_observation(pdf_url: Column, text: Column, needle: Column) -> Column:
    """Sentences of a paper's text as it is read that hold the needle, whatever its case; else that none does, or why there is no text."""
    read = read_observation(pdf_url, text)
    found = sentences_with(F.trim(read), needle)
    failed = F.contains(F.lower(read), F.lit("error reading")) | F.contains(F.lower(read), F.lit("does not have an open access"))
    return F.when(failed, read).when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(F.concat(F.lit("No sentence found containing '"), needle, F.lit("'.")))


def context_observation(query: Column, title: Column, context: Column) -> Column:
    """What a request for more context is told, with or without any."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("unknown"))
    without = F.concat(F.lit("No additional context was provided by the user. Paper title: "), name, F.lit(". Focus query: "), query, F.lit(". Continue using only the original excerpt."))
    given = F.concat(F.lit("Additional context from the user for paper title '"), name, F.lit("' and focus query '"), query, F.lit("':\n"), context)
    return F.when(F.coalesce(context, F.lit("")) == "", without).otherwise(given)


#: Roles of a history by the kinds of message.
ROLES = {"system": "system", "ai": "assistant", "human": "user", "tool": "tool"}


def history(turns: DataFrame, key: str = "trajectory_id", keep_system: bool = False) -> DataFrame:
    """key, history array<struct<role,content>> in the order of turns; kinds without a role go, and system messages unless kept."""
    role = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in ROLES.items()])
    rows = turns.withColumn("role", role).filter(F.col("role").isNotNull() & (F.lit(keep_system) | (F.col("role") != "system")))
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return rows.groupBy(key).agg(F.transform(said, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))


def best_reward(rewards: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(rewards, lambda r: r.isNotNull())), F.lit(0.0))


def tokens_by_role(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, input_tokens, output_tokens: what the assistant says is output, all else input."""
    n = word_count(F.coalesce("text", F.lit("")))
    mine = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return turns.groupBy(key).agg(F.coalesce(F.sum(F.when(~mine, n)), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum(F.when(mine, n)), F.lit(0)).cast("long").alias("output_tokens"))


def last_turn(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, role and text of the last turn; of several with that number the greatest by role, then text."""
    return turns.groupBy(key).agg(F.max(F.struct("turn", "role", "text")).alias("s")).select(key, "s.*")


def run_metrics(results: DataFrame, *by: str) -> DataFrame:
    """examples, correct (true only), selected, errors and their shares for each run; null is not correct."""
    examples, right = F.count("*"), F.count_if(F.coalesce("is_correct", F.lit(False)))
    chosen, failed = F.count_if(F.col("selected").isNotNull()), F.count_if(F.coalesce(F.col("status") == "error", F.lit(False)))
    return results.groupBy(*by).agg(examples.alias("examples"), right.alias("correct"), chosen.alias("selected"), failed.alias("errors"), (right / examples).alias("accuracy"), (chosen / examples).alias("selection_rate"))


def sweep_summary(runs: DataFrame, by: str = "temperature") -> DataFrame:
    """Mean, sample deviation (0 for one run), least and most accuracy, mean selection rate and all errors."""
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.avg("accuracy").alias("mean_accuracy"), F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("stdev_accuracy"), F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"), F.avg("selection_rate").alias("mean_selection_rate"), F.sum("errors").alias("errors")
    )


def score_results(results: DataFrame, threshold: float = 0.8) -> DataFrame:
    """results with is_in_search (place of the first found title like a cited one, from 0, or null) and is_correct.

    results: id, cited_titles array, found_titles array, selected_title.
    """
    each = results.select("id", F.posexplode_outer("found_titles").alias("place", "found"), "cited_titles").select("id", "place", "found", F.explode_outer("cited_titles").alias("cited"))
    first = each.filter(is_similar(F.col("found"), F.col("cited"), threshold)).groupBy("id").agg(F.min("place").alias("is_in_search"))
    chosen = results.select("id", "selected_title", F.explode_outer("cited_titles").alias("cited")).groupBy("id").agg(F.max(is_similar(F.col("selected_title"), F.col("cited"), threshold)).alias("is_correct"))
    return results.join(first, "id", "left").join(chosen, "id", "left").withColumn("is_correct", F.when(F.col("selected_title").isNotNull(), F.coalesce("is_correct", F.lit(False))))


def training_records(rows: DataFrame, targets: DataFrame, system_prompt: str, data_source: str = "citation") -> DataFrame:
    """Nested training records; a row without a target id is an error when it is read."""
    joined = rows.join(targets.select("id", "title_key", "target_id"), ["id", "title_key"], "left")
    joined = joined.withColumn("target_id", F.coalesce("target_id", F.raise_error(F.concat(F.lit("no target id for row "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    args = F.struct(F.col("year").alias("year"), F.col("source_paper_title").alias("source_title"), F.col("target_paper_title").alias("target_title"), F.col("target_id").alias("target_id"))
    return joined.select(
        F.lit(data_source).alias("data_source"), F.lit("citation_agent").alias("agent_name"), F.array(message("system", F.lit(system_prompt)), message("user", F.col("excerpt"))).alias("prompt"),
        F.lit("citation").alias("ability"), F.struct(F.lit("rule").alias("style"), F.col("target_id").alias("ground_truth")).alias("reward_model"),
        F.struct(F.col("id").alias("row_id"), F.col("venue").alias("venue"), F.lit(True).alias("need_tools_kwargs"), F.struct(args.alias("create_kwargs")).alias("tools_kwargs")).alias("extra_info"),
    )


def target_ids(metadata: DataFrame, order: str = "_ord") -> DataFrame:
    """id, title_key, target_id of the last record for each (id, title); records without a target id are skipped."""
    rows = metadata.filter(F.trim(F.coalesce("resolved_paper_id", F.lit(""))) != "").withColumn("title_key", entity_title("source_paper_title"))
    return rows.groupBy("id", "title_key").agg(F.max_by("resolved_paper_id", order).alias("target_id"))
