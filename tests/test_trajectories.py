"""Replay over texts against a plain state machine."""

import random
import re

from pyspark.sql import functions as F

from marginalia.operators import trajectories
from marginalia.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(log, papers):
    """(trajectory, turn): (place, status, observation, selected id) by one dictionary of state for each trajectory."""
    out, states = {}, {}
    for a in sorted(log, key=lambda a: (a["trajectory_id"], a["turn"])):
        s = states.setdefault(a["trajectory_id"], {"n": 0, "latest": [], "all": {}, "done": False})
        s["n"] += 1
        query, name, pid = (a["query"] or "").strip(), a["name"], a["paper_id"] or ""
        selected = None

        def text(pid):
            url, body = papers.get(pid, (None, None))
            if not url:
                return "This paper does not have an open access PDF."
            return body if body else "There was an error reading the PDF. Please try a different paper. " + url

        if s["n"] > 5:
            got = "refused", "Max actions reached."
        elif s["done"]:
            got = "refused", "A paper was already selected; stop."
        elif name in ("search_relevance", "search_citation_count", "search_text_snippet"):
            if not query:
                got = "invalid", "A non-empty query is required."
            else:
                found = a["results"] or []
                got = "ok", "\n\n".join(f"- Paper ID: {p['paperId']}\n   Title: {p['title']}\n   Abstract: {(p['abstract'] or '')[:1000]}\n   Citation Count: {p['citationCount']}" for p in found) or trajectories.NOTHING
                if name != "search_text_snippet":
                    s["latest"] = [p["paperId"] for p in found]
                    s["all"].update({p["paperId"]: p for p in found})
        elif name == "ask_for_more_context":
            title = (a["paper_title"] or "").strip()
            got = ("ok", f"No additional context was provided by the user. Paper title: {title}. Focus query: {query}. Continue using only the original excerpt.") if query and title else ("invalid", "Both query and paper_title are required.")
        elif name in ("read", "find_in_text"):
            if pid not in s["latest"]:
                got = "invalid", f"Paper {pid} not found in the latest search buffer."
            elif name == "find_in_text" and not query:
                got = "invalid", "A non-empty query is required."
            else:
                shown = text(pid)
                shown = shown if len(shown) <= 16_000 else shown[:16_000] + "\n[truncated]"
                if name == "find_in_text" and pid in papers and papers[pid][0] and papers[pid][1]:
                    hits = [x for x in re.split(r"(?<=[.!?])\s+", shown.strip()) if query.lower() in x.lower()]
                    shown = "\n".join(hits) if hits else f"No sentence found containing '{query}'."
                got = "ok", shown
        elif name == "select":
            if pid in s["all"]:
                s["done"], selected = True, pid
                got = "ok", f"Selection recorded: {s['all'][pid]['title']}. Stop now."
            else:
                got = "invalid", f"Paper {pid} not found in the search buffer."
        else:
            got = "invalid", "Unknown action."
        out[a["trajectory_id"], a["turn"]] = (s["n"], *got, selected)
    return out


def test_replay_over_texts_equals_a_state_machine(spark):
    rng = random.Random(2)
    names = ["search_relevance", "search_citation_count", "search_text_snippet", "read", "read", "find_in_text", "select", "ask_for_more_context", "other", None]
    papers = {str(i): (rng.choice([None, "", "u"]) if i % 3 else "u", rng.choice([None, "", "One fox. Two Foxes! Three hens? fox", "x" * 20_000])) for i in range(12)}
    log = []
    for t in range(150):
        for turn in rng.sample(range(50), rng.randrange(1, 9)):
            results = [{"paperId": str(rng.randrange(14)), "title": f"T{k}", "abstract": rng.choice([None, "a" * 1200]), "citationCount": rng.choice([None, k]), "externalIds": None, "url": None} for k in range(rng.randrange(4))]
            log.append({"trajectory_id": t, "turn": turn, "name": rng.choice(names), "query": rng.choice(["fox", "  ", None, "zebra"]), "paper_id": rng.choice([None, *map(str, range(14))]), "paper_title": rng.choice(["P", "", None]), "results": rng.choice([None, results, results])})
    schema = f"trajectory_id int, turn int, name string, query string, paper_id string, paper_title string, results {trajectories.FOUND}"
    table = spark.createDataFrame([(k, *v) for k, v in papers.items()], "paperId string, pdf_url string, text string")
    calls = trajectories.told(spark.createDataFrame(log, schema).repartition(4), table).cache()
    want = plain(log, papers)
    assert {(r["trajectory_id"], r["turn"]): (r["place"], r["status"], r["observation"], r["selected"] and r["selected"]["paperId"]) for r in calls.collect()} == want
    targets = spark.createDataFrame([(t, str(t % 14)) for t in range(150)], "trajectory_id int, target_id string")
    for r in trajectories.ended(calls, targets).collect():
        own = [v for (t, _), v in want.items() if t == r["trajectory_id"]]
        chosen = next((v[3] for v in own if v[3] is not None), None)
        assert (r["n_actions"], r["n_refused"], r["n_invalid"], r["selected_id"]) == (len(own), *(sum(v[1] == s for v in own) for s in ("refused", "invalid")), chosen)
        assert r["correct"] == (chosen == str(r["trajectory_id"] % 14)) and r["reward"] == float(r["correct"])


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role")).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    papers = {str(r["doc_id"]): ("https://pdf.example.org/x" if r["doc_id"] % 7 else None, r["text"]) for r in docs}
    log = []
    for r in rows:
        i, n = r["conv_id"], r["turn"]
        name = "search_relevance" if r["role"] == "user" else "ask_for_more_context" if r["role"] != "assistant" else ("read", "find_in_text", "select")[(i + n) % 3]
        found = [{"paperId": str(x), "title": f"Title {x}", "abstract": None, "citationCount": n % 9} for x in (i, i + n % 2)]
        log.append({"trajectory_id": i, "turn": n, "name": name, "query": "th" if i % 5 else "", "paper_id": str(i + n % 2), "paper_title": "T", "results": found if r["role"] == "user" else None})
    got = catalogue.QUERIES["trajectory_observations"](spark, SF).collect()
    assert {(r["trajectory_id"], r["turn"]): (r["place"], r["status"], r["observation"], r["selected_id"]) for r in got} == plain(log, papers)
    assert len(got) == len(log) and len({r["status"] for r in got}) > 1


def test_agents_without_tools(spark):
    rows = [(1, "Based on the excerpt, it is: Deep Sheep", ["deep sheep", "x"]), (2, "My guess: A: B", ["A: B"]), (3, "Title: With Colon", ["Title: With Colon"]), (4, "most likely nothing", ["z"]), (5, None, ["z"])]
    df = spark.createDataFrame(rows, "id int, answer string, target_titles array<string>")
    got = {r["id"]: (r["selected_title"], r["is_correct"]) for r in trajectories.without_search(df, df).collect()}
    assert got == {1: ("Deep Sheep", True), 2: ("A: B", True), 3: ("Title: With Colon", True), 4: ("", False), 5: (None, False)}
