import json
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import fingerprint
from marginalia.operators import audit, curation, evaluation, listings, release, retrieval, sampling
from marginalia.operators import titles as titles_module
from marginalia.plans import catalogue
from marginalia.sources import boundary, files, sinks
from marginalia.streaming import resume


def test_greedy_equals_plain_loop():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("abc"), rng.choice("xyz"), f"{i:03d}") for i in rng.sample(range(500), rng.randrange(1, 20))]
        quota = rng.randrange(len(rows) + 1)
        s, t, left, want = Counter(), Counter(), set(range(len(rows))), []
        for _ in range(quota):
            i = min(left, key=lambda i: (s[rows[i][0]], t[rows[i][1]], rows[i][2]))
            left.remove(i)
            want.append(i)
            s[rows[i][0]] += 1
            t[rows[i][1]] += 1
        assert sampling.greedy_picks(rows, quota) == want
    with pytest.raises(ValueError):
        sampling.greedy_picks([("a", "x", "1")], 2)


def pool(spark):
    return spark.createDataFrame([(f"v{i % 5}", i, f"s{i % 7}", f"t{i % 11}", f"{i * 37 % 101:03d}") for i in range(60)], "venue string, id int, source_key string, target_key string, score string")


def plain_hold_out(rows, n):
    """The rule in a loop: rows (id, source, target, score) of one group."""
    many_s, many_t = Counter(r[1] for r in rows), Counter(r[2] for r in rows)
    rows = sorted(rows, key=lambda r: (many_s[r[1]], many_t[r[2]], r[3], r[0]))
    held = []
    for r in rows:
        if len(held) < n and all(r[1] != h[1] and r[2] != h[2] for h in held):
            held.append(r)
    return {r[0] for r in held + [r for r in rows if r not in held][: n - len(held)]}


def plain_waterfill(venues, total):
    """One place at a time to the lowest that has room; venues (name, index, initial, capacity)."""
    now = {v: i for v, _, i, _ in venues}
    while sum(now.values()) < total:
        room = [(now[v], k, v) for v, k, _, c in venues if now[v] < c]
        if not room:
            break
        now[min(room)[2]] += 1
    return now


def test_bounded_groups_equal_plain_loops(spark):
    """Hot pairs, sources and targets, few and many sources; quotas from 1 up."""
    rng = random.Random(5)
    rows = []
    for by, n, kinds in (("few", 150, 3), ("many", 150, 60), ("hot", 200, 0), ("single", 90, 1)):
        for i in range(n):
            source, target = (f"s{rng.randrange(kinds)}", f"t{rng.randrange(kinds)}") if kinds else ("s0" if i % 2 else f"s{i}", "t0" if i % 3 else f"t{i}")
            rows.append((len(rows), by, source, target, f"{rng.randrange(40):02d}"))
    df = spark.createDataFrame(rows, "id int, venue string, source_key string, target_key string, score string")
    for n in (1, 4, 9):
        picked = {}
        for r in sampling.diverse_sample(df, "venue", n, "id").collect():
            picked.setdefault(r["venue"], {})[r["pick"]] = r["id"]
        held = {}
        for r in sampling.hold_out(df, "venue", n, "id").filter("split = 'validation'").collect():
            held.setdefault(r["venue"], set()).add(r["id"])
        for by in ("few", "many", "hot", "single"):
            own = sorted((r for r in rows if r[1] == by), key=lambda r: (r[4], r[0]))
            left, used_s, used_t, want = list(own), Counter(), Counter(), []
            while len(want) < n:
                r = min(left, key=lambda r: (used_s[r[2]], used_t[r[3]], r[4], r[0]))
                left.remove(r)
                used_s[r[2]] += 1
                used_t[r[3]] += 1
                want.append(r[0])
            assert [picked[by][i] for i in range(n)] == want, (by, n)
            assert held[by] == plain_hold_out([(r[0], r[2], r[3], r[4]) for r in own], n), (by, n)
    with pytest.raises(ValueError):
        sampling.diverse_sample(df, "venue", 1000, "id")
    for _ in range(12):
        venues = [(f"v{k}", k, (a := rng.randrange(6)), a + rng.randrange(8)) for k in range(rng.randrange(1, 7))]
        total = rng.randrange(0, 60)
        table = spark.createDataFrame(venues, "venue string, venue_idx int, initial int, capacity int")
        assert {r["venue"]: r["target"] for r in sampling.waterfill(table, total).collect()} == plain_waterfill(venues, total), (venues, total)


def test_ranks_of_any_type(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (100, "a"), (None, "b"), (10, None), (-3, None)], "k int, g string").repartition(3)
    assert [(r["k"], r["id"]) for r in curation.numbered(df.select("k"), ["k"], 5).orderBy("id").collect()] == [(None, 5), (-3, 6), (9, 7), (10, 8), (10, 9), (100, 10)]
    got = {(r["g"], r["k"]): r["r"] for r in curation.ranked(df, ["k"], "r", ["g"]).collect()}
    assert got == {("b", None): 0, ("b", 9): 1, ("a", 10): 0, ("a", 100): 1, (None, -3): 0, (None, 10): 1}
    assert curation.numbered(df.limit(0), ["k"], 0).count() == 0
    hot = spark.range(5000).withColumn("g", F.lit(1))
    assert sorted(r["b"] for r in curation.batch_numbers(hot, ["id"], "g", 1000).groupBy(F.col("batch").alias("b")).count().filter("count = 1000").collect()) == [0, 1, 2, 3, 4]


def test_sample_and_hold_out(spark):
    got = sampling.diverse_sample(pool(spark), "venue", 3, "id").collect()
    assert Counter(r["venue"] for r in got) == {f"v{i}": 3 for i in range(5)}
    split = sampling.hold_out(pool(spark), "venue", 2, "id")
    rows = split.join(pool(spark), ["venue", "id"]).collect()
    assert Counter(r["split"] for r in rows) == {"validation": 10, "train": 50}
    for v in range(5):
        held = [r for r in rows if r["venue"] == f"v{v}" and r["split"] == "validation"]
        assert len({r["source_key"] for r in held}) == len({r["target_key"] for r in held}) == 2
    targets = spark.createDataFrame([(f"v{i}", 4) for i in range(5)], "venue string, target int")
    old = pool(spark).filter("id < 5")
    filled = sampling.fill_venue(old, pool(spark).filter("id >= 5"), targets, "venue", "id").collect()
    assert Counter(r["venue"] for r in filled) == {f"v{i}": 4 for i in range(5)} and {r["id"] for r in filled if r["pick"] == 0} == set(range(5))


def test_waterfill(spark):
    rows = [("a", 0, 1, 9), ("b", 1, 4, 6), ("c", 2, 0, 2)]
    got = {r["venue"]: r["target"] for r in sampling.waterfill(spark.createDataFrame(rows, "venue string, venue_idx int, initial int, capacity int"), 11).collect()}
    assert got == {"a": 5, "b": 4, "c": 2}


def test_dedup_and_ids(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), (None, 3, "c")], "k string, o int, v string")
    assert {r["v"] for r in curation.first_wins(df, ["k"], ["o"]).collect()} == {"a", "c"}
    assert {r["v"] for r in curation.last_wins(df, ["k"], "o").collect()} == {"b", "c"}
    hashed = spark.range(50).select("id", F.sha2(F.col("id").cast("string"), 256).alias("score"))
    ids = curation.numbered(hashed, ["score"], 7, "n").orderBy("score").collect()
    assert [r["n"] for r in ids] == list(range(7, 57))
    assert curation.next_id(df.select(F.lit(None).cast("long").alias("id"))).first()["next_id"] == 100_000


def base(**change):
    row = dict(id="1", source_file="a.csv", source_paper_title="Source", source_paper_url="u", citation_marker="[1]", reference_key=None, raw_sentence="A claim that is long enough to be a passage [1].", raw_reference="X. Target title. 2020.",
               resolved_paper_id="p", resolved_title="Target title", resolved_year=2020, resolution_query=None, resolution_score=0.9, sentence_citation_count=1)
    return row | change


SCHEMA = "id string, source_file string, source_paper_title string, source_paper_url string, citation_marker string, reference_key string, raw_sentence string, raw_reference string, resolved_paper_id string, resolved_title string, resolved_year int, resolution_query string, resolution_score double, sentence_citation_count int"


def decided(spark, rows, adjudicated=(), excluded=(), corrected=()):
    a = spark.createDataFrame(list(adjudicated), "source_file string, id string, action string, reasons array<string>, revision map<string,string>, authority string")
    x = spark.createDataFrame(list(excluded), "source_file string, id string")
    c = spark.createDataFrame(list(corrected), "source_file string, id string, reason string, paper_id string, title string, year int")
    return audit.decide(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), a, x, c)


def test_decisions(spark):
    rows = [
        base(id="ok"), base(id="miss", resolved_title=""), base(id="two", sentence_citation_count=2), base(id="weak", resolution_score=0.5), base(id="weak2", resolution_score=0.5, raw_reference="Another text. 2020."),
        base(id="self", source_paper_title="Target title"), base(id="year", citation_marker="(X, 2001)", raw_sentence="A claim that is long enough to be a passage (X, 2001)."), base(id="adj", resolved_title=""), base(id="exc"), base(id="cor"), base(id="spill", raw_reference="Target title " + "z" * 1300),
    ]
    got = {r["id"]: r["decision"] for r in decided(spark, rows, [("a.csv", "adj", "accept", [], None, None)], [("a.csv", "exc")], [("a.csv", "cor", "wrong", "DOI:1", "New", 2019)]).collect()}
    assert {k: v["action"] for k, v in got.items()} == dict(ok="accept", miss="reject", two="reject", weak="accept", weak2="review", self="review", year="review", adj="accept", exc="reject", cor="revise", spill="accept")
    assert got["miss"]["reasons"] == ["missing_resolved_title"] and got["adj"]["reasons"] == ["external_adjudication"]
    assert got["cor"]["revision"]["resolved_title"] == "New" and got["spill"]["authority"] == "deterministic_cross_check"
    counts = audit.decision_counts(decided(spark, rows)).first()
    assert counts["n_rows"] == 11 and not counts["release_ready"]


def test_replay(spark):
    kind = f"trajectory_id int, turn int, name string, query string, paper_id string, results array<{evaluation.PAPER}>"
    p = [("p1", "T", {}, "u")]
    log = [(1, 0, "search_relevance", "q", None, p), (1, 1, "select", None, "p1", None), (1, 2, "read", None, "p1", None), (2, 0, "select", None, "p1", None), (2, 1, "search_relevance", " ", None, None)]
    log += [(3, i, "ask_for_more_context", None, None, None) for i in range(5)] + [(3, 5, "search_relevance", "q", None, p)]
    targets = spark.createDataFrame([(1, "P1"), (2, "p1"), (3, "p1")], "trajectory_id int, target_id string")
    got = {r["trajectory_id"]: r for r in evaluation.replay(spark.createDataFrame(log, kind), targets).collect()}
    assert (got[1]["correct"], got[1]["n_refused"], got[1]["reward"]) == (True, 1, 1.0)
    assert (got[2]["correct"], got[2]["n_invalid"]) == (False, 2)
    assert (got[3]["n_actions"], got[3]["n_refused"]) == (6, 1)


def test_scores(spark):
    r = spark.createDataFrame([(1, ["A long title of a paper"], ["other", "A long title of a paper!"], "A long title of the paper"), (2, ["x"], [], None)], "id int, cited_titles array<string>, found_titles array<string>, selected_title string")
    got = {x["id"]: x for x in evaluation.score_results(r).collect()}
    assert (got[1]["is_in_search"], got[1]["is_correct"]) == (1, True) and (got[2]["is_in_search"], got[2]["is_correct"]) == (None, None)
    best = spark.createDataFrame([([0.1, None, 0.7],), ([],)], "r array<double>").select(evaluation.best_reward(F.col("r")).alias("b")).collect()
    assert [b["b"] for b in best] == [0.7, 0.0]


FAR = "x" * 900
PAGES = [
    ("blocks", '<div class="paper"><p class="title">A Plain Title</p><a href="/v1/a.html">abs</a><a href="/v1/a.pdf">Download PDF</a></div>', [("A Plain Title", "https://h/v1/a.html", "https://h/v1/a.pdf")]),
    ("last-pdf", '<div class="paper"><p class="title">A <i>Plain</i> &amp; Title</p><a href="/a.html">abs</a><a href="/a.pdf">pdf</a><a href="/b.pdf">pdf</a><a href="/a-supp.pdf">supp</a></div>', [("A Plain & Title", "https://h/a.html", "https://h/b.pdf")]),
    ("no-abs", '<div class="paper"><p class="title">Some Title</p><a href="/a.html">Abstract</a><a href="/a.pdf">pdf</a></div><div class="paper"><p class="title"> </p><a href="/b.html">abs</a><a href="/b.pdf">pdf</a></div>', []),
    ("twice", '<div class="x paper y"><p class="title">One Title</p><a href="/a">abs</a><a href="/a.pdf">pdf</a></div><div class="paper"><p class="title">Other</p><a href="/a">ABS</a><a href="/b.pdf">pdf</a></div>', [("One Title", "https://h/a", "https://h/a.pdf")]),
    ("unquoted", "<a href=/x/y.pdf>pdf</a> <a href=/x/y.bib>bib</a> <a href=/x/y>abs</a> <a href=/x/y>A Proper Long Title</a>", [("A Proper Long Title", "https://h/x/y", "https://h/x/y.pdf")]),
    ("author", '<a href="/p/z">The Title of the Work</a> <a href="/people/ann">Ann the Author</a> <a href="/p/z.pdf">pdf</a> <a href="/p/z-supp.pdf">supp</a>', [("The Title of the Work", "https://h/p/z", "https://h/p/z.pdf")]),
    ("own-title-far", f'<a href="/one">Its own long title</a>{FAR}<a href="/1.pdf">pdf</a><a href="/two">The next long title</a>{FAR}<a href="/2.pdf">pdf</a>', [("Its own long title", "https://h/one", "https://h/1.pdf"), ("The next long title", "https://h/two", "https://h/2.pdf")]),
    ("too-far", f'<a href="/one">Its own long title</a>{FAR}{FAR}<a href="/1.pdf">pdf</a>', []),
    ("same-target", '<a href="/other">Another long title</a><a href="/q">q</a><a href="/q.pdf">pdf</a>', []),
    ("volume", '<a href="/v.pdf">Proceedings of everything</a> <a href="#">https://h/all</a>', []),
    ("content", '<a href="/content/C2024/html/A_paper.html">A Paper of Content</a><a href="/content/C2024/papers/A_paper.pdf">pdf</a>', [("A Paper of Content", "https://h/content/C2024/html/A_paper.html", "https://h/content/C2024/papers/A_paper.pdf")]),
    ("listing", '<a href="/paper_files/paper/2023/hash/ab-Abstract-Conference.html">First Great Paper</a>', [("First Great Paper", "https://h/paper_files/paper/2023/hash/ab-Abstract-Conference.html", "https://h/paper_files/paper/2023/file/ab-Paper-Conference.pdf")]),
    ("nothing", None, []),
]


def test_listings(spark):
    pages = spark.createDataFrame([(f"https://h/?{name}", source) for name, source, _ in PAGES], "url string, html string")
    found = {}
    for r in listings.papers(pages).orderBy("page", "place").collect():
        found.setdefault(r["page"], []).append((r["title"], r["source_paper_url"], r["pdf_url"]))
    for name, _, want in PAGES:
        assert found.get(f"https://h/?{name}", []) == want, name


def test_manifest_and_listing_pages(spark):
    pages = spark.createDataFrame([("https://h/1", PAGES[0][1]), ("https://h/2", PAGES[0][1]), ("https://h/3", '<a href="/1">day=1</a><a href="/1?day=all">All Papers</a>'), ("https://h/1?day=all", PAGES[4][1])], "url string, html string")
    assert listings.manifest(pages, 2024, "V").count() == 2
    follow = {(r["landing_url"], r["listing_url"]) for r in listings.follow_listings(pages).collect()}
    assert ("https://h/3", "https://h/1?day=all") in follow
    days = '<a href="/p?day=1">a</a><a href="/p?day=1">a</a><a href="/q">Day 2</a><a href="/all.pdf">All papers</a><a href="/day.pdf?day=3">x</a>'
    named = listings.listing_pages(spark.createDataFrame([("https://h/", days)], "url string, html string")).orderBy("place").collect()
    assert [r["listing_url"] for r in named] == ["https://h/p?day=1", "https://h/q"]


def test_resolution(spark):
    papers = spark.createDataFrame([("a", "Counting sheep at night", "", 2020), ("b", "Counting goats at night", "", 2020), ("c", "Sleep", "", 1990)], "paperId string, title string, abstract string, year int")
    refs = spark.createDataFrame([(1, "Smith, A. Counting sheep at night. 2020.", ["counting sheep at night"])], "reference_id int, reference_text string, queries array<string>")
    got = retrieval.resolve(refs, papers).collect()
    assert [(r["reference_id"], r["paper_id"]) for r in got] == [(1, "a")]
    own = spark.createDataFrame([(1, "Counting Sheep at Night")], "reference_id int, source_title string")
    assert retrieval.resolve(refs, papers, own).first()["paper_id"] == "b"
    asked = spark.createDataFrame([(1, "Counting sheep at night!", ["goats", "sheep counting"])], "row_id int, target_title string, queries array<string>")
    assert tuple(retrieval.discoverable(asked, papers).first())[:2] == (1, "sheep counting")


@pytest.mark.parametrize("few", [retrieval.FEW_TERMS, 0])
def test_search_by_few_tokens_equals_scoring_all(spark, monkeypatch, few):
    """Few and many tokens, one of them in nearly all papers, ties, null texts and years, filters."""
    monkeypatch.setattr(retrieval, "FEW_TERMS", few)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    papers, queries = [], []
    for i in range(300):
        own = rng.sample(words, rng.randrange(0, 12)) + (["common"] if i % 10 else [])
        papers.append((f"p{i:03}", " ".join(own) if i % 37 else None, rng.choice(words), rng.choice([None, 1990, 2000, 2010]), [rng.choice(["cs", "bio"])] if i % 7 else None, {"url": "u", "status": "s"} if i % 3 else None))
    for i in range(40):
        own = rng.sample(words, rng.randrange(0, 10)) + rng.choice([[], ["common"], ["absent", "common"]])
        queries.append((i, " ".join(own) if i else None, rng.choice([None, 1990, 2005])))
    p = spark.createDataFrame(papers, "paperId string, title string, abstract string, year int, fieldsOfStudy array<string>, openAccessPdf struct<url:string,status:string>")
    q = spark.createDataFrame(queries, "query_id int, query string, max_year int")
    for limit, fields, open_access in ((1, None, False), (3, ["cs"], False), (20, None, True), (400, [], False), (400, None, False)):
        want = []
        for i, text, most in queries:
            asked = set((text or "").split())
            scores = []
            for pid, title, abstract, year, kinds, pdf in papers:
                if (fields is not None and not set(fields) & set(kinds or [])) or (open_access and not pdf) or (most is not None and (year is None or year > most)):
                    continue
                if n := len(asked & {*(title or "").split(), *abstract.split()}):
                    scores.append((-n / len(asked), pid))
            want += [(i, pid, -s, k + 1) for k, (s, pid) in enumerate(sorted(scores)[:limit])]
        assert sorted(map(tuple, retrieval.search(q, p, limit, fields, open_access).collect())) == sorted(want)


def test_frequent_tokens_are_not_looked_up(spark):
    """A token in nine tenths of the papers makes no candidates where rarer ones decide."""
    papers = [(f"p{i:04}", " ".join(["common", *(["frequent"] if i % 2 else []), *(["rare", "seldom", f"x{i}"] if i % 100 == 0 else [])]) if i % 10 else "other") for i in range(3000)]
    papers += [(f"q{i}", "common frequent rare seldom often") for i in range(5)]
    own = spark.createDataFrame(papers, "paperId string, title string").select(F.col("paperId").alias("paper_id"), F.lit(None).cast("int").alias("year"), F.split("title", " ").alias("tokens")).cache()
    asked = retrieval.asked_tokens(spark.createDataFrame([(1, "common frequent rare seldom often")], "query_id int, query string"))
    terms = retrieval.ranked_terms(asked, own)
    found = retrieval.candidates(terms, asked, own, 3)
    assert found.count() == 5 and retrieval._met(terms, own).count() > 2500


def test_first_wins_with_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "x", "p", 2), (1, "y", "q", 1)], "k int, __key string, __RN string, o int")
    (row,) = curation.first_wins(df, ["k"], ["o"]).collect()
    assert row.asDict() == {"k": 1, "__key": "y", "__RN": "q", "o": 1}


@pytest.mark.parametrize("kinds", [3, 40])
def test_fill_venue_equals_a_plain_loop(spark, kinds):
    rng = random.Random(kinds)
    made = lambda n, tag: [(rng.choice("uvw"), f"{tag}{i}", rng.choice([None, *map(str, range(kinds))]), str(rng.randrange(kinds)), f"{rng.randrange(1000):04}") for i in range(n)]
    old, pool, wanted = made(9, "o"), made(300, "p"), {"u": 12, "v": 3, "w": 25}
    schema = "venue string, id string, source_key string, target_key string, score string"
    targets = spark.createDataFrame(list(wanted.items()), "venue string, target int")
    got = sampling.fill_venue(spark.createDataFrame(old, schema), spark.createDataFrame(pool, schema).repartition(5), targets, "venue", "id").collect()
    for v, n in wanted.items():
        have = sorted((r[4], r[1], r[2], r[3]) for r in old if r[0] == v)
        rest = sorted((r[4], r[1], r[2], r[3]) for r in pool if r[0] == v)
        picks = sampling.greedy_picks([(s, t, score) for score, _, s, t in rest], max(n - len(have), 0), Counter(s for _, _, s, _ in have), Counter(t for _, _, _, t in have))
        assert [r["id"] for r in sorted(got, key=lambda r: r["pick"]) if r["venue"] == v] == [*(r[1] for r in have), *(rest[i][1] for i in picks)]


def test_a_large_pool_is_cut_before_it_meets(spark):
    pool = spark.range(300_000).select(F.lit("v").alias("by"), "id", (F.col("id") % 50_000).cast("string").alias("source"), F.lit("t").alias("target"), F.sha2(F.col("id").cast("string"), 256).alias("score"))
    slim = pool.select("by", F.col("id").alias("row_id"), "source", "target", "score")
    assert sampling._pickable(slim, 10).count() <= 2 * 10 * 10 + 10


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("threshold,strict", [(0.9, True), (0.8, False), (0.6, True)])
def test_similar_titles_equal_brute_force(spark, threshold, strict):
    rng = random.Random(9)
    stems = ["deep", "learning", "of", "graphs", "for", "retrieval", "a", "study", "neural", "sheep", "Étude", "x"]
    titles = [" ".join(rng.choices(stems, k=rng.randrange(1, 8))) for _ in range(150)]
    edited = []
    for t in titles:
        s = list(t)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["", "e", "Q", " "])
        edited.append("".join(s))
    left = [*titles, "", "a", "ab", "ABCDEFG", "abcdefg" * 40, None, titles[0]]
    right = [*edited, "", "b", "ba", "abcdefh", "abcdefg" * 39, None, edited[0].upper()]
    got = titles_module.similar_pairs(spark.createDataFrame([(t,) for t in left], "title string"), spark.createDataFrame([(t,) for t in right], "title string"), threshold, strict)
    a, b = ({t.lower() for t in side if t is not None} for side in (left, right))
    want = {(x, y, round(ratio(x, y), 12)) for x in a for y in b if (ratio(x, y) > threshold if strict else ratio(x, y) >= threshold)}
    assert sorted((r["left_title"], r["right_title"], round(r["ratio"], 12)) for r in got.collect()) == sorted(want)
    assert len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_skipped_titles_by_query(spark):
    found = spark.createDataFrame([(q, r + 1, f"Paper number {q} {'abcde'[r] * 12}", c) for q in (1, 2) for r, c in enumerate([None, 5, 9, 5, 7])], "query_id int, rank int, title string, citationCount int")
    skip = spark.createDataFrame([(1, "PAPER NUMBER 1 CCCCCCCCCCCC"), (1, "paper number 2 eeeeeeeeeeee"), (2, None)], "query_id int, title string")
    ranks = lambda df: [[r["rank"] for r in df.orderBy("place").collect() if r["query_id"] == q] for q in (1, 2)]
    assert ranks(retrieval.citation_count_topk(found, skip, 3)) == [[2, 4, 1], [3, 5, 2]]
    assert ranks(retrieval.citation_count_topk(found, None, 2, fetch=2)) == [[2, 1], [2, 1]]
    assert ranks(retrieval.relevance_topk(found, skip, 3)) == [[1, 2], [1, 2, 3]]
    assert ranks(retrieval.relevance_topk(found, skip, 3, refill=True)) == [[1, 2, 4], [1, 2, 3]]


def test_reconstruct(spark):
    s = spark.createDataFrame([("u", 0, "A claim [1]."), ("u", 1, "Twice [2]."), ("u", 2, "Twice [2].")], "source_paper_url string, body_sentence_index int, sentence string")
    sha = {r["sentence"]: r["h"] for r in s.select("sentence", fingerprint(F.col("sentence")).alias("h")).collect()}
    rows = [("ok", "u", 0, sha["A claim [1]."], "[1]"), ("sha", "u", None, sha["A claim [1]."], "[1]"), ("twice", "u", None, sha["Twice [2]."], "[2]"), ("range", "u", 9, "x", "[1]"), ("digest", "u", 0, "x", "[1]"), ("marker", "u", 0, sha["A claim [1]."], "[7]"), ("none", None, 0, "x", "[1]"), ("gone", "v", 0, "x", "[1]")]
    got = {r["id"]: r for r in release.reconstruct(spark.createDataFrame(rows, "id string, source_paper_url string, locator_index int, passage_sha256 string, citation_marker string"), s).collect()}
    assert got["ok"]["excerpt"] == got["sha"]["excerpt"] == "A claim [CITATION]."
    assert {k: v["error"] for k, v in got.items() if v["status"] == "error"} == dict(twice="expected one matching sentence, found 2", range="sentence index out of range", digest="passage digest mismatch", marker="citation marker absent", none="missing source URL", gone="source text unavailable")


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted", text\nover lines', "x\\y")], "id string, excerpt string, note string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "c")).collect()] == [tuple(r) for r in rows.collect()]
    (tmp_path / "m.csv").write_text("﻿source_paper_title,source_paper_url,year\n T ,https://h/x.pdf,2024\n")
    m = files.manifest(spark, str(tmp_path / "m.csv")).first()
    assert (m["source_paper_title"], m["pdf_url"], m["year"], m["venue"]) == ("T", "https://h/x.pdf", 2024, None)
    with pytest.raises(files.SourceError):
        files.csv(spark, str(tmp_path / "m.csv"), required=["absent"])
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n')
    assert [r["id"] for r in files.jsonl(spark, str(tmp_path / "a.jsonl"), "id string").collect()] == ["1", "2"]
    assert files.invalid_lines(spark, str(tmp_path / "a.jsonl"), "id string").first()["n_invalid"] == 1
    with pytest.raises(files.SourceError):
        files.jsonl(spark, str(tmp_path / "a.jsonl"), "id string", strict=True)
    assert [r["value"] for r in sinks.json_lines(spark.createDataFrame([(1, None)], "b int, a string")).collect()] == ['{"a":null,"b":1}']


def test_boundary():
    calls = []

    def fail():
        calls.append(1)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        boundary.with_retries(fail, lambda e: 414, sleep=lambda s: None)
    assert len(calls) == 1
    with pytest.raises(RuntimeError):
        boundary.with_retries(fail, lambda e: 503, attempts=3, sleep=lambda s: None)
    assert len(calls) == 4
    pages = {"*": ([{"n": 1}, {"n": 2}], "b"), "b": ([{"n": 3}], "b")}
    assert [r["n"] for r in boundary.cursor_pages(pages.__getitem__, 10)] == [1, 2, 3]
    assert [r["n"] for r in boundary.cursor_pages(pages.__getitem__, 1)] == [1]


def test_text_from_outside():
    assert boundary.without_lone_surrogates({"a": ["x\ud800y", 1]}) == {"a": ["x?y", 1]}
    assert boundary.article_query("pmc", 2024, boundary.any_of(["a b", "c"])) == '("a b" OR "c") AND 2024[PDAT] AND open access[filter]'
    assert boundary.article_query("europe_pmc", 2025) == "PUB_YEAR:2025 AND OPEN_ACCESS:Y AND HAS_PDF:Y"
    assert boundary.identified("t", email="", api_key="k") == {"tool": "t", "api_key": "k"}
    assert boundary.StaticContext(" x ").context("q", "t") == "x" and boundary.StaticContext().context("q", "t") == ""
    asked = iter(["one", "two ", "", "three"])
    assert boundary.LinesContext(lambda: next(asked, None)).context("q", "t") == "one\ntwo"
    assert boundary.LinesContext(iter([" SKIP", "x"]).__next__).context("q", "t") == ""
    assert [boundary.progress_line(i, 9, "T", 4, 3) is not None for i in (1, 2, 3, 4, 6)] == [True, False, True, False, True]
    assert boundary.progress_line(3, 9, "T", 4, 3) == "[3/9] Example source paper: T | kept 4 dataset row(s) so far" and boundary.progress_line(1, 9, "T", 0, 0) is None


def test_target_ids_keep_the_last(spark):
    rows = [("1", "A Title", "p1", 0), ("1", "a  TITLE", "p2", 1), ("1", "A title", "", 2), ("2", "B", None, 3)]
    got = evaluation.target_ids(spark.createDataFrame(rows, "id string, source_paper_title string, resolved_paper_id string, _ord int")).collect()
    assert [(r["id"], r["title_key"], r["target_id"]) for r in got] == [("1", "a title", "p2")]


def test_resume_commits_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    curate = lambda df: df.filter("x > 0")
    spark.createDataFrame([(1,), (-1,)], "x int").coalesce(1).write.parquet(src)
    resume.process_new_files(spark, src, "x int", curate, out, state).awaitTermination()
    spark.createDataFrame([(2,)], "x int").coalesce(1).write.mode("append").parquet(src)
    resume.process_new_files(spark, src, "x int", curate, out, state).awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(out).collect()) == [1, 2]
    asked = []
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")

    def answer(df):
        asked.append(df.count())
        return df.withColumn("v", F.upper("k"))

    joined, known = resume.memoised(rows, "k", answer)
    assert joined.count() == 3 and known.count() == 2 and asked == [2]


def test_flags_and_gates(spark):
    a = spark.createDataFrame([("e", "s", ""), ("e2", "s2", "t2")], "excerpt_key string, source_key string, target_key string")
    b = spark.createDataFrame([("e", "s9", ""), ("e9", "s2", "t9")], "excerpt_key string, source_key string, target_key string")
    flags = curation.leakage_flags(a, b)
    assert tuple(curation.leakage_counts(flags).first()) == (1, 1, 0, 2)
    assert curation.without_leakage(a, b).count() == 0
    assert {r["n"] for r in curation.overlap_counts(a, b).collect()} == {1}


def test_contained_items(spark):
    texts = ["x the quick brown fox jumps y", "wthe quick brown fox jumpsz", "the quick fox", "a quick brown the", "", None, "the quick brown fox"]
    items = ["the quick brown fox jumps", "quick brown", "the", "", None, "k br"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, k string")
    other = spark.createDataFrame(list(enumerate(items)), "item_id long, item string")
    got = sorted((r["doc_id"], r["item_id"]) for r in curation.contained_items(rows, other, "k", "item").collect())
    assert got == [(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if x and x in (t or "")]


def test_entry_holds_no_benchmark_item(spark):
    sf = "/root/testdata/sf0.01"
    key = lambda t: " ".join(t.lower().split())
    texts = {r["doc_id"]: key(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [key(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    sample = {r["doc_id"] for r in catalogue.QUERIES["decontaminated_balanced_sample"](spark, sf).collect()}
    assert sample and not [i for i in sample if any(x in texts[i] for x in items)]
    assert {r["doc_id"] for r in catalogue.QUERIES["benchmark_contamination"](spark, sf).collect()} == {i for i, t in texts.items() if any(x in t for x in items)}


def test_joins_of_releases_and_audit_levels_run_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    report = catalogue.QUERIES["release_report_joined"](spark, sf).first()
    assert 0 < report["n_in_splits"] < report["n_records"] and report["n_index_locators"] > 0 and report["n_fingerprint_locators"] > 0
    decided = catalogue.QUERIES["audit_decisions"](spark, sf).collect()
    assert {r["authority"] for r in decided} >= {"external_adjudication", "confirmed_manual_audit", "automatic_policy"}
    assert {(r["revised_id"] or " ")[0] for r in decided} == {"A", "C", " "}


def test_strict_lines_name_their_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": "2"}\n\n{"id": "3"}\nnot json\nnor this\n')
    with pytest.raises(files.SourceError, match=r"b\.jsonl:4: not json"):
        files.jsonl(spark, str(tmp_path), "id string", strict=True)


def test_prompt_with_titles_to_skip(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Do <FORMAT_INSTRUCTIONS> now.\n")
    assert files.prompt(spark, str(tmp_path / "p.txt"), "this") == "Do this now.\n"
    assert files.prompt(spark, str(tmp_path / "p.txt"), "this", ["A", "B"]) == "Do this now.\nThe following paper titles should be skipped during search:\n- A\n- B"
    (tmp_path / "q.txt").write_text("Do nothing.")
    with pytest.raises(files.SourceError):
        files.prompt(spark, str(tmp_path / "q.txt"), "this")


def test_acquired_pdfs(spark):
    pdf, html = bytearray(b"xx%PDF-1.4"), bytearray(b"<html>")
    late, large = bytearray(b" " * 1024 + b"%PDF-"), bytearray(b"%PDF-" + b"x" * 3000)
    pmc = "https://pmc.example/articles/pmc12/pdf/"
    rows = [("path", "/f.pdf", "u"), ("gone", "/g.pdf", "u"), ("cache", None, "h"), ("stale", None, "u"), ("bigcache", "", "u"), ("url", None, "u"), ("mirror", None, pmc), ("html", None, "h"), ("late", None, "l"), ("big", None, "b"), ("none", "", None)]
    df = spark.createDataFrame(rows, "id string, pdf_path string, pdf_url string")
    got = files.acquired_pdfs(
        df, spark.createDataFrame([("/f.pdf", html)], "path string, content binary"), spark.createDataFrame([("cache", pdf), ("stale", html), ("bigcache", large)], "id string, content binary"),
        spark.createDataFrame([("u", pdf), ("h", html), ("l", late), ("b", large), ("https://europepmc.org/articles/PMC12?pdf=render", pdf)], "address string, content binary"), max_bytes=2000,
    )
    by_id = {r["id"]: (r["origin"], r["error"]) for r in got.collect()}
    assert {i: o for i, (o, e) in by_id.items() if o} == {"path": "path", "cache": "cache", "stale": "url", "url": "url", "mirror": "fallback"}
    assert by_id["gone"][1] == "PDF path does not exist" and by_id["none"][1] == "no pdf_url or pdf_path"
    assert by_id["bigcache"][1] == by_id["big"][1] == "PDF exceeds the size limit" and by_id["html"][1] == by_id["late"][1] == "download did not return a PDF"


def test_runs_by_file_name(spark, tmp_path):
    for name, results in (("m_temp0p7_run2.json", [(True, "a", "ok"), (None, None, "error")]), ("m_temp0p0_run1.json", [(False, "b", "ok")]), ("other.json", [(True, "c", "ok")])):
        (tmp_path / name).write_text(json.dumps({"results": [dict(zip(("is_correct", "selected", "status"), r, strict=True)) for r in results]}))
    runs = evaluation.run_metrics(files.run_results(spark, str(tmp_path)), "temperature", "run")
    assert sorted((r["temperature"], r["run"], r["examples"], r["correct"], r["errors"]) for r in runs.collect()) == [(0.0, 1, 1, 0, 0), (0.7, 2, 2, 1, 1)]


def test_json_of_ascii_with_sorted_keys(spark):
    df = spark.createDataFrame([((("é", "🙂"), [("x", "y")]), None, "a\n\"b")], "z struct<q:struct<d:string,c:string>,p:array<struct<n:string,m:string>>>, b int, a string")
    (line,) = [r["value"] for r in sinks.json_lines(df, ascii_only=True).collect()]
    want = {"a": 'a\n"b', "b": None, "z": {"p": [{"m": "y", "n": "x"}], "q": {"c": "🙂", "d": "é"}}}
    assert json.loads(line) == want and line == json.dumps(want, sort_keys=True, separators=(",", ":"))


def test_outputs_and_states(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    given = dict(starting_id=5, split="train", citation_mode="single", citation_style="numeric", fields_of_study=None)
    sinks.fresh_outputs(spark, [out], state)
    spark.range(3).write.parquet(out)
    with pytest.raises(sinks.OutputError):
        sinks.fresh_outputs(spark, [out], state)
    assert not resume.resumed(spark, state, given) and resume.resumed(spark, state, given, {"rows": out})
    sinks.fresh_outputs(spark, [out], state)
    with pytest.raises(resume.ResumeError, match="split=train"):
        resume.resumed(spark, state, given | {"split": "test"})
    with pytest.raises(resume.ResumeError, match="fields"):
        resume.resumed(spark, state, {k: v for k, v in given.items() if k != "fields_of_study"})
    for n in (4, 5):
        backup = sinks.replaced(spark.read.parquet(out).union(spark.range(1)), out, lambda df, path: df.write.parquet(path))
        assert spark.read.parquet(out).count() == n and spark.read.parquet(backup).count() == 3
    real = sinks.renamed

    def lost(spark_, old, new):
        if old.endswith(".new"):
            raise RuntimeError("lost")
        real(spark_, old, new)

    sinks.renamed = lost
    try:
        with pytest.raises(RuntimeError, match="lost"):  # between the two renames
            sinks.replaced(spark.read.parquet(out).union(spark.range(1)), out, lambda df, path: df.write.parquet(path))
    finally:
        sinks.renamed = real
    assert not sinks.exists(spark, out) and sinks.recovered(spark, out) and spark.read.parquet(out).count() == 5
    sinks.fresh_outputs(spark, [out], state, restart=True)
    assert not sinks.exists(spark, out) and not sinks.exists(spark, state)
    with pytest.raises(resume.ResumeError, match="gone"):
        resume.resumed(spark, state, given)
        resume.resumed(spark, state, given, {"rows": out})


def test_rewards_and_matches(spark):
    df = spark.createDataFrame([("c", True, [0.2]), ("c", None, [None, 0.2, 0.7]), ("c", None, None), ("c", False, [1.0])], "s string, y boolean, r array<double>")
    reward = lambda name: df.select(evaluation.result_reward(F.col("s"), name, F.col("y"), F.col("r")).alias("x"))
    assert [r["x"] for r in reward("c").collect()] == [1.0, 0.7, 0.0, 0.0]
    with pytest.raises(Exception, match="unexpected data source"):
        reward("d").collect()
    rows = [(1, ["Nothing alike", "The cat sat", "The cat sat!"], ["Zebra", "the cat SAT", "Nothing alike"]), (2, ["x"], ["y"]), (3, [], ["y"]), (4, ["aaaa", "aaaa"], ["aaaa"])]
    got = evaluation.title_matches(spark.createDataFrame(rows, "id int, found_titles array<string>, target_titles array<string>")).collect()
    assert {r["id"]: (r["target"], r["place"], r["title"]) for r in got} == {1: (1, 1, "The cat sat"), 4: (0, 0, "aaaa")}
    record = spark.createDataFrame([(1, "k", "v", "e", 2024, "a", "b")], "id int, title_key string, venue string, excerpt string, year int, source_paper_title string, target_paper_title string")
    targets = spark.createDataFrame([(1, "k", "T")], "id int, title_key string, target_id string")
    assert evaluation.training_records(record, targets, "p").first()["reward_model"]["ground_truth"] == "T"
    with pytest.raises(Exception, match="no target id for row 1"):
        evaluation.training_records(record, targets.limit(0), "p").collect()


def test_observations(spark):
    rows = [("u", "One fox. Two FOXES ran. Three hens.", "fox"), ("u", "One.", "fox"), ("u", "", "fox"), (None, "One fox.", "fox")]
    df = spark.createDataFrame(rows, "u string, t string, n string")
    got = [r["x"] for r in df.select(evaluation.find_observation(F.col("u"), F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == ["One fox.\nTwo FOXES ran.", "No sentence found containing 'fox'.", "There was an error reading the PDF. Please try a different paper. u", "This paper does not have an open access PDF."]
    asked = spark.createDataFrame([("q", "T", "more"), ("q", None, None)], "q string, t string, c string")
    got = [r["x"] for r in asked.select(evaluation.context_observation(F.col("q"), F.col("t"), F.col("c")).alias("x")).collect()]
    assert got[0].endswith("'T' and focus query 'q':\nmore") and "Paper title: unknown. Focus query: q." in got[1]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "ai", "a"), (1, 1, "human", "h"), (1, 3, "tool", "t"), (1, 4, "noise", "n")], "trajectory_id int, turn int, kind string, content string")
    assert [tuple(m) for m in evaluation.history(turns).first()["history"]] == [("user", "h"), ("assistant", "a"), ("tool", "t")]
    assert evaluation.history(turns, keep_system=True).first()["history"][0]["role"] == "system"


@pytest.mark.parametrize("limit", [curation.BROADCAST_CHARS, 2])
def test_contained_items_equal_substrings(spark, monkeypatch, limit):
    monkeypatch.setattr(curation, "BROADCAST_CHARS", limit)
    rows = ["a b c d e", "xa b cy", "b", "", "a b", "q a b c", "a b c d e", "a  c"]
    items = ["a b c", "b", "", "a b", "b c d", "z", "a b c", "a  c"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, k string")
    table = spark.createDataFrame(list(enumerate(items)), "j int, item string")
    got = {(r["i"], r["j"]) for r in curation.contained_items(df, table, "k", "item").collect()}
    assert got == {(i, j) for i, row in enumerate(rows) for j, item in enumerate(items) if item and item in row}


def test_gates_and_pools(spark):
    rows = [("1", "v", "2025", "a [CITATION]"), ("2", "", "2025", "b [CITATION]"), ("3", "v", "2024", "c [CITATION]"), ("4", "v", "2025", "d"), ("", "v", "2025", "e [CITATION]")]
    gated, counts = curation.biomedical_gate(spark.createDataFrame(rows, "id string, venue string, year string, excerpt string"), spark.createDataFrame([("1", "x")], "id string, note string"), ["id", "excerpt"])
    assert {r["id"]: (r["reason"], r["note"]) for r in gated.collect()} == {"1": (None, "x"), "2": (None, None), "3": ("wrong_year", None), "4": ("citation_marker_count", None), "": ("missing_required_value", None)}
    assert counts.first()["n_missing_venue_kept"] == 1 and counts.first()["n_kept"] == 2
    keys = spark.createDataFrame([("e", "s", "t")], ", ".join(f"{k} string" for k in curation.KEYS))
    assert curation.pooled_keys([keys, keys, keys.withColumn("excerpt_key", F.lit("f"))]).count() == 2
    papers = spark.createDataFrame([("k", "B", 1), ("k", "A", 2), ("k", "Z", 0), ("j", "Z", 1)], "k string, v string, o int")
    assert {r["v"] for r in curation.first_in_venue_order(papers, ["k"], ["A", "B"], "v", ["o"]).collect()} == {"A", "Z"}
    assert [r["o"] for r in curation.first_rows(papers, ["o", "v"], 2).collect()] == [0, 1]


def test_small_functions(spark):
    one = spark.range(1)
    from marginalia.functions import similarity, text

    assert one.select(text.token_count(F.lit("a b, c")).alias("n"), text.token_count(F.lit("a b, c"), lambda x: F.split(x, " ")).alias("m")).first()[:2] == (4, 3)
    assert one.select(text.utc_now().alias("t")).first()["t"].endswith("+00:00")
    key = one.select(similarity.row_key(F.lit("Stra\u00dfe  X"), F.lit("A: b"), F.lit(None).cast("string")).alias("k")).first()["k"]
    assert (key["excerpt_key"], key["source_key"], key["target_key"]) == ("strasse x", "a b", None)
