import hashlib
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as engine
from marginalia.functions import text
from marginalia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rel.fetchall())


def rows_of(duck, sql):
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    return [dict(zip(names, r, strict=True)) for r in rel.fetchall()]


def test_folded_keys(spark, duck):
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(duck, "SELECT doc_id, text FROM documents")}
    got = {r["doc_id"]: r for r in catalogue.QUERIES["folded_keys"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert got[i]["folded"] == " ".join(t.split()).casefold()
        assert got[i]["entity"] == " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()))


def test_title_ratio(spark, duck):
    lines = {r["doc_id"]: (r["text"] or "").split("\n") for r in rows_of(duck, "SELECT doc_id, text FROM documents")}
    got = {r["doc_id"]: r for r in catalogue.QUERIES["title_ratio"](spark, SF).collect()}
    assert len(got) == len(lines)
    for i, ls in lines.items():
        assert got[i]["ratio"] == pytest.approx(SequenceMatcher(None, ls[0], ls[-1]).ratio())
        assert got[i]["similar"] == (SequenceMatcher(None, ls[0].lower(), ls[-1].lower()).ratio() > 0.5)


def test_reference_resolution(spark, duck):
    """Search, scores and the choice in plain Python over the registered query's tables."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    content = lambda x: [w for w in words(x) if w not in text.STOPWORDS]
    bare = lambda x: " ".join(re.sub(r"[^a-z0-9\s]", " ", x.lower()).split())
    items = rows_of(duck, "SELECT item_id, text FROM benchmark")
    papers = [(f"b{r['item_id']}", r["text"], 2000 + r["item_id"] % 25) for r in items]
    papers += [(str(r["doc_id"]), (r["text"] or "").split("\n")[0], 2000 + r["n_chars"] % 25) for r in rows_of(duck, "SELECT doc_id, text, n_chars FROM documents")]
    tokens = {p: set(content(t)) for p, t, _ in papers}
    entries = [(r["item_id"], f"Smith, A. and Lee, B. {2000 + r['item_id'] % 25}. {r['text']}") for r in items]
    df = spark.createDataFrame(entries, "i long, t string").select("i", text.resolution_queries(F.col("t")).alias("q"))
    queries = {r["i"]: r["q"] for r in df.collect()}
    want = {}
    for i, entry in entries:
        best = None
        for at, query in enumerate(queries[i]):
            asked = set(content(query))
            near = sorted(((-len(asked & tokens[p]) / len(asked), p) for p, _, _ in papers if asked & tokens[p]))[:10]
            for rank, (_, p) in enumerate(near):
                title, year = next((t, y) for q, t, y in papers if q == p)
                if i % 3 == 0 and bare(title) == bare(entry.partition(". ")[2].partition(". ")[2].partition(". ")[2]):
                    continue
                own = {w for w in bare(title).split() if len(w) > 2}
                score = 0.7 * len(own & set(bare(entry).split())) / max(len(own), 1) + 0.3 * SequenceMatcher(None, bare(title), bare(entry)).ratio()
                found = re.search(r"\b(?:19|20)\d{2}[a-z]?\b", entry)
                away = abs(year - int(found[0][:4]))
                score += 0.05 if str(year) in entry else -min(0.10, 0.02 * (away - 1)) if away > 1 else 0
                if title and (best is None or (score, -at, -rank) > best[:3]):
                    best = (score, -at, -rank, p, query)
        if best and best[0] >= 0.55:
            want[i] = (best[3], best[4], round(best[0], 6))
    got = {r["reference_id"]: (r["paper_id"], r["query"], round(r["score"], 6)) for r in catalogue.QUERIES["reference_resolution"](spark, SF).collect()}
    assert got == want and 20 < len(want) < len(items)


def test_greedy_queries(spark, duck):
    """Ten of each language by plain greedy picks, and six held out of each."""
    rows = [r | {"score": hashlib.sha256("\x1f".join([str(catalogue.SEED), r["lang"], r["source"], str(r["doc_id"])]).encode()).hexdigest(), "target": " ".join(re.findall("[a-z0-9]+", (r["text"] or "").split("\n")[-1].lower()))} for r in rows_of(duck, "SELECT * FROM documents ORDER BY doc_id")]
    first = {}
    for r in rows:
        first.setdefault(" ".join((r["text"] or "").split()).lower(), r)
    picked = {(r["venue"], r["doc_id"]): r["pick"] for r in catalogue.QUERIES["diverse_sample_greedy"](spark, SF).collect()}
    held = {r["doc_id"] for r in catalogue.QUERIES["holdout_disjoint"](spark, SF).filter("split = 'validation'").collect()}
    for lang in {r["lang"] for r in rows}:
        left, s, t = [r for r in first.values() if r["lang"] == lang], Counter(), Counter()
        for k in range(10):
            r = min(left, key=lambda r: (s[r["source"]], t[r["target"]], r["score"], r["doc_id"]))
            left.remove(r)
            s[r["source"]] += 1
            t[r["target"]] += 1
            assert picked[lang, r["doc_id"]] == k
        own = [r for r in rows if r["lang"] == lang]
        many_s, many_t = Counter(r["source"] for r in own), Counter(r["target"] for r in own)
        own.sort(key=lambda r: (many_s[r["source"]], many_t[r["target"]], r["score"], r["doc_id"]))
        kept = []
        for r in own:
            if len(kept) < 6 and all(r["source"] != h["source"] and r["target"] != h["target"] for h in kept):
                kept.append(r)
        kept += [r for r in own if r not in kept][: 6 - len(kept)]
        assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in own if r["doc_id"] in held}


def test_every_query_is_checked():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"folded_keys", "title_ratio", "reference_resolution", "diverse_sample_greedy", "holdout_disjoint", "trajectory_observations"}


def test_entry(spark):
    assert engine.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(engine.queries())
