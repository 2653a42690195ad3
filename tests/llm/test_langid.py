"""Language identification: plain naive Bayes, held-out accuracy, odd rows."""

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import langid, queries


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def features(word):
    """The buckets of a word's n-grams, each hashed by itself."""
    s, out = [0, *map(ord, word), 0], []
    for n in range(1, langid.ORDER + 1):
        for i in range(len(s) - n + 1):
            if n == 1 and i in (0, len(s) - 1):
                continue
            h = 0
            for x in s[i : i + n]:
                h = (h * langid.BASE + x + 1) % (1 << 64)
            out.append(int(langid.mixed(np.array([h + n & (1 << 64) - 1], np.uint64))[0] >> np.uint64(40)) % langid.BUCKETS)
    return out


def plain(rows):
    """(held_out, language, score) of (doc_id, text, lang) rows by a dictionary of counts."""
    held = [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else False for i, _, _ in rows]
    counts, docs = defaultdict(Counter), Counter()
    for h, (_, text, lang) in zip(held, rows, strict=True):
        if not h and text is not None and lang is not None and any(c.isalpha() for c in text):
            docs[lang] += 1
        if not h and text is not None and lang is not None:
            for w in words(text):
                counts[lang].update(features(w))
    out = []
    for h, (_, text, _) in zip(held, rows, strict=True):
        if not docs or not any(c.isalpha() for c in text or ""):
            out.append((h, "und", 0.0))
            continue
        seen = Counter(f for w in words(text) for f in features(w))
        logs = {}
        for lang in docs:
            total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][f] + langid.SMOOTHING) / total) for f, n in seen.items())
        best = min(logs, key=lambda x: (-logs[x], x))
        out.append((h, best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out


def test_language_equals_plain_bayes(spark, monkeypatch):
    rng = random.Random(3)
    stems = {"en": ["the", "house", "and", "Of"], "de": ["das", "Haus", "über", "und"], "hi": ["घर", "में", "का"], "ru": ["дом", "И", "на"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(stems))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(rng.choices(stems[lang] + stems["en"], k=rng.randrange(1, 6))), rng.choice([lang, lang, lang, None])))
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34!", "en"), (203, "́", "de"), (None, "das Haus", "de"), (0, rows[0][1], rows[0][2]), (204, "x" * 5000, "en"), (205, "the", "xx")]
    monkeypatch.setattr(langid, "SLICE", 200)
    df = spark.createDataFrame([(i, t, g, "a", 1.5) for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in langid.op13_language_id(df).collect())
    assert got == sorted((i if i is not None else -1, h, g, round(s, 9)) for (i, _, _), (h, g, s) in zip(rows, plain(rows), strict=True))


def test_registered_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op13_language_id"](spark, sf).collect()
    assert len(got) == len(lang)
    judged = [(r["lang_pred"], lang[r["doc_id"]]) for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(judged) > 150 and sum(a == b for a, b in judged) >= 0.97 * len(judged)


def test_nothing_to_learn_and_too_many_languages(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.op13_language_id(none).collect()] == [("und", 0.0)]
    assert langid.op13_language_id(none.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit_language(many, max_langs=3)
    assert langid.words_of(pa.array(["", None], pa.string())).distinct == 0
