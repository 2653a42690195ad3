from pyspark.sql import functions as F

from marginalia.functions import citations, identifiers, similarity, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_normalizers(spark):
    assert one(spark, " A\n Paper \x1cTest ", text.spaces) == "A Paper Test"
    assert one(spark, "A  Paper: Test!", text.compare_text) == "a paper test"
    assert one(spark, None, text.title_key) == ""
    assert one(spark, "Straße — 2", text.title_key) == "stra e 2"
    assert one(spark, "--A b/C--", text.slug) == "a-b-c"
    assert one(spark, "", text.slug) == "paper"
    assert one(spark, "exam-\nple\ntext", text.body_text) == "example text"


def test_sentences_keep_et_al(spark):
    got = one(spark, 'As X et al. Show it. "Then" more! 3 left? yes.', text.sentences)
    assert got == ["As X et al. Show it.", '"Then" more!', "3 left? yes."]


def test_queries(spark):
    e = "the quick brown fox jumps over [CITATION] lazy dogs and small cats"
    got = one(spark, e, text.discoverability_queries)
    assert got[0] == "the quick brown fox jumps over lazy dogs and small cats"
    assert got[1] == "quick brown fox jumps over lazy dogs small"
    assert got[2] == "quick brown fox jumps over lazy dogs small cats"
    assert all("CITATION" not in q for q in got)
    assert one(spark, "a b c", text.window_query) is None
    assert len(one(spark, "word " * 300, text.compact_query)) <= 180
    assert one(spark, "x" * 400, text.compact_query) == "x" * 180
    assert one(spark, 'A. B. "A quoted title here". 2020.', text.title_guess) == "A quoted title here"
    assert one(spark, "Smith, A. Learning to count sheep at night. Journal 2020", text.title_guess) == "Learning to count sheep at night"


def test_fingerprint_ignores_spacing(spark):
    assert one(spark, "a  b", text.fingerprint) == one(spark, "a b\n", text.fingerprint)


def test_python_only_functions(spark):
    assert one(spark, "  STRASSE ß ", similarity.casefold) == "strasse ss"
    assert one(spark, "ﬁne  Ⅳ-x", similarity.entity_title) == "fine iv x"
    r = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r"))
    assert [x["r"] for x in r.collect()] == [0.25, 0.5, None]
    assert one(spark, 'x {"a": 1} {"action": {"name": "read"}} {"b": 2}', similarity.last_action) == '{"action": {"name": "read"}}'
    assert one(spark, 'x {"a": {"b": 1}} y', similarity.last_json_block) == '{"a": {"b": 1}}'
    near = spark.createDataFrame([("A Study of Things",), ("Other",), (None,)], "t string").select(similarity.similar_to_any(["a study of thing"], 0.9)("t").alias("n"))
    assert [x["n"] for x in near.collect()] == [True, False, None]


def test_numeric_keys(spark):
    assert one(spark, "1, 3-5;7", citations.numeric_keys) == ["1", "3", "4", "5", "7"]
    assert one(spark, "5-3", citations.numeric_keys) == []
    assert one(spark, "1, x", citations.numeric_keys) == []


def test_author_year_keys(spark):
    assert one(spark, "Smith, A. and Lee, B. (2020a). T.", citations.author_year_key) == "smith-2020a"
    assert one(spark, "Anna Smith et al., 2021", citations.author_year_key) == "smith-2021"
    assert one(spark, "no year", citations.author_year_key) is None
    assert one(spark, "X, 2020; bad", citations.author_year_keys) == []


def test_body_split(spark):
    s = "Title\nReferences\n" + "b" * 3000 + "\n5 References\n[1] A\nAppendix"
    got = one(spark, s, citations.body_and_references)
    assert got["body"].endswith("b" * 3000) and got["refs"] == "[1] A\nAppendix"
    early = one(spark, "x\nReferences\n[1] A", citations.body_and_references)
    assert early["body"] == "x" and early["refs"] == "[1] A"
    assert one(spark, "nothing here", citations.body_and_references)["refs"] == ""


def test_reference_maps(spark):
    docs = spark.createDataFrame([("p", "skip\n[1] First\n  goes on\n2. Second\n[1] Again\n[3]")], "k string, refs string")
    assert sorted((r["reference_key"], r["reference_text"]) for r in citations.numeric_reference_map(docs, "k", "refs").collect()) == [("1", "Again"), ("2", "Second")]
    entries = "Smith, A. and Lee, B. 2020. One thing. Jones, C. and Ray, D. 2019. Other.\nSmith, Z. and Old, Y. 2020. Clash."
    docs = spark.createDataFrame([("p", entries)], "k string, refs string")
    assert [r["reference_key"] for r in citations.author_year_reference_map(docs, "k", "refs").collect()] == ["jones-2019"]


def test_leakage(spark):
    rows = [("[3] Smith John, Doe Jane. Title.", "x", True), ("[12] We show that this works well.", "x", False), ("This is a longer sentence that the entry has too", "[1] This is a longer sentence that the entry has too", True)]
    got = spark.createDataFrame([r[:2] for r in rows], "s string, r string").select(citations.reference_leakage(F.col("s"), F.col("r")).alias("y")).collect()
    assert [g["y"] for g in got] == [r[2] for r in rows]


def test_citing_sentences(spark):
    body = "It was shown before by many other people [2,3]. This is a claim that was made by one [1]. An unknown one stands in this sentence over here [9]. Too short [1]. And ranges are written out in such a long sentence [4-5]."
    docs = spark.createDataFrame([("p", body)], "k string, body string")
    refs = spark.createDataFrame([("p", str(i), f"Entry {i}") for i in range(1, 6)], "k string, reference_key string, reference_text string")
    single = citations.citing_sentences(docs, refs, "k", "body").collect()
    assert [(r["body_sentence_index"], r["excerpt"]) for r in single] == [(1, "This is a claim that was made by one [CITATION].")]
    multi = citations.citing_sentences(docs, refs, "k", "body", mode="multi").collect()
    assert len(multi) == 4 and all(r["citation_count"] == 2 for r in multi)
    assert any(r["excerpt"].endswith("[CITATION, 3].") for r in multi) and any(r["excerpt"].endswith("[4, CITATION].") for r in multi)


def test_author_year_sentences(spark):
    body = "Smith et al. (2019) have shown that long sentences are read by few people. Others (Jones, 2020; Lee and Kim, 2018) disagree with nearly all of what they have written."
    docs = spark.createDataFrame([("p", body)], "k string, body string")
    refs = spark.createDataFrame([("p", k, k) for k in ("smith-2019", "jones-2020", "lee-2018")], "k string, reference_key string, reference_text string")
    got = {r["reference_key"]: r["excerpt"] for r in citations.citing_sentences(docs, refs, "k", "body", "author_year", "any").collect()}
    assert got["smith-2019"].startswith("[CITATION] have shown")
    assert "([CITATION]; Lee and Kim, 2018)" in got["jones-2020"] and "(Jones, 2020; [CITATION])" in got["lee-2018"]


def test_author_year_groups(spark):
    """Places, overlaps, repeated markers, segments without a key and unknown keys."""
    known = ["smith-2019", "jones-2020", "lee-2018", "lee-2018a"]
    cases = [
        ("Lee (2018) and (Jones, 2020) and Lee (2018).", [("Lee (2018)", ["lee-2018"], "replace"), ("Lee (2018)", ["lee-2018"], "replace"), ("(Jones, 2020)", ["jones-2020"], "parens")]),
        ("(see Smith 2019; Lee and Kim 2018a)", [("(see Smith 2019; Lee and Kim 2018a)", ["smith-2019", "lee-2018a"], "parens")]),
        ("(Unknown, 2020; Jones, 2020) but Smith et al. (2019)", [("Smith et al. (2019)", ["smith-2019"], "replace")]),
        ("(2019) alone and (no year)", []),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, s, known) for i, (s, _) in enumerate(cases)], "i int, s string, k array<string>")
    got = {r["i"]: r["g"] for r in df.select("i", citations.author_year_groups(F.col("s"), F.col("k")).alias("g")).collect()}
    for i, (s, want) in enumerate(cases):
        assert [(g["marker"], g["keys"], g["wrapper"]) for g in got[i] or []] == want, s
    assert got[1][0]["segments"] == ["see Smith 2019", "Lee and Kim 2018a"] and got[0][0]["segments"] == ["[CITATION]"]


def test_abbreviation_ends_no_sentence(spark):
    written = "As Lee et al. Have shown. ET AL. Said so too. The zet al. Ends one."
    assert one(spark, written, text.sentences) == ["As Lee et al. Have shown.", "ET AL. Said so too.", "The zet al.", "Ends one."]


def test_identifiers(spark):
    rows = [("p1", {"DOI": "10.1/X"}, "https://a.b/", t) for t in ("P1", "doi:10.1/x", "URL:https://a.b", "", "other", "mag:1")]
    got = spark.createDataFrame(rows, "p string, e map<string,string>, u string, t string").select(identifiers.identifier_matches(F.col("p"), F.col("e"), F.col("u"), F.col("t")).alias("y")).collect()
    assert [g["y"] for g in got] == [True, True, True, False, False, False]
    assert one(spark, "https://h/a/B.pdf/?x=1", identifiers.link_target) == "/a/b"
    assert one(spark, "https://h/paper_files/paper/2023/hash/ab-Abstract-Datasets_Track.html", identifiers.derived_pdf_url).endswith("/file/ab-Paper-Datasets_Track.pdf")
