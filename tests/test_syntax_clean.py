import time

import pytest
from pyspark.sql import functions as F

from penmark.operators import annotate, clean, clean_rules, syntax


def tokens_df(spark, rows):
    return spark.createDataFrame(rows, "article_id long, sent_id long, tok_id long, text string, pos string, "
                                       "dep string, head_id long")


def test_dependency_depth_cases(spark):
    toks = tokens_df(spark, [
        (1, 0, 0, "a", "NOUN", "ROOT", 0),                                   # one token -> 0
        (2, 0, 0, "a", "NOUN", "ROOT", 0), (2, 0, 1, "b", "NOUN", "dep", 0),   # root + child -> 2
        (3, 0, 0, "a", "NOUN", "ROOT", 0), (3, 0, 1, "b", "NOUN", "dep", 0), (3, 0, 2, "c", "NOUN", "dep", 1),
        (4, 0, 0, "a", "NOUN", "ROOT", 0),
        (4, 1, 0, "a", "NOUN", "ROOT", 0), (4, 1, 1, "b", "NOUN", "dep", 0), (4, 1, 2, "c", "NOUN", "dep", 1),
    ])
    sents = toks.select("article_id", "sent_id", F.lit("x.").alias("text")).distinct()
    got = {r.article_id: r.avg_dependency_depth for r in syntax.sentence_features(syntax.from_tables(sents, toks)).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 3.0, 4: 1.5}


def test_dependency_depth_of_a_long_sentence(spark):
    n = 5000
    chain = spark.range(n).select(F.lit(1).alias("article_id"), F.lit(0).alias("sent_id"), F.col("id").alias("tok_id"),
                                  F.lit("a").alias("text"), F.lit("NOUN").alias("pos"),
                                  F.when(F.col("id") == 0, "ROOT").otherwise("dep").alias("dep"),
                                  F.greatest(F.col("id") - 1, F.lit(0)).alias("head_id"))
    tree = chain.withColumn("article_id", F.lit(2)).withColumn("head_id", F.floor(F.col("tok_id") / 2))
    toks = chain.unionByName(tree)
    sents = toks.select("article_id", "sent_id", F.lit("x.").alias("text")).distinct()
    got = {r.article_id: r.avg_dependency_depth for r in syntax.sentence_features(syntax.from_tables(sents, toks)).collect()}
    assert got == {1: float(n), 2: 1.0 + (n - 1).bit_length()}


def test_standin_reads_whole_sentences(spark):
    docs = spark.createDataFrame([(1, " ".join(["word"] * 300) + ".")], "doc_id long, text string")
    assert annotate.tokens(syntax.annotate_standin(docs)).count() == 300


def test_many_urls_without_an_end_are_linear(spark):
    body = "see http://x.example/page\n" * 20_000
    t0 = time.time()
    assert one(spark, lambda d: clean.strip_html_urls("t"), body) == body
    assert one(spark, lambda d: clean.capture_url("t", "a"), body) == ""
    text = "a http://x.example/1.html\nb www.y.example/2\n3.html\n" + body
    assert one(spark, lambda d: clean.strip_html_urls("t"), text) == "a b " + body
    assert one(spark, lambda d: clean.capture_url("t", "a"), text) == "http://x.example/1.html"
    assert time.time() - t0 < 30


def test_entity_frequencies(spark):
    ents = spark.createDataFrame([(1, "e1", "PERSON"), (1, "e2", "PERSON"), (1, "e3", "ORG")],
                                 "article_id long, ent_id string, label string")
    got = {r.tag: r.freq for r in syntax.entity_frequencies(ents).collect()}
    assert abs(got["PERSON"] - 2 / 3) < 1e-9 and abs(got["ORG"] - 1 / 3) < 1e-9


def one(spark, fn, text, names=None):
    df = spark.createDataFrame([(text, names or [])], "t string, names array<string>")
    return df.select(fn(df).alias("y")).first()["y"]


def test_author_bios(spark):
    text = "body\nAnn Lee writes.\nBo Ray writes."
    assert one(spark, lambda d: clean.strip_author_bios("t", "names"), text, ["Ann Lee", "Bo Ray"]) == "body"
    # a name never seen: the walk reaches the top; cut at the topmost hit
    text2 = "intro\nAnn Lee said\nmiddle\nend"
    assert one(spark, lambda d: clean.strip_author_bios("t", "names"), text2, ["Ann Lee", "Bo Ray"]) == "intro"


def test_header_a_and_contribution(spark):
    t = "Section\nBy Ann Lee\nSummary\nJanuary 5, 2025\nUpdated today\nBody line.\n"
    assert one(spark, lambda d: clean.header_a("t"), t) == "Body line.\n"
    c = "Body.\nBo Ray contributed to this report.\n\n"
    assert one(spark, lambda d: clean.strip_contribution("t"), c) == "Body."


def test_header_c_and_pubdate(spark):
    t = "Motto\nMarch 3, 2025\nBy Ann Lee\nBody\n"
    assert one(spark, lambda d: clean.header_c("t"), t) == "Body\n"
    df = spark.createDataFrame([("March 3, 2025\n",), ("JANUARY 5 2025",), ("",)], "d string")
    got = [tuple(r) for r in df.select(clean.pubdate("d", "a"), clean.pubdate("d", "b")).collect()]
    assert got == [("3/3/2025", "3/3/2025"), (None, "1/5/2025"), (None, None)]


def test_a_new_publisher_is_rows(spark):
    rows = [("d", "genre", 0, "folder", "Herald"), ("d", "date", 0, "extract", clean.DATE_A), ("d", "byline", 0, "extract_group", r"(?m)^Words: (.*)$"),
            ("d", "url", 0, "constant", "none"), ("d", "title", 0, "input", "title_in| | Herald"), ("d", "text", 2, "remove", r"\[ad\]"),
            ("d", "text", 1, "cut_through", "Words:"), ("d", "text", 3, "remove_text", "THE END")]
    table = clean_rules.to_table(spark, clean.RULES).union(spark.createDataFrame(rows, clean_rules.SCHEMA))
    rules = clean_rules.from_table(table)
    pages = spark.createDataFrame([("texts/NotNYT/Herald/1.pdf", "Big day | Herald", "May 1, 2025\nWords: Ann Lee\nBody [ad]text.\nTHE END"),
                                   ("texts/NYT/news/2.pdf", "T - The New York Times", "By Bo Ray\nJanuary 5, 2025\nBody of Bo Ray.\nmore\n"),
                                   ("texts/Other/x/3.pdf", "t", "text")], "path string, title string, page_text string")
    got = {r.path: r for r in clean.clean_all(pages, rules=rules).collect()}
    d = got["texts/NotNYT/Herald/1.pdf"]
    assert (d.layout, d.author, d.clean_title, d.clean_text, d.url) == ("d", "Ann Lee", "Big day", "Body text.", "none")
    plain = {r.path: r for r in clean.clean_all(pages).collect()}
    assert got["texts/NYT/news/2.pdf"] == plain["texts/NYT/news/2.pdf"] and got["texts/NYT/news/2.pdf"].layout == "a"
    assert plain["texts/NotNYT/Herald/1.pdf"].layout is None and got["texts/Other/x/3.pdf"].clean_text is None


def test_wrong_rules_are_refused(spark):
    for bad in (("e", "text", 1, "explode", ""), ("e", "text", 1, "built_in", "nothing"), ("e", "nowhere", 0, "constant", ""), ("e", "date", 0, "constant", "")):
        with pytest.raises(ValueError):
            clean_rules.checked([*clean.RULES, clean_rules.Rule(*bad)])
