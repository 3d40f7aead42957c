from pyspark.sql import functions as F

from penmark.operators import clean, stats
from penmark.sources import tables


def one(spark, fn, text, title=""):
    df = spark.createDataFrame([(text, title)], "t string, title string")
    return df.select(fn().alias("y")).first()["y"]


def test_header_b_title_page_and_tail(spark):
    t = "Front\nBig News Today\ncover note\n1/5/25, 10:02 AM\nAnn Lee in Paris\nPublished JANUARY 5 2025\nBody.\n"
    assert one(spark, lambda: clean.header_b("t"), t) == "Body.\n"
    assert one(spark, lambda: clean.strip_title_page("t", "title"), t, "Big News Today") == t.replace("cover note\n", "", 1)
    tail = "Body.\nCopyright The Financial Times Limited 2025. All rights reserved. x\ny"
    assert one(spark, lambda: clean.truncate_tail("t", "b"), tail) == "Body.\n"


def test_captions_and_title(spark):
    t = "Intro\nPhoto by Cy Doe for The New York Times\nBody\n"
    assert one(spark, lambda: clean.strip_captions("t", "a"), t) == "Intro\n\nBody\n"
    assert one(spark, lambda: clean.strip_captions("t", "b"), "a\nx © y\nb") == "a\nb"
    assert one(spark, lambda: clean.strip_title("t", "title"), "Big  News\nToday\nBody", "Big News Today") == "Body"


def test_clean_articles_dispatch_keeps_unknown(spark):
    rows = [("texts/NYT/en/1.pdf", "T - The New York Times", "By Ann Lee\nJanuary 5, 2025\nBody text.\n"),
            ("texts/NotNYT/Other/2.pdf", "T", "x")]
    df = spark.createDataFrame(rows, "path string, title string, page_text string")
    out, rejects = clean.clean_articles(df)
    r = out.first()
    assert (r.layout, r.author, r.pub_date, r.clean_text, r.is_target) == ("a", "Ann Lee", "1/5/2025", "Body text.", "1")
    assert rejects.count() == 1


def test_mean_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, float("nan"))], "id int, x double")
    got = {r.id: r.x for r in stats.mean_fill(df, ["x"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0}
    g = stats.filled_group_means(df.withColumn("g", F.lit("a")), "g", ["x"]).first()
    assert g.x == 2.0


def test_spread_only_on_request(spark):
    small = spark.range(100).coalesce(1)
    assert tables.spread(small, "id").rdd.getNumPartitions() == 1
    spark.conf.set(tables.INPUT_PARTITIONS, "6")
    try:
        assert tables.spread(small, "id").rdd.getNumPartitions() == 6
    finally:
        spark.conf.unset(tables.INPUT_PARTITIONS)
