"""Reading the input tables and deriving the article view from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.session import apply_runtime_conf

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

INPUT_PARTITIONS = "spark.penmark.inputPartitions"

# --- FIXED VALUES: text prefix that adds a URL, an apostrophe and a contraction ---
STYLE_PREFIX = "See http://x.example/a?b=1 don't cannot "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan."""
    apply_runtime_conf(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` over as many partitions as the session's
    ``spark.penmark.inputPartitions`` says; without that setting the scan's own splits stay.
    For test files of one row group, which would otherwise be one task."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def styled_text(doc_id="doc_id", text="text"):
    """Raw text with blank-line paragraphs, questions on every third document,
    and a prefix carrying a URL, an apostrophe and a contraction."""
    paras = F.replace(F.col(text), F.lit("\n"), F.lit("\n\n"))
    body = F.when(F.col(doc_id) % 3 == 0, F.regexp_replace(paras, r"\.", "?")).otherwise(paras)
    return F.concat(F.lit(STYLE_PREFIX), body)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table of the reference, derived from ``documents``.

    article_id = doc_id; Source = source; Genre = lang; Author = source/lang;
    NYT (is_target) = source number below 10; title = first five words of the
    first line; PubDate text = M/D/2025 from the id, 'bad' for every 17th id.
    """
    d = documents(spark, sf_dir)
    pub = F.when(F.col("doc_id") % 17 == 0, F.lit("bad")).otherwise(
        F.concat_ws("/", (F.col("doc_id") % 12 + 1).cast("string"),
                    (F.col("doc_id") % 28 + 1).cast("string"), F.lit("2025")))
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.concat_ws("/", "source", "lang").alias("author"),
        F.col("source"),
        (F.substring("source", 4, 100).try_cast("int") < 10).alias("is_target"),
        F.col("lang").alias("genre"),
        pub.alias("pub_date_raw"),
        T.first_words("text", 5).alias("title"),
        F.col("text"),
    )


# --- FIXED VALUES: page fixtures for the three cleaning layouts ---
FURNITURE_BLOCK = "1/5/25, 10:02 AM\nTitle\nhttps://x.example/a.html\n1/9\n"


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed-page stand-ins built from ``documents``: every document is laid
    out as page text of layout a, b or c (by id), with header, page
    furniture, captions, notices and author lines around the real text;
    every 7th id has an unknown publisher folder."""
    d = documents(spark, sf_dir)
    did = F.col("doc_id").cast("string")
    day = (F.col("doc_id") % 28 + 1).cast("string")
    base = T.first_words("text", 5)
    lay = F.when(F.col("doc_id") % 7 == 6, F.lit("x")).otherwise(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int")))
    path = (F.when(lay == "a", F.concat(F.lit("texts/NYT/"), F.col("lang"), F.lit("/"), did, F.lit(".pdf")))
            .when(lay == "b", F.concat(F.lit("texts/NotNYT/FinancialTimes/"), did, F.lit(".pdf")))
            .when(lay == "c", F.concat(F.lit("texts/NotNYT/WashingtonPost/"), did, F.lit(".pdf")))
            .otherwise(F.concat(F.lit("texts/NotNYT/Other/"), did, F.lit(".pdf"))))
    title = (F.when(lay == "a", F.concat(base, F.lit(" - The New York Times")))
             .when(lay == "c", F.concat(base, F.lit(" - The Washington Post"))).otherwise(base))
    page_a = F.concat(F.lit("Section\nhttps://x.example/story/"), did, F.lit(".html\nBy Ann Lee and Bo Ray\nSummary\n"
                      "January "), day, F.lit(", 2025\nUpdated today\n" + FURNITURE_BLOCK), base, F.lit("\n"),
                      F.col("text"), F.lit("\nPhoto by Cy Doe for The New York Times\nAnn Lee reports from Paris.\n"
                                           "Bo Ray edits the desk.\n"))
    page_b = F.concat(F.lit("Front page\n"), base, F.lit("\ncover note\n1/5/25, 10:02 AM\nAnn Lee in Paris\n"
                      "Published JANUARY "), day, F.lit(" 2025\nhttps://x.example/b/"), did, F.lit(" more\n"),
                      F.col("text"), F.lit("\nPhoto © Agency\nCopyright The Financial Times Limited 2025. "
                                           "All rights reserved. tail\n"))
    readers = F.when(F.col("doc_id") % 5 == 0, F.lit("What readers are saying\nmany things\n")).otherwise(F.lit(""))
    page_c = F.concat(F.lit("Motto\nMarch "), day, F.lit(", 2025\nUpdated later\nBy Ann Lee\n"), base, F.lit("\n"),
                      F.col("text"), F.lit("\nDemocracy Dies in Darkness\nBo Ray contributed to this report.\n"),
                      readers)
    page = F.when(lay == "a", page_a).when(lay == "b", page_b).otherwise(page_c)
    return d.select("doc_id", path.alias("path"), title.alias("title"), page.alias("page_text"))
