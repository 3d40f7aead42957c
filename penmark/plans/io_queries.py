"""Registered queries for loading, typing, projection and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions.lexicons import LEXICAL_FEATURES
from penmark.operators import basic, clean, prep, syntax
from penmark.plans.registry import query, rounded
from penmark.sources import files, tables


def _reference_shaped(spark, sf_dir):
    """The article table under the reference's column names."""
    a = tables.articles(spark, sf_dir)
    return a.select(F.col("article_id"), F.col("author").alias("Author"), F.col("source").alias("Source"),
                    F.when(F.col("is_target"), F.lit("1")).otherwise(F.lit("0")).alias("NYT"),
                    F.col("genre").alias("Genre"), F.col("pub_date_raw").alias("PubDate"),
                    F.col("title").alias("Article Title"), F.col("text").alias("Article Text"),
                    F.lit("NA").alias("URL"))


@query("sink_roundtrip")
def sink_roundtrip(spark, sf_dir):
    """S6 + S1: articles written as multi-line CSV (fixed column order) and
    scanned back with the article schema; texts come back intact."""
    ref = _reference_shaped(spark, sf_dir)
    path = files.write_csv(ref.drop("article_id"), files.scratch_path(spark, "articles-csv"),
                           files.ARTICLE_COLUMNS)
    back = files.read_articles_csv(spark, path)
    files.require_columns(back)
    tc = files.text_column(back)
    return back.select(F.col("Source").alias("source"), F.col("Article Title").alias("title"),
                       F.length(tc).cast("bigint").alias("n_chars"), F.md5(tc).alias("text_md5"))


@query("load_typed")
def load_typed(spark, sf_dir):
    """P1 + P2: typed article table (date or NULL, boolean target)."""
    ref = _reference_shaped(spark, sf_dir)
    return ref.select("article_id", F.col("Source").alias("source"),
                      (F.col("NYT").try_cast("int") == 1).alias("is_target"),
                      clean.coerce_date("PubDate").alias("pub_date"))


@query("numeric_coerce")
def numeric_coerce(spark, sf_dir):
    """Text -> DOUBLE, unparseable or not a number -> NULL."""
    d = tables.documents(spark, sf_dir)
    s = (F.when(F.col("doc_id") % 5 == 0, F.col("lang")).when(F.col("doc_id") % 7 == 0, "nan")
         .when(F.col("doc_id") % 7 == 1, " NaN").otherwise(F.col("n_chars").cast("string")))
    return d.select("doc_id", s.alias("raw"), prep.coerce_number(s).alias("value"))


@query("filter_source")
def filter_source(spark, sf_dir):
    """Articles of one source."""
    a = tables.articles(spark, sf_dir)
    return a.where(F.col("source") == "src0").select("article_id", "title")


@query("binary_label")
def binary_label(spark, sf_dir):
    """1 for the target source, else 0."""
    a = tables.articles(spark, sf_dir)
    return a.select("article_id", F.when(F.col("is_target"), F.lit(1)).otherwise(F.lit(0)).alias("label"))


@query("concat_pages")
def concat_pages(spark, sf_dir):
    """Conversation turns as pages of one document."""
    c = tables.table(spark, sf_dir, "conversations")
    out = files.concat_pages(c, "conv_id", "turn", "text")
    return out.select("conv_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("join_features")
def join_features(spark, sf_dir):
    """P8 + J1 + J2: the wide table, article columns joined to the basic features, the
    syntax features and the tag frequencies on the article id."""
    from penmark.plans.syntax_queries import annotated, article_tag_table, styled_documents
    docs, sents = styled_documents(spark, sf_dir).withColumnRenamed("doc_id", "article_id"), annotated(spark, sf_dir)
    art = tables.articles(spark, sf_dir).select("article_id", "source", "genre", "title")
    b = basic.basic_features(docs, keep=["article_id"], mode="normalized")
    return rounded(art.join(b, "article_id").join(syntax.syntax_features(docs, sents), "article_id")
                   .join(article_tag_table(docs, sents), "article_id"))


@query("feature_projection")
def feature_projection(spark, sf_dir):
    """The feature columns of a table, by exclusion of the metadata names."""
    f = basic.extract(_reference_shaped(spark, sf_dir), "Article Text", families=["lexical", "readability"],
                      keep=["article_id", "Author", "Source", "Genre", "Article Title"], mode="normalized")
    return rounded(f.select("article_id", *prep.feature_columns(f, ["article_id"])))


@query("align_features")
def align_features(spark, sf_dir):
    """K3: align a frame to an expected feature list by name (missing -> 0,
    extra dropped)."""
    d = tables.documents(spark, sf_dir)
    f = basic.extract(d, keep=["doc_id"], families=["lexical", "punctuation"], mode="normalized")
    expected = ["doc_id"] + LEXICAL_FEATURES + ["pos_NOUN_freq", "word_ngram_0"]
    return rounded(prep.align_by_name(f, expected))


@query("union_features")
def union_features(spark, sf_dir):
    """Wide tag frequencies of two batches with different tag sets (the
    second annotator knows no SCONJ), unioned by name: the missing tag is NULL there."""
    from penmark.operators import annotate, standin
    from penmark.plans.syntax_queries import annotated
    tokens = annotate.token_field(annotated(spark, sf_dir), "pos")
    frames = []
    for parity, tags in enumerate((standin.POS, standin.POS[:-1])):
        frames.append(syntax.wide_tags(tokens.where(F.col("article_id") % 2 == parity), "pos", "pos_", "_freq", tags))
    return rounded(prep.union_features(frames))
