"""Registered queries for n-grams, TF-IDF and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.operators import fitstate, ngrams
from penmark.plans.registry import query, rounded
from penmark.sources import files, tables


@query("ngrams")
def ngram_digest(spark, sf_dir):
    """Number of uni+bigrams per document and a digest of the sequence."""
    d = tables.documents(spark, sf_dir)
    g = ngrams.with_ngrams(d.select("doc_id", "text"), "text")
    return g.select("doc_id", F.size(ngrams.GRAMS).cast("bigint").alias("n_grams"),
                    F.md5(F.array_join(ngrams.GRAMS, "|")).alias("grams_md5"))


@query("vocab_topk")
def vocab_topk(spark, sf_dir):
    """The 500-term vocabulary with corpus/document frequency and idf."""
    terms, n = ngrams.frequent_terms(tables.documents(spark, sf_dir), "text", 500)
    v = spark.createDataFrame(terms, "term string, cf bigint, df bigint")
    idf = F.log(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return rounded(v.select("term", "cf", "df", idf.alias("idf")))


@query("merged_vocabulary")
def merged_vocabulary(spark, sf_dir):
    """N3 from merged fits: three batches are fitted on their own, the first two merged
    and stored, and the third merged into what is read back; the vocabulary of all documents."""
    d = tables.documents(spark, sf_dir).select("doc_id", "text")
    states = [fitstate.TermState.of(d.where(F.col("doc_id") % 3 == i)) for i in range(3)]
    path = files.scratch_path(spark, "terms")
    states[0].merge(states[1]).save(path)
    model = fitstate.TermState.load(spark, path).merge(states[2]).model(500)
    return rounded(model.table(spark).select("term", "idf"))


@query("tfidf")
def tfidf(spark, sf_dir):
    """Normalised TF-IDF weights of every document, sparse long form."""
    d = tables.documents(spark, sf_dir).select("doc_id", "text")
    model = ngrams.fit(d, "text", 500)
    vec = model.transform(d, "text")
    return rounded(ngrams.long_weights(vec, model, "doc_id"))


@query("tfidf_transform")
def tfidf_transform(spark, sf_dir):
    """Benchmark texts weighted with the vocabulary fitted on documents."""
    d = tables.documents(spark, sf_dir).select("doc_id", "text")
    model = ngrams.fit(d, "text", 500)
    b = tables.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return rounded(ngrams.long_weights(model.transform(b, "text"), model, "item_id"))
