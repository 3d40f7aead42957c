"""Registered queries for the text functions, basic features and group stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.operators import basic, stats
from penmark.plans import shared
from penmark.plans.registry import query, rounded
from penmark.sources import tables


def _styled(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return d.select("doc_id", tables.styled_text().alias("text"))


@query("mean_by_source")
def mean_by_source(spark, sf_dir):
    """Mean of the ten report features per source (G2 after G4)."""
    art = tables.articles(spark, sf_dir)
    feats = basic.extract(art, keep=["article_id", "source"],
                          families=["lexical", "function_words"], mode="normalized")
    sel = stats.select_features(feats)
    return rounded(stats.filled_group_means(feats, "source", sel))


@query("basic_features")
def basic_features(spark, sf_dir):
    """All 88 basic features of every document (reference pipeline: normalised text)."""
    d = tables.documents(spark, sf_dir)
    return rounded(basic.basic_features(d, keep=["doc_id"], mode="normalized"))


@query("lexical_features")
def lexical_features(spark, sf_dir):
    return rounded(basic.lexical_features(_styled(spark, sf_dir), keep=["doc_id"], mode="normalized"))


@query("function_words")
def function_words(spark, sf_dir):
    return rounded(basic.function_word_features(_styled(spark, sf_dir), keep=["doc_id"], mode="normalized"))


@query("readability")
def readability(spark, sf_dir):
    return rounded(basic.readability_features(_styled(spark, sf_dir), keep=["doc_id"], mode="raw"))


@query("punct_features")
def punct_features(spark, sf_dir):
    return rounded(basic.punctuation_features(_styled(spark, sf_dir), keep=["doc_id"], mode="raw"))


@query("structure_features")
def structure_features(spark, sf_dir):
    return rounded(basic.structure_features(_styled(spark, sf_dir), keep=["doc_id"], mode="raw"))


@query("raw_basic_features")
def raw_basic_features(spark, sf_dir):
    """The four families that do not need Treebank tokens, on raw text."""
    return rounded(basic.extract(_styled(spark, sf_dir), keep=["doc_id"], mode="raw",
                                 families=["function_words", "readability", "punctuation", "structure"]))


@query("normalize_text")
def normalize_text(spark, sf_dir):
    return _styled(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("norm_text"))


def _array_digest(df, arr, n_name, h_name, sep=" "):
    return df.select("doc_id", F.size(arr).cast("bigint").alias(n_name),
                     F.md5(F.array_join(arr, sep)).alias(h_name))


@query("word_tokens")
def word_tokens(spark, sf_dir):
    s = _styled(spark, sf_dir)
    return _array_digest(s, T.word_tokens("text"), "n_words", "words_md5")


@query("treebank_tokens")
def treebank_tokens(spark, sf_dir):
    s = _styled(spark, sf_dir)
    return _array_digest(s, T.treebank_tokens(T.normalize_text("text")), "n_tokens", "tokens_md5")


@query("sentences")
def sentences(spark, sf_dir):
    s = _styled(spark, sf_dir)
    return _array_digest(s, T.sentence_pieces("text"), "n_sentences", "sentences_md5", "|")


@query("quote_spans")
def quote_spans(spark, sf_dir):
    s = _styled(spark, sf_dir)
    return _array_digest(s, T.quote_spans("text"), "n_quotes", "quotes_md5", "|")


@query("stopword_filter")
def stopword_filter(spark, sf_dir):
    s = _styled(spark, sf_dir)
    toks = T.without_stopwords(T.treebank_tokens(T.normalize_text("text")))
    return _array_digest(s, toks, "n_content_tokens", "content_md5")


@query("term_counts")
def term_counts(spark, sf_dir):
    """Corpus frequency of every lower-cased word."""
    d = tables.documents(spark, sf_dir)
    toks = d.select(F.explode_outer(T.word_tokens(F.lower("text"))).alias("token")).where("token IS NOT NULL")
    return stats.term_counts(toks, "token")


@query("syllables")
def syllables(spark, sf_dir):
    """T8 for every distinct word of the corpus, with its frequency."""
    d = tables.documents(spark, sf_dir)
    words = stats.term_counts(d.select(F.explode_outer(T.word_tokens("text")).alias("word"))
                              .where("word IS NOT NULL"), "word")
    return words.select("word", T.syllables("word").alias("syllables"), "n")


@query("mean_fill")
def mean_fill(spark, sf_dir):
    """G4 on its own: a feature with holes (NULL for every 7th document) filled
    by its column mean."""
    d = tables.documents(spark, sf_dir)
    feats = basic.extract(d, keep=["doc_id"], families=["lexical"], mode="normalized")
    holed = feats.select("doc_id", *[F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col(c)).alias(c)
                                     for c in ["avg_word_length", "lexical_diversity"]])
    return rounded(stats.mean_fill(holed, ["avg_word_length", "lexical_diversity"]))


@query("source_distribution")
def source_distribution(spark, sf_dir):
    """G1: documents per source with share."""
    return rounded(stats.value_counts(tables.documents(spark, sf_dir), "source"))


PLOTTED = ["avg_word_length", "lexical_diversity", "word_count", "unique_word_ratio"]


def lexical_by_source(spark, sf_dir):
    """Lexical features of the articles with their source, computed once: the statistics read them several times."""
    def build():
        art = tables.articles(spark, sf_dir)
        return basic.extract(art, keep=["article_id", "source"], families=["lexical"], mode="normalized")

    return shared.stored_once(spark, sf_dir, "lexical", build)


@query("box_stats")
def box_stats(spark, sf_dir):
    """G8 on the lexical features per source."""
    return rounded(stats.box_stats(lexical_by_source(spark, sf_dir), "source", PLOTTED))


@query("outlier_values")
def outlier_values(spark, sf_dir):
    """The points a box plot draws beyond its whiskers, with their articles."""
    return rounded(stats.outliers(lexical_by_source(spark, sf_dir), "source", PLOTTED, "article_id"))


@query("feature_corr")
def feature_corr(spark, sf_dir):
    """Correlations of the first four report features within each source."""
    return rounded(stats.feature_corr(lexical_by_source(spark, sf_dir), "source",
                                      ["avg_sentence_length", "avg_word_length", "lexical_diversity", "word_count"]))


@query("feature_histogram")
def feature_histogram(spark, sf_dir):
    """The diagonal of the pair plot."""
    return stats.feature_histogram(lexical_by_source(spark, sf_dir), "source", PLOTTED)


@query("feature_joint")
def feature_joint(spark, sf_dir):
    """The other panels of the pair plot, every two features as a grid of counts."""
    return stats.feature_joint(lexical_by_source(spark, sf_dir), "source", PLOTTED)
