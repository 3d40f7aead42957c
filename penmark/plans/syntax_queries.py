"""Registered queries for the syntax aggregates (Y-series) over the stand-in
annotation of the styled document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.operators import annotate, basic, ngrams, standin, syntax, wide
from penmark.plans import shared
from penmark.plans.registry import query, rounded
from penmark.sources import tables


def styled_documents(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", tables.styled_text().alias("text"))


def annotated(spark, sf_dir):
    """Sentence rows of the styled documents.  Like a tagger's output they are written
    once per application, as Parquet in the shared folder; every
    aggregate reads the nested columns that it uses."""
    return shared.stored_once(spark, sf_dir, "annotated", lambda: syntax.annotate_standin(styled_documents(spark, sf_dir)))


@query("pos_freq")
def pos_freq(spark, sf_dir):
    return rounded(syntax.tag_frequencies(annotate.token_field(annotated(spark, sf_dir), "pos"), "pos"))


@query("dep_freq")
def dep_freq(spark, sf_dir):
    return rounded(syntax.tag_frequencies(annotate.token_field(annotated(spark, sf_dir), "dep"), "dep"))


@query("ent_freq")
def ent_freq(spark, sf_dir):
    return rounded(syntax.entity_frequencies(annotate.entities(annotated(spark, sf_dir))))


@query("pos_ratios")
def pos_ratios(spark, sf_dir):
    return rounded(syntax.token_ratios(annotated(spark, sf_dir)).drop("passive_voice_freq"))


@query("passive_freq")
def passive_freq(spark, sf_dir):
    return rounded(syntax.token_ratios(annotated(spark, sf_dir)).select("article_id", "passive_voice_freq"))


@query("question_freq")
def question_freq(spark, sf_dir):
    return rounded(syntax.sentence_features(annotated(spark, sf_dir), ["question_freq"]))


@query("clause_ratios")
def clause_ratios(spark, sf_dir):
    return rounded(syntax.sentence_features(annotated(spark, sf_dir), ["complex_sentence_ratio", "compound_sentence_ratio"]))


@query("dep_depth")
def dep_depth(spark, sf_dir):
    return rounded(syntax.sentence_features(annotated(spark, sf_dir), ["avg_dependency_depth"]))


@query("sentence_complexity")
def sentence_complexity(spark, sf_dir):
    return rounded(syntax.sentence_features(annotated(spark, sf_dir), ["avg_sentence_complexity"]))


@query("syntax_features")
def syntax_features(spark, sf_dir):
    """Y4-Y8 and Y10 for every document (no tokens -> seven zeros)."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"))
    return rounded(syntax.syntax_features(docs, annotated(spark, sf_dir)))


def article_tag_table(docs, sents):
    """A column per tag of the annotator and the noun-chunk complexity, for every row of ``docs`` (article_id)."""
    out = docs.select("article_id")
    for family, rows, col, tags in (("pos", annotate.token_field(sents, "pos"), "pos", standin.POS), ("dep", annotate.token_field(sents, "dep"), "dep", standin.DEP),
                                    ("ent", annotate.entities(sents), "label", standin.ENT)):
        out = out.join(syntax.wide_tags(rows, col, f"{family}_freq_", "", tags), "article_id", "left")
    out = out.join(syntax.sentence_features(sents, ["avg_sentence_complexity"]), "article_id", "left")
    return out.withColumn("avg_sentence_complexity", F.coalesce("avg_sentence_complexity", F.lit(0.0)))


@query("article_tags")
def article_tags(spark, sf_dir):
    """The tag half of Y12: a column per tag of the annotator, and noun-chunk complexity."""
    docs = tables.documents(spark, sf_dir).select(F.col("doc_id").alias("article_id"))
    return rounded(article_tag_table(docs, annotated(spark, sf_dir)))


@query("process_articles")
def process_articles(spark, sf_dir):
    """Five lexical features (F1b) and the tags of ``article_tags``, one
    wide row per article."""
    docs = styled_documents(spark, sf_dir).withColumnRenamed("doc_id", "article_id")
    lex = basic.extract(docs, keep=["article_id"], families=["lexical"], mode="raw").drop("unique_word_ratio")
    return rounded(lex.join(article_tag_table(docs, annotated(spark, sf_dir)), "article_id", "left"))


def stored_tags(spark, sf_dir):
    """The long tag frequencies by family, small next to the sentences: the registry reads them and the cells do."""
    long = syntax.tag_tables(annotated(spark, sf_dir))
    return {family: shared.stored_once(spark, sf_dir, f"tags-{family}", lambda t=t: t) for family, t in long.items()}


def wide_features(spark, sf_dir, basic_too=False):
    """The registry and the sparse rows of every document: (basic,) syntax, tag and n-gram features."""
    docs = styled_documents(spark, sf_dir).withColumnRenamed("doc_id", "article_id")
    sents = annotated(spark, sf_dir)
    # the fit reads the normalised texts twice, the basic features once more; the weights come from the fit's counts
    norm = shared.stored_once(spark, sf_dir, "normalized", lambda: docs.select("article_id", basic.T.normalize_text("text").alias("text")))
    words = norm.select("article_id", ngrams.normalized_unigrams("text").alias(ngrams.UNI))
    model, weights = ngrams.fit_weights(words, "article_id", 500)
    parts = []
    if basic_too:
        b = basic.basic_features(norm, keep=["article_id"], mode="normalized", ready=True)
        parts.append(wide.Fixed("basic", [c for c in b.columns if c != "article_id"], b))
    parts.append(wide.Fixed("syntax", syntax.SYNTAX_FEATURES, syntax.syntax_features(docs, sents)))
    parts += [wide.Tags(family, long, f"{family}_{{}}_freq") for family, long in stored_tags(spark, sf_dir).items()]
    parts.append(wide.Sparse("word_ngram", model.terms, weights.withColumnRenamed("tfidf", "values")))
    return wide.assemble(docs.select("article_id"), parts)


@query("advanced_features")
def advanced_features(spark, sf_dir):
    """Syntax features, part-of-speech, dependency and entity frequencies and the 500
    TF-IDF weights of each article as one standardised vector (one global
    fit); one row per article and position."""
    registry, rows = wide_features(spark, sf_dir)
    return rounded(wide.cells(wide.standardize(rows, wide.fit(registry, rows))))


@query("all_features")
def all_features(spark, sf_dir):
    """F8 + J1: the cells of the whole wide vector (basic, syntax, tags and n-grams) as
    they were measured; one row per article and position that has a value."""
    return rounded(wide.cells(wide_features(spark, sf_dir, basic_too=True)[1]))


@query("feature_registry")
def feature_registry(spark, sf_dir):
    """Position, family and name of every feature column, tags as they were seen."""
    return wide_features(spark, sf_dir, basic_too=True)[0].table.select("pos", "family", "name")
