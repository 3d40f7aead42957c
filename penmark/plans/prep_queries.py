"""Registered queries for preparation (M1-M6) and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions.lexicons import basic_feature_names
from penmark.operators import basic, evaluate, fitstate, prep
from penmark.plans.pair_queries import author_pair_table_df, source_pair_table, source_pair_vectors, with_holes
from penmark.plans.registry import query, rounded
from penmark.session import cut_lineage
from penmark.sources import files, tables


def holed_vectors(spark, sf_dir):
    art = tables.articles(spark, sf_dir)
    feats = basic.basic_features(art.select("article_id", "text"), keep=["article_id"], mode="normalized")
    names = [c for c in feats.columns if c != "article_id"]
    vec = F.array(*[F.col(c).cast("double") for c in names])
    rows = feats.select("article_id", with_holes(F.col("article_id"), vec).alias("features"))
    # read by the fit and again by the transform: computed once
    path = files.write_parquet(rows, files.scratch_path(spark, "vectors"))
    return spark.read.schema(rows.schema).parquet(path)


def _long(df, id_col, vec):
    return df.select(id_col, F.posexplode_outer(vec).alias("pos", "value")).select(
        id_col, F.col("pos").cast("bigint").alias("pos"), "value")


@query("impute_mean")
def impute_mean(spark, sf_dir):
    """M1: mean imputation of article feature vectors; an all-missing
    position is dropped."""
    v = holed_vectors(spark, sf_dir)
    st = prep.fit_vector_stats(v, "features", len(basic_feature_names()))
    return rounded(_long(prep.impute(v, "features", st), "article_id", "features"))


@query("standardize")
def standardize(spark, sf_dir):
    """M1 + M2: imputed, then (x - mean) / population std (0 std -> 1)."""
    v = holed_vectors(spark, sf_dir)
    st = prep.fit_vector_stats(v, "features", len(basic_feature_names()))
    return rounded(_long(prep.standardize(v, "features", st), "article_id", "features"))


@query("merged_standardize")
def merged_standardize(spark, sf_dir):
    """M1 + M2 with statistics merged from two batches' moments, the first one stored in between."""
    v = holed_vectors(spark, sf_dir)
    path = files.scratch_path(spark, "moments")
    fitstate.MomentState.of(v.where(F.col("article_id") % 2 == 0), "features").save(path)
    rest = fitstate.MomentState.of(v.where(F.col("article_id") % 2 == 1), "features")
    st = fitstate.MomentState.load(spark, path).merge(rest).stats()
    return rounded(_long(prep.standardize(v, "features", st), "article_id", "features"))


@query("label_encode")
def label_encode(spark, sf_dir):
    """M3: source -> index, alphabetical."""
    art = tables.articles(spark, sf_dir).select("article_id", "source")
    return prep.label_encode(art, "source", "label")


@query("hash_split")
def hash_split(spark, sf_dir):
    """M4: stable 80/20 split by seeded id hash."""
    art = tables.articles(spark, sf_dir).select("article_id")
    return prep.hash_split(art, "article_id", 80, 42)


@query("split_data")
def split_data(spark, sf_dir):
    """M5: sequential 70/10/20 split of the shuffled author pairs."""
    _, lab = author_pair_table_df(spark, sf_dir)
    return prep.split_data(lab.select("pair_id"), "pair_id", 0.2, 0.1, 42)


@query("stratified_split")
def stratified_split(spark, sf_dir):
    """M6: 70/15/15 split of the source pairs, stratified by label."""
    _, d = source_pair_table(spark, sf_dir)
    return prep.stratified_split(d.select("pair_id", "label"), "pair_id", "label", 0.3, 0.5, 42)


def scored_pairs(spark, sf_dir):
    """M11 with given weights: p = sigmoid(b + w . |diff|) on three features,
    all of the lexical family."""
    d, names = source_pair_vectors(spark, sf_dir, families=("lexical",))
    pos = {n: i + 1 for i, n in enumerate(names)}
    z = (F.lit(1.0) - F.lit(2.0) * F.element_at("diff", pos["avg_word_length"])
         - F.lit(5.0) * F.element_at("diff", pos["lexical_diversity"])
         - F.lit(0.001) * F.element_at("diff", pos["word_count"]))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    # one small row per pair, read by several metric plans: materialise once
    return cut_lineage(d.select("pair_id", "label", p.alias("prob_1"),
                    F.when(p >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("prediction")))


@query("linear_score")
def linear_score(spark, sf_dir):
    return rounded(scored_pairs(spark, sf_dir))


@query("accuracy")
def accuracy(spark, sf_dir):
    return rounded(evaluate.accuracy(scored_pairs(spark, sf_dir)))


@query("log_loss")
def log_loss(spark, sf_dir):
    return rounded(evaluate.log_loss(scored_pairs(spark, sf_dir)))


@query("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(scored_pairs(spark, sf_dir))


@query("classification_report")
def classification_report(spark, sf_dir):
    return rounded(evaluate.classification_report(scored_pairs(spark, sf_dir)))
