"""Registered model queries.  The pair model's epochs are deterministic, so SQL
can follow them; forests and the source classifier's solver are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.functions.lexicons import basic_feature_names
from penmark.operators import basic, bundle, evaluate, model, pairs, prep, stats
from penmark.operators.ranking import h60
from penmark.plans import shared
from penmark.plans.pair_queries import source_pair_vectors
from penmark.plans.registry import query, rounded
from penmark.session import cut_lineage
from penmark.sources import files, tables

MAX_EPOCHS = 100


def split_pairs(spark, sf_dir):
    """Labelled source pairs with |diff| vectors, split 70/15/15 by label."""
    def build():
        d, _ = source_pair_vectors(spark, sf_dir)
        return prep.stratified_split(cut_lineage(d), "pair_id", "label", 0.3, 0.5, 42)

    return shared.stored_once(spark, sf_dir, "split-pairs", build)


def fitted_pairs(spark, sf_dir):
    """The split pairs, and the bundle trained on them as it is read back from disk."""
    d = split_pairs(spark, sf_dir)
    train = bundle.PairClassifier(basic_feature_names(), maxIter=MAX_EPOCHS)
    path = shared.path_of(spark, sf_dir, "pair-model", lambda p: train.fit(d).write().save(p))
    return d, bundle.PairClassifierModel.load(path)


@query("train_pair_model")
def train_pair_model(spark, sf_dir):
    """M7: pair model trained on the training split, best epoch by validation
    loss; test predictions."""
    d, m = fitted_pairs(spark, sf_dir)
    return rounded(m.transform(d.where(F.col("split") == "test")).select("pair_id", "label", "prediction", "prob_1"))


@query("train_history")
def train_history(spark, sf_dir):
    """M8: loss and accuracy of every epoch on train and validation."""
    return rounded(fitted_pairs(spark, sf_dir)[1].history(spark))


@query("best_epoch")
def best_epoch(spark, sf_dir):
    """M8: the epoch with the lowest validation loss."""
    return model.best_epoch(train_history(spark, sf_dir))


def _article_frame(spark, sf_dir, families=("lexical", "function_words")):
    art = tables.articles(spark, sf_dir)
    return basic.extract(art, keep=["article_id", "source", "is_target"], families=list(families),
                         mode="normalized")


@query("source_classifier")
def source_classifier(spark, sf_dir):
    """M9: multinomial logistic regression on the source, 80/20 split; test
    predictions with the true label."""
    f = _article_frame(spark, sf_dir)
    names = [c for c in f.columns if c not in ("article_id", "source", "is_target")]
    f = prep.hash_split(prep.label_encode(f, "source", "label"), "article_id", 80, 42)
    f = f.withColumn("x", F.array(*[F.col(c).cast("double") for c in names]))
    f = cut_lineage(f.select("article_id", "label", "split", "x"))
    st = prep.fit_vector_stats(f.where(F.col("split") == "train"), "x")
    z = model.to_vector(prep.standardize(f, "x", st, "z"), "z")
    # ridge penalty of strength C = 1: regParam is per row
    train = z.where(F.col("split") == "train")
    m = model.train_logistic(train, family="multinomial", reg=1.0 / max(1, train.count()), l1_ratio=0.0, max_iter=1000)
    return model.predict(m, z.where(F.col("split") == "test")).select("article_id", "label", "prediction")


def report_features(spark, sf_dir):
    """The articles' source, target flag and report features, and these features' names.  The
    texts are read once: the fill, the forest and the summary read the stored table."""
    def build():
        f = _article_frame(spark, sf_dir)
        return f.select("article_id", "source", "is_target", *stats.select_features(f))

    f = shared.stored_once(spark, sf_dir, "report-features", build)
    return f, stats.select_features(f)


def forest(spark, sf_dir):
    f, sel = report_features(spark, sf_dir)
    f = stats.mean_fill(f, sel)
    f = prep.hash_split(f, "article_id", 70, 42)
    f = f.withColumn("label", F.col("is_target").cast("int")).withColumn(
        "x", F.array(*[F.col(c).cast("double") for c in sel]))
    f = cut_lineage(model.to_vector(f.select("article_id", "label", "split", "x"), "x"))
    m = model.train_forest(f.where(F.col("split") == "train"))
    return m, f, sel


@query("forest_eval")
def forest_eval(spark, sf_dir):
    """M10 + E3: forest on the ten report features, 70/30 split; report."""
    m, f, _ = forest(spark, sf_dir)
    p = cut_lineage(model.predict(m, f.where(F.col("split") == "test")))
    return rounded(evaluate.classification_report(p))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """E5: forest importances, descending."""
    m, _, sel = forest(spark, sf_dir)
    return model.importances(m, sel, spark)


def long_report(df, section, name, values):
    """(section, name, value) rows of a wide table, one per row and value column."""
    cells = F.array(*[F.struct(F.concat_ws(":", F.col(name), F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in values])
    return df.select(F.lit(section).alias("section"), F.explode_outer(cells).alias("kv")).select("section", "kv.name", "kv.value")


@query("source_summary")
def source_summary(spark, sf_dir):
    """E6, the sections without a model: articles and feature means per source."""
    f, sel = report_features(spark, sf_dir)
    counts = stats.value_counts(f, "source").select(F.lit("count").alias("section"), F.col("source").alias("name"),
                                                    F.col("n").cast("double").alias("value"))
    return rounded(counts.unionByName(long_report(stats.filled_group_means(f, "source", sel), "mean", "source", sel)))


@query("source_report")
def source_report(spark, sf_dir):
    """The source-difference report as (section, name, value) rows:
    counts, group means, importances and the classification report."""
    m, ff, sel = forest(spark, sf_dir)
    imp = model.importances(m, sel, spark).select(F.lit("importance").alias("section"), F.col("feature").alias("name"),
                                                  F.col("importance").alias("value"))
    rep = evaluate.classification_report(cut_lineage(model.predict(m, ff.where(F.col("split") == "test"))))
    rep = long_report(rep, "report", "class", ["precision", "recall", "f1", "support"])
    return source_summary(spark, sf_dir).unionByName(rounded(imp.unionByName(rep)))


def score_texts(gen, art, m, draws_per_text):
    """Every text of ``gen`` (gen_id, text) is paired with ``draws_per_text`` seeded draws
    of the articles; its score is the mean 'same source' probability over its pairs.
    Only drawn articles are featurised; features are aligned with the bundle's registry by name."""
    names = m.fitted.names

    def vectors(df, id_col, tag):
        f = basic.basic_features(df, keep=[id_col], mode="normalized")
        aligned = prep.align_by_name(f, [id_col, *names])
        return aligned.select(F.concat(F.lit(tag), F.col(id_col).cast("string")).alias("vid"),
                              F.array(*[F.col(c).cast("double") for c in names]).alias("v"))

    # draws of each generated text among the articles (ranked by hash)
    ranked = pairs.ranked_members(art.select(F.lit("t").alias("g"), "article_id"), "g", "article_id", 42)
    n_t = ranked.count()
    draws = gen.select("gen_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(draws_per_text - 1)))) \
        .withColumn("rank", F.pmod(h60(42, "score", F.col("gen_id"), F.col("k")), F.lit(max(n_t, 1))))
    # generated and article ids live in different spaces: tagged
    pr = cut_lineage(draws.join(ranked.select("rank", "article_id"), "rank").select(
        F.concat_ws("/", F.col("gen_id").cast("string"), F.col("k").cast("string")).alias("pair_id"), "article_id",
        F.concat(F.lit("g"), F.col("gen_id").cast("string")).alias("id1"), F.concat(F.lit("a"), F.col("article_id").cast("string")).alias("id2")))
    drawn = art.select("article_id", "text").join(pr.select("article_id"), "article_id", "left_semi")
    diff = pairs.pair_abs_diff(pr, vectors(gen, "gen_id", "g").unionByName(vectors(drawn, "article_id", "a")), "vid", "v")
    p = m.transform(diff)
    return (p.groupBy(F.col("id1").alias("gen")).agg(F.avg("prob_1").alias("prob_same_source"), F.count(F.lit(1)).alias("n_pairs"))
            .withColumn("pred_label", (F.col("prob_same_source") >= 0.5).cast("int")))


@query("score_articles")
def score_articles(spark, sf_dir, draws_per_text: int = 5):
    """M11 re-aimed: the pair model scores PAIRS, so every generated text
    (assistant turns of a conversation, concatenated) is paired with draws of
    target-source articles.  The fitted bundle is read from disk."""
    m = fitted_pairs(spark, sf_dir)[1]
    conv = tables.table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    gen = files.concat_pages(conv, "conv_id", "turn", "text").withColumnRenamed("conv_id", "gen_id")
    return rounded(score_texts(gen, tables.articles(spark, sf_dir).where(F.col("is_target")), m, draws_per_text))
