"""Registered queries for pair building, pair vectors and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.operators import basic, ngrams, pairs
from penmark.plans.registry import query, rounded
from penmark.session import cut_lineage
from penmark.sources import feature_store, tables

SEED = 42
SOURCE_DRAWS = 50      # reference: min(50, group size) draws per source

HOLE_POS = 3    # sentence_count: missing in every row -> dropped by the imputer
HOLE_MOD = 11   # and a scatter of missing cells


def with_holes(id_col, vec):
    """A test vector with missing cells: one position, and a scatter by id."""
    return F.transform(vec, lambda x, i: F.when((i == HOLE_POS) | ((id_col + i) % HOLE_MOD == 0),
                                                F.lit(None).cast("double")).otherwise(x))


def _articles(spark, sf_dir):
    return tables.articles(spark, sf_dir)


def source_pair_sets(spark, sf_dir):
    art = _articles(spark, sf_dir)
    # the draws are small and feed two plans: materialise them once
    same = cut_lineage(pairs.same_group_pairs(art, "source", "article_id", SOURCE_DRAWS, SEED))
    n_same = same.count()
    diff = pairs.cross_group_pairs(art, "source", "article_id", n_same, SEED)
    return art, same, diff


@query("same_source_pairs")
def same_source_pairs(spark, sf_dir):
    """A4: min(50, size) two-article draws per source."""
    return pairs.same_group_pairs(_articles(spark, sf_dir), "source", "article_id", SOURCE_DRAWS, SEED)


@query("diff_source_pairs")
def diff_source_pairs(spark, sf_dir):
    """A5: as many different-source draws as there are same-source pairs."""
    return source_pair_sets(spark, sf_dir)[2]


def same_author_pairs(art, n=None):
    """n different same-author pairs; as many as there are articles, unless told otherwise."""
    return pairs.distinct_group_pairs(art, "author", "article_id", art.count() if n is None else n, SEED)


@query("author_pairs_sampled")
def author_pairs_sampled(spark, sf_dir, n=None):
    """A1: different same-author pairs, one per article (all pairs, if there are fewer)."""
    return same_author_pairs(_articles(spark, sf_dir), n)


@query("author_pairs_share")
def author_pairs_share(spark, sf_dir, share=0.25):
    """A stated share of all same-author pairs."""
    return pairs.sampled_group_pairs(_articles(spark, sf_dir), "author", "article_id", share, SEED)


@query("diff_author_pairs")
def diff_author_pairs(spark, sf_dir, n=None):
    """A2: different-author pairs, as many as same-author pairs."""
    art = _articles(spark, sf_dir)
    return pairs.cross_group_pairs(art, "author", "article_id", same_author_pairs(art, n).count(), SEED)


def author_pair_table_df(spark, sf_dir, n=None):
    art = _articles(spark, sf_dir)
    same = cut_lineage(same_author_pairs(art, n))
    diff = pairs.cross_group_pairs(art, "author", "article_id", same.count(), SEED)
    return art, cut_lineage(pairs.labelled_pairs(same, diff, "author", SEED))


@query("author_pair_table")
def author_pair_table(spark, sf_dir):
    """A3 + J3: labelled, shuffled pairs with titles and authors of both ends."""
    art, lab = author_pair_table_df(spark, sf_dir)
    out = pairs.with_pair_details(lab, art.select("article_id", "title", "author"))
    return out.select("pair_id", F.col("id1").alias("article1_idx"), F.col("id2").alias("article2_idx"),
                      F.col("label").alias("same_author"), "article1_title", "article2_title",
                      "article1_author", "article2_author")


@query("pair_cosine")
def pair_cosine(spark, sf_dir):
    """TF-IDF fitted on the articles of the author pairs, cosine per pair."""
    art, lab = author_pair_table_df(spark, sf_dir)
    p = lab.select("pair_id", F.col("id1").alias("article1_idx"), F.col("id2").alias("article2_idx"))
    return rounded(ngrams.pair_cosine(art.select("article_id", "text"), p, "article_id", "text"))


def source_pair_table(spark, sf_dir):
    """Articles and the labelled, shuffled source pairs."""
    art, same, diff = source_pair_sets(spark, sf_dir)
    return art, cut_lineage(pairs.labelled_pairs(same.withColumnRenamed("source", "grp"), diff, "grp", SEED))


def source_pair_vectors(spark, sf_dir, families=tuple(basic.FAMILY_ORDER), holes=None):
    """|feature difference| vectors of the source pairs and the feature names.
    Only articles of some pair are featurised (semi-join below the features), and
    only the families asked for; ``holes`` maps (id column, vector) to a vector with missing cells."""
    art, lab = source_pair_table(spark, sf_dir)
    used = lab.select(F.explode(F.array("id1", "id2")).alias("article_id"))
    texts = art.select("article_id", "text").join(used, "article_id", "left_semi")
    feats = basic.extract(texts, keep=["article_id"], families=list(families), mode="normalized")
    names = [c for c in feats.columns if c != "article_id"]
    vec = F.array(*[F.col(c).cast("double") for c in names])
    vec = holes(F.col("article_id"), vec) if holes else vec
    return pairs.pair_abs_diff(lab, feats.select("article_id", vec.alias("features")), "article_id", "features"), names


@query("pair_abs_diff")
def pair_abs_diff(spark, sf_dir):
    """|feature difference| of each labelled source pair (88 basic
    features), one row per pair and feature position."""
    d, _ = source_pair_vectors(spark, sf_dir)
    return rounded(d.select("pair_id", "id1", "id2", "label", F.posexplode_outer("diff").alias("pos", "value"))
                   .withColumn("pos", F.col("pos").cast("bigint")))


@query("store_pair_diff")
def store_pair_diff(spark, sf_dir):
    """A6/J6 from the feature store: the basic features of all articles written once in
    buckets of the id, the differences of the source pairs looked up there."""
    art, lab = source_pair_table(spark, sf_dir)
    feats = basic.basic_features(art.select("article_id", "text"), keep=["article_id"], mode="normalized")
    vec = F.array(*[F.col(c).cast("double") for c in feats.columns if c != "article_id"])
    store = spark.table(feature_store.write(feats.select("article_id", vec.alias("features")), buckets=16))
    d = feature_store.abs_differences(lab, store)
    return rounded(d.select("pair_id", "id1", "id2", "label", F.posexplode_outer("diff").alias("pos", "value"))
                   .withColumn("pos", F.col("pos").cast("bigint")))


@query("missing_cells")
def missing_cells(spark, sf_dir):
    """A7 over pair vectors with missing cells (the holes of ``impute_mean``)."""
    d, _ = source_pair_vectors(spark, sf_dir, holes=with_holes)
    return rounded(pairs.missing_cells(d, "diff"))
