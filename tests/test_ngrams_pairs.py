import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from penmark.operators import ngrams, pairs
from penmark.operators.ranking import h60, hash_rank


def test_tfidf_hand_case(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red")], "doc_id long, text string")
    m = ngrams.fit(docs, "text", 500)
    assert m.terms == ["fox", "red", "red fox", "red red"]
    assert m.idf[1] == pytest.approx(1.0) and m.idf[0] == pytest.approx(1.405465, abs=1e-6)
    vec = {r.doc_id: r.tfidf for r in m.transform(docs).collect()}
    for v in vec.values():
        assert math.sqrt(sum(x * x for x in v)) == pytest.approx(1.0)
    cos = sum(a * b for a, b in zip(vec[1], vec[2]))
    assert cos == pytest.approx(0.345818, abs=1e-6)
    p = spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "pair_id int, article1_idx long, article2_idx long")
    sims = [r.word_ngram_similarity for r in ngrams.pair_cosine(docs, p, "doc_id", "text").orderBy("pair_id").collect()]
    assert sims[0] == pytest.approx(0.345818, abs=1e-6) and sims[0] == pytest.approx(sims[1])


def test_hash_rank_exact_and_skew_safe(spark):
    # one group holds a third of all rows
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot"))
                                  .otherwise((F.col("id") % 50).cast("string")).alias("g"))
    got = hash_rank(df, ["g"], h60(7, F.col("id")), F.col("id"), out="r", bucket_bits=4)
    w = Window.partitionBy("g").orderBy(h60(7, F.col("id")), F.col("id"))
    want = df.withColumn("r", F.row_number().over(w) - 1)
    assert sorted(got.select("id", "r").collect()) == sorted(want.select("id", "r").collect())
    glob = hash_rank(df, [], h60(7, F.col("id")), F.col("id"), out="r")
    assert sorted(r[0] for r in glob.select("r").collect()) == list(range(3000))


def test_pair_draws(spark):
    art = spark.range(200).select(F.col("id").alias("article_id"), (F.col("id") % 4).cast("string").alias("source"))
    same = pairs.same_group_pairs(art, "source", "article_id", 50, 42).collect()
    assert len(same) == 4 * 50
    assert all(r.id1 != r.id2 and r.id1 % 4 == r.id2 % 4 for r in same)
    diff = pairs.cross_group_pairs(art, "source", "article_id", len(same), 42).collect()
    assert len(diff) == len(same)
    assert all(r.group1 != r.group2 and r.id1 % 4 != r.id2 % 4 for r in diff)
    # deterministic
    assert sorted(same) == sorted(pairs.same_group_pairs(art, "source", "article_id", 50, 42).collect())


def test_small_groups(spark):
    art = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "article_id long, source string")
    same = pairs.same_group_pairs(art, "source", "article_id", 50, 1).collect()
    assert len(same) == 2 and all({r.id1, r.id2} == {1, 2} for r in same)


def test_exact_quantiles_skewed(spark):
    from penmark.operators.ranking import exact_quantiles
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 37 % 1013 / 7.0).alias("v"))
    got = {r.g: (r.q0, r.q1, r.q2) for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    want = {r.g: tuple(r.p) for r in df.groupBy("g").agg(
        F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).collect()}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)


def test_distinct_group_pairs(spark):
    art = spark.range(60).select(F.col("id").alias("article_id"), F.when(F.col("id") < 30, F.lit("hot")).otherwise(
        (F.col("id") % 11).cast("string")).alias("author"))
    members = {r.article_id: r.author for r in art.collect()}
    sizes = [sum(a == x for a in members.values()) for x in set(members.values())]
    total = sum(m * (m - 1) // 2 for m in sizes)
    every = pairs.distinct_group_pairs(art, "author", "article_id", 10 * total, 7).collect()
    assert len(every) == total == len({frozenset((r.id1, r.id2)) for r in every})
    assert all(members[r.id1] == members[r.id2] == r.author and r.id1 != r.id2 for r in every)
    some = pairs.distinct_group_pairs(art, "author", "article_id", 25, 7).collect()
    assert len(some) == 25 == len({frozenset((r.id1, r.id2)) for r in some})
    alone = art.where("article_id = 0")
    assert pairs.distinct_group_pairs(alone, "author", "article_id", 5, 7).count() == 0


def test_quantiles_of_one_common_value(spark):
    from penmark.operators.ranking import exact_quantiles
    df = spark.range(4000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(5.0).alias("v"))
    got = exact_quantiles(df, ["g"], "v", [0.05, 0.5, 0.99]).first()
    want = df.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.99))).alias("p")).first().p
    assert [got.q0, got.q1, got.q2] == pytest.approx(want, abs=1e-9)
