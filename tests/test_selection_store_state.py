"""Splits by selection, the feature store, mergeable fits, heavy hitters and the small sources."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.operators import fitstate, ngrams, pairs, prep, selection, stats
from penmark.operators.ranking import h60
from penmark.sources import feature_store, files
from tests.conftest import SF001


# --- splits -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,small", [(0, 4096), (1, 4096), (9, 4096), (3000, 20), (3000, 1)])
def test_split_equals_ranking(spark, monkeypatch, n, small):
    monkeypatch.setattr(selection, "SMALL", small)
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.k: r.split for r in prep.split_data(df, "k", 0.2, 0.1, 42).collect()}
    order = [r.k for r in df.orderBy(h60(42, "split", F.col("k")), "k").collect()]
    n_test, n_val = int(n * 0.2), int(n * 0.1)
    expected = ["train"] * (n - n_test - n_val) + ["val"] * n_val + ["test"] * n_test
    assert got == dict(zip(order, expected))


def test_equal_hashes_are_split_by_the_tie(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 10)
    df = spark.range(1000).withColumn("h", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.lit(1 << 59) + F.col("id")).cast("bigint"))
    got = selection.split_by_quotas(df, F.col("h"), F.col("id"), [("a", 100), ("b", 400)], "c")
    order = [r.id for r in df.orderBy("h", "id").collect()]
    assert {r.id: r.split for r in got.collect()} == {k: "a" if i < 100 else "b" if i < 500 else "c" for i, k in enumerate(order)}


def test_stratified_split_within_groups(spark):
    df = spark.range(500).selectExpr("id as k", "case when id % 50 = 0 then 1 when id % 7 = 0 then null else 0 end as y")
    got = prep.stratified_split(df, "k", "y", 0.3, 0.5).groupBy("y", "split").count().collect()
    n = Counter({(r.y, r.split): r["count"] for r in got})
    assert (n[1, "val"], n[1, "test"], n[1, "train"]) == (1, 2, 7) and (None, "val") not in n
    zeros = n[0, "val"] + n[0, "test"] + n[0, "train"]
    assert n[0, "val"] + n[0, "test"] == -(-zeros * 3 // 10)


def test_split_ranks_and_sorts_nothing(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    plan = prep.split_data(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


# --- feature store ------------------------------------------------------------------------------------


def test_store_lookup_has_no_exchange_on_the_feature_side(spark):
    feats = spark.range(400).selectExpr("id as article_id", "array(cast(id as double), 1.0D, null) as features")
    table = spark.table(feature_store.write(feats, buckets=8))
    lab = spark.range(300).selectExpr("id as pair_id", "id as id1", "399 - id as id2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = feature_store.abs_differences(lab, table)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = plan.splitlines().index(next(x for x in plan.splitlines() if "FileScan" in x))
    above = plan.splitlines()[:scan]
    depth = len(re.match(r"[ :|+-]*", plan.splitlines()[scan])[0])
    # walk up from the scan to the merge join: nothing but filters, projections and sorts
    for line in reversed(above):
        d = len(re.match(r"[ :|+-]*", line)[0])
        if d < depth:
            assert "Exchange" not in line
            depth = d
            if "SortMergeJoin" in line:
                break
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    expected = {r.pair_id: r.diff for r in pairs.pair_abs_diff(lab, feats, "article_id").collect()}
    assert {r.pair_id: r.diff for r in got.collect()} == expected and len(expected) == 300


# --- mergeable fits -----------------------------------------------------------------------------------


def test_merged_fits_equal_the_whole(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    parts = [docs.where(f"doc_id % 3 = {i}") for i in range(3)]
    states = [fitstate.TermState.of(p) for p in parts]
    kept = states[0].merge(states[1]).save(str(tmp_path / "terms"))
    merged = fitstate.TermState.load(spark, str(tmp_path / "terms")).merge(states[2]).model(200)
    assert merged == ngrams.fit(docs, "text", 200) and kept.n_docs == parts[0].count() + parts[1].count()

    rng = random.Random(1)
    rows = [(i, [None if rng.random() < 0.2 else 1e6 + rng.random(), float("nan"), 3.0, rng.random() if i % 4 == 1 else None]) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    moments = [fitstate.MomentState.of(df.where(f"i % 4 = {k}"), "v") for k in range(4)]
    merged = moments[0].merge(moments[1]).save(str(tmp_path / "m")).merge(*moments[2:]).stats()
    whole = prep.fit_vector_stats(df, "v")
    assert merged.keep == whole.keep == [0, 2, 3]
    assert all(abs(a - b) < 1e-9 for x, y in ((merged.mean, whole.mean), (merged.scale, whole.scale)) for a, b in zip(x, y))


# --- heavy hitters ------------------------------------------------------------------------------------


def test_frequent_terms_are_exact_at_every_summary_size(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text")
    expected = [(r.term, r.cf, r.df) for r in ngrams.vocabulary(ngrams.term_stats(docs), 40).collect()]
    for tracked in (64, 1024, 1 << 16):
        assert ngrams.frequent_terms(docs, "text", 40, tracked) == (expected, 200)
    grams = ngrams.with_ngrams(docs).select(ngrams.GRAMS)
    assert ngrams.candidate_terms(grams, 40, 64) is None        # too small to decide
    monkeypatch.setattr(ngrams, "MOST_TRACKED", 64)             # the way out: every term is counted
    assert ngrams.frequent_terms(docs, "text", 40, 64) == (expected, 200)


def test_frequent_terms_edges(spark):
    docs = spark.createDataFrame([(None,), ("",), ("aa bb aa",), ("x y",)], "text string")
    assert ngrams.frequent_terms(docs, "text", 2) == ([("aa", 2, 1), ("aa bb", 1, 1)], 4)
    assert ngrams.frequent_terms(docs.limit(0), "text", 2) == ([], 0)
    assert ngrams.frequent_terms(docs.where("text is null or text = ''"), "text", 2) == ([], 2)


def test_candidates_shuffle_no_terms(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text")
    best = ngrams.term_stats(docs, "text", ["the", "of"])
    assert {r.term for r in best.collect()} == {"the", "of"}


# --- sources and selection of columns ---------------------------------------------------------------------


def test_required_and_text_columns(spark):
    df = spark.createDataFrame([("a", "t")], ["Author", "Text"])
    with pytest.raises(ValueError, match="Source"):
        files.require_columns(df)
    files.require_columns(df, ["Author"])
    assert files.text_column(df) == "Text"
    assert files.text_column(df.withColumn("Article Text", F.lit("x"))) == "Article Text"
    with pytest.raises(ValueError, match="no text column"):
        files.text_column(df.select("Author"))


def test_list_files(spark, tmp_path):
    for name in ("texts/NYT/news/a.pdf", "texts/NotNYT/b.pdf", "texts/NYT/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {r.path.split("/texts/")[1]: (r.length, bytes(r.content)) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert got == {"NYT/news/a.pdf": (20, b"texts/NYT/news/a.pdf"), "NotNYT/b.pdf": (18, b"texts/NotNYT/b.pdf")}
    assert files.list_files(spark, str(tmp_path), "*.txt").count() == 1


def test_write_report(spark, tmp_path):
    rows = [("count", "src", 2.0), ("mean", "a:b", 0.5)]
    path = files.write_report(spark.createDataFrame(rows, "section string, name string, value double"), str(tmp_path / "r"))
    got = [json.loads(x) for p in tmp_path.glob("r/*.json") for x in p.read_text().splitlines()]
    assert path.endswith("r") and sorted((x["section"], x["name"], x["value"]) for x in got) == rows


def test_select_features_falls_back_to_the_columns_after_the_metadata(spark):
    names = [f"meta{i}" for i in range(8)] + ["word_count", *[f"f{i}" for i in range(12)]]
    df = spark.createDataFrame([tuple(range(len(names)))], names)
    assert stats.select_features(df) == names[8:18]
    three = df.withColumnRenamed("f0", "avg_word_length").withColumnRenamed("f5", "lexical_diversity")
    assert stats.select_features(three) == ["avg_word_length", "lexical_diversity", "word_count"]
