"""Passes that must stay linear, and the parts of a plan that must not run twice."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from penmark.operators import clean


def test_layout_b_byline_is_linear_in_a_line(spark):
    long_line = "word " * 80_000
    df = spark.createDataFrame([(1, f"{long_line}\nAnn in Rome in May\nx in y\n"), (2, f"{long_line} in z")], "i int, t string")
    began = time.time()
    got = dict(df.select("i", clean.capture_author("t", "b")).collect())
    assert got == {1: "Ann in Rome", 2: ""}
    assert time.time() - began < 30     # an attempt at every character took minutes


def test_captures_match_the_plain_patterns(spark):
    r = random.Random(5)
    parts = [" in ", "in", " ", "\n", "a", "\r", "by", "http://", "www.", ".html", "x", "é", "😀"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 14))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    for new, old in ((clean.capture_author("t", "b"), F.regexp_extract("t", r"([^\n]*) in [^\n]*\n", 1)),
                     (clean.capture_url("t", "a"), F.regexp_extract(F.regexp_extract("t", r"(?:https?://|www\.)[\s\S]*", 0),
                                                                    r"\A(?:https?://|www\.)[\s\S]+?\.html\b", 0))):
        assert df.where(~new.eqNullSafe(old)).count() == 0


def test_spaced_words_count_as_the_text_does(spark):
    from penmark.functions import text as T
    r = random.Random(7)
    parts = ["e", "es", "ed", "a", "y", "b", "th", "İ", "Σ", "é", "1", "_", " ", "\n", ".", "'", "ß", "́", "😀", "𝒳", "E", "S", "u"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 30))),) for _ in range(4000)] + [("",), ("bleed shes tree queue",)]
    df = spark.createDataFrame(rows, "t string")
    w = T.spaced_words("t")
    low = T.lower_words(w)
    # T8 word by word (the passes over the whole text miss letters beyond U+FFFF in their look-behinds)
    each = F.aggregate(F.transform(T.word_tokens(F.lower("t")), T.syllables), F.lit(0).cast("bigint"), lambda a, n: a + n)
    for new, old in ((T.spaced_count(w), F.size(T.word_tokens("t"))), (T.spaced_length(w), F.length(F.array_join(T.word_tokens("t"), ""))),
                     (T.spaced_count(low), F.size(T.word_tokens(F.lower("t")))), (T.spaced_syllables(low), each)):
        assert [x.t for x in df.where(~new.eqNullSafe(old)).limit(3).collect()] == []


def test_frequent_terms_of_no_words(spark):
    from penmark.operators import ngrams
    assert ngrams.frequent_terms(spark.createDataFrame([("",), (None,)], "text string")) == ([], 2)


def test_tag_shares_read_the_tokens_once(spark):
    from penmark.operators import syntax
    rows = [(1, "A"), (1, "A"), (1, "B"), (2, None), (None, "A")]
    df = spark.createDataFrame(rows, "article_id long, tag string")
    long = syntax.tag_frequencies(df, "tag")
    assert sorted(map(tuple, long.collect()), key=str) == [(1, "A", 2 / 3), (1, "B", 1 / 3), (2, None, 1.0)]
    assert long._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1      # a join read them twice
    wide = syntax.wide_tags(df, "tag", "p_", "", ["A", "C"])
    assert sorted(map(tuple, wide.collect())) == [(1, 2 / 3, None), (2, None, None)]


def test_annotation_checks_every_token():
    from penmark.operators import annotate
    good = [("a", "X", "dep", 0), ("b", "X", "dep", 1)]
    sent = lambda toks: [{"text": "a b", "tokens": toks, "ents": [], "chunks": []}]
    assert annotate.problem(sent(good)) is None and annotate.problem(sent([])) is None
    for bad in (("a", "X", "dep", 2), ("a", "X", "dep", -1), ("a", "X", "dep", True), ("a", None, "dep", 0), ("a", "X", "dep")):
        assert "a token needs" in annotate.problem(sent([good[0], bad]))


def test_draws_are_never_broadcast(spark):
    from penmark.operators import pairs
    df = spark.createDataFrame([(i, "g") for i in range(40)], "i long, g string")
    got = pairs.sampled_group_pairs(df, "g", "i", 1.0)
    assert got.select("id1", "id2").distinct().count() == 40 * 39 // 2
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__slice" in plan      # was a broadcast of the draws


def test_pair_cosine_reads_its_documents_once(spark):
    from penmark.operators import ngrams, pairs
    r = random.Random(3)
    words = ["red", "fox", "Élan", "naïve", "x1", "a_b", "日本", "ab", "abc", "don", "z"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(60, ""), (61, None), (7, "fox"), (None, "red")]
    pair = [(k, r.randint(0, 62), r.randint(0, 62)) for k in range(200)] + [(200, None, 1), (201, 99, 98)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(pair, "pair_id int, article1_idx long, article2_idx long")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    got = {x.pair_id: x.word_ngram_similarity for x in ngrams.pair_cosine(df.mapInArrow(counted, df.schema), p, "doc_id", "text", max_features=20).collect()}
    assert reads.value == len(docs)         # three times before
    ids = {i for x in pair for i in x[1:]}
    used = df.where(F.col("doc_id").isin(list(ids - {None})))
    best = ngrams.vocabulary(ngrams.term_stats(used), 20).collect()
    model = ngrams.model_of([(t.term, t.cf, t.df) for t in best], used.count())
    vectors = {}
    for x in model.transform(used.na.fill("")).collect():
        vectors.setdefault(x.doc_id, []).append(x.tfidf)
    for k, a, b in pair:
        va, vb = vectors.get(a, []), vectors.get(b, [])
        want = sum(x * y for x, y in zip(va[0], vb[0])) if len(va) == len(vb) == 1 else 0.0
        assert abs(got[k] - want) < 1e-12, (k, a, b)


def test_fit_weights_where_no_summary_decides(spark, monkeypatch):
    from penmark.operators import ngrams
    r = random.Random(4)
    docs = [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(30))) for i in range(40)]
    words = spark.createDataFrame(docs, "i int, t string").select("i", ngrams.unigrams("t").alias(ngrams.UNI))
    model, weights = ngrams.fit_weights(words, "i", 30)
    assert model == ngrams.model_of([(t.term, t.cf, t.df) for t in ngrams.vocabulary(ngrams.gram_stats(ngrams.grams_of_words(words)), 30).collect()], 40)
    want = sorted(weights.collect())
    monkeypatch.setattr(ngrams, "MOST_TRACKED", 0)
    again, weights = ngrams.fit_weights(words, "i", 30)
    assert again == model and sorted(weights.collect()) == want
