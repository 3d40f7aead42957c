"""The annotation point and the wide vector by registry."""

import numpy as np
import pytest

from penmark.operators import annotate, syntax, wide


def shouting_factory():
    """A model that fails on some texts and answers others badly."""
    def factory():
        def one(text):
            if "boom" in text:
                raise RuntimeError("no memory")
            if "bad" in text:
                return [{"text": text, "tokens": [("x", "NOUN", "ROOT", 5)], "ents": [], "chunks": []}]
            words = text.split()
            tokens = [(w, "NOUN", "dep" if i else "ROOT", 0) for i, w in enumerate(words)]
            return [{"text": text, "tokens": tokens, "ents": [(0, "PERSON")], "chunks": [0]}] if words else []

        return lambda texts: [one(t) for t in texts]

    return factory      # a nested function travels to the workers by value


def test_failing_texts_keep_an_error_row(spark):
    rows = [(1, "a b c"), (2, "boom"), (3, None), (4, "bad"), (5, "x " * 5_000), (None, "d"), (1, "e f")]
    got = annotate.annotate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shouting_factory(), "shouting", batch_texts=3)
    assert got.columns == ["article_id", "sent_id", "text", "tokens", "ents", "chunks", "error"]
    errors = {r.article_id: r.error for r in annotate.errors(got).collect()}
    assert set(errors) == {2, 4} and "no memory" in errors[2] and "head among 1 tokens" in errors[4]
    count = {r.article_id: r["count"] for r in annotate.tokens(got).groupBy("article_id").count().collect()}
    assert count == {1: 5, 5: 5_000, None: 1}
    assert annotate.sentences(got).count() == 4 and annotate.entities(got).count() == 4 and annotate.chunks(got).count() == 4
    assert annotate.annotate(spark.createDataFrame([], "doc_id long, text string"), shouting_factory(), "shouting").count() == 0


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    marks = str(tmp_path)

    def factory():
        import uuid
        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return lambda texts: [[] for _ in texts]

    docs = spark.range(0, 4_000, 1, 1).selectExpr("id as doc_id", "'a' as text")
    assert annotate.annotate(docs, factory, "counted", batch_texts=10).count() == 0
    assert len(list(tmp_path.iterdir())) == 1


def test_wrong_number_of_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    got = annotate.errors(annotate.annotate(docs, lambda: lambda texts: [], "short")).collect()
    assert {r.article_id for r in got} == {1, 2} and all("0 documents for 1 texts" in r.error for r in got)


def test_sentence_rows_from_tables(spark):
    sents = spark.createDataFrame([(1, 0, "a b?"), (1, 1, "...")], "article_id long, sent_id long, text string")
    tokens = spark.createDataFrame([(1, 0, 1, "b", "VERB", "mark", 0), (1, 0, 0, "a", "NOUN", "ROOT", 0)],
                                   "article_id long, sent_id long, tok_id long, text string, pos string, dep string, head_id long")
    got = syntax.from_tables(sents, tokens)
    f = syntax.sentence_features(got).first()
    assert (f.question_freq, f.complex_sentence_ratio, f.avg_dependency_depth, f.avg_sentence_complexity) == (0.5, 0.5, 1.0, 0.0)
    assert syntax.token_ratios(got).first().verb_noun_ratio == 1.0


def test_wide_vector_against_numpy(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "article_id long")
    fixed = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 1.0), (3, 9.0, 1.0)], "article_id long, a double, b double")
    tags = spark.createDataFrame([(1, "Y", 0.5), (2, "X", 0.25), (3, "Y", 1.0)], "article_id long, tag string, freq double")
    grams = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [0.5, 0.5, 0.0])], "article_id long, values array<double>")
    registry, rows = wide.assemble(ids, [wide.Fixed("f", ["a", "b"], fixed), wide.Tags("t", tags, "t_{}"), wide.Vector("g", ["u", "v", "w"], grams)])
    assert [r[:3] for r in registry.rows] == [(0, "f", "a"), (1, "f", "b"), (2, "t", "t_X"), (3, "t", "t_Y"), (4, "g", "u"), (5, "g", "v"), (6, "g", "w")]
    nan = np.nan
    dense = np.array([[2, nan, nan, .5, 0, 1, 0], [4, 1, .25, nan, .5, .5, 0], [9, 1, nan, 1, 0, 0, 0], [nan, nan, nan, nan, 0, 0, 0]])
    filled = np.where(np.isnan(dense), np.nanmean(dense, axis=0), dense)
    scale = filled.std(axis=0)
    z = (filled - filled.mean(axis=0)) / np.where(scale > 1e-14, scale, 1)
    stats = wide.fit(registry, rows)
    got = {(r.article_id, r.pos): r.value for r in wide.cells(wide.standardize(rows, stats)).collect()}
    assert len(got) == z.size and all(abs(got[i + 1, j] - z[i, j]) < 1e-12 for i in range(4) for j in range(7))
    assert {(r.article_id, r.pos): r.value for r in wide.cells(rows).collect()} == {
        (i + 1, j): v for i, row in enumerate(dense) for j, v in enumerate(row) if not np.isnan(v) and not (j >= 4 and v == 0)}


def test_wide_registry_refuses_an_unbounded_family(spark, monkeypatch):
    monkeypatch.setattr(wide, "MAX_TAGS", 3)
    tags = spark.range(5).selectExpr("id as article_id", "cast(id as string) as tag", "1.0 as freq")
    with pytest.raises(ValueError, match="more than 3"):
        wide.assemble(tags.select("article_id"), [wide.Tags("t", tags)])


def test_wide_edges(spark):
    ids = spark.createDataFrame([(7,)], "article_id long")
    tags = spark.createDataFrame([], "article_id long, tag string, freq double")
    registry, rows = wide.assemble(ids, [wide.Tags("t", tags)])
    assert registry.rows == [] and rows.count() == 1 and wide.cells(wide.standardize(rows, wide.fit(registry, rows))).count() == 0
