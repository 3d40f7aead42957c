import pytest

from penmark.functions.lexicons import basic_feature_names
from penmark.operators import basic


def feats(spark, text, mode, families=None):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    fams = families or basic.FAMILY_ORDER
    return basic.extract(df, keep=["id"], families=fams, mode=mode).first().asDict()


def test_lexical_hand_case(spark):
    f = feats(spark, "the cat and the dog", "normalized", ["lexical"])
    assert f["word_count"] == 5 and f["sentence_count"] == 1
    assert f["avg_sentence_length"] == 5 and f["avg_word_length"] == 3.0
    assert f["lexical_diversity"] == 1.0 and f["unique_word_ratio"] == pytest.approx(0.8)


def test_function_words_hand_case(spark):
    f = feats(spark, "The cat and the dog", "raw", ["function_words"])
    assert f["the_freq"] == pytest.approx(0.4) and f["articles_freq"] == pytest.approx(0.4)
    assert f["and_freq"] == pytest.approx(0.2) and f["conjunctions_freq"] == pytest.approx(0.2)
    assert f["pronouns_freq"] == 0


def test_readability_hand_case(spark):
    f = feats(spark, "The cat sat. Dogs ran!", "raw", ["readability"])
    assert f["avg_words_per_sentence"] == 2.5 and f["avg_sentence_length_chars"] == 8.0
    assert f["flesch_kincaid_grade"] == pytest.approx(-2.815)
    assert f["automated_readability_index"] == pytest.approx(-5.108)


def test_punctuation_hand_case(spark):
    f = feats(spark, "a, b; c.", "raw", ["punctuation"])
    assert f["comma_freq"] == f["semicolon_freq"] == f["period_freq"] == 0.125
    assert f["question_mark_freq"] == 0


def test_structure_hand_case(spark):
    f = feats(spark, 'He said "go home now".\n\nEnd.', "raw", ["structure"])
    assert f["paragraph_count"] == 2 and f["avg_paragraph_length"] == 13.0
    assert f["avg_paragraph_length_words"] == 3.0
    assert f["quote_frequency"] == pytest.approx(1 / 6) and f["avg_quote_length"] == 3.0


def test_empty_text_gives_zeros(spark):
    f = feats(spark, None, "normalized")
    assert all(f[n] == 0 for n in basic_feature_names())


def test_normalised_identities(spark):
    # on normalised text: one sentence and one paragraph, no punctuation
    f = feats(spark, "Hello, world! It's 2025.\n\nA new \"day\" begins?", "normalized")
    assert f["sentence_count"] == 1 and f["paragraph_count"] == 1
    assert f["avg_sentence_length"] == f["word_count"]
    assert all(f[n] == 0 for n in basic_feature_names() if n.endswith("_freq") and n.startswith(
        ("comma", "period", "question", "exclamation", "semicolon", "colon", "dash", "parenthesis", "quote_f",
         "apostrophe")))


def test_88_names_in_order(spark):
    assert len(basic_feature_names()) == 88
    df = spark.createDataFrame([(1, "x y")], "id long, text string")
    assert basic.basic_features(df, keep=["id"]).columns[1:] == basic_feature_names()


def test_same_result_under_repartition(spark):
    from tests.conftest import SF001
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    a = sorted(basic.basic_features(d, keep=["doc_id"]).collect())
    b = sorted(basic.basic_features(d.repartition(7), keep=["doc_id"]).collect())
    assert a == b
    for r in a:
        assert all(0.0 <= r[n] <= 1.0 for n in basic_feature_names() if n.endswith("_freq"))
