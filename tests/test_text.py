import pytest
from pyspark.sql import functions as F

from penmark.functions import text as T
from tests.conftest import rows


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("src,want", [
    (None, ""), ("Visit http://a.b/c NOW!", "visit now"), ("It's 20% up", "its up"),
    ("A--B  c", "ab c"), ("x_1 é2", "x_ é"), ("  Tab\there \n new ", "tab here new"),
])
def test_normalize(spark, src, want):
    assert one(spark, T.normalize_text, src) == want


@pytest.mark.parametrize("word,n", [
    ("the", 1), ("named", 1), ("makes", 1), ("banana", 3), ("queue", 1), ("rhythm", 1), ("code", 1),
    ("area", 2), ("beautiful", 3), ("trees", 1), ("tree", 1), ("sky", 1), ("hmmm", 1),
])
def test_syllables_word_and_text_agree(spark, word, n):
    assert one(spark, T.syllables, word) == n
    assert one(spark, T.total_syllables, word) == n


def test_total_syllables_is_sum_over_words(spark):
    text = "The beautiful banana trees, named code-area; hmmm 2024 x_y!"
    words = ["The", "beautiful", "banana", "trees", "named", "code", "area", "hmmm", "2024", "x_y"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    per_word = sum(r[0] for r in rows(df.select(T.syllables("w"))))
    assert one(spark, T.total_syllables, text) == per_word


def test_treebank_contractions(spark):
    toks = one(spark, T.treebank_tokens, "we cannot gonna wanna canna")
    assert toks == ["we", "can", "not", "gon", "na", "wan", "na", "canna"]


def test_sentences_and_quotes(spark):
    assert one(spark, T.sentence_pieces, "One. Two!? \n  . Three") == ["One", "Two", "Three"]
    assert one(spark, T.quote_spans, 'He said "go home" and "x".') == ["go home", "x"]
    assert one(spark, T.sentence_count, "") == 0


def test_author_split(spark):
    assert one(spark, T.author_split, "Ann Lee, Bo Ray and Cy Doe") == ["Ann Lee", "Bo Ray", "Cy Doe"]
    assert one(spark, T.author_split, "Ann Lee, and Bo Ray") == ["Ann Lee", "Bo Ray"]


def test_stopwords_case_sensitive_keeps_duplicates(spark):
    df = spark.createDataFrame([(["The", "the", "cat", "cat", "and"],)], "t array<string>")
    assert df.select(T.without_stopwords("t")).first()[0] == ["The", "cat", "cat"]
