"""Property tests: invariants over generated text."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from penmark.functions import text as T

ALPHABET = st.sampled_from(list("abcdeéxyz ABCÉ\n\t.,!?\"'-_0123456789"))
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=1, max_size=25)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_normalize_idempotent_and_clean(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    n = df.select("id", T.normalize_text("t").alias("n"))
    nn = n.select("id", "n", T.normalize_text("n").alias("nn")).collect()
    for r in nn:
        assert r.n == r.nn                      # normalising twice changes nothing
        assert "  " not in r.n and r.n == r.n.strip()
        assert all(ch.isalpha() or ch == "_" or ch == " " or ch.isnumeric() and not ch.isdecimal() for ch in r.n)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_word_count_conservation(spark, texts):
    # the words of a text are the words of its paragraphs (no word spans a blank line)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    per = df.select(F.size(T.word_tokens("t")).alias("a"),
                    F.aggregate(F.split("t", "\n\n"), F.lit(0), lambda acc, p: acc + F.size(T.word_tokens(p)))
                    .alias("b")).collect()
    assert all(r.a == r.b for r in per)
    # python's \\w+ agrees with the Unicode word class
    import re
    got = [r.w for r in df.orderBy("id").select(T.word_tokens("t").alias("w")).collect()]
    assert got == [re.findall(r"\w+", t) for t in texts]
