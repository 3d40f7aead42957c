"""Plan guards: the scale properties of the headline plans must not regress."""
import re

import __spark_entry__ as E
from tests.conftest import SF001


def plan(spark, name):
    df = E.queries()[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(p):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", p))


def test_features_are_map_only_and_pruned(spark):
    for name in ("basic_features", "raw_basic_features", "normalize_text"):
        p = plan(spark, name)
        assert shuffles(p) <= 1, name          # at most the local-only spread
        scans = re.findall(r"FileScan parquet \[([^\]]*)\]", p)
        assert len(scans) == 1
        cols = {c.split("#")[0] for c in scans[0].split(",")}
        assert cols == {"doc_id", "text"}, cols  # no unused column is read


def test_cleaning_scans_once(spark):
    p = plan(spark, "clean_articles")
    assert len(re.findall(r"FileScan parquet", p)) == 1
    assert shuffles(p) <= 1


def test_tfidf_transform_has_no_join_shuffle(spark):
    p = plan(spark, "tfidf")
    assert shuffles(p) <= 1 and "Join" not in p
