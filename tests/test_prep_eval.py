import math

import pytest
from pyspark.sql import functions as F

from penmark.operators import evaluate, prep


def test_impute_and_scale_hand_case(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, None]), (2, [None, 5.0, None]), (3, [3.0, 5.0, None])],
                               "id long, v array<double>")
    st = prep.fit_vector_stats(df, "v")
    assert st.keep == [0, 1] and st.mean == [2.0, 5.0]
    assert st.scale[0] == pytest.approx(math.sqrt(2 / 3)) and st.scale[1] == 1.0
    out = {r.id: r.v for r in prep.standardize(df, "v", st).collect()}
    assert out[1] == pytest.approx([-1.224745, 0.0], abs=1e-6)
    assert out[2] == pytest.approx([0.0, 0.0]) and out[3] == pytest.approx([1.224745, 0.0], abs=1e-6)


@pytest.mark.parametrize("n,sizes", [(10, (7, 1, 2)), (4, (4, 0, 0))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "pair_id")
    got = {r.split: r["count"] for r in prep.split_data(df, "pair_id").groupBy("split").count().collect()}
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == sizes


def test_metrics_hand_case(spark):
    p = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.2), (0, 0, 0.3)],
                              "label int, prediction int, prob_1 double")
    assert evaluate.accuracy(p).first()[0] == 0.75
    rep = {r["class"]: r for r in evaluate.classification_report(p).collect()}
    assert rep["1"].precision == 1.0 and rep["1"].recall == 0.5 and rep["1"].f1 == pytest.approx(2 / 3)
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].f1 == pytest.approx(0.8)
    assert rep["macro avg"].f1 == pytest.approx(0.733333, abs=1e-6)
    ll = evaluate.log_loss(p).first()[0]
    want = -(math.log(0.9) + math.log(0.4) + math.log(0.8) + math.log(0.7)) / 4
    assert ll == pytest.approx(want)


def test_align_and_union(spark):
    a = spark.createDataFrame([(1, 0.5)], "id long, x double")
    b = spark.createDataFrame([(2, 0.1)], "id long, y double")
    u = prep.union_features([a, b]).orderBy("id").collect()
    assert u[0].y is None and u[1].x is None
    al = prep.align_by_name(a, ["id", "x", "z"]).first()
    assert al.z == 0.0 and al.x == 0.5
