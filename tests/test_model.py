from pyspark.sql import functions as F

from penmark.operators import model, ngrams, prep


def test_logistic_save_load_roundtrip(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("pair_id"), (F.col("id") % 2).alias("label"),
                                 F.array((F.col("id") % 2) * 2.0 - 1.0 + (F.col("id") % 7) / 10.0,
                                         F.lit(0.5)).alias("x"))
    z = model.to_vector(df, "x")
    m = model.train_logistic(z, max_iter=50)
    p1 = model.predict(m, z).select("pair_id", "prediction", "prob_1").orderBy("pair_id").collect()
    acc = sum(r.prediction == r.pair_id % 2 for r in p1) / len(p1)
    assert acc > 0.9                       # above the majority baseline
    path = str(tmp_path / "m")
    model.save(m, path)
    p2 = model.predict(model.load(path), z).select("pair_id", "prediction", "prob_1").orderBy("pair_id").collect()
    assert p1 == p2


def test_fitted_preparation_save_load(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, None, 4.0]), (2, [3.0, None, 4.0]), (3, [None, None, 4.0])], "id long, x array<double>")
    st = prep.fit_vector_stats(df, "x")
    st.save(spark, str(tmp_path / "stats"))
    back = prep.VectorStats.load(spark, str(tmp_path / "stats"))
    assert back == st
    score = lambda s: [r.z for r in prep.standardize(df, "x", s, "z").orderBy("id").collect()]
    assert score(back) == score(st)
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "")], "id long, text string")
    fitted = ngrams.fit(docs, "text", 10)
    fitted.save(spark, str(tmp_path / "terms"))
    again = ngrams.TfidfModel.load(spark, str(tmp_path / "terms"))
    assert again == fitted
    weights = lambda m: sorted(tuple(r) for r in ngrams.long_weights(m.transform(docs), m, "id").collect())
    assert weights(again) == weights(fitted) and {r[0] for r in weights(fitted)} == {1, 2}
