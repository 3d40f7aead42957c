"""Epoch training against a numpy solver, and the fitted bundle from disk."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.operators import bundle, epochs

ALPHA, L1 = 0.01, 0.5


def sigmoid(m):
    return 1 / (1 + np.exp(-m))


def numpy_epochs(x, y, xv, yv, n):
    w = ahead = np.zeros(x.shape[1])
    b = ahead_b = 0.0
    t, ridge, lasso = 1.0, ALPHA * (1 - L1), ALPHA * L1
    step = 1 / (0.25 * np.mean(1 + (x ** 2).sum(1)) + ridge)
    out = []
    for e in range(1, n + 1):
        err = sigmoid(x @ ahead + ahead_b) - y
        moved = ahead - step * (x.T @ err / len(y) + ridge * ahead)
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0), ahead_b - step * err.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
        for split, xs, ys in (("train", x, y), ("val", xv, yv)):
            p = np.clip(sigmoid(xs @ w + b), 1e-15, 1 - 1e-15)
            out.append((e, split, -np.mean(np.where(ys == 1, np.log(p), np.log(1 - p))), np.mean((p > 0.5) == (ys == 1))))
    return out, w, b


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), "train" if i < 200 else "val" if i < 260 else "test") for i in range(300)]
    return spark.createDataFrame(rows, "pair_id long, z array<double>, label int, split string").repartition(4), x, y


def test_epochs_equal_numpy(problem):
    df, x, y = problem
    m = epochs.train(df, alpha=ALPHA, l1_ratio=L1, max_epochs=30)
    expected, _, _ = numpy_epochs(x[:200], y[:200], x[200:260], y[200:260], 30)
    assert [h[:2] for h in m.history] == [h[:2] for h in expected] and len(m.history) == 60
    assert np.allclose([h[2:] for h in m.history], [h[2:] for h in expected], atol=1e-9)
    val = [h for h in m.history if h[1] == "val"]
    assert m.epoch == min(val, key=lambda h: (h[2], h[0]))[0]
    # the kept weights are those of the best epoch
    p = np.clip(sigmoid(x[200:260] @ np.array(m.weights) + m.intercept), 1e-15, 1)
    assert abs(-np.mean(np.where(y[200:260] == 1, np.log(p), np.log(1 - p))) - val[m.epoch - 1][2]) < 1e-9


def test_epochs_reach_the_optimum_and_drop_noise(problem):
    df, x, y = problem
    m = epochs.train(df.where("split <> 'val'"), alpha=0.2, l1_ratio=0.9, max_epochs=150)
    assert {h[1] for h in m.history} == {"train"}
    # at the optimum, the gradient of a dropped weight is within the penalty
    err = sigmoid(x[:200] @ np.array(m.weights) + m.intercept) - y[:200]
    gradient = x[:200].T @ err / 200
    assert sum(w == 0 for w in m.weights) >= 2
    assert all(abs(g) <= 0.18 + 1e-4 if w == 0 else abs(g + 0.02 * w + math.copysign(0.18, w)) < 1e-4 for g, w in zip(gradient, m.weights))


def test_early_stopping(problem):
    df, x, y = problem
    whole = epochs.train(df, alpha=ALPHA, l1_ratio=L1, max_epochs=60)
    losses = [h[2] for h in whole.history if h[1] == "val"]
    best, idle, stop = math.inf, 0, len(losses)
    for i, v in enumerate(losses):
        best, idle = (v, 0) if v < best else (best, idle + 1)
        if idle >= 3:
            stop = i + 1
            break
    m = epochs.train(df, alpha=ALPHA, l1_ratio=L1, max_epochs=60, early_stopping=True, patience=3)
    assert max(h[0] for h in m.history) == stop


def test_no_training_rows_is_an_error(problem):
    with pytest.raises(ValueError):
        epochs.train(problem[0].where("split = 'val'"))


def test_bundle_in_a_fresh_session(spark, problem, tmp_path):
    df, _, _ = problem
    holes = df.withColumn("diff", F.transform("z", lambda v, i: F.when((i == 2) & (v > 1), F.lit(None).cast("double")).otherwise(v)))
    names = [f"f{i}" for i in range(6)]
    m = bundle.PairClassifier(names, maxIter=20).fit(holes)
    path = str(tmp_path / "model")
    m.write().save(path)
    back = bundle.PairClassifierModel.load(path)
    key = lambda t: {r.pair_id: (r.prob_1, r.prediction) for r in t.collect()}
    expected = key(m.transform(holes))
    assert key(back.transform(holes)) == expected
    assert back.fitted.names == names and back.getOrDefault("maxIter") == 20 and back.uid == m.uid and back.fitted.linear.history == m.fitted.linear.history
    holes.where("split = 'test'").coalesce(1).write.parquet(str(tmp_path / "rows"))
    code = (f"from penmark.session import get_spark\nfrom penmark.operators import bundle\n"
            f"s = get_spark(master='local[1]', shuffle_partitions=1)\n"
            f"t = bundle.PairClassifierModel.load({path!r}).transform(s.read.parquet({str(tmp_path / 'rows')!r}))\n"
            f"print('SUM', sum(r.prob_1 for r in t.collect()))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=240)
    assert got.returncode == 0, got.stderr
    total = float(next(x for x in got.stdout.splitlines() if x.startswith("SUM")).split()[1])
    assert abs(total - sum(expected[r.pair_id][0] for r in holes.where("split = 'test'").collect())) < 1e-9


def test_bundle_of_another_version_is_refused(spark, problem, tmp_path, monkeypatch):
    df = problem[0].withColumnRenamed("z", "diff")
    m = bundle.PairClassifier(["a"] * 6, maxIter=2).fit(df)
    monkeypatch.setattr(bundle, "VERSION", 2)
    m.write().save(str(tmp_path / "m"))
    monkeypatch.setattr(bundle, "VERSION", 1)
    with pytest.raises(ValueError, match="version 2"):
        bundle.PairClassifierModel.load(str(tmp_path / "m"))
