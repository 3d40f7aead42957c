"""Periodic runs, the quality rules and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.llm import periodic, quality, spelling
from tests.conftest import SF001, SF01


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words here", "x"), (3, "word and more. " * 30_000, "x"), (4, "same text twice here now", None),
            (4, "same text twice here now", None), (5, "x" * 50_000, "x"), (5, "x" * 50_001, "x"), (6, " \n\n ", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n string").withColumn("word", F.lit(1)).withColumn("start", F.lit("a"))


# --- periodic runs ------------------------------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            m = j + q - i
            if j > i and m >= max(6, 4 * q) and not any(w[i:i + m - p] == w[i + p:i + m] for p in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rnd = random.Random(5)
    texts = []
    for _ in range(800):
        k = rnd.choice([1, 2, 2, 3, 6])
        w = [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6 and len(w) > 8:
            unit = w[:rnd.randint(1, 6)]
            w = w[:rnd.randint(0, 20)] + unit * rnd.randint(2, 7) + w[rnd.randint(0, 20):] + unit * rnd.randint(2, 7)
        texts.append(w)
    got = periodic.find_runs([np.array(w, dtype=np.int64) for w in texts])
    assert got == [brute_runs(w) for w in texts] and sum(map(len, got)) > 300


def test_run_report_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: r for r in periodic.report(docs).collect()}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in gone).encode()).hexdigest()


def test_long_texts_stay_near_linear():
    for w, runs in (([0] * 300_000, [(0, 300_000, 1)]), ([i % 7 for i in range(300_000)], [(0, 300_000, 7)]),
                    (list(range(200_000)), [])):
        assert periodic.find_runs([np.array(w), np.array(w[:5])])[0] == runs


def test_runs_edges(spark, odd):
    got = periodic.report(odd).collect()
    assert len(got) == odd.count()
    none = [r for r in got if r.doc_id in (1, 2, 6)]
    assert all(r.n_runs == 0 and r.start is None and r.runs_sha256 == r.collapsed_sha256 == hashlib.sha256(b"").hexdigest() for r in none)
    assert [r.n_runs for r in got if r.doc_id is None] == [0]
    assert len({tuple(r) for r in got if r.doc_id == 4}) == 1
    long = [r for r in got if r.doc_id == 3][0]
    assert long.n_runs > 0 and long.length > 10_000
    assert periodic.report(odd.limit(0)).count() == 0
    texts = {r.doc_id: r for r in periodic.runs(odd).collect()}
    assert texts[3].collapsed == "word and more." and [tuple(x) for x in texts[3].runs] == [(0, 90_000, 3)] and texts[1].collapsed == ""


# --- quality ------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    scores, y = np.array([r.score for r in held]), np.array([r.quality for r in held])
    above = np.mean([(scores[y == 0] < s).mean() + (scores[y == 0] == s).mean() / 2 for s in scores[y == 1]])
    said = np.array([r.predicted for r in held])
    assert above > 0.97 and (said[y == 1] == 1).mean() > 0.98 and (said[y == 0] == 0).mean() > 0.8


def test_compiled_rules_equal_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) and model.table(spark).count() == len(model.rules)
    for r in model.score(docs.select("doc_id", "text")).limit(200).collect():
        x = quality.statistics(r.text)
        total = model.intercept
        for rule, weight in model.rules:
            if all(x[s] <= at if side == "<=" else x[s] > at for s, side, at in rule):
                total += weight
        assert abs(r["__score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_paths_of_trees():
    described = ("forest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 2 <= 0.25)\n      Predict: 0.0\n"
                 "     Else (feature 2 > 0.25)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n")
    assert quality.rules_of(described) == [((2, "<=", 0.25),), ((2, "<=", 0.5),), ((2, "<=", 0.5), (2, ">", 0.25)), ((2, ">", 0.5),)]


def test_statistics_against_a_plain_count():
    x = dict(zip(quality.STATISTICS, quality.statistics("Ab cd! ab\n\nAb cd! ab\n12 é$")))
    assert x["words"] == np.log1p(8) and x["distinct_words"] == 5 / 8 and x["top_word"] == 2 / 8 and x["repeated_lines"] == 1 - 2 / 3
    assert x["capitals"] == 2 / 27 and x["digits"] == 2 / 27 and x["symbols"] == 1 / 27 and x["non_ascii"] == 2 / 27 and x["exclamations"] == 2 / 27
    assert quality.statistics(None) == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)


def test_held_out_quality_is_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(r.score is not None and r.held_out is not None for r in got)
    assert all(r.score < 1e-6 for r in quality.score(odd, labels.limit(0)).collect())
    assert quality.score(odd.limit(0), labels).count() == 0


# --- spelling variants --------------------------------------------------------------------------------


def brute_variants(n):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    rows, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        rows[w] = len(others)
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


@pytest.fixture
def many_ranges(spark):
    """So many ranges that nodes reach over borders."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_variants_against_brute_force(spark, many_ranges):
    rnd = random.Random(3)
    n = {}
    for _ in range(400):        # few letters, so that prefixes, suffixes and repeated letters abound
        w = "".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8)))
        n[w] = rnd.choice([2, 3, 25, 40, 300, 5000])
    n.update({"chain" * 3: 2, "chain" * 3 + "s": 25, "chains" + "chain" * 2 + "s": 300, "aaaaaaa": 4, "aaaaaaaa": 4, "aaaaaaaaa": 90})
    got = {tuple(r) for r in spelling.group(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()}
    expected = brute_variants(n)
    assert got == expected
    assert sum(1 for r in expected if r[1] and r[2] != r[1]) > 0     # chains of more than one step


def test_words_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    n = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    assert {(r.word, r.n) for r in spelling.count_words(docs, alter=True).collect()} == {(w, c) for w, c in n.items() if c >= 2}


def test_variants_edges(spark, odd):
    rows = spelling.report(odd).collect()
    assert all(r.n >= 2 and len(r.word) >= 7 for r in rows)
    assert spelling.report(odd.limit(0)).count() == 0
    assert spelling.report(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0
    # a very long word and one a letter longer: near, numbered in ranges, no prefix is written out
    long = spark.createDataFrame([(None, f"{'ab' * 20_000} {'ab' * 20_000} {'ab' * 20_000}c {'ab' * 20_000}c")], "doc_id long, text string")
    assert sorted((len(r.word), r.n, r.n_near, r.form) for r in spelling.report(long).collect()) == [(40_000, 2, 1, None), (40_001, 2, 1, None)]
