"""Toxicity, archives, nearest neighbours and the pipeline."""

import glob
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.llm import ann, toxicity, warc
from tests.conftest import SF01, SF001

# --- toxicity -----------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    scores, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    above = np.mean([(scores[y == 0] < s).mean() + (scores[y == 0] == s).mean() / 2 for s in scores[y == 1]])
    assert above > 0.93
    said = np.array([r.predicted for r in held])
    assert (said & y).sum() / said.sum() > 0.9 and (said & y).sum() / y.sum() > 0.85


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (3, "x " * 100_000, None), (3, "again", "e")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None and r.held_out is not None for r in got)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.reject(docs, labels.limit(0)).schema == docs.schema
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_features():
    f = toxicity.Featurizer({"idiot": 5.0, "scum*": 4.0})
    x = dict(zip(toxicity.FEATURES, f("You are an IDIOT, scumbag! 1d10t st*pid")))
    assert x["hits"] == 2 and x["near_second_person"] == 2 and x["strongest"] == 5 and x["hidden"] > 0 and x["hidden_hits"] == 1 and x["capitals"] > 0
    assert f(None) == f("") == [0.0] * len(toxicity.FEATURES)


# --- archives -----------------------------------------------------------------------------------------

def check_archive(pages):
    first = {}
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    for i, p in rows:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    want = Counter()
    for i, p in rows:
        refers = first.get(p) if i is not None and first.get(p) != i else None
        want[(i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == want


def test_archive_round_trip(spark):
    check_archive(spark.read.parquet(f"{SF001}/pages.parquet"))


def test_archive_edges(spark):
    rng = random.Random(8)
    ends = ["", "\n", "\r", "\r\n", "\r\n\r\n", "\n\n", "WARC/1.1\r\n"]
    rows = [(1, "u", None), (2, "u", ""), (3, None, "a" * 99), (4, "u", "a" * 99), (5, "u\r\nX: y", "b" * 100), (6, "u", "b" * 100),
            (7, "u", "é" * 300_000), (8, "u", "line\r\n" * 200_000), (8, "u", "other page of the same name " * 10), (None, "u", "b" * 100),
            (9, "u", "b" * 100), (9, "u", "b" * 100)]
    rows += [(100 + i, "u", "".join(rng.choice(["x", "é", "\r", "\n", " "]) for _ in range(150)) + e) for i, e in enumerate(ends)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    check_archive(pages)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_rebuild_the_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 1000)
    html = "".join(f"line {i} é\n" for i in range(2000))
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "tiny")], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archives(pages.coalesce(1), path)
    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(path + "/*.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.endswith(b"\r\n\r\n")
    got = {}
    for batch in ([line for line in raw.split(b"\n")[:-1]],):
        for r in warc.parse(iter(batch)):
            got.setdefault(r["record_id"], []).append(r)
    assert b"".join(r["chunk"] for r in got[1]) == html.encode() and max(len(r["chunk"]) for r in got[1]) <= 1000
    assert [r["chunk_no"] for r in got[1]] == list(range(len(got[1])))
    assert got[1][-1]["payload_digest"] == got[1][-1]["stored_digest"] == hashlib.sha256(html.encode()).hexdigest()
    assert got[2][-1]["refers_to"] == 1 and got[2][-1]["payload_bytes"] == len(html.encode())
    table = warc.read_archives(spark, path).collect()
    assert b"".join(r.chunk for r in sorted(table, key=lambda r: r.chunk_no) if r.record_id == 1) == html.encode()


def test_broken_archive_is_refused():
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"HTTP/1.1 200\r"])))
    with pytest.raises(ValueError):
        list(warc.parse(iter([b"WARC/1.1\r", b"Content-Length: 9\r", b"\r", b"abc"])))


# --- nearest neighbours -------------------------------------------------------------------------------

def brute_nearest(rows, top=5):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in ok if i % 50 == 0}:
        best = {}
        for i, v in ok:
            for j, u in ok:
                if i == q and j != q:
                    best[j] = max(best.get(j, -2), ann.cosine(v, u))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]
    return out


def test_recall(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    got = {}
    for r in ann.nearest(e, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest([(r.vec_id, r.embedding) for r in e.collect()])
    found = [len({j for j, _ in want[q]} & {j for j, _ in got.get(q, [])}) / len(want[q]) for q in want]
    assert set(got) == set(want) and np.mean(found) >= 0.9
    exact = {(q, j): s for q, x in want.items() for j, s in x}
    assert all(s == exact[q, j] for q, x in got.items() for j, s in x if (q, j) in exact)
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_nearest_edges(spark):
    same = [0.5, 0.25, 1.0]
    rows = [(0, same), (50, same), (7, same), (8, same), (9, same), (10, same), (11, same), (12, [1.0, 0.0, 0.0]), (13, None), (14, []),
            (15, [0.0, 0.0, 0.0]), (16, [1.0, None, 2.0]), (17, [float("nan"), 1.0, 1.0]), (18, [1.0, 2.0]), (None, same), (7, same)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [7, 8, 9, 10, 11], 50: [0, 7, 8, 9, 10]}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(1, 1)]
    assert ann.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_a_lone_far_candidate_is_found(spark):
    """Whatever the cosine, with the registered parameters."""
    rng = np.random.default_rng(11)
    for c in (0.4, 0.0, -0.5, -0.95):
        a, b = rng.standard_normal(16), rng.standard_normal(16)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        df = spark.createDataFrame([(0, a.tolist()), (1, b.tolist())], "vec_id long, embedding array<double>")
        assert [(r.vec_id, r["rank"]) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(1, 1)]


def recall_of(spark, x, queries):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).where(F.col("vec_id") < len(x)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in queries:
        c = unit @ unit[q]
        c[q] = -2
        hits.append(len(got[q] & set(np.argsort(-c)[:5].tolist())) / 5)
    return np.mean(hits)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_with_several_projections(spark, monkeypatch, clustered):
    """Small buckets, so that a table has three projections."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", 60)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32))
    if clustered:
        x = np.repeat(rng.standard_normal((200, 32)), 20, axis=0) + 0.3 * x
    assert ann.projections(len(x)) == 3
    assert recall_of(spark, x, range(0, len(x), 50)) >= 0.9
    if clustered:       # near neighbours: a smaller part of the buckets is visited
        h, unit = ann.Hasher(32, 3), x / np.linalg.norm(x, axis=1, keepdims=True)
        buckets = h.buckets(unit)
        share = np.mean([np.isin(buckets[:, 0], h.probes(unit[q], 0, cosine=0.9)).mean() for q in range(0, len(x), 200)])
        assert share < 0.25


def test_probing_makes_only_what_it_visits():
    h = ann.Hasher(64, 9)
    q = np.random.default_rng(1).standard_normal(64)
    q /= np.linalg.norm(q)
    found = h.probes(q, 0, 0.02, 0.9)
    assert 0 < len(found) < 5000 and len(set(found.tolist())) == len(found)


def test_probes_go_from_likely_to_unlikely():
    h = ann.Hasher(8, 2)
    rng = np.random.default_rng(3)
    q = rng.standard_normal(8)
    q /= np.linalg.norm(q)
    order = h.probes(q, 0, 0.999).tolist()
    near = q * ann.TARGET_COSINE + np.sqrt(1 - ann.TARGET_COSINE ** 2) * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(
        (lambda x: x - (x @ q)[:, None] * q)(rng.standard_normal((4000, 8))))
    seen = Counter(h.buckets(near)[:, 0].tolist())
    head = sum(seen[b] for b in order[:len(order) // 3])
    assert len(set(order)) == len(order) and head > 0.6 * 4000


# --- pipeline -----------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline
    from penmark.llm import decontaminate, jaccard, line_dedup
    from penmark.llm.common import stored
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF001), f"test-{name}")
        assert after.schema == docs.schema, name
        old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert set(new) <= set(old)
        if name == "line_dedup":
            assert set(new) == set(old) and line_dedup.report(after).where("n_dropped > 0").count() == 0
        if name == "ngram_jaccard_join":
            groups = {r.doc_id: r.class_id for r in jaccard.near_duplicates(before).collect()}
            assert sorted(new) == sorted(set(groups.values())) and all(new[i] == old[i] for i in new)
        if name == "benchmark_decontamination":
            items = spark.read.parquet(f"{SF001}/benchmark.parquet")
            assert decontaminate.report(after, items).where("contaminated").count() == 0
            flagged = {r.doc_id for r in decontaminate.report(before, items).where("contaminated").collect()}
            assert all(new[i] == old[i] for i in old if i not in flagged)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF001)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    """Rows without ids and rows that share one keep their own texts through every stage."""
    import corpus_pipeline
    from penmark.llm.common import stored
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    twice = text(40)
    rows = [(None, text(40), "a") for _ in range(20)] + [(None, twice, "a"), (None, twice, "b"), (9, text(30), None), (9, text(30), "c"),
                                                         (9, None, "c"), (10, "", "c"), (None, None, None)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    before = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, str(tmp_path)), f"test-{name}")
        assert after.dtypes == before.dtypes
        if name == "ngram_jaccard_join":
            assert Counter(r.text for r in after.collect())[twice] == 1
        before = after
    kept = Counter(r.text for r in before.collect() if r.text)
    assert kept == Counter({t for _, t, _ in rows if t})
    packed = corpus_pipeline.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in packed) == before.count()


def test_toxicity_features_by_a_plain_loop(spark):
    lexicon = {"the": 4.0, "on*": 3.5, "ther": 5.0, "ist": 4.5}
    f = toxicity.Featurizer(lexicon)
    for r in spark.read.parquet(f"{SF001}/documents.parquet").limit(80).collect():
        words = "".join(c.lower() if c.isascii() and (c.isalnum()) else c if not c.isascii() else " " for c in r.text).split()
        weight = []
        for w in words:
            terms = [w] + [w[:k] + "*" for k in (4, 5, 6) if len(w) > k]
            weight.append(max([lexicon.get(t, 0.0) for t in terms]))
        hits = [i for i, x in enumerate(weight) if x]
        you = [i for i, w in enumerate(words) if w.encode() in toxicity.SECOND_PERSON]
        size = len(r.text.encode())
        want = {"words": np.log1p(len(words)), "hits": len(hits), "density": len(hits) / len(words), "weighted_density": sum(weight) / len(words),
                "strongest": max(weight), "distinct": len({words[i] for i in hits}), "second_person": len(you) / len(words),
                "stretch_density": max((sum(i <= j < i + toxicity.STRETCH for j in hits) for i in hits), default=0) / min(len(words), toxicity.STRETCH),
                "near_second_person": sum(any(abs(i - y) <= toxicity.NEAR for y in you) for i in hits),
                "capitals": sum("A" <= c <= "Z" for c in r.text) / size, "exclamations": r.text.count("!") / size,
                "stops": sum(c in "!?.,;:" for c in r.text) / size, "digits": sum(c in "0123456789" for c in r.text) / size,
                "word_length": size / len(words)}
        got = dict(zip(toxicity.FEATURES, f(r.text)))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (r.doc_id, want, got)


def test_queries_are_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
