"""Work that must be done once, and work that must not grow faster than the input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def write_documents(spark, path, n=60):
    r = random.Random(11)
    words = ["the", "fox", "runs", "and", "I", "was", "Élan", "in", "Paris", "because", "they", "might", "sleep."]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), r.choice(["en", "fr"]), f"src{r.randint(8, 11)}", 1) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def counted(monkeypatch, spark, module, name):
    """The rows that pass through a function's result from now on."""
    reads, made = spark.sparkContext.accumulator(0), getattr(module, name)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    monkeypatch.setattr(module, name, lambda *a, **k: (d := made(*a, **k)).mapInArrow(count, d.schema))
    return reads


def test_source_report_reads_its_articles_once(spark, tmp_path, monkeypatch):
    from penmark.operators import model
    from penmark.plans import model_queries
    sf = write_documents(spark, tmp_path)
    grown = []
    real = model.train_forest
    monkeypatch.setattr(model, "train_forest", lambda *a, **k: grown.append(real(*a, trees=3, **k)) or grown[-1])
    reads = counted(monkeypatch, spark, model_queries.tables, "articles")
    got = model_queries.source_report(spark, sf).collect()
    assert {r.section for r in got} == {"count", "mean", "importance", "report"}
    assert sum(r.value for r in got if r.section == "count") == 60
    assert reads.value == 60        # 240 before
    assert grown[0].stages[-1].getOrDefault("cacheNodeIds")


def test_forest_has_no_more_partitions_than_cores(spark, monkeypatch):
    from penmark.operators import model
    seen = []
    fit = model.Pipeline.fit
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or fit(self, df))
    df = spark.range(0, 200, 1, 40).select((F.col("id") % 2).alias("label"), F.array((F.col("id") % 2) * 1.0, F.col("id") * 1.0).alias("x"))
    m = model.train_forest(model.to_vector(df, "x"), trees=2)
    assert seen == [spark.sparkContext.defaultParallelism]      # 40 before
    assert model.predict(m, model.to_vector(df, "x")).where("prediction = label").count() > 190


def walked(seed, r, width, total, share):
    """The sample of a range, draw by draw."""
    import hashlib
    import math
    missed, at, i, taken = math.log1p(-share) if share < 1 else -math.inf, r * width, 0, []
    while True:
        u = int(hashlib.md5(f"{seed}|gap|{r}|{i}".encode()).hexdigest()[:15], 16) / (1 << 60)
        at += math.floor(math.log1p(-u) / missed)
        if at >= min(total, (r + 1) * width):
            return taken
        taken.append(at)
        at, i = at + 1, i + 1


def test_taken_ordinals_are_the_walk():
    from penmark.operators import pairs
    for share in (1.0, 0.25, 0.9, 0.003):
        width = max(1, round(pairs.RANGE_DRAWS / share))
        for r, total in ((0, 10**9), (7, 10**9), (3, 3 * width + 5), (0, 2)):
            assert pairs.taken_ordinals(r, width, total, share, 42).tolist() == walked(42, r, width, total, share)
    o = [j * (j - 1) // 2 + d for j in (1, 2, 3, 1000, 94906266) for d in (0, j - 1)]
    import numpy as np
    assert pairs.rows_of_ordinals(np.array(o)).tolist() == [j for j in (1, 2, 3, 1000, 94906266) for _ in (0, 1)]


def test_sampled_pairs_shuffle_members_not_draws(spark, monkeypatch):
    """Every draw against the member table, with blocks and slices so small that groups span many; ids repeat and may be null."""
    from penmark.operators import pairs
    for name, value in (("RANGE_DRAWS", 8), ("SLICE_RANGES", 3), ("MOST_SLICES", 40), ("BLOCK_RANKS", 4), ("WALK_RANGES", 2)):
        monkeypatch.setattr(pairs, name, value)
    rows = [(i, f"g{i % 3}") for i in range(70)] + [(900, "g0"), (900, "g0"), (None, "g1"), (5, None), (6, "one")] + [(1000 + i, f"p{i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "i long, g string")
    mem = pairs.ranked_members(df, "g", "i", 42)
    space, total = pairs.pair_space(mem, "g", 42)
    member = {(x.g, x["rank"]): x.i for x in mem.collect()}
    firsts = sorted((x.__getitem__("__first"), x.g) for x in space.collect())
    for share in (1.0, 0.3):
        width = max(1, round(8 / share))
        want = []
        for o in (o for r in range(-(-total // width)) for o in walked(42, r, width, total, share)):
            first, g = max(x for x in firsts if x[0] <= o)
            j = next(j for j in range(1, 200) if j * (j + 1) // 2 > o - first)
            want.append((g, o, member[g, o - first - j * (j - 1) // 2], member[g, j]))
        out = pairs.sampled_group_pairs(df, "g", "i", share)
        got = sorted(map(tuple, out.collect()), key=lambda x: x[1])
        # equal hashes of repeated ids may change places; both have the same id
        assert got == want and (share < 1 or len(got) == total)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[:plan.index("MapInArrow")]      # the draws were shuffled three times
    assert pairs.sampled_group_pairs(df.where("g = 'one'"), "g", "i", 0.5).count() == 0


def odd_texts(r, n):
    parts = ["e", "É", "İ", "Σ", "ß", "1", "_", "٣", "²", " ", "\n", " ", ".", "'", "ht-tp", "http://x", "😀", "𝒳y", "ab", "the fox"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["", " ", "a", "ab"]


def test_words_of_normalised_texts(spark):
    from penmark.functions import text as T
    from penmark.operators import ngrams
    df = spark.createDataFrame([(t,) for t in odd_texts(random.Random(5), 3000)] + [(None,)], "t string").select(T.normalize_text("t").alias("t"))
    assert [x.t for x in df.where(~ngrams.normalized_unigrams("t").eqNullSafe(ngrams.unigrams("t"))).limit(3).collect()] == []


def test_wide_features_normalise_once_and_weigh_by_the_counts(spark, tmp_path, monkeypatch):
    """The n-gram cells are those of the fitted model's transform, the basic ones those of the texts; texts are normalised once."""
    from penmark.operators import basic, ngrams
    from penmark.plans import syntax_queries
    sf = write_documents(spark, tmp_path)
    calls, real = [], basic.T.normalize_text
    monkeypatch.setattr(basic.T, "normalize_text", lambda c: calls.append(c) or real(c))
    monkeypatch.setattr(ngrams.TfidfModel, "transform", lambda *a, **k: 1 / 0)      # it split every text again
    registry, rows = syntax_queries.wide_features(spark, sf, basic_too=True)
    assert len(calls) == 1          # twice before
    monkeypatch.undo()
    docs = syntax_queries.styled_documents(spark, sf).withColumnRenamed("doc_id", "article_id")
    norm = docs.select("article_id", real("text").alias("text"))
    model = ngrams.fit(norm, "text", 500)
    names = {f: [n for _, g, n, _ in registry.rows if g == f] for f in ("basic", "word_ngram")}
    assert names["word_ngram"] == model.terms
    want = {x.article_id: x for x in model.transform(norm, "text").join(basic.basic_features(docs, keep=["article_id"]), "article_id").collect()}
    first = min(p for p, f, _, _ in registry.rows if f == "word_ngram")
    got = rows.collect()
    assert len(got) == len(want) == 60
    for x in got:
        cells = {c.pos: c.value for c in x.cells}
        y = want[x.article_id]
        assert [cells.get(i) for i in range(88)] == [None if y[n] is None else float(y[n]) for n in names["basic"]]
        assert all(abs(cells.get(first + i, 0.0) - v) < 1e-12 for i, v in enumerate(y.tfidf))
        assert [i for i, v in enumerate(y.tfidf) if v] == [p - first for p in sorted(cells) if p >= first]


def plain_depth(tokens):
    """The deepest token by following heads; None if there is none, or its way is unknown."""
    found = []
    for i, (tok, _, dep, _) in enumerate(tokens):
        at, d = i, 0
        while at is not None and tokens[at][0] is not None and tokens[at][3] != tokens[at][0] and d < 1000:
            at, d = tokens[at][3], d + 1
        known = at is not None and tokens[at][0] is not None
        found += [0] if dep == "ROOT" else [d + 1] if known else []
    return max(found, default=None)


def test_sentence_features_by_a_plain_loop(spark):
    """Heads, tags and ids may be unknown; the loop over rows and the columns of a batch must agree."""
    from penmark.operators import syntax
    r, rows = random.Random(9), []
    for a in range(80):
        for s in range(r.randint(1, 4)):
            n = r.choice([0, 1, 2, 3, 17, 40])
            odd = a % 4 == 0
            toks = [(None if odd and r.random() < .05 else i, r.choice(["VERB", "AUX", "NOUN", "PROPN", "ADJ", "ADV", None]),
                     r.choice(["ROOT", "mark", "cc", "auxpass", "dep", None] if odd else ["ROOT", "cc", "dep", "dep"]),
                     None if odd and r.random() < .05 else r.randint(0, i)) for i in range(n)]
            rows.append((a, s, r.choice(["x?", "x? \n", "x.", None]), toks, [0] * r.randint(0, 2), None if r.random() < .95 else "failed"))
    kind = "article_id long, sent_id long, text string, tokens array<struct<tok_id:bigint,pos:string,dep:string,head_id:bigint>>, chunks array<bigint>, error string"
    df = spark.createDataFrame(rows, kind)
    wanted = syntax.RATIOS + syntax.SENTENCE_FEATURES
    got = {x.article_id: x.asDict() for x in syntax.article_features(df, wanted).collect()}
    fewer = [w for w in wanted if w != "avg_dependency_depth"]
    by_rows = {x.article_id: x.asDict() for x in syntax.article_features(df, fewer).collect()}
    for a, x in got.items():
        mine = [t for i, _, _, t, _, e in rows if i == a and e is None]
        depth = sum(plain_depth(t) or 0 for t in mine) / len(mine)
        assert x == by_rows[a] | {"avg_dependency_depth": depth}
    only = syntax.article_features(df, ["avg_dependency_depth"])
    assert {x.article_id: x.avg_dependency_depth for x in only.collect()} == {a: x["avg_dependency_depth"] for a, x in got.items()}
    assert "MapInArrow" in only._jdf.queryExecution().executedPlan().toString()      # lambdas made every token an object, several times


def test_depths_of_cycles_and_wrong_heads():
    import numpy as np
    import pytest
    from penmark.operators import syntax
    assert syntax.depths_of(np.array([0, 3, 2]), np.array([0, 0, 1, 1, 1]), np.array([0, 1, 1, 1, 0])).tolist() == [0, 1, 2, 1, 0]
    assert syntax.depths_of(np.array([2]), np.array([1, 0]), np.array([1, 1])).tolist() == [2, 2]      # one round for two tokens
    with pytest.raises(ValueError):
        syntax.depths_of(np.array([2, 2]), np.array([0, 2, 0, 0]), np.array([0, 1, 0, 1]))


def test_documents_are_checked_together_as_they_are_one_by_one():
    from penmark.operators import annotate
    tok = ("a", "X", "dep", 0)
    sent = lambda **k: [{"text": "a", "tokens": [tok], "ents": [], "chunks": []} | k]
    good = [sent(), [], sent(tokens=[]), sent(ents=[(0, "ORG")], chunks=[0]), sent(tokens=[tok, ("b", "X", "dep", 1)])]
    bad = [None, (), [3], [{"text": "a"}], sent(text=None), sent(ents=[(1, "ORG")]), sent(ents=[(0, 1)]), sent(chunks=[1]), sent(tokens=[], chunks=[0]),
           *[sent(tokens=[tok, t]) for t in (("a", "X", "dep", 2), ("a", "X", "dep", -1), ("a", "X", "dep", 1 << 70), ("a", "X", "dep", True), ("a", None, "dep", 0), ("a", "X", "dep"))]]
    assert annotate.checked(good) == [None] * len(good) and annotate.checked([]) == []
    for d in bad:
        got = annotate.checked([*good, d])
        assert got == [*[None] * len(good), annotate.problem(d)] and got[-1]


def test_scratch_tables_are_zstd(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from penmark.plans import shared
    assert shared.stored_once(spark, str(tmp_path), "y", lambda: spark.range(3).coalesce(1)).count() == 3
    path = shared._paths[spark.sparkContext.applicationId, str(tmp_path), "y"]
    assert {pq.read_metadata(f).row_group(0).column(0).compression for f in glob.glob(f"{path}/part-*")} == {"ZSTD"}      # snappy before
