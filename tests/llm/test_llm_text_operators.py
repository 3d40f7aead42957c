"""Operators on texts against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penmark.llm import decontaminate, jaccard, line_dedup, lm_score, packing, pii, token_counts
from penmark.llm.common import words_of
from tests.conftest import SF001

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    long = "word and more. " * 30_000
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words here", "x"), (3, long, "x"), (4, "same text twice here now", None),
            (4, "same text twice here now", None), (5, "x" * 50_000, "x"), (6, " \n\n ", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_words(texts):
    for _, t in texts[:50]:
        assert [w.decode() for w in words_of(t)] == WORD.findall(lower_ascii(t))
    assert words_of(None) == words_of("") == words_of("- .\n") == []


# --- token counts -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())


def test_every_prefix_counts_exactly(sentencepiece_model):
    c = token_counts.counter(token_counts.model_path())
    rng = random.Random(3)
    alphabet = list("abthe ing  \n,.%éß漢😀▁<s>0\t\x00")
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(500)]
    cases += [" " * n for n in range(1, 20)]
    for t, changes in zip(cases, c.prefix_changes(cases)):
        assert token_counts.counts_at(changes).tolist() == [len(sentencepiece_model.encode(t[:i + 1])) for i in range(len(t))]


def test_token_counts_match_the_library(spark, texts, sentencepiece_model):
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.read.parquet(f"{SF001}/documents.parquet")).collect()}
    for i, t in texts:
        assert (got[i].n_tokens, got[i].n_bytes) == (len(sentencepiece_model.encode(t)), len(t.encode()))
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_prefix_table_answers_budgets(spark, texts, sentencepiece_model):
    docs = spark.createDataFrame(texts[:20], "doc_id long, text string")
    table = token_counts.count_tokens(docs, keep_prefixes=True)
    by_id = dict(texts)
    for r in token_counts.truncate_to(table, [0, 7, 50]).collect():
        t = by_id[r.doc_id]
        assert r.n_tokens <= r.budget and r.n_tokens == len(sentencepiece_model.encode(t[:r.n_chars]))
        assert all(len(sentencepiece_model.encode(t[:n])) > r.budget for n in range(r.n_chars + 1, min(len(t), r.n_chars + 30) + 1))
    from pyspark.sql import functions as F
    n = table.select("doc_id", token_counts.tokens_of_prefix(F.col("prefix_changes"), F.lit(40)).alias("n"))
    for r in n.collect():
        assert r.n == len(sentencepiece_model.encode(by_id[r.doc_id][:40]))


def test_token_counts_edges(odd, empty):
    got = sorted(((r.doc_id, r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(odd).collect()), key=str)
    assert (1, 0, 0) in got and (2, 0, 0) in got and len(got) == 8 and sum(g[0] is None for g in got) == 1
    assert token_counts.count_tokens(empty).count() == 0


# --- decontamination ----------------------------------------------------------------------------------

def brute_hits(items, words, window=13):
    hit, found = set(), set()
    for name, it in items:
        k = min(window, len(it))
        for i in range(len(it) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == it[i:i + k]:
                    hit.update(range(j, j + k))
                    found.add(name)
    return hit, found


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        window, alphabet = rng.choice([2, 3, 5]), [b"a", b"b", b"c"]
        items = [(str(i), [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 4))]
        words = [rng.choice([*alphabet, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, found = decontaminate.Automaton(items, window).scan(words)
        hit, names = brute_hits(items, words, window)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == names


def test_longest_matches():
    a = decontaminate.Automaton([("1", [b"a", b"b", b"c"]), ("2", [b"b", b"c", b"d"])], 2)
    ids = [a.vocab.get(w, -1) for w in (b"a", b"b", b"c", b"d", b"a")]
    assert a.longest_matches(ids) == [1, 2, 3, 3, 1]


def test_decontamination_report(spark, texts):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    held = [(str(r.item_id), words_of(r.text)) for r in items.collect()]
    windows = {}
    for name, w in held:
        for i in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(name)
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    for i, t in texts:
        words, hit, names = words_of(t), set(), set()
        for j in range(len(words)):
            if (w := tuple(words[j:j + 13])) in windows:
                hit.update(range(j, j + len(w)))
                names |= windows[w]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
    kept = {r.doc_id: r.text for r in decontaminate.clean(docs, items).collect()}
    for i, t in texts:
        if not got[i].contaminated:
            assert kept[i] == t
    again = decontaminate.report(spark.createDataFrame([(i, t) for i, t in kept.items()], "doc_id long, text string"), items)
    assert again.where("contaminated").count() == 0


def test_a_large_benchmark_is_scanned_in_groups(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice((5, 20, 90))))) for k in range(12)]
    docs = []
    for k in range(60):
        t = [f"f{rng.randint(0, 500)}" for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 15))
            t[len(t) // 2:len(t) // 2] = w[a:a + rng.randint(5, 40)]
        docs.append((k % 40 if k % 7 else None, " ".join(t), len(" ".join(t))))
    docs += [(1, None, 0), (2, "", 0), (3, items[1][1], 9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for f in (decontaminate.report, decontaminate.clean):
        whole, grouped = (sorted(map(repr, f(docs, bench, max_chars=n).collect())) for n in (10 ** 6, 200))
        assert whole == grouped
    assert decontaminate.report(docs, bench, max_chars=200).where("contaminated").count() > 5


def test_decontamination_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (None, "word and more"), (2, "same text twice"), (2, "same text twice"), (3, "")],
                                  "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(odd, items).collect()}
    assert got[4].n_hit == 3 and got[4].n_items == 1 and got[4].contaminated and got[1].n_words == 0 and not got[3].contaminated
    kept = decontaminate.clean(odd, items)
    assert kept.schema == odd.schema and [r.text for r in kept.where("doc_id = 4").collect()] == [" here now"] * 2
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(empty, items).count() == decontaminate.clean(empty, items).count() == 0
    with pytest.raises(ValueError):
        decontaminate.build(items, max_chars=3)


# --- line dedup ---------------------------------------------------------------------------------------

def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: lower_ascii(x.strip(" \t\n\x0b\x0c\r"))
    rows = [(line_dedup.NO_ID if i is None else i, t or "") for i, t in rows]
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return Counter((i, len(t.split("\n")), "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in rows)


def check_lines(df, rows):
    want = Counter()
    for (i, n, kept), c in brute_lines(rows).items():
        want[(None if i == line_dedup.NO_ID else i, n, hashlib.sha256(kept.encode()).hexdigest())] += c
    got = Counter((r.doc_id, r.n_lines, r.kept_sha256) for r in line_dedup.report(df).collect())
    assert got == want


def test_line_dedup_against_brute_force(spark, texts):
    check_lines(spark.read.parquet(f"{SF001}/documents.parquet"), texts)


def test_line_dedup_edges(spark, odd, empty):
    check_lines(odd, [(r.doc_id, r.text) for r in odd.collect()])
    line = "A line that is LONG enough"
    rows = [(1, line), (1, f"\t{line} "), (2, line.lower() + "\nother"), (None, f"x\n{line}\r"), (7, line), (8, "ä" * 19), (9, "ä" * 19),
            (10, "ä" * 19), (11, "é" * 20), (12, "é" * 20), (13, f"{'é' * 20}\n{'é' * 20}"), (14, line + "\n" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(df, rows)
    kept = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    assert kept[14] == line + "\n" + line and kept[2] == "other" and kept[None] == "x" and kept[11] == ""
    assert line_dedup.report(empty).count() == line_dedup.clean(empty).count() == 0


def test_small_filter_gives_the_same_lines(spark, texts, monkeypatch):
    monkeypatch.setattr(line_dedup, "MAX_FILTER_BITS", 1 << 10)      # nearly everything is suspected
    monkeypatch.setattr(line_dedup, "SEGMENT_BITS", 1 << 8)
    check_lines(spark.createDataFrame(texts, "doc_id long, text string"), texts)


# --- n-gram Jaccard join ------------------------------------------------------------------------------

def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words_of(t)
        k = min(5, len(w))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set())
    links = {n: set() for n in range(len(rows))}
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    return links


def check_join(rows, df, **how):
    links = brute_links(rows)
    want = Counter()
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        ids = [rows[m][0] for m in seen]
        want[(i, None if None in ids else min(ids), len(links[n]))] += 1
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, **how).collect())
    assert got == want


def near_copies(n, words=120, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(words)] = f"z{rng.randrange(10_000)}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_jaccard_join_against_brute_force(spark, texts):
    rows = texts + near_copies(60)
    check_join(rows, spark.createDataFrame(rows, "doc_id long, text string"), block=16)


def test_jaccard_edges(spark, empty):
    rows = [(1, None), (2, ""), (3, ""), (4, "one two"), (5, "One, two!"), (5, "One, two!"), (6, "one two three"), (None, "a b c d e f"),
            (7, "a b c d e f"), (8, "q " * 20_000), (9, "q " * 10_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    check_join(rows, df)
    kept = sorted((r.doc_id is not None, r.doc_id or 0) for r in jaccard.keep_one(df).collect())
    assert kept == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 6), (True, 8)]
    assert jaccard.keep_one(df).schema == df.schema
    assert jaccard.near_duplicates(empty).count() == jaccard.keep_one(empty).count() == 0


def test_rows_without_ids_are_told_apart(spark):
    """100 pairs of near copies without ids, and rows that share an id but no text."""
    rng = random.Random(8)
    rows = []
    for _ in range(100):
        w = [f"w{rng.randrange(10 ** 9)}" for _ in range(60)]
        rows += [(None, " ".join(w)), (None, " ".join(w[:-1] + ["end"]))]
    rows += [(7, f"{a} one two three four five six seven") for a in "abc"] + [(7, "a one two three four five six seven"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("mine"))
    kept = jaccard.keep_one(df)
    texts = [r.text for r in kept.collect()]
    assert kept.dtypes == df.dtypes and len(texts) == 100 + 3 + 2
    assert {t for i, t in rows if i == 7} <= set(texts) and None in texts and "" in texts
    links = jaccard.near_duplicates(df).where("doc_id is null").groupBy("n_links").count().collect()
    assert {r.n_links: r["count"] for r in links} == {1: 200, 0: 2}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)]
    got = {r.v: r.root for r in jaccard.components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert {got[i] for i in range(41)} == {0}
    for a, b in links:
        assert a == b or got[a] == got[b] <= min(a, b)


# --- packing ------------------------------------------------------------------------------------------

def test_packing_covers_every_id_once(spark, texts, odd):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = texts[:80] + [(r.doc_id and r.doc_id + 10_000, r.text) for r in odd.collect() if r.doc_id != 4]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=30_000).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_encoder_matches_the_library():
    e = packing.encoder(packing.DEFAULT_TOKENIZER)
    rng = random.Random(5)
    alphabet = [*"abthe ing  \n,.%$'’éİΣσς漢😀x0 \t́ \x0b\x85", "<|endoftext|>", "'s", "'ll", "é"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for t, ids in zip(cases, e.encode(cases)):
        assert np.frombuffer(ids, "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_retrieval_prefers_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 100, size=(12, 500)) for k in range(1, 5)]
    ids = [x.astype("<u2") for t in topics for x in t]
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=1 << 16)
    idf = np.log1p((len(ids) - df + 0.5) / (df + 0.5)).astype(np.float32)
    sequences = packing.pack_shard(list(range(len(ids))), ids, idf, 500.0)
    pure = [len({i // 12 for i, _, _ in s}) == 1 for s in sequences if len(s) > 1]
    assert np.mean(pure) > 0.6


def test_every_term_of_a_seed_queries():
    # 40 terms weigh alike in the seed; each neighbour shares just one of them
    ids = [np.arange(100, 140, dtype="<u2")] + [np.array([100 + k, 1000 + k], dtype="<u2") for k in range(40)]
    shard = packing.Shard(ids, np.ones(1 << 16, dtype=np.float32), 3.0)
    shard.left[0] = 0
    assert sorted(shard.neighbours(0).tolist()) == list(range(1, 41))
    rng = np.random.default_rng(1)
    ids = [np.unique(rng.integers(0, 60 if k % 3 else 900, size=30)).astype("<u2") for k in range(200)]
    idf = rng.random(1 << 16).astype(np.float32) + 0.1
    shard = packing.Shard(ids, idf, 20.0)
    for used in (1, 120, 180):
        shard.left[:used] = 0
        share = {i: sum(float(idf[t]) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(x) / 20.0)) for t in set(x) & set(ids[0]))
                 for i, x in enumerate(ids) if i >= used and set(x) & set(ids[0])}
        found = shard.neighbours(0).tolist()
        assert set(found) == set(share)
        assert all(share[a] >= share[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_likely_neighbours_meet_in_a_shard(spark):
    # 30 topics, each dealt over ids and rows without a doc_id; then one text many times
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    topics = [["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for _ in range(30)]
    rows = [(k * 977 % 100_003 if k % 3 else None, " ".join(rng.choice(topics[k % 30]) for _ in range(40))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = {(r.doc_id, r.text): k % 30 for k, r in enumerate(df.collect())}
    topic = {i: k for (i, _), k in docs.items() if i is not None}
    tokens = sum(r.n for r in packing.tokenize(df).collect())
    pieces = packing.pack(df, window=256, shard_tokens=tokens // 30).collect()
    assert len({p.sequence_id >> 32 for p in pieces}) >= 25
    assert sum(p.length for p in pieces) == tokens
    pairs = same = 0
    by_shard = {}
    for p in pieces:
        if p.doc_id is not None:
            by_shard.setdefault(p.sequence_id >> 32, set()).add(p.doc_id)
    for ids in by_shard.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            pairs += 1
            same += topic[a] == topic[b]
    assert same > 0.3 * pairs                       # by chance: 1 in 30

    copies = spark.createDataFrame([(None, "the very same text of some ten words or so") for _ in range(500)], "doc_id long, text string")
    pieces = packing.pack(copies, window=64, shard_tokens=1_000).collect()
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id >> 32] += p.length
    assert len(sizes) >= 5 and max(sizes.values()) < 2_500


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0


# --- personal data ------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 14 <= len(d) <= 19 and sum(int(x) * 2 - 9 * (int(x) > 4) if j % 2 else int(x) for j, x in enumerate(d[::-1])) % 10 == 0,
                  "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(a, list(PATTERNS)[k], b) for a, k, b in sorted(out)]


def test_base_patterns_against_regexes():
    rng = random.Random(4)
    for alphabet in ("a1.@-+ 2%x(9", "0123456789 -.+()"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("x" * 200_000 + "1" * 200_000 + "@") == []


def test_pii_query(spark, texts, odd, empty):
    got = {r.doc_id: r for r in pii.find(spark.read.parquet(f"{SF001}/documents.parquet")).collect()}
    for i, t in texts:
        base = brute_spans(t)
        written = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == k for x in base) for k in PATTERNS]
    assert pii.find(odd).where("spans = ''").count() == 8
    assert pii.find(empty).count() == 0


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(pii.labelled_table(spark))


def test_tagger_finds_what_patterns_miss(tagger):
    found = pii.tagged_spans(tagger, ["Onth wher the password=0a9b8c7d6e5f4a3b, ering of", "call (555) 014-2033 and the ering", "plain words only, 12 of them."])
    assert [k for _, k, _ in found[0]] == ["secret"] and [k for _, k, _ in found[1]] == ["phone"] and found[2] == []


def test_pruned_viterbi_is_exact(tagger, texts):
    for _, t in texts[:40]:
        tokens = [t.split()[:120]]
        rows = tagger.rows(tokens)
        scores = tagger.scores(rows)
        full = tagger.decode([scores[1:-1].astype(float)])[0] if tokens[0] else np.empty(0)
        got = np.zeros(len(tokens[0]), dtype=int)
        spans, parts = tagger.runs(scores, rows)
        for (a, b), path in zip(spans, tagger.decode(parts)):
            got[a - 1:b - 1] = path
        assert (full == got).all()


# --- language-model scores ----------------------------------------------------------------------------

def test_network_gradient():
    net = lm_score.Network()
    rng = np.random.default_rng(0)
    target = rng.integers(0, lm_score.SIZE, 40).astype(np.int32)
    context = rng.integers(0, lm_score.SIZE, (40, 2 * lm_score.SIDE)).astype(np.int32)
    before = net.flat.copy()
    seen = {k: np.ones_like(w) * 1e8 for k, w in net.w.items()}        # the step is then -RATE * gradient / 1e4
    net.step(target, context, seen)
    gradient = (before - net.flat) / lm_score.RATE * 1e4 * 40 ** 0.5
    k = int(np.argmax(np.abs(gradient)))
    loss = []
    for d in (1e-2, -1e-2):
        moved = lm_score.Network(before.copy())
        moved.flat[k] += d
        loss.append(-moved.log_probs(target, context).astype(np.float64).sum())
    assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(gradient[k], rel=0.05)


def test_words_of_a_bucket_have_their_own_probability(spark):
    by_bucket = {}
    for k in range(1000):
        by_bucket.setdefault(zlib.crc32(b"rare%d" % k) % lm_score.BUCKETS, []).append(f"rare{k}")
    often, seldom = next(x for x in by_bucket.values() if len(x) > 1)[:2]
    common = " ".join(f"c{k}" for k in range(lm_score.SIZE - lm_score.BUCKETS))
    rows = [(None, common)] * 12 + [(1, f"c1 c2 {often} c3 c4")] * 8 + [(2, f"c1 c2 {seldom} c3 c4")]
    got = {r.doc_id: r.pll for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] - got[2] == pytest.approx(np.log(8), abs=1e-4)


@pytest.mark.parametrize("shared", [0, 3, 200_000])
def test_scores_word_by_word(spark, monkeypatch, shared):
    """Every word's probability by a plain loop over the untrained network, and its exact share of its bucket."""
    monkeypatch.setattr(lm_score, "SHARED", shared)
    monkeypatch.setattr(lm_score, "train", lambda numbers, rounds: lm_score.Network().flat)
    common = [f"c{k}" for k in range(lm_score.SIZE - lm_score.BUCKETS)]
    rng = random.Random(4)
    rare = [f"r{k}" for k in range(600)]
    rows = [(0, " ".join(common * 6))] + [(i, " ".join(rng.choice(rare if rng.random() < 0.4 else common[:50]) for _ in range(rng.randint(0, 30))))
                                          for i in range(1, 40)]
    counts = Counter(w for _, t in rows for w in t.split())
    own = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:len(common)]]
    number = {w: i for i, w in enumerate(own)}
    bucket = Counter()
    for w, n in counts.items():
        if w not in number:
            bucket[zlib.crc32(w.encode()) % lm_score.BUCKETS] += n
    net = lm_score.Network().w
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[1:]:
        words = text.split()
        ids = [number.get(w, lm_score.SIZE - lm_score.BUCKETS + zlib.crc32(w.encode()) % lm_score.BUCKETS) for w in words]
        total = 0.0
        for at, (w, t) in enumerate(zip(words, ids)):
            places = [at + d for d in range(-lm_score.SIDE, lm_score.SIDE + 1) if d]
            around = [ids[p] if 0 <= p < len(ids) else lm_score.PAD for p in places]
            h = np.tanh(sum(net["embed"][c].astype(float) * net["gate"][k] for k, c in enumerate(around)) + net["bias"])
            cls, slot = t % lm_score.CLASSES, t // lm_score.CLASSES
            for logits, which in ((h @ net["to_class"] + net["class_bias"], cls), (h @ net["to_word"][cls] + net["word_bias"][cls], slot)):
                total += logits[which] - np.log(np.exp(logits).sum())
            if w not in number:
                total += np.log(counts[w] / bucket[zlib.crc32(w.encode()) % lm_score.BUCKETS])
        assert got[i].n_words == len(words) and got[i].pll == pytest.approx(total, abs=1e-3)


def test_words_of_a_batch_are_those_of_its_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab Z9\t\n-é漢\U0001F600\x00") for _ in range(rng.randint(0, 9))) for _ in range(2000)] + ["", "a", "b", ""]
    for some in (pa.array(texts), pa.array(texts).slice(7, 900), pa.array([""]), pa.array([], pa.string()), pa.array(["ab", "cd"])):
        words, at = lm_score.words_in(some)
        words = words.to_pylist()
        assert [words[i:j] for i, j in zip(at, at[1:])] == [words_of(t) for t in some.to_pylist()] and len(words) == at[-1]


def test_ids_and_shares_of_a_batch():
    own, names, shares = [b"the", b"of"], [b"some", b"rare"], np.array([-1.5, -2.5])
    words, at = lm_score.words_in(pa.array(["The new, rare of", "", "new some newer the"]))
    ids, known, other, rare = lm_score.Ids(own, names, shares)(words)
    bucket = [lm_score.SIZE - lm_score.BUCKETS + zlib.crc32(w) % lm_score.BUCKETS for w in (b"new", b"rare", b"some", b"newer")]
    assert ids.tolist() == [0, bucket[0], bucket[1], 1, bucket[0], bucket[2], bucket[3], 0]
    assert known.tolist() == [0, 0, -2.5, 0, 0, -1.5, 0, 0] and other.tolist() == [1, 4, 6]
    assert lm_score.joined(rare, np.searchsorted(other, at)).to_pylist() == [b"new", b"", b"new newer"]


def test_blocks_of_logits(monkeypatch):
    """Log-softmax and gradient do not hang on the blocks in which they are worked out."""
    monkeypatch.setattr(lm_score, "WIDE", 10)
    rng = np.random.default_rng(3)
    for ends in ([1], [9], [10, 11, 12, 30], [1, 2, 5, 90], [20, 41, 42], np.cumsum(rng.integers(1, 25, 40)).tolist()):
        bounds = lm_score.blocks(ends)
        assert bounds[0] == 0 and bounds[-1] == ends[-1] and 0 < min(np.diff(bounds)) and max(np.diff(bounds)) < 2 * 10
        assert {b for a, b in zip(bounds, bounds[1:]) if b - a == 1} == {b for a, b in zip([0, *ends], ends) if b - a == 1}
        logits = rng.standard_normal((lm_score.SLOTS, ends[-1])).astype(np.float32)
        which = rng.integers(0, lm_score.SLOTS, ends[-1])
        p = np.exp(logits.astype(float)) / np.exp(logits.astype(float)).sum(axis=0)
        at = which, np.arange(ends[-1])
        assert lm_score.picked(logits, which, bounds, gradient=True) == pytest.approx(np.log(p[at]), abs=1e-5)
        p[at] -= 1
        assert np.abs(logits - p).max() < 1e-6


def test_scores_of_texts_without_words(spark):
    rows = [(1, None), (2, ""), (3, " - ")]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.pll, r.mean_pll) for r in got) == [(i, 0, 0.0, None) for i in (1, 2, 3)]


def test_width_of_the_network():
    assert lm_score.DIMS == 24
    assert lm_score.Network().w["to_word"].shape == (lm_score.CLASSES, 24, lm_score.SLOTS)


def test_probabilities_sum_to_one():
    net = lm_score.Network()
    every = np.arange(lm_score.SIZE, dtype=np.int32)
    context = np.tile(np.array([1, 2, 3, lm_score.PAD], dtype=np.int32), (lm_score.SIZE, 1))
    assert np.exp(net.log_probs(every, context).astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)


def test_training_beats_word_frequencies(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lm_score.score(docs).collect()
    counts = Counter(w for r in docs.collect() for w in words_of(r.text))
    own = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lm_score.SIZE - lm_score.BUCKETS]}
    merged = Counter()
    for w, n in counts.items():
        merged[w if w in own else zlib.crc32(w) % lm_score.BUCKETS] += n
    total = sum(merged.values())
    unigram = sum(n * np.log(n / total) for n in merged.values()) / total
    assert sum(r.n_words for r in rows) == total and sum(r.bucket_pll for r in rows) / total > unigram
    got = {r.doc_id: r for r in lm_score.score(odd).collect()}
    assert got[1].n_words == 0 and got[1].pll == 0 and got[1].mean_pll is None and got[3].pll < 0
    assert lm_score.score(empty).count() == 0


def test_line_dedup_tells_rows_without_ids_apart(spark):
    """Three texts without ids share a line: one of them keeps it; equal texts without ids are one document."""
    line = "a line that is long enough"
    rows = [(None, f"{line}\nown {i}") for i in range(3)] + [(None, f"{line}\nown 0")] + [(None, None)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r.n_lines - r.n_dropped for r in got]
    assert len(got) == 5 and sorted(r.n_dropped for r in got)[:2] == [0, 0] and sum(r.n_dropped for r in got) in (2, 3) and min(kept) == 1
    with_id = line_dedup.report(spark.createDataFrame(rows + [(1, line)], "doc_id long, text string")).collect()
    assert all(r.n_dropped == (r.doc_id is None and r.n_lines == 2) for r in with_id)
    two = line_dedup.report(spark.createDataFrame([rows[0], rows[0], rows[1]], "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in two)


def test_every_whole_neighbour_is_tried():
    """After the best neighbour a window has room for 18 more: the next 99 are too long, the one behind them fits."""
    idf = np.ones(1 << 16)
    rng = np.random.default_rng(0)
    long = [np.full(40, 7, dtype=np.uint16) for _ in range(100)]
    short = np.concatenate((np.full(1, 7), rng.integers(100, 60_000, 17))).astype(np.uint16)
    got = packing.pack_shard([0] * 102, [np.full(1990, 7, dtype=np.uint16), *long, short], idf, 100.0)
    first = next(s for s in got if s[0][0] == 0)
    assert len(first) == 3 and 1 <= first[1][0] <= 100 and first[2][0] == 101
    x = rng.integers(0, 50, 1000).astype(np.uint16)
    a, b = packing.terms_of(x), np.unique(x, return_counts=True)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and len(packing.terms_of(x[:0])[0]) == 0


def test_packing_looks_up_a_word_once_whatever_follows_it():
    import public_tokenizers
    e = packing.Encoder(str(public_tokenizers.path(packing.DEFAULT_TOKENIZER)))
    texts = ["Fox fox! fox*** (fox), don't 'tis fox's. x1 ²é\xa0fox\n\nfox--", None, "", " ", "<|endoftext|> fox!", "日本 fox!"]
    for t, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert b"fox" in e.folded and not {b"fox!", b"fox***", b"fox--"} & set(e.folded)     # each was encoded on its own before


def test_packing_terms_and_keys_of_many_texts():
    r = np.random.default_rng(2)
    ids = [r.integers(0, 50, n).astype("<u2") for n in (1, 5, 400, 2, 90)] + [np.array([7, 7, 7], "<u2"), np.array([49407], "<u2")]
    row, term, count = packing.terms_of_each([*ids, ids[0][:0]])
    for i, x in enumerate([*ids, ids[0][:0]]):
        t, tf = packing.terms_of(x)
        assert term[row == i].tolist() == t.tolist() and count[row == i].tolist() == tf.tolist()
    idf = r.random(1 << 16).astype(np.float32)
    together = list(zip(*packing.content_keys(ids, idf, 60.0)))
    assert together == [tuple(k[0] for k in packing.content_keys([x], idf, 60.0)) for x in ids]
    assert together[-2] == (7, 7) and together[-1] == (49407, 49407) and together[2][0] != together[2][1]


def test_batches_of_long_texts_are_bounded(spark):
    from penmark.llm import common
    rows = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))

    def run(batches):
        for b in batches:
            yield {"n": [len(b["text"])], "chars": [sum(map(len, b["text"]))]}

    got = common.map_columns(rows, run, "n bigint, chars bigint").collect()
    assert sum(r.n for r in got) == 3000 and max(r.chars for r in got) <= common.BATCH_BYTES + 10_000      # 30 MB at once before


def test_encoder_cache_is_bounded_and_keeps_frequent_words():
    import public_tokenizers
    e = packing.Encoder(str(public_tokenizers.path(packing.DEFAULT_TOKENIZER)), limit=100)
    for k in range(40):
        texts = [f"the fox q{k}x{i} z{i}y{k}" for i in range(20)]
        for t, ids in zip(texts, e.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.folded) + len(e.older) <= 2 * (100 + 45) and b"fox" in e.folded
    assert b"q0x0" not in e.folded | e.older
