"""Periodic run detection (operator 11): descending-LCP Kruskal over word positions.

A run is a stretch of words with smallest period q that cannot be extended and is
at least ``max(6, 4 * q)`` words long.  Per text, suffixes are ordered by prefix
doubling; neighbours in that order are united by decreasing LCP.  Each class of
the union-find keeps its positions ordered; when a union at LCP l makes two
positions i < i + d adjacent and 3 * d <= l, the words [i, i + d + l) have period d
and cannot be extended to the right: a seed.

Why the seeds are enough.  Let a run start at s, end at e and have smallest period
q.  s and s + q have LCP e - s - q >= 3 * q, so they meet in one class at exactly that level.  A position
between them in the class would give the stretch a second period below q, and with it
(Fine and Wilf) one that divides q: so none is there, and the pair is a seed.  A
position between i and i + d is there for every seed whose d is not the smallest
period.  So the seeds of (period, end) with the smallest i are the runs.

Suffixes that share fewer than ``LEAST`` words with any other suffix of
their text cannot seed a run and are left out of the unions (exact: 3 * d <= l and
d + l >= 6 need l >= 5).

The work is map-only: a text is held by one task, in memory proportional to its words;
no row is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import map_columns

LEAST = 5               # shortest LCP that can seed a run
WORDS_AT_ONCE = 300_000     # words of texts whose suffixes are ordered together (a longer text comes alone)

Run = tuple[int, int, int]


def ranks_by_doubling(ids: np.ndarray) -> list[np.ndarray]:
    """``r[k][i]``: the rank of the 2^k words from i on, equal exactly for equal
    words.  Positions whose rank is already their own are not sorted again.  No repeated
    stretch may reach the last position."""
    dense = np.unique(ids, return_inverse=True)[1]
    counts = np.bincount(dense)
    rank = (np.cumsum(counts) - counts)[dense]      # number of positions of smaller rank: room for the group's parts
    live = np.flatnonzero(counts[dense] > 1)
    levels, width = [rank], 1
    while len(live):
        key = rank[live] * len(ids) + rank[live + width]
        order = np.argsort(key)
        key, at = key[order], live[order]
        index = np.arange(len(at))
        old = rank[at]
        group_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        part_start = np.maximum.accumulate(np.where(new, index, 0))
        rank = rank.copy()
        rank[at] = old + part_start - group_start
        levels.append(rank)
        live = np.sort(at[~(new & np.r_[new[1:], True])])
        width *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b (a != b)."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out[levels[k][a + out] == levels[k][b + out]] += 1 << k
    return out


def seeds_of(left: list[int], right: list[int], lcp: list[int]) -> list[Run]:
    """(i, d, l) seeds from edges between neighbouring suffixes, given by
    decreasing LCP: the smaller class moves into the larger one."""
    owner: dict[int, list[int]] = {}
    seeds = []
    for a, b, level in zip(left, right, lcp):
        big = owner.get(a) or owner.setdefault(a, [a])
        small = owner.get(b) or owner.setdefault(b, [b])
        if len(big) < len(small):
            big, small = small, big
        reach = level // 3
        places = [bisect_left(big, x) for x in small]
        last = len(small) - 1
        for t, (x, k) in enumerate(zip(small, places)):
            # the neighbour in the other class, unless one of the own class is nearer
            if k and (t == 0 or places[t - 1] != k) and x - big[k - 1] <= reach:
                seeds.append((big[k - 1], x - big[k - 1], level))
            if k < len(big) and (t == last or places[t + 1] != k) and big[k] - x <= reach:
                seeds.append((x, big[k] - x, level))
            owner[x] = big
        if len(small) * 16 < len(big):
            for x in small:
                insort(big, x)
        else:
            big += small
            big.sort()      # two ordered stretches: a merge
    return seeds


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Per text (an array of word ids >= 0): its runs (start, length, period), ordered by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    if not texts or not sum(map(len, texts)):
        return out
    # one sequence; equal words of different texts get different numbers, so a repeated stretch lies in one text,
    # and a number of its own after each text keeps it from reaching the end
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    end_mark = np.zeros(1, dtype=np.int64)
    ids = np.concatenate([x for t in texts for x in (t + 1, end_mark)])
    levels = ranks_by_doubling(ids + text_of * (ids.max() + 1))
    if len(levels) < 3:
        return out
    four = levels[2]        # suffixes whose first four words occur twice
    shared = np.flatnonzero(np.bincount(four)[four] > 1)
    suffixes = shared[np.argsort(levels[-1][shared])]
    a, b = suffixes[:-1], suffixes[1:]
    lcp = common_prefixes(levels, a, b)
    enough = lcp >= LEAST
    a, b, lcp = a[enough], b[enough], lcp[enough]
    order = np.argsort(-lcp, kind="stable")
    seeds = np.array(seeds_of(a[order].tolist(), b[order].tolist(), lcp[order].tolist()), dtype=np.int64).reshape(-1, 3)
    if not len(seeds):
        return out
    start, period, end = seeds[:, 0], seeds[:, 1], seeds.sum(axis=1)
    order = np.lexsort((start, end, period))
    start, period, end = start[order], period[order], end[order]
    first = np.r_[True, (period[1:] != period[:-1]) | (end[1:] != end[:-1])]
    start, period, length = start[first], period[first], (end - start)[first]
    whole = length >= np.maximum(6, 4 * period)
    start, period, length = start[whole], period[whole], length[whole]
    order = np.lexsort((period, start))
    for s, m, q in zip(start[order].tolist(), length[order].tolist(), period[order].tolist()):
        t = int(text_of[s])
        out[t].append((s - int(begin[t]), m, q))
    return out


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document under the rule that makes one in ten periodic: with
    h = crc32(decimal id), g = h // 10, if h % 10 = 0 every word i >= a becomes
    word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).  A null id changes nothing."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[:n - a]


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, m, q in runs:
        change[s + q] += 1
        change[s + m] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def row_of(words: list[bytes], runs: list[Run]) -> tuple:
    """n_runs; start, length, period and exponent of the longest run; digests of all runs and of the kept words."""
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (len(runs), start, length, period, 1000 * length // period if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest())


SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def by_texts(docs: DataFrame, fn, schema: str, rewrite: bool) -> DataFrame:
    """Map documents: ``fn(doc_id, words, runs)`` gives one row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        def flush(held):
            numbers: dict[bytes, int] = {}
            arrays = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
                      for _, words in held]
            rows = [fn(d, words, runs) for (d, words), runs in zip(held, find_runs(arrays))]
            return dict(zip(names, zip(*rows)))

        for b in batches:
            held, size = [], 0
            for d, text in zip(b["doc_id"], b["text"]):
                words = text.encode().split() if text else []       # splits at \x20 and \x09-\x0D, as bytes
                if rewrite:
                    words = rewritten(words, d)
                held.append((d, words))
                size += len(words)
                if size >= WORDS_AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def runs(docs: DataFrame) -> DataFrame:
    """Per document its runs as they stand (no rewriting): doc_id, runs array of
    (start, length, period), and ``collapsed``, the text's words without repeats joined by one blank.
    Edge cases as in ``report``."""
    def one(d, words, found):
        return d, [{"start": s, "length": m, "period": q} for s, m, q in found], b" ".join(without_repeats(words, found)).decode()

    return by_texts(docs, one, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", False)


def report(docs: DataFrame) -> DataFrame:
    """Per document, after the contract's rewriting: doc_id, n_runs, start, length,
    period, exponent_milli, runs_sha256, collapsed_sha256.

    Null and empty texts have no words, no runs and the digests of empty strings.
    Repeated rows and rows that share an id are answered each; a null doc_id is not rewritten.
    An empty table gives no rows.  Other columns are not read."""
    return by_texts(docs, lambda d, words, found: (d, *row_of(words, found)), SCHEMA, True)
