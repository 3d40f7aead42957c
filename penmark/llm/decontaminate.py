"""Benchmark decontamination (operator 6): a generalised suffix automaton.

All benchmark items' words go into one automaton over word numbers.  A
document's words are streamed through it; after each word the automaton knows
the longest match length, i.e. the longest suffix of what was read that occurs
inside some item.  A length of at least the window size means that the window
ending there occurs in a benchmark item, and all its words are hit.

Words outside the benchmark's vocabulary, and neighbouring words that are
adjacent in no item, end every match, so only runs between such breaks are
walked word by word; runs shorter than the shortest window can hold none.

The automaton is linear in the benchmark's size, which doesn't follow the
corpus.  It is built on the driver and broadcast, and documents are not shuffled.  A
benchmark of more than ``MAX_ITEM_CHARS`` of text is dealt into groups of at most that
size (a longer item into overlapping parts that hold all its windows).  The groups are
built, broadcast and scanned for one after another; a document's spans and items of
all groups are united by row before anything is derived from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import WORD_BYTES, map_batches, map_columns, shared_path, stored, words_of

WINDOW = 13                  # words
COVERAGE = 20                # contaminated: COVERAGE * hit words >= all words
MAX_ITEM_CHARS = 4_000_000   # benchmark text in an automaton, about 500 MB of a worker's memory


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows of each item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.holders: dict[tuple[int, ...], list[str]] = {}    # window -> items that hold it
        adjacent = set()
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            if not ids:
                continue
            state = 0
            for x in ids:
                state = self._add(state, x)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                held = self.holders.setdefault(tuple(ids[i:i + size]), [])
                if not held or held[-1] != item:
                    held.append(item)
            adjacent.update(zip(ids, ids[1:]))
        self.sizes = sorted({len(w) for w in self.holders}, reverse=True)
        v = len(self.vocab)
        self.adjacent = np.array(sorted(a * v + b for a, b in adjacent), dtype=np.int64)

    def _add(self, state: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        to = nxt[state].get(x)
        if to is not None:
            return to if length[to] == length[state] + 1 else self._clone(state, x, to)
        new = len(nxt)
        nxt.append({})
        length.append(length[state] + 1)
        link.append(0)
        p = state
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return new

    def _clone(self, p: int, x: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(x) == q:
            nxt[p][x] = copy
            p = link[p]
        return copy

    def longest_matches(self, ids: list[int]) -> list[int]:
        """Longest match length after each word of a run."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for x in ids:
            while state and x not in nxt[state]:
                state = link[state]
                matched = length[state]
            if x in nxt[state]:
                state = nxt[state][x]
                matched += 1
            out.append(matched)
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (merged, as word ranges) and the items with occurring windows."""
        if not self.sizes or len(words) < self.sizes[-1]:
            return [], set()
        v = len(self.vocab)
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = ids >= 0
        shortest = self.sizes[-1]
        if shortest > 1:
            key = ids[:-1] * v + ids[1:]
            at = np.minimum(np.searchsorted(self.adjacent, key), len(self.adjacent) - 1)
            kept = known[:-1] & known[1:] & (self.adjacent[at] == key)
        else:
            kept = known[:-1] & known[1:]
        # runs of words in which every neighbouring pair may go on
        edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.view(np.int8), [0]))))
        runs = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= shortest]
        if shortest == 1:
            runs = [(int(a), int(b)) for a, b in
                    zip(*[np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))[i::2] for i in (0, 1)])]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in runs:
            run = ids[a:b].tolist()
            for i, matched in enumerate(self.longest_matches(run)):
                for size in self.sizes:
                    if matched >= size and (held := self.holders.get(tuple(run[i + 1 - size:i + 1]))):
                        items.update(held)
                        spans.append((a + i + 1 - size, a + i + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def item_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")) \
                    .where("i is not null and t is not null")


def item_chars(benchmark: DataFrame) -> int:
    return item_rows(benchmark).agg(F.sum(F.length("t") + 16).alias("n")).first().n or 0


def build(benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_ITEM_CHARS) -> Automaton:
    """The automaton of a benchmark table (item_id, text) of checked size."""
    size = item_chars(benchmark)
    if size > max_chars:
        raise ValueError(f"benchmark of {size} characters; split it into parts of at most {max_chars}")
    return Automaton([(r.i, words_of(r.t)) for r in item_rows(benchmark).collect()], window)


def parts_of(words: list[bytes], window: int, max_chars: int) -> Iterator[list[bytes]]:
    """Parts of an item that hold each of its windows, of about ``max_chars`` at most."""
    a = 0
    while a < len(words):
        b, size = a, 0
        while b < len(words) and (b - a < window or size + len(words[b]) < max_chars):
            size += len(words[b]) + 1
            b += 1
        yield words[a:b]
        if b == len(words):
            return
        a = b - window + 1


def groups(benchmark: DataFrame, window: int, max_chars: int) -> Iterator[Automaton]:
    """Automata of bounded size, one at a time."""
    held, size = [], 0
    for r in item_rows(benchmark).toLocalIterator():
        for words in parts_of(words_of(r.t), window, max_chars):
            n = sum(len(w) + 1 for w in words) + 16
            if held and size + n > max_chars:
                yield Automaton(held, window)
                held, size = [], 0
            held.append((r.i, words))
            size += n
    if held:
        yield Automaton(held, window)


def grouped_hits(rows: DataFrame, benchmark: DataFrame, window: int, max_chars: int) -> DataFrame:
    """(row, spans, items) of the rows (row, text) that hold a window of any group."""
    spark = rows.sparkSession
    path = shared_path(spark, "bench-hits")
    schema = "row bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"
    spark.createDataFrame([], schema).write.parquet(path)
    for automaton in groups(benchmark, window, max_chars):
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches, shared=shared):
            for b in batches:
                out = {"row": [], "spans": [], "items": []}
                for row, t in zip(b["row"], b["text"]):
                    spans, items = shared.value.scan(words_of(t))
                    if spans:
                        out["row"].append(row)
                        out["spans"].append([{"first": s, "last": e - 1} for s, e in spans])
                        out["items"].append(sorted(items))
                yield out

        map_columns(rows.select("row", "text"), run, schema).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    return merged([(x["first"], x["last"] + 1) for x in spans or []])


def is_contaminated(n_hit: int, n_words: int, coverage: int = COVERAGE) -> bool:
    return n_hit > 0 and coverage * n_hit >= n_words


REPORT = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
          "contaminated boolean, spans array<struct<first: bigint, last: bigint>>")


def reported(doc_ids: list, n_words: list[int], hits: list[tuple[list[tuple[int, int]], set[str]]], coverage: int) -> dict:
    n_hit = [sum(e - s for s, e in spans) for spans, _ in hits]
    return {"doc_id": doc_ids, "n_words": n_words, "n_hit": n_hit, "n_items": [len(items) for _, items in hits],
            "items_sha256": [hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() for _, items in hits],
            "contaminated": [is_contaminated(h, n, coverage) for h, n in zip(n_hit, n_words)],
            "spans": [[{"first": s, "last": e - 1} for s, e in spans] for spans, _ in hits]}


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
           max_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, spans (hit word ranges).

    Null and empty texts have no words and are clean; benchmark rows with a
    null id or text hold no window; an empty benchmark hits nothing; repeated
    rows are reported each; other columns of either table are not read."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if item_chars(benchmark) > max_chars:
        return grouped_report(docs, benchmark, window, coverage, max_chars)
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window, max_chars))

    def run(batches):
        automaton = shared.value
        for b in batches:
            texts = [words_of(t) for t in b["text"]]
            yield reported(b["doc_id"], [len(w) for w in texts], [automaton.scan(w) for w in texts], coverage)

    return map_columns(docs, run, REPORT)


def grouped_report(docs: DataFrame, benchmark: DataFrame, window: int, coverage: int, max_chars: int) -> DataFrame:
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "bench-docs")

    def count(batches):
        for b in batches:
            yield {"row": b["row"], "doc_id": b["doc_id"], "n_words": [len(words_of(t)) for t in b["text"]]}

    def run(batches):
        for b in batches:
            hits = [(united(s), set(i or [])) for s, i in zip(b["spans"], b["items"])]
            yield reported(b["doc_id"], b["n_words"], hits, coverage)

    counts = map_columns(rows, count, "row bigint, doc_id bigint, n_words bigint")
    return map_columns(counts.join(grouped_hits(rows, benchmark, window, max_chars), "row", "left"), run, REPORT)


def word_bounds(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the words of a UTF-8 text."""
    import re
    return [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]


def cut(automaton: Automaton, text: str, coverage: int = COVERAGE) -> str | None:
    """The text without its hit spans if it is contaminated (None: unchanged).
    Cutting joins what stood around a span, so it goes on until no window is left."""
    raw, changed = text.encode(), False
    while True:
        words = raw.translate(WORD_BYTES).split()
        spans, _ = automaton.scan(words)
        n_hit = sum(e - s for s, e in spans)
        if not (n_hit if changed else is_contaminated(n_hit, len(words), coverage)):
            return raw.decode() if changed else None
        raw, changed = without(raw, spans), True


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A UTF-8 text without some word ranges."""
    bounds = word_bounds(raw)
    keep, at = [], 0
    for s, e in spans:
        keep.append(raw[at:bounds[s][0]])
        at = bounds[e - 1][1]
    return b"".join(keep) + raw[at:]


def grouped_clean(docs: DataFrame, benchmark: DataFrame, window: int, coverage: int, max_chars: int) -> DataFrame:
    """As ``cut``, one round over all groups at a time; only rows that were cut go on."""
    spark, names = docs.sparkSession, docs.columns
    base = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "bench-docs")
    path = shared_path(spark, "bench-cut")
    todo, first = base.select(F.col("__row").alias("row"), "text"), True
    spark.createDataFrame([], "row bigint, new string").write.parquet(path)
    while first or todo.head(1):
        hits = stored(grouped_hits(todo, benchmark, window, max_chars), "bench-round")

        def run(batches, first=first):
            for b in batches:
                out = {"row": [], "text": []}
                for row, t, spans in zip(b["row"], b["text"], b["spans"]):
                    spans = united(spans)
                    if not first or is_contaminated(sum(e - s for s, e in spans), len(words_of(t)), coverage):
                        out["row"].append(row)
                        out["text"].append(without(t.encode(), spans).decode())
                yield out

        if not first:
            todo.join(hits, "row", "left_anti").select("row", F.col("text").alias("new")).write.mode("append").parquet(path)
        todo = stored(map_columns(todo.join(hits.select("row", "spans"), "row"), run, "row bigint, text string"), "bench-round")
        first = False

    def worded(batches):
        for b in batches:
            yield {"__row": b["row"], "__new": b["new"], "__kept": [bool(words_of(t)) for t in b["new"]]}

    cuts = map_columns(spark.read.schema("row bigint, new string").parquet(path), worded, "__row bigint, __new string, __kept boolean")
    out = base.join(cuts, "__row", "left").where("__kept is null or __kept")
    new = {"text": F.coalesce("__new", "text").alias("text")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("__new").isNull(), F.col("n_chars")).otherwise(F.length("__new").cast(kind)).alias("n_chars")
    return out.select(*(new.get(c, F.col(f"`{c}`")) for c in names))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE,
          max_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """``docs`` with the hit spans of contaminated documents removed from
    ``text``; all other rows and columns pass unchanged, also clean documents that
    hold a window below the coverage limit.  A document of which no word is
    left is dropped.  ``n_chars``, if there, follows the new text."""
    if item_chars(benchmark) > max_chars:
        return grouped_clean(docs, benchmark, window, coverage, max_chars)
    shared = docs.sparkSession.sparkContext.broadcast(build(benchmark, window, max_chars))
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        automaton = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            keep, new = [], []
            for t in texts:
                done = cut(automaton, t, coverage) if t else None
                new.append(t if done is None else done)
                keep.append(done is None or bool(words_of(done)))
            columns = list(b.columns)
            if any(n is not t for n, t in zip(new, texts)):
                columns[at] = pa.array(new, type=b.schema.field(at).type)
                if chars is not None:
                    columns[chars] = pa.array(
                        [c if n is t else len(n) for c, n, t in zip(columns[chars].to_pylist(), new, texts)],
                        type=b.schema.field(chars).type)
            out = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield out if all(keep) else out.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)
