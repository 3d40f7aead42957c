"""LM scoring (operator 5): masked pseudo-likelihood of whole documents.

A small network predicts every word from the ``SIDE`` words on either side of it; a
document's score is the sum of the log-probabilities of its words, each
conditioned on its neighbours (pseudo-log-likelihood).

1. Word counts over all documents (combined per task before the shuffle) choose the
   vocabulary: the most frequent words, and hash buckets for all others.  A word of a bucket has
   the bucket's probability times its exact share of the bucket's words in the corpus; the
   words' counts stay a distributed table, which is joined.
2. Training covers all documents, in ``ROUNDS`` rounds over disjoint parts of them.  In a round
   every task starts from the same weights and takes AdaGrad steps in numpy over its own
   documents; the tasks' weights are averaged by their number of words.  Only
   weights travel: one set per task, summed in blocks.
3. A map-only pass scores every document.

The softmax has two levels, a word's class and the word within its class, both
predicted from the context.
"""

from __future__ import annotations

import ctypes
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import WORD_BYTES, map_batches, map_columns, stored

CLASSES, SLOTS = 64, 64         # classes, and words of a class
BUCKETS = 256                   # vocabulary entries for all words that have none of their own
SHARED = 200_000                # rare words whose share of their bucket every task holds; the others' are joined
DIMS = 24
SIDE = 2                        # context words on either side
ROUNDS = 2
BATCH = 16_384                  # words of a step
WIDE = 2048                     # columns of logits that are worked on at a time: they fit a processor's cache
COUNTED = 1 << 24               # bytes of words that are counted at a time
RATE = 0.15
SEED = 2024
BLOCK = 1 << 14                 # weights of a row when tasks report
SIZE = CLASSES * SLOTS
PAD = SIZE                      # stands outside the text

SHAPES = {"embed": (SIZE + 1, DIMS), "gate": (2 * SIDE, DIMS), "bias": (DIMS,), "to_class": (DIMS, CLASSES),
          "class_bias": (CLASSES,), "to_word": (CLASSES, DIMS, SLOTS), "word_bias": (CLASSES, SLOTS)}


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (as ``words_of`` parts them) of all texts, one after another, and where every text's words
    begin, with the end of the last.  No object is made of a word."""
    texts = texts.cast(pa.binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = data.slice(first, last - first).to_pybytes().translate(WORD_BYTES) if last > first else b""
    offsets -= first
    inside = np.frombuffer(data, np.uint8) != 0x20
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    some = offsets[1:] > offsets[:-1]       # a text's border parts words too
    borders = offsets[:-1][some], offsets[1:][some] - 1
    begins[borders[0]], ends[borders[1]] = inside[borders[0]], inside[borders[1]]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    at = np.zeros(len(begins) + 1, dtype=np.int32)
    np.cumsum(ends - begins + 1, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(data.translate(None, b" "))])
    return words, np.searchsorted(begins, offsets)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of the corpus, stored."""
    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        values, n = pc.value_counts(pa.chunked_array(held, pa.binary())).flatten()
        return pa.RecordBatch.from_arrays([values.cast(pa.string()), n], ["word", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(words_in(b.column(0))[0])
            size += b.nbytes
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        yield counted(held)

    counts = map_batches(docs.select("text"), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counts, "lm-counts")


def vocabulary(counts: DataFrame) -> list[bytes]:
    """The most frequent words of the corpus, most frequent first."""
    best = counts.orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS).collect()      # bounded by the vocabulary
    return [r.word.encode() for r in best]


def bucket_shares(counts: DataFrame, words: list[bytes]) -> DataFrame:
    """(word, n, share): of every word without an entry of its own, the logarithm of its exact
    share of its bucket in the corpus.  The table grows with the corpus."""
    own = counts.sparkSession.createDataFrame([(w.decode(),) for w in words], "word string")
    rare = counts.join(F.broadcast(own), "word", "left_anti").withColumn("bucket", F.crc32("word") % BUCKETS)
    total = rare.groupBy("bucket").agg(F.sum("n").alias("total"))
    return stored(rare.join(F.broadcast(total), "bucket").select("word", "n", F.log(F.col("n") / F.col("total")).alias("share")), "lm-shares")


def known_shares(shares: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The ``SHARED`` most frequent words of that table and their shares, for every task."""
    best = shares.orderBy(F.desc("n"), "word").limit(SHARED).select("word", "share").toArrow()
    return [w.encode() for w in best["word"].to_pylist()], best["share"].to_numpy()


def other_shares(numbers: DataFrame, shares: DataFrame) -> DataFrame:
    """(row, share): the sum of the shares of a document's words that are not among the known ones."""
    def run(batches):
        for b in batches:
            out = {"row": [], "word": [], "n": []}
            for row, x in zip(b["row"], b["rare"]):
                n = Counter(x.split())
                out["row"] += [row] * len(n)
                out["word"] += [w.decode() for w in n]
                out["n"] += n.values()
            yield out

    held = map_columns(numbers.select("row", "rare"), run, "row bigint, word string, n bigint")
    return held.join(shares.select("word", "share"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("share")).alias("other"))


class Network:
    """Weights as named arrays; ids are class + CLASSES * slot, so frequent words spread over the classes."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(SEED)
            flat = np.concatenate([(rng.standard_normal(s) * (0.1 if k in ("embed", "to_class", "to_word") else 0)).ravel()
                                   + (1 if k == "gate" else 0) for k, s in SHAPES.items()])
        self.flat = flat.astype(np.float32)
        self.w, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            self.w[k] = self.flat[at:at + n].reshape(s)     # views: a step on them is a step on flat
            at += n
        self.w["embed"][PAD] = 0

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """(dims, words).  Embeddings are weighted for every neighbour's place before they are looked up."""
        weighted = self.w["embed"] * self.w["gate"][:, None, :]
        x = weighted[0].take(context[:, 0], axis=0)
        for p in range(1, 2 * SIDE):
            x += weighted[p].take(context[:, p], axis=0)
        return self.bent(x)

    def bent(self, x: np.ndarray) -> np.ndarray:
        h = np.ascontiguousarray(x.T)
        h += self.w["bias"][:, None]
        return np.tanh(h, out=h)

    def class_logits(self, h: np.ndarray) -> np.ndarray:
        logits = self.w["to_class"].T @ h
        logits += self.w["class_bias"][:, None]
        return logits

    def word_logits(self, h: np.ndarray, classes: list[tuple[int, int, int]]) -> np.ndarray:
        logits = np.empty((SLOTS, h.shape[1]), dtype=np.float32)
        for c, a, b in classes:
            part = logits[:, a:b]
            np.matmul(self.w["to_word"][c].T, h[:, a:b], out=part)
            part += self.w["word_bias"][c][:, None]
        return logits

    def log_probs(self, target: np.ndarray, context: np.ndarray) -> np.ndarray:
        if not len(target):         # texts without words
            return np.empty(0, dtype=np.float32)
        classes, order = by_class(target % CLASSES)
        target = target[order]
        h = self.hidden(context[order])
        found = picked(self.class_logits(h), target % CLASSES, blocks([len(target)]))
        found += picked(self.word_logits(h, classes), target // CLASSES, blocks(b for _, _, b in classes))
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, target: np.ndarray, context: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """One AdaGrad step on the mean negative log-probability (times a constant).  Words
        are handled in the order of their classes, so that a class is a slice."""
        w, n = self.w, len(target)
        classes, order = by_class(target % CLASSES)
        target, context = target[order], context[order].astype(np.intp)
        e = w["embed"].take(context, axis=0)                # (words, neighbours, dims)
        h = self.bent(np.einsum("npd,pd->nd", e, w["gate"]))
        grad = {"to_word": np.zeros_like(w["to_word"]), "word_bias": np.zeros_like(w["word_bias"])}
        p = self.class_logits(h)
        picked(p, target % CLASSES, blocks([n]), gradient=True)
        dh = w["to_class"] @ p
        grad["to_class"], grad["class_bias"] = h @ p.T, p.sum(axis=1)
        p = self.word_logits(h, classes)
        picked(p, target // CLASSES, blocks(b for _, _, b in classes), gradient=True)
        for c, a, b in classes:
            part = p[:, a:b]
            dh[:, a:b] += w["to_word"][c] @ part
            np.matmul(h[:, a:b], part.T, out=grad["to_word"][c])
            part.sum(axis=1, out=grad["word_bias"][c])
        dh *= 1 - h * h
        grad["bias"] = dh.sum(axis=1)
        grad["gate"] = np.einsum("npd,nd->pd", e, np.ascontiguousarray(dh.T))
        around = context.T.ravel()
        grad["embed"] = np.empty_like(w["embed"])
        added = np.empty((2 * SIDE, n))
        for d in range(DIMS):       # what every neighbour adds, summed by id
            np.outer(w["gate"][:, d], dh[d], out=added)
            grad["embed"][:, d] = np.bincount(around, added.ravel(), SIZE + 1)
        grad["embed"][PAD] = 0
        for k, g in grad.items():
            g /= n ** 0.5
            seen[k] += g * g
            w[k] -= RATE * g / np.sqrt(seen[k])


def blocks(ends: Iterable[int]) -> list[int]:
    """Bounds of blocks of ``WIDE`` to 2 * ``WIDE`` columns (the last may be smaller), given the ends of the classes.  A class
    of one column is a block of its own: numpy sums a single column in another order, and so a word's
    probability does not hang on the width of the blocks."""
    bounds, begin = [0], 0
    for b in ends:
        if b - begin == 1 and begin > bounds[-1]:
            bounds.append(begin)
        while b - bounds[-1] >= 2 * WIDE:
            bounds.append(bounds[-1] + WIDE)
        if b - begin == 1 or b - bounds[-1] >= WIDE:
            bounds.append(b)
        begin = b
    return bounds if bounds[-1] == begin else [*bounds, begin]


def picked(logits: np.ndarray, which: np.ndarray, bounds: list[int], gradient: bool = False) -> np.ndarray:
    """Log-softmax values at ``which`` of every column, block by block; the logits become, if asked for, softmax minus one-hot."""
    found = np.empty_like(logits[0])
    for a, b in zip(bounds, bounds[1:]):
        x, row, columns = logits[:, a:b], which[a:b], np.arange(b - a)
        x -= x.max(axis=0)
        at = x[row, columns]
        np.exp(x, out=x)
        total = x.sum(axis=0)
        np.subtract(at, np.log(total), out=found[a:b])
        if gradient:
            x /= total
            x[row, columns] -= 1
    return found


def keep_memory() -> None:
    """A step's arrays come from memory that the last step freed, not from the system anew (glibc's
    thresholds at the highest values that it would choose; a task still gives all back at its end)."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-3, 32 << 20)        # M_MMAP_THRESHOLD
        option(-1, 64 << 20)        # M_TRIM_THRESHOLD


def grouped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, where each begins in the order of ids, and that order (16 bits are sorted by digits)."""
    ids = ids.astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], first, order


def by_class(cls: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(class, begin, end) of every class in the order of classes, and that order."""
    ids, first, order = grouped(cls)
    return list(zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(order)])), order


class Ids:
    """Vocabulary ids and shares of words: entries 0.. are the vocabulary's own words, then the words
    whose share is known; all others have their bucket's id."""

    def __init__(self, own: list[bytes], names: list[bytes], shares: np.ndarray):
        self.known = pa.array([*own, *names], pa.binary())
        self.ids = np.array([*range(len(own)), *map(self.bucket, names), 0], dtype="<u2")
        self.shares = np.r_[np.zeros(len(own)), shares, 0]

    @staticmethod
    def bucket(word: bytes) -> int:
        return SIZE - BUCKETS + zlib.crc32(word) % BUCKETS

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """The ids, the known shares (or 0), which words have none, and those words."""
        entries = pc.index_in(words, value_set=self.known).fill_null(len(self.known)).to_numpy()
        other = np.flatnonzero(entries == len(self.known))
        rare = words.take(pa.array(other))
        ids, coded = self.ids[entries], rare.dictionary_encode()
        distinct = joined(coded.dictionary, [0, len(coded.dictionary)])[0].as_py().split()
        ids[other] = np.fromiter(map(self.bucket, distinct), dtype="<u2")[coded.indices.to_numpy()]
        return ids, self.shares[entries], other, rare


def joined(words: pa.Array, bounds: np.ndarray | list[int]) -> pa.Array:
    """Stretches of words, each joined by blanks."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), b" ")


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets and their contexts for the words of some texts."""
    pad = np.full(SIDE, PAD, dtype=np.int32)
    row = np.concatenate([pad, *(x for t in texts for x in (t, pad))])
    at = np.flatnonzero(row != PAD)
    offsets = np.array([d for d in range(-SIDE, SIDE + 1) if d])
    return row[at], row[at[:, None] + offsets]


def numbered(docs: DataFrame, words: list[bytes], shares: tuple[list[bytes], np.ndarray], rounds: int) -> DataFrame:
    """(doc_id, row, part, ids, share, rare): every document's words as 16-bit vocabulary ids, read by
    all rounds and by scoring; ``part`` is the round that trains on the document, ``share`` the
    sum of its known words' shares of their buckets, ``rare`` its words that have neither an entry nor a known share."""
    shared = docs.sparkSession.sparkContext.broadcast((words, *shares))

    def run(batches):
        number = Ids(*shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            words, at = words_in(b.column("text"))
            ids, known, other, rare = number(words)
            bounds = at.tolist()
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("row"), b.column("part"),
                pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)]),
                pa.array([known[i:j].sum() for i, j in zip(bounds, bounds[1:])], pa.float64()),
                joined(rare, np.searchsorted(other, at)),
            ], ["doc_id", "row", "part", "ids", "share", "rare"])

    part = F.pmod(F.xxhash64("text"), F.lit(rounds)).cast("int").alias("part")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), part, "text")
    return stored(map_batches(rows, run, "doc_id bigint, row bigint, part int, ids binary, share double, rare binary"), "lm-ids")


def unpacked(ids: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in ids]


def train(numbers: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after all rounds, each over its own part of the documents."""
    spark = numbers.sparkSession
    flat = Network().flat
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def run(batches):
            keep_memory()
            net = Network(shared.value.copy())
            seen = {name: np.full_like(w, 1e-2) for name, w in net.w.items()}
            held, size, total = [], 0, 0
            for b in batches:
                for x in unpacked(b["ids"]):
                    if len(x):
                        held.append(x)
                        size += len(x)
                    if size >= BATCH:
                        total += size
                        learn(net, held, seen)
                        held, size = [], 0
            if held:
                total += size
                learn(net, held, seen)
            if total:
                for i in range(0, len(net.flat), BLOCK):
                    yield {"block": [i], "weights": [net.flat[i:i + BLOCK].tobytes()], "words": [total]}

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            totals: Counter = Counter()
            for b in batches:
                for block, x, n in zip(b["block"], b["weights"], b["words"]):
                    x = np.frombuffer(x, np.float32).astype(np.float64) * n
                    sums[block] = sums[block] + x if block in sums else x
                    totals[block] += n
            if sums:
                yield {"block": [*sums], "weights": [(s / totals[i]).astype(np.float32).tobytes() for i, s in sums.items()]}

        reports = map_columns(numbers.where(F.col("part") == k).select("ids"), run, "block int, weights binary, words bigint")
        mean = map_columns(reports.repartition("block"), add, "block int, weights binary").collect()    # one model
        for r in mean:
            flat[r.block:r.block + BLOCK] = np.frombuffer(r.weights, np.float32)
        shared.unpersist()
    return flat


def learn(net: Network, texts: list[np.ndarray], seen: dict[str, np.ndarray]) -> None:
    target, context = windows(texts)
    # equal steps: what a long text adds makes no small step of its own
    bounds = np.linspace(0, len(target), max(1, round(len(target) / BATCH)) + 1).astype(int)
    for a, b in zip(bounds, bounds[1:]):
        net.step(target[a:b], context[a:b], seen)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, n_words, pll (sum of the conditional
    log-probabilities of its words, natural logarithm, every word with its own
    probability), mean_pll (pll / n_words), bucket_pll and mean_bucket_pll (the same with a bucket as one word).

    Null and empty texts have no words, a pll of 0 and a null mean.  Repeated
    rows are trained on and scored each; a null doc_id stays null; an empty table
    gives no rows; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = word_counts(docs)
    words = vocabulary(counts)
    shares = bucket_shares(counts, words)
    numbers = numbered(docs, words, known_shares(shares), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(train(numbers, rounds))

    def run(batches):
        keep_memory()
        net = Network(shared.value)
        for b in batches:
            at = 0
            while at < len(b["ids"]):       # runs of about ten steps' words
                texts, size, start = [], 0, at
                while at < len(b["ids"]) and size < 10 * BATCH:
                    texts += unpacked(b["ids"][at:at + 1])
                    size += len(texts[-1])
                    at += 1
                sizes = np.array([len(x) for x in texts])
                ends = np.cumsum(sizes)
                target, context = windows(texts)
                bounds = np.linspace(0, len(target), max(1, round(len(target) / BATCH)) + 1).astype(int)
                lp = np.concatenate([np.zeros(1), *(net.log_probs(target[i:j], context[i:j]).astype(np.float64)
                                                    for i, j in zip(bounds, bounds[1:]))])
                run_sum = np.cumsum(lp)
                pll = run_sum[ends] - run_sum[ends - sizes]
                yield {"doc_id": b["doc_id"][start:at], "row": b["row"][start:at], "n_words": sizes.tolist(), "bucket_pll": pll.tolist(),
                       "share": b["share"][start:at]}

    scored = map_columns(numbers.select("doc_id", "row", "ids", "share"), run,
                         "doc_id bigint, row bigint, n_words bigint, bucket_pll double, share double")
    scored = scored.join(other_shares(numbers, shares), "row", "left")
    pll = F.col("bucket_pll") + F.col("share") + F.coalesce("other", F.lit(0.0))
    mean = [F.when(F.col("n_words") > 0, x / F.col("n_words")) for x in (pll, F.col("bucket_pll"))]
    return scored.select("doc_id", "n_words", pll.alias("pll"), mean[0].alias("mean_pll"), "bucket_pll", mean[1].alias("mean_bucket_pll"))
