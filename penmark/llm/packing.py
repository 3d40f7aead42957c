"""Packing (operator 1): lexical retrieval fills the windows.

1. Documents are tokenized in a map-only pass and stored as 16-bit token ids.
2. One pass over the stored ids counts, for every token id, the documents that hold
   it; that table is bounded by the vocabulary and broadcast.
3. Documents are dealt by content into shards of at most about ``SHARD_TOKENS``
   tokens.  A document's keys are the two terms that win a weighted MinHash; documents that
   share their keys meet in a shard, with a chance that doesn't depend on the corpus' size.
   A first key that overflows a shard is split by the second, and what still
   overflows (copies) by row.  Each shard builds a BM25 inverted index over its
   documents (token ids as terms, corpus-wide document frequencies).  A seed opens a window; the
   index returns its unused neighbours, best first, and they fill the window
   greedily.  What still doesn't fit is cut: the best neighbour gives the
   missing tokens and its rest stays available.  Documents longer than a window fill
   windows of their own and compete with their tails.

A shard's last, incomplete window is cut into sequences whose lengths are powers
of two, which need no padding; so no sequence is padded at all.

Shards are independent tasks of bounded size.  A shard is sorted before it is packed,
so a task that runs again gives the same sequences.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import map_columns, splitmix, stored

WINDOW = 2048
END_ID = 1                  # closes every document
SHARD_TOKENS = 2_000_000
FREQUENT = 8                # terms that one in so many documents of a shard holds are kept as dense rows
SPLIT = 16                  # bins of the second key for every shard that a first key would fill
K1, B = 1.2, 0.75           # BM25
DEFAULT_TOKENIZER = "word_bpe_49k.json"


# ASCII characters that the splitter keeps in one piece after a word (an apostrophe may open a piece of its own)
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# 1: letter, 2: one of these
KINDS = np.array([1 if chr(b).isalpha() else 2 if chr(b) in STOPS else 0 for b in range(256)], dtype=np.uint8)
# Latin-1 bytes, lower-cased as the tokenizer does it, line ends as blanks
FOLDED = bytes(32 if b == 10 else ord(chr(b).lower()) for b in range(256))


class Encoder:
    """Token ids as 16-bit little-endian bytes.

    The tokenizer drops white space and never joins what stands left and right
    of it, so the ids of a text are those of its parts between blanks and line
    ends, and each distinct part is encoded once per worker (bounded caches).  Its
    normaliser lower-cases character by character, so a Latin-1 text (which NFC leaves
    alone) may be lower-cased first; its splitter separates letters from
    punctuation that follows, so Latin-1 texts are parted there, too.  The parts of a batch of
    them are told apart in Arrow, so each distinct one is looked up once.

    The cache has two generations: a full one becomes the older one, from which parts that are seen
    again come back.  So it holds about twice ``limit`` parts, the frequent ones among them, however
    many different parts the corpus has."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids need more than 16 bits")
        # words of Latin-1 letters only: what the normaliser and splitter make of them is known
        # (one piece, its bytes in the byte-level alphabet), so they go to the model itself
        self.model = Tokenizer(self.tokenizer.model)
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
        self.closing = np.zeros(1 << 16, dtype=bool)    # tokens that end a word
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        probe = [chr(c) + w for c in self.letters if chr(c).islower() for w in ("", "the", "éa")]
        if self._direct(probe) != self._ids(probe):
            raise ValueError("expected a byte-level tokenizer that lower-cases and splits off letters")
        self.folded: dict[bytes, bytes] = {}            # parts of Latin-1 texts
        self.older: dict[bytes, bytes] = {}             # those of the generation before
        self.other: dict[str, bytes] = {"": b""}        # parts of all other texts
        self.limit = limit

    def _direct(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, whose last tokens close them."""
        if not words:
            return []
        spelled = [w if w.isascii() else w.translate(self.letters) for w in words]      # ASCII letters stand for themselves
        ids = np.array(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u2")
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) != len(words):
            return self._ids(spelled, self.model)
        raw, bounds = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _ids(self, parts: list[str], tokenizer=None) -> list[bytes]:
        """The ids of each part, from one call."""
        if not parts:
            return []
        e = (tokenizer or self.tokenizer).encode(parts, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(e.ids, dtype="<u2").tobytes()
        bounds = (2 * np.searchsorted(np.array(e.word_ids), np.arange(len(parts) + 1))).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def learn(self, parts: list[bytes]) -> list[bytes]:
        """The ids of the parts; the cache keeps those it lacked, unless they are long."""
        ids = list(map(self.folded.get, parts))
        at = [i for i, x in enumerate(ids) if x is None]
        if self.older:
            again = [(i, x) for i, x in zip(at, map(self.older.get, [parts[i] for i in at])) if x is not None]
            for i, x in again:
                ids[i] = self.folded[parts[i]] = x
            at = [i for i in at if ids[i] is None] if again else at
        texts = b" ".join([parts[i] for i in at]).decode("latin-1").split(" ") if at else []    # (no part holds a blank)
        letters = list(map(str.isalpha, texts))
        for chosen, encode in ((letters, self._direct), ([not x for x in letters], self._ids)):
            for i, x in zip(itertools.compress(at, chosen), encode(list(itertools.compress(texts, chosen)))):
                ids[i] = x
                if len(parts[i]) <= 64:
                    self.folded[parts[i]] = x
        return ids

    def encode_folded(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts whose white space is blanks."""
        if not texts:
            return []
        data = b" ".join(texts) + b" "
        chars = np.frombuffer(data, np.uint8)
        kinds = KINDS[chars]
        blank = chars == 32
        cut = blank.copy()
        cut[:-1] |= (kinds[:-1] == 1) & (kinds[1:] == 2)
        ends = np.flatnonzero(cut)
        offsets = np.concatenate(([0], ends + 1 - np.cumsum(blank, dtype=np.int32)[ends])).astype(np.int32)      # without the blanks
        full = np.diff(offsets) > 0
        ends, offsets = ends[full], offsets[np.concatenate(([True], full))]
        del chars, kinds, blank, cut            # as long as the texts, each
        bare = data.translate(None, b" ")
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self.learn(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) >> 1
        held = sizes[at]
        upto = np.concatenate(([0], np.cumsum(held, dtype=np.int32)))
        # token i of the batch is token i - upto[part] of its part
        source = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[at] - upto[:-1], held)
        source += np.arange(len(source), dtype=np.int32)
        raw = np.frombuffer(b"".join(ids), "<u2")[source].tobytes()
        texts_end = np.cumsum([len(t) + 1 for t in texts])
        bounds = [0, *(2 * upto[np.searchsorted(ends, texts_end)]).tolist()]        # after the parts that end before the text does
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.folded) > self.limit:
            self.older, self.folded = self.folded, {}
        if len(self.other) > self.limit:
            self.other = {"": b""}
        plain: dict[int, bytes] = {}
        other: dict[int, list[str]] = {}
        for i, t in enumerate(texts):
            try:
                b = (t or "").encode("latin-1")
                if b"<|" not in b:                              # (lower-casing must not make a special token's name)
                    plain[i] = b.translate(FOLDED)
                    continue
            except UnicodeEncodeError:
                pass
            other[i] = t.replace("\n", " ").split(" ")
        out = dict(zip(plain, self.encode_folded(list(plain.values()))))
        missing = list(set().union(*other.values()).difference(self.other))
        self.other.update(zip(missing, self._ids(missing)))
        for i, x in other.items():
            out[i] = b"".join(map(self.other.__getitem__, x))
        for p in missing:
            if len(p) > 64:
                del self.other[p]
        return [out[i] for i in range(len(texts))]


@functools.lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    import public_tokenizers
    return Encoder(str(public_tokenizers.path(name)))


def tokenize(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n): ids as 16-bit little-endian binary, closed by ``end_id``."""
    from penmark.llm.token_counts import batched
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches):
        e = encoder(tokenizer)
        for b in batches:
            for i, j in batched(b["text"], 1 << 22):
                ids = [x + end for x in e.encode(b["text"][i:j])]
                yield {"doc_id": b["doc_id"][i:j], "ids": ids, "n": [len(x) // 2 for x in ids]}

    return map_columns(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run,
                       "doc_id bigint, ids binary, n bigint")


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a text, ascending, and how often each occurs (16 bits are sorted by digits)."""
    if not len(ids):
        return ids, np.empty(0, dtype=np.int64)
    ordered = np.sort(ids, kind="stable")
    starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
    return ordered[starts], np.diff(starts, append=len(ids))


def terms_of_each(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``terms_of`` for many texts by one sort: (text, term, count), by text and term."""
    sizes = [len(x) for x in ids]
    kind = np.uint32 if len(ids) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(ids), dtype=kind) << kind(16), sizes)
    keys |= np.concatenate([*ids, np.empty(0, dtype="<u2")])
    keys.sort()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[:len(keys)]
    found = keys[starts]
    return (found >> kind(16)).astype(np.int32), (found & kind(0xFFFF)).astype(np.uint16), np.diff(starts, append=len(keys))


def chunks(ids: list[bytes], tokens: int = 1 << 20):
    """Stored texts as token arrays, in lists of about so many tokens."""
    held, n = [], 0
    for x in ids:
        held.append(np.frombuffer(x, "<u2"))
        n += len(held[-1])
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def document_frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents per token id, number of documents, mean length, over the whole corpus."""
    def run(batches):
        encoder.cache_clear()           # the texts are encoded: a worker that serves on needs it no more
        df = np.zeros(1 << 16, dtype=np.int64)
        for b in batches:
            for ids in chunks(b["ids"]):
                df += np.bincount(terms_of_each(ids)[1], minlength=1 << 16)
        terms = np.flatnonzero(df)
        yield {"term": terms, "df": df[terms]}

    parts = map_columns(tokens.select("ids"), run, "term int, df bigint")
    df = np.zeros(1 << 16, dtype=np.int64)
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():      # at most one row per token id
        df[r.term] = r.df
    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("tokens")).first()
    return df, total.n, (total.tokens or 0) / max(1, total.n)


@functools.lru_cache(maxsize=1)
def races() -> np.ndarray:
    """Exponential variables of all token ids, the same in every task."""
    x = splitmix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(11)
    return -np.log((x.astype(np.float64) + 0.5) / (1 << 53))


def content_keys(ids: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[list[int], list[int]]:
    """Per text (of one token at least) the two terms that win the race of squared BM25 weights: a
    text's likely neighbours have the same with the chance of their weighted overlap."""
    row, t, tf = terms_of_each(ids)
    w = idf[t] * tf / (tf + (K1 * (1 - B + B * np.array([len(x) for x in ids]) / mean))[row])
    v = races()[t] / np.maximum(w * w, 1e-30)
    starts = np.searchsorted(row, np.arange(len(ids)))
    winners = []
    for _ in range(2):
        best = np.flatnonzero(v == np.minimum.reduceat(v, starts)[row])
        best = best[np.searchsorted(row[best], np.arange(len(ids)))]        # ties: the first
        winners.append(t[best].tolist())
        # a text of one term has it twice
        v[best[np.diff(starts, append=len(row)) > 1]] = np.inf
    return winners[0], winners[1]


def bin_of(key: int, bins: int) -> int:
    return (key * 40503 % (1 << 16)) * bins >> 16


class Deal:
    """Which shard a document goes to: neighbouring units (a first key, a bin of its second key, or
    a part of such a bin) share a shard while they fit."""

    def __init__(self, units: list[tuple[int, int, int]], bins: dict[int, int], room: int):
        self.bins = bins                                        # first keys that are split
        self.place: dict[tuple[int, int], tuple[int, int]] = {}     # unit -> first shard, shards
        shard, held = 0, 0
        for key, part, tokens in sorted(units):
            parts = max(1, -(-tokens // room))
            if held and held + tokens > room:
                shard, held = shard + 1, 0
            self.place[key, part] = shard, parts
            shard, held = shard + parts - 1, held + tokens if parts == 1 else room
        self.shards = shard + 1

    def __call__(self, first: int, second: int, salt: int) -> int:
        bins = self.bins.get(first)
        shard, parts = self.place[first, bin_of(second, bins) if bins else -1]
        return shard + salt % parts


def deal(tokens: DataFrame, shared, room: int) -> Deal:
    """Counts the tokens of all keys; the driver gets at most one row per token id, and
    ``SPLIT`` rows per shard that an overflowing key fills."""
    def run(batches):
        encoder.cache_clear()
        idf, mean = shared.value
        n: Counter = Counter()
        for b in batches:
            for ids in chunks(b["ids"]):
                for x, *key in zip(ids, *content_keys(ids, idf, mean)):
                    n[tuple(key)] += len(x)
            if len(n) > 100_000:
                yield {"first": [k for k, _ in n], "second": [k for _, k in n], "n": [*n.values()]}
                n.clear()
        yield {"first": [k for k, _ in n], "second": [k for _, k in n], "n": [*n.values()]}

    keys = stored(map_columns(tokens.select("ids"), run, "first int, second int, n bigint"), "pack-keys")
    units, bins = [], {}
    for r in keys.groupBy("first").agg(F.sum("n").alias("n")).collect():
        if r.n > room:
            bins[r["first"]] = min(1 << 16, SPLIT * -(-r.n // room))
        else:
            units.append((r["first"], -1, r.n))
    if bins:
        split = pa.table([[*bins], [*bins.values()]], pa.schema([("first", pa.int32()), ("bins", pa.int64())]))
        split = keys.sparkSession.createDataFrame(split)        # (a list would start more Python workers)
        part = F.shiftright(F.col("second").cast("bigint") * 40503 % (1 << 16) * F.col("bins"), 16).cast("int")
        rows = keys.join(F.broadcast(split), "first").groupBy("first", part.alias("part")).agg(F.sum("n").alias("n"))
        units += [(r["first"], r.part, r.n) for r in rows.collect()]
    return Deal(units, bins, room)


class Shard:
    """The unused pieces of a shard and their BM25 index."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        self.left = np.array([len(x) for x in ids], dtype=np.int64)     # unused tokens; 0: used up
        rows, self.terms, tf = terms_of_each(ids)
        weights = idf[self.terms] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * self.left / mean))[rows])
        self.bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        order = np.argsort(self.terms, kind="stable")
        self.order = self.terms[order]
        self.index(rows[order], weights.astype(np.float32)[order])

    def index(self, rows: np.ndarray, weights: np.ndarray) -> None:
        """Postings of the unused pieces; ``order`` holds their terms, ascending."""
        self.rows, self.by_term = rows, weights
        self.alive = np.unique(rows)                            # pieces of the index
        self.postings = np.searchsorted(self.order, np.arange((1 << 16) + 1))
        held = np.diff(self.postings)
        self.dense = np.full(1 << 16, -1)
        often = np.flatnonzero(held * FREQUENT >= max(1, len(self.alive)))
        self.dense[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(self.alive)), dtype=np.float32)
        at = self.dense[self.order]
        self.matrix[at[at >= 0], np.searchsorted(self.alive, rows[at >= 0])] = weights[at >= 0]

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused pieces that share a term with the seed, best first."""
        unused = self.left[self.alive] > 0
        if 2 * unused.sum() < len(self.alive):                  # half of the pieces are used up: a smaller index
            keep = self.left[self.rows] > 0
            self.order = self.order[keep]
            self.index(self.rows[keep], self.by_term[keep])
        t = self.terms[self.bounds[seed]:self.bounds[seed + 1]]
        dense = self.dense[t]
        spans = [slice(a, b) for a, b in zip(self.postings[t[dense < 0]].tolist(), self.postings[t[dense < 0] + 1].tolist())]
        score = np.zeros(len(self.left))
        score[self.alive] = self.matrix[dense[dense >= 0]].sum(axis=0)
        if spans:
            score += np.bincount(np.concatenate([self.rows[s] for s in spans]),
                                 weights=np.concatenate([self.by_term[s] for s in spans]), minlength=len(self.left))
        score[self.left == 0] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(doc_ids: list, ids: list[np.ndarray], idf: np.ndarray, mean: float,
               window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document index, start, length)."""
    sequences: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(ids), dtype=np.int64)
    for i, x in enumerate(ids):
        for _ in range(len(x) // window):
            sequences.append([(i, int(start[i]), window)])
            start[i] += window
    shard = Shard([x[s:] for x, s in zip(ids, start)], idf, mean)
    left = shard.left
    queue = np.argsort(-left, kind="stable").tolist()       # seeds, longest first
    queue.reverse()

    def take(i: int, room: int) -> tuple[int, int, int]:
        n = min(int(left[i]), room)
        piece = (i, int(start[i]), n)
        start[i] += n
        left[i] -= n
        return piece

    while queue:
        seed = queue.pop()
        if not left[seed]:
            continue
        sequence = [take(seed, window)]
        room = window - sequence[0][2]
        if room:
            near = shard.neighbours(seed)
            sizes, at = left[near], 0
            while room:                                         # whole pieces that fit, best first, to the last neighbour
                fit = np.flatnonzero(sizes[at:] <= room)
                if not len(fit):
                    break
                at += int(fit[0]) + 1
                sequence.append(take(int(near[at - 1]), room))
                room -= sequence[-1][2]
            for i in near:                                      # then the best of the rest, cut
                if not room:
                    break
                if left[i]:
                    sequence.append(take(int(i), room))
                    room -= sequence[-1][2]
                    if left[i]:
                        queue.append(int(i))
            while room and queue:                               # no neighbour is left: the next unused pieces
                i = queue[-1]
                if left[i]:
                    sequence.append(take(i, room))
                    room -= sequence[-1][2]
                if not left[i]:
                    queue.pop()
        if room:
            sequences.extend(powers(sequence))
        else:
            sequences.append(sequence)
    return sequences


def powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of an incomplete sequence, cut into sequences whose lengths are powers of two."""
    out, pieces = [], list(sequence)[::-1]
    total = sum(p[2] for p in pieces)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        current = []
        while size:
            i, s, n = pieces.pop()
            if n > size:
                pieces.append((i, s + size, n - size))
                n = size
            current.append((i, s, n))
            size -= n
        out.append(current)
    return out


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = DEFAULT_TOKENIZER, with_ids: bool = False,
         shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, padding (0) and, if asked for, the piece's ``ids``.

    A null or empty text is packed as its closing id alone.  Rows that share a
    doc_id are packed each; a null doc_id stays null; an empty table gives no
    rows; other columns are not read."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer), "pack-tokens")
    df, n_docs, mean = document_frequencies(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, max(mean, 1.0)))
    dealt = spark.sparkContext.broadcast(deal(tokens, shared, shard_tokens))

    def place(batches):
        idf, mean = shared.value
        for b in batches:
            keys = [k for ids in chunks(b["ids"]) for k in zip(*content_keys(ids, idf, mean))]
            where = [dealt.value(*k, salt) for k, salt in zip(keys, b["salt"])]
            yield {"doc_id": b["doc_id"], "ids": b["ids"], "n": b["n"], "shard": where}

    def packed(shard, doc_ids, ids):
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")}
        if with_ids:
            out["ids"] = []
        for k, sequence in enumerate(pack_shard(doc_ids, ids, *shared.value, window)):
            offset = 0
            for i, s, n in sequence:
                piece = ids[i][s:s + n].astype("<u4").tobytes()
                for name, v in (("doc_id", doc_ids[i]), ("start", s), ("length", n), ("ids_crc32", zlib.crc32(piece)),
                                ("doc_tokens", len(ids[i])), ("sequence_id", shard << 32 | k), ("offset", offset),
                                ("padding", 0)):
                    out[name].append(v)
                if with_ids:
                    out["ids"].append(piece)
                offset += n
        return out

    def run(batches):
        encoder.cache_clear()
        shard, doc_ids, ids = None, [], []
        for b in batches:
            for at, i, x in zip(b["shard"], b["doc_id"], b["ids"]):
                if at != shard:
                    if ids:
                        yield packed(shard, doc_ids, ids)
                    shard, doc_ids, ids = at, [], []
                doc_ids.append(i)
                ids.append(np.frombuffer(x, "<u2"))
        if ids:
            yield packed(shard, doc_ids, ids)

    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint, padding bigint")
    # the stored rows are read in the same order by every attempt, so the salt is the row's own
    salted = tokens.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = map_columns(salted, place, "doc_id bigint, ids binary, n bigint, shard int")
    shards = placed.repartitionById(dealt.value.shards, "shard").sortWithinPartitions("shard", "doc_id", "n", F.crc32("ids"))
    return map_columns(shards.select("shard", "doc_id", "ids"), run, schema + (", ids binary" if with_ids else ""))
