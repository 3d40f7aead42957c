"""Line dedup (operator 7): two Bloom filters find the suspected repeats.

1. Each task reduces its documents' line keys to 64-bit hashes, distinct per
   document, and sends the Bloom positions of those it saw in one document and
   of those it saw in several.  Per filter segment these become two bit sets:
   once seen and twice seen (a bit that arrives a second time moves up).  Only
   positions are sent, so the volume follows the number of distinct lines of a
   task, not the size of the filters.
2. Lines whose key may be in the twice-seen filter are suspects.  Only their
   (key digest, doc_id) pairs are shuffled, and counted exactly.
3. Keys in at least ``min_docs`` documents are repeats; the largest doc_id
   keeps its lines, all other holders lose theirs.

A Bloom filter has false positives but no false negatives: its size changes the
number of suspects, never the result.  The twice-seen filter is broadcast;
its size follows the number of long lines up to ``MAX_FILTER_BITS``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import map_batches, map_columns, splitmix, stored

MIN_CHARS = 20          # code points of a key that counts
MIN_DOCS = 3            # documents that make a key a repeat
PROBES = 3              # Bloom positions of a key
BITS_PER_LINE = 16
MAX_FILTER_BITS = 1 << 30       # 128 MB
SEGMENT_BITS = 1 << 20
NO_ID = -(1 << 63)      # stands for a null doc_id: smaller than all others
# --- FIXED VALUES: bytes stripped at both ends of a key, and A-Z to a-z ---
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).translate(LOWER)


def long_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Per line its key, or None if the key is too short to count."""
    if not text:
        return [None]
    out = []
    for line in text.encode().split(b"\n"):
        k = key_of(line)
        # a code point takes 1 to 4 bytes
        out.append(k if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars) else None)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def hashes_of(keys: set[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Bloom positions of hashes, one row per probe."""
    with np.errstate(over="ignore"):
        step = splitmix(h) | np.uint64(1)
        return np.stack([splitmix(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def count_lines(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("n")).first().n or 0


def filter_bits(n_lines: int) -> int:
    """A power of two with room for every line to be distinct, within the bound."""
    return min(MAX_FILTER_BITS, max(1 << 16, 1 << (n_lines * BITS_PER_LINE - 1).bit_length()))


def twice_seen(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> bytes:
    """The twice-seen Bloom filter over all documents' keys, as packed bits."""
    width = min(bits, SEGMENT_BITS)
    segments = bits // width

    def mark(batches):
        seen = []
        for b in batches:
            for t in b["text"]:
                keys = {k for k in long_keys(t, min_chars) if k is not None}
                if keys:
                    seen.append(hashes_of(keys))
            if sum(map(len, seen)) > 2_000_000:     # bounded; a key of two runs is sent from both
                yield pack(seen)
                seen = []
        if seen:
            yield pack(seen)

    def pack(seen):
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        once = np.unique(positions(h[n == 1], bits))
        twice = np.unique(positions(h[n > 1], bits))
        out = {"segment": [], "once": [], "twice": []}
        at = np.arange(segments + 1) * width
        a, b = np.searchsorted(once, at), np.searchsorted(twice, at)
        for s in range(segments):
            if a[s] < a[s + 1] or b[s] < b[s + 1]:
                out["segment"].append(s)
                out["once"].append((once[a[s]:a[s + 1]] - s * width).astype(np.uint32).tobytes())
                out["twice"].append((twice[b[s]:b[s + 1]] - s * width).astype(np.uint32).tobytes())
        return out

    def merge(batches):     # one task's segments; what arrives is streamed into their bits
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, o, t in zip(b["segment"], b["once"], b["twice"]):
                if s not in held:
                    held[s] = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
                once, twice = held[s]
                o, t = np.frombuffer(o, np.uint32), np.frombuffer(t, np.uint32)
                twice[t] = True
                twice[o[once[o]]] = True
                once[o] = True
                once[t] = True
        if held:
            yield {"segment": [*held], "bits": [np.packbits(x[1]).tobytes() for x in held.values()]}

    marks = map_columns(docs.select("text"), mark, "segment int, once binary, twice binary")
    parts = map_columns(marks.repartition("segment"), merge, "segment int, bits binary").collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts:
        out[r.segment * width // 8:(r.segment + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Exactly confirmed repeats that a document loses: (id, other, digest), the first two as in ``doc_keys``."""
    bits = filter_bits(count_lines(docs))
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, bits, min_chars))

    def suspects(batches):
        packed = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            out = {"id": [], "other": [], "digest": []}
            for i, other, t in zip(b["id"], b["other"], b["text"]):
                keys = [*{k for k in long_keys(t, min_chars) if k is not None}]
                if keys:
                    p = positions(hashes_of(keys), bits)
                    hit = ((packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=0)
                    for j in np.flatnonzero(hit):
                        out["id"].append(i)
                        out["other"].append(other)
                        out["digest"].append(digest(keys[j]))
            yield out

    found = stored(map_columns(docs.select(*doc_keys(), "text"), suspects, "id bigint, other bigint, digest binary"), "line-suspects")
    # two steps: distinct documents of a key spread a hot key over all tasks
    pairs = found.groupBy("digest", "id", "other").agg(F.count(F.lit(1)).alias("n"))
    kept = pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "other")).alias("keeper")) \
                .where(F.col("n") >= min_docs).select("digest", "keeper")
    kept = stored(kept, "line-repeats")
    return found.join(kept, "digest").where(F.struct("id", "other") != F.col("keeper")).select("id", "other", "digest")


def doc_keys():
    """What makes rows one document: the id, and for rows without one the text."""
    no_id = F.col("doc_id").isNull()
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
            F.when(no_id, F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")).alias("other")]


def with_drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``docs`` beside the array of key digests that each loses (``__drop``)."""
    drops = repeats(docs, min_chars, min_docs).groupBy("id", "other").agg(F.collect_set("digest").alias("__drop"))
    own = [k.alias(f"__own_{n}") for k, n in zip(doc_keys(), ("id", "other"))]
    keyed = drops.select(F.col("id").alias("__own_id"), F.col("other").alias("__own_other"), "__drop")
    return docs.select("*", *own).join(keyed, ["__own_id", "__own_other"], "left").select(*docs.columns, "__drop")


def drop_lines(text: str | None, drop: list[bytes] | None, min_chars: int) -> tuple[list[str], int]:
    """The kept lines, and the number of all lines."""
    lines = text.split("\n") if text else [""]
    if not drop:
        return lines, len(lines)
    gone = set(drop)
    return [x for x, k in zip(lines, long_keys(text, min_chars)) if k is None or digest(k) not in gone], len(lines)


def report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line; rows that share a doc_id are one
    document, and so are rows without an id that share a text; a null doc_id is smaller than all
    others; an empty table gives no rows; other columns are not read."""
    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "n_lines": [], "n_dropped": [], "kept_sha256": []}
            for t, d in zip(b["text"], b["__drop"]):
                kept, n = drop_lines(t, d, min_chars)
                out["n_lines"].append(n)
                out["n_dropped"].append(n - len(kept))
                out["kept_sha256"].append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield out

    rows = with_drops(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), min_chars, min_docs)
    return map_columns(rows, run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def clean(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows without any
    pass unchanged, a row that loses all its lines has an empty text.
    ``n_chars``, if there, follows the new text."""
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None
    schema = docs.schema

    def run(batches):
        for b in batches:
            columns = list(b.columns)
            drops = columns.pop()
            if drops.null_count < len(drops):
                texts = columns[at].to_pylist()
                new = ["\n".join(drop_lines(t, d, min_chars)[0]) if d else t
                       for t, d in zip(texts, drops.to_pylist())]
                columns[at] = pa.array(new, type=b.schema.field(at).type)
                if chars is not None:
                    columns[chars] = pa.array(
                        [c if n is t else len(n) for c, n, t in zip(columns[chars].to_pylist(), new, texts)],
                        type=b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(i) for i in range(len(columns))]))

    return map_batches(with_drops(docs, min_chars, min_docs), run, schema)
