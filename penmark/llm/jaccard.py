"""N-gram Jaccard join (operator 4): MinHash banding, exact verification.

1. Every document becomes its set of five-word shingles.  Documents with the same
   set form a class (copies); from here on a class counts once.
2. MinHash signatures of ``BANDS`` x ``ROWS`` values: two classes of similarity s
   share a band with probability 1 - (1 - s^ROWS)^BANDS, that is 0.992 at s = 0.8
   and 0.9996 at 0.85, but 0.04 at 0.4 and below 0.0001 at 0.2.
3. The band hashes are shuffled; a band value held by several classes links
   each of them to the smallest, and connected components of these links
   are the candidate groups.  No pairs are listed: a band value of m classes gives m - 1 links.
4. Inside a candidate group every two classes are compared on their full
   shingle sets.  A group is cut into blocks of ``BLOCK`` classes and each pair of
   blocks is a unit of work of its own, so a hot group spreads over tasks.
   A unit counts links per class and reports its local components, never pairs.
5. Components of the verified links are the near-duplicate classes.

A group's comparisons grow with the square of its number of *different* texts,
which the exact number of links asks for; rows only grow by the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import WordHasher, map_columns, shingle_hashes, splitmix, stored, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 8
BLOCK = 256


def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = splitmix(np.arange(2 * BANDS * ROWS, dtype=np.uint64))
    a, b = np.split((seeds >> np.uint64(32)).astype(np.uint32), 2)
    return a | np.uint32(1), b


def band_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band of the MinHash signature of a non-empty set."""
    low = (splitmix(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 16) // len(a))
    for i in range(0, len(low), step):       # bounded memory for very long texts
        x = low[i:i + step, None] * a[None, :]
        x += b[None, :]
        np.minimum(least, x.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    acc = splitmix(np.arange(BANDS, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            acc = splitmix(acc * np.uint64(0x100000001B3) + rows[:, r])
    return acc


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, set_hash, bands) of every document; set_hash is null and bands
    are empty where there are no words."""
    def run(batches):
        hasher = WordHasher()
        a, b = permutations()
        for batch in batches:
            out = {"row": batch["row"], "doc_id": batch["doc_id"], "set_hash": [], "bands": []}
            for t in batch["text"]:
                s = shingle_hashes(hasher(words_of(t)), SHINGLE)
                out["set_hash"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["bands"].append(band_hashes(s, a, b).view(np.int64).tolist() if len(s) else [])
            yield out

    return map_columns(docs.select("row", "doc_id", "text"), run, "row bigint, doc_id bigint, set_hash binary, bands array<bigint>")


def components(links: DataFrame, label: str) -> DataFrame:
    """(v, root): connected components of undirected links (a, b), root = the
    smallest member.  Each round takes the smallest root among the
    neighbours and then the root's root, which at least halves the
    distances left; every round is written to the shared folder."""
    both = stored(links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))
                                                               .where("a <> b")).distinct(), f"{label}-links")
    state = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("root")), f"{label}-roots")
    while True:
        near = both.join(state.select(F.col("v").alias("a"), "root"), "a").groupBy(F.col("b").alias("v")) \
                   .agg(F.min("root").alias("near"))
        best = state.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        best = stored(best, f"{label}-step")
        up = best.select(F.col("v").alias("root"), F.col("root").alias("above"))
        # hooking: a vertex's old root also learns the smaller root
        hook = best.where("root < old").groupBy(F.col("old").alias("root")).agg(F.min("root").alias("hooked"))
        after = best.join(up, "root", "left").join(hook, "root", "left") \
                    .select("v", "old", F.least("root", F.coalesce("above", "root"), F.coalesce("hooked", "root")).alias("root"))
        after = stored(after, f"{label}-roots")
        state = after.select("v", "root")
        if after.where("root <> old").isEmpty():
            return state


def count_overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct sets."""
    values = np.concatenate(right)
    rows = np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for i, s in enumerate(left):
        a, b = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = b - a
        hit = n > 0
        if hit.any():
            a, n = a[hit], n[hit]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            out[i] = np.bincount(rows[at], minlength=len(right))
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    overlap = count_overlaps(left, right)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return overlap >= similarity * (total - overlap) - 1e-9


def compare_unit(key: tuple, members: list[dict], similarity: float) -> dict:
    """Links of one pair of blocks: per class the number of linked classes and of
    documents in them, and the smallest class of its local component."""
    _, i, j = key
    first = [m for m in members if m["block"] == i]
    second = first if i == j else [m for m in members if m["block"] == j]
    if not first or not second or (i == j and len(first) < 2):
        return {"set_hash": [], "n_classes": [], "n_docs": [], "low": []}
    near = linked(*([np.frombuffer(m["shingles"], np.uint64) for m in x] for x in (first, second)), similarity)
    if i == j:
        np.fill_diagonal(near, False)
        nodes, full = first, near
    else:
        nodes = first + second
        full = np.zeros((len(nodes), len(nodes)), dtype=bool)
        full[:len(first), len(first):] = near
        full |= full.T
    order = sorted(range(len(nodes)), key=lambda n: nodes[n]["set_hash"])
    low = np.empty(len(nodes), dtype=np.int64)
    low[order] = np.arange(len(nodes))
    size = np.array([m["size"] for m in nodes])
    while True:     # the smallest member's rank reaches everyone along the links
        after = np.minimum(low, np.where(full, low[None, :], len(nodes)).min(axis=1))
        if (after == low).all():
            break
        low = after
    has = np.flatnonzero(full.any(axis=1))
    return {"set_hash": [nodes[n]["set_hash"] for n in has], "n_classes": full.sum(axis=1)[has].tolist(),
            "n_docs": (full @ size)[has].tolist(), "low": [nodes[order[low[n]]]["set_hash"] for n in has]}


NO_ID = -(1 << 63)      # stands for a null doc_id


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a stored table with a number of its own for every row (``__row``): rows are
    told apart by it, however many share an id or have none."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-rows")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its near-duplicate
    class), copy_id (smallest doc_id with the same shingle set), n_copies
    (documents with that set), n_links (other documents of similarity at least
    ``similarity``, copies included), n_text_links (different shingle sets among them).

    Texts without words resemble nothing, not even each other: their class is
    themselves and they have no links.  A text of one to four words is one
    shingle.  Rows that share a doc_id are copies if their texts are; a
    null doc_id counts as the smallest and is returned as null.  An empty table gives no rows;
    other columns are not read."""
    rows = numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = classes_of_rows(rows, similarity, block)
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), real(F.coalesce("class_id", "doc_id")).alias("class_id"),
                      real(F.coalesce("copy_id", "doc_id")).alias("copy_id"), F.coalesce("size", F.lit(1)).alias("n_copies"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"))


def classes_of_rows(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """(row, doc_id, root, class_id, copy_id, size, n_links, n_text_links) of numbered rows;
    the last six are null for a text without words, and a null doc_id is ``NO_ID``."""
    rows = rows.select(F.col("__row").alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text")
    sigs = stored(signatures(rows), "jaccard-signatures")
    classes = stored(sigs.where("set_hash is not null").groupBy("set_hash").agg(
        F.min("doc_id").alias("rep0"), F.min("row").alias("row"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")),
        "jaccard-classes")
    # candidate search names a class by 60 bits of its hash; two classes of one name only
    # share a candidate group
    name = F.conv(F.substring(F.hex("set_hash"), 1, 15), 16, 10).cast("bigint")
    bands = classes.select(name.alias("name"), F.posexplode("bands").alias("band", "value"))
    hubs = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("hub")).where("n > 1")
    links = stored(bands.join(hubs.select("band", "value", "hub"), ["band", "value"]).where("name <> hub")
                   .select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct(), "jaccard-candidates")
    groups = components(links, "jaccard-groups")

    # full shingle sets of the candidates, from one text of each class
    named = classes.select(name.alias("v"), "set_hash", "row", "size").join(groups, "v")
    blocks = named.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("bigint").alias("blocks"))
    chosen = stored(named.join(blocks, "root").select(F.col("root").alias("unit"), "blocks", "set_hash", "size", "row"),
                    "jaccard-chosen")
    kept = ["unit", "blocks", "set_hash", "size"]

    def sets(batches):
        hasher = WordHasher()
        for b in batches:
            out = {k: [] for k in (*kept, "shingles")}
            for t, *row in zip(b["text"], *(b[k] for k in kept)):
                s = shingle_hashes(hasher(words_of(t)), SHINGLE).tobytes()
                for k, v in zip(out, (*row, s)):
                    out[k].append(v)
            yield out

    # the chosen side is the smaller one: the texts need no sort
    texts = rows.select("row", "text").join(chosen.hint("shuffle_hash"), "row").select("text", *kept)
    full = map_columns(texts, sets, "unit bigint, blocks bigint, set_hash binary, size bigint, shingles binary")
    full = stored(full, "jaccard-sets")
    own = F.pmod(F.xxhash64("set_hash"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    work = full.select("unit", "set_hash", "size", "shingles", own.alias("block"), other.alias("other")).select(
        "*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(batches):
        key, members = None, []
        for m in units(batches):
            if m["key"] != key:
                if members:
                    yield compare_unit(key, members, similarity)
                key, members = m["key"], []
            members.append(m)
        if members:
            yield compare_unit(key, members, similarity)

    def units(batches) -> Iterator[dict]:
        for b in batches:
            for r in range(len(b["unit"])):
                m = {k: b[k][r] for k in ("set_hash", "block", "size", "shingles")}
                m["key"] = (b["unit"][r], b["i"][r], b["j"][r])
                yield m

    work = work.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "set_hash")
    found = stored(map_columns(work, compare, "set_hash binary, n_classes bigint, n_docs bigint, low binary"), "jaccard-links")
    roots = components(found.select(F.col("set_hash").alias("a"), F.col("low").alias("b")), "jaccard-verified")
    counts = found.groupBy("set_hash").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_docs").alias("n_docs"))

    per_class = classes.select("set_hash", "rep0", "size").join(roots.withColumnRenamed("v", "set_hash"), "set_hash", "left") \
                       .join(counts, "set_hash", "left") \
                       .select("set_hash", F.coalesce("root", "set_hash").alias("root"), F.col("rep0").alias("copy_id"), "size",
                               F.coalesce("n_classes", F.lit(0)).alias("n_text_links"),
                               (F.coalesce("n_docs", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    per_class = stored(per_class, "jaccard-per-class")
    lowest = per_class.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    per_class = stored(per_class.join(lowest, "root"), "jaccard-result")
    return sigs.select("row", "doc_id", "set_hash").join(per_class, "set_hash", "left")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that with the
    smallest doc_id (a null one counts as the smallest), of several the first row.  Texts
    without words all stay; columns are unchanged."""
    names = [f"__c{i}" for i in range(len(docs.columns))]       # no column can clash with a key
    rows = numbered(docs.toDF(*names))
    of = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    found = classes_of_rows(rows.select("__row", *[F.col(v).alias(k) for k, v in of.items()]), similarity, BLOCK)
    found = stored(found.select("row", "doc_id", "root"), "jaccard-kept")
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    kept = first.union(found.where("root is null").select("row")).withColumnRenamed("row", "__row")
    return rows.join(kept, "__row", "left_semi").select(*names).toDF(*docs.columns)
