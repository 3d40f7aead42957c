"""Spelling variant grouping (operator 13): a dictionary of trie-node pairs.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  The nodes of a trie of the words and of a trie of the reversed words are
numbered; cutting a word at position i gives the pair (node of what is before i,
node of what is from i on), and skipping the code point at i the pair (node before
i, node after i).  Two words that differ by a replacement share a skip pair; a word with one
code point more shares a skip pair of it with a cut pair of the shorter word.  Pairs of
integers are all that is joined, and equal pairs mean equal strings: neighbours are exact.

The numbers come from two ordered passes: words are sorted into ranges, each task
walks its range and numbers the nodes that are new against the word before.  Nodes
that reach over the border of a range are prefixes of words on both sides; they
get numbers of their own from the list of border words (two per range).  A node that only one word
passes through can't be part of a match, so no pair is made of it.

Group sizes: all words of a skip pair differ in the code point at one position, so a pair
has at most as many as there are letters.  Within it the best neighbour is found from the
two most frequent words; pairs of words are never listed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import map_columns, stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
TIMES = 10              # a form is at least this many times as frequent
HELD = 400_000          # different words a task counts before it hands them on
SKIP_ONE_IN = 31
SPAN = 1 << 40          # numbers of one range's words and nodes

# --- FIXED VALUES: the letters of a run ---
LETTERS = "A-Za-zÀ-ÿ"
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


# maximal runs that are long enough: nothing makes a run longer
RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(CAPITALS)


def altered(run: str, start: int) -> str:
    """The lower-cased run without the code point that the rule deletes; ``start`` is the crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), start)
    if h % SKIP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, alter: bool = False) -> DataFrame:
    """(word, n): the words of at least ``LEAST_LENGTH`` code points that occur at
    least ``LEAST_COUNT`` times in all texts.  Tasks count before the shuffle."""
    def run(batches) -> Iterator[dict]:
        total: dict[str, int] = {}

        def handed():
            out = {"word": [*total], "n": [*total.values()]}
            total.clear()
            return out

        for b in batches:
            for d, text in zip(b["doc_id"], b["text"]):
                start = zlib.crc32(f"{d}:".encode())
                for found in RUN.findall(text or ""):
                    w = lowered(found)
                    if alter and d is not None:
                        w = altered(w, start)
                        if len(w) < LEAST_LENGTH:
                            continue
                    total[w] = total.get(w, 0) + 1
                if len(total) > HELD:
                    yield handed()
        if total:
            yield handed()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = map_columns(rows, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n        # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def numbered(words: Iterator[str], base: int) -> Iterator[tuple[str, list[int]]]:
    """Per word of an ordered sequence the numbers of its trie nodes, from the root
    (the empty prefix) down to the deepest that a neighbour in the order passes through too."""
    before: list[int] = [base]
    fresh = base + 1
    word, kept = next(words, None), 0
    while word is not None:
        following = next(words, None)
        depth = shared(word, following) if following is not None else 0
        nodes = before[:kept + 1]
        if depth > kept:
            nodes += range(fresh, fresh + depth - kept)
            fresh += depth - kept
        yield word, nodes
        before, word, kept = nodes, following, depth


class Borders:
    """The first and last word of every range, and the numbers (below 0) of the nodes that reach over a border."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        rows = sorted(rows)
        self.words = sorted({w for _, first, last in rows for w in (first, last)})
        self.nodes = {w: [-1 - x for x in nodes] for w, nodes in numbered(iter(self.words), 0)}
        self.neighbours = {part: [w for w in (rows[i - 1][2] if i else None, rows[i + 1][1] if i + 1 < len(rows) else None) if w is not None]
                           for i, (part, _, _) in enumerate(rows)}

    def settle(self, part: int, word: str, nodes: list[int]) -> list[int]:
        """The word's nodes with those that reach over a border renumbered.  The root is always one of them."""
        over = [-1]
        for other in self.neighbours[part]:
            depth = shared(word, other)
            if depth >= len(over):
                over = self.nodes[other][:depth + 1]
        return over + nodes[len(over):]


def ordered(words: DataFrame, column: str, out: str, number: str | None = None) -> tuple[DataFrame, Borders]:
    """``words`` sorted by ``column`` into ranges, with ``<out>``: the numbers of its
    nodes, ``<out>_part``: its range, and (if named) ``number``: a number that follows
    the order.  Written as a table, so that ranges don't move when a task runs again."""
    at = words.columns.index(column)
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields]
    schema += [f"{out} array<bigint>", f"{out}_part int"] + [f"{number} bigint"] * bool(number)
    names = [x.split()[0] for x in schema]

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[tuple] = []

        def rows():
            for b in batches:
                for row in zip(*b.values()):
                    held.append(row)
                    yield row[at]

        done = []
        for i, (_, nodes) in enumerate(numbered(rows(), part * SPAN)):
            done.append((*held.pop(0), nodes, part) + ((part * SPAN + i,) if number else ()))
            if len(done) == 20_000:
                yield dict(zip(names, zip(*done)))
                done = []
        if done:
            yield dict(zip(names, zip(*done)))

    sorted_words = words.repartitionByRange(column).sortWithinPartitions(column)
    table = stored(map_columns(sorted_words, run, ", ".join(schema)), "spelling-" + out)
    # one row per range
    borders = table.groupBy(f"{out}_part").agg(F.min(column).alias("first"), F.max(column).alias("last")).collect()
    return table, Borders([tuple(r) for r in borders])


def pairs_of(word: str, forward: list[int], backward: list[int]) -> Iterator[tuple[int, int, bool, bool]]:
    """(node before, node after, skipped, counted) of the cuts and skips whose nodes
    other words pass through too.  Skipping any code point of a row of equal ones gives the
    same string: only the first is counted as a longer word."""
    size, least = len(word), len(word) - len(backward) + 1      # a suffix from position least on has a shared node
    for i in range(max(0, least - 1), min(size, len(forward))):
        if i >= least:
            yield forward[i], backward[size - i], False, False
        yield forward[i], backward[size - i - 1], True, i == 0 or word[i] != word[i - 1]
    if size < len(forward):
        yield forward[size], backward[0], False, False


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, word, n) with ids in code-point order, and their node pairs (before, after, skipped, counted, id, n)."""
    first, borders = ordered(words, "word", "forward", "id")
    second, borders_back = ordered(first.withColumn("drow", F.reverse("word")), "drow", "backward")
    # two short words per range
    shared_borders = words.sparkSession.sparkContext.broadcast((borders, borders_back))

    def run(batches):
        ahead, back = shared_borders.value
        names = ("before", "after", "skipped", "counted", "id", "n")
        for b in batches:
            out = []
            for word, n, f, fp, i, drow, r, rp in zip(*(b[c] for c in ("word", "n", "forward", "forward_part", "id", "drow", "backward",
                                                                       "backward_part"))):
                out += [(*p, i, n) for p in pairs_of(word, ahead.settle(fp, word, f), back.settle(rp, drow, r))]
            if out:
                yield dict(zip(names, zip(*out)))

    return first.select("id", "word", "n"), map_columns(
        second, run, "before bigint, after bigint, skipped boolean, counted boolean, id bigint, n bigint")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of near words, and the most frequent one as (-n, id)."""
    me = F.struct((-F.col("n")).alias("m"), F.col("id").alias("id"))
    groups = pairs.groupBy("before", "after").agg(
        F.collect_list(F.when(F.col("skipped"), F.struct(me.alias("w"), "counted"))).alias("skips"),
        F.max(F.when(~F.col("skipped"), me)).alias("cut"))
    # at most one word per letter in skips, and one cut word: the pair spells it
    groups = groups.where(F.size("skips") + F.col("cut").isNotNull().cast("int") > 1)
    groups = groups.select(
        "cut", F.slice(F.array_sort(F.transform("skips", lambda x: x["w"])), 1, 2).alias("top"),
        F.size("skips").cast("bigint").alias("size"), F.size(F.filter("skips", lambda x: x["counted"])).cast("bigint").alias("longer"),
        F.explode(F.concat(F.transform("skips", lambda x: F.struct(x["w"].alias("w"), x["counted"].alias("counted"), F.lit(True).alias("skipped"))),
                           F.filter(F.array(F.struct(F.col("cut").alias("w"), F.lit(False).alias("counted"), F.lit(False).alias("skipped"))),
                                    lambda x: x["w"].isNotNull()))).alias("x"))
    has_cut = F.col("cut").isNotNull()
    first, second = F.get("top", F.lit(0)), F.get("top", F.lit(1))
    other = F.when(first["id"] != F.col("x.w.id"), first).otherwise(second)     # the most frequent other word of the skips
    rows = groups.select(
        F.col("x.w.id").alias("id"),
        F.when(F.col("x.skipped"), F.col("size") - 1 + (F.col("x.counted") & has_cut).cast("bigint")).otherwise(F.col("longer")).alias("n_near"),
        F.when(F.col("x.skipped"), F.least(other, F.col("cut"))).otherwise(first).alias("best"))
    return rows.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def group(words: DataFrame) -> DataFrame:
    """Per word of a (word, n) table: word, form, root, n, n_near, form_n.  Words
    are distinct and not null."""
    words, pairs = node_pairs(stored(words, "spelling-words"))
    near = neighbours(pairs)
    form = F.when(-F.col("best.m") >= TIMES * F.col("n"), F.col("best.id"))
    rows = stored(words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form_id")), "spelling-forms")
    # forms grow TIMES-fold in count, so chains are short; each round halves what is left of them
    steps = rows.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    while True:
        onward = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        joined = stored(steps.join(onward, "root_id", "left").select(
            "id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")), "spelling-roots")
        steps = joined.select("id", "root_id")
        if joined.where("moved").isEmpty():
            break
    words = rows.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = rows.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    out = rows.join(steps, "id", "left").join(words, "form_id", "left").join(roots, "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """``group`` over the words of the texts as they stand.  Edge cases as in ``report``."""
    return group(count_words(docs))


def report(docs: DataFrame) -> DataFrame:
    """Per word, after the contract's deletions: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; in a document without an id nothing is
    deleted.  Repeated rows are counted each.  A table without words gives no rows.  Other columns
    are not read."""
    return group(count_words(docs, alter=True))
