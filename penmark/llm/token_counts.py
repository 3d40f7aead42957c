"""Token counts (operator 9): prefix dynamic programming over a BPE vocabulary.

The tokenizer is a sentencepiece BPE model with byte fallback.  For such a
model the last token of every prefix's encoding follows from shorter prefixes:
a token sequence is the model's encoding exactly when each adjacent pair is
the encoding of its own concatenation.  So the last token of prefix ``i`` is
the one vocabulary piece ``t`` ending at ``i`` that is compatible with the last
token of prefix ``i - len(t)``, and ``count[i] = count[i - len(t)] + 1``.  One
left-to-right pass yields the exact token count of *every* prefix; truncation
and budget questions are then lookups, with no re-encoding.

The counts are stored as one signed byte per code point (the change from one
prefix to the next), about the size of the text itself.

Two characters that are adjacent inside no piece are a hard cut: the encodings
left and right of it are independent, so the table of a text is the
concatenation of the tables of its segments and repeated segments are
computed once per worker (bounded cache, values never depend on it).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.common import map_columns

SPACE = "▁"      # the model's mark for a space
DEFAULT_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


class PrefixCounter:
    """Exact token counts of all prefixes under one sentencepiece BPE model."""

    def __init__(self, model_path: str, cache_limit: int = 1_200_000):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        for i in range(sp.vocab_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            if sp.is_unused(i):
                raise ValueError("models with unused pieces need resegmentation, which is not supported")
            self.rank[sp.id_to_piece(i)] = -sp.get_score(i)
        self.joined = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        if sp.encode("a", out_type=str)[0][:1] != SPACE or any(b == SPACE != a for a, b in self.joined):
            raise ValueError("expected a model with a leading space mark that never ends up inside a piece")
        # pieces that the model produces at all, by their characters from the last to the first
        self.pieces: list[str] = [""]
        self.trie: dict = {}
        for p in self.rank:
            if self._merge(p) == [p]:
                node = self.trie
                for ch in reversed(p):
                    node = node.setdefault(ch, {})
                node[""] = len(self.pieces)
                self.pieces.append(p)
        self.pairs: dict[int, bool] = {}
        self.segments: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.limit = cache_limit

    def _merge(self, s: str) -> list[str]:
        """Greedy merging of a short string: best-ranked pair first, leftmost on ties."""
        parts = list(s)
        rank = self.rank
        while len(parts) > 1:
            scored = [(rank[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in rank]
            if not scored:
                break
            i = min(scored)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, key: int) -> bool:
        a, b = self.pieces[key >> 20], self.pieces[key & 0xFFFFF]
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        ok = self.pairs[key] = a[-1] + b[0] not in self.joined or self._merge(a + b) == [a, b]
        return ok

    def _extend(self, s: str, last: list[int], count: list[int]) -> None:
        """Carry the table on over the characters of ``s`` it doesn't hold yet."""
        trie, pairs = self.trie, self.pairs
        for i in range(len(last), len(s) + 1):
            node, j, token, start = trie, i, 0, i - 1
            while j:
                node = node.get(s[j - 1])
                if node is None:
                    break
                j -= 1
                t = node.get("")
                if t is not None:
                    before = last[j]
                    if before:
                        key = before << 20 | t
                        ok = pairs.get(key)
                        if ok is None:
                            ok = self._compatible(key)
                        if ok:
                            token, start = t, j
                            break
                    else:
                        token, start = t, j
            # a character outside the vocabulary falls back to its bytes
            last.append(token)
            count.append(count[start] + (1 if token else len(s[i - 1].encode())))

    @staticmethod
    def _changes(count: list[int]) -> bytes:
        return bytes([(b - a) & 0xFF for a, b in pairwise(count)])

    def segment(self, s: str) -> bytes:
        """Changes of the token count along one segment without hard cuts."""
        hit = self.segments.get(s)
        if hit is not None:
            return hit
        last, count = [0], [0]     # last token of each prefix; 0: none, or a character outside the vocabulary
        self._extend(s, last, count)
        done = self._changes(count)
        if len(s) <= 64:
            if len(self.segments) > self.limit:
                self.segments.clear()
            self.segments[s] = done
        return done

    def chunk(self, s: str) -> bytes:
        """Changes along any marked string: its segments between hard cuts, in turn."""
        joined = self.joined
        out, start = [], 0
        for i in range(1, len(s)):
            if s[i - 1:i + 1] not in joined:
                out.append(self.segment(s[start:i]))
                start = i
        out.append(self.segment(s[start:]))
        return b"".join(out)

    def learn(self, words: Iterable[str]) -> None:
        """Tables of the given space-preceded words that the cache lacks.  In
        sorted order a word carries on the table of the prefix it shares with
        the word before it."""
        chunks, joined, alpha = self.chunks, self.joined, str.isalpha
        missing = set(words).difference(chunks)
        bare = {w for w in missing if alpha(w)}
        ended = {w for w in missing.difference(bare)
                 if w[-1] in ",." and alpha(w[:-1]) and w[-2:] not in joined}
        bare.update({w[:-1] for w in ended}.difference(chunks))
        previous, last, count = "", [0], [0]
        for w in sorted(bare):
            s = SPACE + w
            same = 0
            for x, y in zip(s, previous):
                if x != y:
                    break
                same += 1
            del last[same + 1:], count[same + 1:]
            if all(s[i:i + 2] in joined for i in range(max(same - 1, 0), len(s) - 1)):
                self._extend(s, last, count)
                chunks[w] = self._changes(count)
                previous = s
            else:
                chunks[w] = self.chunk(s)
                previous, last, count = "", [0], [0]
        for w in ended:
            chunks[w] = chunks[w[:-1]] + self.segment(w[-1])
        for w in missing.difference(bare, ended):
            chunks[w] = self.chunk(SPACE + w)

    def prefix_changes(self, texts: list[str | None]) -> list[bytes]:
        """Per text, one signed byte per code point; the running sum at
        position i is the exact token count of ``text[:i + 1]``."""
        chunks = self.chunks
        if len(chunks) > self.limit:
            chunks.clear()
        split = [t.split(" ") if t and "  " not in t and t[0] != " " != t[-1] and SPACE not in t else None
                 for t in texts]
        words = set().union(*(p for p in split if p))
        self.learn(words)
        out = []
        for t, parts in zip(texts, split):
            if not t:
                out.append(b"")
                continue
            c = b"".join(map(chunks.__getitem__, parts)) if parts else self.chunk(SPACE + t.replace(" ", SPACE))
            # the leading mark has no position of its own: its count joins the first character's
            out.append(((c[0] + c[1]) & 0xFF).to_bytes(1, "little") + c[2:])
        for w in words:
            if len(w) > 64:
                chunks.pop(w, None)
        return out


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def batched(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of about ``size`` characters (at least one text each)."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def counts_at(changes: bytes) -> np.ndarray:
    """Token counts of all non-empty prefixes."""
    return np.cumsum(np.frombuffer(changes, dtype=np.int8), dtype=np.int64)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix whose token count is within budget."""
    if len(counts) == 0 or counts[-1] <= budget:
        return len(counts)
    ok = np.flatnonzero(counts <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def model_path(name: str = DEFAULT_MODEL) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT,
                 model: str | None = None, keep_prefixes: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``
    (n_tokens > limit), ``fit_chars`` (code points of the longest prefix of at
    most ``limit`` tokens) and, if asked for, ``prefix_changes``.

    ``model`` is the name of a tokenizer file (resolved on each worker) or None
    for the default.  Null and empty texts have 0 bytes and 0 tokens; repeated
    rows are counted each; a null id stays null; an empty table gives no rows.
    The work is map-only: no shuffle, one text in memory at a time per worker
    beside its Arrow batch."""
    name = model or DEFAULT_MODEL

    def run(batches):
        c = counter(model_path(name))
        for b in batches:
            out = {"id": b["id"], "n_bytes": [], "n_tokens": [], "over_limit": [], "fit_chars": []}
            if keep_prefixes:
                out["prefix_changes"] = []
            tables = (x for i, j in batched(b["text"]) for x in c.prefix_changes(b["text"][i:j]))
            for t, changes in zip(b["text"], tables):
                n = int(np.frombuffer(changes, dtype=np.int8).sum(dtype=np.int64))
                out["n_bytes"].append(len(t.encode()) if t else 0)
                out["n_tokens"].append(n)
                out["over_limit"].append(n > limit)
                out["fit_chars"].append(len(changes) if n <= limit else longest_prefix(counts_at(changes), limit))
                if keep_prefixes:
                    out["prefix_changes"].append(changes)
            yield out

    schema = "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    if keep_prefixes:
        schema += ", prefix_changes binary"
    rows = map_columns(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run, schema)
    return rows.withColumnRenamed("id", id_col)


def tokens_of_prefix(changes: Column, n_chars: Column) -> Column:
    """Exact token count of the first ``n_chars`` code points, from the stored
    table alone (SQL functions, no tokenizer)."""
    part = F.hex(F.substring(changes, F.lit(1), F.least(n_chars, F.length(changes)).cast("int")))
    value = lambda i: F.conv(F.substring(part, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    steps = F.when(F.length(part) > 0, F.sequence(F.lit(0), (F.length(part) / 2 - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("bigint"),
                       lambda acc, i: acc + F.when(value(i) > 127, value(i) - 256).otherwise(value(i)))


def truncate_to(df: DataFrame, budgets: list[int], id_col: str = "doc_id",
                changes_col: str = "prefix_changes") -> DataFrame:
    """For each row of a stored prefix table and each budget: the longest
    prefix (code points) within it and that prefix's exact token count."""
    def run(batches):
        for b in batches:
            out = {"id": [], "budget": [], "n_chars": [], "n_tokens": []}
            for i, ch in zip(b["id"], b["changes"]):
                counts = counts_at(ch or b"")
                for k in budgets:
                    n = longest_prefix(counts, k)
                    out["id"].append(i)
                    out["budget"].append(k)
                    out["n_chars"].append(n)
                    out["n_tokens"].append(int(counts[n - 1]) if n else 0)
            yield out

    rows = map_columns(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(changes_col).alias("changes")), run,
                       "id bigint, budget bigint, n_chars bigint, n_tokens bigint")
    return rows.withColumnRenamed("id", id_col)
