"""Syntax features (Y1-Y12) aggregated from annotated sentences.

A tagger/parser is not part of this library (none is installed, and a per-row
model is not a Spark operator); ``annotate`` runs a caller's tagger, and the features are
aggregates over its sentence rows (or over tables of sentences, tokens, entities and
chunks that a tagger left elsewhere, see ``from_tables``).  ``standin`` is a fixed
rule for tests, not a parser.

Plan: whatever belongs to one sentence is computed from its row's arrays, map-side;
one shuffle by article with partial aggregation is left.  Dependency depth follows
head pointers inside one sentence by pointer doubling (n log n for n tokens), over
the arrays of a batch at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.functions import text as T
from penmark.functions.lexicons import SYNTAX_FEATURES
from penmark.operators import annotate, standin


def annotate_standin(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence rows by the stand-in rule."""
    return annotate.annotate(docs, standin.annotator, "standin", id_col, text_col)


def from_tables(sents: DataFrame, tokens: DataFrame, ents: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Sentence rows from tables: sentences(article_id, sent_id, text), tokens(article_id,
    sent_id, tok_id, text, pos, dep, head_id), ents(article_id, sent_id, ent_id, label),
    chunks(article_id, sent_id, chunk_id).  One group is one sentence."""
    key = ["article_id", "sent_id"]
    out = sents.join(tokens.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("tok_id", "text", "pos", "dep", "head_id"))).alias("tokens")),
                     key, "left")
    empty = {"tokens": "array<struct<tok_id:bigint,text:string,pos:string,dep:string,head_id:bigint>>",
             "ents": "array<struct<ent_id:string,label:string>>", "chunks": "array<bigint>"}
    for table, name, item in ((ents, "ents", F.struct("ent_id", "label")), (chunks, "chunks", F.col("chunk_id"))):
        part = table.groupBy(*key).agg(F.collect_list(item).alias(name)) if table is not None else None
        out = out.join(part, key, "left") if part is not None else out.withColumn(name, F.lit(None).cast(empty[name]))
    return out.select(*key, "text", *[F.coalesce(F.col(c).cast(t), F.array().cast(t)).alias(c) for c, t in empty.items()],
                      F.lit(None).cast("string").alias("error"))


def _shares(rows: DataFrame, tag_col: str) -> DataFrame:
    """(article_id, tag, freq) of rows (article_id, tag): counted by article and tag, the few counts
    of an article are its total; rows are read once and never joined with themselves."""
    per = rows.where("article_id is not null").groupBy("article_id", F.col(tag_col).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    one = per.groupBy("article_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct("tag", "n")).alias("tags"))
    return one.select("article_id", "total", F.inline("tags")).select("article_id", "tag", (F.col("n") / F.col("total")).alias("freq"))


def tag_frequencies(tokens: DataFrame, tag_col: str) -> DataFrame:
    """(article_id, tag, freq) = tag count / token count; only tags
    seen in the article appear (absent = missing, not 0)."""
    return _shares(tokens, tag_col)


def entity_frequencies(ents: DataFrame) -> DataFrame:
    """Label count / number of entities of the article."""
    return _shares(ents, "label")


RATIOS = ["verb_noun_ratio", "adj_adv_ratio", "passive_voice_freq"]
SENTENCE_FEATURES = ["question_freq", "complex_sentence_ratio", "compound_sentence_ratio", "avg_dependency_depth", "avg_sentence_complexity"]


# per sentence: tokens with one of these tags, by their field
COUNTED = {"verb_noun_ratio": [("pos", ("VERB", "AUX")), ("pos", ("NOUN", "PROPN"))], "adj_adv_ratio": [("pos", ("ADJ",)), ("pos", ("ADV",))],
           "passive_voice_freq": [("dep", ("auxpass", "nsubjpass"))], "complex_sentence_ratio": [("dep", ("mark",))], "compound_sentence_ratio": [("dep", ("cc",))]}
FLAGS = ("mark", "cc")
NO_DEPTH = -(1 << 40)


def depths_of(size, up, dist):
    """Edges from every token to the root of its sentence, for sentences of ``size`` tokens one after the other: ``up`` has the
    heads' places in the sentence (-1: unknown), ``dist`` 1 or, for a root, 0.  Every round of a sentence replaces
    the ancestors by their ancestors and adds the distances, so log2(n) rounds reach every root.  Negative where a
    head on the way is unknown."""
    import numpy as np
    start = np.repeat(np.cumsum(size) - size, size)
    n = len(up)
    if n and ((up < -1) | (up >= np.repeat(size, size))).any():
        raise ValueError("a head is not among its sentence's tokens")
    up = np.append(np.where(up < 0, n, up + start), n)
    dist = np.append(np.where(up[:n] == n, NO_DEPTH, dist), NO_DEPTH)
    rounds = np.repeat(np.maximum(1, np.ceil(np.log2(np.maximum(1, size)))).astype(np.int64), size)
    live, k = np.arange(n), 0
    while len(live):
        dist[live], up[live] = dist[live] + dist[up[live]], up[up[live]]
        k += 1
        live = live[rounds[live] > k]
    return dist[:n]


def _sentence_facts(s: DataFrame, wanted: list[str]) -> DataFrame:
    """Per sentence: the tag counts and flags of the wanted features, the number of tokens, and Y8 as ``max_depth``: max over tokens of
    ROOT 0, otherwise 1 + edges to the self-headed root.  ``head_id`` is a 0-based position in the sentence.  Tags are counted by
    array functions and the heads of a batch followed as columns; lambdas made every token an object several times over."""
    def count(field: str, tags: tuple):
        if tags[0] in FLAGS:
            return F.array_contains(f"tokens.{field}", tags[0]).cast("bigint")
        a = F.col(f"tokens.{field}")
        return sum((F.size(a) - F.size(F.array_remove(a, t)) for t in tags), F.lit(0)).cast("bigint")

    facts = {"article_id": F.col("article_id")} | {f"__n{i}": count(*x) for i, x in enumerate(x for w in wanted for x in COUNTED.get(w, []))}
    if "question_freq" in wanted:
        facts["__question"] = _asks().cast("int")
    if "avg_sentence_complexity" in wanted:
        facts["__chunks"] = F.size("chunks")
    kept = list(facts)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in batches:
            size = pc.list_value_length(b.column("head_id")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            root, head, tok = (b.column(c).flatten() for c in ("root", "head_id", "tok_id"))
            up = head.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            if head.null_count and (up[head.is_valid().to_numpy(zero_copy_only=False)] < 0).any():
                raise ValueError("a head is not among its sentence's tokens")
            dist = (up != tok.fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64)
            if tok.null_count:
                dist[tok.is_null().to_numpy(zero_copy_only=False)] = NO_DEPTH
            depth = depths_of(size, up, dist) + 1
            depth[root.fill_null(False).to_numpy(zero_copy_only=False)] = 0
            most, some = np.full(b.num_rows, -1, dtype=np.int64), size > 0
            if some.any():
                most[some] = np.maximum.reduceat(depth, (np.cumsum(size) - size)[some])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(size), pa.array(most, mask=most < 0)], names=[*kept, "__tokens", "max_depth"])

    x = s.select(*[v.alias(c) for c, v in facts.items()], F.transform("tokens.dep", lambda d: d == "ROOT").alias("root"),
                 F.col("tokens.head_id").alias("head_id"), F.col("tokens.tok_id").alias("tok_id"))
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in kept)
    return x.mapInArrow(run, f"{kinds}, __tokens bigint, max_depth bigint")


def article_features(annotated: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted ones of ``RATIOS`` and ``SENTENCE_FEATURES`` per article (Y4-Y9):
    flags and counts per sentence row, then one aggregation by article.  Only the
    nested columns that the wanted features read are fetched.  ``n_tokens`` is added."""
    s = annotated.where("error is null")
    n, order = F.count(F.lit(1)), [x for w in wanted for x in COUNTED.get(w, [])]
    if "avg_dependency_depth" in wanted:
        s = _sentence_facts(s, wanted)
        tokens, question, chunks = F.col("__tokens"), F.col("__question"), F.col("__chunks")
        count = lambda field, *tags: F.col(f"__n{order.index((field, tags))}")
        flag = count
    else:
        tokens, question, chunks = F.size("tokens"), _asks().cast("int"), F.size("chunks")
        count = lambda field, *tags: F.size(F.filter("tokens", lambda t: t[field].isin(*tags)))
        flag = lambda field, tag: F.exists("tokens", lambda t: t[field] == tag).cast("int")
    tagged = lambda field, *tags: F.sum(count(field, *tags))
    share = lambda yes: F.sum(yes) / F.greatest(F.lit(1), n)
    features = {
        "verb_noun_ratio": lambda: tagged("pos", "VERB", "AUX") / F.greatest(F.lit(1), tagged("pos", "NOUN", "PROPN")),
        "adj_adv_ratio": lambda: tagged("pos", "ADJ") / F.greatest(F.lit(1), tagged("pos", "ADV")),
        "passive_voice_freq": lambda: tagged("dep", "auxpass", "nsubjpass") / F.greatest(F.lit(1), F.sum(tokens)),
        "question_freq": lambda: share(question),
        "complex_sentence_ratio": lambda: share(flag("dep", "mark")),
        "compound_sentence_ratio": lambda: share(flag("dep", "cc")),
        "avg_dependency_depth": lambda: F.sum(F.coalesce("max_depth", F.lit(0))) / F.greatest(F.lit(1), n),
        "avg_sentence_complexity": lambda: F.sum(chunks) / n,
    }
    return s.groupBy("article_id").agg(*[features[c]().alias(c) for c in wanted], F.sum(tokens).alias("n_tokens"))


def _asks(text: str = "text"):
    """Does the stripped text end in a question mark?  Only texts that have one are stripped."""
    return F.col(text).contains("?") & T.strip_ws(F.col(text)).endswith("?")


def token_ratios(annotated: DataFrame) -> DataFrame:
    """Y4 + Y5 of the articles that have tokens."""
    return article_features(annotated, RATIOS).where("n_tokens > 0").drop("n_tokens")


def sentence_features(annotated: DataFrame, wanted: list[str] = SENTENCE_FEATURES) -> DataFrame:
    """Y6, Y7, Y8, Y9 of the articles that have sentences."""
    return article_features(annotated, wanted).drop("n_tokens")


def syntax_features(articles: DataFrame, annotated: DataFrame, id_col: str = "article_id") -> DataFrame:
    """The seven fixed syntax features per article (Y4-Y8, Y10: an article
    without tokens gets seven zeros)."""
    f = article_features(annotated, SYNTAX_FEATURES)
    j = articles.select(F.col(id_col).alias("article_id")).join(f, "article_id", "left")
    return j.select("article_id", *[F.when(F.col("n_tokens") > 0, F.col(c)).otherwise(F.lit(0.0)).cast("double").alias(c)
                                    for c in SYNTAX_FEATURES])


def tag_tables(annotated: DataFrame) -> dict[str, DataFrame]:
    """The long tag frequencies of an annotation by family."""
    return {"pos": tag_frequencies(annotate.token_field(annotated, "pos"), "pos"),
            "dep": tag_frequencies(annotate.token_field(annotated, "dep"), "dep"),
            "ent": entity_frequencies(annotate.entities(annotated))}


def wide_tags(rows: DataFrame, tag_col: str, prefix: str, suffix: str, tags: list[str]) -> DataFrame:
    """One row per article of the rows (article_id, tag): the share of each listed tag as a column
    ``{prefix}{tag}{suffix}`` (absent = NULL).  One aggregation with a counter per tag."""
    n = [F.count_if(F.col(tag_col) == t).alias(f"__{i}") for i, t in enumerate(tags)]
    counted = rows.where("article_id is not null").groupBy("article_id").agg(F.count(F.lit(1)).alias("__n"), *n)
    return counted.select("article_id", *[F.when(F.col(f"__{i}") > 0, F.col(f"__{i}") / F.col("__n")).alias(f"{prefix}{t}{suffix}")
                                          for i, t in enumerate(tags)])
