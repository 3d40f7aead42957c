"""Annotation by a caller's tagger: texts in, sentence rows with tokens out.

The library holds no tagger.  ``annotate`` takes a *factory*: a function without
arguments that loads a model and returns a callable ``texts -> documents``.
It is called once per worker process and name; the callable then gets bounded batches of texts and
returns, per text, its sentences in order::

    {"text": str, "tokens": [(text, pos, dep, head), ...], "ents": [(start, label), ...], "chunks": [start, ...]}

with heads, entity and noun chunk starts as token positions in the sentence.  The result has
one row per sentence and one error row (``error`` not null, no sentence) per text
that the model failed on or answered in another shape; no text is dropped and no
job is stopped by one text.

The table is meant to be written once as Parquet; readers then fetch only
the nested columns that they use.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = ("article_id bigint, sent_id bigint, text string, "
          "tokens array<struct<tok_id:bigint,text:string,pos:string,dep:string,head_id:bigint>>, "
          "ents array<struct<ent_id:string,label:string>>, chunks array<bigint>, error string")

READ_ROWS = 64          # rows of a batch that are Python objects at a time

Document = list[dict]
Annotator = Callable[[list[str]], list[Document]]

_loaded: dict[str, Annotator] = {}      # models of this worker process


def model_of(name: str, factory: Callable[[], Annotator]) -> Annotator:
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def tokens_ok(tokens) -> bool:
    """Are all (text, pos, dep, head), the head one of the tokens?  Read by columns."""
    if set(map(len, tokens)) != {4}:
        return False
    *strings, heads = zip(*tokens)
    return (all(set(map(type, c)) == {str} for c in strings) and set(map(type, heads)) == {int}
            and min(heads) >= 0 and max(heads) < len(tokens))


def problem(document) -> str | None:
    """What is wrong with an annotated document, or None."""
    if not isinstance(document, list):
        return "not a list of sentences"
    for i, s in enumerate(document):
        if not isinstance(s, dict) or not {"text", "tokens", "ents", "chunks"} <= s.keys() or not isinstance(s["text"], str):
            return f"sentence {i}: needs text, tokens, ents, chunks"
        n = len(s["tokens"])
        if n and not tokens_ok(s["tokens"]):
            return f"sentence {i}: a token needs text, pos, dep and a head among {n} tokens"
        if not all(len(e) == 2 and isinstance(e[1], str) and 0 <= e[0] < n for e in s["ents"]):
            return f"sentence {i}: an entity needs a start among {n} tokens and a label"
        if not all(isinstance(c, int) and 0 <= c < n for c in s["chunks"]):
            return f"sentence {i}: a chunk needs a start among {n} tokens"
    return None


def checked(documents: list) -> list[str | None]:
    """``problem`` of each document.  Documents without a fault are seen to be so by columns, all at once."""
    try:
        sound = all(type(d) is list for d in documents)
        sents = list(chain.from_iterable(documents)) if sound else []
        sound = sound and set(map(type, sents)) <= {dict} and all(type(s["text"]) is str and type(s["tokens"]) is list for s in sents)
        tokens = list(chain.from_iterable(s["tokens"] for s in sents)) if sound else []
        sound = sound and set(map(type, tokens)) <= {tuple} and set(map(len, tokens)) <= {4}
        if sound and tokens:
            *strings, heads = zip(*tokens)
            sizes = np.array([len(s["tokens"]) for s in sents])
            sound = all(set(map(type, c)) == {str} for c in strings) and set(map(type, heads)) == {int}
            sound = sound and bool((np.array(heads).view(np.uint64) < np.repeat(sizes, sizes).view(np.uint64)).all())
        if sound and all(_starts_ok(s, len(s["tokens"])) for s in sents):
            return [None] * len(documents)
    except Exception:  # noqa: BLE001 - whatever is wrong is found document by document
        pass
    return [problem(d) for d in documents]


def _starts_ok(sentence: dict, n: int) -> bool:
    return (all(len(e) == 2 and isinstance(e[1], str) and 0 <= e[0] < n for e in sentence["ents"])
            and all(isinstance(c, int) and 0 <= c < n for c in sentence["chunks"]))


def annotated_batch(model: Annotator, texts: list[str]) -> list[tuple[Document, str | None]]:
    """(document, error) per text; a batch that fails is tried text by text."""
    try:
        documents = model(texts)
        if len(documents) != len(texts):
            raise ValueError(f"{len(documents)} documents for {len(texts)} texts")
    except Exception as e:  # noqa: BLE001 - the caller's model may raise anything; the text keeps an error row
        if len(texts) == 1:
            return [([], f"{type(e).__name__}: {e}")]
        return [x for t in texts for x in annotated_batch(model, [t])]
    wrong = checked(documents)
    return [([] if w else d, w and f"bad annotation: {w}") for d, w in zip(documents, wrong)]


def lists(items: list[list], kind: pa.DataType, columns: list | None = None) -> pa.ListArray:
    """A list column from flat children."""
    offsets = pa.array([0, *accumulate(map(len, items))], type=pa.int32())
    if columns is None:
        return pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(items)), type=kind))
    children = [pa.array(c, type=kind.field(i).type) for i, c in enumerate(columns)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(children, fields=[kind.field(i) for i in range(kind.num_fields)]))


def rows_of(ids: list, results: list[tuple[Document, str | None]], schema: pa.Schema) -> pa.RecordBatch:
    flat = [(d, i, s, None) for d, (doc, error) in zip(ids, results) if not error for i, s in enumerate(doc)]
    flat += [(d, None, {"text": None, "tokens": [], "ents": [], "chunks": []}, error) for d, (_, error) in zip(ids, results) if error]
    sents = [s for _, _, s, _ in flat]
    tokens = [s["tokens"] for s in sents]
    # an empty document leaves no sentence, as an empty text does
    token_type, ent_type = schema.field("tokens").type.value_type, schema.field("ents").type.value_type
    every = list(zip(*chain.from_iterable(tokens))) or [()] * 4
    return pa.RecordBatch.from_arrays([
        pa.array([x[0] for x in flat], type=pa.int64()), pa.array([x[1] for x in flat], type=pa.int64()),
        pa.array([s["text"] for s in sents], type=pa.string()),
        lists(tokens, token_type, [list(chain.from_iterable(range(len(x)) for x in tokens)), *every]),
        lists([s["ents"] for s in sents], ent_type, [[f"{i}:{e[0]}" for _, i, s, _ in flat for e in s["ents"]],
                                                     [e[1] for s in sents for e in s["ents"]]]),
        lists([s["chunks"] for s in sents], pa.int64()), pa.array([x[3] for x in flat], type=pa.string())], schema=schema)


def annotate(docs: DataFrame, factory: Callable[[], Annotator], name: str, id_col: str = "doc_id", text_col: str = "text",
             batch_chars: int = 200_000, batch_texts: int = 256) -> DataFrame:
    """Sentence rows of ``docs`` (see the module).  ``name`` identifies the model in a
    worker process.  Null texts are read as empty; a batch ends after ``batch_texts`` texts
    or ``batch_chars`` characters, so a long text comes alone."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name, factory)
        # a batch is many small tuples without cycles; at the usual thresholds the collector walks them over and over
        gc.set_threshold(200_000, 20, 100)
        for b in batches:
            ids, texts, size = [], [], 0
            # Spark's batches hold thousands of texts: only a few at a time become Python objects
            for at in range(0, b.num_rows, READ_ROWS):
                part = b.slice(at, READ_ROWS)
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(d)
                    texts.append(t or "")
                    size += len(texts[-1])
                    if size >= batch_chars or len(texts) >= batch_texts:
                        yield rows_of(ids, annotated_batch(model, texts), schema)
                        ids, texts, size = [], [], 0
            if texts:
                yield rows_of(ids, annotated_batch(model, texts), schema)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def sentences(annotated: DataFrame) -> DataFrame:
    return annotated.where("error is null").select("article_id", "sent_id", "text")


def tokens(annotated: DataFrame) -> DataFrame:
    return annotated.where("error is null").select("article_id", "sent_id", F.inline("tokens"))


def token_field(annotated: DataFrame, field: str) -> DataFrame:
    """(article_id, field) per token; no other nested column is fetched."""
    return annotated.where("error is null").select("article_id", F.explode(f"tokens.{field}").alias(field))


def entities(annotated: DataFrame) -> DataFrame:
    return annotated.where("error is null").select("article_id", F.inline("ents"))


def chunks(annotated: DataFrame) -> DataFrame:
    return annotated.where("error is null").select("article_id", "sent_id", F.explode("chunks").alias("chunk_id"))


def errors(annotated: DataFrame) -> DataFrame:
    return annotated.where("error is not null").select("article_id", "error")
