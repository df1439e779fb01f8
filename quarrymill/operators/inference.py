"""Models over columns: rows are repacked to the batches that a model or a service takes, whatever Arrow's batches are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import TOKEN
from quarrymill.operators.retrieval import _fnv

BATCH = 64  # fixed value: texts of one request
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Scorer = Callable[[str, list[str]], Sequence[float]]


def repacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order in batches of size rows, only the last one smaller; at most one batch and what came last are held."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - rows)
            held.append(part)
            rows, at = rows + part.num_rows, at + part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def embedded(rows: DataFrame, load: Callable[[], Embedder], text_col: str, size: int = BATCH, dim: int | None = None, out_col: str = "vector") -> DataFrame:
    """V2: rows with a vector for each text, by a model that is loaded once in a task and asked for up to size texts at a time.

    Null texts aren't asked for and have null vectors; texts stay in their order and partition. An answer with another number of vectors
    than texts, or with a vector of another length than dim (or than the task's first one), ends the job: its vectors can't be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, length = None, dim
        for batch in repacked(batches, size):
            texts = batch.column(text_col).to_pylist()
            asked = [k for k, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            if asked:
                model = model or load()
                answer = model([texts[k] for k in asked])
                if len(answer) != len(asked):
                    raise ValueError(f"{len(answer)} vectors for {len(asked)} texts")
                for k, v in zip(asked, answer, strict=True):
                    length = len(v) if length is None else length
                    if len(v) != length:
                        raise ValueError(f"a vector of {len(v)} components where there are {length}")
                    vectors[k] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{out_col}` array<double>")


def reranked(candidates: DataFrame, queries: DataFrame, load: Callable[[], Scorer], size: int = BATCH) -> DataFrame:
    """(query_id, id, score) of candidates (query_id, id, text, rank) by a model that scores up to size texts for one query (query_id, query) at a time.

    A query's candidates, a bounded list, come to one task in the order of their ranks, so that full batches are of one query; texts that
    are null count as empty. The number of scores is checked as in embedded.
    """
    asked = candidates.select("query_id", "id", F.coalesce("text", F.lit("")).alias("text"), "rank").join(queries.select("query_id", "query"), "query_id")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("query_id", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in _by_value(batches, "query_id", size):
            model = model or load()
            texts = batch.column("text").to_pylist()
            scores = model(batch.column("query")[0].as_py() or "", texts)
            if len(scores) != len(texts):
                raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array([float(x) for x in scores], pa.float64())], ["query_id", "id", "score"])

    dealt = asked.repartition("query_id").sortWithinPartitions("query_id", "rank", "id").select("query_id", "id", "text", "query")
    return dealt.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def _by_value(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a column in batches of up to size rows of one value each."""
    held: list[pa.RecordBatch] = []
    rows, value = 0, None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        values, at = batch.column(column).to_pylist(), 0
        while at < len(values):
            if rows and (rows == size or values[at] != value):
                yield whole()
                held, rows = [], 0
            value, end = values[at], at
            while end < len(values) and values[end] == value and rows + end - at < size:
                end += 1
            held.append(batch.slice(at, end - at))
            rows, at = rows + end - at, end
    if rows:
        yield whole()


def local_embedder(dim: int = 1024) -> Callable[[], Embedder]:
    """V1 as a model: the vectors of hash_embed_dense, with zeros where a text has no token of a bucket."""

    def load() -> Embedder:
        token, known = regex.compile(TOKEN), {}

        def embed(texts: list[str]) -> list[np.ndarray]:
            out = []
            for text in texts:
                counts: dict[str, int] = {}
                for t in token.findall(text):
                    t = t.lower()
                    counts[t] = counts.get(t, 0) + 1
                v = np.zeros(dim)
                for t, n in counts.items():
                    if t not in known:
                        known[t] = _fnv(t) % dim
                    v[known[t]] += 1 + np.log(n)
                out.append(v / (np.sqrt(v @ v) or 1.0))
            return out

        return embed

    return load


def local_scorer() -> Scorer:
    """A scorer without a model: the share of a query's distinct tokens that a text has."""
    token = regex.compile(TOKEN)
    words = lambda text: {t.lower() for t in token.findall(text)}

    def score(query: str, texts: list[str]) -> list[float]:
        own = words(query)
        return [len(own & words(t)) / max(1, len(own)) for t in texts]

    return score
