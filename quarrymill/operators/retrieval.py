"""Embedding, recall, fusion, re-ranking and the evaluation of retrieval, for all queries of a table at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions.text import fnv1a, tokens
from quarrymill.sources.shared import stored

SPARSE_DIM = 65_536
BM25_K1, BM25_B = 1.5, 0.75
RRF_K, RRF_WEIGHTS = 60, (0.5, 0.5)
PASS_QUERIES, PASS_ENTRIES = 4_096, 1 << 22  # queries of one pass over the points, and their components
STEP_CELLS = 1 << 22
MERGE_PARTS = 256
KNOWN_TOKENS = 1_000_000
WHITE = r"\s+"


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, tf), tokens in lower case."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.transform(tokens(F.col(text_col)), F.lower)).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))


def hash_embed_sparse(docs: DataFrame, id_col: str, text_col: str, dim: int = SPARSE_DIM) -> DataFrame:
    """V1, sparse: (id, idx, w), the term counts by hash bucket as postings."""
    return token_counts(docs, id_col, text_col).groupBy("id", (fnv1a(F.col("token")) % dim).alias("idx")).agg(F.sum("tf").alias("w"))


def hash_embed_dense(docs: DataFrame, id_col: str, text_col: str, dim: int = 1024) -> DataFrame:
    """V1, dense: (id, idx, w), 1 + ln(tf) by hash bucket over the vector's length; a row for each component that isn't zero."""
    parts = token_counts(docs, id_col, text_col).groupBy("id", (fnv1a(F.col("token")) % dim).alias("idx")).agg(F.sum(1 + F.log("tf")).alias("v"))
    # A window over one vector's components, so that the tokens are counted once.
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return parts.select("id", "idx", (F.col("v") / length).alias("w"))


def ranked(scored: DataFrame, k: int | None, score: str = "score", id_col: str = "id", query: str = "query_id") -> DataFrame:
    """Rank from 1 within a query by score down, ties (at nine digits) to the smaller id; the first k, or all."""
    order = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), id_col)
    out = scored.withColumn("rank", F.row_number().over(order).cast("int"))
    return out if k is None else out.where(F.col("rank") <= k)


def hash_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int, dense: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """V1 with a row for each text: (id, idx, w) and the columns to keep, the components of hash_embed_dense or hash_embed_sparse as arrays by index, both empty for a text without tokens. Texts stay where they are: nothing is shuffled, and a token is hashed once in a task."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            toks = batch.column("toks")
            flat = toks.flatten().dictionary_encode()
            names = flat.dictionary.to_pylist()
            if len(known) > KNOWN_TOKENS:
                known.clear()
            for t in names:
                if t not in known:
                    known[t] = _fnv(t)
            bucket = np.array([known[t] % dim for t in names], dtype=np.int64)
            row = np.repeat(np.arange(len(toks)), pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False))
            cell, tf = np.unique(row * max(1, len(names)) + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            row, code = np.divmod(cell, max(1, len(names)))
            at, back = np.unique(row * dim + bucket[code], return_inverse=True)
            w = np.bincount(back, 1 + np.log(tf) if dense else tf, len(at)).astype(float)
            row, idx = np.divmod(at, dim)
            if dense:
                w /= np.sqrt(np.bincount(row, w * w, len(toks)))[row]
            ends = pa.array(np.searchsorted(row, np.arange(len(toks) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(idx)), pa.ListArray.from_arrays(ends, pa.array(w)), *(batch.column(c) for c in keep)], ["id", "idx", "w", *keep])

    rows = docs.select(F.col(id_col).alias("id"), F.transform(tokens(F.col(text_col)), F.lower).alias("toks"), *keep)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *keep)]
    return rows.mapInArrow(embed, ", ".join([kinds[0], "idx array<long>", "w array<double>", *kinds[1:]]))


def _fnv(token: str) -> int:
    h = 2166136261
    for c in token:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def _recall(queries: DataFrame, size: Column, points: DataFrame, k: int | str | None, threshold: float | None, skip_self: bool, prepare: Callable, scores: Callable) -> DataFrame:
    """(query_id, id, score, rank) of queries against all points, brute force.

    Queries, a stated set, are dealt to passes of a bounded number of queries and components. A pass goes to all executors, where each task
    scores its points by blocks of arrays and keeps k per query (a number, or a column of queries); the tasks' lists are merged in parts, then by
    query. So points are never shuffled for their scores, common terms make no hot key, and no pair leaves a task but what may be among the best.
    Without k, all pairs at the threshold come. Where more than one pass is needed, the points are written once, and each pass writes its lists
    before the next one's queries are sent. See FILTERS for the columns that hold queries to some of the points.
    """
    n, entries = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    passes = max(1, -(-n // PASS_QUERIES), -(-entries // PASS_ENTRIES))
    kinds = queries.schema["query_id"].dataType.simpleString(), points.schema["id"].dataType.simpleString()
    points = stored(points) if passes > 1 else points
    lists = None
    for i in range(passes):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toPandas()
        most = None if k is None else asked[k].to_numpy(dtype=np.int64) if isinstance(k, str) else np.full(len(asked), k)
        floor = np.full(len(asked), -np.inf if threshold is None else threshold)
        if "threshold" in asked:
            floor = np.maximum(floor, asked["threshold"].astype(float).fillna(-np.inf).to_numpy())
        held = points.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), most, floor, _filters(asked), prepare(asked)))
        part = points.mapInPandas(_scan(held, skip_self, scores), f"part int, query_id {kinds[0]}, id {kinds[1]}, score double, k long")
        if k is not None:
            order = Window.partitionBy("query_id", "part").orderBy(F.round("score", 9).desc(), "id")
            part = part.withColumn("at", F.row_number().over(order)).where("at <= k").drop("at")
        if passes > 1:
            part = stored(part)
            held.destroy()
        lists = part if lists is None else lists.unionByName(part)
    out = ranked(lists.drop("part"), None)
    return (out if k is None else out.where("rank <= k")).drop("k")


# Columns of queries that hold them to points: doc_ids (any of these in the points' doc_id; null or empty for all), and page_from and page_to (points whose own pages overlap; null for all).
FILTERS = ("doc_ids", "page_from", "page_to")


def _filters(asked: pd.DataFrame) -> list[tuple[np.ndarray, tuple]]:
    """(queries, filter) for each different filter but none."""
    if not set(FILTERS) <= set(asked.columns):
        return []
    of: dict[tuple, list[int]] = {}
    for i, (ids, low, high) in enumerate(zip(*(asked[c] for c in FILTERS), strict=True)):
        ids = frozenset() if ids is None or not len(ids) else frozenset(ids)
        pages = () if pd.isna(low) or pd.isna(high) else (low, high)
        if ids or pages:
            of.setdefault((ids, pages), []).append(i)
    return [(np.array(rows), key) for key, rows in of.items()]


def _scan(held, skip_self: bool, scores: Callable) -> Callable:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, most, floor, filters, data = held.value
        part = TaskContext.get().partitionId() % MERGE_PARTS
        floors = floor.copy()
        best = pd.DataFrame({"q": np.empty(0, np.int64), "id": [], "score": np.empty(0)})
        k_of = lambda q: most[q] if most is not None else np.zeros(len(q), np.int64)
        out = lambda df: pd.DataFrame({"part": part, "query_id": names[df["q"].to_numpy()], "id": df["id"].to_numpy(), "score": df["score"].to_numpy(), "k": k_of(df["q"].to_numpy())})
        for batch in batches:
            for points, block in scores(data, batch):
                for asks, (ids, pages) in filters:
                    fits = np.ones(len(points), dtype=bool)
                    if ids:
                        fits &= points["doc_id"].isin(ids).to_numpy()
                    if pages:
                        fits &= ((points["page_from"] <= pages[1]) & (points["page_to"] >= pages[0])).to_numpy(dtype=bool)
                    block[np.ix_(~fits, asks)] = np.nan
                row, q = np.nonzero((block >= floor) & (np.round(block, 9) >= np.round(floors, 9)))
                some = pd.DataFrame({"q": q, "id": points["id"].to_numpy()[row], "score": block[row, q]})
                if skip_self:
                    some = some[some["id"].to_numpy() != names[some["q"].to_numpy()]]
                if most is None:
                    yield out(some)
                elif len(some):
                    both = (pd.concat([best, some]) if len(best) else some).assign(at=lambda x: x["score"].round(9))
                    both = both.sort_values(["q", "at", "id"], ascending=[True, False, True], kind="stable")
                    best = both[both.groupby("q").cumcount().to_numpy() < most[both["q"].to_numpy()]].drop(columns="at")
                    full = best.groupby("q")["score"].agg(["size", "min"])
                    full = full[full["size"].to_numpy() == most[full.index.to_numpy()]]
                    floors[full.index.to_numpy()] = np.maximum(floor[full.index.to_numpy()], full["min"].to_numpy())
        if len(best):
            yield out(best)

    return scan


def postings_topk(queries: DataFrame, points: DataFrame, k: int | str) -> DataFrame:
    """(query_id, id, score, rank) by inner product of sparse vectors, queries (query_id, idx, w, ...) against points (id, idx, w, ...), both with a row for each vector; points that share no index with a query don't come. k is a number or a column of queries; see FILTERS for what else queries may ask."""

    def prepare(asked: pd.DataFrame) -> tuple:
        sizes = asked["idx"].map(len).to_numpy(dtype=np.int64)
        idx = np.concatenate([*asked["idx"], np.empty(0)]).astype(np.int64)
        order = np.argsort(idx, kind="stable")
        terms, first = np.unique(idx[order], return_index=True)
        return terms, np.append(first, len(idx)), np.repeat(np.arange(len(asked)), sizes)[order], np.concatenate([*asked["w"], np.empty(0)]).astype(float)[order], len(asked)

    def scores(held: tuple, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        terms, first, asks, weights, n = held
        step = max(1, STEP_CELLS // max(1, len(asks)))
        for at in range(0, len(batch) if len(terms) else 0, step):
            some = batch.iloc[at : at + step]
            idx, w = np.concatenate([*some["idx"]]).astype(np.int64), np.concatenate([*some["w"]]).astype(float)
            row = np.repeat(np.arange(len(some)), some["idx"].map(len))
            term = np.minimum(np.searchsorted(terms, idx), len(terms) - 1)
            known = terms[term] == idx
            row, w, term = row[known], w[known], term[known]
            meets = first[term + 1] - first[term]
            posting = np.arange(meets.sum()) + np.repeat(first[term] - (np.cumsum(meets) - meets), meets)
            cell = np.repeat(row, meets) * n + asks[posting]
            block = np.bincount(cell, np.repeat(w, meets) * weights[posting], len(some) * n).astype(float)
            block[np.bincount(cell, minlength=len(block)) == 0] = np.nan
            yield some, block.reshape(len(some), n)

    return _recall(queries, F.size("idx"), points, k, None, False, prepare, scores)


def dense_topk(queries: DataFrame, points: DataFrame, k: int | None, threshold: float | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank) by cosine of unit vectors, every query (query_id, qv) against every point (id, v).

    Brute force, as the reference's index is by default, by matrix products. Without k, all that reach the threshold come. Null vectors, those
    with null components, and pairs of different lengths take no part.
    """

    def prepare(asked: pd.DataFrame) -> dict:
        sizes = asked["qv"].map(len)
        return {d: (np.flatnonzero(sizes == d), np.stack([*asked["qv"][sizes == d]]).astype(float)) for d in sizes.unique()} | {None: len(asked)}

    def scores(held: dict, batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        n = held[None]
        for d, same in batch.groupby(batch["v"].map(len)):
            if d in held:
                step = max(1, STEP_CELLS // max(n, d))
                for at in range(0, len(same), step):
                    some = same.iloc[at : at + step]
                    block = np.full((len(some), n), np.nan)
                    block[:, held[d][0]] = np.stack([*some["v"]]).astype(float) @ held[d][1].T
                    yield some, block

    return _recall(queries.where("qv is not null").select("query_id", "qv"), F.size("qv"), points.where("v is not null").select("id", "v"), k, threshold, skip_self, prepare, scores)


def contained(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, id): documents (id, text) that hold the whole text of a question (query_id, query).

    The words within a question, its first and last aside, are whole words of any text that holds it, so the two join on the longest pair of
    adjacent ones (the middle word of three), and then texts are compared. Questions of one or two words, if there are any, are looked for in every text.
    """
    words = F.filter(F.split("query", WHITE), lambda w: w != "")
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), F.size("inner") - 2), lambda i: F.concat_ws(" ", F.get("inner", i), F.get("inner", i + 1)))
    longest = F.array_max(F.transform(pairs, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    asked = questions.withColumn("words", words).withColumn("inner", inner).withColumn("key", F.when(F.size("inner") >= 2, longest).otherwise(F.get("inner", F.lit(0))))
    keyed = asked.where("key IS NOT NULL").select("query_id", "query", "key")
    own = F.filter(F.split("text", WHITE), lambda w: w != "")
    two = F.transform("own", lambda w, i: F.concat_ws(" ", w, F.get("own", i + 1)))
    keys = docs.withColumn("own", own).select("id", "text", F.explode(F.array_distinct(F.array_union("own", two))).alias("key"))
    found = keys.join(keyed, "key").where(F.contains("text", F.col("query"))).select("query_id", "id")
    short = asked.where("key IS NULL AND query <> ''").select("query_id", "query")
    if short.limit(1).count():
        found = found.unionByName(docs.join(short, F.contains("text", F.col("query"))).select("query_id", "id"))
    return found


def filter_column(spec: dict) -> Column:
    """P10: a filter of must, should and must_not conditions on fields (match value or any, range gte lte gt lt) as one Column."""

    def one(condition: dict) -> Column:
        field = F.col(condition["key"])
        if "match" in condition:
            match = condition["match"]
            return field.isin(*match["any"]) if "any" in match else field == F.lit(match["value"])
        of = {"gte": lambda v: field >= v, "lte": lambda v: field <= v, "gt": lambda v: field > v, "lt": lambda v: field < v}
        out = F.lit(True)
        for key, value in condition["range"].items():
            out = out & of[key](value)
        return out

    out = F.lit(True)
    for condition in spec.get("must", ()):
        out = out & one(condition)
    for condition in spec.get("must_not", ()):
        out = out & ~one(condition)
    if should := spec.get("should"):
        some = F.lit(False)
        for condition in should:
            some = some | one(condition)
        out = out & some
    return out


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, weights: tuple[float, float] = RRF_WEIGHTS) -> DataFrame:
    """V9: (query_id, id, score, dense_rank, sparse_rank): the sum of weight / (k + rank) over ranked lists; ties go to the better dense rank, then the better sparse rank."""
    both = dense.select("query_id", "id", (F.lit(weights[0]) / (F.lit(k) + F.col("rank"))).alias("s"), F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).unionByName(
        sparse.select("query_id", "id", (F.lit(weights[1]) / (F.lit(k) + F.col("rank"))).alias("s"), F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("sparse_rank"))
    )
    return both.groupBy("query_id", "id").agg(F.sum("s").alias("score"), F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank"))


def dbsf(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = RRF_WEIGHTS) -> DataFrame:
    """(query_id, id, score): the weighted sum of each list's z-scores (population deviation; 0 where it is 0, or the list lacks the id)."""
    parts = []
    for lists, weight in ((dense, weights[0]), (sparse, weights[1])):
        w = Window.partitionBy("query_id")
        mean, deviation = F.avg("score").over(w), F.stddev_pop("score").over(w)
        parts.append(lists.select("query_id", "id", (F.lit(weight) * F.when(deviation > 1e-12, (F.col("score") - mean) / deviation).otherwise(0.0)).alias("s")))
    return parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def bm25(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of candidates (query_id, id, text, rank) for queries (query_id, query): document counts and mean length are of a query's own candidates; scores are over the best one's, those of 0 don't come."""
    # Everything is counted within a query, so that its candidates move once and are recalled once. Of a text, only the tokens that its query has are counted.
    own = Window.partitionBy("query_id")
    terms = queries.select("query_id", F.array_distinct(F.transform(tokens(F.col("query")), F.lower)).alias("terms"))
    said = candidates.join(terms, "query_id").select("query_id", "id", "terms", F.transform(tokens(F.col("text")), F.lower).alias("toks"))
    met = said.select("query_id", "id", F.size("toks").alias("len"), F.filter("toks", lambda t: F.array_contains("terms", t)).alias("met"))
    sized = met.withColumns({"n": F.count(F.lit(1)).over(own), "avgdl": F.avg("len").over(own)})
    tf = sized.select("query_id", "id", "len", "n", "avgdl", F.explode("met").alias("token")).groupBy("query_id", "id", "token").agg(F.count(F.lit(1)).alias("tf"), *(F.first(c).alias(c) for c in ("len", "n", "avgdl")))
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "token")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.greatest("avgdl", F.lit(1e-9))))
    raw = tf.groupBy("query_id", "id").agg(F.sum(weight).alias("raw"))
    return raw.where("raw > 0").withColumn("best", F.max("raw").over(own)).select("query_id", "id", (F.col("raw") / F.col("best")).alias("score"))


def evaluate(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, n_expected, n_found, hit_rate, mrr, pass) of expected (query_id, id) and hits (query_id, id, rank); a query without expectations doesn't come."""
    first = hits.groupBy("query_id", "id").agg(F.min("rank").alias("first"))
    position = first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    met = expected.distinct().join(position, ["query_id", "id"], "left")
    out = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("position").alias("n_found"), F.min("position").alias("best"))
    return out.select(
        "query_id", "n_expected", "n_found", F.round(F.col("n_found") / F.col("n_expected"), 4).alias("hit_rate"), F.round(F.coalesce(1 / F.col("best"), F.lit(0.0)), 4).alias("mrr"), (F.col("n_found") == F.col("n_expected")).alias("pass"),
    )


def report(cases: DataFrame) -> DataFrame:
    """One row over all cases."""
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("pass").alias("n_passed"), F.count_if(~F.col("pass")).alias("n_failed"), F.round(F.avg("hit_rate"), 4).alias("avg_hit_rate"), F.round(F.avg("mrr"), 4).alias("avg_mrr"))
