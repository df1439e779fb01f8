"""Exact top-k search: tiled integer matrix products, a selection in each tile, and a merge of per-query lists up a tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 16_384
TILE_ROWS = 2_048
FAN_IN = 16
STEP_ROWS = 256
LONG_MAX = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, factor: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(factor * x) of each component; rows whose id or vector is null, or that hold a null or non-finite component, go."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # Python's floor follows in the tile: Spark's floor() gives a long and would overflow on huge components.
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c * float(factor)).alias("v"))


def _floats(column: pd.Series) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in column])) if len(column) else np.zeros((0, 0))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating-point BLAS while every partial sum is below 2**53, else by Python integers (held to the range of a long)."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
    return np.array([[max(-LONG_MAX - 1, min(LONG_MAX, int(x))) for x in r] for r in exact], dtype=np.int64)


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k best by (score down, id up); the columns stand in the order of the ids."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones_like(scores, dtype=bool))
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above = scores > kth
    tied = scores == kth
    keep = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(keep)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query of (vec_id, v) against all candidates of (vec_id, v) but those with its own id.

    Queries are dealt to tiles and candidates to shards by their ids' hashes, each of a bounded number of rows; each pair of tile and
    shard is one task's matrix product, of which k rows per query leave. Lists are merged FAN_IN shards at a time until one is left.
    Vectors of different lengths aren't compared. A repeated id among the queries gives one list, from one of its rows; each row of a
    repeated candidate id counts. Ties go to the smaller id. Empty tables give no rows.
    """
    n_candidates = candidates.count()
    n_queries = queries.count()
    shards = max(1, -(-n_candidates // SHARD_ROWS))
    tiles = max(1, -(-n_queries // TILE_ROWS))
    if n_candidates < 64 * SHARD_ROWS:  # small inputs still spread over the executors
        shards = max(shards, min(64, -(-n_candidates // 1_024)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = queries.dropDuplicates(["vec_id"]).select(deal(tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    right = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), deal(shards).alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        rows = rows.sort_values("vec_id", kind="stable")
        for _, same in rows.groupby(rows["v"].map(len)):
            asks, holds = same[same["asks"]], same[~same["asks"]]
            if asks.empty or holds.empty:
                continue
            c, ids = _floats(holds["v"]), holds["vec_id"].to_numpy()
            for at in range(0, len(asks), STEP_ROWS):
                some = asks.iloc[at : at + STEP_ROWS]
                own = some["vec_id"].to_numpy()
                scores = _scores(_floats(some["v"]), c)
                # A query's own rows may take places of the selection, so that many more are selected, and dropped after.
                spare = int((np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")).max(initial=0))
                r, j = _select(scores, k + spare)
                found = pd.DataFrame({"query_id": own[r], "vec_id": ids[j], "score": scores[r, j]})
                found = found[found["query_id"] != found["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(found.groupby("query_id").head(k))
        best = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best.astype("int64").assign(shard=int(key[1]))[["query_id", "shard", "vec_id", "score"]]

    lists = left.unionByName(right).groupBy("tile", "shard").applyInPandas(product, "query_id long, shard int, vec_id long, score long")
    order = (F.col("score").desc(), F.col("vec_id"))
    while shards > FAN_IN:
        lists = lists.withColumn("shard", (F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN_IN)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def self_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """top_k of the rows whose id is divisible by every, against all rows."""
    rows = quantized(vectors, id_col, vector_col)
    return top_k(rows.where(F.pmod("vec_id", F.lit(every)) == 0), rows, k)

