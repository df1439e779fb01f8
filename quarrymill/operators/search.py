"""Search as one operator: a table of requests, each with parameters of its own, answered by one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.operators import retrieval as R
from quarrymill.sources.shared import stored

TOP_K, PREFETCH = 5, 50
MOST_TOP_K, MOST_PREFETCH, MOST_RRF_K = 50, 200, 1_000
DENSE_DIM = 1024


def params(json: Column) -> Column:
    """A request's parameters as a struct of mode, top_k, prefetch, rerank, fusion, rrf_k and weights, each null unless the JSON object has it in the right type.

    Numbers count only as numbers, not as texts that look like one; they are rounded, halves up, and held to their ranges. Weights are two
    numbers. What isn't an object, or has a key twice, gives nulls only.
    """
    root = F.try_parse_json(json)
    field = lambda name: F.try_variant_get(root, f"$.{name}", "variant")
    kind = lambda v: F.schema_of_variant(v)
    is_number = lambda v: kind(v).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$")

    def chosen(name: str, *values: str) -> Column:
        v = field(name)
        return F.when((kind(v) == "STRING") & v.cast("string").isin(*values), v.cast("string"))

    def number(v: Column) -> Column:
        # Under a condition, as casts of other variants may fail.
        x = F.when(is_number(v), F.try_variant_get(v, "$", "double"))
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    def held(name: str, most: int) -> Column:
        x = number(field(name))
        return F.when(x.isNotNull(), F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(most))).cast("int")  # least and greatest pass over nulls

    pair = F.when(kind(field("rrfWeights")).startswith("ARRAY"), F.try_variant_get(field("rrfWeights"), "$", "array<variant>"))
    both = F.transform(pair, number)
    rerank = field("rerank")
    return F.struct(
        chosen("mode", "hybrid", "dense", "sparse").alias("mode"), held("topK", MOST_TOP_K).alias("top_k"), held("prefetchLimit", MOST_PREFETCH).alias("prefetch"), F.when(kind(rerank) == "BOOLEAN", rerank.cast("boolean")).alias("rerank"),
        chosen("fusion", "rrf", "dbsf").alias("fusion"), held("rrfK", MOST_RRF_K).alias("rrf_k"), F.when((F.size(both) == 2) & ~F.exists(both, F.isnull), both).alias("weights"),
    )


def resolved(requests: DataFrame, native: bool = True) -> DataFrame:
    """requests (query_id, query, params, ...) with what they ask for in the columns mode, top_k, prefetch, rerank, fusion, rrf_k, w_dense and w_sparse. A collection without sparse vectors (native=False) is searched by dense ones, whatever the mode asked for."""
    p = F.col("_p")
    top_k = F.coalesce(p["top_k"], F.lit(TOP_K))
    columns = {
        "mode": F.coalesce(p["mode"], F.lit("hybrid")) if native else F.lit("dense"), "top_k": top_k, "prefetch": F.least(F.greatest(F.coalesce(p["prefetch"], F.lit(PREFETCH)), top_k), F.lit(MOST_PREFETCH)), "rerank": F.coalesce(p["rerank"], F.lit(False)),
        "fusion": F.coalesce(p["fusion"], F.lit("rrf")), "rrf_k": F.coalesce(p["rrf_k"], F.lit(R.RRF_K)), "w_dense": F.coalesce(p["weights"][0], F.lit(R.RRF_WEIGHTS[0])), "w_sparse": F.coalesce(p["weights"][1], F.lit(R.RRF_WEIGHTS[1])),
    }
    return requests.withColumn("_p", params(F.col("params"))).withColumns(columns).drop("_p", "params")


def fuse(dense: DataFrame, sparse: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score, dense_rank, sparse_rank, fused_rank) of two recalled lists, each query by its own mode, fusion, weights and constants.

    One list alone keeps its scores, for four times as many as are wanted; fused lists keep as many as were recalled. Ties go to the better dense rank, then the better sparse rank.
    """
    own = Window.partitionBy("query_id", "list")
    lists = dense.withColumn("list", F.lit("dense")).unionByName(sparse.withColumn("list", F.lit("sparse"))).join(asked.select("query_id", "mode", "top_k", "prefetch", "fusion", "rrf_k", "w_dense", "w_sparse"), "query_id")
    deviation = F.stddev_pop("score").over(own)
    z = F.when(deviation > 1e-12, (F.col("score") - F.avg("score").over(own)) / deviation).otherwise(0.0)
    weight = F.when(F.col("list") == "dense", F.col("w_dense")).otherwise(F.col("w_sparse"))
    share = F.when(F.col("mode") != "hybrid", F.col("score")).when(F.col("fusion") == "dbsf", weight * z).otherwise(weight / (F.col("rrf_k") + F.col("rank")))
    most = F.when(F.col("mode") != "hybrid", 4 * F.col("top_k")).otherwise(F.greatest("prefetch", "top_k"))
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("rank"))).alias(f"{name}_rank")
    fused = lists.withColumn("share", share).groupBy("query_id", "id").agg(F.sum("share").alias("score"), of("dense"), of("sparse"), F.first(most).alias("most"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return fused.withColumn("fused_rank", F.row_number().over(order).cast("int")).where("fused_rank <= most").drop("most")


def search(requests: DataFrame, chunks: DataFrame, native: bool = True) -> DataFrame:
    """(query_id, rank, id, doc_id, score, rerank_score, dense_rank, sparse_rank, fused_rank, text, parent_text) for a table of requests.

    requests: query_id, query, params (JSON, see params and resolved), doc_ids, page_from and page_to (filters, null for none) and threshold
    (of dense scores, null for none). chunks: id, doc_id, text, parent_text, page_from, page_to, enabled; those that aren't enabled are never
    found. All requests share one scan of the chunks for dense recall and one for sparse, whatever their modes: each goes only to the lists
    that its mode needs, with a limit and a filter of its own, and filters hold before the limit. Then each is fused, re-ranked if it asks
    for that, and cut by its own numbers. A request whose text is null or has no tokens, or whose filter leaves nothing, has no rows; of requests
    that share a query_id the result isn't defined.
    """
    asked = stored(resolved(requests, native))
    points = chunks.where("enabled").select("id", "doc_id", "page_from", "page_to", "text")

    def recalled(dense: bool, modes: tuple[str, str]) -> DataFrame:
        dim = DENSE_DIM if dense else R.SPARSE_DIM
        those = asked.where(F.col("mode").isin(*modes))
        keep = ("doc_ids", "page_from", "page_to", "prefetch", *(("threshold",) if dense else ()))
        vectors = R.hash_vectors(those, "query_id", "query", dim, dense).withColumnRenamed("id", "query_id").join(those.select("query_id", *keep), "query_id")
        kept = R.hash_vectors(points, "id", "text", dim, dense, keep=("doc_id", "page_from", "page_to"))
        return stored(R.postings_topk(vectors, kept, "prefetch"))

    fused = stored(fuse(recalled(True, ("hybrid", "dense")), recalled(False, ("hybrid", "sparse")), asked))
    wanted = fused.join(asked.select("query_id", "query", "top_k", "prefetch", "rerank"), "query_id")
    texts = chunks.select("id", "doc_id", "text", "parent_text")
    plain = wanted.where("NOT rerank AND fused_rank <= top_k").select("query_id", F.col("fused_rank").alias("rank"), "id", F.lit(None).cast("double").alias("rerank_score"))
    candidates = wanted.where("rerank AND fused_rank <= greatest(prefetch, top_k)").join(texts.select("id", "text"), "id").select("query_id", "id", "text", F.col("fused_rank").alias("rank"))
    scored = R.bm25(candidates, asked.select("query_id", "query")).join(fused.select("query_id", "id", "fused_rank"), ["query_id", "id"])
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "fused_rank")
    reranked = scored.withColumn("rank", F.row_number().over(order).cast("int")).join(asked.select("query_id", "top_k"), "query_id").where("rank <= top_k").select("query_id", "rank", "id", F.round("score", 6).alias("rerank_score"))
    found = plain.unionByName(reranked).join(fused, ["query_id", "id"]).join(texts, "id")
    return found.select("query_id", "rank", "id", "doc_id", F.round("score", 6).alias("score"), "rerank_score", "dense_rank", "sparse_rank", "fused_rank", "text", "parent_text")
