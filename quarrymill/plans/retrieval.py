"""Queries of embedding, recall, fusion, re-ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions.text import fnv1a
from quarrymill.operators import retrieval as R
from quarrymill.operators import search as S
from quarrymill.plans import sql
from quarrymill.sources.shared import stored

PREFETCH, TOP_K, DENSE_DIM = 50, 5, 1024
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): documents that hold a question whole."""
    return R.contained(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _bench(spark, sf_dir))


def _list(spark: SparkSession, sf_dir: str, dim: int, dense: bool, k: int) -> DataFrame:
    """Documents recalled for every question, written once for all that read them."""
    docs, items = R.hash_vectors(read(spark, sf_dir, "documents"), "doc_id", "text", dim, dense), R.hash_vectors(read(spark, sf_dir, "benchmark"), "item_id", "text", dim, dense)
    return stored(R.postings_topk(items.withColumnRenamed("id", "query_id"), docs, k))


def _recall(spark: SparkSession, sf_dir: str, k: int = PREFETCH) -> DataFrame:
    return _list(spark, sf_dir, DENSE_DIM, True, k)


def _sparse(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return _list(spark, sf_dir, R.SPARSE_DIM, False, k)


def _reranked(spark: SparkSession, sf_dir: str, recall: DataFrame, k: int) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.ranked(R.bm25(recall.join(docs, "id").select("query_id", "id", "text", "rank"), _bench(spark, sf_dir)), k)


_DENSE = f"{sql.postings('d', 'documents', 'doc_id', 'text', DENSE_DIM, True)}, {sql.postings('q', 'benchmark', 'item_id', 'text', DENSE_DIM, True)}, dense_s AS (SELECT q.id AS query_id, d.id AS id, sum(d.w * q.w) AS score FROM d JOIN q USING (idx) GROUP BY 1, 2), {sql.topk('dense', 'dense_s', PREFETCH)}"
_SPARSE = f"{sql.postings('sd', 'documents', 'doc_id', 'text', R.SPARSE_DIM, False)}, {sql.postings('sq', 'benchmark', 'item_id', 'text', R.SPARSE_DIM, False)}, sparse_s AS (SELECT sq.id AS query_id, sd.id AS id, CAST(sum(sd.w * sq.w) AS BIGINT) AS score FROM sd JOIN sq USING (idx) GROUP BY 1, 2), {sql.topk('sparse', 'sparse_s', PREFETCH)}"


def _bm25_sql(source: str) -> str:
    return f"""c AS (SELECT r.query_id, r.id, {sql.lower_toks('text')} AS t FROM {source} r JOIN documents ON doc_id = r.id),
        pq AS (SELECT query_id, count(*) AS n, avg(len(t)) AS avgdl FROM c GROUP BY 1),
        terms AS (SELECT DISTINCT item_id AS query_id, unnest({sql.lower_toks('text')}) AS token FROM benchmark),
        ctf AS (SELECT query_id, id, dl, token, count(*) AS tf FROM (SELECT query_id, id, len(t) AS dl, unnest(t) AS token FROM c) JOIN terms USING (query_id, token) GROUP BY ALL),
        cdf AS (SELECT query_id, token, count(*) AS df FROM ctf GROUP BY ALL),
        raw AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {R.BM25_K1 + 1} / (tf + {R.BM25_K1} * (1 - {R.BM25_B} + {R.BM25_B} * dl / greatest(avgdl, 1e-9)))) AS raw FROM ctf JOIN cdf USING (query_id, token) JOIN pq USING (query_id) GROUP BY ALL),
        bm AS (SELECT query_id, id, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM raw WHERE raw > 0), {sql.topk('top', 'bm', TOP_K)}"""


_GOLD = "gold AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_EVAL = """pos AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM top),
        cases AS (SELECT query_id, count(*) AS n_expected, count(position) AS n_found, round(count(position) / count(*), 4) AS hit_rate, round(coalesce(1.0 / min(position), 0.0), 4) AS mrr, count(position) = count(*) AS pass FROM gold LEFT JOIN pos USING (query_id, id) GROUP BY 1)"""


@query(f"WITH {_DENSE}, {_bm25_sql('dense')}, {_GOLD}, {_EVAL} SELECT * FROM cases")
def flagship_search_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense recall, lexical re-ranking and its quality for every question."""
    return R.evaluate(_gold(spark, sf_dir), _reranked(spark, sf_dir, _recall(spark, sf_dir), TOP_K))


@query(f"WITH {_DENSE}, {_bm25_sql('dense')}, {_GOLD}, {_EVAL} SELECT count(*) AS n_cases, count(*) FILTER (pass) AS n_passed, count(*) FILTER (NOT pass) AS n_failed, round(avg(hit_rate), 4) AS avg_hit_rate, round(avg(mrr), 4) AS avg_mrr FROM cases")
def retrieval_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, V17."""
    return R.report(flagship_search_eval(spark, sf_dir))


@query(f"WITH {_DENSE}, {_bm25_sql('dense')} SELECT query_id, id AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _reranked(spark, sf_dir, _recall(spark, sf_dir), TOP_K).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {sql.postings('d', 'documents', 'doc_id', 'text', R.SPARSE_DIM, False)} SELECT id AS doc_id, count(*) AS n_terms, CAST(sum(w) AS BIGINT) AS total, CAST(sum(idx * w) AS BIGINT) AS checksum FROM d GROUP BY 1")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's sparse vector."""
    v = R.hash_embed_sparse(read(spark, sf_dir, "documents"), "doc_id", "text")
    return v.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.sum("w").alias("total"), F.sum(F.col("idx") * F.col("w")).alias("checksum"))


@query(f"WITH {sql.postings('d', 'documents', 'doc_id', 'text', DENSE_DIM, True)} SELECT id AS doc_id, count(*) AS n_components, round(sum(w * w), 6) AS norm, round(max(w), 6) AS largest, round(sum(w), 6) AS total FROM d GROUP BY 1")
def hash_embed_dense_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, dense."""
    v = R.hash_embed_dense(read(spark, sf_dir, "documents"), "doc_id", "text", DENSE_DIM)
    return v.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_components"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"), F.round(F.max("w"), 6).alias("largest"), F.round(F.sum("w"), 6).alias("total"))


@query(f"WITH {_SPARSE} SELECT query_id, id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= {TOP_K}")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, J15."""
    return _sparse(spark, sf_dir, TOP_K).select("query_id", F.col("id").alias("doc_id"), F.col("score").cast("long").alias("score"), "rank")


_VEC = "vec AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_VEC_S = "s AS (SELECT q.id AS query_id, p.id AS id, p.label, list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])) AS score FROM vec p JOIN vec q ON p.id <> q.id AND q.id % 50 = 0)"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points, and as queries those whose id is divisible by 50."""
    points = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return points, points.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VEC}, {_VEC_S}, {sql.topk('top', 's', 10)} SELECT query_id, id AS vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of stored points to stored points, themselves left out."""
    points, queries = _vectors(spark, sf_dir)
    return _out(R.dense_topk(queries, points, 10, skip_self=True))


@query(f"WITH {_VEC}, {_VEC_S}, f AS (SELECT * FROM s WHERE label IN (1, 2, 3) AND NOT (label >= 3)), {sql.topk('top', 'f', 10)} SELECT query_id, id AS vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with a P10 filter."""
    points, queries = _vectors(spark, sf_dir)
    chosen = R.filter_column({"must": [{"key": "label", "match": {"any": [1, 2, 3]}}], "must_not": [{"key": "label", "range": {"gte": 3}}]})
    return _out(R.dense_topk(queries, points.where(chosen), 10, skip_self=True))


@query(f"WITH {_VEC}, {_VEC_S} SELECT query_id, id AS vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s WHERE score >= 0.25")
def score_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points over a score."""
    points, queries = _vectors(spark, sf_dir)
    scored = R.dense_topk(queries, points, None, threshold=0.25, skip_self=True)
    return _out(scored)


@query("""WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS v, generate_subscripts(embedding, 1) - 1 AS idx FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, idx) AS rn FROM x)
    SELECT vec_id, count(*) AS n_kept, CAST(sum(idx) AS BIGINT) AS idx_sum, round(sum(abs(v)), 6) AS weight FROM r WHERE rn <= 64 AND abs(v) > 0.05 GROUP BY 1""")
def pseudo_sparse_top64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: the 64 largest components of a dense vector over 0.05, as a sparse one."""
    v = F.transform(F.col("embedding"), lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("a"), i.alias("idx")))
    kept = F.filter(F.slice(F.array_sort(v), 1, 64), lambda s: s["a"] < -0.05)
    return read(spark, sf_dir, "embeddings").select("vec_id", kept.alias("kept")).where(F.size("kept") > 0).select("vec_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + x["idx"]).alias("idx_sum"), F.round(F.aggregate("kept", F.lit(0.0), lambda s, x: s - x["a"]), 6).alias("weight"))


_BOTH = f"WITH {_DENSE}, {_SPARSE}"


@query(f"{_BOTH}, u AS (SELECT query_id, id, 0.5 / (60 + rank) AS s, rank AS dr, NULL AS sr FROM dense UNION ALL SELECT query_id, id, 0.5 / (60 + rank), NULL, rank FROM sparse), f AS (SELECT query_id, id, sum(s) AS score, max(dr) AS dr, max(sr) AS sr FROM u GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dr NULLS LAST, sr NULLS LAST, id) AS rank FROM f) SELECT query_id, id AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 10")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9, J9, T5, U1."""
    fused = R.rrf(_recall(spark, sf_dir), _sparse(spark, sf_dir, PREFETCH))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return fused.withColumn("rank", F.row_number().over(order).cast("int")).where("rank <= 10").select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"{_BOTH}, z AS (SELECT query_id, id, 0.5 * CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS s FROM dense WINDOW w AS (PARTITION BY query_id) UNION ALL SELECT query_id, id, 0.5 * CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END FROM sparse WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, id, sum(s) AS score FROM z GROUP BY 1, 2), {sql.topk('top', 'f', 10)} SELECT query_id, id AS doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM top")
def dbsf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10, A20."""
    fused = R.ranked(R.dbsf(_recall(spark, sf_dir), _sparse(spark, sf_dir, PREFETCH)), 10)
    return fused.select("query_id", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


@query(f"{_BOTH} SELECT query_id, count(*) AS n_union, count(*) FILTER (b = 2) AS n_both, count(*) FILTER (b = 1 AND d = 1) AS n_dense_only FROM (SELECT query_id, id, count(*) AS b, max(d) AS d FROM (SELECT query_id, id, 1 AS d FROM dense UNION ALL SELECT query_id, id, 0 FROM sparse) GROUP BY 1, 2) GROUP BY 1")
def set_ops_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two ranked lists per question."""
    a, b = _recall(spark, sf_dir).select("query_id", "id"), _sparse(spark, sf_dir, PREFETCH).select("query_id", "id")
    both = a.withColumn("d", F.lit(1)).unionByName(b.withColumn("d", F.lit(0))).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("b"), F.max("d").alias("d"))
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_union"), F.count_if(F.expr("b = 2")).alias("n_both"), F.count_if(F.expr("b = 1 and d = 1")).alias("n_dense_only"))


@query(f"WITH {_DENSE}, {_bm25_sql('dense')} SELECT t.query_id, t.id AS doc_id, CAST(t.rank AS INTEGER) AS rank, CAST(d.rank AS INTEGER) AS prev_rank, round(t.score, 6) AS score, left(o.text, 200) AS preview, o.source AS kb FROM top t JOIN dense d USING (query_id, id) JOIN documents o ON o.doc_id = t.id")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, re-rank, context of each hit, and its rank before."""
    recall = _recall(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("preview"), F.col("source").alias("kb"))
    top = _reranked(spark, sf_dir, recall, TOP_K)
    return top.join(recall.select("query_id", "id", F.col("rank").alias("prev_rank")), ["query_id", "id"]).join(docs, "id").select("query_id", F.col("id").alias("doc_id"), "rank", "prev_rank", F.round("score", 6).alias("score"), "preview", "kb")


@query("SELECT label, count(*) AS n_points, CAST(min(len(embedding)) AS BIGINT) AS dim_min, CAST(max(len(embedding)) AS BIGINT) AS dim_max, count(*) FILTER (len(embedding) <> 64 OR embedding IS NULL) AS n_violations FROM embeddings GROUP BY 1")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, dimensions and violations of the scheme by payload label."""
    e = read(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n_points"), F.min(F.size("embedding")).cast("long").alias("dim_min"), F.max(F.size("embedding")).cast("long").alias("dim_max"), F.count_if((F.size("embedding") != 64) | F.col("embedding").isNull()).alias("n_violations"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({sql.lower_toks('text')}) AS token FROM documents) SELECT token, fnv, df FROM (SELECT token, {sql.fnv('token')} AS fnv, count(*) AS df FROM t GROUP BY 1)")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each token, and its hash."""
    tf = R.token_counts(read(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).select("token", fnv1a(F.col("token")).alias("fnv"), "df")


# Requests over the questions, and what they should be taken for: by item_id, parameters of every mode, of wrong types and out of their ranges.
_ASKED = [
    "{}", '{"mode":"dense","topK":3}', '{"mode":"sparse","topK":2.5}', '{"fusion":"dbsf","rrfWeights":[0.7,0.3],"topK":7}', '{"rerank":true,"topK":4}', '{"mode":"dense","rerank":true,"prefetchLimit":10}', '{"topK":"9","rrfK":10.4,"rrfWeights":[0.2,"x"]}',
    "not json", '{"topK":99,"prefetchLimit":500,"rrfK":0,"mode":"fuzzy"}', '[1]', '{"topK":-3,"prefetchLimit":0,"rrfWeights":[1,2.5]}', '{"rerank":"yes","fusion":"DBSF","rrfWeights":[1]}', '{"mode":"sparse","rerank":true,"prefetchLimit":30,"topK":12}',
]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions as requests. By their ids, they are held to three sources, to pages that overlap 3 and 4, to neither or to both, and their dense scores to 0.1 or more."""
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("query"), F.get(F.array(*(F.lit(x) for x in _ASKED)), (i % len(_ASKED)).cast("int")).alias("params"), F.when(i % 3 == 1, F.array(*(F.lit(f"src{k}") for k in (1, 2, 3)))).alias("doc_ids"),
        F.when(i % 5 == 2, 3).alias("page_from"), F.when(i % 5 == 2, 4).alias("page_to"), F.when(i % 4 == 3, 0.1).alias("threshold"),
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source, on made-up pages; every eleventh isn't enabled."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(i.alias("id"), F.col("source").alias("doc_id"), "text", F.concat_ws(" ", "source", F.substring("text", 1, 40)).alias("parent_text"), (i % 10).cast("int").alias("page_from"), (i % 10 + i % 3).cast("int").alias("page_to"), (i % 11 != 0).alias("enabled"))


_REQUESTS = f"""a AS (SELECT item_id, (CASE item_id % {len(_ASKED)} {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ASKED))} END) AS params FROM benchmark),
    o AS (SELECT item_id, CASE WHEN json_valid(params) AND json_type(params) = 'OBJECT' THEN CAST(params AS JSON) END AS p FROM a),
    k AS (SELECT item_id, p, json_type(p, '$.topK') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS has_k, json_type(p, '$.prefetchLimit') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS has_p, json_type(p, '$.rrfK') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS has_r,
          json_type(p, '$.rrfWeights') = 'ARRAY' AND json_array_length(p, '$.rrfWeights') = 2 AND json_type(p, '$.rrfWeights[0]') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_type(p, '$.rrfWeights[1]') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS has_w FROM o),
    asked AS MATERIALIZED (SELECT item_id AS query_id, CASE WHEN json_type(p, '$.mode') = 'VARCHAR' AND p ->> 'mode' IN ('hybrid', 'dense', 'sparse') THEN p ->> 'mode' ELSE 'hybrid' END AS mode,
          CASE WHEN has_k THEN least(greatest(floor(CAST(p ->> 'topK' AS DOUBLE) + 0.5), 1), 50) ELSE 5 END AS top_k,
          least(greatest(CASE WHEN has_p THEN least(greatest(floor(CAST(p ->> 'prefetchLimit' AS DOUBLE) + 0.5), 1), 200) ELSE 50 END, CASE WHEN has_k THEN least(greatest(floor(CAST(p ->> 'topK' AS DOUBLE) + 0.5), 1), 50) ELSE 5 END), 200) AS prefetch,
          coalesce(json_type(p, '$.rerank') = 'BOOLEAN' AND p ->> 'rerank' = 'true', false) AS rerank, CASE WHEN json_type(p, '$.fusion') = 'VARCHAR' AND p ->> 'fusion' IN ('rrf', 'dbsf') THEN p ->> 'fusion' ELSE 'rrf' END AS fusion,
          CASE WHEN has_r THEN least(greatest(floor(CAST(p ->> 'rrfK' AS DOUBLE) + 0.5), 1), 1000) ELSE 60 END AS rrf_k,
          CASE WHEN has_w THEN CAST(p ->> '$.rrfWeights[0]' AS DOUBLE) ELSE 0.5 END AS wd, CASE WHEN has_w THEN CAST(p ->> '$.rrfWeights[1]' AS DOUBLE) ELSE 0.5 END AS ws FROM k)"""


@query(f"WITH {_REQUESTS} SELECT query_id, mode, CAST(top_k AS INTEGER) AS top_k, CAST(prefetch AS INTEGER) AS prefetch, rerank, fusion, CAST(rrf_k AS INTEGER) AS rrf_k, wd AS w_dense, ws AS w_sparse FROM asked")
def search_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests ask for, with defaults for what is missing, of a wrong type or out of range."""
    return S.resolved(_requests(spark, sf_dir)).drop("query", "doc_ids", "page_from", "page_to", "threshold")


@query(f"""WITH {_REQUESTS}, {sql.postings('d', 'documents', 'doc_id', 'text', DENSE_DIM, True)}, {sql.postings('q', 'benchmark', 'item_id', 'text', DENSE_DIM, True)}, {sql.postings('sd', 'documents', 'doc_id', 'text', R.SPARSE_DIM, False)}, {sql.postings('sq', 'benchmark', 'item_id', 'text', R.SPARSE_DIM, False)},
    ch AS (SELECT doc_id AS id, source, doc_id % 10 AS pf, doc_id % 10 + doc_id % 3 AS pt FROM documents WHERE doc_id % 11 <> 0),
    fits AS (SELECT query_id, id FROM asked, ch WHERE (query_id % 3 <> 1 OR source IN ('src1', 'src2', 'src3')) AND (query_id % 5 <> 2 OR (pf <= 4 AND pt >= 3))),
    ds AS (SELECT q.id AS query_id, d.id AS id, sum(d.w * q.w) AS score FROM d JOIN q USING (idx) GROUP BY 1, 2), ss AS (SELECT sq.id AS query_id, sd.id AS id, CAST(sum(sd.w * sq.w) AS DOUBLE) AS score FROM sd JOIN sq USING (idx) GROUP BY 1, 2),
    found AS (SELECT 'dense' AS list, ds.* FROM ds JOIN fits USING (query_id, id) WHERE query_id % 4 <> 3 OR score >= 0.1 UNION ALL SELECT 'sparse', ss.* FROM ss JOIN fits USING (query_id, id)),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY round(score, 9) DESC, id) AS rank FROM found JOIN asked USING (query_id) WHERE mode IN ('hybrid', list)),
    rec AS MATERIALIZED (SELECT * FROM ranks WHERE rank <= prefetch),
    sh AS (SELECT *, CASE WHEN list = 'dense' THEN wd ELSE ws END AS w, stddev_pop(score) OVER x AS sd, avg(score) OVER x AS m FROM rec WINDOW x AS (PARTITION BY query_id, list)),
    f AS (SELECT query_id, id, sum(CASE WHEN mode <> 'hybrid' THEN score WHEN fusion = 'rrf' THEN w / (rrf_k + rank) WHEN sd > 1e-12 THEN w * (score - m) / sd ELSE 0 END) AS score, max(CASE WHEN list = 'dense' THEN rank END) AS dr, max(CASE WHEN list = 'sparse' THEN rank END) AS sr FROM sh GROUP BY 1, 2),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, dr NULLS LAST, sr NULLS LAST, id) AS fr FROM f),
    fused AS MATERIALIZED (SELECT fr.*, top_k, prefetch, rerank FROM fr JOIN asked USING (query_id) WHERE fr <= CASE WHEN mode <> 'hybrid' THEN 4 * top_k ELSE greatest(prefetch, top_k) END),
    cand AS (SELECT query_id, id FROM fused WHERE rerank AND fr <= greatest(prefetch, top_k)), {_bm25_sql('cand').rsplit(', top AS', 1)[0]},
    hits AS (SELECT query_id, id, fr AS rank, CAST(NULL AS DOUBLE) AS rerank_score FROM fused WHERE NOT rerank AND fr <= top_k
        UNION ALL SELECT query_id, id, rank, score FROM (SELECT bm.*, top_k, row_number() OVER (PARTITION BY query_id ORDER BY round(bm.score, 9) DESC, fr) AS rank FROM bm JOIN fused USING (query_id, id)) WHERE rank <= top_k)
    SELECT query_id, CAST(hits.rank AS INTEGER) AS rank, id, source AS doc_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, CAST(dr AS INTEGER) AS dense_rank, CAST(sr AS INTEGER) AS sparse_rank, CAST(fr AS INTEGER) AS fused_rank, length(text) AS n_text, source || ' ' || left(text, 40) AS parent_text
    FROM hits JOIN fused USING (query_id, id) JOIN documents ON doc_id = id""")
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question by parameters and filters of its own, in one plan."""
    found = S.search(_requests(spark, sf_dir), _sources(spark, sf_dir))
    return found.withColumn("n_text", F.length("text").cast("long")).drop("text")
