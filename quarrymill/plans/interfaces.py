"""Queries of what the interfaces show: projections, settings, panels, counters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions import contracts as K
from quarrymill.functions import text as X
from quarrymill.operators import tables as T

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, CASE event_type WHEN 'signup' THEN 'waiting' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'splitting' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status, event_type = 'error' AS failed FROM events")
def compat_projection(spark, sf_dir):
    """Epoch seconds and mapped states."""
    state = F.col("event_type")
    named = F.when(state == "signup", "queued").when(state == "view", "parsing").when(state == "click", "chunking").when(state == "purchase", "ready").otherwise("failed")
    return read(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), X.status_of(named).alias("status"), (state == "error").alias("failed"))


_CONFIGS = (
    '{"size":%d,"overlap":%d,"strategy":"token"}', '{"size":"%d","overlap":%d,"strategy":"title","protects":["code",5]}', '{"size":%d,"overlap":true,"parentSize":%d,"strategy":"heading"}', '{"size":null,"overlap":1,"strategy":5,"n":%d}', "no json %d", '{"size":%d.5,"size":1}', '{"size":%d,"protects":"code","strategy":"hybrid"}',
)


@query("""WITH e AS (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS k, user_id % 400 AS a, user_id % 300 AS b FROM events),
    c AS (SELECT event_id, k, CASE WHEN k IN (0, 2, 6) THEN a ELSE 512 END AS size, CASE k WHEN 0 THEN b WHEN 1 THEN b WHEN 3 THEN 1 ELSE 0 END AS overlap, CASE k WHEN 2 THEN b ELSE 2000 END AS parent FROM e)
    SELECT event_id, CAST(greatest(size, 16) AS INTEGER) AS size, CAST(greatest(0, least(overlap, size // 4)) AS INTEGER) AS overlap, CAST(greatest(size, parent) AS INTEGER) AS parent_size, CASE k WHEN 0 THEN 'token' WHEN 1 THEN 'title' ELSE 'hybrid' END AS strategy, CASE k WHEN 1 THEN ['code'] ELSE ['code', 'table'] END AS protects FROM c""")
def config_sanitise(spark, sf_dir):
    """Configurations with known and unknown strategies, numbers as texts, nulls, repeated keys and no JSON."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(_CONFIGS)).cast("int").alias("k"), (F.col("user_id") % 400).alias("a"), (F.col("user_id") % 300).alias("b"))
    json = F.get(F.array(*(F.format_string(x, *(F.col(c) for c in "ab"[: x.count("%d")])) for x in _CONFIGS)), F.col("k"))
    return e.select("event_id", K.chunk_config(json).alias("c")).select("event_id", "c.*")


@query("""WITH e AS (SELECT vec_id, label, CAST(vec_id % 8 AS INTEGER) AS k FROM embeddings)
    SELECT vec_id, CAST(CASE WHEN k IN (0, 1, 4) THEN label + 0.5 WHEN k IN (2, 5) THEN label + 0.25 WHEN k = 3 THEN 2.0 END AS DOUBLE) AS first_weight, CASE WHEN k IN (0, 4) THEN 2 WHEN k IN (1, 2, 3, 5) THEN 1 END AS n FROM e""")
def sparse_probe(spark, sf_dir):
    """V3: answers of embedding services in all shapes: arrays, pairs with a repeated index, an object with a zero and with a repeated index, nested, with data or of unequal lengths, and none; their first weight and how many there are."""
    i, w = F.col("vec_id"), F.col("label")
    shapes = (
        '{"sparse_embedding":{"indices":[9,3],"values":[7,%s.5]}}', '{"sparse":[[4,1],[4,%s.5]]}', '{"lexical_weights":{"5":0,"6":%s.25,"x":1}}', '{"sparse":{"8":1.0,"8":2.0},"label":%s}', '{"embeddings":{"sparse":{"indices":[1,2],"data":[%s.5,1]}}}',
        '{"sparse_indices":{"indices":[1,2],"values":[1]},"sparse":{"7":%s.25}}', '{"sparse":[[1,"%s"]]}', '{"sparse":null,"dense":[%s]}',
    )
    json = F.get(F.array(*(F.format_string(x, w) for x in shapes)), (i % len(shapes)).cast("int"))
    found = K.sparse_probe(json)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.get(F.map_values(found), F.lit(0)).alias("first_weight"), F.when(found.isNotNull(), F.size(found)).alias("n"))


@query("SELECT count(DISTINCT label) AS collections, count(*) AS points FROM embeddings")
def points_total(spark, sf_dir):
    """Labels as collections, and the points of all."""
    each = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("points"))
    return each.agg(F.count("label").alias("collections"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))


@query("SELECT vec_id, label, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def points_by_id(spark, sf_dir):
    """Points of given ids with their vectors; ids of no point don't come, and repeated ones once."""
    ids = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    points = T.points(read(spark, sf_dir, "embeddings"), ids.unionByName(ids).withColumnRenamed("doc_id", "vec_id"), "vec_id", vector="embedding", with_vector=True)
    return points.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT vec_id, label FROM embeddings WHERE label > 3 OR label = 3 AND vec_id > 100 ORDER BY label, vec_id LIMIT 200")
def scroll_by_label(spark, sf_dir):
    """The page behind the point 100 of label 3, by label and id, without vectors."""
    return T.scroll_by(read(spark, sf_dir, "embeddings"), "label", "vec_id", after=(3, 100), size=200, vector="embedding")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN left(text, 60) WHEN 2 THEN 'in ' || source ELSE 'summary: ' || source || chr(10) || 'body: ' || left(text, 60) END AS text FROM documents WHERE trim(left(text, 60)) <> ''""")
def payload_to_text(spark, sf_dir):
    """a key before another, one that is no string, nested JSON, and lines of the other strings."""
    said = F.substring("text", 1, 60)
    shapes = (
        F.struct(F.lit(7).alias("content"), F.lit(" ").alias("text"), F.col("source").alias("page_content"), said.alias("chunk")),
        F.struct(F.col("source").alias("text_preview"), said.alias("content")),
        F.struct(F.to_json(F.struct(F.concat(F.lit("in "), "source").alias("text"))).alias("_node_content"), F.col("source").alias("summary")),
        F.struct(F.lit("not json").alias("_node_content"), F.col("source").alias("summary"), F.lit("").alias("empty"), said.alias("body"), F.lit(5).alias("n")),
    )
    kind, payload = F.col("doc_id") % 4, F.to_json(shapes[3])
    for k in (2, 1, 0):
        payload = F.when(kind == k, F.to_json(shapes[k])).otherwise(payload)
    return read(spark, sf_dir, "documents").where(F.trim(said) != "").select("doc_id", K.payload_text(payload).alias("text"))


_MIME_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.MIME.items())


@query(f"SELECT page_id, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) {_MIME_SQL} ELSE 'application/octet-stream' END AS mime, length(html) AS size FROM pages")
def page_mime(spark, sf_dir):
    """F13, S1."""
    return read(spark, sf_dir, "pages").select("page_id", K.mime_of(F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1))).alias("mime"), F.length("html").cast("long").alias("size"))


@query("SELECT CAST(count(*) FILTER (event_type IN ('signup', 'view')) AS BIGINT) AS pending, count(*) FILTER (event_type = 'click') AS active, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type IN ('signup', 'view', 'click')) AS depth, count(*) FILTER (event_type IN ('signup', 'view', 'click')) >= 500 AS over_limit FROM events")
def queue_stats(spark, sf_dir):
    """A21, A23, ST8: one pass."""
    of = lambda *types: F.count_if(F.col("event_type").isin(*types))
    return read(spark, sf_dir, "events").agg(of("signup", "view").alias("pending"), of("click").alias("active"), of("error").alias("failed"), of("purchase").alias("done"), of("signup", "view", "click").alias("depth"), (of("signup", "view", "click") >= 500).alias("over_limit"))


@query("SELECT source, count(*) AS segments, count(*) FILTER (coalesce(l.quality, 1) = 1) AS enabled, count(*) FILTER (l.doc_id IS NULL) AS not_run, count(*) FILTER (l.toxic = 1) AS strict FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def segments_panel(spark, sf_dir):
    """Conditional counts of a joined table."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").withColumn("run", F.lit(True)), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.coalesce("quality", F.lit(1)) == 1).alias("enabled"), F.count_if(F.col("run").isNull()).alias("not_run"), F.count_if(F.col("toxic") == 1).alias("strict"))


@query("SELECT user_id, count(*) AS calls, max(ts) AS last_used FROM events GROUP BY 1")
def counter_update(spark, sf_dir):
    """Increments counted at once."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_used"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT source, count(*) AS n_docs, CAST(min(rank) FILTER (doc_id % 5 = 0) AS INTEGER) AS first_wanted FROM r GROUP BY 1")
def first_appearance(spark, sf_dir):
    """Where the first wanted document stands in each list."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id"))
    r = read(spark, sf_dir, "documents").select("source", "doc_id", rank.alias("rank"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.when(F.col("doc_id") % 5 == 0, F.col("rank"))).alias("first_wanted"))


@query("(SELECT event_id, 'running' AS list FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 10) UNION ALL (SELECT event_id, 'failed' FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10)")
def activity_lists(spark, sf_dir):
    """T6."""
    e = read(spark, sf_dir, "events")
    running = e.where("event_type = 'click'").orderBy("ts", "event_id").limit(10).select("event_id", F.lit("running").alias("list"))
    return running.unionByName(e.where("event_type = 'error'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(10).select("event_id", F.lit("failed").alias("list")))


@query("SELECT DISTINCT name FROM (SELECT source AS name FROM documents UNION ALL SELECT 'default' UNION ALL SELECT lang FROM documents WHERE lang <> '') WHERE name <> ''")
def collection_names(spark, sf_dir):
    """U4, A18."""
    d = read(spark, sf_dir, "documents")
    default = spark.range(1).select(F.lit("default").alias("name"))
    return d.select(F.col("source").alias("name")).unionByName(default).unionByName(d.select(F.col("lang").alias("name"))).where("name <> ''").distinct()


@query("SELECT event_id, least(greatest(CAST(user_id % 200 AS BIGINT), 2), 168) AS interval_h, ts + INTERVAL 1 HOUR * CAST(least(greatest(user_id % 200, 2), 168) AS INTEGER) AS next_run FROM events")
def next_run(spark, sf_dir):
    """The interval held to 2 to 168 hours."""
    hours = X.clamp(F.col("user_id") % 200, 2, 168)
    return read(spark, sf_dir, "events").select("event_id", hours.alias("interval_h"), (F.col("ts") + F.make_dt_interval(hours=hours.cast("int"))).alias("next_run"))


@query("SELECT user_id, CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) AS span_s FROM events GROUP BY 1")
def uptime(spark, sf_dir):
    """D7."""
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.floor((F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 1_000_000).alias("span_s"))


@query("SELECT doc_id, CAST(len(b) AS BIGINT) AS n_blocks, CAST(list_max(list_transform(b, lambda x: length(left(x, 200)))) AS BIGINT) AS longest FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents)")
def layout_read(spark, sf_dir):
    """Blocks cut to 200 characters."""
    b = F.transform(F.split("text", "\n"), lambda x: F.substring(x, 1, 200))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(b).cast("long").alias("n_blocks"), F.array_max(F.transform(b, lambda x: F.length(x))).cast("long").alias("longest"))


@query("SELECT doc_id, text IS NOT NULL AS has_source, l.doc_id IS NOT NULL AS has_layout, l.quality = 1 AS has_chunks FROM documents LEFT JOIN labels l USING (doc_id)")
def artifact_flags(spark, sf_dir):
    """P17."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return d.select("doc_id", F.col("text").isNotNull().alias("has_source"), F.col("there").isNotNull().alias("has_layout"), (F.col("quality") == 1).alias("has_chunks"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR ends_with(c_name, '7')")
def name_search(spark, sf_dir):
    """P5, P6, P15."""
    return read(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("12")) | F.endswith("c_name", F.lit("7"))).select("c_custkey", "c_name")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def job_owner(spark, sf_dir):
    """Lookups as joins; Spark broadcasts what its size allows."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return o.join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("""WITH a AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN user_id % 256 || '.' || (event_id % 256) || '.2.1' WHEN 1 THEN '192.0.' || (event_id % 8) || '.5' WHEN 2 THEN '172.' || (event_id % 64) || '.0.300' ELSE 'fe80::' || (event_id % 10) END AS address FROM events),
    p AS (SELECT *, string_split(address, '.') AS s FROM a),
    n AS (SELECT event_id, address, CASE WHEN regexp_full_match(address, '[0-9]{1,3}([.][0-9]{1,3}){3}') AND list_max(list_transform(s, lambda x: TRY_CAST(x AS INT))) < 256 THEN s[1]::BIGINT * 16777216 + s[2]::BIGINT * 65536 + s[3]::BIGINT * 256 + s[4]::BIGINT END AS n FROM p)
    SELECT event_id, address, n IS NULL OR n < 16777216 OR n >> 24 IN (10, 127) OR n >> 22 = 401 OR n >> 16 IN (43518, 49320) OR n >> 20 = 2753 OR n >> 8 = 12582914 OR n >> 17 = 25353 OR n >> 28 >= 14 AS private FROM n""")
def address_class(spark, sf_dir):
    """F24."""
    kind, of = F.col("user_id") % 4, lambda n: (F.col("event_id") % n).cast("string")
    a = F.when(kind == 0, F.concat((F.col("user_id") % 256).cast("string"), F.lit("."), of(256), F.lit(".2.1"))).when(kind == 1, F.concat(F.lit("192.0."), of(8), F.lit(".5")))
    a = a.when(kind == 2, F.concat(F.lit("172."), of(64), F.lit(".0.300"))).otherwise(F.concat(F.lit("fe80::"), of(10)))
    return read(spark, sf_dir, "events").select("event_id", a.alias("address")).withColumn("private", K.is_private(F.col("address")))


@query("SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0")
def cancelled_jobs(spark, sf_dir):
    """ST6, K3: jobs without those in a table of tombstones."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return T.cascade(e, e.where("event_id % 4 = 0").select(F.col("event_id").alias("gone")), "event_id", "gone").select("event_id", "event_type")


@query("SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE label IN (1, 2) AND vec_id > 100 ORDER BY vec_id LIMIT 50")
def scroll_points(spark, sf_dir):
    """With a filter, from a cursor."""
    points = read(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2))
    return T.scroll(points, "vec_id", 100, 50).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))


@query("""SELECT event_id, 'size' AS key, CAST(user_id % 3 AS VARCHAR) AS before, CAST(event_id % 3 AS VARCHAR) AS after FROM events WHERE user_id % 3 <> event_id % 3
    UNION ALL SELECT event_id, 'strategy', event_type, NULL FROM events UNION ALL SELECT event_id, 'overlap', NULL, CAST(user_id % 2 AS VARCHAR) FROM events""")
def config_key_diff(spark, sf_dir):
    """A key in both, one gone and one new."""
    before = F.to_json(F.struct((F.col("user_id") % 3).alias("size"), F.col("event_type").alias("strategy")))
    after = F.to_json(F.struct((F.col("event_id") % 3).alias("size"), (F.col("user_id") % 2).alias("overlap")))
    return T.key_diff(read(spark, sf_dir, "events").select("event_id", before.alias("old"), after.alias("new")), "old", "new")
