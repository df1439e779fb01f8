"""Queries over tables: dashboards, job queues, logs, versions, interval joins and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions import contracts as K
from quarrymill.functions import text as X
from quarrymill.operators import tables as T
from quarrymill.plans import sql
from quarrymill.sources import html_markdown

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


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _with_now(events: DataFrame) -> DataFrame:
    """A column now: the latest time of the log, one value."""
    return events.join(F.broadcast(events.agg(F.max("ts").alias("now"))))


@query(f"SELECT doc_id, CAST(len({sql.toks('text')}) AS BIGINT) AS n_tokens FROM documents")
def token_stats(spark, sf_dir):
    """F1."""
    return read(spark, sf_dir, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


@query(f"WITH t AS (SELECT source, CAST(len({sql.toks('text')}) AS BIGINT) AS n FROM documents) SELECT source, count(*) AS chunks, min(n) AS token_min, max(n) AS token_max, floor(avg(n) * 10 + 0.5) / 10 AS token_avg, quantile_disc(n, 0.95) AS token_p95 FROM t GROUP BY 1")
def chunk_stats_p95(spark, sf_dir):
    """A10."""
    t = read(spark, sf_dir, "documents").select("source", X.count_tokens(F.col("text")).alias("n"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("n").alias("token_min"), F.max("n").alias("token_max"), X.js_round(F.avg("n"), 1).alias("token_avg"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("token_p95"))


@query("SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS hash16 FROM documents")
def content_hash(spark, sf_dir):
    """F2."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), X.hash16(F.col("text")).alias("hash16"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('9f8b7c6d5e4f4a3b8c1d0e9f8a7b6c5d') || encode(source || ':' || doc_id || ':0:' || left(sha256(text), 16))) AS d FROM documents)
    SELECT doc_id, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(d, 17, 1))::INT % 4 + 1 AS INT), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS chunk_id FROM h""")
def chunk_id_v5(spark, sf_dir):
    """F3."""
    return read(spark, sf_dir, "documents").select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id").cast("string"), F.lit("0"), F.col("text")).alias("chunk_id"))


@query("SELECT doc_id, left(sha1('false|' || text), 16) AS fingerprint FROM documents")
def chunk_fingerprint(spark, sf_dir):
    """F4."""
    return read(spark, sf_dir, "documents").select("doc_id", X.fingerprint16(F.lit(False), F.col("text")).alias("fingerprint"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS rn, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents) SELECT doc_id, source, copies FROM r WHERE rn = 1")
def content_dedup_latest(spark, sf_dir):
    """The newest document of each content."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    # The newest by an aggregate: a content with a third of all copies is reduced before the exchange.
    return d.groupBy("h").agg(F.max(F.struct("doc_id", "source")).alias("m"), F.count(F.lit(1)).alias("copies")).select("m.doc_id", "m.source", "copies")


@query("SELECT copies, count(*) AS families, CAST(sum(copies) AS BIGINT) AS documents FROM (SELECT count(*) AS copies FROM documents GROUP BY sha256(text)) GROUP BY 1")
def dup_family_counts(spark, sf_dir):
    """C19, A18."""
    d = read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    return d.groupBy("copies").agg(F.count(F.lit(1)).alias("families"), F.sum("copies").alias("documents"))


_S = r"[ \t\n\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]"


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS t FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g') AS t FROM a),
    c AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(160), ' '), chr(12288), ' '), '(?m)[ \t]+$', '', 'g') AS t FROM b),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^([ \t]*)[•‣▪▫◦·●○]{_S.replace(chr(92) + "n", "")}+', '\1- ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM c),
    e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(\*\*|\*|~~|`){_S}+([，。；：、！？）】》”’,.;:!?)\]}}])', '\1\2', 'g'), '([（【《“‘({{\[]){_S}+(\*\*|\*|~~|`)', '\1\2', 'g') AS t FROM d),
    f AS (SELECT doc_id, regexp_replace(t, '^{_S}+|{_S}+$', '', 'g') AS t FROM e)
    SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS text FROM f""")
def clean_markdown(spark, sf_dir):
    """F11."""
    return read(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(F.col("text")).alias("text"))


_MARKED = " State-of-the-art 2024 x RAG a_b RAG 知识库召回 中 知识库"


@query(rf"""WITH t AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || '{_MARKED}' ELSE text END AS t FROM benchmark),
    r AS (SELECT item_id, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_-]+') AS w, regexp_extract_all(t, '[一-龥]{{2,}}') AS runs FROM t),
    g AS (SELECT item_id, w, flatten(list_transform(runs, lambda x: list_concat([x], flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(length(x) - n + 2, 1)), lambda i: substr(x, i, n))))))) AS g FROM r),
    f AS (SELECT item_id, list_concat(w, list_filter(g, lambda x, i: list_position(g, x) = i)) AS f FROM g)
    SELECT item_id, list_transform(list_sort(list_transform(f, lambda x, i: {{'n': -length(x), 'i': i, 't': x}})), lambda x: x.t) AS tokens FROM f""")
def highlight_tokens(spark, sf_dir):
    """F7; every other question with hyphens, repeated words, numbers and CJK runs added."""
    text = F.when(F.col("item_id") % 2 == 0, F.concat("text", F.lit(_MARKED))).otherwise(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", X.highlight_tokens(text).alias("tokens"))


_WIDE_SQL = r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FFEF}]"
_WIDTH_TAILS = ("", "ｱｲ﹐ 中文㐀", "…\U0001f600カ￦", "가ㄱ豈")


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text || list_extract(['{_WIDTH_TAILS[0]}', '{_WIDTH_TAILS[1]}', '{_WIDTH_TAILS[2]}', '{_WIDTH_TAILS[3]}'], CAST(doc_id % 4 AS INTEGER) + 1) END AS t FROM documents),
    n AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[一-鿿]')) AS c FROM t)
    SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE greatest(1, floor(c + (n - c) / 4.0 + 0.5)) END AS BIGINT) AS rough, CAST(n + len(regexp_extract_all(t, '{_WIDE_SQL}')) AS BIGINT) AS width FROM n""")
def rough_tokens_width(spark, sf_dir):
    """F8, F9; with wide, half-width and compatibility characters, and some empty texts."""
    text = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat("text", F.get(F.array(*(F.lit(x) for x in _WIDTH_TAILS)), (F.col("doc_id") % 4).cast("int"))))
    return read(spark, sf_dir, "documents").select("doc_id", X.rough_tokens(text).alias("rough"), X.display_width(text).alias("width"))


_BLANK_SQL = r"[ \t\n\x0b\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@query(rf"""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '. ' || url || chr(127) || chr(8203) || 'x' || chr(12288) || chr(7) || 'y.' WHEN 2 THEN ' .' || chr(65279) || ' ?.' ELSE repeat(url || ' ', 5) END AS name FROM pages),
    c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '[\x00-\x1F\x7F\\/:*?"<>|]', ' ', 'g'), '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{A0}}\x{{3000}}]', ' ', 'g'), '{_BLANK_SQL}', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM n)
    SELECT page_id, left(CASE WHEN name = '' THEN 'page-' || page_id ELSE name END, 80) AS filename FROM c""")
def safe_filename(spark, sf_dir):
    """F12, S16; names with control, zero-width and wide characters, with nothing left, and too long."""
    url, kind = F.col("url"), F.col("page_id") % 4
    name = F.when(kind == 0, url).when(kind == 1, F.concat(F.lit(". "), url, F.lit("\x7f\u200bx\u3000\x07y."))).when(kind == 2, F.lit(" .\ufeff ?.")).otherwise(F.repeat(F.concat(url, F.lit(" ")), 5))
    return read(spark, sf_dir, "pages").select("page_id", X.safe_filename(name, F.concat(F.lit("page-"), "page_id")).alias("filename"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(chr(160) || left(text, 200) || chr(8203) || chr(8233) || chr(12288) || chr(11) || ' .' || chr(65279) || ' ', '[\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '{_BLANK_SQL}', ' ', 'g') AS text FROM documents""")
def clean_inline(spark, sf_dir):
    """beginnings of documents between spaces of all kinds."""
    return read(spark, sf_dir, "documents").select("doc_id", X.clean_inline(F.concat(F.lit("\u00a0"), F.substring("text", 1, 200), F.lit("\u200b\u2029\u3000\x0b .\ufeff "))).alias("text"))


@query("""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS BIGINT) WHEN 2 THEN o_orderkey * 1000 WHEN 3 THEN o_orderkey * 1000003 + 950000 ELSE o_orderkey * 5000000 + 999999 END AS n FROM orders),
    d AS (SELECT o_orderkey, n, CASE WHEN n < 1000 THEN '' WHEN n < 1000000 THEN CAST((n * 20 + 1000) // 2000 // 10 AS VARCHAR) || '.' || (n * 20 + 1000) // 2000 % 10
        WHEN n < 1000000000 THEN CAST((n * 200 + 1000000) // 2000000 // 100 AS VARCHAR) || '.' || lpad(CAST((n * 200 + 1000000) // 2000000 % 100 AS VARCHAR), 2, '0') ELSE CAST((n * 200 + 1000000000) // 2000000000 // 100 AS VARCHAR) || '.' || lpad(CAST((n * 200 + 1000000000) // 2000000000 % 100 AS VARCHAR), 2, '0') END AS t FROM n)
    SELECT o_orderkey, CASE WHEN n IS NULL THEN '—' WHEN n < 1000 THEN CAST(n AS VARCHAR) ELSE rtrim(rtrim(t, '0'), '.') || CASE WHEN n < 1000000 THEN 'K' WHEN n < 1000000000 THEN 'M' ELSE 'B' END END AS shown FROM d""")
def human_counts(spark, sf_dir):
    """F26."""
    k = F.col("o_orderkey").cast("long")
    n = F.when(k % 5 == 1, F.col("o_custkey").cast("long")).when(k % 5 == 2, k * 1000).when(k % 5 == 3, k * 1000003 + 950000).when(k % 5 == 4, k * 5000000 + 999999)
    return read(spark, sf_dir, "orders").select("o_orderkey", X.human_count(n).alias("shown"))


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'k' || c_custkey ELSE 'sk-' || c_name || '-' || c_custkey END AS k FROM customer)
    SELECT c_custkey, 'sha256:' || left(sha256(k), 16) AS key, sha256(k) AS key_hash, left(k, 12) AS key_prefix, CASE WHEN c_custkey % 2 = 0 THEN left(k, 12) || '…' WHEN length(k) <= 12 THEN k ELSE left(k, 8) || '…' || right(k, 4) END AS shown FROM k""")
def key_columns(spark, sf_dir):
    """what is stored of keys, and how those with and without a stored prefix are shown."""
    i = F.col("c_custkey")
    key = F.when(i % 3 == 0, F.concat(F.lit("k"), i)).otherwise(F.concat(F.lit("sk-"), "c_name", F.lit("-"), i))
    c = read(spark, sf_dir, "customer").select("c_custkey", key.alias("k"), X.key_columns(key).alias("x"))
    return c.select("c_custkey", "x.*", X.key_preview(F.col("k"), F.when(i % 2 == 0, F.col("x.key_prefix"))).alias("shown"))


_CODES = ("A0202", "-10001", "-30002", "-60002", "-60018", "404", "429", "503", "401", "200", "none of these", "-60003")
_WAITS = ("5", "0", "1e1", "31", "-1", "soon", "", " 7.5 ", "Mon, 01 Jan 2024 00:00:20 GMT", "Mon, 01 Jan 2024 00:05:00 GMT", "Sun, 31 Dec 2023 23:59:00 GMT")


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 12 THEN NULL ELSE {list(_CODES)}[CAST(event_id % 13 AS INTEGER) + 1] END AS code, {list(_WAITS)}[CAST(event_id % 11 AS INTEGER) + 1] AS header FROM events),
    c AS (SELECT *, CASE WHEN code IN ('A0202', 'A0211', '401') THEN 'MINERU_AUTH' WHEN code IN ('-30001', '-30002', '-30003') THEN 'MINERU_AGENT_LIMIT' WHEN code = '-60002' THEN 'MINERU_BAD_FILE' WHEN code IN ('-60004', '-60005', '-60006', '-60017', '-60018', '-60019') THEN 'MINERU_QUOTA' WHEN code IN ('400', '403', '404') THEN 'MINERU_API' END AS class FROM e)
    SELECT event_id, class, class IS NULL AS retryable, CAST(CASE WHEN try_cast(trim(header) AS DOUBLE) >= 0 THEN least(try_cast(trim(header) AS DOUBLE) * 1000, 30000)
        WHEN header LIKE '%GMT' THEN least(greatest(epoch_ms(strptime(header, '%a, %d %b %Y %H:%M:%S GMT')) - epoch_ms(TIMESTAMP '2024-01-01'), 0), 30000) END AS BIGINT) AS wait_ms FROM c""")
def retry_policies(spark, sf_dir):
    """classes of error codes, and what Retry-After headers say on the first of January 2024."""
    at = lambda values, n: F.get(F.array(*(F.lit(x) for x in values)), (F.col("event_id") % n).cast("int"))
    code = at(_CODES, 13)
    now = F.timestamp_seconds(F.lit(1_704_067_200))
    return read(spark, sf_dir, "events").select("event_id", K.error_class(code).alias("class"), K.is_retryable(code).alias("retryable"), K.retry_after_ms(at(_WAITS, 11), now).alias("wait_ms"))


_FIRST_SQL = r"""regexp_extract(html, '(?is)<{0}(?:\s(?:[^>''"]|''[^'']*''|"[^"]*")*)?>(.*?)</{0}\s*>', 1)"""
_ZERO_WIDTH_SQL = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


@query(rf"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, '<title>', '<TITLE lang="x" data-t=''>''>  '), '<h1>', '<h1 class="a b"> <em>x</em>&nbsp;') ELSE replace(replace(html, '<title>', '<title>&lt;b&gt; '), '<h1>', '<!-- <h1>no</h1> --><h1>') END AS html FROM pages),
    t AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<!>', 'g') AS html FROM p),
    h AS (SELECT page_id, [{_FIRST_SQL.format("title")}, {_FIRST_SQL.format("h1")}] AS said FROM t),
    d AS (SELECT page_id, list_transform(said, lambda x: {sql.html_text("x")}) AS said FROM h, ({sql.REFERENCES})),
    c AS (SELECT page_id, list_transform(said, lambda x: trim(regexp_replace(regexp_replace(x, '{_ZERO_WIDTH_SQL}', '', 'g'), '{_BLANK_SQL}', ' ', 'g'), ' ')) AS said FROM d)
    SELECT page_id, said[1] AS title, said[2] AS h1 FROM c""")
def html_title(spark, sf_dir):
    """Pages as they are, with attributes and elements within, and with references and a heading in a comment."""
    html, kind = F.col("html"), F.col("page_id") % 3
    put = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    marked = F.when(kind == 1, put(put(html, "<title>", "<TITLE lang=\"x\" data-t='>'>  "), "<h1>", '<h1 class="a b"> <em>x</em>&nbsp;')).when(kind == 2, put(put(html, "<title>", "<title>&lt;b&gt; "), "<h1>", "<!-- <h1>no</h1> --><h1>")).otherwise(html)
    return html_markdown.page_titles(read(spark, sf_dir, "pages").select("page_id", marked.alias("html")))


@query("""WITH r AS (SELECT user_id AS kb, event_id AS run_id, ts, CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS status, value FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY kb, status = 'running' ORDER BY ts DESC, run_id DESC) AS n FROM r)
    SELECT kb, run_id, CAST(row_number() OVER (PARTITION BY kb ORDER BY ts DESC, run_id DESC) AS INTEGER) AS position, status, CASE WHEN status = 'done' THEN round(value / 500, 4) END AS hit_rate FROM k WHERE status = 'running' OR n <= 20""")
def test_run_history(spark, sf_dir):
    """The runs of each knowledge base from the newest, all that go on and the last 20 that ended, with the hit rate of those that are done."""
    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "error", "error").otherwise("done")
    runs = e.select(F.col("user_id").alias("kb"), F.col("event_id").alias("run_id"), "ts", state.alias("status"), (F.col("value") / 500).alias("hit_rate"))
    return T.run_history(runs).select("kb", "run_id", "position", "status", F.round("hit_rate", 4).alias("hit_rate"))


_DOMAIN = ["signup", "error", "click", "view", "purchase", "cancelled", "retrying"]


@query("SELECT event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['signup', 'error', 'click', 'view', 'purchase', 'cancelled', 'retrying']) AS event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def status_counts_filled(spark, sf_dir):
    """A2, A4, A5, A21, K12."""
    return T.filled_counts(read(spark, sf_dir, "events"), "event_type", _DOMAIN)


@query("SELECT engine, n, round(100.0 * n / sum(n) OVER (), 4) AS pct FROM (SELECT coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), 'pending') AS engine, count(*) AS n FROM documents GROUP BY 1)")
def engine_distribution(spark, sf_dir):
    """An empty engine counts as pending; shares of all."""
    engine = F.coalesce(F.nullif(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.lit("")), F.lit("pending"))
    n = read(spark, sf_dir, "documents").groupBy(engine.alias("engine")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.join(F.broadcast(total)).select("engine", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


@query("SELECT CASE WHEN n_chars < 100 THEN '0-100' WHEN n_chars < 1000 THEN '100-1k' WHEN n_chars < 5000 THEN '1k-5k' WHEN n_chars < 20000 THEN '5k-20k' ELSE '20k+' END AS bin, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def size_histogram(spark, sf_dir):
    """Half-open bins."""
    c = F.col("n_chars")
    bin_ = F.when(c < 100, "0-100").when(c < 1000, "100-1k").when(c < 5000, "1k-5k").when(c < 20000, "5k-20k").otherwise("20k+")
    return read(spark, sf_dir, "documents").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source AS kb, count(*) AS documents, CAST(round(avg(n_chars)) AS BIGINT) AS avg_size, CAST(sum(n_chars) AS BIGINT) AS total, max(doc_id) AS newest FROM documents GROUP BY 1")
def kb_summary(spark, sf_dir):
    """Counts, sums and rounded means per knowledge base."""
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("n_chars")).cast("long").alias("avg_size"), F.sum("n_chars").alias("total"), F.max("doc_id").alias("newest"))


def _trend_sql(width: int, buckets: int) -> str:
    return f"WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT CAST(floor((epoch_us(now) - epoch_us(ts)) / ({width} * 1000000.0)) AS INTEGER) AS bucket, event_type FROM events, m), c AS (SELECT bucket, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM e GROUP BY 1) SELECT CAST(b AS INTEGER) AS bucket, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM range({buckets}) r(b) LEFT JOIN c ON bucket = b"


@query(_trend_sql(3600, 24))
def throughput_trend(spark, sf_dir):
    """The last 24 hours, hour by hour back from the latest event."""
    e = _with_now(_events(spark, sf_dir))
    return T.rolling_trend(e, "ts", F.col("now"), 3600, 24, {"completed": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"})


@query(_trend_sql(86400, 30))
def growth_trend(spark, sf_dir):
    """30 days."""
    e = _with_now(_events(spark, sf_dir))
    return T.rolling_trend(e, "ts", F.col("now"), 86400, 30, {"completed": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"})


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta, round(100.0 * (n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day), 4) AS pct FROM d")
def trend_delta(spark, sf_dir):
    """Days are few, so their window is."""
    d = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))
    return d.select("day", "n", (F.col("n") - before).alias("delta"), F.round(100.0 * (F.col("n") - before) / before, 4).alias("pct"))


@query("SELECT source AS kb, count(*) AS points FROM documents GROUP BY 1 ORDER BY points DESC, kb LIMIT 5")
def leaderboard_top5(spark, sf_dir):
    """T3."""
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb")).agg(F.count(F.lit(1)).alias("points")).orderBy(F.col("points").desc(), "kb").limit(5)


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS orders, coalesce(lines, 0) AS lines FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey")
def recent_with_counts(spark, sf_dir):
    """Counts of grandchildren summed before each join, so that no row is joined twice."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left").select("c_custkey", "c_name", zero("orders"), zero("lines"))


@query("SELECT event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def keep_latest_n(spark, sf_dir):
    """W6."""
    return T.keep_newest(read(spark, sf_dir, "events"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("event_id", "event_type", "ts")


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS kept FROM events, m WHERE NOT ((event_type <> 'error' AND ts < now - INTERVAL 7 DAY) OR (event_type = 'error' AND ts < now - INTERVAL 30 DAY)) GROUP BY 1")
def retention_sweep(spark, sf_dir):
    """D3, K3: 7 days, failures 30."""
    e = _with_now(_events(spark, sf_dir))
    old = lambda days: F.col("ts") < F.col("now") - F.make_interval(days=F.lit(days))
    gone = ((F.col("event_type") != "error") & old(7)) | ((F.col("event_type") == "error") & old(30))
    return T.delete_where(e, gone).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS gone FROM events, m WHERE ts < now - INTERVAL 10 DAY AND event_type IN ('view', 'click') GROUP BY 1")
def log_clean(spark, sf_dir):
    """By age and level."""
    e = _with_now(_events(spark, sf_dir))
    return e.where((F.col("ts") < F.col("now") - F.make_interval(days=F.lit(10))) & F.col("event_type").isin("view", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("gone"))


@query("SELECT event_id, event_type, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR AND contains(lower(props), '5') AND event_type IN ('error', 'view') ORDER BY ts DESC, event_id DESC LIMIT 50")
def oplog_search_page(spark, sf_dir):
    """Contains ignores case, as the reference's store does for ASCII."""
    e = _with_now(_events(spark, sf_dir))
    hit = (F.col("ts") >= F.col("now") - F.make_interval(hours=F.lit(72))) & F.contains(F.lower("props"), F.lit("5")) & F.col("event_type").isin("error", "view")
    return e.where(hit).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT doc_id, source, position FROM (SELECT doc_id, source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents WHERE lang = 'en') WHERE position BETWEEN 41 AND 60")
def doc_list_page(spark, sf_dir):
    """T1, T8, W10."""
    d = read(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "source", "n_chars")
    return T.page(d, [F.col("n_chars").desc(), F.col("doc_id")], 3, 20).select("doc_id", "source", "position")


@query("SELECT doc_id, coalesce(edited > ran, false) AS stale FROM (SELECT d.doc_id, greatest(d.n_chars, l.quality * 5000) AS edited, CASE WHEN l.toxic IS NULL THEN NULL ELSE 2000 END AS ran FROM documents d LEFT JOIN labels l USING (doc_id))")
def stale_cases(spark, sf_dir):
    """The later of two times, nulls aside, is after the last run; never run isn't stale."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    edited, ran = F.greatest("n_chars", F.col("quality") * 5000), F.when(F.col("toxic").isNotNull(), 2000)
    return d.select("doc_id", F.coalesce(edited > ran, F.lit(False)).alias("stale"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_anti_join(spark, sf_dir):
    """J11, ST6."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT source, count(*) AS owned FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1")
def expected_semi_join(spark, sf_dir):
    """J10, J12."""
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("owned"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS stale FROM events, m WHERE (event_type IN ('view', 'click') AND ts < now - INTERVAL 2 MINUTE) OR (event_type = 'error' AND value IS NULL AND ts < now - INTERVAL 10 MINUTE) GROUP BY 1")
def stale_job_reclaim(spark, sf_dir):
    """ST3, P8: without a heartbeat for two minutes, or for ten where there never was one."""
    e = _with_now(_events(spark, sf_dir))
    old = lambda m: F.col("ts") < F.col("now") - F.make_interval(mins=F.lit(m))
    return e.where((F.col("event_type").isin("view", "click") & old(2)) | ((F.col("event_type") == "error") & F.col("value").isNull() & old(10))).groupBy("event_type").agg(F.count(F.lit(1)).alias("stale"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' AND (value IS NULL OR value <= 50) ORDER BY ts, event_id LIMIT 5")
def fifo_claim(spark, sf_dir):
    """The five oldest that are due."""
    e = read(spark, sf_dir, "events")
    return e.where((F.col("event_type") == "signup") & (F.col("value").isNull() | (F.col("value") <= 50))).orderBy("ts", "event_id").limit(5).select("event_id", "ts")


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'active' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def compare_and_set(spark, sf_dir):
    """K7."""
    return T.compare_and_set(read(spark, sf_dir, "events"), "event_type", "view", "active", F.col("user_id") % 3 == 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k AS key, json_type(props, '$.' || k) AS kind, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2")
def payload_json_types(spark, sf_dir):
    """Types of a payload's fields."""
    e = read(spark, sf_dir, "events")
    field = e.select("props", F.explode(F.json_object_keys("props")).alias("key"))
    value = F.from_json(F.col("props"), "map<string,variant>")[F.col("key")]
    kind = F.schema_of_variant(value)
    named = F.when(kind == "BIGINT", "UBIGINT").when(kind == "STRING", "VARCHAR").when(kind == "VOID", "NULL").when(kind == "BOOLEAN", "BOOLEAN").when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").otherwise("DOUBLE")
    return field.select("key", named.alias("kind")).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 100 = 0")
def upsert_points(spark, sf_dir):
    """K2: rows of known ids are replaced, others added."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    rows = e.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).unionByName(e.where("vec_id % 100 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return T.upsert(e, rows, "vec_id")


@query("SELECT d.doc_id, d.source, CASE WHEN l.quality = 0 THEN 'off' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def patch_payload(spark, sf_dir):
    """K4, C17."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return T.patch(d, read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("off").alias("lang")), "doc_id", ["lang"])


@query("SELECT o_orderstatus, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1")
def cascade_delete(spark, sf_dir):
    """K6: customers go, their orders with them, and these orders' lines."""
    gone = read(spark, sf_dir, "customer").where("c_custkey % 10 = 0")
    orders = T.cascade(read(spark, sf_dir, "orders"), gone, "o_custkey", "c_custkey").select("o_orderkey", "o_orderstatus")
    return read(spark, sf_dir, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("lines"))


# Lines of documents stand for layout blocks, and windows of 700 characters for chunks.
_BLOCKS = "b AS (SELECT doc_id, i - 1 AS idx, l, CAST(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)) AS BIGINT) AS s FROM (SELECT doc_id, lines, unnest(lines) AS l, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))), blocks AS (SELECT doc_id, idx, coalesce(s, 0) AS b_start, coalesce(s, 0) + length(l) AS b_end FROM b), chunks AS (SELECT doc_id, CAST(c AS BIGINT) AS c_start, CAST(least(c + 700, length(text)) AS BIGINT) AS c_end FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 700)) AS c FROM documents))"


def _blocks(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines.withColumn("b_start", start).select("doc_id", "idx", "b_start", (F.col("b_start") + F.length("line")).alias("b_end"))


def _chunks(spark, sf_dir):
    n = F.length("text").cast("long")
    d = read(spark, sf_dir, "documents").select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(700).cast("long"))).alias("c_start"))
    return d.select("doc_id", "c_start", F.least(F.col("c_start") + 700, F.col("n")).alias("c_end"))


@query(f"WITH {_BLOCKS} SELECT doc_id, c_start, count(*) AS n_blocks, CAST(arg_min(idx, b_start) AS INTEGER) AS first_block, CAST(arg_max(idx, b_start) AS INTEGER) AS last_block FROM chunks JOIN blocks USING (doc_id) WHERE b_start < c_end AND b_end > c_start GROUP BY 1, 2")
def layout_overlap_join(spark, sf_dir):
    """J7, C11, W7."""
    pairs = T.overlaps(_chunks(spark, sf_dir), _blocks(spark, sf_dir), "doc_id")
    return pairs.groupBy("doc_id", "c_start").agg(F.count(F.lit(1)).alias("n_blocks"), F.min_by("idx", "b_start").alias("first_block"), F.max_by("idx", "b_start").alias("last_block"))


@query(f"WITH {_BLOCKS}, two AS (SELECT doc_id, c_start, c_end FROM chunks UNION ALL SELECT doc_id, CAST(0 AS BIGINT), max(c_end) FROM chunks WHERE c_start < 1400 GROUP BY 1) SELECT doc_id, c_start, c_end, max(c_end) OVER (PARTITION BY doc_id ORDER BY c_start, c_end ROWS UNBOUNDED PRECEDING) AS reached FROM two")
def prefix_max_end(spark, sf_dir):
    """Windows, and one over the first two of a document."""
    c = _chunks(spark, sf_dir)
    two = c.unionByName(c.where("c_start < 1400").groupBy("doc_id").agg(F.lit(0).cast("long").alias("c_start"), F.max("c_end").alias("c_end")))
    return T.reached(two, "doc_id").select("doc_id", "c_start", "c_end", "reached")


@query(f"WITH {_BLOCKS}, two AS (SELECT * FROM chunks UNION ALL SELECT doc_id, CAST(0 AS BIGINT), max(c_end) FROM chunks GROUP BY 1) SELECT doc_id, CAST(idx AS INTEGER) AS idx, c_start, c_end FROM blocks JOIN two USING (doc_id) WHERE b_start < c_end AND b_end > c_start AND c_start <= b_start QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY c_end - c_start, c_start) = 1")
def narrowest_cover(spark, sf_dir):
    """Windows and the whole document both cover a line; the window is narrower."""
    c = _chunks(spark, sf_dir)
    two = c.unionByName(c.groupBy("doc_id").agg(F.lit(0).cast("long").alias("c_start"), F.max("c_end").alias("c_end")))
    return T.narrowest_cover(T.overlaps(two, _blocks(spark, sf_dir), "doc_id"), ["doc_id", "idx"]).select("doc_id", "idx", "c_start", "c_end")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 30 AND l_quantity + 5 >= 20")
def search_page_overlap_filter(spark, sf_dir):
    """Pages [q, q + 5] meet [20, 30]."""
    return read(spark, sf_dir, "lineitem").where((F.col("l_quantity") <= 30) & (F.col("l_quantity") + 5 >= 20)).select("l_orderkey", "l_linenumber")


@query(f"WITH {_BLOCKS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(CASE WHEN b_start >= 50 THEN b_start - 30 WHEN b_start > 10 THEN 10 ELSE b_start END AS BIGINT) AS a, CAST(CASE WHEN b_end >= 50 THEN b_end - 30 WHEN b_end > 10 THEN 20 ELSE b_end END AS BIGINT) AS b FROM blocks")
def splice_shift(spark, sf_dir):
    """Characters 10 to 50 become 10 others."""
    b = _blocks(spark, sf_dir).select("doc_id", "idx", F.col("b_start").alias("a"), F.col("b_end").alias("b"))
    return T.splice(b, F.lit(10), F.lit(50), F.lit(10))


@query("SELECT user_id, event_type AS last_type, n FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_state(spark, sf_dir):
    """ST2, ST9: the state after the last event of each user."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(list_extract([2000, 8000, 30000], CAST(least(greatest(event_id % 5, 1), 3) AS INT)) AS BIGINT) AS retry_ms, CAST(least(60000, 5000 * power(2, least(event_id % 6, 4))) AS BIGINT) AS probe_ms, CAST(least(greatest(floor(value * 100), 64), 8192) AS BIGINT) AS max_tokens, floor(value * 10 + 0.5) / 10 AS rounded FROM events")
def scalar_policies(spark, sf_dir):
    """F18, F20, F21, F22, P3."""
    return read(spark, sf_dir, "events").select("event_id", X.retry_backoff_ms(F.col("event_id") % 5).alias("retry_ms"), X.probe_backoff_ms(F.col("event_id") % 6).alias("probe_ms"), X.clamp(F.col("value") * 100, 64, 8192).alias("max_tokens"), X.js_round(F.col("value"), 1).alias("rounded"))


@query("SELECT count(*) AS n, CAST(coalesce(sum(length(props)), 0) + 120 * count(*) AS BIGINT) AS bytes FROM events")
def log_footprint(spark, sf_dir):
    """A15, P14."""
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(F.length("props")), F.lit(0)) + 120 * F.count(F.lit(1))).alias("bytes"))


@query("SELECT doc_id, CAST(f AS BIGINT) AS page_from, CAST(least(f + 199, n) AS BIGINT) AS page_to FROM (SELECT doc_id, n, unnest(range(1, n + 1, 200)) AS f FROM (SELECT doc_id, greatest(n_chars, 1) AS n FROM documents))")
def part_split_plan(spark, sf_dir):
    """Pages in parts of 200."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.greatest("n_chars", F.lit(1)).alias("n"))
    return d.select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(200).cast("long"))).alias("page_from")).select("doc_id", "page_from", F.least(F.col("page_from") + 199, "n").alias("page_to"))


@query("SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM conversations")
def multipart_offsets(spark, sf_dir):
    """Where each part begins once parts are joined by blank lines."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long").alias("char_offset"))


@query("SELECT conv_id, min(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) AS state, count(*) FILTER (role = 'assistant') || '/' || count(*) AS label FROM conversations GROUP BY 1")
def multipart_status(spark, sf_dir):
    """The state of the most urgent part, and how many are done."""
    order = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(order).alias("state"), F.concat_ws("/", F.count_if(F.col("role") == "assistant"), F.count(F.lit(1))).alias("label"))
