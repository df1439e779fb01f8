"""The numbered queries over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, fill_middle, filter_audit, minhash, pieces, quality, repeats, secret_scan, sharding, substrings, topk, toxicity, wrappers


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for each whose id is divisible by 50, by integer inner products; null vectors and those with null or non-finite components take no part, ties go to the smaller id, an empty table gives no rows."""
    return topk.self_top_k(_read(spark, sf_dir, "embeddings"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, those in benchmark windows, and its items; null texts have no words, items without words no windows, and rows that repeat an id are each judged by their own text."""
    documents, _ = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return documents.drop("text_key")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, groups of equal texts together unless one is over its fair share; null texts have size 1."""
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of two-word shingles and its component at a Jaccard similarity of 0.8; texts without words are linked with nothing, equal texts always."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by importance resampling towards those labelled 1; see quality.resample for ties, nulls and tables without labels."""
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text, with its length and as text: a cut may leave half a character at its ends, for which U+FFFD stands there; kept_sha256 is of the bytes themselves."""
    cut = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), left.alias("kept_text"))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's best pieces, the other segmentations of its n best, and the hash of the text that the pieces write."""
    done = pieces.encode_and_decode(_read(spark, sf_dir, "documents"))
    return done.withColumn("decoded_sha256", F.sha2("text", 256)).drop("text")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's spans of the fixed patterns and of random tokens; a null text has none, an empty table gives no rows."""
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    counts = [secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.digest(base), 256).alias("base_sha256"), secret_scan.digest(spans).alias("spans"))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page by its marks or its host's wrapper; null html gives an empty text, null urls share one host."""
    return wrappers.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, from 0 to 1, by a model of the labelled ones that aren't held out; null and empty texts have the score of no words, and without labels of both kinds all score 0."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.training_rows(docs, _read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's counts for every order of the five filters and every step; a null source is the empty string, null texts are empty, and labels that an id lacks are 0."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text's words without those of 13-word windows that a document with a smaller id has; null texts have no words."""
    left = substrings.remove_earlier(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and hashes of each text's fill-in-middle output and of the text rebuilt from it; a null text is empty and plain."""
    made = fill_middle.transform(_read(spark, sf_dir, "documents"))
    rebuilt = fill_middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_pieces, op2_secrets, op3_topk, op4_decontaminate, op5_sharding, op6_minhash, op7_quality, op8_repeats, op9_wrappers, op10_toxicity, op11_filters, op12_substrings, op13_fill_middle)}

ORACLES = {
    "op11_filters": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        first_of AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY 1),
        lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
        fails AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
                  || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END)
                  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS f
                  FROM d LEFT JOIN first_of USING (t) LEFT JOIN lab ON lab.doc_id = d.doc_id),
        n AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
        o AS (SELECT '' AS done UNION ALL SELECT done || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(done, x)),
        steps AS (SELECT done AS filter_order, step, done[step] AS filter, done[1 : step - 1] AS before FROM (SELECT done, unnest(range(1, 6)) AS step FROM o WHERE length(done) = 5)),
        rows AS (SELECT part, filter_order, step, filter,
                 sum(CASE WHEN regexp_matches(f, '[' || before || filter || ']') THEN 0 ELSE n END) AS kept,
                 sum(CASE WHEN contains(f, filter) AND (before = '' OR NOT regexp_matches(f, '[' || before || '-]')) THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN contains(f, filter) AND before <> '' AND regexp_matches(f, '[' || before || '-]') THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN f = filter THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN contains(f, filter) AND (before = '' OR NOT regexp_matches(f, '[' || before || '-]')) THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN contains(f, filter) AND (before = '' OR NOT regexp_matches(f, '[' || before || '-]')) THEN toxic ELSE 0 END) AS toxic_lost
                 FROM n, steps GROUP BY 1, 2, 3, 4)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
            CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM rows
    """,
    "op12_substrings": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        first_of AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY 1),
        gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first_of USING (g) WHERE doc_id > first_id) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
            sha256(coalesce(array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p))), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
    """,
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
    "op4_decontaminate": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        occ AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
                FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, i, n FROM occ JOIN win USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op6_minhash": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
                 JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
        reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, link.b AS r FROM reach JOIN link ON reach.r = link.a),
        c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
}
