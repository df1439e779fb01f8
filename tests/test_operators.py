"""Fixed vectors, and small cases worked out by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import chunking as C
from quarrymill.operators import retrieval as R
from quarrymill.operators import tables as T
from quarrymill.operators import versions as V
from quarrymill.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    assert one(spark, X.tokens, "abc中文 中文abc") == ["abc中文", "中", "文", "abc"]
    assert one(spark, X.tokens, "state-of-the-art _foo it's 3.14 v1.2") == ["state-of-the-art", "foo", "it's", "3", "14", "v1", "2"]
    assert one(spark, X.tokens, None) == []
    assert C.count("abc中文 中文abc") == 4


def test_hashes(spark):
    assert one(spark, X.fnv1a, "hello") == 1335831723
    assert one(spark, X.hash16, "hello") == "2cf24dba5fb0a30e"
    assert one(spark, lambda t: X.chunk_id(F.lit("kb1"), F.lit("doc1"), F.lit("0"), t), "hello") == "43a78513-a2cd-5edb-9c80-464b02c4a9be"


def test_text_functions(spark):
    from quarrymill.sources.html_markdown import clean

    cases = {"a\r\n• b\n\n\n\n\nc": "a\n- b\n\n\nc\n", "": "", " \u00a0\n": "", "x\u200by\u3000z": "xy z\n", "**b** 。 c 。": "**b**。 c 。\n", "( **b**": "(**b**\n", "○ \n▫\u2003b": "○\n- b\n", "a \t\nb  ": "a\nb\n"}
    for text, want in cases.items():
        assert one(spark, X.clean_markdown, text) == want == clean(text), repr(text)
    marks = one(spark, X.highlight_tokens, "find 向量检索 now")
    assert set(marks) == {"find", "now", "向量检索", "向量检", "量检索", "向量", "量检", "检索"} and [len(m) for m in marks] == sorted(map(len, marks), reverse=True)
    assert one(spark, X.js_round, -2.5, "double") == -2.0
    assert one(spark, X.display_width, "a中b") == 4
    assert one(spark, X.status_of, "upserting") == "indexing"
    assert one(spark, X.highlight_tokens, "State-of-the-art RAG 2024 中 a RAG x1") == ["State-of-the-art", "RAG", "RAG", "x1"]
    assert {t: one(spark, X.display_width, t) for t in ("ｱｲ﹐", "", "㐀a")} == {"ｱｲ﹐": 6, "": 0, "㐀a": 3}
    assert {t: one(spark, X.rough_tokens, t) for t in ("", None, "a", "中中", "abcdef")} == {"": 0, None: 0, "a": 1, "中中": 2, "abcdef": 2}
    assert one(spark, X.clean_inline, " \u00a0a\u200b\u2028b ") == " a b "
    assert one(spark, lambda n: X.safe_filename(n, F.lit("page")), "\x7f. ..") == "page" and one(spark, X.safe_filename, "a\u200b/\u3000b.") == "a b"
    assert {n: one(spark, X.human_count, n, "long") for n in (None, -5, 999, 1_000, 1_250, 999_950, 1_000_000, 1_234_567, 2_500_000_000)} == {None: "—", -5: "-5", 999: "999", 1_000: "1K", 1_250: "1.3K", 999_950: "1000K", 1_000_000: "1M", 1_234_567: "1.23M", 2_500_000_000: "2.5B"}
    assert one(spark, lambda k: X.key_preview(k, F.lit("")), "sk-1234567890abcd") == "sk-12345…abcd" and one(spark, lambda k: X.key_preview(k, F.lit(None)), "short-key") == "short-key"
    assert one(spark, X.key_columns, "hello").asDict() == {"key": "sha256:2cf24dba5fb0a30e", "key_hash": "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", "key_prefix": "hello"}


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.7, 2)], "query_id int, id string, score double, rank int")
    sparse = spark.createDataFrame([(1, "b", 3.0, 1), (1, "c", 1.0, 2)], "query_id int, id string, score double, rank int")
    assert {r.id: round(r.score, 6) for r in R.rrf(dense, sparse).collect()} == {"b": 0.016261, "a": 0.008197, "c": 0.008065}
    assert {r.id: round(r.score, 6) for r in R.dbsf(dense, sparse).collect()} == {"a": 0.5, "b": 0.0, "c": -0.5}


def test_bm25(spark):
    cand = spark.createDataFrame([(1, 1, "a a b", 1), (1, 2, "b c", 2), (1, 3, "d", 3)], "query_id int, id int, text string, rank int")
    got = R.bm25(cand, spark.createDataFrame([(1, "a b")], "query_id int, query string")).collect()
    assert {r.id: round(r.score, 6) for r in got} == {1: 1.0, 2: 0.295442}


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3), (1, "z", 4)], "query_id int, id string, rank int")
    r = R.evaluate(spark.createDataFrame([(1, "z"), (1, "w")], "query_id int, id string"), hits).first()
    assert (r.hit_rate, r.mrr, r["pass"]) == (0.5, 0.3333, False)


def test_filter_dsl(spark):
    df = spark.range(10)
    spec = {"must": [{"key": "id", "range": {"gte": 2, "lt": 9}}], "must_not": [{"key": "id", "match": {"value": 5}}], "should": [{"key": "id", "match": {"any": [3, 5, 7]}}, {"key": "id", "range": {"gt": 7}}]}
    assert [r.id for r in df.where(R.filter_column(spec)).orderBy("id").collect()] == [3, 7, 8]


def test_blocks_and_sentences():
    md = "# A\n\npara one\nline2\n```py\nx\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |\ntail\n![i](u)\n<table>\n<tr>\n</table> x\nend\n```\nopen"
    got = C.blocks(md)
    assert [b.kind for b in got] == ["heading", "paragraph", "code", "table", "paragraph", "image", "table", "paragraph", "code"]
    assert all(md[b.start : b.end] == b.text for b in got)
    assert [s for _, s in C.sentences("见 v1.2 节。Pi is 3.14. Next e.g. this.")] == ["见 v1.2 节。", "Pi is 3.14.", " Next e.g. this."]


def test_config_clamp():
    c = C.Config(8, 100, 1).clamped()
    assert (c.size, c.overlap, c.parent_size) == (16, 2, 8)


@pytest.mark.parametrize("seed", range(5))
def test_chunk_properties(seed):
    r = random.Random(seed)
    md = "\n".join(r.choice(["# head", "", "word " * r.randint(1, 60) + ".", "```\ncode\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "one. Two three! four?"]) for _ in range(60))
    config = C.Config(32, 4, 100).clamped()
    end = 0
    for group in C.parents(C.blocks(md), config):
        assert group[0].start >= end
        end = group[-1].end
        for c in C.children(group, config):
            assert group[0].start <= c.start < c.end <= group[-1].end and c.tokens <= config.size + config.overlap + 8


def test_version_diff(spark):
    left = [(1, i, f, f * 3) for i, f in enumerate("ABC")]
    right = [(1, i, f, f * 3) for i, f in enumerate("AXCD")]
    schema = "doc_id long, seq int, fingerprint string, text string"
    got = {(r.kind, r.left_seq, r.right_seq) for r in V.diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    assert got == {("same", 0, 0), ("changed", 1, 1), ("same", 2, 2), ("added", None, 3)}
    assert V.dice("night", "nacht") == 0.25


def test_snapshot_is_idempotent(spark):
    history = spark.createDataFrame([], "doc_id long, seq int, token_count long, version int")
    chunks = spark.createDataFrame([(1, 0, 5), (1, 1, 7)], "doc_id long, seq int, token_count long")
    twice = V.snapshot(V.snapshot(history, chunks, 1), chunks, 1)
    assert [(r.chunks, r.tokens) for r in V.listing(twice).collect()] == [(2, 12)]


def test_splice_fixture(spark):
    md, offsets = "AA\n\nBB\n\nCC", [(8, 10), (0, 2)]
    df = spark.createDataFrame(offsets, "a long, b long")
    assert sorted((r.a, r.b) for r in T.splice(df, F.lit(4), F.lit(8), F.lit(0)).collect()) == [(0, 2), (4, 6)] and md[:4] + md[8:] == "AA\n\nCC"


def test_overlap_join_is_brute_force(spark):
    r = random.Random(3)
    chunks = [(d, a, a + r.randint(1, 9_000)) for d in range(3) for a in (r.randint(0, 20_000) for _ in range(30))]
    blocks = [(d, a, a + r.randint(0, 6_000)) for d in range(3) for a in (r.randint(0, 20_000) for _ in range(30))]
    got = T.overlaps(spark.createDataFrame(chunks, "d int, c_start long, c_end long"), spark.createDataFrame(blocks, "d int, b_start long, b_end long"), "d").collect()
    want = [(d, c, e, b, f) for d, c, e in chunks for g, b, f in blocks if d == g and b < e and f > c]
    assert sorted((x.d, x.c_start, x.c_end, x.b_start, x.b_end) for x in got) == sorted(want)


def test_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    assert sorted((r.id, r.v) for r in T.upsert(df, spark.createDataFrame([(2, "B"), (4, "d")], "id int, v string"), "id").where("v is not null").collect()) == [(1, "a"), (2, "B"), (4, "d")]
    assert T.delete_where(df, F.col("v") == "a").count() == 2
    assert {r.v: r.n for r in T.filled_counts(df, "v", ["a", "z"]).collect()} == {"a": 1, "z": 0}


def test_state_machine(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", s, t + dt.timedelta(seconds=i)) for i, s in enumerate(["done"] * 5)] + [("b", "fail", t)] * 3 + [("c", "done", t), ("c", "cancel", t + dt.timedelta(seconds=1))]
    spark.createDataFrame(rows, "doc_id string, signal string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id string, signal string, ts timestamp").parquet(str(tmp_path / "in"))
    q = jobs.state_machine(stream).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    assert q.awaitTermination(60)
    last = {r.doc_id: r.status for r in spark.sql("SELECT * FROM jobs_out").collect()}
    assert last == {"a": "ready", "b": "failed", "c": "cancelled"}


def test_stream_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t + dt.timedelta(minutes=i), "x", 1.0, i % 2) for i in range(180)], "event_id long, ts timestamp, event_type string, value double, user_id int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double, user_id int").parquet(str(tmp_path / "in"))
    for name, out in (("w", jobs.windowed(stream)), ("p", jobs.throttled(stream))):
        out.writeStream.outputMode("complete").format("memory").queryName(f"win_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.sql("SELECT n FROM win_w").collect()) == [60, 60, 60]
    assert spark.sql("SELECT sum(reports) FROM win_p").first()[0] == 180


def test_contracts(spark):
    from quarrymill.functions import contracts as K

    c = one(spark, K.chunk_config, "not json")
    assert (c["size"], c["overlap"], c["parent_size"], c["strategy"], c["protects"]) == (512, 0, 2000, "hybrid", ["code", "table"])
    assert one(spark, K.mime_of, "MD") == "text/markdown" and one(spark, K.mime_of, "zzz") == "application/octet-stream"
    exts = {"text/html; charset=x": "shtml", "image/jpeg": "jpeg", "image/tiff": "tiff", "application/xhtml+xml": "html", "x/pdf": "pdf", "application/msword": "doc", "": ""}
    assert {m: one(spark, K.ext_of, m) for m in exts} == exts
    assert one(spark, K.payload_text, '{"a": "1", "b": "x"}') == "a: 1\nb: x"
    assert one(spark, K.task_handle, "abc")["ids"] == ["abc"] and one(spark, K.task_handle, '{"kind":') is None
    assert one(spark, K.task_handle, '{"kind":"parts","pages":3,"parts":[{"id":"p","from":1,"to":2}]}')["ids"] == ["p"]
    for shape in ('{"indices":[1,2],"values":[0.5,1.0]}', '[{"index":1,"value":0.5},{"index":2,"value":1.0}]', '{"1":0.5,"2":1.0,"3":0}'):
        assert one(spark, K.sparse_field, shape) == {1: 0.5, 2: 1.0}
    for address in ("192.168.1.1", "192.0.2.5", "abc", "1.2", "999.1.1.1", "", None, "::1", "fe80::1", "fd12::", "::ffff:10.0.0.1", "::ffff:a00:1", "::g", "1.2.3.4\n"):
        assert one(spark, K.is_private, address), address
    for address in ("192.169.1.1", "192.0.0.5", "8.8.8.8", "2001:db8::1", "::ffff:8.8.8.8", "::ffff:808:808"):
        assert not one(spark, K.is_private, address), address
    payloads = {'{"text": 5, "content": " ", "chunk": " x "}': " x ", '{"_node_content": "{\\"text\\": \\"in\\"}", "a": "b"}': "in", '{"_a": "x", "c": "d", "n": 1, "b": "e"}': "c: d\nb: e", "[1]": "", "no": ""}
    assert {p: one(spark, K.payload_text, p) for p in payloads} == payloads
    assert {c: one(spark, K.error_class, c) for c in ("503", "404", "-10001", "A0211", "-60019", "zzz", None)} == {"503": None, "404": "MINERU_API", "-10001": None, "A0211": "MINERU_AUTH", "-60019": "MINERU_QUOTA", "zzz": None, None: None}
    now = F.timestamp_seconds(F.lit(1_704_067_200))
    waits = {"5": 5_000, "0": 0, "99": 30_000, "-1": None, "soon": None, "": None, None: None, "Mon, 01 Jan 2024 00:00:07 GMT": 7_000, "Sun, 31 Dec 2023 00:00:00 GMT": 0, "Tue, 02 Jan 2024 00:00:00 GMT": 30_000}
    assert {h: one(spark, lambda x: K.retry_after_ms(x, now), h) for h in waits} == waits
    repeated = {'{"a":"x","a":"y","b":"z"}': "a: y\nb: z", '{"text":"x","text":" "}': "text:  ", '{"text":"x","text":"y"}': "y"}
    assert {p: one(spark, K.payload_text, p) for p in repeated} == repeated
    sparse = {'[[1,0.5],[1,2]]': {1: 2.0}, '[{"index":1,"value":1},{"index":1,"value":2}]': {1: 2.0}, '{"1":1,"1":3}': {1: 3.0}, '{"indices":[2,1],"weights":[1,0]}': {1: 0.0, 2: 1.0}, '[[1,"x"]]': None, "[]": None, "{}": None, "no": None, None: None, '{"indices":[1],"values":[1,2]}': None}
    assert {j: one(spark, K.sparse_field, j) for j in sparse} == sparse
    configs = {'{"strategy":"title"}': ("title", 512), '{"strategy":"heading","size":"64"}': ("hybrid", 512), '{"size":64.9}': ("hybrid", 64), '{"size":1,"size":2}': ("hybrid", 512), "null": ("hybrid", 512), None: ("hybrid", 512)}
    assert {j: (c["strategy"], c["size"]) for j in configs for c in [one(spark, K.chunk_config, j)]} == configs


def test_upserts_of_a_key_in_two_batches(spark, tmp_path):
    from quarrymill.streaming import jobs

    for batch, rows in ((0, [(1, "a"), (2, "b")]), (10, [(1, "c")]), (9, [(1, "d"), (3, None)])):
        spark.createDataFrame(rows, "event_id long, v string").write.parquet(f"{tmp_path}/out/batch={batch}")
    assert sorted((r.event_id, r.v) for r in jobs.upserted(spark, f"{tmp_path}/out").collect()) == [(1, "c"), (2, "b"), (3, None)]


def test_recall_in_passes_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "PASS_QUERIES", 3)
    monkeypatch.setattr(R, "STEP_CELLS", 40)
    r = random.Random(3)
    points = {i: [float(r.randint(-2, 2)) for _ in range(4)] for i in range(120)}
    asked = {i: points[i] for i in range(0, 120, 11)}
    df = spark.createDataFrame([*points.items(), (900, None), (901, [1.0]), (902, [None, 1.0, 1.0, 1.0])], "id long, v array<double>")
    queries = spark.createDataFrame([*asked.items(), (903, None)], "query_id long, qv array<double>")
    score = {(q, i): sum(a * b for a, b in zip(x, v)) for q, x in asked.items() for i, v in points.items() if q != i}
    best = lambda q, k, least: [(i, s) for s, i in sorted(((s, i) for (a, i), s in score.items() if a == q and s >= least), key=lambda x: (-x[0], x[1]))][:k]
    for k, threshold in ((5, None), (5, 0.0), (None, 3.0)):
        got = R.dense_topk(queries, df, k, threshold, skip_self=True).orderBy("query_id", "rank").collect()
        want = [(q, i, s, n + 1) for q in asked for n, (i, s) in enumerate(best(q, k, -99 if threshold is None else threshold))]
        assert [(x.query_id, x.id, x.score, x["rank"]) for x in got] == want
    postings = lambda vectors: spark.createDataFrame([(i, [j for j, x in enumerate(v) if x], [x for x in v if x]) for i, v in vectors.items()], "id long, idx array<long>, w array<double>")
    asking = lambda vectors: postings(vectors).withColumnRenamed("id", "query_id")
    shared = {(q, i): sum(a * b for a, b in zip(x, v)) for q, x in asked.items() for i, v in points.items() if any(a and b for a, b in zip(x, v))}
    want = [(q, i, s, n + 1) for q in asked for n, (s, i) in enumerate(sorted(((s, i) for (a, i), s in shared.items() if a == q), key=lambda x: (-x[0], x[1]))[:4])]
    assert [(x.query_id, x.id, x.score, x["rank"]) for x in R.postings_topk(asking(asked), postings(points), 4).orderBy("query_id", "rank").collect()] == want
    assert R.postings_topk(asking(asked).where("query_id < 0"), postings(points), 4).count() == 0


def test_hash_vectors_are_the_postings(spark):
    rows = [(1, "a b a é 中文 A"), (2, None), (3, ""), (4, "x " * 5_000), (5, "a b a é 中文 A"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc long, text string")
    for dense, postings in ((True, R.hash_embed_dense(docs, "doc", "text", 7)), (False, R.hash_embed_sparse(docs, "doc", "text", 7))):
        want = {(x.id, x.idx, round(float(x.w), 12)) for x in postings.collect()}
        got = R.hash_vectors(docs, "doc", "text", 7, dense).collect()
        assert len(got) == len(rows) and {(x.id, i, round(w, 12)) for x in got for i, w in zip(x.idx, x.w, strict=True)} == want


def test_questions_within_texts(spark):
    texts = ["one two  three four", "xone two three fourx", "two", "a\ttwo three\nb", "", None, "two three four five six", "atwo threeb"]
    asked = ["one two three four", "two", "wo thre", "two three", "one two  three", "", None, "ne two three fou", "three four five", "e four f"]
    got = R.contained(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, i) for q, a in enumerate(asked) for i, t in enumerate(texts) if a and t is not None and a in t)
