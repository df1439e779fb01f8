"""Rows repacked for models, and what is done about answers that don't fit."""

import pyarrow as pa
import pytest

from quarrymill.operators import inference as I
from quarrymill.operators import retrieval as R


def test_repacking_keeps_rows_and_order():
    for sizes in ([], [0], [1], [5, 0, 3, 64, 1, 200], [7] * 30):
        at, batches = 0, []
        for n in sizes:
            batches.append(pa.RecordBatch.from_pydict({"x": pa.array(range(at, at + n), pa.int64())}))
            at += n
        got = [b.column("x").to_pylist() for b in I.repacked(iter(batches), 8)]
        assert [x for b in got for x in b] == list(range(at)) and all(len(b) == 8 for b in got[:-1])


def test_embedding_in_batches(spark):
    rows = [(k, None if k % 7 == 0 else "a b a " * (k % 5)) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")

    def load():
        calls = []
        return lambda texts: calls.append(len(texts)) or [[len(calls), len(texts), len(t)] for t in texts]

    got = I.embedded(df, load, "text", size=64).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.id, r.text) for r in got] == rows
    assert [r.vector for r in got] == [None if t is None else [k // 64 + 1, sum(x is not None for _, x in rows[k // 64 * 64 :][:64]), len(t)] for k, t in rows]
    own = {r.id: r.vector for r in I.embedded(df, I.local_embedder(16), "text", dim=16).where("text IS NOT NULL").collect()}
    want = {k: [0.0] * 16 for k in own}
    for r in R.hash_embed_dense(df, "id", "text", 16).where("id IS NOT NULL").collect():
        if r.id in want:
            want[r.id][r.idx] = r.w
    assert all(own[k] == pytest.approx(want[k]) for k in want)
    for bad in (lambda: lambda t: [[1.0]] * (len(t) - 1), lambda: lambda t: [[1.0] * (k + 1) for k in range(len(t))]):
        with pytest.raises(Exception, match="vectors for|a vector of"):
            I.embedded(df, bad, "text").collect()
    assert I.embedded(df.limit(0), load, "text").count() == 0


def test_reranking_asks_for_one_query_at_a_time(spark):
    rows = [(q, i, f"t{q} {i}" if i % 3 else None, i) for q in range(5) for i in range(q * 4)]
    candidates, queries = spark.createDataFrame(rows, "query_id long, id long, text string, rank int"), spark.createDataFrame([(q, f"q{q}") for q in range(5)], "query_id long, query string")
    seen = {}
    for r in I.reranked(candidates, queries, lambda: lambda query, texts: [int(query[1:]) * 100 + len(texts) for _ in texts], size=6).collect():
        seen.setdefault(r.query_id, []).append(r.score)
    assert {q: sorted(s) for q, s in seen.items()} == {q: sorted(q * 100 + min(6, q * 4 - i // 6 * 6) for i in range(q * 4)) for q in range(1, 5)}
    found = {(r.query_id, r.id): r.score for r in I.reranked(spark.createDataFrame([(1, 1, "a b", 1), (1, 2, "b", 2), (1, 3, None, 3)], "query_id long, id long, text string, rank int"), spark.createDataFrame([(1, "A c b b")], "query_id long, query string"), I.local_scorer).collect()}
    assert found == {(1, 1): 2 / 3, (1, 2): 1 / 3, (1, 3): 0.0}
