"""Requests with parameters of their own against hand-made vectors and the cases that docstrings state; search_requests is held to SQL in test_queries."""

import json

import pytest

from quarrymill.operators import retrieval as R
from quarrymill.operators import search as S

NONE = (None,) * 7
VECTORS = {
    "{}": NONE, "[]": NONE, "null": NONE, "3": NONE, "nope": NONE, "": NONE, None: NONE, '{"topK":1,"topK":2}': NONE,
    '{"topK":2.5,"prefetchLimit":2.49,"rrfK":1e9}': (None, 3, 2, None, None, 1000, None),
    '{"topK":-2.5,"prefetchLimit":1e300,"rrfK":0.4}': (None, 1, 200, None, None, 1, None),
    '{"topK":"5","prefetchLimit":true,"rrfK":[1],"rerank":1,"mode":5,"fusion":null}': NONE,
    '{"mode":"dense","fusion":"dbsf","rerank":false,"extra":{"topK":4}}': ("dense", None, None, False, "dbsf", None, None),
    '{"mode":"Dense","fusion":"rrf ","rrfWeights":[1,2,3]}': NONE,
    '{"rrfWeights":[0,-2.5]}': (None, None, None, None, None, None, [0.0, -2.5]),
    '{"rrfWeights":[1,"2"]}': NONE, '{"rrfWeights":{"0":1,"1":2}}': NONE, '{"rrfWeights":[1,null]}': NONE,
}


def test_params_by_hand(spark):
    df = spark.createDataFrame([(k,) for k in VECTORS], "p string")
    got = {r.p: tuple(r.x) for r in df.select("p", S.params(df.p).alias("x")).collect()}
    assert got == VECTORS


REQUEST = "query_id long, query string, params string, doc_ids array<string>, page_from int, page_to int, threshold double"
CHUNK = "id long, doc_id string, text string, parent_text string, page_from int, page_to int, enabled boolean"


@pytest.fixture
def chunks(spark):
    rows = [(i, f"d{i % 3}", t, f"P{i}", i, i + 1, i != 3) for i, t in enumerate(["cat dog", "cat cat fish", "dog", "cat dog fish", None, "", "fish fish bird", "cat dog"])]
    return spark.createDataFrame([*rows, (8, None, "cat", None, None, None, True), (9, "d0", "cat", "P9", 1, 1, None)], CHUNK)


def _found(spark, chunks, *requests, **kw):
    rows = [(q, text, None if p is None else json.dumps(p), *(more or (None,) * 4)) for q, text, p, more in requests]
    out = {}
    for r in S.search(spark.createDataFrame(rows, REQUEST), chunks, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_requests_of_all_kinds_at_once(spark, chunks, monkeypatch):
    calls = []
    once = R.postings_topk
    monkeypatch.setattr(R, "postings_topk", lambda *a: calls.append(a) or once(*a))
    found = _found(
        spark, chunks, (1, "cat", {"mode": "sparse", "topK": 2}, None), (2, "cat dog", {"mode": "dense", "topK": 50}, None), (3, "cat fish", {"mode": "sparse", "rerank": True}, None), (4, "cat", None, (["d0", "d2"], None, None, None)),
        (5, "cat", {"mode": "sparse"}, (None, 1, 1, None)), (6, "cat dog", {"mode": "dense"}, (None, None, None, 0.99)), (7, None, None, None), (8, "", None, None), (9, "zebra", {"mode": "sparse"}, None), (10, "cat", {"mode": "sparse"}, (["nowhere"], None, None, None)),
    )
    assert len(calls) == 2
    ids = {q: [r.id for r in rows] for q, rows in found.items()}
    assert ids[1] == [1, 0] and [r.score for r in found[1]] == [2.0, 1.0] and found[1][0].dense_rank is None
    assert ids[2][:2] == [0, 7] and 3 not in ids[2] and 9 not in ids[2] and all(r.sparse_rank is None for r in found[2])
    assert ids[3][0] == 1 and found[3][0].rerank_score == 1.0 and all(r.rerank_score is not None for r in found[3])
    assert set(ids[4]) == {0} and found[4][0].parent_text == "P0" and found[4][0].doc_id == "d0"
    assert ids[5] == [1, 0] and ids[6] == [0, 7] and not {7, 8, 9, 10} & set(ids)


def test_a_collection_without_sparse_vectors(spark, chunks):
    found = _found(spark, chunks, (1, "cat", {"mode": "sparse", "fusion": "dbsf"}, None), native=False)
    assert found[1][0].id == 8 and all(r.sparse_rank is None and r.dense_rank == r.fused_rank for r in found[1])


def test_no_requests_and_no_chunks(spark, chunks):
    assert S.search(spark.createDataFrame([], REQUEST), chunks).count() == 0
    assert _found(spark, chunks.limit(0), (1, "cat", None, None)) == {}
