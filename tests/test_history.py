"""Versions as intervals against a dictionary of whole snapshots, and the cases that docstrings state."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import history as H

CHUNK = "doc_id long, chunk_id string, seq int, text_preview string, full_text string, token_count long"


@pytest.fixture
def frame(spark):
    return lambda rows, schema=CHUNK: spark.createDataFrame(rows, schema)


def _cut(store):
    """The store, written out, so that plans of many steps stay small."""
    return H.Store(*(df.sparkSession.createDataFrame(df.collect(), df.schema) for df in store))


def _chunk(d, k, text):
    return (d, f"{d}:{k}", k, None if text is None else text[:4], text, None if text is None else len(text))


def _state(rows):
    return sorted(map(tuple, rows), key=str)


def test_versions_are_whole_snapshots(frame):
    r = random.Random(6)
    sets = {d: [_chunk(d, k, f"t{k}") for k in range(r.randint(1, 4))] for d in range(8)}
    store = H.started(frame([c for s in sets.values() for c in s]))
    head, archived = {d: 1 for d in sets}, {}
    for _ in range(4):
        touched = {d: [_chunk(d, k, r.choice([f"t{k}", f"new{r.random()}", "", None])) for k in range(r.randint(1, 5)) if r.random() < 0.8] or [_chunk(d, 0, "z")] for d in sets if r.random() < 0.6}
        store = _cut(H.change(store, frame([c for s in touched.values() for c in s])))
        for d, new in touched.items():
            archived[d, head[d]], sets[d], head[d] = sets[d], new, head[d] + 1
        back = {d: str(r.choice([v for x, v in archived if x == d] or [1])) for d in sets if r.random() < 0.4}
        store, results = H.restore(store, frame(list(back.items()), "doc_id long, version string"))
        got, store = {x.doc_id: x for x in results.collect()}, _cut(store)
        for d, v in back.items():
            if (d, int(v)) not in archived:
                assert got[d].outcome == "missing" and got[d].restored_version is None
                continue
            old = archived[d, int(v)]
            assert (got[d].outcome, got[d].restored_version, got[d].chunk_count, got[d].degraded) == ("restored", head[d] + 1, len(old), sum(not c[4] for c in old))
            assert got[d].stale == len({c[1] for c in sets[d]} - {c[1] for c in old})
            archived[d, head[d]], sets[d], head[d] = sets[d], [(*c[:4], c[4] or c[3], c[5]) for c in old], head[d] + 1
        assert _state(H.current(store).select(*store.rows.columns[:6]).collect()) == _state(c for s in sets.values() for c in s)
        assert {(x.doc_id, x.head) for x in store.heads.collect()} == set(head.items()) and {(x.doc_id, x.version) for x in store.snapshots.collect()} == set(archived)
    read = H.as_of(store, store.snapshots).collect()
    assert _state((x.version, *x[:0], x.doc_id, x.chunk_id, x.seq, x.text_preview, x.full_text, x.token_count) for x in read) == _state((v, *c) for (d, v), s in archived.items() for c in s)
    _check_listing(store, sets, archived)
    gone = [k for k in archived if r.random() < 0.5]
    store = _cut(H.delete(store, frame([*gone, (0, 99)], "doc_id long, version int")))
    for k in gone:
        del archived[k]
    _check_listing(store, sets, archived)
    rows = store.rows.collect()
    assert all(x.valid_to is None or any(d == x.doc_id and x.valid_from <= v < x.valid_to for d, v in archived) for x in rows)


def _check_listing(store, sets, archived):
    got = H.listing(store).orderBy("doc_id", "position").collect()
    want = []
    for d in sorted(sets):
        of = [("current", sets[d])] + [(str(v), archived[d, v]) for v in sorted((v for x, v in archived if x == d), reverse=True)]
        want += [(d, k + 1, v, len(s), sum(c[5] or 0 for c in s), any(c[4] for c in s)) for k, (v, s) in enumerate(of)]
    assert [tuple(x) for x in got] == want


def test_what_is_refused(frame):
    store = H.started(frame([_chunk(1, 0, "a"), _chunk(2, 0, "b"), _chunk(3, 0, "c")]))
    store = store._replace(heads=store.heads.withColumn("status", F.when(F.col("doc_id") == 2, "parsing").otherwise("failed")))
    store = H.change(store, frame([_chunk(1, 0, "A"), _chunk(2, 0, "B"), _chunk(9, 0, "unknown")]))
    assert {x.doc_id: x.full_text for x in H.current(store).collect()} == {1: "A", 2: "b", 3: "c"}
    asked = [(1, "current"), (2, "1"), (3, "0"), (9, "1"), (3, "no")]
    after, results = H.restore(store, frame(asked, "doc_id long, version string"))
    assert {(x.doc_id, x.outcome) for x in results.collect()} == {(1, "current"), (2, "running"), (3, "invalid"), (9, "unknown")}
    assert after.snapshots.count() == 1 and H.changes(after, F.lit(1), F.col("head")).count() == 1


def test_archiving_twice_and_nothing(frame):
    store = H.bump(H.started(frame([_chunk(1, 0, "a")])), frame([(1,), (1,), (7,)], "doc_id long"))
    assert [tuple(x) for x in store.snapshots.collect()] == [(1, 1)] and store.heads.first().head == 2
    again = H.bump(store._replace(heads=store.heads.withColumn("head", F.lit(1))), frame([(1,)], "doc_id long"))
    assert again.snapshots.count() == 1
    empty = H.started(frame([]))
    assert H.listing(empty).count() == 0 and H.restore(empty, frame([], "doc_id long, version string"))[1].count() == 0


def test_listing_moves_no_texts(spark, frame):
    """What a restored store's listing shuffles has no text in it; nor does what tells which versions are whole."""
    store = H.change(H.started(frame([_chunk(1, k, f"t{k}") for k in range(9)] + [_chunk(2, 0, None)])), frame([_chunk(1, 0, "new"), _chunk(2, 0, "x")]))
    after, results = H.restore(store, frame([(1, "1"), (2, "1")], "doc_id long, version string"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for df in (H.listing(after), results):
        said = df._jdf.queryExecution().explainString(mode).split("\n\n")
        moved = [x for x in said if "Exchange\n" in x]
        assert moved and not any("text" in x for x in moved)
    assert [(x.doc_id, x.version, x.chunks, x.has_full_text) for x in H.listing(after).orderBy("doc_id", "position").collect()] == [(1, "current", 9, True), (1, "2", 1, True), (1, "1", 9, True), (2, "current", 1, False), (2, "2", 1, True), (2, "1", 1, False)]


def test_a_store_without_notes(frame):
    noted = H.change(H.started(frame([_chunk(1, 0, "a"), _chunk(1, 1, "b"), _chunk(2, 0, None)])), frame([_chunk(1, 0, "a"), _chunk(1, 1, "B")]))
    plain = noted._replace(rows=noted.rows.drop(*H.NOTES))
    after = [H.restore(s, frame([(1, "1"), (2, "1")], "doc_id long, version string"))[0] for s in (noted, plain)]
    assert _state(H.current(after[0]).collect()) == _state(H.current(after[1]).collect()) == _state([_chunk(1, 0, "a"), _chunk(1, 1, "b"), _chunk(2, 0, None)])
    assert _state(H.listing(after[0]).collect()) == _state(H.listing(after[1]).collect())
