"""Differences of versions against the table of lengths, at sizes at which that table can't be kept."""

import json
import random
import time
from collections import Counter

import pytest
from conftest import SF

from quarrymill.operators import versions as V
from quarrymill.plans import documents


def _by_table(a, b):
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i] == b[j] else max(length[i + 1][j], length[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_anchors_are_those_of_the_table():
    r = random.Random(2)
    for _ in range(400):
        kinds = r.choice([1, 2, 3, 20])
        a, b = ([r.choice([None, *map(str, range(kinds))]) for _ in range(r.randint(0, 30))] for _ in range(2))
        assert V.anchors(a, b) == _by_table(a, b)
    assert V.anchors(["p", "s"], ["s", "q", "s"]) == [(1, 0)]


def test_a_long_document(spark):
    r = random.Random(3)
    a = [f"f{r.randint(0, 15_000)}" for _ in range(20_000)]
    b = [x if r.random() < 0.9 else f"g{r.randint(0, 99)}" for x in a if r.random() < 0.95]
    began = time.time()
    found = V.anchors(a, b)
    assert time.time() - began < 20 and len(found) > 16_000 and all(a[i] == b[j] for i, j in found) and found == sorted(set(found))
    frame = lambda x: spark.createDataFrame([(1, k, f, f"text {f}") for k, f in enumerate(x)], "doc_id long, seq int, fingerprint string, text string")
    got = V.diff(frame(a), frame(b)).groupBy("kind").count().collect()
    kinds = {x["kind"]: x["count"] for x in got}
    assert kinds["same"] == len(found) and kinds["same"] + kinds["changed"] + kinds.get("removed", 0) == len(a) and kinds["same"] + kinds["changed"] + kinds.get("added", 0) == len(b)


@pytest.fixture
def version(spark):
    return lambda rows: spark.createDataFrame([(d, k, f, t) for d, k, f, t in rows], "doc_id long, seq int, fingerprint string, text string")


def test_differences_and_their_report(version):
    left = version([(1, k, f, t) for k, (f, t) in enumerate([("A", "a"), ("B", "night"), ("C", "c")])] + [(2, 0, "Z", "z"), (4, 0, None, None)])
    right = version([(1, k, f, t) for k, (f, t) in enumerate([("A", "a"), ("X", "nacht"), ("C", "c"), ("D", "d")])] + [(3, 5, "N", "n"), (4, 3, None, "x")])
    changes = V.diff(left, right)
    got = sorted(map(tuple, changes.collect()), key=str)
    assert got == sorted([(1, "same", 0, 0, 1.0), (1, "changed", 1, 1, 0.25), (1, "same", 2, 2, 1.0), (1, "added", None, 3, None), (2, "removed", 0, None, None), (3, "added", None, 5, None), (4, "same", 0, 3, 1.0)], key=str)
    report = {x.doc_id: json.loads(x.report) for x in V.report_json(changes).collect()}
    assert report[1]["summary"] == {"same": 2, "changed": 1, "added": 1, "removed": 0} and [x["kind"] for x in report[1]["changes"]] == ["changed", "added"] and report[4]["changes"] == []
    assert V.diff(left.limit(0), right.limit(0)).count() == 0


def test_likeness_without_what_both_begin_and_end_with():
    r = random.Random(5)
    by_pairs = lambda a, b: 1.0 if a == b else 0.0 if min(len(a), len(b)) < 2 else 2 * sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values()) / (len(a) + len(b) - 2)
    for _ in range(3000):
        a, b = ("".join(r.choice("abé") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert V.dice(a, b) == by_pairs(a, b)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_000_000))
    assert V.dice(long, long[:500_000] + "x" + long[500_000:]) == by_pairs(long, long[:500_000] + "x" + long[500_000:])


def test_documents_pass_by_one_after_another(spark, version):
    """Differences are computed once, by one pass over sorted rows, wherever a batch ends."""
    r = random.Random(7)
    sides = [{d: [(k * 2, r.choice("ABCD"), r.choice([None, "", "night", "nacht"])) for k in range(r.randint(0, 9))] for d in range(60)} for _ in range(2)]
    left, right = (version([(d, *x) for d, of in side.items() for x in r.sample(of, len(of))]) for side in sides)
    want = []
    for d in range(60):
        a, b = (side[d] for side in sides)
        for kind, i, j in V.steps([x[1] for x in a], [x[1] for x in b]):
            alike = {"same": 1.0, "changed": V.dice(a[i][2] or "", b[j][2] or "") if i is not None and j is not None else None}.get(kind)
            want.append((d, kind, None if i is None else a[i][0], None if j is None else b[j][0], alike))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, V.diff(left, right).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = V.report_json(V.diff(left, right))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") == 1 and "CoGroup" not in plan and "Join" not in plan


def test_counts_of_changes_move_no_text(spark, version):
    left = version([(1, k, f, f"text {f}") for k, f in enumerate("ABCD")] + [(2, 0, "Z", None)])
    right = version([(1, k, f, f"text {f}") for k, f in enumerate("AXCDE")])
    assert {x["kind"]: x["n"] for x in V.summary(V.aligned(left, right)).collect()} == {"same": 3, "changed": 1, "added": 1, "removed": 1}
    assert sorted(map(tuple, V.aligned(left, right).collect()), key=str) == sorted((tuple(x)[:4] for x in V.diff(left, right).collect()), key=str)
    plan = documents.QUERIES["version_diff_summary"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in plan.split("\n") if "MapInArrow" in x]
    assert len(moved) == 1 and "text" not in moved[0] and "Join" not in plan and "CoGroup" not in plan
