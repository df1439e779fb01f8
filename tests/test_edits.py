"""Many edits in one pass against the same edits made one by one, and the cases that docstrings state."""

import random

import pytest

from quarrymill.operators import edits as E
from quarrymill.plans import documents

CHUNK = "doc_id long, chunk_id string, is_parent boolean, char_start int, char_end int, text string, token_count long, text_preview string"
EDIT = "chunk_id string, replacement string"


def _one(md, start, end, own, replacement):
    """One edit of one text: (text, start, end of what went) or None where it has no place."""
    if not (0 <= start < end <= len(md) and md[start:end] == own):
        start = md.find(own) if own else -1
        if start < 0:
            return None
        end = start + len(own)
    if replacement is None:
        n = 0
        while n < 2 and md[end : end + 1] == "\n":
            end, n = end + 1, n + 1
        while end >= len(md) and n < 2 and start > 0 and md[start - 1] == "\n":
            start, n = start - 1, n + 1
    return md[:start] + (replacement or "") + md[end:], start, end


def _one_by_one(md, spans, edits):
    """The text after edits in ascending order, and where the spans (key, a, b) are then; each edit moves what follows it."""
    spans = {k: (a, b) for k, a, b, _ in spans}
    for key, a, b, own, replacement in edits:
        a, b = spans[key]
        done = _one(md, a, b, own, replacement)
        assert done
        md, start, end = done
        added = len(replacement or "")
        move = lambda x, inside: x + added - (end - start) if x >= end else inside if x > start else x
        spans = {k: (move(x, start), move(y, start + added)) for k, (x, y) in spans.items()}
        if replacement is None:
            del spans[key]
        else:
            spans[key] = (start, start + added)
    return md, {k: (min(a, len(md)), min(b, len(md))) for k, (a, b) in spans.items()}


def _run(spark, docs, chunks, edits):
    out = E.apply_edits(spark.createDataFrame(docs, "doc_id long, md string"), spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(edits, EDIT))
    return [sorted(df.collect(), key=str) for df in out]


def test_many_edits_are_the_edits_one_by_one(spark):
    r = random.Random(8)
    docs, chunks, edits, want = [], [], [], {}
    for d in range(60):
        parts, spans, md = [], [], r.choice(["", "\n", "# x\n"])
        for k in range(r.randint(1, 8)):
            own = f"p{k}" + "".join(r.choice("ab é😀\n") for _ in range(r.randint(0, 6))) + "."
            spans.append((f"{d}:{k}", len(md), len(md) + len(own), own))
            md += own + "\n" * r.randint(0, 4)
        parts = [(f"{d}:P{k}", spans[k][1], spans[min(k + 2, len(spans) - 1)][2], None) for k in range(0, len(spans), 3)]
        chosen = [(*s, r.choice([None, "new text\n", "x", "p1 " * 5])) for s in spans if r.random() < 0.5]
        docs.append((d, md))
        chunks += [(d, k, False, a + r.choice([0, 0, 0, 999]), b, own, 1, "old") for k, a, b, own in spans] + [(d, k, True, a, b, "old", 1, "old") for k, a, b, _ in parts]
        edits += [(k, new) for k, _, _, _, new in chosen]
        want[d] = (*_one_by_one(md, spans + parts, chosen), {k for k, *_ in chosen})
    after, rows, log = _run(spark, docs, chunks, edits)
    assert {x.doc_id: x.md for x in after} == {d: w[0] for d, w in want.items()}
    right = {c[1]: c[3] < 900 for c in chunks}
    for x in rows:
        md, spans, touched = want[x.doc_id]
        if right[x.chunk_id]:
            assert (x.char_start, x.char_end) == spans[x.chunk_id]
        if x.is_parent and touched and md != docs[x.doc_id][1]:
            a, b = spans[x.chunk_id]
            assert x.text == (md[a:b] or "old")
    assert sorted(x.chunk_id for x in log) == sorted(k for k, _ in edits) and all(x.patched for x in log)
    assert {x.chunk_id for x in rows} == {k for w in want.values() for k in w[1]}


def test_edits_without_a_place(spark):
    docs = [(1, "AA\n\nBB\n\nCC"), (2, None), (3, "")]
    chunk = lambda d, k, a, b, t, parent=False: (d, k, parent, a, b, t, 1, t)
    chunks = [chunk(1, "a", 0, 2, "AA"), chunk(1, "b", 4, 6, "BB"), chunk(1, "c", 8, 10, "CC"), chunk(1, "p", 0, 10, "AA\n\nBB\n\nCC", True), chunk(1, "lost", 0, 3, "zz"), chunk(1, "over", 1, 6, "A\n\nBB"), chunk(2, "n", 0, 1, "x"), chunk(3, "e", 0, 1, "y"), chunk(4, "none", 0, 1, "w")]
    after, rows, log = _run(spark, docs, chunks, [("b", None), ("lost", "Q"), ("over", "R"), ("c", " 　\t"), ("n", "X"), ("e", "Y"), ("none", "W"), ("p", "no"), ("who", "no"), ("a", "x" * 200_001)])
    assert {x.doc_id: x.md for x in after} == {1: "AR\n\nCC", 2: None, 3: ""}
    assert {x.chunk_id: (x.action, x.patched) for x in log} == {"b": ("delete", False), "lost": ("edit", False), "over": ("edit", True), "c": ("refused", False), "a": ("refused", False), "n": ("edit", False), "e": ("edit", False), "none": ("edit", False)}
    got = {x.chunk_id: (x.char_start, x.char_end, x.text) for x in rows}
    assert "b" not in got and got["c"] == (4, 6, "CC") and got["p"] == (0, 6, "AR\n\nCC") and got["lost"][2] == "Q" and got["n"] == (0, 1, "X") and got["none"] == (0, 1, "W")


def test_the_given_vectors(spark):
    chunks = [(1, k, False, a, a + 2, t, 1, t) for k, a, t in (("a", 0, "AA"), ("b", 4, "BB"), ("c", 8, "CC"))]
    after, rows, _ = _run(spark, [(1, "AA\n\nBB\n\nCC")], chunks, [("b", None)])
    assert after[0].md == "AA\n\nCC" and {x.chunk_id: (x.char_start, x.char_end) for x in rows} == {"a": (0, 2), "c": (4, 6)}
    after, _, _ = _run(spark, [(1, "AA\n\nBB\n\nCC")], chunks, [("b", None), ("c", None)])
    assert after[0].md == "AA"


def test_reverting_brings_the_text_back(spark):
    docs, chunks = [(1, "one\n\ntwo\n\nthree")], [(1, k, False, a, a + len(t), t, 1, t) for k, a, t in (("a", 0, "one"), ("b", 5, "two"), ("c", 10, "three"))]
    d, c = spark.createDataFrame(docs, "doc_id long, md string"), spark.createDataFrame(chunks, CHUNK)
    known = spark.createDataFrame([("c", "the first three")], "chunk_id string, text string")
    edits = spark.createDataFrame([("a", "ONE  more"), ("c", "3"), ("b", "2\n2")], EDIT)
    kept = E.backups(known, c, edits)
    assert {x.chunk_id: x.text for x in kept.collect()} == {"a": "one", "b": "two", "c": "the first three"}
    d2, c2, _ = E.apply_edits(d, c, edits)
    assert d2.first().md == "ONE  more\n\n2\n2\n\n3" and {x.text_preview for x in c2.collect()} == {"ONE more", "2 2", "3"}
    d3, c3, _ = E.apply_edits(d2, c2, E.reverting(kept, spark.createDataFrame([("a",), ("b",), ("zz",)], "chunk_id string")))
    assert d3.first().md == "one\n\ntwo\n\n3" and {x.chunk_id: (x.char_start, x.char_end) for x in c3.collect()} == {"a": (0, 3), "b": (5, 8), "c": (10, 11)}


@pytest.mark.parametrize("empty", [0, 1])
def test_no_edits(spark, empty):
    after, rows, log = _run(spark, [(1, "x")][empty:], [(1, "a", False, 0, 1, "x", 1, "x")][empty:], [])
    assert (len(after), len(rows), len(log)) == (1 - empty, 1 - empty, 0)


def test_lines_are_cut_without_their_text_beside_each(spark, tmp_path):
    texts = ["", "\n", "a\nb\na\n", "x", None, "ab\na\n\nab\né😀\n😀", "\n".join(f"line {n % 40}" for n in range(500))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    _, chunks, edits = documents._line_chunks(spark, str(tmp_path))
    want, asked = {}, {}
    for d, md in enumerate(texts):
        at, lines = 0, [] if md is None else md.split("\n")
        for k, t in enumerate(lines):
            off = 3 if (d + k) % 3 == 0 and md.find(t) == at else 0
            want[f"{d}:{2 * k}"] = (at + off, at + len(t) + off, t)
            start = want.get(f"{d}:{k // 4 * 2 + 1}", (at,))[0]
            want[f"{d}:{k // 4 * 2 + 1}"] = (start, at + len(t), "old")
            if (d + k) % 11 == 5 or (d + k) % 7 == 3:
                asked[f"{d}:{2 * k}"] = None if (d + k) % 11 == 5 else "new " + t[:10]
            at += len(t) + 1
    assert {x.chunk_id: (x.char_start, x.char_end, x.text) for x in chunks.collect()} == want
    assert {x.chunk_id: x.replacement for x in edits.collect()} == asked
    for df in (chunks, edits):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "posexplode" not in plan
