"""Snapshots of chunk sets and the differences between two of them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot(history: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
    """Chunks (doc_id, ...) appended as a version, once for each document and number; documents without chunks add nothing."""
    new = chunks.withColumn("version", F.lit(version))
    known = history.select("doc_id", "version").distinct()
    return history.unionByName(new.join(known, ["doc_id", "version"], "left_anti"))


def listing(history: DataFrame) -> DataFrame:
    """Versions with their counts, the newest first."""
    return history.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens")).orderBy("doc_id", F.col("version").desc())


def _shared(a: str, b: str) -> int:
    """How many characters a and b begin with that are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def dice(a: str, b: str) -> float:
    """of the multisets of character pairs. Pairs within what both begin and end with are in both, so only those of the rest are counted."""
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    head = _shared(a, b)
    tail = _shared(a[: head - 1 if head else None : -1], b[: head - 1 if head else None : -1])
    rest = lambda x: x[max(head - 1, 0) : len(x) - max(tail - 1, 0)]
    x, y = (Counter(zip(t, t[1:])) for t in map(rest, (a, b)))
    return 2 * (max(head - 1, 0) + max(tail - 1, 0) + sum((x & y).values())) / (len(a) + len(b) - 2)


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where there is a choice, the left side moves on first.

    Rows of the table of lengths are kept as bits, one for each place of b at which a length doesn't grow, and one row follows from the next
    by a few operations on big integers. Only every so many rows are kept, those between are computed again as the path comes to them:
    20 000 against 20 000 take seconds and some megabytes.
    """
    n, m = len(a), len(b)
    full = (1 << m) - 1
    places: dict[str, int] = {}
    for j, x in enumerate(reversed(b)):
        places[x] = places.get(x, 0) | 1 << j

    def before(row: int, i: int) -> int:
        """The row of a[i:] from that of a[i + 1:]."""
        met = row & places.get(a[i], 0)
        return (row + met | row - met) & full

    step = math.isqrt(n) + 1
    kept = {n: full}
    row = full
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % step == 0:
            kept[i] = row
    common = lambda row, j: m - j - (row & ((1 << m - j) - 1)).bit_count()  # noqa: E731  of what is left of both
    out, i, j, block = [], 0, 0, {}
    while i < n and j < m:
        if i not in block or i + 1 not in block:
            end = min(n, (i // step + 1) * step)
            row, block = kept[end], {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                row = block[k] = before(row, k)
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif common(block[i + 1], j) >= common(block[i], j + 1):
            i += 1
        else:
            j += 1
    return out


def steps(a: list[str], b: list[str]) -> Iterator[tuple[str, int | None, int | None]]:
    """(kind, place in a, place in b) in order: anchors are the same, and what is left over between them is paired in order as changed, the rest removed or added."""
    i, j = 0, 0
    for x, y in [*anchors(a, b), (len(a), len(b))]:
        paired = min(x - i, y - j)
        yield from (("changed", i + k, j + k) for k in range(paired))
        yield from (("removed", k, None) for k in range(i + paired, x))
        yield from (("added", None, k) for k in range(j + paired, y))
        if x < len(a):
            yield "same", x, y
        i, j = x + 1, y + 1


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, kind, left_seq, right_seq, similarity) of two versions (doc_id, seq, fingerprint, text) of documents.

    Equal fingerprints in order are the same; between them, what is left over is paired in order as changed, with the similarity of
    the texts, and the rest is removed or added. Null fingerprints are equal. The rows of both versions are sorted by document and pass
    by one after another, so a task holds those of one document and of one batch; only changed pairs' texts become Python strings.
    """
    return _passed(left, right, ["text"], ", similarity double")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Diff without the similarity, of versions (doc_id, seq, fingerprint): no text is read or moved."""
    return _passed(left, right, [], "")


def _passed(left: DataFrame, right: DataFrame, more: list[str], schema: str) -> DataFrame:
    kind = left.schema["doc_id"].dataType.simpleString()
    both = [x.select("doc_id", F.lit(side).alias("side"), F.col("seq").cast("int").alias("seq"), "fingerprint", *more) for side, x in enumerate((left, right))]
    rows = both[0].unionByName(both[1]).repartition("doc_id").sortWithinPartitions("doc_id", "side", "seq", "fingerprint")
    return rows.mapInArrow(_compare, f"doc_id {kind}, kind string, left_seq int, right_seq int{schema}")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """diff of rows (doc_id, side, seq, fingerprint, text) in order; without texts, aligned."""
    names, kinds = ["doc_id", "kind", "left_seq", "right_seq", "similarity"], [None, pa.string(), pa.int32(), pa.int32(), pa.float64()]
    texts = None
    # Of the document that passes by: seqs, fingerprints and where the texts are, by side.
    doc, own, out = None, (([], [], []), ([], [], [])), [[] for _ in names]

    def end() -> None:
        (a, of_a, at_a), (b, of_b, at_b) = own
        for kind, i, j in steps(of_a, of_b):
            alike = 1.0 if kind == "same" else None
            if kind == "changed" and texts is not None:
                alike = dice(*(column[k].as_py() or "" for column, k in (at_a[i], at_b[j])))
            for to, x in zip(out, (doc, kind, None if i is None else a[i], None if j is None else b[j], alike), strict=True):
                to.append(x)
        for part in (*own[0], *own[1]):
            part.clear()

    def given() -> pa.RecordBatch:
        n = len(names) - (texts is None)
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out[:n], kinds, strict=False)], names[:n])
        for x in out:
            x.clear()
        return batch

    for batch in batches:
        kinds[0] = batch.schema.field("doc_id").type
        texts = batch.column("text") if "text" in batch.schema.names else None
        for k, (of, side, seq, fingerprint) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "side", "seq", "fingerprint")), strict=True)):
            if of != doc:
                end()
                doc = of
            for to, x in zip(own[side], (seq, fingerprint, (texts, k)), strict=True):
                to.append(x)
        if out[0]:
            yield given()
    end()
    if out[0]:
        yield given()


def summary(changes: DataFrame) -> DataFrame:
    """A13."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def report_lines(changes: DataFrame) -> DataFrame:
    """A line of a Markdown report for each change but the same."""
    return changes.where("kind <> 'same'").select("doc_id", F.coalesce("left_seq", "right_seq").alias("at"), F.format_string("- %s: %s → %s", "kind", F.coalesce(F.col("left_seq").cast("string"), F.lit("–")), F.coalesce(F.col("right_seq").cast("string"), F.lit("–"))).alias("line"))


def report_json(changes: DataFrame) -> DataFrame:
    """(doc_id, report) with a JSON document for each: how many changes there are of each kind, and all of them but the same in order. A document's changes become one value, as the reader of a report gets it."""
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    order = F.struct(F.coalesce("left_seq", "right_seq").alias("at"), "kind", "left_seq", "right_seq", F.round("similarity", 4).alias("similarity"))
    listed = F.array_sort(F.collect_list(F.when(F.col("kind") != "same", order)))
    per_doc = changes.groupBy("doc_id").agg(*(n(k) for k in ("same", "changed", "added", "removed")), listed.alias("changes"))
    return per_doc.select("doc_id", F.to_json(F.struct(F.struct("same", "changed", "added", "removed").alias("summary"), "changes"), {"ignoreNullFields": "false"}).alias("report"))
