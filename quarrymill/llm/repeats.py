"""Removal of long repeated byte strings, found in run-length (BWT) indexes over the segments that share an anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import bitmap, broadcast_bytes, gram_hashes, in_bitmap, lists, materialize, mix, prefix_sums, reuse_memory, signed, span_hashes, text_slices

LENGTH = 400
GRAM = 128
BUCKET_BYTES = 500_000
HOT_SEGMENTS = 200
HOT_WINDOWS = 200_000
POSITION_BITS = 30
SLICE_BYTES = 1 << 16  # its arrays of eight bytes a byte stay in a core's cache


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, window counts, anchor hashes, prefix sums): the windows of length bytes within each row, in runs that share an anchor.

    A window's anchor is its least-hashed gram, the first of equals, so equal windows have equal anchors at equal places. Segment i
    is windows starts[i] .. starts[i] + counts[i] - 1, its bytes data[starts[i] : starts[i] + counts[i] - 1 + length].
    """
    gram = min(GRAM, max(1, length // 3))
    sums = prefix_sums(data)
    n, width = len(data) - gram + 1, length - gram + 1
    if n < width:
        nothing = np.empty(0, dtype=np.int64)
        return nothing, nothing, nothing.astype(np.uint64), sums
    hashes = gram_hashes(sums, gram)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    np.bitwise_and(hashes, np.uint64(2**64 - (1 << POSITION_BITS)), out=padded[:n])
    padded[:n] |= np.arange(n, dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    behind = np.empty_like(blocks)
    np.minimum.accumulate(blocks[:, ::-1], axis=1, out=behind[:, ::-1])
    ahead = np.minimum.accumulate(blocks, axis=1, out=blocks).ravel()
    windows = n - width + 1
    anchor = np.minimum(behind.ravel()[:windows], ahead[width - 1 : width - 1 + windows])
    anchor &= np.uint64((1 << POSITION_BITS) - 1)
    anchor = anchor.view(np.int64)
    inside = np.zeros(windows + 1, dtype=np.int32)
    sizes = np.diff(offsets)
    whole = sizes >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(starts):
        return starts, starts, starts.astype(np.uint64), sums
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (np.diff(starts) > 1)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(starts)))
    return starts[first], counts, hashes[anchor[starts[first]]], sums


def _row_keys(sums: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return signed(span_hashes(sums, offsets[:-1], offsets[1:]))


def _anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                found, n = np.unique(segments(data, offsets, length)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _segments_of(docs: DataFrame, bits, length: int, contents: bool) -> DataFrame:
    """(anchor, seg, windows, ...) of segments whose anchor the bitmap knows: with doc_id, text_key and start, or with the content of the first of equal ones in a batch of rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            seen: set[int] = set()
            for row, end, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                starts, counts, anchors, sums = segments(data, offsets, length)
                chosen = np.flatnonzero(in_bitmap(known, anchors)) if len(starts) else starts
                starts, counts, anchors = starts[chosen], counts[chosen], anchors[chosen]
                ends = starts + counts - 1 + length
                seg = span_hashes(sums, starts, ends)
                if contents:
                    both, first = np.unique(seg ^ mix(anchors), return_index=True)
                    first = first[[x not in seen for x in both.tolist()]] if len(both) else first
                    seen.update(both.tolist())
                    raw = data.tobytes()
                    cut_out = pa.array([raw[starts[i] : ends[i]] for i in first], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(signed(anchors[first])), pa.array(signed(seg[first])), pa.array(counts[first].astype(np.int64)), cut_out], ["anchor", "seg", "windows", "content"])
                    continue
                of = np.searchsorted(offsets, starts, side="right") - 1
                ids = batch.column("doc_id").slice(row, end - row).take(pa.array(of))
                keys = _row_keys(sums, offsets)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchors)), pa.array(signed(seg)), pa.array(counts.astype(np.int64)), ids, pa.array(keys), pa.array(starts - offsets[of])], ["anchor", "seg", "windows", "doc_id", "text_key", "start"],
                )

    return docs.mapInArrow(cut, "anchor long, seg long, windows long, " + ("content binary" if contents else "doc_id long, text_key long, start long"))


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, by ranks of prefixes two, three or more times as long each round, of what is still tied; what ends counts as less than what goes on."""
    n = len(data)
    used = np.zeros(256, dtype=np.int64)
    used[data] = 1
    bits = int(used.sum()).bit_length()  # symbols are 1 and up, 0 is the end
    symbols, depth = np.cumsum(used)[data], 62 // bits
    packed = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        packed <<= bits
        packed[: max(0, n - k)] |= symbols[k:]
    order = np.argsort(packed)
    ordered = packed[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    row, rank = np.arange(n), np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, row, 0))
    parts = max(2, 62 // (n + 1).bit_length())
    while True:
        tied = row[~(fresh & np.append(fresh[1:], True))]
        if not len(tied):
            return order
        at = order[tied]
        key = rank[at]
        for k in range(1, parts):
            on = at + k * depth
            key = key * (n + 1) + np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[tied] = at
        fresh[tied] = new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= parts


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts (each ended by a byte that no text has) with what holds at the ends of its runs.

    Kept are the runs' symbols and lengths and, at each run's first and last row, the text position and its longest common prefix with
    the row before the first and after the last. Elsewhere within a run, the position one to the right has a match one shorter, so that
    matching statistics stream from these samples alone. Prefixes are told up to length, and those under least count as none.
    """

    def __init__(self, texts: list[bytes], length: int, least: int = 0) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        self.n = len(data)
        order = suffix_order(data)
        bwt = data[order - 1]
        # The beginning of each text is a run of its own, so that what streams to a position comes from its own text.
        head = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 255)])
        tail = np.concatenate([head[1:], [True]])
        self.symbols, self.lengths = bwt[head], np.diff(np.append(np.flatnonzero(head), self.n))
        before, after = np.flatnonzero(head[1:]) + 1, np.flatnonzero(tail[:-1])
        sums = prefix_sums(data)
        self.heads = order[head], np.concatenate([[0], self._common(sums, order[before], order[before - 1], length, least)])
        self.tails = order[tail], np.concatenate([self._common(sums, order[after], order[after + 1], length, least), [0]])

    def _common(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, least: int) -> np.ndarray:
        """Common prefixes of positions a and b, up to most and 0 if under least, by bisection of equal hashes."""
        out = np.zeros(len(a), dtype=np.int64)
        high = np.minimum(most, self.n - np.maximum(a, b))
        long = np.flatnonzero(high >= least)
        long = long[span_hashes(sums, a[long], a[long] + least) == span_hashes(sums, b[long], b[long] + least)]
        a, b, high, low = a[long], b[long], high[long], np.full(len(long), least, dtype=np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = span_hashes(sums, a, a + middle) == span_hashes(sums, b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[long] = low
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest string there, up to the length sampled, that stands anywhere else too."""
        out = np.zeros(self.n, dtype=np.int64)
        for where, common in (self.heads, self.tails):
            known = np.full(self.n, -1, dtype=np.int64)
            known[where] = where
            value = np.zeros(self.n, dtype=np.int64)
            value[where] = common
            last = np.maximum.accumulate(known)
            out = np.maximum(out, np.where(last >= 0, value[last] - (np.arange(self.n) - last), 0))
        return out


def _marked(length: int):
    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        reuse_memory()
        rows = rows.drop_duplicates(["anchor", "seg"]).sort_values(["anchor", "seg"])
        index = RunIndex([bytes(x) for x in rows["content"]], 3 * length, length)
        inside = np.zeros(index.n + 1, dtype=np.int8)
        inside[index.begins] = 1
        inside[index.begins + rows["windows"].to_numpy()] = -1
        repeated = (index.matching_statistics() >= length) & (np.cumsum(inside[:-1], dtype=np.int8) > 0)
        edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(index.begins, begin, side="right") - 1
        own = rows.iloc[of]
        return pd.DataFrame({"anchor": own["anchor"].to_numpy(), "seg": own["seg"].to_numpy(), "begin": begin - index.begins[of], "end": end - index.begins[of]}).astype("int64")

    return mark


def _hot_marks(content: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, begin, end) of repeated windows among the distinct segments (anchor, seg, content, distinct) of anchors with very many.

    Equal windows stand at equal places from their anchor and have equal hashes, so an anchor's windows are dealt out by place and, of
    the most frequent anchors, by hash as well: any number of tasks shares its work, each counting at most about HOT_WINDOWS hashes. A
    row holds a segment's windows of one part.
    """
    gram = min(GRAM, max(1, length // 3))
    width = length - gram + 1
    schema = "anchor long, place int, part int, seg long, at array<int>, window array<long>"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for anchor, seg, content_, distinct in zip(*(batch.column(c) for c in ("anchor", "seg", "content", "distinct")), strict=True):
                data = np.frombuffer(content_.as_buffer(), dtype=np.uint8)
                sums, at = prefix_sums(data), np.arange(len(data) - length + 1)
                hashes = gram_hashes(sums, length)
                grams = gram_hashes(sums[: width + gram], gram) >> np.uint64(POSITION_BITS)
                expected = distinct.as_py() * width // 2
                places = min(width, -(-expected // HOT_WINDOWS))
                parts = -(-expected // (places * HOT_WINDOWS))
                key = (int(np.argmin(grams)) - at) * places // width * parts + (hashes % np.uint64(parts)).astype(np.int64)
                for k in np.unique(key):
                    own = key == k
                    rows.append((anchor.as_py(), int(k) // parts, int(k) % parts, seg.as_py(), at[own].astype(np.int32), signed(hashes[own])))
            anchors, place, part, segs, ats, found = zip(*rows, strict=True) if rows else ((),) * 6
            counts = np.array([len(x) for x in ats], dtype=np.int64)
            flat = lambda x, kind: np.concatenate(x) if x else np.empty(0, dtype=kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(place, pa.int32()), pa.array(part, pa.int32()), pa.array(segs, pa.int64()), lists(flat(ats, np.int32), counts, pa.int32()), lists(flat(found, np.int64), counts, pa.int64())], ["anchor", "place", "part", "seg", "at", "window"],
            )

    def repeated(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["at"].map(len).to_numpy()
        hashes = np.concatenate(rows["window"].to_list())
        _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        row, at = np.repeat(np.arange(len(rows)), sizes)[twice], np.concatenate(rows["at"].to_list())[twice]
        if not len(at):
            return pd.DataFrame({"anchor": [], "seg": [], "begin": [], "end": []}).astype("int64")
        first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)])
        last = np.append(first[1:], True)
        own = rows.iloc[row[first]]
        return pd.DataFrame({"anchor": own["anchor"].to_numpy(), "seg": own["seg"].to_numpy(), "begin": at[first], "end": at[last] + 1}).astype("int64")

    dealt = content.select("anchor", "seg", "content", "distinct").mapInArrow(windows, schema)
    return dealt.groupBy("anchor", "place", "part").applyInPandas(repeated, "anchor long, seg long, begin long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_key, begin, end): maximal runs of bytes covered by strings of length bytes that start more than once in docs (doc_id, text).

    Windows of length bytes are gathered in segments by anchor (see segments), and only segments whose anchor occurs again leave the
    scan. Equal segments collapse: all their windows repeat. Bytes leave it only for anchors with segments that differ; these meet in a
    bucket of bounded size, of which a run-length index is built and matching statistics streamed. Anchors with over HOT_SEGMENTS distinct segments (the edges of
    a very common passage) are counted by window instead, dealt by the window's place, so no task holds them.
    """
    spark = docs.sparkSession
    shared = _anchor_counts(docs, length).where("n > 1")
    found = materialize(_segments_of(docs, broadcast_bytes(spark, bitmap(shared, "anchor")), length, contents=False))
    per_segment = materialize(found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")))
    per_anchor = per_segment.groupBy("anchor").agg(F.count(F.lit(1)).alias("distinct"), F.sum(F.col("windows") + length).alias("bytes")).where(F.col("distinct") > 1)
    per_anchor = materialize(per_anchor)
    content = _segments_of(docs, broadcast_bytes(spark, bitmap(per_anchor, "anchor")), length, contents=True).join(per_anchor, "anchor")
    warm_bytes = per_anchor.where(F.col("distinct") <= HOT_SEGMENTS).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-warm_bytes // BUCKET_BYTES))
    warm = content.where(F.col("distinct") <= HOT_SEGMENTS).withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    marks = warm.groupBy("bucket").applyInPandas(_marked(length), "anchor long, seg long, begin long, end long")
    hot = content.where(F.col("distinct") > HOT_SEGMENTS)
    if per_anchor.where(F.col("distinct") > HOT_SEGMENTS).limit(1).count():
        marks = marks.union(_hot_marks(hot.dropDuplicates(["anchor", "seg"]), length))
    copies = per_segment.where("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("begin"), F.col("windows").alias("end"))
    covered = found.select("anchor", "seg", "doc_id", "text_key", "start").join(marks.union(copies), ["anchor", "seg"])
    spans = covered.select("doc_id", "text_key", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") - 1 + length).alias("end"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(F.coalesce(F.col("begin") > reached, F.lit(True)), 1).otherwise(0))
    run = fresh.withColumn("run", F.sum("fresh").over(order))
    return run.groupBy("doc_id", "text_key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("run")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row: its UTF-8 bytes without those covered by a string of length bytes that starts anywhere else too, in its own text or another's.

    kept is binary, since a cut may fall within a character. Strings are judged on the input. Null texts count as empty; texts under
    length bytes keep all; of repeated rows all are cut, none stays. Rows without an id are cut too.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Copies of a row are told apart by nothing, nor need be: each is cut alike, and each counts as a place where the string starts.
    spans = repeated_spans(docs, length)
    cuts = spans.distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    cuts = materialize(cuts)
    bits = broadcast_bytes(docs.sparkSession, bitmap(cuts, "text_key"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            keys = np.concatenate([_row_keys(prefix_sums(data), offsets) for _, _, data, offsets in text_slices(batch, "text", SLICE_BYTES)]) if batch.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(keys), pa.array(in_bitmap(known, keys))], ["doc_id", "text", "text_key", "touched"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans_ in zip(batch.column("text"), batch.column("cuts"), strict=True):
                raw, out, at = text.as_buffer().to_pybytes(), [], 0
                for s in spans_.as_py() or []:
                    out.append(raw[at : s["begin"]])
                    at = s["end"]
                kept.append(b"".join([*out, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("n_spans"), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_spans", "kept"])

    rows = docs.mapInArrow(keyed, "doc_id long, text string, text_key long, touched boolean")
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    plain = rows.where("not touched").select("doc_id", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    of = cuts.toDF("of_id", "of_key", "cuts")
    joined = rows.where("touched").join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left")
    shorter = joined.select("doc_id", "text", n_bytes, F.when(F.col("cuts").isNull(), zero).otherwise(F.size("cuts")).cast("long").alias("n_spans"), "cuts").mapInArrow(cut, "doc_id long, n_bytes long, n_spans long, kept binary")
    shorter = shorter.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", "kept")
    return plain.unionByName(shorter)
