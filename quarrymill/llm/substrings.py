"""Removal of word sequences that an earlier document has: suffix automata over shards of what may repeat, and documents streamed through them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import BASE, SPACED_WORDS, broadcast_bytes, in_small_batches, materialize, mix, pairs_of_two, powers, shared_folder, signed, text_slices, words

LENGTH = 13
GRAM = 5
HOT_SEGMENTS = 200
SHARD_WORDS = 60_000
SLICE_BYTES = 1 << 20
POSITION_BITS = 30
LEAST_BITS, MOST_BITS = 20, 28  # of a bitmap: 32 MB at most, whatever the input
BITS_PER_KEY = 16


class SuffixAutomaton:
    """The smallest automaton of all substrings of the sequences added to it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for what is one longer than state p, to which p and the shorter ones lead from now on."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        following, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new, p = len(following), last
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def statistics(self, sequence: list[int]) -> list[int]:
        """At each place, the length of the longest string that ends there and stands in an added sequence."""
        following, link, length, at, matched, out = self.next, self.link, self.length, 0, 0, []
        for c in sequence:
            while at and c not in following[at]:
                at = link[at]
                matched = length[at]
            if c in following[at]:
                at = following[at][c]
                matched += 1
            out.append(matched)
        return out


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the runs of one after another in ascending places."""
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate([[0], breaks + 1])], places[np.append(breaks, len(places) - 1)] + 1


def segments(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, window counts, anchors, keys) of the windows of length words within each row, in runs that share an anchor.

    A window's anchor is its least-hashed gram of a few words, the first of equals, so equal windows have equal anchors at equal places.
    A segment is windows starts[i] .. starts[i] + counts[i] - 1; its key is a hash of all its words.
    """
    gram = min(GRAM, max(1, length // 2))
    if length < 2:
        raise ValueError("a window has two words or more")
    windows = len(hashes) - length + 1
    nothing = np.empty(0, dtype=np.int64)
    if windows < 1:
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    grams = hashes
    for k in range(1, gram):
        grams = pairs_of_two(grams[:-1], hashes[k:])
    places = np.uint64((1 << POSITION_BITS) - 1)
    least, reach, width = (grams & ~places) | np.arange(len(grams), dtype=np.uint64), 1, length - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    anchor = (least & places).astype(np.int64)
    sizes = np.diff(first)
    whole = sizes >= length
    inside = np.zeros(windows + 1, dtype=np.int32)
    np.add.at(inside, first[:-1][whole], 1)
    np.add.at(inside, first[1:][whole] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    fresh = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (np.diff(at) > 1)])
    begin = np.flatnonzero(fresh)
    starts, counts = at[begin], np.diff(np.append(begin, len(at)))
    up, down = powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes + np.uint64(BASE)) * up[: len(hashes)], out=sums[1:])
    ends = starts + counts - 1 + length
    return starts, counts, grams[anchor[starts]], mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table to the cluster's shared folder and read again: less on disk than a checkpoint of numbers."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    in_small_batches(df).write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bitmap_of(keys: DataFrame, column: str) -> bytes:
    """A bitmap of keys modulo its size, a power of two by their count and at most 32 MB; a clash lets more through, which changes no result."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_PER_KEY * keys.count()).bit_length()))
    at = F.pmod(F.col(column), F.lit(size)) + 1
    parts = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros(size // 8, dtype=np.uint8)
    for row in parts:
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out.tobytes()


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64, copy=False) & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                _, _, hashes, first = words(data, offsets, SPACED_WORDS)
                found, n = np.unique(segments(hashes, first, length)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return docs.select("text").mapInArrow(count, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


def _occurrences(docs: DataFrame, bits, length: int) -> DataFrame:
    """(anchor, seg, doc_id, row_key, start, windows) of each segment whose anchor the bitmap knows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                _, _, hashes, first = words(data, offsets, SPACED_WORDS)
                starts, counts, anchors, keys = segments(hashes, first, length)
                chosen = np.flatnonzero(in_bits(known, anchors))
                of = np.searchsorted(first, starts[chosen], side="right") - 1
                ids, rows = (batch.column(c).slice(row, end - row).take(pa.array(of)) for c in ("doc_id", "row_key"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchors[chosen])), pa.array(signed(keys[chosen])), ids, rows, pa.array((starts[chosen] - first[of]).astype(np.int32)), pa.array(counts[chosen].astype(np.int32))],
                    ["anchor", "seg", "doc_id", "row_key", "start", "windows"],
                )

    return docs.mapInArrow(cut, "anchor long, seg long, doc_id long, row_key long, start int, windows int")


def _contents(docs: DataFrame, several, hot, length: int) -> DataFrame:
    """(anchor, seg, hot, content): the bytes of each distinct segment of the anchors that the bitmap knows, and whether the other one does."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, very = (np.frombuffer(b.value, dtype=np.uint8) for b in (several, hot))
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text", SLICE_BYTES):
                begins, ends, hashes, first = words(data, offsets, SPACED_WORDS)
                starts, counts, anchors, keys = segments(hashes, first, length)
                chosen = np.flatnonzero(in_bits(known, anchors))
                _, once = np.unique(keys[chosen] ^ mix(anchors[chosen]), return_index=True)
                chosen = chosen[once]
                raw = data.tobytes()
                content = [raw[a:b] for a, b in zip(begins[starts[chosen]], ends[starts[chosen] + counts[chosen] + length - 2], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchors[chosen])), pa.array(signed(keys[chosen])), pa.array(in_bits(very, anchors[chosen])), pa.array(content, pa.binary())], ["anchor", "seg", "hot", "content"])

    return docs.select("text").mapInArrow(cut, "anchor long, seg long, hot boolean, content binary").dropDuplicates(["anchor", "seg"])


def _shard_marks(length: int):
    """Of a shard's segments (anchor, seg, first, content), the runs of windows that a segment with a smaller first document has too: (anchor, seg, begin, end)."""

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["first", "anchor", "seg"], kind="stable")
        numbers: dict[bytes, int] = {}
        texts = [[numbers.setdefault(w, len(numbers)) for w in content.split()] for content in rows["content"]]
        first, automaton, out = rows["first"].to_numpy(), SuffixAutomaton(), []
        keys = list(zip(rows["anchor"], rows["seg"], strict=True))
        edges = [0, *(np.flatnonzero(np.diff(first)) + 1), len(first)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for i in range(a, b):  # a document's segments meet those of smaller ones only
                ends = np.flatnonzero(np.array(automaton.statistics(texts[i])) >= length)
                out += [(*keys[i], int(s), int(e)) for s, e in zip(*runs(ends - length + 1), strict=True)]
            for i in range(a, b):
                automaton.add(texts[i])
        return pd.DataFrame(out, columns=["anchor", "seg", "begin", "end"]).astype({"anchor": "int64", "seg": "int64", "begin": "int32", "end": "int32"})

    return mark


def _hot_marks(pieces: DataFrame, length: int) -> DataFrame:
    """The same for segments of anchors with very many: each window is a text of its own, equal ones collapse to their smallest first document, and any number of tasks shares an anchor's."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.as_py().split() for c in batch.column("content")]
            counts = np.array([len(t) - length + 1 for t in texts], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(texts)), counts))
            at = [k for n in counts for k in range(n)]
            said = [b" ".join(t[k : k + length]) for t, n in zip(texts, counts, strict=True) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("anchor", "seg", "first")), pa.array(at, pa.int32()), pa.array(said, pa.binary())], ["anchor", "seg", "first", "at", "window"])

    every = stored(pieces.mapInArrow(windows, "anchor long, seg long, first long, at int, window binary"))
    earliest = materialize(every.groupBy("window").agg(F.min("first").alias("earliest"), F.max("first").alias("last")).where("earliest < last").drop("last"))
    met = every.join(earliest, "window").where("earliest < first")
    return met.select("anchor", "seg", F.col("at").alias("begin"), (F.col("at") + 1).alias("end"))


def earlier_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, row_key, spans): for each row of docs (doc_id, row_key, text), the (begin, end) in words of what a window of length words covers that starts in a document with a smaller id too.

    Windows are gathered in segments by anchor (see segments), and only those whose anchor occurs again leave the scan. Equal segments
    collapse: all but those of the smallest document are covered. The others' words are needed only where an anchor has segments that
    differ: these are the reference, dealt by anchor to shards of a bounded number of words, and for each shard a suffix automaton is
    built, document after document, through which the next document's segments are streamed first. Both reference and stream grow with
    the corpus, so a shard's automaton stays in the task that its segments come to. An anchor with over HOT_SEGMENTS different segments
    (the edge of a very common passage) has them cut to single windows, which collapse as segments do.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    repeated = stored(_anchor_counts(docs, length).where("n > 1").select("anchor"))
    found = stored(_occurrences(docs, broadcast_bytes(spark, bitmap_of(repeated, "anchor")), length))
    distinct = stored(found.groupBy("anchor", "seg").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("windows").alias("windows")))
    per_anchor = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("windows") + length - 1).alias("words")).where("n > 1"))
    several, hot = (broadcast_bytes(spark, bitmap_of(per_anchor.where(f"n > {n}"), "anchor")) for n in (1, HOT_SEGMENTS))
    pieces = stored(_contents(docs, several, hot, length).join(distinct.select("anchor", "seg", "first"), ["anchor", "seg"]))
    shards = max(1, -(-(per_anchor.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS))
    dealt = pieces.where("NOT hot").select("anchor", "seg", "first", "content", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    marks = dealt.groupBy("shard").applyInPandas(_shard_marks(length), "anchor long, seg long, begin int, end int").union(_hot_marks(pieces.where("hot"), length))
    per_segment = marks.groupBy("anchor", "seg").agg(F.collect_list(F.struct("begin", "end")).alias("marks"))
    decided = stored(distinct.join(per_segment, ["anchor", "seg"], "left").where("last > first OR marks IS NOT NULL").select("anchor", "seg", "first", "marks"))
    own = F.when(F.col("doc_id") > F.col("first"), F.array(F.struct(F.lit(0).alias("begin"), F.col("windows").alias("end")))).otherwise(F.col("marks"))
    covered = found.join(decided, ["anchor", "seg"]).select("doc_id", "row_key", "start", F.inline(own))
    span = F.struct((F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") - 1 + length).alias("end"))
    return covered.groupBy("doc_id", "row_key").agg(F.collect_list(span).alias("spans"))


def remove_earlier(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: its words, joined by single spaces, without those covered by a window of length words that starts in a document with a smaller id too.

    Windows are judged on the input. Null, empty and short texts lose nothing, nor does a text to itself, to a row of the same id, or to
    a later one; of equal texts the smallest id keeps all. Rows without an id lose nothing and take nothing from others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    cuts = stored(earlier_spans(docs, length))
    bits = broadcast_bytes(docs.sparkSession, bitmap_of(cuts.select("doc_id"), "doc_id"))
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def keep(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        for text_, own in zip(batch.column("text"), spans, strict=True):
            said, left, at = text_.as_buffer().to_pybytes().split(), [], 0
            for s in sorted((s["begin"], s["end"]) for s in own or ()):
                left += said[at : max(at, s[0])]
                at = max(at, s[1])
            left += said[at:]
            out.append((len(said), len(said) - len(left), b" ".join(left)))
        n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    def touched(batch: pa.RecordBatch) -> pa.Array:
        ids = batch.column("doc_id")
        return pa.array(in_bits(np.frombuffer(bits.value, dtype=np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pc.invert(touched(batch)))
            yield keep(rest, [None] * rest.num_rows)

    def to_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(touched(batch))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield keep(batch, batch.column("spans").to_pylist())

    joined = docs.mapInArrow(to_cut, docs.schema).join(cuts, ["doc_id", "row_key"], "left").select("doc_id", "text", "spans")
    return docs.mapInArrow(plain, schema).unionByName(joined.mapInArrow(cut, schema))
