"""Near-duplicate detection: circulant MinHash signatures, banding, and Jaccard similarity confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import LOWER, SPACED_WORDS, bitmap, broadcast_bytes, give_back, giving_back, in_bitmap, lists, materialize, mix, pairs_of_two, signed, text_slices, words
from quarrymill.llm.graph import components

UNIVERSE_BITS = 32  # two texts of a million distinct shingles have one in ten thousand places in common by chance
BANDS, BAND_ROWS = 40, 5  # a pair at 0.8 shares no band with a chance of (1 - 0.8**5)**40, about 1e-7
SMALL_BUCKET = 16
ASK_ROWS, HOLD_ROWS, HOLD_SHINGLES = 256, 1_024, 1_000_000
COLUMNS = 4_096
CHUNK = 256


def _permute(x: np.ndarray, spare: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit universe, in place: products with odd numbers and shifts onto itself, each of which can be undone."""
    for shift, factor in ((16, a), (15, b)):
        np.right_shift(x, np.uint32(shift), out=spare)
        x ^= spare
        x *= np.uint32(factor)
    return x


def signature(elements: np.ndarray) -> np.ndarray:
    """Circulant MinHash: the least place of all elements for each coordinate j, an element's being second((first(element) + j) mod 2**32). So the second permutation is shifted by one further for each."""
    at = (elements >> np.uint64(64 - UNIVERSE_BITS)).astype(np.uint32)
    at = _permute(at, np.empty_like(at), 0x9E3779B1, 0x85EBCA6B)
    shifts = np.arange(BANDS * BAND_ROWS, dtype=np.uint32)
    places, spare = (np.empty((min(CHUNK, len(at)), len(shifts)), dtype=np.uint32) for _ in range(2))
    least = np.full(len(shifts), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(at), CHUNK):
        some = at[k : k + CHUNK]
        np.add(some[:, None], shifts, out=places[: len(some)])
        np.minimum(least, _permute(places[: len(some)], spare[: len(some)], 0x7FEB352D, 0x846CA68B).min(axis=0), out=least)
    return least


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of size-word shingles of each row; of the whole sequence where it has fewer words; none without words."""
    _, _, hashes, first = words(LOWER[data], offsets, SPACED_WORDS)
    grams = hashes.copy()
    for _ in range(size - 1):  # grams[i] grows to words i .. i + size - 1
        grams = pairs_of_two(grams[:-1], hashes[-len(grams) + 1 :]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif n:
            whole = np.array([n], dtype=np.uint64)
            for i in range(a, b):
                whole = mix(whole * np.uint64(31) + hashes[i : i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands): set_id is of equal sets only, but for a clash of 128-bit hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix(np.arange(1, BAND_ROWS + 1, dtype=np.uint64))
        salt = mix(np.arange(1_000, 1_000 + BANDS, dtype=np.uint64))
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, "text"):
                ids, counts, bands, n_bands = [], [], [], []
                for elements in shingle_sets(data, offsets, size):
                    counts.append(len(elements))
                    ids.append(None if not len(elements) else np.array([mix(elements ^ np.uint64(11)).sum(), mix(elements ^ np.uint64(77)).sum()], dtype=np.uint64).tobytes())
                    n_bands.append(BANDS if len(elements) else 0)
                    if len(elements):
                        bands.append(mix((signature(elements).reshape(BANDS, BAND_ROWS).astype(np.uint64) * weights).sum(axis=1) ^ salt))
                flat = np.concatenate(bands) if bands else np.empty(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), lists(signed(flat), np.array(n_bands), pa.int64())], ["doc_id", "n_shingles", "set_id", "bands"])

    return docs.mapInArrow(giving_back(sign), "doc_id long, n_shingles long, set_id binary, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node) rows, the others having been left out before any exchange, but for clashes in the bitmap."""
    bits = broadcast_bytes(docs.sparkSession, bitmap(wanted, "node"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known, batch.column("node").to_numpy(zero_copy_only=False))))

    return docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text").mapInArrow(giving_back(pick), "node long, text string")


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with 100 * |intersection| >= percent * |union|, on the full sets of their texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            sets: list[np.ndarray] = []
            for _, _, data, offsets in text_slices(batch, "text_a"):
                sets += shingle_sets(data, offsets, size)
            i = 0
            for _, _, data, offsets in text_slices(batch, "text_b"):
                for other in shingle_sets(data, offsets, size):
                    both = len(np.intersect1d(sets[i], other, assume_unique=True))
                    kept[i] = both > 0 and 100 * both >= percent * (len(sets[i]) + len(other) - both)
                    i += 1
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("a", "b")], ["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(docs, wanted)
    with_b = pairs.join(texts.toDF("b", "text_b"), "b")
    return with_b.join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(giving_back(check), "a long, b long")


def _tiled(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of large buckets: rows (key, node, n, label, rows, shingles, main, most).

    The rows outside a bucket's largest component meet all its rows in tiles of bounded size, each one product of incidence matrices.
    No pair leaves a tile but links, of which one for each row and other component is enough.
    """
    asks_all = F.col("rows") - F.col("most")
    holds_in = F.greatest(F.ceil(F.col("rows") / HOLD_ROWS), F.ceil(F.col("shingles") / HOLD_SHINGLES)).cast("int")
    asks_in = F.greatest(F.ceil(asks_all / ASK_ROWS), F.ceil(F.col("shingles") / HOLD_SHINGLES)).cast("int")
    cut = rows.withColumns({"holds_in": holds_in, "asks_in": asks_in})
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    texts = _texts(docs, rows.select("node").distinct())
    known = cut.join(texts, "node").select("key", "node", "label", "main", "holds_in", "asks_in", "text")
    holds = known.select("key", every("asks_in").alias("i"), deal("holds_in").alias("j"), F.lit(False).alias("asks"), "node", "label", "text")
    asks = known.where("label != main").select("key", deal("asks_in").alias("i"), every("holds_in").alias("j"), F.lit(True).alias("asks"), "node", "label", "text")

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["asks", "node"], kind="stable")
        batch = pa.RecordBatch.from_arrays([pa.array(group["text"], pa.string())], ["text"])
        sets: list[np.ndarray] = []
        for _, _, data, offsets in text_slices(batch, "text"):
            sets += shingle_sets(data, offsets, size)
        asking = group["asks"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((int(asking.sum()), int((~asking).sum())), dtype=np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - first] = 1
            both += part[asking] @ part[~asking].T
        node, label = group["node"].to_numpy(), group["label"].to_numpy()
        union = sizes[asking][:, None] + sizes[~asking][None, :] - both
        i, j = np.nonzero((both > 0) & (100 * both >= percent * union) & (label[asking][:, None] != label[~asking][None, :]))
        found = pd.DataFrame({"a": node[asking][i], "b": node[~asking][j], "label": label[~asking][j]})
        del sets, row, column, both, union, batch
        give_back()
        return found.drop_duplicates(["a", "label"])[["a", "b"]].astype("int64")

    return asks.unionByName(holds).groupBy("key", "i", "j").applyInPandas(tile, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, linked where the Jaccard similarity of word shingles is at least percent.

    1. One scan gives each row its set's size, hash and bands. Rows with equal sets form a class, stood for by its smallest id.
    2. In each band bucket of several classes, all are compared with one leader: the class that meets most others over all its buckets.
       Links are confirmed on the full sets, recomputed from the texts. A bucket of n classes so gives n - 1 pairs.
    3. What then is still unconnected within a bucket is compared too, pair by pair in small buckets and in tiles in large ones, so no
       link of two that share a bucket is lost.
    Components take the smallest id. Null and empty texts and texts without words have no shingles and link with nothing; texts with fewer
    words than a shingle are one shingle, linked only with the same words. An id that stands on several different texts takes the links of all of
    them as a node, each row reporting the component of its own set's class; rows without an id take no part in links: their component is null and they are kept.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_signatures(docs, shingle))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = materialize(classes.select("node", "n", F.explode("bands").alias("key")))
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    bits = broadcast_bytes(docs.sparkSession, bitmap(shared, "key"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known, batch.column("key").to_numpy(zero_copy_only=False))))

    members = materialize(banded.mapInArrow(giving_back(pick), "node long, n long, key long").join(shared, "key"))
    degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
    ranked = members.join(degree, "node")
    leaders = ranked.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("leader"), F.col("n").alias("leader_n")), F.struct("degree", -F.col("node"))).alias("lead")).select("key", "lead.*")
    near = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  sizes that far apart can't reach it
    starred = members.join(leaders, "key").where((F.col("node") != F.col("leader")) & near(F.col("n"), F.col("leader_n")))
    pairs = materialize(starred.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    edges = materialize(_confirmed(docs, pairs, shingle, percent))
    labels = components(edges)

    # Whatever else shares a bucket and isn't connected yet. The leader has met all the others.
    followers = members.join(leaders.select("key", "leader"), "key").where("node != leader").join(labels, "node", "left")
    followers = followers.select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    per_label = followers.groupBy("key", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    apart = per_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.max_by("label", F.struct("rows", "label")).alias("main"), F.max("rows").alias("most")).where("labels > 1")
    open_rows = materialize(followers.join(apart, "key"))
    small = open_rows.where(F.col("rows") <= SMALL_BUCKET)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"))
    rest = small.select("key", F.col("node").alias("a"), "n", "label").join(other, "key").where((F.col("label") < F.col("label_b")) & near(F.col("n"), F.col("n_b")))
    untried = materialize(rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti").join(pairs.toDF("b", "a"), ["a", "b"], "left_anti"))
    more = [_confirmed(docs, untried, shingle, percent)] if untried.limit(1).count() else []
    large = open_rows.where(F.col("rows") > SMALL_BUCKET)
    if large.limit(1).count():
        more.append(_tiled(docs, large, shingle, percent))
    for links in more:
        edges = edges.union(links)
    if more:
        labels = components(edges)

    nodes = classes.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("label"))
    linked = rows.drop("bands").join(nodes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
