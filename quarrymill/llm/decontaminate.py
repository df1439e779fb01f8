"""Benchmark decontamination by a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import ALNUM_WORDS, LOWER, bitmap, broadcast_bytes, giving_back, in_bitmap, lists, materialize, pairs_of, sha256_hex, signed, text_slices, words

WINDOW = 13
BROADCAST_ROWS = 50_000


def _shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle for each word: of it and the next in its row, or of it alone where the row has but one word; False marks a row's last word of several, which begins none."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    begins = np.ones(len(hashes), dtype=bool)
    if len(hashes):
        out[:-1] = pairs_of(hashes)
        counts = np.diff(first)
        last = first[1:][counts > 0] - 1
        out[last] = hashes[last]
        begins[first[1:][counts > 1] - 1] = False
    return out, begins


def _keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of each row's words in order: rows of one id and equal words have equal results."""
    if not len(hashes):
        return np.zeros(len(first) - 1, dtype=np.uint64)
    ordered = np.concatenate([[np.uint64(0)], np.cumsum((hashes ^ np.uint64(0x5851F42D4C957F2D)) * (2 * np.arange(len(hashes), dtype=np.uint64) + np.uint64(1)))])
    plain = np.concatenate([[np.uint64(0)], np.cumsum(hashes ^ np.uint64(0x5851F42D4C957F2D))])
    return ordered[first[1:]] - ordered[first[:-1]] - (plain[first[1:]] - plain[first[:-1]]) * (2 * first[:-1].astype(np.uint64))


def text_key(column: str) -> Column:
    """The text_key that contamination gives a row of this text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        keys = [signed(_keys(*words(LOWER[data], offsets, ALNUM_WORDS)[2:])) for _, _, data, offsets in text_slices(batch, "text")]
        return pd.Series(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64))

    return of(F.col(column))


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, start, words, shingles) of each window: window words of an item one after another, or all where it has fewer. Items without an id, text or words have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, "text"):
                data = LOWER[data]
                starts, ends, hashes, first = words(data, offsets, ALNUM_WORDS)
                grams, begins = _shingles(hashes, first)
                raw = data.tobytes()
                said = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts, ends, strict=True)]
                kept = np.concatenate([[0], np.cumsum(begins)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").slice(row, end - row).cast(pa.string()), lists(said, np.diff(first), pa.string()), lists(signed(grams[begins]), np.diff(kept[first]), pa.int64())], ["item_id", "words", "shingles"],
                )

    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    split_items = items.mapInArrow(giving_back(split), "item_id string, words array<string>, shingles array<long>").where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0))))
    return split_items.withColumn("start", starts).select("item_id", "start", F.slice("words", F.col("start") + 1, F.lit(window)).alias("words"), F.slice("shingles", F.col("start") + 1, F.least(F.size("shingles"), F.lit(max(1, window - 1)))).alias("shingles"))


def _counts(docs: DataFrame, bits) -> DataFrame:
    """How often the documents have each shingle that the bitmap lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                _, _, hashes, first = words(LOWER[data], offsets, ALNUM_WORDS)
                both = np.concatenate([_shingles(hashes, first)[0], hashes])
                found, n = np.unique(both[in_bitmap(known, both)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return docs.select("text").mapInArrow(giving_back(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bits, window: int) -> DataFrame:
    """A row for each document: its number of words, and (word position, shingle, words around it) for each of its shingles that the bitmap lets through."""
    schema = "doc_id long, text_key long, n_words long, found array<struct<at:long,shingle:long,from:long,around:array<string>>>"
    kind = pa.struct([("at", pa.int64()), ("shingle", pa.int64()), ("from", pa.int64()), ("around", pa.list_(pa.string()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, "text"):
                data = LOWER[data]
                starts, ends, hashes, first = words(data, offsets, ALNUM_WORDS)
                n_words = np.diff(first)
                whole = _keys(hashes, first)
                pair, _ = _shingles(hashes, first)
                at, gram = [np.flatnonzero(in_bitmap(known, pair))], [pair[in_bitmap(known, pair)]]
                if len(hashes):  # one-word items ask for words
                    alone = np.flatnonzero(in_bitmap(known, hashes) & (pair != hashes))
                    at.append(alone)
                    gram.append(hashes[alone])
                at, gram = np.concatenate(at), np.concatenate(gram)
                order = np.argsort(at, kind="stable")
                at, gram = at[order], gram[order]
                of = np.searchsorted(first, at, side="right") - 1
                low = np.maximum(first[of], at - window + 1) if len(at) else at
                high = np.minimum(first[of + 1], at + window) if len(at) else at
                raw = data.tobytes()
                around = [[raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(low, high, strict=True)]
                found = pa.StructArray.from_arrays([pa.array(at - first[of] if len(at) else at), pa.array(signed(gram)), pa.array(low - first[of] if len(at) else at), pa.array(around, pa.list_(pa.string()))], fields=list(kind))
                counts = np.zeros(len(n_words) + 1, dtype=np.int32)
                np.cumsum(np.bincount(of, minlength=len(n_words)) if len(at) else np.zeros(len(n_words), dtype=np.int64), out=counts[1:])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(signed(whole)), pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(counts), found)], ["doc_id", "text_key", "n_words", "found"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(find), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, hits). documents: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated. hits: doc_id, text_key, item_id, begin, end in words.

    Shingles are pairs of adjacent words (the word itself for one-word items). Each window must lie in a document whole, so its prefix
    is one shingle: its rarest, by counts over all documents. A fixed-size bitmap of the prefixes picks documents' shingles in the scan;
    these join the windows on the shingle, pass bounds on position and length, and then their words are compared. text_key tells rows
    apart that share an id. Null texts and texts without words get zeros and are not contaminated; benchmark rows without an id, text or
    words ask for nothing; repeated benchmark rows count as one item. Two reads of the documents; no text is shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = materialize(item_windows(benchmark, window).distinct())
    grams = windows.select(F.explode("shingles").alias("shingle")).distinct()
    counted = _counts(docs, broadcast_bytes(spark, bitmap(grams, "shingle")))

    each = windows.withColumn("window", F.struct("item_id", "start", "words"))
    placed = each.select("window", F.posexplode("shingles").alias("offset", "shingle")).join(counted, "shingle", "left")
    rarest = placed.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("prefix"))
    # A shingle that no document has can't be matched; dropping its windows loses nothing.
    prefixes = materialize(rarest.where("prefix.n > 0").select(F.col("prefix.shingle").alias("shingle"), F.col("prefix.offset").cast("long").alias("offset"), "window.item_id", "window.words"))
    rows = materialize(_candidates(docs, broadcast_bytes(spark, bitmap(prefixes, "shingle")), window))

    found = rows.where(F.size("found") > 0).select("doc_id", "text_key", "n_words", F.inline("found")).distinct()
    if prefixes.count() <= BROADCAST_ROWS:
        met = found.join(F.broadcast(prefixes), "shingle")
    else:  # a hot shingle's rows are dealt to 16 parts
        salted = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(16)).cast("int")).join(salted, ["shingle", "salt"])
    begin, length = F.col("at") - F.col("offset"), F.size("words")
    fits = (begin >= 0) & (begin + length <= F.col("n_words")) & (begin >= F.col("from"))
    same = F.slice("around", (begin - F.col("from") + 1).cast("int"), length) == F.col("words")
    hits = materialize(met.where(fits & F.when(fits, same)).select("doc_id", "text_key", "item_id", begin.alias("begin"), (begin + length).alias("end")).distinct())

    before = Window.partitionBy("doc_id", "text_key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "text_key", "begin", "end").distinct().withColumn("reached", F.max("end").over(before))
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("reached", F.lit(0))))
    n_hit = spans.groupBy("doc_id", "text_key").agg(F.sum(covered).alias("n_hit"))
    # The set of items of one document is bounded by its windows.
    items = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    key = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    of_doc = n_hit.join(items.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_key"}), key).select("of_id", "of_key", "n_hit", "items")
    joined = rows.drop("found").join(of_doc, key, "left")
    hit = F.coalesce("n_hit", F.lit(0))
    documents = joined.select(
        "doc_id", "text_key", "n_words", hit.cast("long").alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        sha256_hex(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>")))).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )
    return documents, hits
