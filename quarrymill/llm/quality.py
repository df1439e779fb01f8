"""Quality by importance resampling: hashed n-gram models of target and raw text, and a sample by Gumbel top-k of their ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.llm.common import LOWER, SPACED_WORDS, materialize, pairs_of, text_slices, words

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
LENGTH = 100
SHARE = 0.8
EDGE_ROWS = 20_000
BINS = 1 << 16


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the words and pairs of words, where each row's begin)."""
    _, _, hashes, first = words(LOWER[data], offsets, SPACED_WORDS)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    within = row[1:] == row[:-1] if len(row) else np.empty(0, dtype=bool)
    both = np.concatenate([hashes, pairs_of(hashes)[within]]) if len(hashes) else hashes
    of = np.concatenate([row, row[1:][within]]) if len(row) else row
    order = np.argsort(of, kind="stable")
    return (both[order] >> np.uint64(50)).astype(np.int64), np.searchsorted(of[order], np.arange(len(first)))


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all of docs (text): BUCKETS numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, "text"):
                seen += np.bincount(_grams(data, offsets)[0], minlength=BUCKETS)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, each count raised by one."""
    return np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())


def target_rows(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS, label: str = "quality") -> DataFrame:
    """The texts of at most `most` rows labelled 1, chosen by the hash of their id; rows whose crc32(id as text) modulo 4 is 2 are left out, to test on."""
    chosen = labels.where((F.col(label) == 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")


def importance(docs: DataFrame, ratio: np.ndarray, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_grams, log_weight): the ratio of the models' likelihoods of each whole text, as if it had `length` grams, so that long texts don't win or lose by their length alone. Texts without words have weight 0."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, "text"):
                buckets, first = _grams(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(sent.value[buckets])])
                n = np.diff(first)
                weight = np.where(n > 0, (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) * length, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double")


def gumbel_top(weights: DataFrame, share: float = SHARE) -> DataFrame:
    """weights with key and kept: a sample without replacement of floor(share * rows) rows, in proportion to exp(log_weight): the highest log_weight plus Gumbel noise, which the id's hash decides. Ties go to the smaller id.

    Counts of keys in BINS bins of equal width tell the bin that the last place falls in; that bin is cut again, as often as it has over
    EDGE_ROWS rows and more than one key, so that however the keys lie only few rows are ranked in one task. Rows of one and the same
    key beyond that go by id in the same way.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = materialize(weights.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    places = int(share * keyed.count())
    if not places:
        return keyed.withColumn("kept", F.lit(False))
    # Where keys are all equal, rows without an id go first and then smaller ids.
    decided, order = keyed.withColumn("kept", F.lit(None).cast("boolean")), [F.col("key"), F.coalesce(-F.col("doc_id").try_cast("double"), F.lit(1e300))]
    for by in order:
        while True:
            low, high, rows = decided.where("kept is null").agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
            if rows <= EDGE_ROWS or not low < high or not (width := (high - low) / BINS):
                break
            binned = decided.withColumn("bin", F.when(F.col("kept").isNull(), F.least(F.floor((by - low) / width), F.lit(BINS - 1)).cast("int")))
            counts = binned.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("bin").desc()).collect()  # BINS rows at most
            for r in counts:
                edge = r.bin
                if r.n >= places:
                    break
                places -= r.n
            decided = binned.withColumn("kept", F.when(F.col("bin") > edge, True).when(F.col("bin") < edge, False).otherwise(F.col("kept"))).drop("bin")
    rank = F.row_number().over(Window.orderBy(F.col("key").desc(), "doc_id"))  # one bin's rows
    last = decided.where("kept is null").withColumn("kept", rank <= places)
    return decided.where("kept is not null").unionByName(last)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) for each row of docs: the target model is of rows labelled 1, the raw model of all documents.

    Null and empty texts have no grams and weight 0; repeated rows have equal keys; without labels the two models differ only by the
    raw counts; empty tables give no rows. Three reads of the documents, of which none shuffles texts.
    """
    rows = docs.select("doc_id", "text")
    ratio = log_ratio(gram_counts(target_rows(rows, labels)), gram_counts(rows))
    return gumbel_top(importance(rows, ratio), share)
