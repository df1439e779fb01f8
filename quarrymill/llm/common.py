"""Small helpers shared by the operators: checkpoints, fixed-size bitmaps and byte-wise hashing of Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BITMAP_BITS = 1 << 25  # 4 MB, whatever the input
SLICE_BYTES = 1 << 18
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH_ROWS rows: rows are whole texts, so Spark's 10 000 are too much for the memory beside an executor's heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


GIVE_BACK_EVERY = 8
REUSED = 1 << 25


def give_back() -> None:
    """Return freed memory to the system: Arrow and the C library keep it, and a worker lives on to other stages beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def reuse_memory() -> None:
    """Let the C library keep up to REUSED bytes of freed arrays for the next ones: by default it returns arrays of a slice's size to the system each time, and most of a scan's time goes into the pages of new ones."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        for option in (-3, -1):  # M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
            mallopt(option, REUSED)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over the batches of a partition, giving memory back at its end, and Arrow's every few batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, out in enumerate(run(batches), 1):
                yield out
                del out
                if k % GIVE_BACK_EVERY == 0:
                    pa.default_memory_pool().release_unused()
        finally:
            give_back()

    return over


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a new one of our own if all runs on one machine, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and read it back, which cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return in_small_batches(df).checkpoint(eager=True)


def bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of pmod(column, BITMAP_BITS) over all rows. Its size is fixed, so it may be sent to every executor at any scale; a clash only lets a row through to the exact join that follows."""
    at = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1
    parts = keys.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for row in parts:
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out.tobytes()


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.astype(np.int64, copy=False) & (BITMAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S, so that (S[e] - S[s]) * BASE**-s is a hash of data[s:e] wherever it stands."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.take(BYTE_VALUES, data, out=out[1:])
    out[1:] *= up[: len(data)]
    return np.cumsum(out, out=out)


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """span_hashes of all spans of so many bytes, with few arrays in between."""
    n = max(0, len(sums) - size)
    h = sums[size:] - sums[:n]
    h *= powers(len(sums))[1][:n]
    h += np.uint64(size)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) over runs of rows of about limit bytes; null counts as empty."""
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*, inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    table = np.full(256, outside is not None)
    table[list(inside or b"")] = True
    table[list(outside or b"")] = False
    return table


ALNUM_WORDS = byte_class(inside=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
SPACED_WORDS = byte_class(outside=b" \t\n\x0b\x0c\r")


EIGHT_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of words, of which those of eight bytes at most never clash with others of their length. Blocks of eight are mixed with their place before they are summed, so no pattern of letters cancels out."""
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))

    def blocks(at: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix((eights[at] & EIGHT_MASKS[np.minimum(end - at, 8)]) ^ mix(place.astype(np.uint64) + np.uint64(1)))

    sizes = ends - starts
    total = blocks(starts, ends, np.zeros(len(starts), dtype=np.uint64))
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(more.sum()) - np.repeat(first, more) + 1
        total[long] += np.add.reduceat(blocks(np.repeat(starts[long], more) + 8 * place, np.repeat(ends[long], more), place), first)
    return mix(total + sizes.astype(np.uint64) * np.uint64(BASE))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each row and the count at the end) of the maximal runs of bytes in table, cut at the ends of rows."""
    inside = table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(data):
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(data):
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def pairs_of_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(BASE))


def pairs_of(hashes: np.ndarray) -> np.ndarray:
    """Hashes of adjacent pairs of words."""
    return pairs_of_two(hashes[:-1], hashes[1:])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from an array of its elements and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def broadcast_bytes(spark: SparkSession, data: bytes):
    return spark.sparkContext.broadcast(data)


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)
