"""Fill-in-middle: a text is cut at two of its units and its middle moved to the end; units are found and counted in big integers, a bit a byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import in_small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))


def class_table(members: bytes) -> bytes:
    """For bytes.translate: the digit 1 for members, 0 for all other bytes."""
    return bytes(49 if x in members else 48 for x in range(256))


LINE_FEEDS = class_table(b"\n")
SPACES = class_table(b" \t\n\x0b\x0c\r")
LATER_BYTES = class_table(bytes(range(0x80, 0xC0)))  # of a character in UTF-8, after its first


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is in the table's class."""
    return int(data[::-1].translate(table) or b"0", 2)


def unit_starts(data: bytes, unit: str) -> int:
    """Bit i is set if a unit starts at byte i: a line with its line feed, a word with the white space after it (and what stands before the first word), or a character."""
    whole = (1 << len(data)) - 1
    if unit == "line":
        return (mask(data, LINE_FEEDS) << 1 | 1) & whole
    if unit == "word":
        spaces = mask(data, SPACES)
        return (spaces << 1 & ~spaces | 1) & whole
    if unit == "char":
        return mask(data, LATER_BYTES) ^ whole
    raise ValueError(f"unit is line, word or char, not {unit}")


def ranked_bit(bits: int, rank: int, width: int) -> int:
    """The place of the set bit of a rank, from 0. The half that holds it is halved again, so all steps together look at twice the width."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        inside = low.bit_count()
        if rank < inside:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - inside, at + half, width - half
    return at


@dataclass(frozen=True)
class Recipe:
    """unit: line, word or char. Of 100 documents fim_percent are transformed, and of 100 of those spm_percent have the suffix first. What is drawn depends on seed and doc_id only."""

    unit: str = "line"
    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50

    def draws(self, doc_id: int | None) -> list[int]:
        """Four unsigned integers of 32 bits; a null id is drawn as the empty string."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]

    def apply(self, doc_id: int | None, data: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """(number of units, form, code points of prefix and middle, output) of one text."""
        starts = unit_starts(data, self.unit)
        n = starts.bit_count()
        h1, h2, h3, h4 = self.draws(doc_id)
        if not data or any(s in data for s in SENTINELS) or h3 % 100 >= self.fim_percent:
            return n, "plain", None, None, data
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (len(data) if k == n else ranked_bit(starts, k, len(data)) for k in (first, last))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        chars = unit_starts(data, "char")
        lengths = [(chars >> s & ((1 << e - s) - 1)).bit_count() for s, e in ((0, a), (a, b))]
        p, s, m = SENTINELS
        if h4 % 100 < self.spm_percent:
            return n, "spm", *lengths, b"".join((s, suffix, p, prefix, m, middle))
        return n, "psm", *lengths, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row, whatever its length; rows are independent, so nothing is shuffled.

    form is psm, spm or plain; plain texts, among them null ones (as empty), empty ones and those that hold a sentinel, stay as they are
    and have null lengths. Repeated rows get equal outputs; equal texts of different ids are cut at different places.
    """
    rows = in_small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            made = [recipe.apply(i, t.as_buffer().to_pybytes()) for i, t in zip(ids, batch.column("text"), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            output = pa.array(columns[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns[:4], list(schema)[1:5], strict=True)), output], schema=schema)

    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No part holds a sentinel, so that the first of each ends a part."""
    marks = F.when(form == "spm", F.array(F.lit(SUFFIX), F.lit(PREFIX), F.lit(MIDDLE))).otherwise(F.array(F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)))
    begins = [F.instr(output, F.get(marks, F.lit(k))) for k in range(3)]
    width = F.lit(len(PREFIX))
    parts = [F.substring(output, begins[k] + width, begins[k + 1] - begins[k] - width) for k in range(2)]
    middle = F.substring(output, begins[2] + width, F.length(output))
    in_order = F.when(form == "spm", F.concat(parts[1], middle, parts[0])).otherwise(F.concat(parts[0], middle, parts[1]))
    return F.when(form == "plain", output).otherwise(in_order)
