"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens with false-discovery control by length."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import byte_class, giving_back, in_small_batches, text_slices

# The three base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

TOKEN_CHARS = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_CHARS)
# A token's parts: names and values around "=", which only ends a part as padding at the token's end, and the names of a path.
VALUE, STEP = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?"), re.compile(r"[A-Za-z0-9+_-]+(?:=+\Z)?")
TOKEN_BYTES = byte_class(inside=b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
HEX_BYTES = byte_class(inside=b"0123456789abcdef")

# The alphabets that a token may be encoded in, tried in this order. The classes must all occur in it.
ENCODINGS = (
    ("hex", "0123456789abcdef", ("0123456789", "abcdef")),
    ("hex", "0123456789ABCDEF", ("0123456789", "ABCDEF")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", ("0123456789", "abcdefghijklmnopqrstuvwxyz")),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")),
)
BANDS = (20, 24, 32, 40, 48, 64, 96, 128)  # least token lengths of the bands
EDGES = np.array([0.0, 1e-4, 1e-3, 5e-3, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 1.0])
LEAST_CUT = 1e-3
FALSE_SHARE = 0.05
DEFAULT_CUT, MOST_CUT = 0.01, 0.1  # no threshold loses more than a tenth of what is random


def inferred_encoding(token: str) -> tuple[str, str] | None:
    """(name, alphabet) of the narrowest encoding that holds all of a token, padding aside, and of which it shows every character class; else none."""
    used = set(token.rstrip("="))
    for name, alphabet, classes in ENCODINGS:
        if used <= set(alphabet) and all(used & set(c) for c in classes):
            return name, alphabet
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity_p(symbols: np.ndarray, size: int) -> float:
    """Upper tail of the chi-squared statistic of equal frequencies: its exact moments and the Wilson-Hilferty law where symbols recur by chance, else the Poisson law of the recurring pairs that it then counts."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    pairs, mean = int((counts * (counts - 1) // 2).sum()), n * (n - 1) / (2 * size)
    if n < 5 * size:
        below, term = 0.0, math.exp(-mean)
        for k in range(pairs):
            below, term = below + term, term * mean / (k + 1)
        return min(1.0, max(1e-15, 1 - below))
    chi2, freedom = size / n * float((counts**2).sum()) - n, size - 1
    z = ((chi2 / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(symbols: np.ndarray, size: int) -> float:
    """Two-sided test of the number of runs above and below the alphabet's middle."""
    high = symbols * 2 >= size
    a, n = int(high.sum()), len(symbols)
    b = n - a
    if not a or not b:
        return max(1e-15, 2.0 ** (1 - n))
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(symbols: np.ndarray) -> float:
    """Two-sided test of the correlation of neighbours."""
    x = symbols - symbols.mean()
    spread, n = float((x * x).sum()), len(x)
    if spread == 0:
        return 1e-15
    return _two_sided((float((x[1:] * x[:-1]).sum()) / spread + 1 / n) * math.sqrt(n))


def randomness_p(token: str) -> float | None:
    """Fisher's combination of the three tests under the inferred encoding; small for what isn't random, none without an encoding."""
    if (found := inferred_encoding(token)) is None:
        return None
    at = {c: i for i, c in enumerate(found[1])}
    symbols = np.array([at[c] for c in token.rstrip("=")])
    if len(symbols) < TOKEN_CHARS - 2:
        return None
    p = [max(1e-15, x) for x in (uniformity_p(symbols, len(found[1])), runs_p(symbols, len(found[1])), serial_p(symbols))]
    half = -sum(map(math.log, p))
    return math.exp(-half) * (1 + half + half * half / 2)


def _parts(token: str, pattern: re.Pattern[str]) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(token) if m.end() - m.start() >= TOKEN_CHARS]


def tested(token: str) -> Iterator[tuple[str, float]]:
    """The parts of a token and their p-values: its values, and the names of values that as a whole can't pass for random."""
    for a, b in _parts(token, VALUE):
        value = token[a:b]
        if (p := randomness_p(value)) is not None:
            yield value, p
        if (p is None or p <= LEAST_CUT) and "/" in value:
            for c, d in _parts(value, STEP):
                if (p := randomness_p(value[c:d])) is not None:
                    yield value[c:d], p


def _band(length: int) -> int:
    return int(np.searchsorted(BANDS, length, side="right")) - 1


def _run_rows(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """Which rows may have a run of at least so many bytes of the table; rows that touch may be let through too."""
    edge = np.diff(np.concatenate([[0], table[data].astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    far = ends - begins >= least
    rows = np.zeros(len(offsets) - 1, dtype=bool)
    first = np.searchsorted(offsets, begins[far], side="right") - 1
    last = np.searchsorted(offsets, ends[far] - 1, side="right") - 1
    for a, b in zip(first, last, strict=True):
        rows[a : b + 1] = True
    return rows


def score_histogram(docs: DataFrame) -> DataFrame:
    """(band, bin, n): the combined p-values of all tokens of all documents (text), by length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(BANDS), len(EDGES)), dtype=np.int64)
        for batch in batches:
            text = batch.column("text")
            for row, _, data, offsets in text_slices(batch, "text"):
                for i in np.flatnonzero(_run_rows(data, offsets, TOKEN_BYTES, TOKEN_CHARS)):
                    for m in TOKEN.finditer(text[row + int(i)].as_py() or ""):
                        for part, p in tested(m[0]):
                            seen[_band(len(part)), np.searchsorted(EDGES, p, side="right") - 1] += 1
        band, bin_ = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(bin_), pa.array(seen[band, bin_])], ["band", "bin", "n"])

    return docs.mapInArrow(giving_back(count), "band long, bin long, n long").groupBy("band", "bin").agg(F.sum("n").alias("n"))


def thresholds(histogram: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> list[float]:
    """For each length band the p-value above which a token counts as random: the least at which at most false_share of what it lets through can be other than random.

    Random tokens' p-values are uniform, so those above a half show how many there are in all; what the band holds beyond them is not
    random. Only shares count, so that the same mixture has the same threshold at any size, that of a few tokens being as rough as they
    are few. DEFAULT_CUT is that of bands without tokens over LEAST_CUT, and of those where no threshold up to MOST_CUT reaches the share.
    """
    out = []
    for band in range(len(BANDS)):
        bins = np.zeros(len(EDGES))
        for b, k, n in histogram:
            if b == band:
                bins[k] += n
        least, most, half = (int(np.flatnonzero(EDGES == x)[0]) for x in (LEAST_CUT, MOST_CUT, 0.5))
        random = 2 * bins[half:].sum()
        chosen = DEFAULT_CUT
        for k in range(least, most + 1):
            passing = bins[k:].sum()
            if passing and passing - random * (1 - EDGES[k]) <= false_share * passing:
                chosen = float(EDGES[k])
                break
        out.append(chosen)
    return out


def base_spans(text: str, hexes: bool = True) -> list[tuple[str, int, int]]:
    """The matches of the fixed patterns that are long enough, kind by kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if hexes:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return out


def all_spans(text: str, limits: list[float], hexes: bool = True, tokens: bool = True) -> list[tuple[str, int, int]]:
    """base_spans and, outside them, the parts of tokens that pass for random, by start and kind: values, or else names of a path."""
    found = base_spans(text, hexes)
    base = list(found)

    def passes(start: int, end: int) -> bool:
        if any(a < end and start < b for _, a, b in base):
            return False
        p = randomness_p(text[start:end])
        return p is not None and p > limits[_band(end - start)]

    for m in TOKEN.finditer(text) if tokens else ():
        for a, b in _parts(m[0], VALUE):
            start, end = m.start() + a, m.start() + b
            if passes(start, end):
                found.append(("random", start, end))
            elif "/" in text[start:end]:
                found += [("random", start + c, start + d) for c, d in _parts(text[start:end], STEP) if passes(start + c, start + d)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _limits(docs: DataFrame, text_col: str) -> list[float]:
    # A row for each band and bin at most, whatever the input.
    return thresholds([tuple(r) for r in score_histogram(in_small_batches(docs).select(F.col(text_col).alias("text"))).collect()])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row, in code points, by start and then kind; null and empty texts have none, repeated rows each their own.

    Tokens, or their parts around "=" and in paths, of at least TOKEN_CHARS characters are tested for randomness in the encoding that they seem to be in. A first read of all
    documents counts p-values by token length, from which the thresholds follow; a second finds the spans. Neither shuffles texts.
    """
    limits = _limits(docs, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in _batch_spans(batch, limits)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(find), f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def _batch_spans(batch: pa.RecordBatch, limits: list[float]) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = []
    text = batch.column("text")
    for row, end, data, offsets in text_slices(batch, "text"):
        hexes, tokens = _run_rows(data, offsets, HEX_BYTES, HEX_CHARS), _run_rows(data, offsets, TOKEN_BYTES, TOKEN_CHARS)
        out += [all_spans(text[i].as_py() or "", limits, bool(hexes[i - row]), bool(tokens[i - row])) for i in range(row, end)]
    return out


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of touching or overlapping spans replaced by mark; other columns and rows stay, null texts stay null."""
    limits = _limits(docs, text_col)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
            out = []
            for text, spans in zip(own.column("text"), _batch_spans(own, limits), strict=True):
                said, parts, at = text.as_py(), [], 0
                for _, a, b in spans:
                    if a >= at:
                        parts += [said[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, said[at:]]) if spans else said)
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(out, pa.string()))

    return in_small_batches(docs).mapInArrow(giving_back(masked), docs.schema)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
