"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from itertools import chain, product
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import BASE, giving_back, in_small_batches, lists, lists_of

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(r" *[^ \n]+| +|\n")  # no piece of the vocabulary may reach over these cuts
WITHIN = re.compile(rf"{SPACE}*[^{SPACE}\n]*|\n")
SCALE, ZIPF_SHIFT = 10_000, 100
N_BEST = 4
FAR = -(1 << 60)
LONG_UNIT = 48
CACHE_UNITS = 200_000
GROUP_UNITS = 8_192
BATCH_CHARACTERS = 1_000_000


class Vocabulary:
    """A model's pieces and scores; its size is that of the model file, whatever the documents."""

    def __init__(self, pieces: list[str], scores: list[int], byte_ids: list[int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        special = set(byte_ids)
        plain = [(p, i) for i, p in enumerate(pieces) if i > 2 and i not in special]
        self.ids = {p: (i, scores[i]) for p, i in plain}
        self.longest = max(len(p) for p, _ in plain)
        self.byte_score = min(s for _, s in self.ids.values()) - 1  # below any plain piece, a byte each
        # Every prefix of a piece, so that a search ends where no piece goes on.
        self.known = {p[:k]: (-2, 0) for p, _ in plain for k in range(1, len(p))} | self.ids
        keys = np.array([_text_hash(p) for p in self.known], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ids = np.array([i for i, _ in self.known.values()], dtype=np.int32)[order]
        self.key_scores = np.array([x for _, x in self.known.values()], dtype=np.int64)[order]
        self.bytes_of = [b""] * len(pieces)
        for p, i in plain:
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for value, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([value])


def _text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c) + 1) % (1 << 64)
    return h


def load(model_file: str = MODEL_FILE) -> Vocabulary:
    """The pieces of a model file with the scores that a lattice adds up, as integers.

    A unigram file has log-probabilities, which are taken as they are. The scores of a BPE file are merge ranks, which say in what order
    pieces were made, and their sums mean nothing; there a piece counts as likely as its rank has it by the law of Zipf and Mandelbrot,
    -ln(rank + ZIPF_SHIFT), and pieces kept out of the merges as the last. A file without byte pieces, or with pieces that reach over the cuts of UNIT, is refused.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = p.get_piece_size()
    if not all(p.is_byte(p.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError("a vocabulary with all byte pieces is needed, so that every text can be written")
    pieces, byte_ids = [p.id_to_piece(i) for i in range(size)], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    plain = sorted({*range(3, size)} - {*byte_ids})
    if over := [pieces[i] for i in plain if not WITHIN.fullmatch(pieces[i])]:
        raise ValueError(f"pieces that reach from one unit of text into the next: {over[:5]}")
    raw = [p.get_score(i) for i in range(size)]
    if all(raw[i] == -k or raw[i] <= -1e8 for k, i in enumerate(plain)):
        raw = [-math.log(ZIPF_SHIFT + (-x if x > -1e8 else size)) for x in raw]
    return Vocabulary(pieces, [round(SCALE * x) for x in raw], byte_ids)


def units(text: str) -> list[str]:
    """The parts of a text between which no piece reaches, spaces written as in the vocabulary; a space goes before the text, as in the model's training."""
    return UNIT.findall(" " + text) if text else []


def _symbols(unit: str) -> str:
    # The mark for a space, where it stands in the text itself, must come back as itself: U+FFFF isn't in the vocabulary, so it goes to bytes.
    return unit.replace(SPACE, "￿").replace(" ", SPACE)


def _edges(v: Vocabulary, text: str, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, id, score) of the pieces that end there; id -1 for a character that only bytes can write."""
    known = False
    for start in range(max(0, end - v.longest), end):
        if (found := v.ids.get(text[start:end])) is not None:
            known |= start == end - 1
            yield start, *found
    if not known:
        yield end - 1, -1, v.byte_score * _width(text[end - 1])


def _width(c: str) -> int:
    return 3 if c == "￿" else len(c.encode("utf-8", "surrogatepass"))


def _spelled(v: Vocabulary, c: str) -> list[int]:
    return [v.byte_ids[b] for b in (SPACE if c == "￿" else c).encode("utf-8", "surrogatepass")]


def forward(v: Vocabulary, text: str) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """The best score of a path to each position, and the edges that end there."""
    best, edges = [0], [[]]
    for end in range(1, len(text) + 1):
        edges.append(list(_edges(v, text, end)))
        best.append(max([best[s] + score for s, _, score in edges[end]]))
    return best, edges


def n_best(v: Vocabulary, text: str, n: int) -> list[tuple[int, list[int]]]:
    """The n best segmentations of symbols, best first, as (score, piece ids).

    Hypotheses grow from the end to the front. What is missing of one, up to its front position, has the forward Viterbi score there
    as its exact value, so hypotheses leave the queue in the order of their complete scores and the first n complete ones are the n best.
    """
    if not text:
        return [(0, [])]
    best, edges = forward(v, text)
    serial, out = 0, []
    queue = [(-best[-1], len(text), 0, 0, None)]
    while queue and len(out) < n:
        total, at, _, gone, chain = heapq.heappop(queue)  # of equal ones, that which is nearest to the front
        if at == 0:
            ids = []
            while chain is not None:
                ids += chain[0]
                chain = chain[1]
            out.append((-total, ids))
            continue
        for start, piece, score in edges[at]:
            serial += 1
            ids = [piece] if piece >= 0 else _spelled(v, text[at - 1])
            heapq.heappush(queue, (-(best[start] + score + gone), start, serial, gone + score, (ids, chain)))
    return out


def _one_long(v: Vocabulary, text: str) -> tuple[list[int], int, int]:
    two = n_best(v, text, 2)
    return two[0][1], two[0][0], two[0][0] - two[1][0] if len(two) > 1 else -FAR


def best_and_gap(v: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all, number of ids of each, best scores, what the second best lacks): Viterbi forward and backward, over all units of a length at once.

    A path other than the best has an edge that the best has not, and the best path with that edge scores forward + edge + backward.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts, scores, gaps = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    base = np.uint64(BASE)
    for n in np.unique(sizes):
        every = np.flatnonzero(sizes == n)
        if n > LONG_UNIT:
            for i in every:
                ids, scores[i], gaps[i] = _one_long(v, texts[i])
                counts[i] = len(ids)
                parts.append((np.array([i]), np.array(ids, dtype=np.int32)))
            continue
        for which in np.array_split(every, -(-len(every) // GROUP_UNITS)):
            w, rows = len(which), np.arange(len(which))
            points = np.frombuffer("".join(texts[i] for i in which).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(w, n).astype(np.uint64)
            width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4))).astype(np.int64)
            ahead = np.full((w, n + 1), FAR)
            ahead[:, 0] = 0
            back = np.zeros((w, n + 1), dtype=np.int64)
            edges: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = []  # from each start: (end, rows, scores, ids)
            for s in range(n):
                edges.append([])
                alive, h = rows, np.zeros(w, dtype=np.uint64)
                for e in range(s + 1, min(n, s + v.longest) + 1):
                    h = h * base + points[alive, e - 1] + np.uint64(1)
                    k = np.minimum(np.searchsorted(v.keys, h), len(v.keys) - 1)
                    begun = v.keys[k] == h
                    piece = np.where(begun, v.key_ids[k], -2)
                    if e == s + 1:
                        of, ids = alive, np.where(piece >= 0, piece, -1)
                        x = np.where(piece >= 0, v.key_scores[k], v.byte_score * width[:, s])
                    else:
                        hit = piece >= 0
                        of, ids, x = alive[hit], piece[hit], v.key_scores[k[hit]]
                    if len(of):
                        edges[s].append((e, of, x, ids))
                        through = ahead[of, s] + x
                        better = through > ahead[of, e]
                        ahead[of[better], e] = through[better]
                        back[of[better], e] = s
                    alive, h = alive[begun], h[begun]
                    if not len(alive):
                        break
            behind = np.full((w, n + 1), FAR)
            behind[:, n] = 0
            for s in range(n - 1, -1, -1):
                for e, of, x, _ in edges[s]:
                    behind[of, s] = np.maximum(behind[of, s], x + behind[of, e])
            on = np.zeros((w, n + 1), dtype=bool)  # where the best path stands
            on[:, n] = True
            for e in range(n, 0, -1):
                here = rows[on[:, e]]
                on[here, back[here, e]] = True
            path = np.full((w, n + 1), -3, dtype=np.int32)
            second = np.full(w, FAR * 2)
            for s, own in enumerate(edges):
                for e, of, x, ids in own:
                    used = on[of, e] & (back[of, e] == s)
                    path[of[used], e] = ids[used]
                    second[of] = np.maximum(second[of], np.where(used, FAR * 2, ahead[of, s] + x + behind[of, e]))
            scores[which] = ahead[:, n]
            gaps[which] = np.minimum(ahead[:, n] - second, -FAR)
            spelled = (path == -1).any(axis=1)
            plain = path[~spelled]
            counts[which[~spelled]] = (plain > -3).sum(axis=1)
            parts.append((which[~spelled], plain[plain > -3]))
            for j in np.flatnonzero(spelled):
                out = list(chain.from_iterable([int(path[j, e])] if path[j, e] >= 0 else _spelled(v, texts[which[j]][e - 1]) for e in np.flatnonzero(path[j] > -3)))
                counts[which[j]] = len(out)
                parts.append((which[j : j + 1], np.array(out, dtype=np.int32)))
    starts = np.cumsum(counts) - counts
    flat = np.empty(int(counts.sum()), dtype=np.int32)
    for of, ids in parts:
        flat[_ranges(starts[of], counts[of])] = ids
    return flat, counts, scores, gaps


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers, of all i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts, keeping what it has found for units while they are few enough."""

    def __init__(self, v: Vocabulary, n: int) -> None:
        self.v, self.n = v, n
        # Which of their own segmentations n - 1 units may take in the n best of all: what is before a combination in the order of losses is at least the product of its ranks.
        few = [c for c in product(range(n), repeat=n - 1) if math.prod(r + 1 for r in c) <= n]
        self.combinations = np.array(few, dtype=np.int64).reshape(len(few), n - 1)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.scores = np.empty(0, dtype=np.int64)
        self.gaps = np.empty(0, dtype=np.int64)
        self.alternatives: dict[str, tuple[list[int], list[list[int]]]] = {}

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(ids of all texts, number of ids of each, n-best of each)."""
        if len(self.index) > CACHE_UNITS:
            self.reset()
        parts = [units(t) for t in texts]
        every = list(chain.from_iterable(parts))
        fresh = sorted(set(every).difference(self.index))
        if fresh:
            ids, counts, scores, gaps = best_and_gap(self.v, [_symbols(u) for u in fresh])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.ids, self.scores, self.gaps = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores]), np.concatenate([self.gaps, gaps])
        at = np.array(itemgetter(*every)(self.index) if every else [], dtype=np.int64).reshape(-1)
        sizes = self.starts[at + 1] - self.starts[at]
        flat = self.ids[_ranges(self.starts[at], sizes)]
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        where = np.concatenate([[0], np.cumsum(sizes)])
        return flat, where[cuts[1:]] - where[cuts[:-1]], self._n_best(every, at, cuts, where)

    def _options(self, unit: str) -> tuple[list[int], list[list[int]]]:
        """What each of a unit's n best lacks of the best (FAR where there are fewer), and their ids."""
        if unit not in self.alternatives:
            found = n_best(self.v, _symbols(unit), self.n)
            self.alternatives[unit] = [found[0][0] - x for x, _ in found] + [-FAR] * (self.n - len(found)), [ids for _, ids in found]
        return self.alternatives[unit]

    def _n_best(self, every: list[str], at: np.ndarray, cuts: np.ndarray, where: np.ndarray) -> pa.Array:
        """Each text's n best: units are independent, so any of the n best differs from the best in some of the n - 1 units whose second best lacks least."""
        n, texts = self.n, len(cuts) - 1
        totals = np.concatenate([[0], np.cumsum(self.scores[at])])
        gaps = self.gaps[at]
        chosen = np.full((texts, n - 1), -1, dtype=np.int64)
        lost = np.full((texts, n - 1, n), -FAR)
        lost[:, :, 0] = 0
        options: list[list[list[list[int]]]] = []
        for t, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            few = self._least(gaps[a:b], n - 1)
            few = np.sort(few[gaps[a + few] < -FAR]) + a
            chosen[t, : len(few)] = few
            options.append([])
            for k, i in enumerate(few.tolist()):
                lost[t, k], ids = self._options(every[i])
                options[-1].append(ids)
        combined = np.minimum(lost[:, np.arange(n - 1), self.combinations].sum(axis=2), -FAR)
        best = np.argsort(combined, axis=1, kind="stable")[:, :n]
        losses = np.take_along_axis(combined, best, axis=1)
        there = losses < -FAR
        ranks = self.combinations[best]
        changes = (ranks > 0) & there[:, :, None]
        t, segmentation, k = np.nonzero(changes)
        unit = chosen[t, k]
        begin = where[unit]
        ids = [options[a][b][c] for a, b, c in zip(t.tolist(), k.tolist(), ranks[t, segmentation, k].tolist(), strict=True)]
        change = pa.StructArray.from_arrays(
            [pa.array((begin - where[cuts[:-1]][t]).astype(np.int32)), pa.array((where[unit + 1] - begin).astype(np.int32)), lists(np.fromiter(chain.from_iterable(ids), dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64), pa.int32())], names=["at", "n", "ids"],
        )
        of_each = lists_of(change, changes.sum(axis=2)[there])
        scored = pa.StructArray.from_arrays([pa.array(((totals[cuts[1:]] - totals[cuts[:-1]])[:, None] - losses)[there]), of_each], names=["score", "changes"])
        return lists_of(scored, there.sum(axis=1))

    @staticmethod
    def _least(gaps: np.ndarray, k: int) -> np.ndarray:
        """Places of the k least, the first of equals."""
        if len(gaps) < 64:
            return np.argsort(gaps, kind="stable")[:k]
        limit = np.partition(gaps, k - 1)[k - 1] if k else 0
        near = np.flatnonzero(gaps <= limit)
        return near[np.argsort(gaps[near], kind="stable")][:k]


def encode(docs: DataFrame, n: int = N_BEST, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, n_best) for each row. ids is the best segmentation of the whole text under the sum of its pieces' scores (see load).

    n_best lists up to n segmentations as (score, changes): a change puts other ids in place of n ids of the best, from position at.
    Characters without a piece are written in byte pieces, each scored just below the last piece. Null and empty texts have no pieces
    and one segmentation, of score 0; repeated rows are encoded each. One scan, no shuffle.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model_file))
    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(giving_back(_encoding(vocabulary, n)), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {ENCODED}")


ENCODED = "n_pieces long, ids array<int>, n_best array<struct<score:long,changes:array<struct<at:int,n:int,ids:array<int>>>>>"


def _encoding(vocabulary, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, n)
        for batch in batches:
            at = 0
            texts = batch.column("text")
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < BATCH_CHARACTERS):
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                flat, counts, best = encoder.batch(some)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), best], ["doc_id", "n_pieces", "ids", "n_best"])
                at += len(some)

    return run


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    text = b"".join([v.bytes_of[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(encoded: DataFrame, model_file: str = MODEL_FILE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., text): the text that each row's ids write; no ids, or none at all, give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load(model_file))
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return in_small_batches(encoded).select(*dict.fromkeys((*keep, "ids"))).mapInArrow(giving_back(_decoding(vocabulary, keep)), f"{schema}, text string")


def _decoding(vocabulary, keep: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            text = [decode_ids(vocabulary.value, x.values.to_numpy() if x.is_valid else []) for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "text"])

    return run


def encode_and_decode(docs: DataFrame, n: int = N_BEST, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, n_best, text): encode, and decode of its ids, one after another in the same worker, so that a task needs one and the pieces don't leave it in between."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model_file))
    rows = in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    encoding, decoding = _encoding(vocabulary, n), _decoding(vocabulary, ("doc_id", "n_pieces", "ids", "n_best"))
    return rows.mapInArrow(giving_back(lambda batches: decoding(encoding(batches))), f"doc_id {docs.schema[id_col].dataType.simpleString()}, {ENCODED}, text string")
