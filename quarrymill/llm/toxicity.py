"""Toxicity: a support vector machine over a gap-tolerant subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACED_WORDS, giving_back, in_small_batches, materialize, text_slices, words

DECAY = 0.6
SPAN = 7  # a subsequence spreads over at most so many characters
ORDERS = (3, 4)
LETTERS = 27
DIMS = LETTERS**4
WORD_CHARS = 32
TELLING, NEAR, OTHERS = 192, 128, 64  # landmarks
SAMPLE_ROWS = 5_000
COST, SPREAD_COST, HARD_COST, HARD_FROM = 2_000.0, 0.15, 3.0, 0.25
PASSES = 6
TASKS = 12
GRAM = 4
STRETCH_STEP = 8_192
ELEMENTS = 400_000
KNOWN_WORDS = 100_000
THRESHOLD = 0.3


def _codes_of() -> np.ndarray:
    """1 to 26 for what is a letter a-z without its case and accents, 0 for the rest, by code point below 0x250."""
    out = np.zeros(0x250, dtype=np.int64)
    for i in range(0x250):
        base = unicodedata.normalize("NFD", chr(i).lower())[:1]
        if "a" <= base <= "z":
            out[i] = ord(base) - 96
    out[0xDF] = ord("s") - 96
    return out


CODES = _codes_of()
_shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _shape(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (padded to four by -1) and weights of the subsequences of a word of so many characters."""
    if length not in _shapes:
        at, weight = [], []
        for order in ORDERS:
            for first in range(length):
                for rest in combinations(range(first + 1, min(length, first + SPAN)), order - 1):
                    at.append((first, *rest, *[-1] * (4 - order)))
                    weight.append(DECAY ** (rest[-1] - first + 1 - order))
        _shapes[length] = np.array(at, dtype=np.int64).reshape(-1, 4), np.array(weight)
    return _shapes[length]


def features(text: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices of the words, feature numbers, weights), words of a length together and some ELEMENTS weights at once: a feature is a sequence of three or four letters, its weight falls with the gaps that it spans; a word's weights have a sum of squares of 1. Characters other than letters only make gaps; of a word only its first WORD_CHARS characters count, so longer ones are given in parts."""
    raw = [w[:WORD_CHARS] for w in text]
    sizes = np.array([len(w) for w in raw], dtype=np.int64)
    for n in np.unique(sizes):
        if n < min(ORDERS):
            continue
        at, weight = _shape(int(n))
        every = np.flatnonzero(sizes == n)
        for which in np.array_split(every, -(-len(every) * len(at) // ELEMENTS)):
            points = np.frombuffer("".join(raw[i] for i in which).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n)
            codes = np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], 0)
            codes = np.concatenate([codes, np.zeros((len(codes), 1), dtype=np.int64)], axis=1).astype(np.int32)
            letters = (codes[:, :-1] > 0).all(axis=1)
            for rows, plain in ((np.flatnonzero(letters), True), (np.flatnonzero(~letters), False)):
                if not len(rows):
                    continue
                own = codes[rows]
                number = ((own[:, at[:, 0]] * LETTERS + own[:, at[:, 1]]) * LETTERS + own[:, at[:, 2]]) * LETTERS + own[:, at[:, 3]]
                if plain:
                    yield which[rows], number, np.broadcast_to(weight / np.sqrt((weight**2).sum()), number.shape)
                    continue
                there = own > 0
                there[:, -1] = True
                strength = np.where(there[:, at[:, 0]] & there[:, at[:, 1]] & there[:, at[:, 2]] & there[:, at[:, 3]], weight, 0.0)
                norm = np.sqrt((strength**2).sum(axis=1, keepdims=True))
                yield which[rows], np.where(strength > 0, number, 0), strength / np.maximum(norm, 1e-12)


class Landmarks:
    """Words whose kernels with others are the coordinates of these, kept by the features that any of them has."""

    def __init__(self, words_: list[str]) -> None:
        self.words = words_
        found = [(np.repeat(which, number.shape[1]), number.ravel(), np.ascontiguousarray(weight).ravel()) for which, number, weight in features(words_)]
        word, number, weight = (np.concatenate([x[k] for x in found]) if found else np.empty(0, dtype=np.int64) for k in range(3))
        own, at = np.unique(number[weight > 0], return_inverse=True)
        self.slot = np.zeros(DIMS, dtype=np.int32)
        self.slot[own] = np.arange(1, len(own) + 1)
        self.weights = np.zeros((len(own) + 1, len(words_)), dtype=np.float32)  # row 0 is for all other features
        np.add.at(self.weights, (at + 1, word[weight > 0]), weight[weight > 0])
        self.half = np.eye(len(words_))

    def kernels(self, words_: list[str]) -> np.ndarray:
        """The kernel of each word with each landmark: the inner product of their features."""
        out = np.zeros((len(words_), len(self.words)))
        for which, number, weight in features(words_):
            step = max(1, 4 * ELEMENTS // (number.shape[1] * len(self.words)))
            for k in range(0, len(which), step):
                out[which[k : k + step]] = np.matmul(weight[k : k + step, None, :].astype(np.float32), self.weights[self.slot[number[k : k + step]]])[:, 0, :]
        return out

    def whiten(self) -> None:
        """From now on kernels times the inverse root of the landmarks' own, the Nystroem features."""
        value, vector = np.linalg.eigh(self.kernels(self.words) + 1e-3 * np.eye(len(self.words)))
        self.half = vector / np.sqrt(np.maximum(value, 1e-6))

    def rows(self, words_: list[str]) -> np.ndarray:
        return np.hstack([self.kernels(words_) @ self.half, np.ones((len(words_), 1))])

    def model(self, w: np.ndarray) -> Model:
        """The machine of weights w of rows, as weights of features, which are far faster to apply."""
        weights = np.zeros(DIMS)
        weights[np.flatnonzero(self.slot)] = self.weights[1:] @ (self.half @ w[:-1])
        return Model(weights, w[-1], np.zeros(3))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The kernel of each word of a with each of b."""
    return Landmarks(b).kernels(a)


class Model:
    """The decision of a word is the sum of landmark kernels, kept as weights of features; that of a text comes from its highest words."""

    def __init__(self, weights: np.ndarray, bias: float, text_weights: np.ndarray) -> None:
        self.weights, self.bias, self.text_weights = weights.astype(np.float32), bias, text_weights

    def margins(self, text: list[str]) -> np.ndarray:
        out = np.full(len(text), float(self.bias))
        for which, number, weight in features(text):
            out[which] += np.einsum("ij,ij->i", self.weights[number], weight)
        return out

    def highest(self, texts: list[str]) -> np.ndarray:
        """Of texts without known word bounds: the highest margin of all stretches of GRAM to WORD_CHARS characters, wherever they start."""
        gap = WORD_CHARS - 1  # no stretch reaches from one text into the next
        points = np.frombuffer("".join(t + "\0" * gap for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], 0)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begins = np.cumsum(sizes + gap) - sizes - gap
        best = np.full(len(letters), -np.inf)
        where, weight = _shape(SPAN)
        shapes = [([x for x in at if x >= 0], w) for at, w in zip(where.tolist(), weight.tolist(), strict=True) if at[0] == 0]
        for at in range(0, len(letters), STRETCH_STEP):
            codes = letters[at : at + STRETCH_STEP + gap]
            n = len(codes)
            if np.count_nonzero(codes) < min(ORDERS):
                continue
            # What the subsequences that end at a character add, by their span: a stretch one longer gains those that don't begin before it.
            gain, square = np.zeros((SPAN, n)), np.zeros((SPAN, n))
            for places, w in shapes:
                if (last := places[-1]) >= n:
                    continue
                number, there = np.zeros(n - last, dtype=np.int64), np.ones(n - last, dtype=bool)
                for x in places:
                    own = codes[x : n - last + x]
                    number, there = number * LETTERS + own, there & (own > 0)
                number = np.where(there, number * LETTERS ** (4 - len(places)), 0)
                gain[last, last:] += np.where(there, w * self.weights[number], 0)
                square[last, last:] += np.where(there, w * w, 0)
            gain, square = gain.cumsum(axis=0), square.cumsum(axis=0)
            total, norm = np.zeros(n), np.zeros(n)
            for size in range(min(ORDERS), min(WORD_CHARS, n) + 1):
                starts, span = n - size + 1, min(size, SPAN) - 1
                total, norm = total[:starts] + gain[span, size - 1 :], norm[:starts] + square[span, size - 1 :]
                if size >= GRAM:
                    np.maximum(best[at : at + starts], total / np.sqrt(np.maximum(norm, 1e-24)), out=best[at : at + starts])
        place = np.arange(len(letters)) - np.repeat(begins, sizes + gap)
        best[place > np.repeat(np.maximum(0, sizes - GRAM), sizes + gap)] = -np.inf
        highest = np.maximum.reduceat(best, begins)
        return self.bias + np.where(np.isfinite(highest), highest, 0.0)

    def scores(self, top: np.ndarray) -> np.ndarray:
        """Of texts, from the two highest margins of each."""
        return 1 / (1 + np.exp(-np.clip(_evidence(top) @ self.text_weights, -30, 30)))


def _evidence(top: np.ndarray) -> np.ndarray:
    """Margins as the log odds that they stand for (where words of both labels agree in all, the squared hinge is least at the difference of their shares), and a constant."""
    return np.hstack([2 * np.arctanh(np.clip(top, -0.98, 0.98)), np.ones((len(top), 1))])


def joined_letters(text: str) -> list[str]:
    """Words spelled out as three or more single characters between spaces."""
    out, run = [], []
    for w in [*text.split(), "  "]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def top_margins(model: Model, batch: pa.RecordBatch, column: str, known: dict[int, float]) -> np.ndarray:
    """The two highest margins among each text's words; one of over WORD_CHARS characters, or spelled out, has that of its highest stretch. known keeps the margins of words by hash."""
    top = np.full((batch.num_rows, 2), -1.0)
    for row, end, data, offsets in text_slices(batch, column):
        starts, ends, hashes, first = words(data, offsets, SPACED_WORDS)
        distinct, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(known) > KNOWN_WORDS:
            known.clear()
        fresh = np.array([i for i, h in enumerate(distinct.tolist()) if h not in known], dtype=np.int64)
        if len(fresh):
            raw = data.tobytes()
            texts = [raw[starts[j] : ends[j]].decode("utf-8", "replace").lower() for j in index[fresh]]
            margins = model.margins(texts)
            if long := [j for j, t in enumerate(texts) if len(t) > WORD_CHARS]:
                margins[long] = model.highest([texts[j] for j in long])
            known.update(zip(distinct[fresh].tolist(), margins.tolist(), strict=True))
        margin = np.array([known[h] for h in distinct.tolist()])[back] if len(distinct) else np.empty(0)
        single = np.concatenate([[0], np.cumsum(ends - starts == 1)])
        for i in range(row, end):
            a, b = first[i - row], first[i - row + 1]
            own = margin[a:b]
            if single[b] - single[a] >= 3 and (spelled := joined_letters(batch.column(column)[i].as_py())):
                own = np.concatenate([own, model.highest([x.lower() for x in spelled])])
            if len(own) >= 2:
                top[i] = np.sort(np.partition(own, len(own) - 2)[-2:])[::-1]
            elif len(own):
                top[i, 0] = own[0]
    return top


class _Gaps(dict):
    """A table for str.translate: letters without case and accents, white space as it is, a gap for the rest."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = chr(96 + CODES[point]) if point < len(CODES) and CODES[point] else c if c.isspace() else "\0"
        return self[point]


_GAPS = _Gaps()


def training_words(text: str) -> set[str]:
    """The words of a text, whole: those of over WORD_CHARS characters, and what is spelled out letter by letter, in parts that overlap by half."""
    plain = text.lower().translate(_GAPS)
    found = set(plain.split())
    found.update(joined_letters(plain))
    half, out = WORD_CHARS // 2, set()
    for w in found:
        for k in range(0, max(1, len(w) - half), half):
            if len(part := w[k : k + WORD_CHARS].strip("\0")) >= min(ORDERS):
                out.add(part)
    return out


def _spread(word: str) -> list[str]:
    """A word with characters put in between."""
    return [w for w in ("\0".join(word), word[:1] + "\0" + word[1:], word[: len(word) // 2] + "\0" + word[len(word) // 2 :]) if len(w) <= WORD_CHARS]


def _words_of(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many of rows (text, toxic) of each label each word stands; counted on the executors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic"), strict=True):
                found = pa.array(sorted(training_words(text.as_py())), pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(np.full(len(found), label.as_py(), dtype=np.int32))], ["word", "label"])

    counted = rows.select("text", "toxic").mapInArrow(giving_back(cut), "word string, label int").groupBy("word")
    return counted.agg(F.sum("label").cast("long").alias("toxic"), F.sum(1 - F.col("label")).cast("long").alias("clean"))


def _over(words_: DataFrame, of, schema: str) -> DataFrame:
    """of(words, toxic, clean) of each batch, as a record batch of schema."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield of(batch.column("word"), batch.column("toxic").to_numpy().astype(float), batch.column("clean").to_numpy().astype(float))

    return words_.select("word", "toxic", "clean").mapInArrow(giving_back(apply), schema)


def _sums(words_: DataFrame, terms, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all words of c * x x' and d * x, where terms gives (x, c, d) of a batch's words; a row of fixed size comes from each of the TASKS parts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, linear = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x, c, d = terms(part.column("word").to_pylist(), part.column("toxic").to_numpy().astype(float), part.column("clean").to_numpy().astype(float))
                square += x.T @ (x * c[:, None])
                linear += x.T @ d
        yield pa.RecordBatch.from_arrays([pa.array([square[np.triu_indices(size)].tobytes()], pa.binary()), pa.array([linear.tobytes()], pa.binary())], ["square", "linear"])

    square, linear = np.zeros((size, size)), np.zeros(size)
    for row in words_.select("word", "toxic", "clean").mapInArrow(giving_back(apply), "square binary, linear binary").collect():
        square[np.triu_indices(size)] += np.frombuffer(bytes(row.square))
        linear += np.frombuffer(bytes(row.linear))
    return square + np.triu(square, 1).T, linear


def train(rows: DataFrame) -> Model | None:
    """From rows (text, toxic) of labelled texts. None without both labels, or without words in texts of label 1.

    A text's label is that of its sentences and of every word in them, so a word counts for each label by the share of that label's texts
    that have it: what stands in both alike says nothing, what stands in one pulls the machine there, and rare forms share through the
    kernel what their like have shown. Landmarks are the words that tell most of label 1, by likelihood ratio, the clean words that are
    nearest to them, and others by hash. The squared hinge is least by Newton steps: the sums over all words are made once, and after
    that only words past the margin, or clean ones over HARD_FROM, which then cost HARD_COST times as much, change them. All words of
    the rows count; the driver has the landmarks, sums of their size and two margins a text.
    """
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return None
    send = rows.sparkSession.sparkContext.broadcast
    words_ = materialize(_words_of(rows).repartition(TASKS))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    term = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * share))).otherwise(0.0)
    evidence = term(a, bad / (bad + good)) + term(b, good / (bad + good))
    telling = [r.word for r in words_.where(a * good > b * bad).orderBy(evidence.desc(), "word").limit(TELLING).select("word").collect()]
    if not telling:
        return None
    like = np.zeros(DIMS)
    for _, number, weight in features(telling):
        np.add.at(like, number.ravel(), np.ascontiguousarray(weight).ravel())
    nearness = send(Model(like, 0.0, np.zeros(3)))

    def near(word: pa.Array, _: np.ndarray, __: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([word, pa.array(nearness.value.margins(word.to_pylist()))], ["word", "near"])

    clean = _over(words_.where(a * good < b * bad), near, "word string, near double")
    nearest = [r.word for r in clean.orderBy(F.round("near", 9).desc(), "word").limit(NEAR).select("word").collect()]
    others = [r.word for r in words_.orderBy(F.xxhash64("word"), "word").limit(OTHERS).select("word").collect()]
    landmarks = Landmarks(list(dict.fromkeys([*telling, *nearest, *others])))
    landmarks.whiten()
    sent, size = send(landmarks), len(landmarks.words) + 1
    cost = COST / bad, COST / good

    def all_terms(word: list[str], toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Words that tell much count with characters put in between too, so that these pull the machine the same way.
        known = set(sent.value.words[: len(telling)])
        more = [(w, i) for i, x in enumerate(word) if x in known for w in _spread(x)]
        at = np.concatenate([np.arange(len(word)), np.array([i for _, i in more], dtype=np.int64)])
        share = np.where(np.arange(len(at)) < len(word), 1.0, SPREAD_COST)
        p, q = toxic[at] * cost[0] * share, clean[at] * cost[1] * share
        return sent.value.rows([*word, *(w for w, _ in more)]), p + q, p - q

    square, linear = _sums(words_, all_terms, size)
    ridge = np.eye(size)
    ridge[-1, -1] = 1e-3
    w = np.linalg.solve(ridge + square, linear)
    first = send(landmarks.model(w))
    for _ in range(PASSES):
        now = send(landmarks.model(w))

        def changes(word: list[str], toxic: np.ndarray, clean: np.ndarray, now=now) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            margin, before = now.value.margins(word), first.value.margins(word)
            p, q = toxic * cost[0], clean * cost[1]
            q = np.where((before > HARD_FROM) & (toxic * good < clean * bad), HARD_COST, 1.0) * q
            own = np.where(margin < 1, p, 0), np.where(margin > -1, q, 0)
            c, d = own[0] + own[1] - toxic * cost[0] - clean * cost[1], own[0] - own[1] - toxic * cost[0] + clean * cost[1]
            some = np.flatnonzero((c != 0) | (d != 0))
            return sent.value.rows([word[i] for i in some]), c[some], d[some]

        more, further = _sums(words_, changes, size)
        new = np.linalg.solve(ridge + square + more, linear + further)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-3:
            break
    model = landmarks.model(w)
    last = send(model)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            top = top_margins(last.value, batch, "text", known)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(top[:, 0]), pa.array(top[:, 1])], ["toxic", "a", "b"])

    tops = sorted((r.toxic, r.a, r.b) for r in rows.select("text", "toxic").mapInArrow(giving_back(of_texts), "toxic int, a double, b double").collect())
    label, x = np.array([t[0] for t in tops], dtype=float), _evidence(np.array([t[1:] for t in tops]))
    v, ridge = np.zeros(3), np.array([0.5, 0.5, 0.01])
    for _ in range(200):  # logistic regression by damped Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (label - p) - ridge * v)
        v = v + 0.5 * step
        if np.abs(step).max() < 1e-6:
            break
    model.text_weights = v
    return model


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic): at most `most` labelled rows, chosen by the hash of their id so that the labels keep their shares, with their whole texts; rows held out (crc32 of the id, as text, modulo 4 is 2) aren't among them. Of an id with several labels the highest holds; an id with several texts has them all."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(TASKS))


def held_out(column: str):
    """Whether the crc32 of the id, as text, modulo 4 is 2; an id that is null isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): of each whole text, from 0 to 1, higher the likelier it is toxic. Null and empty texts get the score of no words, repeated rows the same one each; without a model all get 0."""
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(top_margins(sent.value, batch, "text", known)))], ["doc_id", "score"])

    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(apply), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def not_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that score at least threshold; null and empty texts have the score of no words, repeated rows go or stay alike."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(top_margins(sent.value, batch, text_col, known)) < threshold))

    return in_small_batches(docs).mapInArrow(giving_back(apply), docs.schema)
