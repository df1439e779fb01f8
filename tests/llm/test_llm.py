"""The ten operators against brute force, exact round trips, held-out accuracy and the edge cases that their docstrings state."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import rows_of, rows_of_sql
from conftest import SF
from pyspark.sql import functions as F

from quarrymill.llm.common import BITMAP_BITS, SPACED_WORDS, broadcast_bytes, text_slices, words
from quarrymill.llm import decontaminate, minhash, pieces, quality, queries, repeats, secret_scan, sharding, topk, toxicity, wrappers

EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "é😀" * 3_000), (6, "same text here " * 40), (7, "same text here " * 40), (7, "same text here " * 40), (None, "no id but a text of some words"), (8, None)]
BENCH = "item_id long, text string"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text), if asked with columns whose names the operators use too."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for c in ("score", "label", "node", "key", "size", "shard", "text_key", "kept", "item_id", "n", "window", "spans", "ids") if extra else ():
            df = df.withColumn(c, F.lit("x"))
        return df

    return make



@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns, want = rows_of_sql(queries.ORACLES[name], SF)
    assert sorted(got.columns) == columns and rows_of(got, columns) == want


def test_words_of_a_pattern_keep_apart(docs_of):
    pattern = "a"
    for _ in range(11):
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    other = pattern.translate(str.maketrans("ab", "ba"))
    for n in (8, 9, 1_024, 2_048):
        texts = [f"one {x[:n]} two" for x in (pattern, other)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
        a, b = (minhash.shingle_sets(data, offsets, 2)[k] for _, _, data, offsets in text_slices(batch, "text") for k in range(2))
        assert not len(np.intersect1d(a, b))
        assert [x.component_id for x in sorted(minhash.near_duplicates(docs_of(list(enumerate(texts))), 2).collect(), key=lambda x: x.doc_id)] == [0, 1]


def test_word_hashes_are_of_the_bytes_alone():
    r = random.Random(5)
    texts = ["".join(r.choice("ab\x00é") for _ in range(r.randint(1, 40))) for _ in range(2_000)]
    data = np.frombuffer(" ".join(texts).encode(), dtype=np.uint8)
    starts, ends, hashes, _ = words(data, np.array([0, len(data)]), SPACED_WORDS)
    own = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert len(set(own)) == len(set(hashes.tolist())) == len(set(zip(own, hashes.tolist())))


# 1 pieces


def _all_segmentations(v, text):
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        for end in range(at + 1, min(len(text), at + v.longest) + 1):
            for start, piece, s in pieces._edges(v, text, end):
                if start == at:
                    go(end, score + s, ids + ([piece] if piece >= 0 else pieces._spelled(v, text[at])))

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_is_brute_force():
    v, r = pieces.load(), random.Random(1)
    for _ in range(150):
        text = "".join(r.choice("then é▁er ing中😀\n") for _ in range(r.randint(0, 8)))
        flat, counts, best = pieces.Encoder(v, 5).batch([text])
        assert pieces.decode_ids(v, flat.tolist()) == text
        best = best.to_pylist()
        every = _all_segmentations(v, "".join(map(pieces._symbols, pieces.units(text))))
        assert [x["score"] for x in best[0]] == [s for s, _ in every[:5]]
        for x in best[0]:
            ids = flat.tolist()
            for c in reversed(x["changes"]):
                ids[c["at"] : c["at"] + c["n"]] = c["ids"]
            assert (x["score"], ids) in every


def test_one_worker_does_what_two_do(docs_of, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_CHARACTERS", 1_000)
    docs = docs_of([*EDGES, (20, "then the other ing\nthe é😀 then  "), (21, "▁ a")], extra=True)
    two = pieces.decode(pieces.encode(docs), keep=("doc_id", "n_pieces", "ids", "n_best"))
    one = pieces.encode_and_decode(docs)
    assert one.schema.simpleString() == two.schema.simpleString() and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_many_texts_at_once_are_each_alone():
    v, r = pieces.load(), random.Random(3)
    texts = ["".join(r.choice("then é▁er ing中😀\n") for _ in range(r.randint(0, 200))) for _ in range(40)]
    flat, counts, best = pieces.Encoder(v, 4).batch(texts)
    alone = [pieces.Encoder(v, 4).batch([t]) for t in texts]
    assert flat.tolist() == [i for ids, _, _ in alone for i in ids.tolist()] and best.to_pylist() == [b.to_pylist()[0] for _, _, b in alone]


def test_agreement_with_the_library():
    """The file is of merges, which no sum of scores repeats in all; by words, the best segmentation is mostly the library's, and the number of pieces nearly so."""
    import sentencepiece

    v, library = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    words = Counter(u for t in texts for u in pieces.units(t) if u.startswith(" ") and u.strip())
    ids, counts, _, _ = pieces.best_and_gap(v, [pieces._symbols(u) for u in words])
    ends = np.cumsum(counts)
    same = sum(words[u] for u, e, n in zip(words, ends, counts, strict=True) if ids[e - n : e].tolist() == library.encode(u[1:]))
    assert same > 0.75 * sum(words.values())
    _, counts, _ = pieces.Encoder(v, 1).batch(texts)
    assert abs(counts.sum() / sum(len(library.encode(t)) for t in texts) - 1) < 0.02


def test_a_vocabulary_over_the_cuts_is_refused(monkeypatch):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "of▁the" if i == 5_000 else whole(self, i))
    with pytest.raises(ValueError, match="of▁the"):
        pieces.load()


def test_long_unit_of_ties():
    text = "a" * 3_000 + "😀" * 500
    flat, _, best = pieces.Encoder(pieces.load(), 4).batch([text])
    assert pieces.decode_ids(pieces.load(), flat.tolist()) == text and len(best[0]) == 4


def test_pieces_edges(spark, docs_of):
    docs = docs_of(EDGES, extra=True)
    out = pieces.decode(pieces.encode(docs), keep=("doc_id", "n_pieces")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, t or "") for i, t in EDGES)
    assert {r.n_pieces for r in out if r.text == ""} == {0}
    assert pieces.encode(docs_of([])).count() == 0


# 2 secrets


def test_secret_scan(spark, docs_of):
    r = random.Random(2)
    token = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = {1: "pässword: hunter22hunter Password = 'short' API_KEY=\"abcdefgh12\"", 2: "x AKIAABCDEFGHIJKL1 AKIAshort", 3: "é " + "0123456789abcdef" * 2, 4: f"see {token} here", 5: "path/to/some-ordinary_file-name/and-more thequickbrownfoxjumpsoverthelazydog", 6: None, 7: "", 8: "ſecret=abcdefghij"}
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secret_scan.scan(docs_of(texts.items(), extra=True)).collect()}
    for i, t in texts.items():
        assert [s for s in got[i] if s[0] != "random"] == sorted(secret_scan.base_spans(t or ""), key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
    assert [s[0] for s in got[1]] == ["assign"] and got[2] == [("access", 2, 19)] and got[3] == [("hex", 2, 34)] and got[8] == []
    assert got[4] == [("random", 4, 44)] and got[5] == got[6] == got[7] == []


def test_thresholds_of_one_mixture_at_any_size():
    def of(times, others):  # 10 000 random tokens, and others in the bins given
        width = np.diff(np.append(secret_scan.EDGES, 1.0))
        width[-2:] = 0.25, 0.25
        n = np.round(10_000 * width).astype(int) + [others.get(k, 0) for k in range(len(width))]
        return secret_scan.thresholds([(2, k, int(x) * times) for k, x in enumerate(n)])[2]

    # Others just over the least edge, others up to a tenth, others everywhere (so that no threshold reaches the share), and none.
    for others, want in (({3: 3_000}, 0.01), ({k: 2_000 for k in range(2, 7)}, 0.1), ({k: 20_000 // k for k in range(2, 15)}, secret_scan.DEFAULT_CUT), ({}, 0.001)):
        assert of(1, others) == of(100, others) == of(10_000, others) == want
    small, large = ([(2, 3, 10 * n), (2, 9, 20 * n), (2, 15, 20 * n)] for n in (1, 100))
    assert secret_scan.thresholds(small) == secret_scan.thresholds(large)
    # 100 tokens and many more of one mixture, random ones alone or with three others to ten.
    for shares in ({7: 10, 15: 40, 16: 50}, {3: 30, 7: 7, 15: 28, 16: 35}):
        assert len({secret_scan.thresholds([(2, k, n * times) for k, n in shares.items()])[2] for times in (1, 10, 40, 41, 1_000)}) == 1


def test_values_names_of_paths_and_upper_case(spark, docs_of):
    r = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = "".join(r.choice(letters + letters.lower() + "0123456789+/") for _ in range(40))
    word = "".join(r.choice(letters + letters.lower() + "0123456789") for _ in range(40))
    upper = "".join(r.choice(letters + "0123456789") for _ in range(40))
    assert secret_scan.inferred_encoding(upper)[0] == "base36" and set("0189") & set(upper)
    hidden = {1: ("AWS_SECRET_ACCESS_KEY=", value, ""), 2: ("https://x.example/a?sig=", word, "&b=1"), 3: ("sig=", value, "=="), 4: ("key ", upper, " x"), 5: ("see /home/someone/files/of/mine/", word, "/index"), 6: ("a=b=", word, "=c"), 7: ("KEY=", upper, "")}
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secret_scan.scan(docs_of([(i, "".join(t)) for i, t in hidden.items()])).collect()}
    assert got == {i: [("random", len(a), len(a + t) + (2 if i == 3 else 0))] for i, (a, t, _) in hidden.items()}
    masked = {x.doc_id: x.text for x in secret_scan.redact(docs_of([(i, "".join(t)) for i, t in hidden.items()])).collect()}
    assert masked[1] == "AWS_SECRET_ACCESS_KEY=[SECRET]" and masked[2] == "https://x.example/a?sig=[SECRET]&b=1"


def test_what_passes_is_mostly_random():
    r = random.Random(11)
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 6)))

    def name() -> str:  # words in camel case with a number, as identifiers are
        made = ""
        while len(made) < 34:
            made += word().capitalize()
        return made[:34] + str(r.randint(10, 99))

    for n_random, n_names in ((40, 10), (400, 100), (3_000, 3_000)):
        tokens = [(True, "".join(r.choice(alphabet) for _ in range(36))) for _ in range(n_random)] + [(False, name()) for _ in range(n_names)]
        scored = [(truth, p) for truth, t in tokens if (p := secret_scan.randomness_p(t)) is not None]
        bins = Counter(int(np.searchsorted(secret_scan.EDGES, p, side="right")) - 1 for _, p in scored)
        limit = secret_scan.thresholds([(2, k, n) for k, n in bins.items()])[2]
        passed = [truth for truth, p in scored if p > limit]
        assert sum(passed) >= 0.85 * n_random and passed.count(False) <= 0.1 * len(passed), (n_random, limit, len(passed))


def test_redaction(spark, docs_of):
    out = {r.doc_id: r for r in secret_scan.redact(docs_of([(1, 'a token = "0123456789abcdef0123456789abcdef" b'), (2, None), (3, "plain")], extra=True)).collect()}
    assert out[1].text == 'a [SECRET]" b' and out[2].text is None and out[3].text == "plain" and out[1].key == "x"
    assert secret_scan.redact(docs_of([])).count() == 0


def test_random_tokens_pass_and_text_does_not():
    r = random.Random(4)
    p = [secret_scan.randomness_p("".join(r.choice("0123456789abcdef") for _ in range(40))) for _ in range(400)]
    assert 0.4 < float(np.mean(np.array(p) > 0.5)) < 0.75 and float(np.mean(np.array(p) < 0.001)) < 0.02
    assert secret_scan.randomness_p("abababababababababab12121212121212121212") < 1e-6
    assert secret_scan.randomness_p("onlyletterswithoutanydigits") is None
    assert secret_scan.thresholds([]) == [secret_scan.thresholds([])[0]] * len(secret_scan.BANDS)
    mixed = [(0, 0, 500), (0, 3, 300)] + [(0, k, 5) for k in range(4, len(secret_scan.EDGES))]
    assert secret_scan.thresholds(mixed)[0] > secret_scan.EDGES[3]


# 3 top-k


def test_topk_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [0.1, 0.1]), (4, None), (5, [1.0, None]), (6, [inf, 1.0]), (7, [float("nan"), 1.0]), (50, [1e300, -1e300]), (51, [2.0]), (None, [1.0, 1.0]), (100, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.self_top_k(df).collect()
    v = {i: [int(np.floor(256 * x)) if abs(x) < 1e15 else int(256 * x) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    limit = (1 << 63) - 1
    for q in (0, 50, 100):
        scored = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(v[q], e)))), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        if q != 50:  # sums beyond a double's exact integers are compared by rank alone
            assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
        assert [m[1] for m in mine] == [i for _, i in scored]
    assert topk.self_top_k(df.where("vec_id < 0")).count() == 0


def test_topk_merges_up_the_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 5)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    r = np.random.default_rng(0)
    e = r.integers(-3, 4, (200, 4)) / 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    q = np.floor(256 * e).astype(int)
    for row in topk.self_top_k(df).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x")).collect():
        want = sorted((-int(q[row.query_id] @ q[j]), j) for j in range(200) if j != row.query_id)[:5]
        assert [(x.vec_id, x.score) for x in row.x] == [(j, -s) for s, j in want]


# 4 decontamination


def _hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, t in items:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(13, len(b))
        for s in range(len(b) - n + 1) if b and item is not None else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[s : s + n]:
                    hit |= set(range(at, at + n))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_is_brute_force(spark, docs_of):
    r = random.Random(5)
    words = ["a", "b", "Ab", "c9", "é", "x_y"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 13, 14, 30])))) for i in range(25)] + [(90, None), (None, "a b c9"), (91, "é"), (92, "É")]
    docs = [(i, " ".join(r.choice(words) for _ in range(40)) + " " + r.choice(items[:25])[1]) for i in range(40)] + EDGES
    got, _ = decontaminate.contamination(docs_of(docs, extra=True), spark.createDataFrame(items, BENCH).withColumn("doc_id", F.lit(1)))
    rows = Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got.collect())
    assert rows == Counter((i, *_hits(t, items)) for i, t in docs)


def test_contamination_salted_and_empty(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    text = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, text)], BENCH)
    got, hits = decontaminate.contamination(docs_of([(i, f"pre {text} post") for i in range(50)]), bench)
    assert {(r.n_hit, r.contaminated) for r in got.collect()} == {(30, True)} and hits.count() == 50 * 18
    assert decontaminate.contamination(docs_of([]), bench)[0].count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs_of(EDGES), bench.where("item_id < 0"))[0].collect()} == {0}


# 5 sharding


def test_best_fit_is_brute_force():
    r = random.Random(6)
    for _ in range(50):
        sizes = sorted((r.randint(1, 60) for _ in range(60)), reverse=True)
        free, want = [], []
        for s in sizes:
            fits = [(f, b) for b, f in enumerate(free) if f >= s]
            b = min(fits)[1] if fits else len(free)
            if not fits:
                free.append(100)
            free[b] -= s
            want.append(b)
        # Bins of equal room may be taken in another order, which changes no sum.
        got = sharding.best_fit_decreasing(sizes, 100)
        fill = lambda bins: sorted(sum(s for s, b in zip(sizes, bins) if b == k) for k in set(bins))
        assert max(got) == max(want) and fill(got) == fill(want) and max(fill(got)) <= 100


def test_runs_of_equal_items_are_item_by_item():
    r = random.Random(8)
    for _ in range(50):
        runs = [(size, r.randint(1, 30)) for size in sorted(r.sample(range(1, 130), 12), reverse=True)]
        fills, singly = Counter(), Counter()
        for run, b, n in sharding.best_fit_runs(runs, 100):
            fills[b] += runs[run][0] * n
        sizes = [size for size, count in runs for _ in range(count)]
        for size, b in zip(sizes, sharding.best_fit_decreasing(sizes, 100), strict=True):
            singly[b] += size
        assert sorted(fills.values()) == sorted(singly.values())
        placed = sharding.pack(runs, 7)
        assert Counter({run: sum(n for r_, _, n in placed if r_ == run) for run in range(12)}) == Counter({run: count for run, (_, count) in enumerate(runs)})
        assert {b for _, b, _ in placed} <= set(range(7))
    assert sharding.pack([], 4) == [] and [b for _, b, _ in sharding.pack([(9, 1)], 4)] == [0]


def test_shards_by_size_classes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_PER_SHARD", 8)
    monkeypatch.setattr(sharding, "PART_ROWS", 40)
    r = random.Random(9)
    rows = [(i, f"{i % 900} " + "w" * (r.randint(0, 20) if i % 3 else r.randint(0, 900))) for i in range(1_500)] + [(5_000 + i, "") for i in range(900)] + [(9_000 + i, "twice") for i in range(2)]
    got = sharding.shard_documents(docs_of(rows)).collect()
    sums, slots, of = Counter(), {}, {}
    for x in got:
        sums[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
        of.setdefault(dict(rows)[x.doc_id], set()).add(x.shard)
    assert len(got) == len(rows) and set(sums) == set(range(16)) and all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums.values()) < 0.02 * max(sums.values())


def test_shards(spark, docs_of):
    r = random.Random(7)
    rows = [(i, "x" * r.randint(0, 300) + str(i % 250)) for i in range(600)] + [(1_000 + i, "copy" * 20) for i in range(100)] + EDGES
    got = sharding.shard_documents(docs_of(rows, extra=True)).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sums, slots, of = Counter(), {}, {}
    text = {}
    for i, t in rows:
        text.setdefault((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1), t)
    for x in got:
        sums[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
        of.setdefault(text[x.doc_id, x.text_crc32, x.size], set()).add(x.shard)
    assert set(sums) <= set(range(16)) and all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = [s for k, s in sums.items() if k not in of["copy" * 20] | of["é😀" * 3_000]]
    assert max(small) - min(small) < 0.05 * max(small)
    assert sharding.shard_documents(docs_of([])).count() == 0


# 6 near duplicates


def _sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def _components(rows, size, percent=80):
    sets = [(i, _sets(t, size)) for i, t in rows]
    of = {i: i for i, _ in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            of[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("size,small", [(2, 16), (5, 1)])
def test_near_duplicates_are_brute_force(spark, docs_of, monkeypatch, size, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    r = random.Random(8)
    rows = []
    for family in range(12):
        base = [r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.choice([3, 30, 80]))]
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(["X1", "q", "z9"])
            rows.append((len(rows) + 10, (" " if r.random() < 0.5 else "\n").join(w)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two")]
    got = {x.doc_id: x for x in minhash.near_duplicates(docs_of(rows, extra=True), shingle=size).collect()}
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == _components(rows, size)
    assert all(x.kept == (i == x.component_id) for i, x in got.items())


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    for share in (0.2, 0.5, 0.8):
        off = []
        for n in (5, 90, 700):
            for _ in range(40):
                both = round(2 * n * share / (1 + share))
                same = draw(both)
                x, y = (minhash.signature(np.concatenate([same, draw(n - both)])) for _ in range(2))
                off.append((x == y).mean() - both / (2 * n - both))
        assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06
    first = draw(3)
    shifts = minhash.signature(first[:1])
    places = np.arange(minhash.BANDS * minhash.BAND_ROWS)
    assert len(set(shifts.tolist())) == len(places) and (minhash.signature(first) == np.minimum.reduce([minhash.signature(first[i : i + 1]) for i in range(3)])).all()


def test_giant_texts_share_no_band_by_chance():
    r = np.random.default_rng(6)
    x, y = (minhash.signature(r.integers(0, 2**64, 1_000_000, dtype=np.uint64)) for _ in range(2))
    assert (x == y).sum() < 3


def test_near_duplicate_edges(spark, docs_of):
    got = minhash.near_duplicates(docs_of(EDGES), shingle=2).collect()
    assert len(got) == len(EDGES)
    assert {(x.doc_id, x.component_id, x.kept) for x in got} == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (None, None, True), (8, 8, True)}
    assert minhash.near_duplicates(docs_of([])).count() == 0


# 7 quality


def test_resampling_is_brute_force(spark, docs_of):
    r = random.Random(11)
    rows = [(i, " ".join(r.choice(["good", "fine", "text", "junk***", "x%%%"][i % 2 : 3 + 2 * (i % 2)]) for _ in range(r.randint(1, 30)))) for i in range(80)] + EDGES
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows, extra=True)
    got = quality.resample(docs, labels, share=0.5).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)

    def grams(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return Counter(quality._grams(data, np.array([0, len(data)]))[0].tolist())

    target, raw = Counter(), Counter()
    for i, t in rows:
        raw += grams(t)
        if i is not None and i < 60 and i % 2 == 0 and zlib.crc32(str(i).encode()) % 4 != 2:
            target += grams(t)
    nt, nr = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    weight = {}
    for i, t in rows:
        g = grams(t)
        n = sum(g.values())
        weight[i, n] = sum(c * (np.log((target[b] + 1) / nt) - np.log((raw[b] + 1) / nr)) for b, c in g.items()) / max(n, 1) * quality.LENGTH
    assert all(abs(x.log_weight - weight[x.doc_id, x.n_grams]) < 1e-6 for x in got)
    ranked = sorted(got, key=lambda x: (-x.key, -1 if x.doc_id is None else x.doc_id))
    assert [x.kept for x in ranked] == [k < len(rows) // 2 for k in range(len(rows))]
    assert quality.resample(docs_of([]), labels).count() == 0


def test_gumbel_top_cuts_the_edge_again(spark, monkeypatch):
    monkeypatch.setattr(quality, "EDGE_ROWS", 3)
    monkeypatch.setattr(quality, "BINS", 4)
    r = random.Random(7)
    rows = [(i, r.choice([0.0, 0.0, 1.0, 1e6])) for i in range(60)] + [(3, 0.0)] * 5 + [(None, 0.0)]
    weights = spark.createDataFrame(rows, "doc_id long, log_weight double")
    for share in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = quality.gumbel_top(weights, share).collect()
        ranked = sorted(got, key=lambda x: (-x.key, -1 if x.doc_id is None else x.doc_id))
        assert [x.kept for x in ranked] == [k < int(share * len(rows)) for k in range(len(rows))]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    held = queries.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2), "doc_id").collect()
    good, bad = ([x.log_weight for x in held if x.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and np.mean([x.kept for x in held if x.quality == 1]) > 0.8


# 8 repeats


def _cut(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b) + 2, dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                covered[s + 1 : s + 1 + length] = True
        kept = bytes(x for x, c in zip(b, covered[1:-1]) if not c)
        out.append((len(b), int(covered.sum()), int((covered[1:] > covered[:-1]).sum()), kept))
    return Counter(out)


@pytest.mark.parametrize("hot", [200, 1, 0])
def test_repeats_are_brute_force(spark, docs_of, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(repeats, "HOT_WINDOWS", 100 if hot == 1 else 3)
    r = random.Random(9)
    passage = ["".join(r.choice("abcé ") for _ in range(n)) for n in (35, 60, 150)]
    noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 80)))
    rows = [(i, noise() + r.choice(passage)[r.randint(0, 10) :] + noise()) for i in range(40)] + [(90, "ab" * 60), (91, "z" * 45), (92, passage[2] + "-" + passage[2])] + EDGES
    got = repeats.remove_repeats(docs_of(rows, extra=True), length=30).collect()
    assert Counter((x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got) == _cut(rows, 30)
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_suffixes_are_sorted_while_tied(monkeypatch):
    r = random.Random(3)
    noise = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))
    raw = noise + b"\xff" + noise[5_000:8_000] + b"\xff" + b"ab" * 200 + b"\xff"
    sorted_, sort = [], np.argsort
    monkeypatch.setattr(repeats.np, "argsort", lambda x, *a, **k: (sorted_.append(len(x)), sort(x, *a, **k))[1])
    order = repeats.suffix_order(np.frombuffer(raw, dtype=np.uint8))
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    assert sum(sorted_) < 3 * len(raw)  # what is alone in its place is not sorted again


def test_run_index_leaves_out_short_matches():
    r = random.Random(4)
    passage = bytes(r.choice(b"abcd ") for _ in range(90))
    texts = [bytes(r.choice(b"abcd ") for _ in range(n)) + passage[k:] for n, k in ((30, 0), (5, 20), (50, 60))] + [passage]
    whole, cut = repeats.RunIndex(texts, 300).matching_statistics(), repeats.RunIndex(texts, 300, 40).matching_statistics()
    inside = np.concatenate([np.arange(len(t) + 1, 0, -1) > 40 for t in texts])
    assert ((whole >= 40) == (cut >= 40))[inside].all() and (cut >= 40)[inside].sum() > 100


def test_contents_of_a_batch_leave_once(docs_of, spark):
    """Equal segments are sent once however many slices of a batch hold them."""
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(3_000))
    rows = [(i, passage) for i in range(400)]
    every = broadcast_bytes(spark, b"\xff" * (BITMAP_BITS // 8))
    sent = repeats._segments_of(docs_of(rows).coalesce(1), every, 400, contents=True).select("anchor", "seg").collect()
    assert len(sent) == len(set(sent))


def test_run_index():
    texts = [b"banana", b"ananas", b"bandana"]
    index = repeats.RunIndex(texts, 20)
    joined = b"".join(t + b"\xff" for t in texts)
    got = index.matching_statistics()
    for i in range(len(joined)):
        if joined[i] != 255:
            end = joined.index(b"\xff", i)
            best = max(n for n in range(end - i + 1) if n == 0 or sum(joined[k : k + n] == joined[i : i + n] for k in range(len(joined))) > 1)
            assert min(got[i], end - i) == best  # beyond the end of a text, ends count as equal
    assert index.lengths.sum() == len(joined) and len(index.lengths) < len(joined)


# 9 wrappers

PAGES = [
    ("http://a.example/1", "<nav><a>m</a></nav><article><h1>T &amp; U</h1><p>one <b>bo</b>ld&nbsp;x<p>two<script>var t='</p>';</script></article><footer>f</footer>", "T & U one bold x two"),
    ("http://a.example/2", "<nav><a>m</a><a>n</a></nav><div class='ad'>buy</div><article><p>only</p><section class='comments'><p>hate it</p></section></article>", "only"),
    ("http://b.example/1", "<div id=menu class=menu>Home</div><div id=c><p>" + "text one " * 30 + "</p><p>more</p></div><div class='sidebar'>side</div><div>Copyright B</div>", ("text one " * 30).strip() + " more"),
    ("http://b.example/2", "<div id=menu class=menu>Home</div><div id=c><p>" + "other words " * 30 + "</p></div><div class='sidebar'>side</div><div>Copyright B</div>", ("other words " * 30).strip()),
    (None, None, ""), ("http://c.example", "", ""), ("http://d.example", "<article>bare<!-- c --> a&lt;b</article", "bare a<b"), ("http://e.example", "<article>" + "<div>" * 400 + "deep" + "</div>" * 400 + "</article>", "deep"),
    ("http://f.example", "<body class='with-sidebar'><main>m <form><input>q</form>n</main></body>", "m n"),
]


def test_wrappers(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.url, r.text) for r in wrappers.extract(df).collect()}
    assert got == {i: (u, t) for i, (u, _, t) in enumerate(PAGES)}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_of_several_layouts(spark):
    said = lambda w, i: " ".join(f"{w}{i}x{j}" for j in range(20 + i))
    menu, foot = "<div class=menu>Home</div>", "<div>Copyright</div><div class=w2>latest {}</div>"
    layouts = [lambda t: f"<article><p>{t}</p></article>", lambda t: f"<main><p>{t}</p></main>", lambda t: f"<div id=content><p>{t}</p><p>end</p></div>", lambda t: f"<section id=post><h1>t</h1><p>{t}</p></section>"]
    for url in ("http://a.example/{}", None, "odd {}"):
        # Of the last layouts the host has few pages, or one.
        pages = [(k, said("abcd"[k], i)) for k, n in enumerate((12, 6, 3, 1)) for i in range(n)]
        rows = [(i, url and url.format(i), menu + layouts[k](t) + foot.format(i)) for i, (k, t) in enumerate(pages)]
        got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: t + (" end" if k == 2 else "") if k < 3 else "t " + t for i, (k, t) in enumerate(pages)}


def test_lone_and_same_pages_without_marks(spark):
    rows = [(1, "http://a.example", "<div>short</div><div id=b><p>" + "long " * 30 + "</p></div>")] + [(i, "http://b.example", "<div>short</div><div id=b><p>" + "long " * 30 + "</p></div>") for i in (2, 3)]
    rows += [(4, "http://c.example", "<main>all <article class=card><img></article>of it</main>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "long " * 29 + "long", 2: "long " * 29 + "long", 3: "long " * 29 + "long", 4: "all of it"}


def test_deep_ends_end_nothing_above():
    deep = "<article><p>a</p>" + "<div>" * 200 + "b" + "</div>" * 200 + "<p>c</p></article><div>no</div>"
    assert wrappers.article_text(wrappers.parse(deep), wrappers.expression(wrappers.parse(deep))) == "a b c"
    outer = "<div><article>" + "<div>" * 200 + "b" + "</div>" * 200 + "<p>c</p></article></div><p>no</p>"
    assert wrappers.article_text(wrappers.parse(outer), wrappers.expression(wrappers.parse(outer))) == "b c"


def test_closed_and_open_ends_of_what_machines_read():
    of = lambda h: wrappers.article_text(wrappers.parse(h), wrappers.expression(wrappers.parse(h)))
    assert of("<article><p>a</p><svg/><p>b</p><svg w=3 /><p>c</p><svg><path/>no</svg><p>d</p></article>") == "a b c d"
    assert of("<article><p>a</p><iframe src=x><p>b</p><svg><p>c</p></article><p>no</p>") == "a b c"
    assert of("<article><p>a</p><script src='x>'/><p>b</p><script>if (a<b) no") == "a b"
    deep = "<article><p>a</p>" + "<div>" * 160 + "<div class=comments>no<p>no</p></div><div>b</div><div>c</div>" + "</div>" * 160 + "<p>d</p></article>"
    assert of(deep) == "a b c d"


def test_a_page_says_the_same_beside_any_others(spark):
    said = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    page = lambda i: f"<article><h1>Title {i}</h1><h2>Ingredients</h2><p>{said(i)}</p><div class=k8>by {i % 3}</div></article><div>end</div>"
    plain = lambda i: f"<div class=top>Home</div><div id=c><h1>Title {i}</h1><h2>Ingredients</h2><p>{said(i)}</p></div><div class=bottom>All rights</div>"
    rows = [(1_000 * n + i, f"http://h{n}.example/x", page(i)) for n in (1, 2, 7, 8, 60) for i in range(n)] + [(100_000 + 1_000 * n + i, f"http://p{n}.example/x", plain(i)) for n in (2, 7, 8, 60) for i in range(n)]
    rows += [(200_000 + i, "http://b.example/x", "<article><p>the same text everywhere</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = {1_000 * n + i: f"Title {i} Ingredients {said(i)} by {i % 3}" for n in (1, 2, 7, 8, 60) for i in range(n)}
    want |= {100_000 + 1_000 * n + i: f"Title {i} Ingredients {said(i)}" for n in (2, 7, 8, 60) for i in range(n)} | {200_000 + i: "the same text everywhere" for i in range(20)}
    assert got == want


def test_marks_of_several_words():
    of = lambda h: wrappers.article_text(wrappers.parse(h), wrappers.expression(wrappers.parse(h)))
    kept = {"section-header": "Results", "share-price": "12", "post_header": "h", "with-sidebar": "x", "has-ads": "y", "navy": "z", "header": "own", "promotional": "p"}
    gone = ["site-footer", "comment-list", "ad-slot", "cookie-banner", "share-buttons", "nav", "article-comments", "ad", "related-posts", "main-menu"]
    assert of("<article>" + "".join(f"<div class='a {c}'>{t}</div>" for c, t in kept.items()) + "".join(f"<div class='b {c}'>no</div>" for c in gone) + "</article>") == " ".join(kept.values())
    assert of("<header>site</header><article><header><h1>Head</h1><nav>menu</nav><p>by me</p></header><p>text</p><footer>f</footer></article>") == "Head by me text"
    assert of("<body><form action=x><div class=menu>m</div><h1>T</h1><p>All of the page is in a form.</p><input><button>Go</button></form></body>") == "T All of the page is in a form."
    assert of("<form><article><p>inside</p><form><label>name</label></form></article></form>") == "inside"


def test_wrapper_expression():
    a, b = (wrappers.expression(wrappers.parse(h)) for h in ("<ul><li>1<li>2</ul><p>x</p><hr>", "<ul><li>3</ul><b>y</b><p>z</p>"))
    assert wrappers.regular_expression(wrappers._joined(a, b)) == "<root><ul>(<li>#</li>)+</ul>(<b>'y'</b>)?<p>#</p>(<hr></hr>)?</root>"


def test_pages_of_the_tables(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op9_wrappers(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(x for x in blocks if x) and r.n_chars == len(r.text)


# 10 toxicity


def test_subsequence_kernel_is_explicit():
    words = ["idiot", "i.d.i.o.t", "thation", "ab"]

    def explicit(w):
        out = Counter()
        codes = [int(toxicity.CODES[ord(c)]) for c in w]
        for order in toxicity.ORDERS:
            for at in combinations(range(len(w)), order):
                if at[-1] - at[0] < toxicity.SPAN and all(codes[k] for k in at):
                    out[tuple(codes[k] for k in at), at] += toxicity.DECAY ** (at[-1] - at[0] + 1 - order)
        norm = sum(x * x for x in out.values()) ** 0.5 or 1
        merged = Counter()
        for (s, _), x in out.items():
            merged[s] += x / norm
        return merged

    e = [explicit(w) for w in words]
    want = [[sum(a[k] * b[k] for k in a) for b in e] for a in e]
    assert np.allclose(toxicity.kernel(words, words), want)


def _auc(score, label):
    both = sorted(zip(score, label, strict=True))
    values, ranks = [x for x, _ in both], {}
    for k, x in enumerate(values):
        ranks.setdefault(x, []).append(k + 1)
    ones = sum(label)
    return (sum(np.mean(ranks[x]) for x, y in both if y) - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_toxicity_held_out_in_every_language(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op10_toxicity(spark, d).cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    assert got.where("held_out <> (crc32(string(doc_id)) % 4 = 2)").count() == 0
    held = got.where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    got.unpersist()
    for lang in ("en", "de", "fr", "es"):
        own = [r for r in held if r.lang == lang]
        assert _auc([r.score for r in own], [r.toxic for r in own]) > 0.9, lang
    assert np.mean([r.predicted for r in held if r.toxic == 1]) > 0.8 and np.mean([r.predicted for r in held if r.toxic == 0]) < 0.02


def test_training_words_are_whole():
    long = "".join(chr(97 + i * 7 % 26) for i in range(100))
    assert toxicity.training_words(f"Été, {long} i d i o t x1") == {"ete", "idiot"} | {long[k : k + 32] for k in range(0, 84, 16)}
    assert toxicity.training_words("") == set()


def _labelled(spark, rows):
    return spark.createDataFrame([(t or "", y) for t, y in rows], "text string, toxic int")


def test_toxicity_tolerates_insertions_and_edges(spark, docs_of):
    r = random.Random(10)
    plain = ["thation", "ering", "onstle", "haveth", "inder", "morest", "therish"]
    text = lambda *more: " ".join([r.choice(plain) for _ in range(20)] + list(more))
    sample = [(text("blargfool", "blargfool"), 1) for _ in range(40)] + [(text(), 0) for _ in range(200)]
    model = toxicity.train(_labelled(spark, sample))
    rows = [(1, text("b.l.a.r.g.f.o.o.l", "blarg*fool")), (2, text()), (3, text("b l a r g f o o l", "blargfool"))] + [(10 + i, t) for i, (_, t) in enumerate(EDGES)]
    got = {x.doc_id: x.score for x in toxicity.score(docs_of(rows, extra=True), model).collect()}
    assert got[1] >= 0.3 and got[3] >= 0.3 and got[2] < 0.3 and all(0 <= s < 0.3 for i, s in got.items() if i >= 10)
    kept = toxicity.not_toxic(docs_of(rows, extra=True), model)
    assert kept.count() == len(rows) - 2 and kept.where("score <> 'x' or lang <> 'en'").count() == 0
    assert toxicity.train(_labelled(spark, [])) is None and toxicity.train(_labelled(spark, [("", 1), (None, 0)])) is None and toxicity.score(docs_of(rows), None).where("score = 0").count() == len(rows)
    assert toxicity.score(docs_of([]), model).count() == 0
    assert toxicity.joined_letters("xx i d i o t yy a b") == ["idiot"]


def test_highest_stretch_is_brute_force(monkeypatch):
    r = random.Random(11)
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.DIMS), -2.0, np.zeros(3))
    texts = ["".join(r.choice("abcdef.*1é語") for _ in range(n)) for n in (3, 4, 7, 20, 33, 90, 90)] + ["語" * 50, "ab"]
    want = [max(model.margins([t[a : a + k] for k in range(4, 33) for a in range(len(t) - k + 1)] or [t])) for t in texts]
    assert np.allclose(model.highest(texts), want, atol=1e-4)
    monkeypatch.setattr(toxicity, "STRETCH_STEP", 16)
    assert np.allclose(model.highest(texts), want, atol=1e-4)


def test_insults_anywhere_in_long_tokens_and_runs(spark, docs_of):
    r = random.Random(12)
    plain = ["thation", "ering", "onstle", "haveth", "inder", "morest", "therish"]
    text = lambda *more: " ".join([r.choice(plain) for _ in range(20)] + list(more))
    model = toxicity.train(_labelled(spark, [(text("blargfool", "blargfool"), 1) for _ in range(40)] + [(text(), 0) for _ in range(200)]))
    joined = "".join(r.choice(plain) for _ in range(40))[:100]
    rows, clean = [], {1: text(joined), 2: text(" ".join(joined))}
    for insult in ("blargfool", "b.l.a.r.g.f.o.o.l"):
        for k in range(101 - len(insult)):
            long = joined[:k] + insult + joined[k + len(insult) :]
            rows += [text(long, long + "x"), text(" ".join(long), "yy", " ".join(long))]
    score = {x.doc_id: x.score for x in toxicity.score(docs_of([*clean.items(), *enumerate(rows, 10)]), model).collect()}
    assert all((s >= 0.3) == (i >= 10) for i, s in score.items())


# the pipeline


def test_pipeline_on_small_tables(spark, docs_of, tmp_path):
    import corpus_pipeline as P

    base = " ".join(f"word{i}" for i in range(60))
    passage = " ".join(f"item{i}" for i in range(20))
    rows = [(1, base), (2, base + " more"), (3, f"x {passage} y"), (4, 'token = "0123456789abcdef0123456789abcdef"'), (5, None), (6, "")] + [(100 + i, f"clean text number {i} of its own kind {i * 7}") for i in range(20)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 4, 5, 6} | {100 + i for i in range(20)}
    assert out[4].decoded_sha256 == hashlib.sha256(b"[SECRET]\"").hexdigest() and out[5].n_pieces == 0
    for name, stage in P.STAGES:
        assert stage(spark, docs_of([]), str(tmp_path)).count() == 0, name


def test_decontamination_goes_by_id_and_text(spark, docs_of, tmp_path):
    import corpus_pipeline as P

    passage = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, passage)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, "no id but clean"), (1, "clean words of a shared id"), (2, "clean"), (3, None), (None, None), (4, "")]
    rows = [*clean, (None, f"x {passage} y"), (1, f"X {passage.upper()}"), (5, passage), (5, passage)]
    got = P.drop_contaminated(spark, docs_of(rows, extra=True), str(tmp_path))
    assert got.columns == docs_of(rows, extra=True).columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(clean)


def test_pipeline_of_clashing_columns_and_repeated_rows(spark, docs_of, tmp_path):
    import corpus_pipeline as P

    base, passage = " ".join(f"word{i}" for i in range(60)), " ".join(f"item{i}" for i in range(20))
    docs = docs_of([(1, base), (1, base), (2, base + " more"), (3, passage), (4, "clean"), (4, "clean"), (None, None)], extra=True)
    for c in ("gone_id", "gone_key", "own_key", "own_id", "c0", "c1", "component_id", "a", "b"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in P.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.where("gone_id <> 'x' or own_key <> 'x' or c0 <> 'x'").count() == 0, name
    assert sorted(r.doc_id or 0 for r in P.run(spark, str(tmp_path)).collect()) == [0, 1, 1, 4, 4]
