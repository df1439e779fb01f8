"""Operators 11 to 13 against brute force, exact round trips and the edge cases that their docstrings state. Their SQL is compared in test_llm."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import fill_middle, filter_audit, queries, substrings

LABELS = "doc_id long, quality int, toxic int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
        return df.withColumns({c: F.lit("x") for c in extra})

    return make


# 11 filter audit


def _audit_by_hand(rows, labels):
    known = {}
    for i, q, t in (x for x in labels if x[0] is not None):
        g = known.get(i, (False, False))
        known[i] = (g[0] or q == 1, g[1] or t == 1)
    texts = [(i, t or "", s or "") for i, t, s in rows]
    failing = []
    for i, t, s in texts:
        w = SPACED.findall(t)
        f = set()
        f |= {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and u == t for j, u, _ in texts) else set()
        failing.append((s, f, *known.get(i, (False, False))))
    out = {}
    for part in {s for s, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        total = {f: 0 for f in "ABCDE"}
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                redundant = sum(f in x[0] for x in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def _random_rows(r, n):
    rows = []
    for i in range(n):
        words = [r.choice(["a", "b", "CD", "é😀", "x#", "word", f"w{r.randint(0, 200)}"]) for _ in range(r.choice([0, 1, 30, 49, 50, 51, 90]))]
        rows.append((i, r.choice(["\x0b", " ", "\n\t "]).join(words), r.choice(["s", "s", "t", None])))
    rows += [(r.randint(0, 2 * n), r.choice(rows)[1], "s") for _ in range(n // 2)]
    return rows + [(None, rows[0][1], "s"), (None, None, None), (3, None, "t"), (4, "", ""), (5, "CAPITAL " * 3_000, "s"), rows[2], rows[2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_filter_audit_by_hand(spark, docs_of, seed):
    r = random.Random(seed)
    rows = _random_rows(r, 60)
    labels = [(r.randint(0, 70), r.randint(0, 1), r.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    got = filter_audit.audit(docs_of(rows, ("part", "key", "good", "toxic", "n")), spark.createDataFrame(labels, LABELS)).collect()
    want = _audit_by_hand(rows, labels)
    assert len(got) == len(want) == 600 * 3
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == want


def test_filter_audit_of_nothing(spark, docs_of):
    empty = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs_of([(1, "x", "s")]).limit(0), empty).count() == 0
    rows = filter_audit.audit(docs_of([(1, None, None)]), empty).collect()
    assert len(rows) == 600 and {x.part for x in rows} == {""} and sum(x.removed for x in rows if x.filter_order == "ABCDE") == 1


def test_shares_add_up_to_all_removed(spark):
    rows = queries.QUERIES["op11_filters"](spark, "/root/testdata/sf0.001").where("filter_order = 'ABCDE'").groupBy("part").agg(F.sum("shapley").alias("s"), F.sum("removed").alias("r")).collect()
    assert rows and all(x.s == 120 * x.r for x in rows)


# 12 substrings


def _earlier_by_hand(rows, length):
    words = [SPACED.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1) if i is not None else ():
            first[tuple(w[k : k + length])] = min(i, first.get(tuple(w[k : k + length]), i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for k in range(len(w) - length + 1) if i is not None and first[tuple(w[k : k + length])] < i for p in range(k, k + length)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


def _removed(spark, rows, length, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in extra})
    return sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_removed, x.kept) for x in substrings.remove_earlier(df, length).collect())


@pytest.mark.parametrize(("length", "hot"), [(2, 200), (4, 200), (4, 2), (13, 200), (13, 1)])
def test_earlier_sequences_by_hand(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    r = random.Random(length + hot)
    base = [" ".join(r.choice("ab") + str(r.randint(0, 2)) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(90):
        parts = [r.choice(base)[r.randint(0, 60) :][: r.randint(0, 180)] if r.random() < 0.6 else " ".join(f"u{r.randint(0, 9_999)}" for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 4))]
        rows.append((r.choice([i, i, 500 - i]), r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(7, base[0]), (7, base[0]), (7, base[0] + " tail"), (None, base[0]), (None, base[1]), (900, None), (901, ""), (902, " \n\t"), (903, "é😀 " * 5_000), (904, "é😀 " * 5_000)]
    assert _removed(spark, rows, length, ("anchor", "seg", "n", "kept", "first", "row_key", "spans")) == _earlier_by_hand(rows, length)


def test_earlier_sequences_of_nothing(spark):
    assert _removed(spark, [], 13) == []
    assert _removed(spark, [(1, None), (2, "a few words")], 13) == [(1, 0, 0, ""), (2, 3, 0, "a few words")]


def test_automaton_has_all_substrings():
    r = random.Random(4)
    for _ in range(30):
        added = [[r.randint(0, 2) for _ in range(r.randint(0, 12))] for _ in range(r.randint(0, 5))]
        automaton = substrings.SuffixAutomaton()
        for x in added:
            automaton.add(x)
        inside = {tuple(x[a:b]) for x in added for a in range(len(x)) for b in range(a, len(x) + 1)} | {()}
        asked = [r.randint(0, 3) for _ in range(40)]
        want = [max(k for k in range(i + 2) if tuple(asked[i + 1 - k : i + 1]) in inside) for i in range(len(asked))]
        assert automaton.statistics(asked) == want and len(automaton.next) <= max(1, 2 * sum(map(len, added)) + 1)


# 13 fill in middle

UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "char": re.compile(r"(?s)."), "word": re.compile(r"\A[ \t-\r]+(?:[^ \t-\r]+[ \t-\r]*)?|[^ \t-\r]+[ \t-\r]*")}


def _filled_by_hand(doc_id, text, unit, seed=7, fim=100, spm=50):
    text = text or ""
    u = UNITS[unit].findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("unit", "fim", "spm"), [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_fill_middle_by_hand_and_back(docs_of, unit, fim, spm):
    r = random.Random(unit)
    texts = ["".join(r.choice(["a", "é", "😀", "\n", "\n\n", " ", "\r\n", "<", "P>", "<M", ">", " ", "\x85"]) for _ in range(r.randint(0, 40))) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    if unit == "word":
        rows = [(i, t.lstrip(), s) for i, t, s in rows]
    rows += [(1_000, None, "s"), (1_001, "", "s"), (None, "x\ny\n", "s"), (1_002, "no end\nof line", "s"), (1_003, "\n" * 5_000, "s"), (1_003, "\n" * 5_000, "s"), (1_004, "é😀 x\n" * 20_000, "s"), (1_005, "a<S>b", "s")]
    made = fill_middle.transform(docs_of(rows, ("n", "form", "output")), fill_middle.Recipe(unit, 7, fim, spm))
    got = made.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = {}
    for i, t, _ in rows:
        want[i, t or ""] = _filled_by_hand(i, t, unit, 7, fim, spm)
    assert len(got) == len(rows)
    for x in got:
        assert (x.n, x.form, x.prefix_chars, x.middle_chars, x.output) == want[x.doc_id, x.back]


def test_ranked_bits():
    r = random.Random(9)
    for _ in range(200):
        width = r.randint(1, 300)
        bits = r.getrandbits(width)
        places = [k for k in range(width) if bits >> k & 1]
        assert [fill_middle.ranked_bit(bits, k, width) for k in range(len(places))] == places


def test_fill_middle_of_nothing(docs_of):
    assert fill_middle.transform(docs_of([(1, "x", "s")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.unit_starts(b"x", "page")
