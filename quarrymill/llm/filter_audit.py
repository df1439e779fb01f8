"""Which of five quality filters removes what, in every order, from the counts of their joint failures."""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import materialize

LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SIGNS = "[#$%&*|]"
FILTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("all", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Failures of A to D: few words, few distinct ones, many capitals, signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * n, 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text), text.rlike(SIGNS)]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): a flag for each filter that a row fails.

    Null texts and parts count as empty. E holds for texts that a smaller id has too: a row's text has its smallest id found by an
    aggregate, and rows meet it by text and id, so a text with a third of all rows is spread over its ids. Rows that repeat both id and
    text fail E alike; rows without an id don't fail it, nor make others fail.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = [f.alias(name) for name, f in zip(FILTERS, text_failures(F.col("text")), strict=False)]
    keyed = materialize(own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *flags))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    return keyed.join(first, ["key", "doc_id"], "left").select("doc_id", "part", *FILTERS[:4], (F.col("doc_id").isNotNull() & F.col("is_first").isNull()).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with 0 or 1 in good and toxic. Without a label both are 0; of several labels of one id the largest counts; a row without an id has none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    return rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def joint_failures(rows: DataFrame) -> DataFrame:
    """(part, joint_all, joint_good, joint_toxic): at S of each list, how many rows (of them good, toxic) fail every filter of S, a set of filters as bits; S = 0 holds all rows."""
    sets = [[f for k, f in enumerate(FILTERS) if s >> k & 1] for s in range(1 << len(FILTERS))]
    weights = dict(zip(COUNTS, ("1", "good", "toxic"), strict=True))
    products = {name: ", ".join(f"sum({' * '.join([w, *s])})" for s in sets) for name, w in weights.items()}
    bits = rows.withColumns({f: F.col(f).cast("int") for f in FILTERS})
    return bits.groupBy("part").agg(*(F.expr(f"array({sums})").alias(f"joint_{name}") for name, sums in products.items()))


def survivors(joint: Column) -> Column:
    """At T, how many rows fail no filter of T: the sum over all S within T of (-1)**|S| times those that fail all of S."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    signs = F.array(*(F.lit((-1) ** s.bit_count()) for s in range(1 << len(FILTERS))))
    return F.transform(sets, lambda t: F.aggregate(sets, F.lit(0).cast("long"), lambda total, s: total + F.when(s.bitwiseAND(t) == s, F.get(signs, s) * F.get(joint, s)).otherwise(0)))


def shapley(joint: Column, k: int) -> Column:
    """What filter k removes, summed over all orders. The rows that some filter of T fails are a game whose dividend at S is (-1)**(|S| + 1) times those that all of S fail; a dividend is shared evenly within S, and there are as many orders as a multiple of every |S|."""
    orders = len(list(permutations(FILTERS)))
    dividends = [(s, (-1) ** (s.bit_count() + 1) * orders // s.bit_count()) for s in range(1, 1 << len(FILTERS)) if s >> k & 1]
    return reduce(lambda a, b: a + b, (F.get(joint, F.lit(s)) * share for s, share in dividends))


def steps() -> list[dict]:
    """All orders, their steps from 1, each step's filter and the set of filters before it."""
    return [{"filter_order": "".join(order), "step": k + 1, "filter": FILTERS.index(order[k]), "before": sum(1 << FILTERS.index(f) for f in order[:k])} for order in permutations(FILTERS) for k in range(len(FILTERS))]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (see the contract of op11).

    The corpus is aggregated once, to the joint failures of the 32 sets of filters in each part; all else is their inversion, on one row
    a part. An empty table has no parts and no rows.
    """
    counts = joint_failures(labelled(failures(docs), labels))
    for name in COUNTS:
        counts = counts.withColumn(f"left_{name}", survivors(F.col(f"joint_{name}")))
    counts = counts.withColumn("shares", F.array(*(shapley(F.col("joint_all"), k) for k in range(len(FILTERS)))))
    table = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order string, step int, filter int, before int>>")
    at = counts.select("*", F.explode(table).alias("at")).select("*", "at.*")
    every, alone = F.lit((1 << len(FILTERS)) - 1), F.get(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))), F.col("filter"))
    after = F.col("before").bitwiseOR(alone)
    removed = {n: F.get(f"left_{n}", F.col("before")) - F.get(f"left_{n}", after) for n in COUNTS}
    columns = {
        "kept": F.get("left_all", after), "removed": removed["all"], "redundant": F.get("joint_all", alone) - removed["all"],
        "unique_fails": F.get("left_all", every.bitwiseXOR(alone)) - F.get("left_all", every), "good_lost": removed["good"], "toxic_lost": removed["toxic"], "shapley": F.get("shares", F.col("filter")),
    }
    return at.select("part", "filter_order", "step", *(c.cast("long").alias(n) for n, c in columns.items()))
