"""Table operators: latest versions, retention, patches, upserts, claims, counts and trends, each a plan over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


KEPT_RUNS = 20


def run_history(runs: DataFrame, keep: int = KEPT_RUNS) -> DataFrame:
    """Runs (kb, run_id, ts, status, hit_rate, ...) that are kept, with their position in their knowledge base from the newest: all that go on and, of the ended ones, the newest; only those that are done have a hit rate."""
    ended = F.col("status") != "running"
    newest = [F.col("ts").desc(), F.col("run_id").desc()]
    kept = runs.where(~ended).unionByName(keep_newest(runs.where(ended), ["kb"], newest, keep))
    return kept.withColumns({"position": F.row_number().over(Window.partitionBy("kb").orderBy(*newest)).cast("int"), "hit_rate": F.when(F.col("status") == "done", F.col("hit_rate"))})


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """K2: whole rows replaced by key, new ones added; both have the same columns, and rows has a key once."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def patch(table: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """K4: columns of the rows named in patches take its values where these aren't null."""
    p = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return table.join(p, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """K3: a row stays where the condition is false or null."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """K6: children without a deleted parent."""
    return children.join(gone.select(F.col(key).alias(foreign)), foreign, "left_anti")


def compare_and_set(table: DataFrame, column: str, expected: str, new: str, where: Column) -> DataFrame:
    """K7: the new value where the condition holds and the old one is as expected."""
    return table.withColumn(column, F.when((F.col(column) == expected) & where, new).otherwise(F.col(column)))


def filled_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A2, A5: counts of each value of a stated domain, 0 where it doesn't occur."""
    values = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rolling_trend(df: DataFrame, ts: str, now: Column, width_s: int, buckets: int, counts: dict[str, Column]) -> DataFrame:
    """Bucket i holds (now - (i + 1) width, now - i width]; buckets without rows have zeros."""
    spine = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    age = F.unix_micros(now) - F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("bucket", F.floor(age / (width_s * 1_000_000)).cast("int")).where((age >= 0) & (F.col("bucket") < buckets))
    seen = rows.groupBy("bucket").agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    return spine.join(seen, "bucket", "left").select("bucket", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counts))


def overlaps(chunks: DataFrame, blocks: DataFrame, doc: str, bin_width: int = 4096) -> DataFrame:
    """Pairs of chunks (doc, c_start, c_end) and blocks (doc, b_start, b_end) of a document with b_start < c_end and b_end > c_start.

    Both sides are dealt to bins of offsets, so the join has equal keys and one long document doesn't meet itself whole; a pair counts
    in the first bin that both touch.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bin_width)))
    c = chunks.withColumn("_bin", bins("c_start", "c_end"))
    b = blocks.withColumn("_bin", bins("b_start", "b_end"))
    first = F.floor(F.greatest("c_start", "b_start") / bin_width)
    return c.join(b, [doc, "_bin"]).where((F.col("b_start") < F.col("c_end")) & (F.col("b_end") > F.col("c_start")) & (F.col("_bin") == first)).drop("_bin")


def narrowest_cover(pairs: DataFrame, block: list[str]) -> DataFrame:
    """Of the chunks that hold a block's start, the narrowest; ties to the earlier start."""
    inside = pairs.where((F.col("c_start") <= F.col("b_start")) & (F.col("b_start") < F.col("c_end")))
    return latest_per(inside, block, [(F.col("c_end") - F.col("c_start")).asc(), F.col("c_start").asc()])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page with their position over all; size is held to 1 to 200."""
    size = max(1, min(200, size))
    start = (max(1, number) - 1) * size
    rows = df.orderBy(*order).offset(start).limit(size)
    # One page, so its numbering is of at most 200 rows.
    return rows.withColumn("position", (F.row_number().over(Window.orderBy(*order)) + start).cast("long"))


def scroll(points: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """The next points by key after the last one seen (all from the first where there is none), up to 1 000: a condition on the key and a limit, so no page costs more than another."""
    rest = points if after is None else points.where(F.col(key) > after)
    return rest.orderBy(key).limit(max(1, min(1_000, size)))


def scroll_by(points: DataFrame, order: str, key: str, after: tuple | None, size: int, vector: str | None = None, with_vector: bool = False) -> DataFrame:
    """The next points by another column and then the key, after the (order, key) last seen; points without a value of order come last and are paged by key, after (None, key). Vectors come if asked for."""
    o, k = F.col(order), F.col(key)
    rest = points
    if after is not None:
        seen, last = after
        rest = points.where(o.isNull() & (k > last)) if seen is None else points.where((o > seen) | ((o == seen) & (k > last)) | o.isNull())
    out = rest.orderBy(o.asc_nulls_last(), k).limit(max(1, min(1_000, size)))
    return out.drop(vector) if vector and not with_vector else out


def points(table: DataFrame, ids: DataFrame, key: str, vector: str | None = None, with_vector: bool = False) -> DataFrame:
    """The points of ids, each once; ids of no point don't come. Vectors come if asked for, else they aren't read."""
    rows = table.drop(vector) if vector and not with_vector else table
    return rows.join(ids.select(key), key, "left_semi")


def key_diff(rows: DataFrame, before: str, after: str) -> DataFrame:
    """A row for each key of either of two JSON objects whose values differ: the other columns, key, before and after (null where it has none)."""
    of = lambda c: F.coalesce(F.from_json(F.col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = [c for c in rows.columns if c not in (before, after)]
    maps = rows.select(*others, of(before).alias("_before"), of(after).alias("_after"))
    keys = maps.withColumn("key", F.explode(F.array_union(F.map_keys("_before"), F.map_keys("_after"))))
    both = keys.select(*others, "key", F.try_element_at("_before", "key").alias("before"), F.try_element_at("_after", "key").alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def reached(chunks: DataFrame, doc: str) -> DataFrame:
    """Chunks (doc, c_start, c_end) with the furthest end of those up to each in their document's order; none that begins before it can be found further back."""
    order = Window.partitionBy(doc).orderBy("c_start", "c_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("reached", F.max("c_end").over(order))


def splice(offsets: DataFrame, start: Column, end: Column, added: Column) -> DataFrame:
    """Offsets (a, b) after [start, end) of their document becomes `added` characters, in one pass: later ones shift, those that span it stretch, those within it fall to its start and end."""
    delta = added - (end - start)
    a = F.when(F.col("a") >= end, F.col("a") + delta).when(F.col("a") > start, start).otherwise(F.col("a"))
    b = F.when(F.col("b") >= end, F.col("b") + delta).when(F.col("b") > start, start + added).otherwise(F.col("b"))
    return offsets.withColumns({"a": a.cast("long"), "b": b.cast("long")})
