"""Versions of documents' chunk sets: rows that are valid from one version to another, so that what stays is kept once, and any version can be read, listed, restored or deleted."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.sources.shared import stored

# The states in which a document can't be changed.
RUNNING = ("queued", "parsing", "chunking", "embedding", "upserting")
INTERVAL = ("valid_from", "valid_to")
NOTES = ("_same", "_full")  # 128 bits of a hash of all of a chunk's columns, compared within a document, and whether it has a full text: noted where rows begin, so that comparing and counting moves no texts
CURRENT = "current"


class Store(NamedTuple):
    """heads: doc_id, head (its version's number from 1), status. snapshots: doc_id, version of those that are archived. rows: doc_id, chunk_id and the chunk's columns (token_count, text_preview and full_text among them), valid_from and valid_to (the version that no longer has it; null in the current one); NOTES are added where they lack, and are to be dropped by who changes a row's chunk by hand."""

    heads: DataFrame
    snapshots: DataFrame
    rows: DataFrame


def started(chunks: DataFrame, status: str = "ready") -> Store:
    """Chunks (doc_id, chunk_id, ...) as the first version of their documents."""
    heads = chunks.select("doc_id").distinct().withColumns({"head": F.lit(1), "status": F.lit(status)})
    rows = _noted(chunks).withColumns({"valid_from": F.lit(1), "valid_to": F.lit(None).cast("int")})
    return Store(heads, heads.select("doc_id", F.col("head").alias("version")).limit(0), rows)


def _noted(rows: DataFrame, full_text: Column | None = None) -> DataFrame:
    """rows with NOTES, those of their chunks or, if it is given, of these with another full text."""
    columns = [c for c in rows.columns if c not in (*INTERVAL, *NOTES)]
    if full_text is None and set(NOTES) <= set(rows.columns):
        return rows
    text = F.col("full_text") if full_text is None else full_text
    said = F.to_json(F.struct(*(text.alias(c) if c == "full_text" else F.col(c) for c in columns)), {"ignoreNullFields": "false"})
    return rows.withColumns({"_same": F.unhex(F.substring(F.sha2(said, 256), 1, 32)), "_full": F.coalesce(text, F.lit("")) != ""})


def current(store: Store) -> DataFrame:
    """The chunks as they are."""
    return store.rows.where("valid_to IS NULL").drop(*INTERVAL, *NOTES)


def as_of(store: Store, versions: DataFrame) -> DataFrame:
    """The chunks as they were in versions (doc_id, version), with the version; a document may be asked for in several."""
    return _as_of(store.rows.drop(*NOTES), versions)


def _as_of(rows: DataFrame, versions: DataFrame) -> DataFrame:
    met = rows.join(versions.select("doc_id", "version").distinct(), "doc_id")
    return met.where("valid_from <= version AND (valid_to IS NULL OR version < valid_to)").drop(*INTERVAL)


def bump(store: Store, ids: DataFrame) -> Store:
    """Archives the documents (doc_id) that can be changed, once for each number and not without chunks, and moves them on to a version of their own."""
    chosen = ids.select("doc_id").distinct().withColumn("_chosen", F.lit(True))
    heads = store.heads.join(chosen, "doc_id", "left").withColumn("_chosen", F.col("_chosen").isNotNull() & ~F.col("status").isin(*RUNNING))
    filled = store.rows.where("valid_to IS NULL").select("doc_id").distinct()
    fresh = heads.where("_chosen").select("doc_id", F.col("head").alias("version")).join(filled, "doc_id", "left_semi").join(store.snapshots, ["doc_id", "version"], "left_anti")
    moved = heads.select("doc_id", F.when(F.col("_chosen"), F.col("head") + 1).otherwise(F.col("head")).alias("head"), "status")
    return Store(moved, store.snapshots.unionByName(fresh), store.rows)


def _replace(store: Store, docs: DataFrame, chunks: DataFrame) -> Store:
    """The current chunks of docs (doc_id, head) replaced by chunks: rows that are the same in all columns go on, others end with the head, and new ones begin there.

    What ends and what begins is found by hashes, which have all columns and so the ids in them; texts meet only the result, and not that where nobody reads them.
    """
    keys = ["doc_id", "_same"]
    rows, heads = _noted(store.rows), docs.select("doc_id", "head")
    new = _noted(chunks).select(*(c for c in rows.columns if c not in INTERVAL))
    live = rows.where("valid_to IS NULL")
    touched = live.select(*keys).join(heads, "doc_id")
    coming = new.select(*keys).distinct()
    ends = touched.join(coming, keys, "left_anti").withColumnRenamed("head", "_end").distinct()
    begins = coming.join(touched, keys, "left_anti").join(heads, "doc_id")
    # A row that began with this very head and ends with it was in no version.
    ended = live.join(ends, keys, "left").withColumn("valid_to", F.col("_end")).where("valid_to IS NULL OR valid_from < valid_to")
    added = new.join(begins, keys).withColumns({"valid_from": F.col("head"), "valid_to": F.lit(None).cast("int")})
    return store._replace(rows=rows.where("valid_to IS NOT NULL").unionByName(ended.select(*rows.columns)).unionByName(added.select(*rows.columns)))


def change(store: Store, chunks: DataFrame) -> Store:
    """Archives each document that chunks (all of a document's, with the store's columns) are of and that can be changed, and makes these its current ones."""
    docs = stored(chunks.select("doc_id").distinct().join(store.heads, "doc_id").where(~F.col("status").isin(*RUNNING)).select("doc_id", (F.col("head") + 1).alias("head")))
    after = _replace(bump(store, docs), docs, _noted(chunks))
    return after._replace(rows=stored(after.rows))


def restore(store: Store, requests: DataFrame) -> tuple[Store, DataFrame]:
    """Documents put back to versions (doc_id, version as text): (store, results).

    The current chunks are archived first, then those of the version become current, in a version of their own. results: doc_id, version,
    outcome (restored, current, invalid, unknown, running, missing or empty), restored_version, chunk_count, degraded (chunks without a
    full text, which take their preview) and stale (chunks whose vectors go, J11). Of several requests of a document the last by number holds.
    """
    number = F.when(F.col("version").rlike("^[0-9]{1,9}$"), F.col("version").cast("int"))
    last = requests.groupBy("doc_id").agg(F.max_by("version", F.struct(F.coalesce(number, F.lit(-1)), F.col("version"))).alias("version")).withColumn("number", number)
    known = last.join(store.heads, "doc_id", "left").join(store.snapshots.select("doc_id", F.col("version").alias("number"), F.lit(True).alias("_there")), ["doc_id", "number"], "left")
    rows = _noted(store.rows)
    asked = last.where("number IS NOT NULL").select("doc_id", F.col("number").alias("version"))
    sizes = _as_of(rows.select("doc_id", "_full", *INTERVAL), asked).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_full")).alias("degraded"))
    outcome = (
        F.when(F.col("head").isNull(), "unknown").when(F.col("version") == CURRENT, "current").when(F.col("status").isin(*RUNNING), "running").when(F.coalesce(F.col("number"), F.lit(0)) < 1, "invalid")
        .when(F.col("_there").isNull(), "missing").when(F.col("n").isNull(), "empty").otherwise("restored")
    )
    judged = stored(known.join(sizes, "doc_id", "left").withColumn("outcome", outcome).select("doc_id", "version", "number", "head", "n", "degraded", "outcome"))
    right = judged.where("outcome = 'restored'")
    text = F.when(F.coalesce(F.col("full_text"), F.lit("")) == "", F.col("text_preview")).otherwise(F.col("full_text"))
    whole = _as_of(_noted(store.rows, text), right.select("doc_id", F.col("number").alias("version"))).drop("version").withColumn("full_text", text)
    stale = current(store).join(right, "doc_id", "left_semi").select("doc_id", "chunk_id").join(whole, ["doc_id", "chunk_id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("stale"))
    docs = right.select("doc_id", (F.col("head") + 1).alias("head"))
    after = _replace(bump(store, docs), docs, whole)
    done = F.col("outcome") == "restored"
    results = judged.join(stale, "doc_id", "left").select(
        "doc_id", "version", "outcome", F.when(done, F.col("head") + 1).alias("restored_version"), F.when(done, F.col("n")).alias("chunk_count"), F.when(done, F.col("degraded")).alias("degraded"), F.when(done, F.coalesce("stale", F.lit(0))).alias("stale"),
    )
    return after, results


def delete(store: Store, versions: DataFrame) -> Store:
    """Without the archived versions (doc_id, version), and without rows that no version left has. The current one can't be deleted."""
    left = store.snapshots.join(versions.select("doc_id", "version"), ["doc_id", "version"], "left_anti")
    # The last version left before a row ends: it has the row if it isn't before the row begins.
    ends = store.rows.where("valid_to IS NOT NULL").select("doc_id", F.col("valid_to").alias("at")).distinct()
    marks = left.select("doc_id", F.col("version").alias("at"), F.lit(1).alias("is_version"), F.col("version").alias("seen"))
    order = Window.partitionBy("doc_id").orderBy("at", "is_version")
    seen = ends.withColumns({"is_version": F.lit(0), "seen": F.lit(None).cast("int")}).unionByName(marks).withColumn("seen", F.max("seen").over(order)).where("is_version = 0")
    rows = store.rows.join(seen.select("doc_id", F.col("at").alias("valid_to"), "seen"), ["doc_id", "valid_to"], "left").where("valid_to IS NULL OR seen >= valid_from")
    return store._replace(snapshots=left, rows=rows.select(*store.rows.columns))


def listing(store: Store) -> DataFrame:
    """(doc_id, position, version, chunks, tokens, has_full_text) of each document's versions, the current one first, then the archived ones from the newest.

    Rows count from the version they begin with until the one they end with, as running sums over a document's versions, so no row meets
    all versions that have it.
    """
    sums = {"chunks": F.lit(1), "tokens": F.coalesce(F.col("token_count"), F.lit(0)), "full": F.col("_full").cast("int")}
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(sign).alias("sign")) for c, sign in zip(INTERVAL, (1, -1), strict=True))))
    steps = _noted(store.rows).select("doc_id", *(x.alias(c) for c, x in sums.items()), ends.alias("end")).where("end.at IS NOT NULL")
    steps = steps.groupBy("doc_id", F.col("end.at").alias("at")).agg(*(F.sum(F.col("end.sign") * F.col(c)).alias(c) for c in sums)).withColumn("version", F.lit(None).cast("string"))
    asked = store.snapshots.select("doc_id", F.col("version").alias("at"), F.col("version").cast("string").alias("version")).unionByName(store.heads.select("doc_id", F.col("head").alias("at"), F.lit(CURRENT).alias("version")))
    order = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = steps.unionByName(asked.withColumns({c: F.lit(0).cast("long") for c in sums}))
    out = totals.select("doc_id", "at", "version", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(c) for c in sums)).where("version IS NOT NULL")
    place = Window.partitionBy("doc_id").orderBy(F.when(F.col("version") == CURRENT, 0).otherwise(1), F.col("at").desc())
    return out.select("doc_id", F.row_number().over(place).alias("position"), "version", "chunks", "tokens", (F.col("full") > 0).alias("has_full_text"))


def changes(store: Store, left: Column, right: Column) -> DataFrame:
    """(doc_id, chunk_id) of chunks that only one of two versions of a document has, or that differ in any column; each version is an expression over heads (doc_id, head)."""
    asked = store.heads.select("doc_id", left.cast("int").alias("l"), right.cast("int").alias("r"))
    within = lambda v: F.coalesce((F.col("valid_from") <= F.col(v)) & (F.col("valid_to").isNull() | (F.col(v) < F.col("valid_to"))), F.lit(False))
    met = _noted(store.rows).join(asked, "doc_id").where(within("l") != within("r"))
    return met.groupBy("doc_id", "chunk_id", "_same").agg(F.count_if(within("l")).alias("in_l"), F.count_if(within("r")).alias("in_r")).where("in_l <> in_r").select("doc_id", "chunk_id").distinct()
