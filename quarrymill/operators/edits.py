"""Editing, deleting and reverting chunks: many edits of a document in one pass over its text, its chunks and its layout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrymill.functions.text import count_tokens
from quarrymill.sources.shared import stored

PREVIEW_CHARS, MOST_CHARS = 500, 200_000
MOST_SWALLOWED = 2
# Fixed value: what white space is when a preview is made.
BLANKS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def preview(text: Column) -> Column:
    """F19 of an edited text: white space runs become single spaces, none at the ends, and the first characters are kept."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), "^ | $", ""), 1, PREVIEW_CHARS)


def place(md: str, edits: list[dict]) -> tuple[str, list[dict]]:
    """The text after edits (chunk_id, start, end, text, replacement), and where each of those that took place stands: chunk_id, start, end (what is removed), added and before (by how much the edits before it move it).

    An edit stands at its offsets if the text there is the chunk's own, else where the chunk's text is first found; where it is found
    nowhere, or overlaps an edit that stands before it, the document stays as it is there. A deletion takes up to two line ends after it
    along and, at the end of the document, up to two in all with those before it.
    """
    standing = []
    for e in edits:
        start, end, own = e["start"], e["end"], e["text"] or ""
        if start is None or end is None or not (0 <= start < end <= len(md) and md[start:end] == own):
            start = md.find(own) if own else -1
            end = start + len(own)
        if start < 0:
            continue
        swallowed = 0
        while e["replacement"] is None and swallowed < MOST_SWALLOWED and md[end : end + 1] == "\n":
            end, swallowed = end + 1, swallowed + 1
        standing.append((start, end, e["chunk_id"], e["replacement"], swallowed))
    standing.sort(key=lambda s: (s[0], s[1], str(s[2])))
    out, placed, at, moved, left = [], [], 0, 0, 0
    for start, end, chunk, replacement, swallowed in standing:
        if start < at:
            continue
        new = replacement or ""
        out += [md[at:start], new]
        placed.append({"chunk_id": chunk, "start": start, "end": end, "added": len(new), "before": moved})
        at, moved = end, moved + len(new) - (end - start)
        left = MOST_SWALLOWED - swallowed if replacement is None and end == len(md) else 0
    text = "".join([*out, md[at:]])
    while left and text.endswith("\n"):
        text, left = text[:-1], left - 1
    return text, placed


def patched(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, md, placed, changed) of docs (doc_id, md) after edits (doc_id, chunk_id, start, end, text, replacement); see place. A document's edits meet it as one row's list, so its text is moved and read once, however many there are."""
    kinds = {c: edits.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id")}
    lists = edits.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_id", "start", "end", "text", "replacement")).alias("edits"))
    schema = f"doc_id {kinds['doc_id']}, md string, placed array<struct<chunk_id:{kinds['chunk_id']},start:int,end:int,added:int,before:int>>, changed boolean"

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, placed, changed = [], [], []
            for md, own in zip(batch.column("md").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                after, done = (md, []) if md is None or not own else place(md, own)
                texts.append(after)
                placed.append(done)
                changed.append(after != md)
            id_ = batch.schema.field("edits").type.value_type.field("chunk_id").type
            kind = pa.list_(pa.struct([("chunk_id", id_), *((c, pa.int32()) for c in ("start", "end", "added", "before"))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(placed, kind), pa.array(changed, pa.bool_())], ["doc_id", "md", "placed", "changed"])

    return docs.select("doc_id", "md").join(lists, "doc_id", "left").mapInArrow(edit, schema)


def shifted(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """Spans (doc_id, key, a, b) with new_a and new_b after the placed edits (doc_id, start, end, added, before).

    Offsets and edits are merged in a document's order, and each offset takes what the last edit that begins before it says: one behind
    it moves by all edits so far, one within it falls to its start (a) or the end of what was added (b). So nothing is shifted twice.
    """
    moves = placed.select("doc_id", F.col("start").alias("pos"), F.lit(1).alias("is_edit"), F.struct("start", "end", "added", "before").alias("edit"), F.lit(None).cast(spans.schema["key"].dataType).alias("key"), F.lit(None).cast("boolean").alias("is_end"))
    of = lambda c, is_end: spans.select("doc_id", F.col(c).alias("pos"), F.lit(0).alias("is_edit"), F.lit(None).cast(moves.schema["edit"].dataType).alias("edit"), "key", F.lit(is_end).alias("is_end"))
    order = Window.partitionBy("doc_id").orderBy("pos", "is_edit")
    last = F.last("edit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = moves.unionByName(of("a", False)).unionByName(of("b", True)).withColumn("last", last).where("is_edit = 0")
    e = F.col("last")
    removed = e["end"] - e["start"]
    new = F.when(e.isNull(), F.col("pos")).when(F.col("pos") >= e["end"], F.col("pos") + e["before"] + e["added"] - removed).otherwise(e["start"] + e["before"] + F.when(F.col("is_end"), e["added"]).otherwise(0))
    of_end = lambda c, name: (F.max(F.when(F.col("is_end") == is_end, F.col(c))).alias(f"{name}{x}") for x, is_end in (("a", False), ("b", True)))
    return merged.withColumn("new", new).groupBy("doc_id", "key").agg(*of_end("pos", ""), *of_end("new", "new_"))


def apply_edits(docs: DataFrame, chunks: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, chunks, log) after edits (chunk_id, replacement): a replacement of null deletes the chunk, a blank one or one of over MOST_CHARS is refused.

    docs: doc_id, md. chunks: doc_id, chunk_id, is_parent, char_start, char_end, text, token_count, text_preview. Edited chunks take their
    new text; the others' offsets move with the document, and parents are cut from it anew (one that nothing is left of keeps its text).
    log: a row for each edit of a known child: doc_id, chunk_id, action (edit, delete or refused), patched (whether the document changed
    there; see place), old_tokens, new_tokens. Of several edits of one chunk the last by text holds; edits of unknown chunks and of parents
    are passed over.
    """
    asked = edits.groupBy("chunk_id").agg(F.max(F.struct(F.col("replacement").isNotNull().alias("said"), F.col("replacement").alias("replacement")))["replacement"].alias("replacement"))
    known = chunks.where("NOT is_parent").select("doc_id", "chunk_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "text", "token_count").join(asked, "chunk_id")
    unfit = F.coalesce((F.regexp_replace("replacement", BLANKS, "") == "") | (F.length("replacement") > MOST_CHARS), F.lit(False))
    known = known.withColumn("action", F.when(unfit, "refused").when(F.col("replacement").isNull(), "delete").otherwise("edit"))
    after = stored(patched(docs, known.where("action <> 'refused'")))
    placed = after.select("doc_id", F.inline("placed"))
    done = known.join(placed.select("doc_id", "chunk_id", F.lit(True).alias("patched"), (F.col("start") + F.col("before")).alias("at")), ["doc_id", "chunk_id"], "left")
    new_tokens = F.when(F.col("action") == "edit", count_tokens(F.col("replacement"))).when(F.col("action") == "refused", F.col("token_count")).otherwise(0)
    log = done.select("doc_id", "chunk_id", "action", F.coalesce("patched", F.lit(False)).alias("patched"), F.col("token_count").cast("long").alias("old_tokens"), new_tokens.cast("long").alias("new_tokens"))

    moved = shifted(chunks.select("doc_id", F.col("chunk_id").alias("key"), F.col("char_start").alias("a"), F.col("char_end").alias("b")), placed).select("doc_id", F.col("key").alias("chunk_id"), "new_a", "new_b")
    changes = done.where("action <> 'refused'").select("doc_id", "chunk_id", "action", "replacement", "at")
    size = after.select("doc_id", F.length("md").alias("n"))
    # Where chunks go is a table without their texts, so those meet it once, and only parents meet the texts of documents.
    moves = stored(moved.join(changes, ["doc_id", "chunk_id"], "left").join(size, "doc_id", "left"))
    rows = chunks.join(moves, ["doc_id", "chunk_id"], "left").where("action IS NULL OR action <> 'delete'")
    is_parent = F.coalesce("is_parent", F.lit(False))
    new_md = after.where("changed").select("doc_id", F.col("md").alias("new_md"))
    rows = rows.where(~is_parent).withColumn("new_md", F.lit(None).cast("string")).unionByName(rows.where(is_parent).join(new_md, "doc_id", "left"))
    held = lambda x: F.greatest(F.least(x, F.coalesce("n", x)), F.lit(0))
    edited = F.col("action").isNotNull()
    # An edit that the document has no place for moves with it, and changes the chunk alone.
    start = F.when(edited & F.col("at").isNotNull(), F.col("at")).otherwise(held(F.col("new_a")))
    end = F.when(edited, start + F.length("replacement")).otherwise(F.greatest(held(F.col("new_b")), start))
    cut = F.substring("new_md", start + 1, end - start)
    text = F.when(edited, F.col("replacement")).when(F.col("is_parent") & (cut != ""), cut).otherwise(F.col("text"))
    changed = edited | (F.col("is_parent") & F.col("new_md").isNotNull())
    out = rows.select(
        *(c for c in chunks.columns if c not in ("char_start", "char_end", "text", "token_count", "text_preview")), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), text.alias("text"),
        F.when(changed, count_tokens(text)).otherwise(F.col("token_count")).cast("long").alias("token_count"), F.when(changed, preview(text)).otherwise(F.col("text_preview")).alias("text_preview"),
    )
    return after.select("doc_id", "md"), out, log


def backups(known: DataFrame, chunks: DataFrame, edits: DataFrame) -> DataFrame:
    """C17: known backups (chunk_id, text) and those of chunks that are edited for the first time."""
    first = edits.where("replacement IS NOT NULL").select("chunk_id").distinct().join(known, "chunk_id", "left_anti")
    return known.unionByName(chunks.where("NOT is_parent").select("chunk_id", "text").join(first, "chunk_id", "left_semi"))


def reverting(known: DataFrame, ids: DataFrame) -> DataFrame:
    """C17: the edits that put the backups of ids (chunk_id) back; ids that were never edited have none and don't come."""
    return known.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("replacement"))
