"""Rows and settings as the interfaces show them: JSON with defaults, clamps, codecs, types and classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME types by extension, the keys in which a payload's text may stand and address blocks that aren't public.
MIME = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "rtf": "application/rtf",
    "odt": "application/vnd.oasis.opendocument.text", "ods": "application/vnd.oasis.opendocument.spreadsheet", "odp": "application/vnd.oasis.opendocument.presentation",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "epub": "application/epub+zip", "ofd": "application/ofd", "html": "text/html", "htm": "text/html", "shtml": "text/html",
    "mhtml": "message/rfc822", "mht": "message/rfc822", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jp2": "image/jp2", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp",
}
LOOSE_MIME = {"html": "html", "pdf": "pdf", "wordprocessingml": "docx", "presentationml": "pptx", "spreadsheetml": "xlsx", "msword": "doc", "ms-powerpoint": "ppt", "ms-excel": "xls", "opendocument.text": "odt", "opendocument.spreadsheet": "ods", "opendocument.presentation": "odp", "epub": "epub", "rtf": "rtf"}
TEXT_KEYS = ("content", "text", "page_content", "chunk", "segment", "document", "doc_text", "text_preview", "parent_text")
PRIVATE_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.2.0", 24), ("198.18.0.0", 15), ("224.0.0.0", 4), ("240.0.0.0", 4))
# Error codes of the parsing service by what they say; others of 400, 403 and 404 are of the interface, all the rest may be tried again.
ERROR_CLASSES = {
    "MINERU_AUTH": ("A0202", "A0211", "401"), "MINERU_AGENT_LIMIT": ("-30001", "-30002", "-30003"), "MINERU_BAD_FILE": ("-60002",), "MINERU_QUOTA": ("-60004", "-60005", "-60006", "-60017", "-60018", "-60019"), "MINERU_API": ("400", "403", "404"),
}
SPARSE_KEYS = ("sparse_embedding", "sparse_indices", "lexical_weights", "sparse")
STRATEGIES = ("token", "title", "hybrid")
MOST_WAIT_MS = 30_000


def mime_of(ext: Column) -> Column:
    """in any case; octets where it isn't known."""
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("application/octet-stream"))


def ext_of(mime: Column) -> Column:
    """F13 back: the last extension of a type, its parameters aside; else by a part of its name; empty where it isn't known."""
    base = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    known = F.create_map(*(F.lit(x) for pair in {v: k for k, v in MIME.items()}.items() for x in pair))
    loose = F.lit("")
    for part, ext in reversed(LOOSE_MIME.items()):
        loose = F.when(F.contains(base, F.lit(part)), ext).otherwise(loose)
        if part == "wordprocessingml":  # images are looked at before the office types
            loose = F.when(F.startswith(base, F.lit("image/")), F.substr(base, F.lit(7))).otherwise(loose)
    return F.coalesce(F.try_element_at(known, base), loose)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it stands there; an expression doesn't grow by being used twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is a STRING, a NUMBER, an ARRAY or an OBJECT; false for null."""
    found = F.schema_of_variant(value)
    return F.coalesce(found.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$") if kind == "NUMBER" else found.startswith(kind), F.lit(False))


def _number(value: Column) -> Column:
    """A variant's number; null for all else and what isn't finite."""
    x = F.when(_is(value, "NUMBER"), F.try_variant_get(value, "$", "double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _text(value: Column) -> Column:
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def chunk_config(json: Column) -> Column:
    """A stored configuration with defaults for what is missing or of the wrong type (numbers as texts are of the wrong one); one that isn't JSON, or has a key twice, has them all."""
    root = F.try_parse_json(json)
    field = lambda name: F.try_variant_get(root, f"$.{name}", "variant")
    number = lambda name, default: F.coalesce(_number(field(name)), F.lit(default)).cast("int")
    size, strategy = number("size", 512), _text(field("strategy"))
    protects = F.filter(F.transform(F.when(_is(field("protects"), "ARRAY"), F.try_variant_get(field("protects"), "$", "array<variant>")), _text), F.isnotnull)
    return F.struct(
        F.greatest(size, F.lit(16)).alias("size"), F.greatest(F.lit(0), F.least(number("overlap", 0), F.floor(size / 4))).cast("int").alias("overlap"), F.greatest(size, number("parentSize", 2000)).alias("parent_size"),
        F.when(strategy.isin(*STRATEGIES), strategy).otherwise("hybrid").alias("strategy"), F.coalesce(protects, F.array(F.lit("code"), F.lit("table"))).alias("protects"),
    )


def _last_of(entries: Column) -> Column:
    """Entries (key, value) with each key once, where it first stands, and its last value: what an object with repeated keys means."""
    return _let(entries, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda e: e["key"])), lambda k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)))


def payload_text(payload: Column) -> Column:
    """the first of the known keys whose value is a string and not blank, as it is; else the text within the JSON of _node_content; else lines of `key: value` of the strings whose keys don't begin with _, up to 4 000 characters. Of a repeated key the last value counts. What isn't an object gives an empty text."""
    said = lambda text: _let(text, lambda t: F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) != "", t))

    def of(strings: Column) -> Column:
        value = lambda k: F.get(F.filter(strings, lambda e: e["key"] == k), F.lit(0))["value"]
        within = said(_text(F.try_variant_get(F.try_parse_json(value("_node_content")), "$.text", "variant")))
        shown = F.filter(strings, lambda e: (F.length(e["value"]) > 0) & ~F.startswith(e["key"], F.lit("_")))
        lines = F.array_join(F.transform(shown, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
        return F.coalesce(*(said(value(k)) for k in TEXT_KEYS), within, F.substring(lines, 1, 4_000))

    entries = _last_of(F.map_entries(F.from_json(payload, "map<string,variant>")))
    strings = F.transform(F.filter(entries, lambda e: _is(e["value"], "STRING")), lambda e: F.struct(e["key"].alias("key"), _text(e["value"]).alias("value")))
    return F.coalesce(_let(strings, of), F.lit(""))


def task_handle(handle: Column) -> Column:
    """A bare id, or JSON of parts; null where the JSON is broken."""
    json = F.from_json(handle, "kind string, pages int, parts array<struct<id:string,from:int,to:int>>")
    single = F.struct(F.lit(None).cast("int").alias("pages"), F.array(handle).alias("ids"))
    parts = F.when((json["kind"] == "parts") & json["parts"].isNotNull(), F.struct(json["pages"].alias("pages"), json["parts"]["id"].alias("ids")))
    return F.when(F.startswith(handle, F.lit("{")), parts).otherwise(single)


def _sparse(json: Column) -> Column:
    """One field's sparse vector as entries (key, value); null where it has none of the shapes."""
    entry = lambda k, w: F.struct(k.cast("int").alias("key"), w.alias("value"))
    at = lambda v, path: _number(F.try_variant_get(v, path, "variant"))
    whole = lambda made: _let(made, lambda es: F.when((F.size(es) > 0) & ~F.exists(es, lambda e: e["key"].isNull() | e["value"].isNull()), es))

    def of(root: Column) -> Column:
        array = lambda path, one: F.transform(F.try_variant_get(root, path, "array<variant>"), one)
        listed = array("$", lambda x: F.when(_is(x, "ARRAY"), entry(at(x, "$[0]"), at(x, "$[1]"))).otherwise(entry(at(x, "$.index"), at(x, "$.value"))))
        weights = F.coalesce(*(array(f"$.{c}", _number) for c in ("values", "data", "weights")))
        paired = _let(F.struct(array("$.indices", _number).alias("i"), weights.alias("w")), lambda p: F.when(F.size(p["i"]) == F.size(p["w"]), F.zip_with(p["i"], p["w"], entry)))
        return F.coalesce(whole(listed), whole(paired))

    named = F.transform(F.map_entries(F.from_json(json, "map<string,variant>")), lambda e: F.struct(F.when(e["key"].rlike(r"^-?[0-9]+\z"), e["key"].try_cast("int")).alias("key"), _number(e["value"]).alias("value")))
    mapped = F.filter(named, lambda e: e["key"].isNotNull() & e["value"].isNotNull() & (e["value"] != 0))
    return F.coalesce(_let(F.try_parse_json(json), of), mapped)


def sparse_field(json: Column) -> Column:
    """V3: an embedding service's sparse vector as a map by index: pairs of index and weight, arrays of both (values, data or weights), or an object by index, from which zero weights go. Of a repeated index the last weight counts. Null where the field has none of these shapes or nothing in it."""
    return _let(F.array_sort(_last_of(_sparse(json))), lambda es: F.when(F.size(es) > 0, F.map_from_entries(es)))


def sparse_probe(datum: Column) -> Column:
    """V3: the first of the known fields of an answer's entry that holds a sparse vector, else the one within its embeddings; null for none."""
    # The field as JSON text, whatever its type.
    return F.coalesce(*(sparse_field(F.get_json_object(datum, path)) for path in (*(f"$.{k}" for k in SPARSE_KEYS), "$.embeddings.sparse")))


def ipv4_number(address: Column) -> Column:
    """The number of an address of four parts up to 255; null for anything else."""
    part = lambda i: F.get(F.split(address, r"\."), F.lit(i)).try_cast("long")
    valid = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z") & (F.greatest(*(part(i) for i in range(4))) <= 255)
    return F.when(valid, ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


def is_private(address: Column) -> Column:
    """whether an address isn't a public one; what is no address counts as private. Of addresses with colons, loopback, unset, local and mapped private ones are; others of hex digits, colons and dots are public."""

    def of_number(n: Column) -> Column:
        out = F.lit(False)
        for base, bits in PRIVATE_BLOCKS:
            a = [int(x) for x in base.split(".")]
            low = ((a[0] * 256 + a[1]) * 256 + a[2]) * 256 + a[3]
            out = out | n.between(low, low + 2 ** (32 - bits) - 1)
        return F.coalesce(out, F.lit(True))

    ip6 = F.lower(address)
    hexes = r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\z"
    group = lambda i: F.conv(F.nullif(F.regexp_extract(ip6, hexes, i), F.lit("")), 16, 10).try_cast("long")
    dotted = r"^::ffff:([0-9]{1,3}(?:\.[0-9]{1,3}){3})\z"
    six = (
        F.when(ip6.isin("::", "::1") | ip6.rlike("^f[cd][0-9a-f]{2}:") | ip6.rlike("^fe[89ab][0-9a-f]:"), True)
        .when(ip6.rlike(dotted), of_number(ipv4_number(F.regexp_extract(ip6, dotted, 1))))
        .when(ip6.rlike(hexes), of_number(group(1) * 65_536 + group(2)))
        .otherwise(ip6.rlike("^::ffff:0:0") | ~ip6.rlike(r"^[0-9a-f:.]+\z"))
    )
    return F.coalesce(F.when(F.contains(address, F.lit(":")), six).otherwise(of_number(ipv4_number(address))), F.lit(True))


def error_class(code: Column) -> Column:
    """the class of a code from the parsing service; null for what may be tried again, which is everything that isn't known."""
    out = F.lit(None).cast("string")
    for name, codes in reversed(ERROR_CLASSES.items()):
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def is_retryable(code: Column) -> Column:
    """codes without a class, unknown and null ones too."""
    return error_class(code).isNull()


def retry_after_ms(header: Column, now: Column) -> Column:
    """a Retry-After header, seconds from 0 or a date, as milliseconds from now up to 30 s; null where it is neither."""
    said = F.trim(header)
    seconds = F.when(said.rlike(r"^[+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), said.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(said, r"^[A-Za-z]{3,9}, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    until = F.when(date.isNotNull(), F.unix_millis(date) - F.unix_millis(now))
    wait = F.coalesce(seconds * 1000, F.greatest(until, F.lit(0)).cast("double"))
    return F.when(wait.isNotNull() & (date.isNotNull() | seconds.isNotNull()), F.least(wait, F.lit(float(MOST_WAIT_MS)))).cast("long")
