"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One CJK, kana or hangul character, or a word of letters and digits that may go on with _ ' ’ -.
TOKEN = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]|[\p{L}\p{N}][\p{L}\p{N}_'’-]*"
WIDE = "[\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe6f\uff00-\uffef]"  # takes two cells
CJK = "[\u4e00-\u9fff]"  # of rough token counts
CJK_RUN = "[\u4e00-\u9fa5]{2,}"  # of marks in hits
LATIN_WORD = "[A-Za-z][A-Za-z0-9_-]+"
ZERO_WIDTH = "[\u200b-\u200d\u2060\ufeff]"
BLANK = "[ \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CHUNK_NAMESPACE = "9f8b7c6d-5e4f-4a3b-8c1d-0e9f8a7b6c5d"
STATUS_MAP = {"queued": "waiting", "parsing": "parsing", "chunking": "splitting", "embedding": "indexing", "upserting": "indexing", "ready": "completed", "failed": "error"}
RETRY_MS = (2_000, 8_000, 30_000)
# What cleaning Markdown replaces, in this order: control characters, line ends, zero-width and wide spaces, spaces at the ends of lines, bullets, runs of blank lines, spaces between emphasis marks and punctuation, and white space around all.
SPACE = "[ \t\n\u1680\u2000-\u200a\u2028\u2029\u202f\u205f]"
IN_LINE = SPACE.replace("\n", "")
CLEANING = (
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"\r\n?", "\n"),
    ("[\u200b-\u200d\u2060\ufeff]", ""),
    ("[\u00a0\u3000]", " "),
    (r"[ \t]+(?![^\n])", ""),
    (rf"(?<![^\n])([ \t]*)[•‣▪▫◦·●○]{IN_LINE}+", "$1- "),
    (r"\n{4,}", "\n\n\n"),
    (rf"(\*\*|\*|~~|`){SPACE}+([，。；：、！？）】》”’,.;:!?)\]}}])", "$1$2"),
    (rf"([（【《“‘({{\[]){SPACE}+(\*\*|\*|~~|`)", "$1$2"),
    (rf"^{SPACE}+|{SPACE}+(?![\s\S])", ""),
)


def tokens(text: Column) -> Column:
    """the tokens of a text in their own case; none of a null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def hash16(text: Column) -> Column:
    """the first 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid5(name: Column, namespace: str = CHUNK_NAMESPACE) -> Column:
    """a name-based UUID (version 5) in its namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def chunk_id(kb: Column, doc: Column, seq: Column, text: Column) -> Column:
    return uuid5(F.concat_ws(":", kb, doc, seq, hash16(text)))


def fingerprint16(is_parent: Column, preview: Column) -> Column:
    """the identity of a chunk in a version diff."""
    return F.substring(F.sha1(F.concat(F.when(is_parent, "true").otherwise("false"), F.lit("|"), preview)), 1, 16)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a text."""
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def highlight_tokens(query: Column) -> Column:
    """what to mark in hits: Latin words of two and more characters in their own case, each as often as it stands there, then CJK runs of two and more and their grams of two to four, each once; the longest first, else in that order."""
    words = F.regexp_extract_all(query, F.lit(LATIN_WORD), F.lit(0))
    runs = F.regexp_extract_all(query, F.lit(CJK_RUN), F.lit(0))

    def grams(run: Column) -> Column:
        of = lambda k: F.when(F.length(run) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - k + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(run), of(2), of(3), of(4))

    found = F.concat(words, F.array_distinct(F.flatten(F.transform(runs, grams))))
    return F.transform(F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), lambda s: s["t"])


def rough_tokens(text: Column) -> Column:
    """F8: CJK characters count one, four others one; under one only an empty text, which has none."""
    said = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(said, F.lit(CJK))
    return F.when(said == "", 0).otherwise(F.greatest(F.lit(1), F.floor(cjk + (F.length(said) - cjk) / 4 + 0.5))).cast("long")


def display_width(text: Column) -> Column:
    """wide characters take two cells."""
    return (F.length(text) + F.regexp_count(text, F.lit(WIDE))).cast("long")


def clean_inline(text: Column) -> Column:
    """zero-width characters go, all white space becomes single spaces; those at the ends stay."""
    return F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), f"{BLANK}+", " ")


def clean_markdown(text: Column) -> Column:
    """CLEANING in order, trimmed, with one end of line; an empty text stays empty."""
    out = text
    for pattern, by in CLEANING:
        out = F.regexp_replace(out, pattern, by)
    return F.when(out != "", F.concat(out, F.lit("\n"))).otherwise(out)


def safe_filename(name: Column, fallback: Column | None = None) -> Column:
    """control characters, what file systems refuse and zero-width ones become spaces, white space single ones, dots and spaces go at the ends; at most 80 characters; the fallback where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1F\x7F\\/:*?"<>|]', " "), ZERO_WIDTH, " ")
    cleaned = F.regexp_replace(F.regexp_replace(plain, f"{BLANK}+", " "), r"^[. ]+|[. ]+\z", "")
    return F.substring(F.when(cleaned != "", cleaned).otherwise(F.lit("") if fallback is None else fallback), 1, 80)


def js_round(x: Column, digits: int = 0) -> Column:
    """halves go up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def status_of(status: Column) -> Column:
    """the seven states of a document as the six of the compatibility interface."""
    out = F.lit("error")
    for key, value in STATUS_MAP.items():
        out = F.when(status == key, value).otherwise(out)
    return out


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(F.floor(x), F.lit(low)), F.lit(high)).cast("long")


def retry_backoff_ms(attempts: Column) -> Column:
    """F21 without its jitter of up to a second."""
    return F.element_at(F.array(*(F.lit(x) for x in RETRY_MS)), clamp(attempts, 1, len(RETRY_MS)).cast("int")).cast("long")


def probe_backoff_ms(fails: Column) -> Column:
    """F22."""
    return F.least(F.lit(60_000), F.lit(5_000) * F.pow(F.lit(2), F.least(fails, F.lit(4)))).cast("long")


def human_count(n: Column) -> Column:
    """whole numbers by thousands with K, M and B, without zeros after the point; a dash for null. Halves go up."""

    def scaled(unit: int, digits: int, name: str) -> Column:
        steps = 10**digits
        rounded = F.floor((n * steps * 2 + unit) / (2 * unit)).cast(f"decimal(20,{digits})") / F.lit(steps)
        return F.concat(F.regexp_replace(rounded.cast(f"decimal(20,{digits})").cast("string"), r"\.?0+\z", ""), F.lit(name))

    by = F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, scaled(1_000, 1, "K")).when(n < 1_000_000_000, scaled(1_000_000, 2, "M")).otherwise(scaled(1_000_000_000, 2, "B"))
    return F.coalesce(by, F.lit("\u2014"))


def human_bytes(n: Column) -> Column:
    """Bytes by powers of 1 024."""
    by = lambda power, unit: F.concat(F.format_string("%.1f", n / 1024**power), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, by(1, " KB")).when(n < 1024**3, by(2, " MB")).otherwise(by(3, " GB"))


def key_columns(key: Column) -> Column:
    """what is stored of a key: a placeholder by which it is unique, its hash, and its first 12 characters to show."""
    digest = F.sha2(key, 256)
    return F.struct(F.concat(F.lit("sha256:"), F.substring(digest, 1, 16)).alias("key"), digest.alias("key_hash"), F.substring(key, 1, 12).alias("key_prefix"))


def key_preview(key: Column, prefix: Column) -> Column:
    """the prefix that is stored; of a row from before there were any, the key itself up to 12 characters, else its first eight and last four."""
    old = F.when(F.length(key) <= 12, key).otherwise(F.concat(F.substring(key, 1, 8), F.lit("\u2026"), F.substring(key, -4, 4)))
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\u2026"))).otherwise(old)
