"""Text functions as Spark expressions: tokens, query terms, filters, labels, dates, versions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words that the keyword leg drops.
STOPWORDS = (
    "a about an and any are as at be by can could did do does for from how i if in into is it its me my no "
    "not of on or our over should so than that the them there these they this those to under versus vs was "
    "we what when where which who why will with would you your"
).split()
# The smaller list of the stop-word variant, and the marks it trims before the test.
VARIANT_STOPWORDS = (
    "a about an and any are as at be by can do does for from how i if in is it me my of on or should than "
    "that the there this to vs was what when which why with you your"
).split()
VARIANT_TRIM = ".,;:!?\"'()[]"
# Model control tokens that are taken out of converted pages.
CONTROL_TOKENS = [
    "<|begin_of_box|>", "<|end_of_box|>", "<|box_start|>", "<|box_end|>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|im_sep|>",
    "<start_of_turn>", "<end_of_turn>",
]
# Model family, query prefix, document prefix; the first that a model's name holds counts.
FAMILIES = [
    ("qwen3-embedding", "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ", ""),
    ("nomic", "search_query: ", "search_document: "),
    ("e5", "query: ", "passage: "),
    ("bge", "Represent this sentence for searching relevant passages: ", ""),
]


def _accents() -> tuple[str, str]:
    pairs = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            pairs[chr(point)] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters, be they part of the letter or marks after it."""
    return F.regexp_replace(F.lower(F.translate(text, *_accents())), r"[\x{300}-\x{36F}]", "")


def tokens(text: Column) -> Column:
    """Terms of a text: folded runs of letters and digits with their marks."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), 0)


def query_tokens(query: Column, stopwords: list[str] = STOPWORDS, trim: str = "") -> Column:
    """White-space tokens with a letter or digit; without stop words, unless nothing else is left."""
    usable = F.filter(F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " "), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(usable, lambda t: ~F.array_contains(stop, F.lower(F.btrim(t, F.lit(trim)) if trim else t)))
    return F.when(F.size(kept) > 0, kept).otherwise(usable)


def match_expression(query: Column) -> Column:
    """The quoted, OR-joined form of a query's tokens; empty where nothing can be searched."""
    return F.array_join(F.transform(query_tokens(query), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def matches_all_words(haystack: Column, query: Column) -> Column:
    """Every white-space word of query occurs in haystack, whatever the case; an empty query matches."""
    words = F.filter(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(haystack), w))


def first_line(text: Column, most: int = 120) -> Column:
    """First line of the trimmed text, cut after so many characters."""
    line = F.split(F.btrim(text, F.lit(" \t\n\r")), "\n")[0]
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def session_title(query: Column, most: int = 48) -> Column:
    text = F.trim(F.regexp_replace(query, r"\s+", " "))
    return F.when(text == "", "New session").when(F.char_length(text) > most, F.concat(F.trim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def strip_control_tokens(text: Column) -> Column:
    for token in CONTROL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return F.btrim(text, F.lit(" \t\n\r"))


def model_prefix(model: Column, kind: str = "query") -> Column:
    """Prefix that a model family wants before queries or documents; empty for an unknown family."""
    at = 1 if kind == "query" else 2
    found = F.lit("")
    for row in reversed(FAMILIES):
        found = F.when(F.contains(F.lower(model), F.lit(row[0])), row[at]).otherwise(found)
    return found


def percent_encode(path: Column) -> Column:
    """Each segment of a path percent-encoded; letters, digits and the marks - _ . ~ $ & + : = @ stay."""

    def segment(s: Column) -> Column:
        s = F.url_encode(s)
        for code, mark in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@")):
            s = F.replace(s, F.lit(code), F.lit(mark))
        return s

    return F.array_join(F.transform(F.split(path, "/"), segment), "/")


def absolute_date(t: Column, now: Column) -> Column:
    return F.when(F.year(t) == F.year(now), F.date_format(t, "MMM d")).otherwise(F.date_format(t, "MMM d, yyyy"))


def relative_date(t: Column, now: Column) -> Column:
    """just now, minutes, hours, days ago; a calendar date beyond a week or in the future; null: empty."""
    s = F.unix_timestamp(now) - F.unix_timestamp(t)

    def ago(unit: int, letter: str) -> Column:
        return F.concat(F.floor(s / unit).cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(t.isNull(), "").when(s < 0, absolute_date(t, now)).when(s < 60, "just now").when(s < 3600, ago(60, "m"))
        .when(s < 86400, ago(3600, "h")).when(s < 7 * 86400, ago(86400, "d")).otherwise(absolute_date(t, now))
    )


def version_key(version: Column) -> Column:
    """Sortable form of a dotted version of any length: numbers as numbers, words before them, missing segments as 0."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.struct(p.cast("decimal(38,0)").alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(-1).cast("decimal(38,0)").alias("n"), p.alias("s"))))

    def segment(x: Column, i: Column) -> Column:  # on which side of all zeros the rest lies comes first
        rest = F.get(F.filter(F.slice(parts, i + 1, F.size(parts) + 1), lambda y: y["n"] != 0), F.lit(0))
        return F.struct(F.coalesce(F.sign(rest["n"]), F.lit(0)).cast("int").alias("side"), x["n"].alias("n"), x["s"].alias("s"))

    end = F.struct(F.lit(0).alias("side"), F.lit(0).cast("decimal(38,0)").alias("n"), F.lit("").alias("s"))
    return F.concat(F.filter(F.transform(parts, segment), lambda y: y["side"] != 0), F.array(end))


def trash_time(trash_id: Column) -> Column:
    """UTC time of a trash id (yyyyMMdd'T'HHmmss, maybe -N); malformed: null."""
    stamp = F.substring_index(trash_id, "-", 1)
    return F.when(stamp.rlike(r"^\d{8}T\d{6}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss")))


_BLANKS = " \t\n\r\v\f"


def is_hidden(path: Column) -> Column:
    """Whether the last part of a path begins with a full stop."""
    return F.startswith(F.element_at(F.split(path, "/"), -1), F.lit("."))


def ensure_markdown_ext(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(md|markdown)$"), path).otherwise(F.concat(path, F.lit(".md")))


def trim_markdown_ext(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(md|markdown)$", "")


def assignments(sets: Column) -> Column:
    """struct(ok, props) of an array of key=v1,v2: values trimmed, empty ones dropped, the last of a key wins.

    Not ok, and without props, where one lacks its = or its key.
    """
    entries = F.transform(sets, lambda s: F.struct(F.substring_index(s, "=", 1).alias("key"), F.filter(F.transform(F.split(F.substring(s, F.instr(s, "=") + 1, F.char_length(s)), ","), lambda v: F.btrim(v, F.lit(_BLANKS))), lambda v: v != "").alias("values")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    ok = F.forall(sets, lambda s: F.instr(s, "=") > 1)
    return F.struct(ok.alias("ok"), F.when(ok, last).alias("props"))


def name_version(arg: Column) -> Column:
    """struct(name, version) of NAME@VERSION, parted at the last @; no @: empty version."""
    whole = r"(?s)^(.*)@([^@]*)$"
    at = F.contains(arg, F.lit("@"))
    return F.struct(F.when(at, F.regexp_extract(arg, whole, 1)).otherwise(arg).alias("name"), F.when(at, F.regexp_extract(arg, whole, 2)).otherwise("").alias("version"))


def utc_text(t: Column) -> Column:
    """A time in UTC to the second, as yyyy-MM-ddTHH:mm:ssZ."""
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
