"""Small string functions: cleaning, keys, names, ids and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.schema import has_text

# The characters Python's strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern. It is tried at every character of every text: one look-up for the low ones named
# singly, and one range test that nearly all others fail, are three times as fast as a list of ranges.
BLANK_RUN = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[^\u1681-\u1fff\u200b-\u2027\u202a-\u202e\u2030-\u205e\u2060-\u2fff]]]+"
)
# Accepted suffixes per reader.
READERS = {
    "pdf": [".pdf"],
    "docx": [".docx"],
    "epub": [".epub"],
    "pptx": [".pptx"],
    "text": [".txt", ".md", ".csv"],
}
# Size units, bytes first.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
UNKNOWN = "Unbekannt"


def regex(pattern: str) -> str:
    """Unicode classes, and only ``\\n`` as a line end."""
    return "(?Ud)" + pattern


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def words(c: Column) -> Column:
    """Split on whitespace runs, no empty words."""
    return F.filter(F.split(c, BLANK_RUN), lambda w: w != "")


def search_regex(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when the pattern does not match or matches nothing."""
    return F.nullif(F.regexp_extract(c, regex(pattern), group), F.lit(""))


def clean_text(c: Column, mode: str = "compat") -> Column:
    """Squeeze blank lines and spaces and strip every line.

    ``compat`` lets the line stripping swallow blank lines too; ``paragraphs`` keeps them.
    """
    squeezed = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), " {2,}(?!\n)", " ")
    blank = r"\s" if mode == "compat" else r"[^\S\n]"
    stripped = F.regexp_replace(squeezed, f"(?Udm)^{blank}+|{blank}+$", "")
    return F.coalesce(strip(stripped), F.lit(""))


def page_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.length(text) / 2000))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^./]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(file_name(name), r"(?s)(?<=.)\.[^./]+$", "")


def reader_for(name: Column) -> Column:
    """Which reader takes this file; null for unsupported types."""
    suffix = extension(name)
    routed = F.lit(None).cast("string")
    for reader, suffixes in READERS.items():
        routed = F.when(suffix.isin(suffixes), reader).otherwise(routed)
    return routed


def normalize_title(title: Column) -> Column:
    """Non-word characters become spaces, runs collapse; the form used in catalogue queries."""
    spaced = F.regexp_replace(title, regex(r"[^\w\s]"), " ")
    return strip(F.regexp_replace(spaced, regex(r"\s+"), " "))


def surname(name: Column) -> Column:
    """Last word of a name; a single word stays as it is."""
    parts = words(name)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(name)


def document_id(name: Column, size: Column, mtime: Column, content_md5: Column | None = None) -> Column:
    parts = [name, size.cast("string"), mtime.cast("string")]
    if content_md5 is not None:
        parts.append(content_md5)
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm == "sha256":
        return F.sha2(content, 256)
    raise ValueError(f"unknown hash algorithm {algorithm!r}; use md5, sha1 or sha256")


def cache_key(service: str, prefix: str, *args: Column) -> Column:
    """Look-up key ``service_prefix_args``; over 100 characters the arguments are hashed."""
    joined = F.concat_ws("_", *[F.when(has_text(a), a) for a in args])
    head = F.lit(f"{service}_{prefix}_")
    key = F.concat(head, joined)
    return F.when(F.length(key) > 100, F.concat(head, F.md5(joined))).otherwise(key)


def cache_file_key(key: Column) -> Column:
    safe = F.regexp_replace(key, r"[^\p{L}\p{N}_-]", "_")
    hashed = F.concat(F.substring(safe, 1, 50), F.lit("_"), F.md5(key))
    return F.when(F.length(safe) > 100, hashed).otherwise(safe)


def human_size(size: Column) -> Column:
    """``0 B`` or two decimals with a 1024-step unit; halves round to even."""
    text = None
    for power, unit in reversed(list(enumerate(SIZE_UNITS))):
        scaled = F.format_string(f"%.2f {unit}", F.bround(size.cast("double") / float(1024**power), 2))
        text = scaled if text is None else F.when(size < 1024 ** (power + 1), scaled).otherwise(text)
    return F.when(size == 0, "0 B").otherwise(text)


def short_size(size: Column) -> Column:
    """The form the upload page shows: up to GB, trailing zeros dropped."""
    text = None
    for power, unit in reversed(list(enumerate(["Bytes", "KB", "MB", "GB"]))):
        digits = F.format_string("%.2f", F.round(size.cast("double") / float(1024**power), 2))
        shown = F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit(f" {unit}"))
        text = shown if text is None else F.when(size < 1024 ** (power + 1), shown).otherwise(text)
    return F.when(size == 0, "0 Bytes").otherwise(text)


def safe_filename(name: Column) -> Column:
    unsafe = '<>:"/\\|?*'
    cleaned = strip(F.translate(name, unsafe, "_" * len(unsafe)))
    return F.when(has_text(cleaned), cleaned).otherwise("unnamed_file")


def display_time(ts: Column, default: str = UNKNOWN) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(default))


def language_label(code: Column, default: str = UNKNOWN) -> Column:
    return F.when(code == "de", "Deutsch").when(code == "en", "Englisch").otherwise(F.coalesce(code, F.lit(default)))


def file_type_label(name: Column, default: str = UNKNOWN) -> Column:
    label = F.upper(F.substring(extension(name), 2, 20))
    return F.when(has_text(label), label).otherwise(default)


def split_names(c: Column, kind: str = "form") -> Column:
    """Author field to list: ``[,;]`` in paged files, ``;`` in office files, ``,`` in forms."""
    separator = {"pdf": r"[,;]\s*", "office": ";", "form": ","}[kind]
    names = F.transform(F.split(c, separator), strip)
    return F.filter(names, lambda n: n != "") if kind == "pdf" else names
