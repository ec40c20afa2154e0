"""Text expressions, all of them built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import unicode

# White space as scripts in browsers see it.
SPACE = "[\\x{0009}-\\x{000D}\\x{0020}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
URL, NUMERIC = "(?i)^https?://\\S+$", "^[\\d\\s.,%$€£-]+$"
PLACEHOLDER, OPENING = "</?x-inline[^>]*>", '<x-inline data-id="[^"]+">'
SAFE_PATH, EXTERNAL = "^[A-Za-z0-9._/-]+$", "(?i)^([a-z][a-z0-9+.-]*:|//)"
UNSAFE, ACCENT = "[^A-Za-z0-9._-]+", "[\u0300-\u036F]"
#: An unsafe character that no normal form touches.
ODD = "[\\x{0}-\\x{2C}\\x{3A}-\\x{40}\\x{5B}-\\x{5E}\\x{60}\\x{7B}-\\x{7F}]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}", ""), f"{SPACE}$", "")


def squeezed(text: Column) -> Column:
    """White space runs become one space, none at the edges."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalized(text: Column) -> Column:
    return unicode.nfc(squeezed(text))


def units(text: Column) -> Column:
    """Length in UTF-16 units; plain length unless a character lies beyond the first plane."""
    return F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), (F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")).otherwise(F.length(text).cast("long"))


def slug(path: Column) -> Column:
    """A name for a chapter path: no extension, dashes for anything else, lower case."""
    stem = F.regexp_replace(path, "\\.[^.]+$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.lower(bare), F.lit("")), F.lit("chapter"))


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def segment_id(path: Column, number: Column, normal: Column) -> Column:
    padded = F.when(number > 9999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 4, "0"))
    return F.concat(slug(path), F.lit("-p"), padded, F.lit("-"), F.substring(checksum(normal), 1, 10))


def cache_key(source: Column, target: Column, provider: Column, model: Column, normal: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat(source, target, provider, model, F.lit(version), normal), 256)


def estimated_tokens(text: Column, segment: Column | None = None) -> Column:
    """A token for four UTF-16 units, the segment's envelope included, at least one."""
    more = F.lit(0) if segment is None else units(segment) + 50
    return F.greatest(F.lit(1), F.ceil((units(text) + more) / 4)).cast("long")


def without_placeholders(text: Column) -> Column:
    return F.regexp_replace(text, PLACEHOLDER, "")


def placeholder_tags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({OPENING})"), F.lit(1)))


def language_neutral(text: Column) -> Column:
    t = trimmed(text)
    return (t == "") | t.rlike(URL) | t.rlike(NUMERIC) | ~t.rlike("\\p{L}")


def escaped(text: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if attribute else out


def safe_path(path: Column, ascii_only: bool = False) -> Column:
    """Each part keeps its extension and becomes plain ASCII before it.

    Every step binds what the next uses more than once.  A part may be very long: long runs of its first
    unsafe character, which becomes a single mark anyway, are shortened before regular expressions see it.
    """

    def cut(p: Column) -> Column:
        ahead = F.octet_length(p) - F.octet_length(F.substring_index(p, ".", -1)) - 1
        base = lambda: F.substring(p.cast("binary"), F.lit(1), ahead).cast("string")
        ext = F.substring(p.cast("binary"), ahead + 1, F.octet_length(p)).cast("string")
        return F.when(ahead > 0, F.struct(base().alias("base"), ext.alias("ext"))).otherwise(F.struct(p.alias("base"), F.lit("").alias("ext")))

    def shorter(p: Column) -> Column:
        base = p["base"]
        for many in (1024, 32):
            base = F.replace(base, F.repeat(p["odd"], F.lit(many)), p["odd"])
        return F.struct(base.alias("base"), p["ext"].alias("ext"))

    def clean(p: Column) -> Column:
        base = p["base"] if ascii_only else unicode.without_accents(p["base"])
        base = F.regexp_replace(F.regexp_replace(base, UNSAFE, "_"), "_+", "_")
        return F.struct(F.regexp_replace(base, "^[._]+|[._]+$", "").alias("base"), p["ext"].alias("ext"))

    parts = F.transform(F.split(path, "/"), cut)
    parts = F.transform(parts, lambda p: F.struct(p["base"].alias("base"), F.regexp_extract(p["base"], ODD, 0).alias("odd"), p["ext"].alias("ext")))
    parts = F.transform(F.transform(parts, shorter), clean)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.when(p["base"] == "", "file").otherwise(p["base"]), p["ext"])), "/")


def output_name(path: Column, language: Column | None = None) -> Column:
    middle = F.lit("-bilingual.epub") if language is None else F.concat(F.lit("-"), language, F.lit("-bilingual.epub"))
    return F.regexp_replace(path, F.lit("(?i)\\.epub$"), middle)


def drive_id(link: Column) -> Column:
    """The file id of a shared link, by path or by parameter."""
    by_path, by_name = F.regexp_extract(link, "/file/d/([A-Za-z0-9_-]+)", 1), F.regexp_extract(link, "[?&]id=([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(by_path, F.lit("")), F.nullif(by_name, F.lit("")))
