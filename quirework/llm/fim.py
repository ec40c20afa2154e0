"""Fill-in-the-middle transformation by escaped marker injection, in DataFrame operations only.

A text's units (code points, words with the gap before them, or lines) are marked by one
``regexp_replace`` that puts a delimiter after each.  So that the delimiter can stand in a
text, too, it is escaped first: an escape character becomes two characters, the delimiter
another two, and the units' pattern takes such a pair for one.  The delimiters are counted;
``substring_index`` takes out what lies before, between and after two of them, and the
parts are unescaped and put together with the markers.

Where to cut, and which form a text gets, comes from the SHA-256 of a seed and the id: its
first four groups of eight hex digits are h1 to h4.  The prefix ends after the smaller of
``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, the middle after the larger.  A text stays
plain if it is empty, holds one of the markers, or ``h3 % 100 >= fim_percent``; the others
are in suffix-prefix-middle order if ``h4 % 100 < spm_percent``, else in
prefix-suffix-middle order.

Every row is by itself: nothing is shuffled, and a text of any length is a few passes over it.

Defined cases: a null text is empty, and so plain; a null id counts as no digits; what
follows the last unit (a trailing gap) belongs to the suffix; texts that hold the
delimiter or the escape character come back unchanged; repeated rows give equal rows; an
empty table gives none; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter and the escape character, and what they become in a text: the escape and one of two letters.
DELIMITER, ESCAPE, OF_ESCAPE, OF_DELIMITER = "\x01", "\x02", "\x02e", "\x02d"
#: Units by name: a pattern over escaped texts.  Pairs hold no space and no line end, so only single characters need to know them.
UNITS = {"char": "(?s)\x02.|.", "word": "\\s*\\S+", "line": "[^\\n]*\\n|[^\\n]+"}
#: Prefix, suffix and middle.  No marker's end begins a marker, so one never arises where a part and a marker meet.
MARKERS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OF_ESCAPE)), F.lit(DELIMITER), F.lit(OF_DELIMITER))


def plain(marked: Column) -> Column:
    """The text of which ``marked`` is an escaped part with delimiters."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(OF_DELIMITER), F.lit(DELIMITER)), F.lit(OF_ESCAPE), F.lit(ESCAPE))


def cut(marked: Column, count: Column) -> Column:
    """``substring_index`` with a count of its own in each row."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count)


def split(docs: DataFrame, *, unit: str = "char", seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n, h3, h4, prefix, middle, suffix) of every row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn("digest", digest).withColumn("marked", F.regexp_replace(escaped(F.col("text")), F.lit(UNITS[unit]), F.lit("$0" + DELIMITER)))
    n = F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(DELIMITER), F.lit("")))
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = rows.withColumn("n", n.cast("long"))
    rows = rows.select(id_col, "text", "n", "marked", *[(x % (F.col("n") + 1)).cast("int").alias(f"at{k}") for k, x in enumerate(h[:2])], h[2].alias("h3"), h[3].alias("h4"))
    low, high, whole = F.least("at0", "at1"), F.greatest("at0", "at1"), F.col("n").cast("int")
    parts = {"prefix": cut(F.col("marked"), low), "middle": cut(cut(F.col("marked"), high), low - high), "suffix": cut(F.col("marked"), high - whole - 1)}
    return rows.select(id_col, "text", "n", "h3", "h4", *[plain(x).alias(k) for k, x in parts.items()])


def transform(docs: DataFrame, *, unit: str = "char", seed: str = "1", fim_percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: n counts units, the others code points."""
    if len(set(markers)) < 3 or any(a[-k:] == b[:k] for a in markers for b in markers for k in range(1, len(a))) or any(a != b and a in b for a in markers for b in markers):
        raise ValueError("markers must differ, and none may begin as one ends or lie within another")
    p, s, m = markers
    rows = split(docs, unit=unit, seed=seed, id_col=id_col, text_col=text_col)
    stays = (F.col("text") == "") | (F.col("h3") % 100 >= fim_percent)
    for x in markers:
        stays = stays | F.contains("text", F.lit(x))
    rows = rows.withColumn("form", F.when(stays, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    is_plain = F.col("form") == "plain"
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(is_plain, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    chars = [F.when(~is_plain, F.length(x).cast("long")).alias(f"{x}_chars") for x in ("prefix", "middle")]
    return rows.select(id_col, "n", "form", *chars, output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from what ``transform`` made of it, by its form."""
    p, s, m = markers
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.replace(F.substring_index(head, s, 1), F.lit(p), F.lit("")), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.replace(F.substring_index(head, p, 1), F.lit(s), F.lit("")))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
