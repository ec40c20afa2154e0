"""Normal forms as expressions, so that no text leaves the JVM for them.

Only what can change is looked at: a text is cut where a boundary is certain, and the pieces
that hold a character which may decompose, reorder or compose are decomposed, sorted and
composed by folds over their code points; all else passes in long runs.  A piece is one character and the marks behind
it, so a fold is short.

The tables come from the Unicode data of the driver's Python: two levels, by the upper and lower bits of
a code point, folded into literals; a look-up is two array reads.  Syllables of Hangul are arithmetic.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "(?s)."
#: Where Hangul jamo and syllables begin, and how many there are of each.
L0, V0, T0, S0 = 0x1100, 0x1161, 0x11A7, 0xAC00
LN, VN, TN = 19, 21, 28
SN = LN * VN * TN
ACCENTS = (0x300, 0x36F)


def points() -> range:
    return range(0x110000)


def is_syllable(c: int) -> bool:
    return S0 <= c < S0 + SN


@cache
def decompositions() -> dict[int, str]:
    """Full canonical decompositions, but for Hangul."""
    found = ((c, unicodedata.normalize("NFD", chr(c))) for c in points() if not is_syllable(c) and not 0xD800 <= c < 0xE000)
    return {c: d for c, d in found if d != chr(c)}


@cache
def compositions() -> dict[str, dict[str, str]]:
    """Composites by their second and then their first part."""
    out: dict[str, dict[str, str]] = {}
    for c in decompositions():
        pair = [chr(int(x, 16)) for x in unicodedata.decomposition(chr(c)).split()]
        if len(pair) == 2 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            out.setdefault(pair[1], {})[pair[0]] = chr(c)
    return out


def ranges(found: set[int]) -> str:
    """A character class of code points."""
    out, run = [], []
    for c in [*sorted(found), None]:
        if run and c != run[-1] + 1:
            out.append(f"\\x{{{run[0]:X}}}" + (f"-\\x{{{run[-1]:X}}}" if len(run) > 1 else ""))
            run = []
        run.append(c)
    return "".join(out)


@cache
def classes() -> tuple[str, str]:
    """(marks, others): characters that act on what is before them, and those that change by themselves."""
    jamo = {*range(V0, V0 + VN), *range(T0 + 1, T0 + TN)}
    marks = {c for c in points() if unicodedata.combining(chr(c))} | jamo | {ord(m) for m in compositions()}
    # a decomposition may begin with a mark, too
    marks |= {c for c, d in decompositions().items() if ord(d[0]) in marks}
    others = {c for c in decompositions() if unicodedata.normalize("NFC", chr(c)) != chr(c)} - marks
    return ranges(marks), ranges(others)


def pages(table: dict[int, object]) -> str:
    """A table by code point as JSON of two levels."""
    out: list = [None] * ((max(table, default=0) >> 8) + 1)
    for c, value in table.items():
        page = out[c >> 8] = out[c >> 8] or []
        page.extend([None] * ((c & 255) + 1 - len(page)))
        page[c & 255] = value
    return json.dumps(out, ensure_ascii=False)


@cache
def tables() -> dict[str, str]:
    """Decompositions, classes of marks, firsts and wholes of what a mark composes with, and ASCII behind accents."""
    pairs = compositions()
    strip = lambda d: "".join(x for x in d if not ACCENTS[0] <= ord(x) <= ACCENTS[1])
    bare = {c: d for c in points() if c > 127 and not is_syllable(c) and not 0xD800 <= c < 0xE000 and (d := strip(unicodedata.normalize("NFKD", chr(c)))) != chr(c) and (not d or any(x.isascii() for x in d))}
    found = {"whole": decompositions(), "class": {c: k for c in points() if (k := unicodedata.combining(chr(c)))}, "firsts": {ord(m): "".join(p) for m, p in pairs.items()}, "composites": {ord(m): "".join(p.values()) for m, p in pairs.items()}, "bare": bare}
    return {name: pages(table) for name, table in found.items()}


def table(name: str, kind: str = "string") -> Callable[[Column], Column]:
    """A look-up by code point: two reads of a literal; null where the table has none."""
    literal = F.from_json(F.lit(tables()[name]), f"array<array<{kind}>>")
    return lambda point: F.get(F.get(literal, F.shiftright(point, 8)), point.bitwiseAND(F.lit(255)))


def of_point(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def decomposed(chars: Column) -> Column:
    """Code points of the canonical decomposition of an array of characters, not yet in order."""
    known = table("whole")

    def one(c: Column) -> Column:
        s = F.ascii(c) - S0
        tail = F.when(s % TN > 0, of_point(F.lit(T0) + s % TN)).otherwise(F.lit(""))
        jamo = F.concat(of_point(F.lit(L0) + F.floor(s / (VN * TN))), of_point(F.lit(V0) + F.floor(s % (VN * TN) / TN)), tail)
        return F.when((s >= 0) & (s < SN), jamo).otherwise(F.coalesce(known(F.ascii(c)), c))

    return F.regexp_extract_all(F.array_join(F.transform(chars, one), ""), F.lit(POINT), F.lit(0))


def ordered(chars: Column) -> Column:
    """(run, class, place, c) of decomposed characters in canonical order: marks sorted by class behind their starter."""
    kinds = table("class", "int")
    zero = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<run:int,class:int,place:int,c:string>>").alias("out"))

    def step(have: Column, c: Column) -> Column:
        kind = F.coalesce(kinds(F.ascii(c)), F.lit(0))
        run = have["run"] + F.when(kind == 0, 1).otherwise(0)
        row = F.struct(run.alias("run"), kind.alias("class"), F.size(have["out"]).alias("place"), c.alias("c"))
        return F.struct(run.alias("run"), F.array_append(have["out"], row).alias("out"))

    return F.array_sort(F.aggregate(chars, zero, step, lambda have: have["out"]))


def composed(rows: Column) -> Column:
    """The text of ordered characters, each starter joined with what may join it."""
    firsts, wholes = table("firsts"), table("composites")
    zero = F.struct(F.lit("").alias("out"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def joined(a: Column, c: Column) -> Column:
        """The composite of a starter and a character, or null."""
        x, y = F.ascii(a), F.ascii(c)
        lv = F.when((x >= L0) & (x < L0 + LN) & (y >= V0) & (y < V0 + VN), of_point(F.lit(S0) + ((x - L0) * VN + (y - V0)) * TN))
        lvt = F.when((x >= S0) & (x < S0 + SN) & ((x - S0) % TN == 0) & (y > T0) & (y < T0 + TN), of_point(x + (y - T0)))
        place = F.when(a != "", F.call_function("instr", firsts(y), a))
        return F.coalesce(lv, lvt, F.when(place > 0, F.substring(wholes(y), place, 1)))

    def step(have: Column, row: Column) -> Column:
        c, kind = row["c"], row["class"]
        free = F.when(have["marks"] == "", True).otherwise(have["last"] < kind)
        whole = F.when((have["starter"] != "") & free, joined(have["starter"], c))
        new = lambda out, starter, marks, last: F.struct(out.alias("out"), starter.alias("starter"), marks.alias("marks"), last.alias("last"))
        begun = new(F.concat(have["out"], have["starter"], have["marks"]), c, F.lit(""), F.lit(0))
        marked = new(have["out"], have["starter"], F.concat(have["marks"], c), kind)
        return F.when(whole.isNotNull(), new(have["out"], whole, have["marks"], have["last"])).when(kind == 0, begun).otherwise(marked)

    return F.aggregate(rows, zero, step, lambda have: F.concat(have["out"], have["starter"], have["marks"]))


@cache
def calm(least: int = 64) -> str:
    """A class of long stretches of characters that nothing happens to: a test of some dozen ranges ahead of one of hundreds."""
    touched = sorted({c for c in points() if unicodedata.combining(chr(c))} | {ord(m) for m in compositions()} | set(decompositions()) | set(range(L0, T0 + TN)) | {0xD800, 0xDFFF, 0x110000})
    touched = [c for c in touched if not (c in decompositions() and unicodedata.normalize("NFC", chr(c)) == chr(c))]
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *touched], touched, strict=False) if b - a > least and a != 0xD800]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in gaps)


def nfc(text: Column) -> Column:
    """The composed canonical form."""
    marks, others = classes()
    low, safe = "\\x{0}-\\x{2FF}", calm()  # the first mark is U+0300
    touched = f"[{marks}{others}]"
    rest = F.array_join(F.regexp_extract_all(text, F.lit(f"[^{low}]+"), F.lit(0)), "")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)[{low}]+(?![^{low}])|[{safe}]+(?![^{safe}])|[^{marks}]?[{marks}]+|."), F.lit(0))
    fixed = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{safe}]+$") | ~p.rlike(touched), p).otherwise(composed(ordered(decomposed(F.regexp_extract_all(p, F.lit(POINT), F.lit(0)))))))
    changes = (F.octet_length(text) != F.char_length(text)) & text.rlike(f"[^{low}]") & F.regexp_replace(rest, f"[{safe}]+", "").rlike(touched)
    return F.when(changes, F.array_join(fixed, "")).otherwise(text)


def without_accents(text: Column) -> Column:
    """The compatible decomposition without accents, as far as ASCII comes of it: other characters may stay as they are."""
    known = table("bare")
    changed = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(POINT), F.lit(0)), lambda c: F.coalesce(known(F.ascii(c)), c)), "")
    return F.when(F.octet_length(text) != F.char_length(text), changed).otherwise(text)
