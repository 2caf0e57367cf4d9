"""Column expressions on strings: white space, words, names of files, sizes, numbers of lists.

White space is Unicode white space plus U+001C to U+001F, as Python's str methods have it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
_U = "(?U)"
# The characters of SPACE: controls, the blank, next line, no-break, Ogham, the General Punctuation ones, and the ideographic one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, f"{_U}{SPACE}+", " "))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def words(x: Column) -> Column:
    return F.array_remove(F.split(x, f"{_U}{SPACE}+"), "")


def bound(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once a row, however often and within whatever lambda it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def word_count(x: Column) -> Column:
    return F.size(words(x))


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def utf16_prefix(x: Column, n: int) -> Column:
    """The longest prefix of whole characters within ``n`` UTF-16 units."""
    return F.when(utf16_length(x) <= n, x).otherwise(F.regexp_replace(F.decode(F.substring(F.encode(x, "UTF-16BE"), 1, 2 * n), "UTF-16BE"), "�$", ""))


def blank(x: Column) -> Column:
    return F.coalesce(strip(x) == "", F.lit(True))


def clean_extracted(x: Column) -> Column:
    """Squeeze text; where it holds table rows (lines from | to |) keep its lines and single blank ones.

    Rows keep their cells, with runs of spaces and tabs as one space; other lines are squeezed.
    """
    lines = F.transform(F.split(F.regexp_replace(x, "\r\n?", "\n"), "\n"), strip)
    lines = F.transform(lines, lambda v: F.when(v.rlike(r"^\|.*\|$"), F.regexp_replace(v, r"[ \t]+", " ")).otherwise(squeeze(v)))
    # A blank line counts if the line before it is not blank.
    kept = bound(lines, lambda held: F.filter(held, lambda v, i: (v != "") | (F.when(i > 0, F.get(held, i - 1)).otherwise("") != "")))
    joined = strip(F.array_join(kept, "\n"))
    return F.when(x.isNull(), None).when(F.regexp_replace(x, "\r\n?", "\n").rlike(r"(?m)^\|.*\|$"), joined).otherwise(squeeze(x))


def safe_filename(name: Column, default: str) -> Column:
    """The last part of a path without characters that file systems refuse; ``default`` if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)), "/+$", ""), r"([^/]*)$", 1)
    base = F.when(base.isin(".", ".."), F.when(base == "..", "..").otherwise("")).otherwise(base)
    plain = F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(strip(plain), "[. ]+$", ""), F.lit("")), F.lit(default))


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def suffix(name: Column) -> Column:
    """The last suffix of a file name in lower case, or an empty string."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / (1024 * 1024)))


def shown_time(text: Column, pattern: str = "yyyy/M/d HH:mm:ss") -> Column:
    """A timestamp for display; text that is none is echoed."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), pattern), text)


def preview(contents: Column, most: int = 4000) -> Column:
    """The trimmed, non-empty chunks with blank lines between them, cut at ``most`` UTF-16 units."""
    text = F.array_join(F.filter(F.transform(contents, strip), lambda x: x != ""), "\n\n")
    return F.when(utf16_length(text) > most, F.concat(utf16_prefix(text, most), F.lit("\n\n..."))).otherwise(text)


def letters(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA; under 1 counts as 1."""
    first = F.greatest(n, F.lit(1)).cast("long")
    state = F.struct(first.alias("left"), F.lit("").alias("text"))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(14)), state, lambda s, _: F.struct(F.when(s["left"] > 0, F.floor((s["left"] - 1) / 26)).otherwise(F.lit(0).cast("long")).alias("left"), F.when(s["left"] > 0, F.concat(F.chr(65 + (s["left"] - 1) % 26), s["text"])).otherwise(s["text"]).alias("text")))
    return steps["text"]


# Roman numerals of each decimal place.
ROMAN = (("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def roman(n: Column) -> Column:
    """Roman numerals, thousands as repeated M; under 1 counts as 1."""
    n = F.greatest(n, F.lit(1)).cast("int")
    place = lambda row, unit: F.get(F.array(*map(F.lit, row)), F.floor(n / unit).cast("int") % 10)
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(ROMAN[0], 100), place(ROMAN[1], 10), place(ROMAN[2], 1))


def list_number(n: Column, kind: Column) -> Column:
    """A counter in the number format ``kind`` of a word processor; unknown formats are decimal."""
    kind = F.lower(strip(kind))
    return F.when(kind == "upperletter", letters(n)).when(kind == "lowerletter", F.lower(letters(n))).when(kind == "upperroman", roman(n)).when(kind == "lowerroman", F.lower(roman(n))).otherwise(n.cast("string"))


def int_or(x: Column, default: int | None = None) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default).cast("int"))
