"""Normalisation of labels and values as column expressions. Comparison works on strings alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters deleted, characters read as a space, and ASCII white space.
ZERO_WIDTH = "[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]"
WIDE_SPACE = "[\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
WHITE = " \t\n\r\f\x0b"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def normalize_text(x: Column) -> Column:
    """Zero-width characters deleted, exotic spaces and runs of blanks one space, line ends LF, at most one empty line, trimmed."""
    x = F.regexp_replace(x, ZERO_WIDTH, "")
    x = F.regexp_replace(x, WIDE_SPACE, " ")
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, "[ \t\f\\x0b]+", " ")
    return _trim(F.regexp_replace(x, "\n{3,}", "\n\n"))


def normalize_key(x: Column) -> Column:
    """Lower-cased a-z and 0-9, everything between as one space."""
    return F.trim(F.regexp_replace(F.lower(_trim(x)), "[^a-z0-9]+", " "))


def normalize_value(x: Column, mode: str = "intelligent") -> Column:
    return x if mode == "exact" else normalize_text(x)


def equality_key(x: Column, mode: str = "intelligent") -> Column:
    """Two values are equal if these are: pipes as spaces, white space collapsed, case ignored; in either mode."""
    loose = F.regexp_replace(normalize_value(x, mode), "\\|", " ")
    return F.trim(F.regexp_replace(F.lower(loose), "[ \t\n\r\f\\x0b]+", " "))


def aggressive(x: Column) -> Column:
    """Lower-cased, separators as spaces, collapsed."""
    return F.trim(F.regexp_replace(F.lower(x), "[|;,\\-_:=/\\\\ \t\n\r\f\\x0b]+", " "))


def tokens(x: Column) -> Column:
    """Sorted tokens, duplicates kept."""
    return F.array_sort(F.filter(F.split(aggressive(x), " "), lambda t: t != ""))


def is_numeric(x: Column) -> Column:
    return _trim(x).rlike("^[-+]?[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?$")


def humanize(x: Column) -> Column:
    """camelCase and snake-case to words with upper-case initials; other letters keep their case."""
    spaced = F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    runs = F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return _trim(F.array_join(F.transform(runs, lambda p: F.concat(F.translate(F.substr(p, F.lit(1), F.lit(1)), LOWER, LOWER.upper()), F.substr(p, F.lit(2)))), ""))


def one_line(x: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(x, "[ \t\n\r\f\\x0b]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def escape_html(x: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def normalize_for_hash(x: Column) -> Column:
    return F.regexp_replace(F.lower(_trim(x)), "[ \t\n\r\f\\x0b]+", " ")


def hash_of(kind: str, x: Column) -> Column:
    """SHA-256 of a normalised value, marked with what it is."""
    return F.sha2(F.concat(F.lit(f"{kind}|"), normalize_for_hash(x)), 256)


def joined(*parts: Column) -> Column:
    """Parts joined by `|`; null parts are empty."""
    return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "|")


def short_fingerprint(x: Column, head: int = 8, tail: int = 4) -> Column:
    return F.when(F.length(x) > head + tail, F.concat(F.left(x, F.lit(head)), F.lit("…"), F.right(x, F.lit(tail)))).otherwise(x)


def column_letters(c: Column) -> Column:
    """Spreadsheet column of a 0-based index, up to ZZZ."""
    one = F.char(65 + c % 26)
    two = F.concat(F.char(64 + F.floor(c / 26)), one)
    three = F.concat(F.char(65 + F.floor((c - 702) / 676)), F.char(65 + F.floor((c - 702) / 26) % 26), one)
    return F.when(c < 26, one).when(c < 702, two).otherwise(three)


def cell_address(r: Column, c: Column) -> Column:
    return F.concat(column_letters(c), (r + 1).cast("string"))


def column_index(letters: Column) -> Column:
    """The 0-based index of spreadsheet column letters."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def word_diff(a: Column, b: Column) -> Column:
    """array<struct<value, added, removed>>: the i-th word or blank run of a against the i-th of b."""
    pattern = F.lit("[^ \t\n\r\f\\x0b]+|[ \t\n\r\f\\x0b]+")
    left, right = F.regexp_extract_all(a, pattern, F.lit(0)), F.regexp_extract_all(b, pattern, F.lit(0))

    def seg(value: Column, added: bool, removed: bool) -> Column:
        return F.struct(value.alias("value"), F.lit(added).alias("added"), F.lit(removed).alias("removed"))

    def pair(x: Column, y: Column) -> Column:
        gone = F.when(x.isNotNull(), F.array(seg(x, False, True))).otherwise(F.slice(F.array(seg(F.lit(""), False, True)), 1, 0))
        new = F.when(y.isNotNull(), F.array(seg(y, True, False))).otherwise(F.slice(F.array(seg(F.lit(""), True, False)), 1, 0))
        return F.when(x == y, F.array(seg(x, False, False))).otherwise(F.concat(gone, new))

    return F.flatten(F.zip_with(left, right, pair))


def stamp(time: Column) -> Column:
    """A time as part of a file name, to the second: 2024-05-06-07-08-09. Years have four digits, or all of theirs without a plus sign; before year 0 a minus sign."""
    year = F.year(time).cast("string")
    return F.concat(F.when(F.year(time).between(0, 9999), F.lpad(year, 4, "0")).otherwise(year), F.date_format(time, "-MM-dd-HH-mm-ss"))
