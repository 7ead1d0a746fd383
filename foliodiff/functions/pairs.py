"""Named values stated in a line of text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\r\f\x0b"
#: How a line may state a field.
COLON = "^([A-Za-z][A-Za-z0-9 _/().\\-&'*]+?)[ \t]*:[ \t]*(.+)$"
EQUALS = "^([A-Za-z][A-Za-z0-9 _/().\\-&'*]+?)[ \t]*=[ \t]*(.+)$"
GAP = "^([A-Za-z][A-Za-z ]{0,29}?)[ \t]{2,}(.+)$"
NUMBER = "^([A-Za-z]{3,30})[ \t]([ \t]*[0-9][0-9,.:/-]*)$"
FIELD_LINE = "^([A-Za-z][A-Za-z0-9 _/().'&-]*?)[ \t]*[:=][ \t]*(.+)$"
KEY_VALUE = "^([A-Za-z][A-Za-z0-9 _/().\\-&'*]+)[ \t]*[:=][ \t]*(.+)$"
SHORT_WORDS = "^[A-Za-z][A-Za-z ]{0,4}$"
LABEL = "^[A-Za-z][A-Za-z ]{1,29}$"
COLUMN_NAME = "^[A-Za-z][A-Za-z ]{0,9}$"
#: Stands between field and value while a segment is cut; no segment that states a field begins with it.
MARK = "\x01"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def pair(field: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), value.alias("value"))


def cells_of(line: Column) -> Column:
    """All cells of a line with pipes, empty ones too."""
    return F.transform(F.split(line, "\\|"), trim)


def _with(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once, however often then names it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def segment_pair(segment: Column) -> Column:
    """struct<field, value> of one trimmed segment: `Field: v`, `Field = v`, `Field   v`, `Field 12`; else null.

    A value with a pipe after a colon is none. Two short words with a gap are column names, not a field. Each notation is one
    pass, made only where those before it found nothing: a segment that has it becomes field and value with MARK between them, any other stays as it is.
    """

    def stated(form: str, needed: Column) -> Column:
        # what a notation cannot do without is looked for first: most segments have none of it
        halves = F.when(needed, F.split(F.regexp_replace(segment, form, f"{MARK}$1{MARK}$2"), MARK, 3))
        is_stated = lambda x: (F.size(x) == 3) & (F.get(x, F.lit(0)) == "") & ~segment.startswith(MARK)
        return _with(halves, lambda x: F.when(is_stated(x), pair(trim(F.get(x, F.lit(1))), trim(F.get(x, F.lit(2))))))

    wide = segment.contains("  ") | segment.contains("\t")
    no_names = lambda g: F.when(~(g["field"].rlike(SHORT_WORDS) & g["value"].rlike(SHORT_WORDS)), g)
    others = F.coalesce(stated(EQUALS, segment.contains("=")), _with(stated(GAP, wide), no_names), stated(NUMBER, wide | segment.contains(" ")))
    return _with(stated(COLON, segment.contains(":")), lambda c: F.when(c.isNotNull(), F.when(~c["value"].contains("|"), c)).otherwise(others))


def with_pairs(lines: DataFrame, line: Column, name: str) -> DataFrame:
    """Adds array<struct<field, value>> of all fields that a line states; tabs count as pipes.

    With pipes each part may state one. A first part with a colon comes first, with the next part as its value if it has none
    itself, and is met again among the parts; if it states nothing, neither does the line. If no part states a field, a first
    part like a label names the second. Two short words are column names and state nothing. Steps are columns of their own,
    so that each is computed once.
    """
    steps = lines.withColumn("_text", F.replace(trim(line), F.lit("\t"), F.lit(" | ")))
    steps = steps.withColumn("_parts", F.when(F.col("_text").contains("|"), F.filter(cells_of(F.col("_text")), lambda p: p != "")).otherwise(F.filter(F.array("_text"), lambda p: p != "")))
    # several parts are looked at one by one, any other text as a whole, and its only part where pipes stand around it
    several, whole = F.size("_parts") >= 2, F.array("_text")
    asked = F.when(several, F.col("_parts")).when(F.col("_text").contains("|"), F.concat(whole, "_parts")).otherwise(whole)
    steps = steps.withColumn("_all", F.transform(asked, segment_pair))
    steps = steps.withColumn("_alone", F.when(~several, F.get("_all", F.lit(0)))).withColumn("_each", F.when(several, F.col("_all")).otherwise(F.slice("_all", F.lit(2), F.size("_parts"))))
    parts, own = F.col("_parts"), F.get("_each", F.lit(0))
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    each = F.filter("_each", lambda p: p.isNotNull())
    bare = trim(F.left(first, F.length(first) - 1))
    with_colon = F.when(own.isNotNull(), F.concat(F.array(own), each)).when(first.endswith(":") & (bare != ""), F.concat(F.array(pair(bare, second)), each))
    without = F.when(F.size(each) > 0, each).when(first.rlike(LABEL), F.array(pair(first, second)))
    names = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(COLUMN_NAME))
    single = F.when(F.col("_text").contains("|") & (F.size(parts) == 1), F.coalesce(own, F.col("_alone"))).otherwise(F.col("_alone"))
    found = F.when((F.size(parts) >= 2) & ~names, F.when(first.contains(":"), with_colon).otherwise(without)).when(single.isNotNull(), F.array(single))
    return steps.withColumn(name, F.coalesce(found, F.slice(each, 1, 0))).drop("_text", "_parts", "_all", "_each", "_alone")
