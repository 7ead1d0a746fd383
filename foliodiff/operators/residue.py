"""Rows that keys left unmatched: values, and prose against fields, one-to-one in document order.

Each phase is a test of a baseline row against a version row; in its order a row takes the first partner that passes and is still free. Done one
after the other, that is: go through all pairs that pass some phase, by (phase, first row, second row), and take every pair whose two rows are free.

Pairs that can pass are found by one equi-join on marks: a field leaves the first letters of its key, its value, the end of its value; prose leaves what
could meet them (those of its short substrings that start a key, itself, its ends). The tests then decide. The order is kept without a loop over rows: in a round, every
pair is taken that comes before all other open pairs of both its rows, which is what the one-by-one way takes first at these rows. Rows that are taken close
their other pairs, and rounds go on until no pair is open; a few do, as chains of rows that want the same partners are short.

Equal values would make a pair for every two rows that share one. Where all rows on one side are no fields (fields do not match fields by value), the k-th simply takes
the k-th, by rank; only values that both sides hold in fields and elsewhere become pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.durable import shuffled, spread, written
from foliodiff.functions.text import equality_key, normalize_key, normalize_text

FIELD, PROSE = ("field_value", "heading"), ("paragraph", "list_item")
#: Texts longer than this are no single statement.
LONGEST = 120
#: Phases by rank, and whether their pairs count as identical. Parts and whole texts share a rank: texts take turns in document order.
PHASES = (
    (0, "value", True),
    (1, "prose_says_field", True),
    (1, "pipe_parts_say_fields", True),
    (2, "prose_is_label", False),
    (3, "field_said_by_prose", True),
    (4, "pipe_row_is_field", True),
    (5, "field_is_pipe_row", True),
    (6, "prose_ends_in_field", True),
    (7, "field_ends_prose", True),
)
#: Letters of keys and of ends of values that marks hold.
GRAM = 3
#: Starts of keys of one side of a pair that are listed beside each text; where there are more, texts leave all their short substrings.
MOST_STARTS = 256


def _sides(base: DataFrame, comp: DataFrame) -> DataFrame:
    """Both sides as one frame, with what the tests look at."""

    def shaped(side: DataFrame, name: str) -> DataFrame:
        value = F.coalesce("value", F.lit(""))
        return side.select(
            F.col("pair_id").alias("pair_id"), F.lit(name).alias("side"), F.col("idx").cast("int").alias("idx"), F.coalesce(F.col("kind").isin(*FIELD), F.lit(False)).alias("is_field"), F.coalesce(F.col("kind").isin(*PROSE), F.lit(False)).alias("is_prose"),
            normalize_key(F.coalesce("label", F.lit(""))).alias("key"), value.alias("value"), F.lower(normalize_text(value)).alias("low"), equality_key(value).alias("eq"),
        )

    return shaped(base, "base").unionByName(shaped(comp, "comp"))


def with_mates(sides: DataFrame) -> DataFrame:
    """Adds mate (of rows whose value class has no fields on one side), mixed (classes with fields and others on both sides) and meets: whether a field
    has free prose on the other side of its pair, or prose a free field. Other rows need leave no marks."""
    same = W.partitionBy("pair_id", "eq")
    own = W.partitionBy("pair_id", "eq", "side").orderBy("idx")
    n_fields = lambda side: F.sum(F.when((F.col("side") == side) & F.col("is_field"), 1).otherwise(0)).over(same)
    ranked = sides.withColumns({"_n": F.row_number().over(own), "mixed": (n_fields("base") > 0) & (n_fields("comp") > 0)})
    level = W.partitionBy("pair_id", "eq", "_n")
    other = F.when(F.col("side") == "base", F.max(F.when(F.col("side") == "comp", F.col("idx"))).over(level)).otherwise(F.max(F.when(F.col("side") == "base", F.col("idx"))).over(level))
    mated = ranked.withColumn("mate", F.when(~F.col("mixed"), other)).drop("_n")
    has = lambda side, what: F.max((F.col("side") == side) & F.col(what) & F.col("mate").isNull()).over(W.partitionBy("pair_id"))
    across = lambda what: F.when(F.col("side") == "base", has("comp", what)).otherwise(has("base", what))
    return mated.withColumn("meets", (F.col("is_field") & across("is_prose")) | (F.col("is_prose") & across("is_field")))


_by_rank = with_mates  # its name in older callers


def _maybe(when: Column, marks: Column) -> Column:
    return F.when(when, marks).otherwise(F.array().cast("array<string>"))


def _grams(x: Column) -> Column:
    """All substrings of 1 to GRAM letters."""

    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(x) - (n - 1))
        return _maybe(F.length(x) >= n, F.transform(starts, lambda i: F.substr(x, i, F.lit(n))))

    each = [of_length(n) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*each))


def _marks(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(kind), x))


def _parts(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "\\|"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b"))), lambda p: p != "")


def _piped(value: Column) -> Column:
    """Key and value that the first two parts of a row with pipes state, as one string; null for other rows."""
    parts = _parts(value)
    stated = F.concat(normalize_key(F.get(parts, F.lit(0))), F.lit("\n"), equality_key(F.get(parts, F.lit(1))))
    return F.when(value.contains("|") & ~value.contains(":") & (F.size(parts) >= 2), stated)


def _label(value: Column) -> Column:
    return F.when(value.rlike("[A-Za-z]:\\s*$"), normalize_key(value))


def _field_marks() -> Column:
    key, low = F.col("key"), F.col("low")
    return F.concat(
        _maybe(key != "", F.array(F.concat(F.lit("k"), F.left(key, F.lit(GRAM))), F.concat(F.lit("q"), key))),
        _maybe(low != "", F.array(F.concat(F.lit("e"), F.right(low, F.lit(GRAM))))),
        F.array(F.concat(F.lit("v"), low), F.concat(F.lit("l"), key), F.concat(F.lit("p"), key, F.lit("\n"), F.col("eq"))),
    )


def _starts_in(x: Column) -> Column:
    """Of the starts of keys that a pair's fields have, those that x holds; all short substrings of x where they were too many to list."""
    return F.when(F.col("starts").isNull(), _grams(x)).otherwise(F.filter("starts", lambda s: x.contains(s)))


def _prose_marks() -> Column:
    """Array of (part, mark); part 0 is the whole text."""
    value, low = F.col("value"), F.col("low")
    has_pipe = value.contains("|")
    plain = ~has_pipe & ~value.contains(":")
    ends = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.right(low, n))
    whole = F.concat(
        _maybe(~has_pipe & (F.length(low) <= LONGEST), F.concat(_marks("k", _starts_in(low)), F.array(F.concat(F.lit("v"), low)))),
        _maybe(plain, F.array_distinct(F.concat(_marks("e", ends), F.array(F.concat(F.lit("q"), low), F.concat(F.lit("v"), low))))),
        F.filter(F.array(F.concat(F.lit("l"), _label(value)), F.concat(F.lit("p"), _piped(value))), lambda m: m.isNotNull()),
    )
    of_part = lambda p, i: F.transform(F.concat(_marks("k", _starts_in(p)), F.array(F.concat(F.lit("v"), p))), lambda m: F.struct((i + 1).alias("part"), m.alias("mark")))
    parts = F.when(has_pipe & (F.col("side") == "base"), F.flatten(F.transform(_parts(low), of_part))).otherwise(F.array().cast("array<struct<part:int,mark:string>>"))
    return F.concat(F.transform(whole, lambda m: F.struct(F.lit(0).alias("part"), m.alias("mark"))), parts)


def _met(free: DataFrame) -> DataFrame:
    """(pair_id, side, mark, prose_idx, part): marks of free prose, by the side of the fields that it may meet.

    Prose lists starts of keys that these fields have, not all that it could meet: a text has many short substrings, and few of them start a key.
    """
    fields = free.filter("is_field AND meets").select("pair_id", "side", F.when(F.col("key") != "", F.left("key", F.lit(GRAM))).alias("start"))
    starts = fields.groupBy("pair_id", "side").agg(F.collect_set("start").alias("starts"))
    starts = starts.withColumn("starts", F.when(F.size("starts") <= MOST_STARTS, F.col("starts"))).select("pair_id", F.col("side").alias("across"), "starts")
    across = F.when(F.col("side") == "base", "comp").otherwise("base")
    # prose without a field on the other side meets nothing
    prose = free.filter("is_prose AND meets").withColumn("across", across).join(shuffled(starts), ["pair_id", "across"]).withColumn("m", F.explode(_prose_marks()))
    return prose.select("pair_id", F.col("across").alias("side"), F.col("idx").alias("prose_idx"), "m.part", "m.mark")


def _passes(field: str, prose: str) -> dict[str, Column]:
    """The tests of a field against prose (or, for parts, one part of it), by phase."""
    f, p = (lambda c: F.col(f"{field}.{c}")), (lambda c: F.col(f"{prose}.{c}"))
    from_prose, whole = p("side") == "base", F.col("part") == 0
    has_pipe = p("value").contains("|")
    plain = whole & ~has_pipe & ~p("value").contains(":")
    names = (f("key") != "") & p("low").contains(f("key"))
    said = whole & ~has_pipe & (F.length(p("low")) <= LONGEST) & ((p("low") == f("low")) | names)
    part = F.get(_parts(p("low")), F.col("part") - 1)
    claims = ~whole & ((part == f("low")) | ((f("low") != "") & (f("key") != "") & part.contains(f("low")) & part.contains(f("key"))))
    row = whole & (_piped(p("value")) == F.concat(f("key"), F.lit("\n"), f("eq")))
    is_key = (f("key") != "") & (p("low") == f("key"))
    ends = (f("low") != "") & p("low").endswith(f("low"))
    return {
        "prose_says_field": from_prose & said,
        "pipe_parts_say_fields": from_prose & claims,
        "prose_is_label": from_prose & whole & (_label(p("value")) == f("key")),
        "field_said_by_prose": ~from_prose & said,
        "pipe_row_is_field": from_prose & row,
        "field_is_pipe_row": ~from_prose & row,
        "prose_ends_in_field": from_prose & plain & (f("low") != "") & ((p("low") == f("low")) | (names & (ends | is_key))),
        "field_ends_prose": ~from_prose & plain & (ends | is_key),
    }


def _pairs(sides: DataFrame) -> DataFrame:
    """(pair_id, base_idx, part, comp_idx, rank, phase) of all pairs of free rows that pass a phase."""
    free = sides.filter("mate IS NULL")
    fields = free.filter("is_field AND meets").select("pair_id", "side", F.col("idx").alias("field_idx"), F.explode(_field_marks()).alias("mark"))
    met = fields.join(shuffled(_met(free)), ["pair_id", "side", "mark"]).select("pair_id", "side", "field_idx", "prose_idx", "part").distinct()
    told = F.struct("side", "key", "value", "low", "eq")
    f = free.filter("is_field AND meets").select("pair_id", "side", F.col("idx").alias("field_idx"), told.alias("f"))
    p = free.filter("is_prose AND meets").select("pair_id", F.when(F.col("side") == "base", "comp").otherwise("base").alias("side"), F.col("idx").alias("prose_idx"), told.alias("p"))
    both = met.join(shuffled(f), ["pair_id", "side", "field_idx"]).join(shuffled(p), ["pair_id", "side", "prose_idx"])
    tests = _passes("f", "p")
    passed = F.filter(F.array(*(F.when(tests[name], F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("phase"))) for rank, name, _ in PHASES if name in tests)), lambda x: x.isNotNull())
    base_idx, comp_idx = (F.when(F.col("side") == a, F.col("prose_idx")).otherwise(F.col("field_idx")) for a in ("comp", "base"))
    found = both.select("pair_id", base_idx.alias("base_idx"), "part", comp_idx.alias("comp_idx"), F.inline(passed))
    # The k-th row of a value finds a partner among the first k of either sort, as those before it take one each.
    numbered = free.filter("mixed").withColumns(
        {"nth": F.row_number().over(W.partitionBy("pair_id", "eq", "side", "is_field").orderBy("idx")), "at": F.row_number().over(W.partitionBy("pair_id", "eq", "side").orderBy("idx"))}
    )
    own = numbered.filter("side = 'base'").select("pair_id", "eq", "idx", "is_field", "at")
    other = numbered.filter("side = 'comp'").select("pair_id", "eq", F.col("idx").alias("comp_idx"), F.col("is_field").alias("_f"), F.col("nth").alias("_nth"))
    equal = own.join(shuffled(other), ["pair_id", "eq"]).filter("NOT (is_field AND _f) AND _nth <= at")
    return found.unionByName(equal.select("pair_id", F.col("idx").alias("base_idx"), F.lit(0).alias("part"), "comp_idx", F.lit(0).alias("rank"), F.lit("value").alias("phase")))


def _round(pairs: DataFrame) -> DataFrame:
    """Takes pairs that come first at both their rows (taken), and closes the pairs of rows that were taken. Parts of a text close only themselves."""
    by_base, by_part, by_comp = W.partitionBy("pair_id", "base_idx"), W.partitionBy("pair_id", "base_idx", "rank", "part"), W.partitionBy("pair_id", "comp_idx")
    open_ = F.when(F.col("open"), F.col("turn"))
    first = pairs.withColumns({"_rank": F.min(F.when(F.col("open"), F.col("rank"))).over(by_base), "_part": F.min(open_).over(by_part)}).withColumn("_comp", F.min(open_).over(by_comp))
    wins = F.col("open") & (F.col("rank") == F.col("_rank")) & (F.col("turn") == F.col("_part")) & (F.col("turn") == F.col("_comp"))
    won = first.withColumn("_wins", wins)
    told = won.withColumns({"_c": F.max("_wins").over(by_comp), "_b": F.max("_wins").over(by_base), "_p": F.max("_wins").over(by_part), "_r": F.max(F.when(F.col("_wins"), F.col("rank"))).over(by_base)})
    spared = (F.col("part") > 0) & (F.col("rank") == F.col("_r")) & ~F.col("_p")
    closed = F.col("_c") | (F.col("_b") & ~spared)
    return told.select("pair_id", "base_idx", "part", "comp_idx", "rank", "phase", "turn", (F.col("taken") | F.col("_wins")).alias("taken"), (F.col("open") & ~closed).alias("open"))


def by_value(sides: DataFrame) -> DataFrame:
    """(pair_id, phase, base_idx, comp_idx, identical) of rows that have a mate by rank."""
    return sides.filter("side = 'base' AND mate IS NOT NULL").select("pair_id", F.lit("value").alias("phase"), F.col("idx").alias("base_idx"), F.col("mate").alias("comp_idx"), F.lit(True).alias("identical"))


def by_marks(sides: DataFrame) -> DataFrame:
    """(pair_id, phase, base_idx, comp_idx, identical) of rows that have none. Only rows that meet some, or are mixed, can be among them."""
    reverse = F.col("phase") == "field_said_by_prose"  # here the version's texts take turns
    turn = F.struct("rank", F.when(reverse, F.col("comp_idx")).otherwise(F.col("base_idx")).alias("a"), "part", F.when(reverse, F.col("base_idx")).otherwise(F.col("comp_idx")).alias("b"))
    open_ = _pairs(sides).withColumns({"turn": turn, "taken": F.lit(False), "open": F.lit(True)}).repartition("pair_id")
    found = None
    same = F.col("phase") != "prose_is_label"
    while True:
        after = written(_round(_round(open_)).filter("taken OR open"))
        taken = after.filter("taken").select("pair_id", "phase", "base_idx", "comp_idx", same.alias("identical"))
        found = taken if found is None else found.union(taken)
        open_ = after.filter("open")
        if open_.isEmpty():
            return found
        open_ = open_.repartition("pair_id")


def match_residue(base: DataFrame, comp: DataFrame) -> DataFrame:
    """(pair_id, phase, base_idx, comp_idx, identical) for unmatched rows (pair_id, idx, kind, label, value) of both sides.

    One-to-one but for baseline prose with pipes, whose parts may claim a field each. Null labels and values are empty ones; a field with an empty key is
    named by nothing; null kinds are neither fields nor prose, and match by value. idx is unique within a side; rows without a partner are left out; an
    empty side gives nothing. Other columns are left out. Rounds are written to the shared folder, so both inputs are read once.
    """
    sides = written(_by_rank(spread(_sides(base, comp), "pair_id")))
    return by_value(sides).union(by_marks(sides))
