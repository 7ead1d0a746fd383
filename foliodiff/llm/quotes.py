"""Quotation linking: nested quote levels parsed, quoted passages joined to their originals, conversations in reply order.

A line that starts with one or more `>` is quoted; their number is its level. Neighbouring lines of one level form a
passage. An attribution line ("... wrote:") right before a passage goes with it. What is left is the message's own body.

A passage is looked up as a whole and line by line: texts are lower-cased, white space collapses, and the SHA-256 of the
result is joined to the bodies and lines that messages of the same conversation wrote themselves. The original is the
first message of the conversation that wrote the text, and must come before the message that quotes it. A passage goes
to the message that wrote most of its characters, the latest such message on a tie. The reply's parent is the original of
its outermost linked level, the latest on a tie. A message without a linked quotation starts a thread.

Scale: originals are reduced to one row a (conversation, hash) by a pre-aggregated minimum, so that the join to quoted
passages is many-to-one whatever is popular, and adaptive execution can split it. Thread starts are found by pointer
doubling, log2(longest chain) joins of the link table alone; each round is checkpointed. No conversation is gathered in
one task: reply order is given as columns (thread_turn, depth, turn) to sort by, parents always before replies.

Built-in expressions only. Null texts are empty messages; rows with a null conversation or turn are kept, never linked.
Rows that repeat a (conversation, turn) keep one row each and share the parent, which is the latest of theirs. Other
columns of the input are not read; clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Endings of an attribution line in four languages.
ATTRIBUTION = r"(?i)(wrote|schrieb|a écrit|escribió)\s*:\s*$"
QUOTE = r"^[ \t]*>[> \t]*"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def key_of(text: Column) -> Column:
    return F.sha2(normal(text), 256)


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, passages array<struct<level, lines>>) for each message."""
    lines = F.transform(
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\r?\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, QUOTE, "").alias("line"),
        ),
    )
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), lines.alias("_lines"))
    return rows.select("conv_id", "turn", "role", _body(F.col("_lines")).alias("body"), _passages(F.col("_lines")).alias("passages"))


def _body(lines: Column) -> Column:
    own = F.filter(
        lines,
        lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)),
    )
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def _passages(lines: Column) -> Column:
    starts = F.filter(
        F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != x["level"]), i)),
        lambda i: i.isNotNull(),
    )
    runs = F.transform(
        F.array(starts),
        lambda s: F.transform(
            s,
            lambda i, k: F.struct(
                F.get(lines, i)["level"].alias("level"),
                F.transform(F.slice(lines, i + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - i), lambda x: x["line"]).alias("lines"),
            ),
        ),
    )[0]
    return F.filter(runs, lambda p: (p["level"] > 0) & F.exists(p["lines"], lambda x: F.length(normal(x)) > 0))


def _units(whole: Column, lines: Column) -> Column:
    """Normalised texts by which a passage or body is known: the whole, and each line, blank ones apart."""
    return F.filter(F.array_distinct(F.concat(F.array(normal(whole)), F.transform(lines, normal))), lambda x: F.length(x) > 0)


def link(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, original): a row for each passage of each distinct message; original may be null."""
    known = parsed.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    originals = (
        known.select("conv_id", "turn", F.explode(_units(F.col("body"), F.split("body", "\n"))).alias("unit"))
        .groupBy("conv_id", F.sha2("unit", 256).alias("key"))
        .agg(F.min("turn").alias("original"))
    )
    quoted = known.select("conv_id", "turn", F.posexplode("passages").alias("passage", "p")).select(
        "conv_id", "turn", "passage", F.sha2(F.array_join("p.lines", "\n"), 256).alias("digest"), "p.level", "p.lines"
    )
    units = quoted.select(
        "conv_id", "turn", "passage", "digest", "level", F.explode(_units(F.array_join("lines", "\n"), F.col("lines"))).alias("unit")
    ).withColumns({"key": F.sha2("unit", 256), "weight": F.length("unit")})
    found = units.join(originals, ["conv_id", "key"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    passage = ["conv_id", "turn", "passage", "digest", "level"]
    weighed = found.groupBy(*passage, "original").agg(F.sum("weight").alias("weight"))
    best = F.max(F.when(F.col("original").isNotNull(), F.struct("weight", "original")))["original"]
    return weighed.groupBy(*passage).agg(best.alias("original")).drop("digest")


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, thread_turn, depth) of every message that replies."""
    best = F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("near"), "original")))["original"]
    parents = durable(links.groupBy("conv_id", "turn").agg(best.alias("parent_turn")).filter(F.col("parent_turn").isNotNull()))
    at = parents.withColumns({"up": F.col("parent_turn"), "depth": F.lit(1).cast("long")})
    while True:
        step = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = durable(at.join(step, ["conv_id", "up"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("open")))
        at = moved.drop("open")
        if moved.filter("open").isEmpty():
            return at.withColumnRenamed("up", "thread_turn")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message without its quotations, with parent_turn, thread_turn, depth, n_quotes, n_linked and max_level.

    Sorted by (conv_id, thread_turn, depth, turn), threads follow one another and each reply follows what it answers.
    """
    parsed = parse(messages, conv, turn, role, text)
    links = durable(link(parsed))
    replies = threads(links)
    counted = links.groupBy("conv_id", "turn").agg(F.count("original").alias("n_linked"))
    found = replies.join(counted, ["conv_id", "turn"])
    return (
        parsed.join(found, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "body", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("passages").cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("max_level"),
        )
    )
