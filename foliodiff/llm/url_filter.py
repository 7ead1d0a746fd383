"""URL filter: host-and-path rules, and for the rest a ratio of two character language models.

Two variable-order Markov models over characters, one of accepted and one of rejected URLs, are counted from the URLs
that the rules decide: there the verdict is known, and the models carry it over to URLs that no rule meets. A character's
probability backs off over contexts of two, one and no characters by Witten-Bell smoothing, so that a context counts as
much as it was seen. A URL's score is the mean over its characters of the difference of the log-probabilities. A quarter
of the decided URLs, by a hash of host and path, are kept from counting; the threshold is calibrated on these by the means
and deviations of their classes. If a class has none of them, the threshold is 0, where both models are equally likely.

Characters fold to an alphabet of 40 symbols, so a model is a table of 40^3 numbers whatever the input: it is built by
one aggregation on Spark, stored, read by the driver at that fixed size, and folded into the scoring expression as one array
literal (higher-order functions take no subqueries). Pages are scanned three times: to count, to calibrate, to judge.

The models learn from and score host and path only, as the SQL does. Query and fragment (from `?` or `#` on) are left out, so
a URL that no rule meets and whose bad part lies there is judged by the rest of it.

A null URL, or one without `://`, has an empty host and path, and is judged as an empty text, whose score is 0. If one
class has no URL to count, everything is allowed that no rule blocks. An empty table gives an empty table. Long URLs are
counted and scored whole. Repeated rows count each, and give repeated results. Columns of the input named host, path, rule,
score or verdict are replaced by the result; all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, unused

#: The symbols that stay apart; symbol 0 is every other character, and pads the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-"
N = len(ALPHABET) + 1
#: Rules of the production run: (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules is configuration, compiled into one expression."""
    rule = verdict = None
    for rule_host, prefix, said in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        rule = F.when(fits, rule_host + prefix) if rule is None else rule.when(fits, rule_host + prefix)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _codes(text: Column) -> Column:
    """Symbol numbers of a text, two paddings first."""
    chars = F.filter(F.split(ascii_lower(text), ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0), F.lit(0)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) % N))


def _grams(codes: Column) -> Column:
    """For each character, the table index of (two characters before, character)."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: i >= 2),
        lambda i: (F.get(codes, i - 2) * N + F.get(codes, i - 1)) * N + F.get(codes, i),
    )


def grams_of(text: Column) -> Column:
    return F.transform(F.array(_codes(F.coalesce(text, F.lit("")))), _grams)[0]


def _smoothed(counts: DataFrame, n: str) -> DataFrame:
    """(idx, p): Witten-Bell probabilities for each of the N^3 indexes, from (idx, n). All tables here have at most N^3 rows."""
    spark = counts.sparkSession
    grid = spark.range(N**3).select(F.col("id").alias("idx"))
    full = grid.join(counts.select("idx", F.col(n).alias("n")), "idx", "left").na.fill(0, ["n"])
    full = full.withColumns({"c": F.col("idx") % N, "h1": (F.col("idx") / N).cast("long") % N, "h2": (F.col("idx") / (N * N)).cast("long")})
    by_char = full.groupBy("c").agg(F.sum("n").alias("n0"))
    total = by_char.agg(F.sum("n0").alias("t0"), F.sum((F.col("n0") > 0).cast("long")).alias("u0"))
    total = total.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N - 1).cast("long"))).alias("c"))
    zero = by_char.join(total, "c").select("c", ((F.col("n0") + F.col("u0") / N + 1 / N) / (F.col("t0") + F.col("u0") + 1)).alias("p0"))
    pair = full.groupBy("h1", "c").agg(F.sum("n").alias("n1"))
    pair_total = pair.groupBy("h1").agg(F.sum("n1").alias("t1"), F.sum((F.col("n1") > 0).cast("long")).alias("u1"))
    one = pair.join(pair_total, "h1").join(zero, "c").select("h1", "c", ((F.col("n1") + (F.col("u1") + 1) * F.col("p0")) / (F.col("t1") + F.col("u1") + 1)).alias("p1"))
    context = full.groupBy("h2", "h1").agg(F.sum("n").alias("t2"), F.sum((F.col("n") > 0).cast("long")).alias("u2"))
    return (
        full.join(context, ["h2", "h1"])
        .join(one, ["h1", "c"])
        .select("idx", ((F.col("n") + (F.col("u2") + 1) * F.col("p1")) / (F.col("t2") + F.col("u2") + 1)).alias("p"))
    )


def fit(labelled: DataFrame, text: str = "text", accepted: str = "accepted") -> DataFrame:
    """One row: table array<double> of N^3 log-probability differences, accepted minus rejected. Counts cover all rows."""
    counts = stored(
        labelled.filter(F.col(accepted).isNotNull())
        .select(F.col(accepted).alias("ok"), F.explode(grams_of(F.col(text))).alias("at"))
        .withColumn("idx", F.col("at").cast("long"))
        .groupBy("idx")
        .agg(F.sum(F.col("ok").cast("long")).alias("yes"), F.sum((~F.col("ok")).cast("long")).alias("no"))
    )
    yes, no = _smoothed(counts, "yes").withColumnRenamed("p", "a"), _smoothed(counts, "no").withColumnRenamed("p", "r")
    cells = yes.join(no, "idx").select("idx", F.log(F.col("a") / F.col("r")).alias("d"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "d"))), lambda x: x["d"]).alias("table"))


def literal(model: DataFrame) -> Column:
    """The table of fit() as a constant; N^3 numbers, whatever the input. The optimizer folds the split and the cast."""
    values = model.head()["table"]
    return F.split(F.lit(",".join(f"{x:.6f}" for x in values)), ",").cast("array<double>")


def score(text: Column, lookup: Column) -> Column:
    """Length-normalised difference of log-likelihoods; 0 for an empty text."""
    total = F.aggregate(grams_of(text), F.lit(0.0), lambda acc, i: acc + F.get(lookup, i))
    return total / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1))


def calibrate(scored: DataFrame, value: str, accepted: str, counted: str) -> DataFrame:
    """One row: threshold, as many deviations above the rejected mean as below the accepted mean, over the rows not counted.

    0 if those lack a class, null if the counted rows do.
    """

    def of(yes: bool, f) -> Column:
        return f(F.when(~F.col(counted) & (F.col(accepted) == yes), F.round(value, 9)))

    a, r = of(True, F.avg), of(False, F.avg)
    sa, sr = of(True, F.stddev_pop), of(False, F.stddev_pop)
    between = F.coalesce(F.try_divide(a * sr + r * sa, sa + sr), (a + r) / 2, F.lit(0.0))
    both = F.count_if(F.col(counted) & F.col(accepted)) * F.count_if(F.col(counted) & ~F.col(accepted)) > 0
    return scored.agg(F.when(both, F.round(between, 6)).alias("threshold"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score and verdict."""
    (said,) = unused(pages, "said")
    u = F.col(f"`{url}`")
    text = F.concat("host", "path")
    parts = pages.withColumns({"host": host_of(u), "path": path_of(u)})
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, said: decided})
    labelled = parts.filter(F.col(said).isNotNull()).select(text.alias("text"), (F.col(said) == "allow").alias("accepted"), (F.substring(F.md5(text), 1, 1) > "3").alias("counted"))
    lookup = literal(fit(labelled.filter("counted")))
    scored = labelled.select("accepted", "counted", score(F.col("text"), lookup).alias("value"))
    threshold = calibrate(scored, "value", "accepted", "counted")
    judged = parts.withColumn("score", F.round(score(text, lookup), 9))
    method = F.when(F.col("score") < F.coalesce(threshold.scalar(), F.lit(float("-inf"))), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(said, method)).drop(said)
