"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every document is judged on its own in a single scan: no shuffle, no Python, whole texts. Words are maximal runs of
characters other than ASCII white space. Repeated five-word windows are found inside a document by hashing each window
to 64 bits; only a document that has two equal hashes pays for the sort that locates them.

Each row of the table has a measure, its bounds, and the least number of words that a text must have for the rule to be asked of it: the
production table asks for function words in texts of 100 words or more, and everything else of every text.

Null text counts as a text without words; texts of any length are judged whole. Empty tables give empty results, repeated rows give repeated results, and
columns of the input whose names are those of a result are replaced by the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from "
    "der die das und den von mit sich des nicht ein eine ist zu auf "
    "le la les de des et un une que qui pour dans en par sur "
    "el los las y del se con por para una al"
).split()
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves a side open. measure: SQL over the statistics below.

    min_words: the rule is asked of texts of that many words only; shorter ones pass it.
    """

    name: str
    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


#: The production table. Measures are numbers a document has once its statistics are known.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 10, None),
    Rule("word_length", "try_divide(word_chars, n_words)", 1.5, 15.0),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.3),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", 0.02, None, min_words=100),  # a short text may do without function words
    Rule("duplicate_lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
    Rule("repeated_words", "try_divide(n_repeat_words, n_words)", None, 0.2),
    Rule("upper_case", "try_divide(n_upper, word_chars)", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda variables are bound, columns used twice may be inlined twice."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words that lie in a five-word window which occurs at least twice in words."""

    def located(grams: Column) -> Column:
        indexed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            size = F.size(s)
            twin = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | ((j < size - 1) & (F.get(s, j + 1)["h"] == x["h"])))
            starts = F.array_sort(F.transform(twin, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
                lambda acc: acc["n"],
            )

        return _let(indexed, covered)

    def counted(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        found = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(located(g)))
        return F.when(n <= WINDOW, F.lit(0)).otherwise(found)

    return _let(words, counted)


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text, each a native expression."""
    whole = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    packed = F.translate(whole, " \t\n\x0b\f\r", "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(packed).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated(words).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*stops))).cast("long"),
        "n_upper": (F.length(packed) - F.length(F.translate(packed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def compile_rules(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(all rules passed, names of the failed rules) over columns named as the statistics. A measure without value fails no rule."""
    failed = []
    for r in rules:
        value = F.expr(r.measure).cast("double")
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        failed.append(F.when((F.col("n_words") >= r.min_words) & F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with the statistics, base_failed, failed_rules and kept. A document that fails the base is never kept."""
    stats = statistics(F.col(f"`{text}`"))
    passed, names = compile_rules(rules)
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return (
        docs.withColumns(stats)
        .withColumns({"base_failed": base, "failed_rules": names})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
