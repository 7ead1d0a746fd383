"""File names, versions and folder hierarchy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds that can be compared, and words that mark a version at the end of a name.
KINDS = ("docx", "rtf", "xlsx", "xls", "csv", "pdf")
VERSION_WORDS = ("final", "draft", "rev", "approved", "released", "original", "updated", "new", "old", "copy", "backup", "wip", "tmp", "temp", "clean")


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot, empty without one."""
    return F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def is_version_token(t: Column) -> Column:
    low = F.lower(t)
    return low.rlike("^[0-9]+$") | low.rlike("^v?[0-9]+(\\.[0-9]+)*$") | low.rlike("^rev ?[0-9]*$") | low.isin(*VERSION_WORDS)


def split_version(name: Column) -> Column:
    """struct<stem, version>: the trailing version tokens of the base name, and what stands before them."""
    base = F.regexp_replace(name, "\\.[^.]+$", "")
    parts = F.filter(F.split(base, "[-_ \t\n.]+"), lambda t: t != "")

    def cut(p: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(acc: Column, t: Column) -> Column:
            on = acc["open"] & is_version_token(t)
            return F.struct((acc["n"] + on.cast("int")).alias("n"), on.alias("open"))

        n = F.aggregate(F.reverse(p), none, step, lambda acc: acc["n"])
        return F.struct(F.slice(p, F.lit(1), F.size(p) - n).alias("stem"), F.slice(p, F.size(p) - n + 1, n).alias("version"))

    found = F.transform(F.array(parts), cut)
    # nothing but version tokens: the base name is the stem
    named = F.transform(found, lambda x: F.struct(F.when(F.size(x["stem"]) > 0, F.array_join(x["stem"], "_")).otherwise(base).alias("stem"), F.array_join(x["version"], "_").alias("version")))
    return named[0]


def natural_key(x: Column) -> Column:
    """array<struct<text, number>>: orders text as text and runs of digits as numbers, shorter names first."""
    chunks = F.filter(F.regexp_extract_all(x, F.lit("([^0-9]*)([0-9]*)"), F.lit(0)), lambda t: t != "")
    return F.transform(chunks, lambda t: F.struct(F.regexp_extract(t, "^[^0-9]*", 0).alias("text"), F.regexp_extract(t, "[0-9]*$", 0).try_cast("decimal(38,0)").alias("number")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def hierarchy(path: Column, level: int) -> Column:
    """struct<account, package_name, category>: the folder at the 1-based level, the next, and the one after."""
    at = [F.coalesce(F.get(segments(path), F.lit(level - 1 + k)), F.lit("")) for k in range(3)]
    root = lambda x: F.when(x == "", "(root)").otherwise(x)
    return F.struct(root(at[0]).alias("account"), root(at[1]).alias("package_name"), at[2].alias("category"))
