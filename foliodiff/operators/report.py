"""The report on differences: severities, roll-ups by account, package and report, versions, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions import names
from foliodiff.functions.names import natural_key
from foliodiff.functions.text import humanize, one_line
from foliodiff.operators.grouping import default_baseline
from foliodiff.operators.numbering import numbered

#: Audit code and severity of each difference type.
TYPES = {
    "cell_changed": ("VALUE_MISMATCH", "Medium"),
    "text_changed": ("TEXT_MISMATCH", "Medium"),
    "header_changed": ("COLUMN_NAME_MISMATCH", "Medium"),
    "rows_added": ("ROW_COUNT_MISMATCH", "High"),
    "rows_removed": ("ROW_COUNT_MISMATCH", "High"),
    "cols_added": ("COLUMN_COUNT_MISMATCH", "High"),
    "cols_removed": ("COLUMN_COUNT_MISMATCH", "High"),
    "sheet_added": ("SHEET_MISMATCH", "High"),
    "sheet_removed": ("SHEET_MISMATCH", "High"),
    "sheet_renamed": ("SHEET_NAME_MISMATCH", "Low"),
    "missing_content": ("MISSING_CONTENT", "High"),
    "added_content": ("ADDED_CONTENT", "Medium"),
    "value_mismatch": ("VALUE_MISMATCH", "Medium"),
    "format_mismatch": ("FORMAT_MISMATCH", "Low"),
    "font_mismatch": ("FONT_MISMATCH", "Low"),
    "font_size_mismatch": ("FONT_SIZE_MISMATCH", "Low"),
    "image_added": ("IMAGE_ADDED", "Medium"),
    "image_removed": ("IMAGE_REMOVED", "High"),
    "image_count_mismatch": ("IMAGE_COUNT_MISMATCH", "Medium"),
    "number_format_mismatch": ("NUMBER_FORMAT_MISMATCH", "Low"),
    "date_format_mismatch": ("DATE_FORMAT_MISMATCH", "Low"),
    "currency_format_mismatch": ("CURRENCY_FORMAT_MISMATCH", "Low"),
    "exact_match": ("MATCH", "Low"),
}


def code_and_severity(kind: Column) -> tuple[Column, Column]:
    """Of a difference type; unknown types keep their name and are Medium."""
    code = severity = None
    for name, (c, s) in TYPES.items():
        code = F.when(kind == name, c) if code is None else code.when(kind == name, c)
        severity = F.when(kind == name, s) if severity is None else severity.when(kind == name, s)
    return code.otherwise(F.upper(kind)), severity.otherwise("Medium")


def issues(diffs: DataFrame) -> DataFrame:
    code, severity = code_and_severity(F.col("difference_type"))
    return diffs.withColumns({"code": code, "severity": severity, "status": F.when(F.col("ignored_scope").isNull(), "Reported").otherwise("Ignored")})


def issue_rollup(found: DataFrame) -> DataFrame:
    """Reported issues per report, package, account, and in all; absent levels are `(all)`."""
    reported = found.filter("status = 'Reported'")
    rolled = reported.rollup("account", "package_name", "report").agg(F.count("*").alias("n_issues"), F.sum((F.col("severity") == "High").cast("long")).alias("n_high"))
    return rolled.select(*(F.coalesce(c, F.lit("(all)")).alias(c) for c in ("account", "package_name", "report")), "n_issues", "n_high")


def type_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("difference_type", "status").agg(F.count("*").alias("n"))


def version_rows(each: DataFrame) -> DataFrame:
    """(dir, stem, version, file_name, role) of comparable versions (grouping.versions): V1.. in natural order; the baseline is the first version of the baseline's format."""
    based = each.filter("place IS NOT NULL").join(default_baseline(each), ["dir", "stem"])
    first = F.min(F.when(F.col("ext") == F.col("baseline"), F.col("place"))).over(W.partitionBy("dir", "stem"))
    role = F.when(F.col("place") == first, "Baseline").otherwise("Compared")
    return based.select("dir", "stem", F.concat(F.lit("V"), (F.col("place") + 1).cast("string")).alias("version"), "file_name", role.alias("role"))


def usual_version_count(groups: DataFrame) -> DataFrame:
    """(n_versions, n_groups): the most frequent number of comparable versions; of several, the one seen first by folder and name."""
    counts = groups.groupBy(F.col("n_comparable").alias("n_versions")).agg(F.count("*").alias("n_groups"), F.min(F.struct("dir", "stem")).alias("at"))
    return counts.orderBy(F.desc("n_groups"), "at").limit(1).select("n_versions", "n_groups")


def run_stats(docs: DataFrame, groups: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row: what a run saw and found. diffs has difference_type and status.

    Each group of two comparable versions or more counts as two comparisons; matches are comparisons beyond the differences, at least 0. types maps each
    difference type to its count. Every input is aggregated once, to a row or (types) one row a type.
    """
    files = docs.agg(F.count("*").alias("files"), F.count_if(~F.col("failed")).alias("parsed"), F.count_if("failed").alias("failed"), F.countDistinct("account").alias("accounts"))
    some = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n_comparable") >= 2).alias("comparable_groups"))
    by_type = diffs.groupBy("difference_type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Ignored").alias("ignored"))
    found = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("differences"), F.coalesce(F.sum("ignored"), F.lit(0)).alias("ignored"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("difference_type", "n")))).alias("types"))
    row = files.crossJoin(some).crossJoin(found)  # one row each
    comparisons = 2 * F.col("comparable_groups")
    return row.select("files", "parsed", "failed", "accounts", "groups", "comparable_groups", comparisons.alias("comparisons"), "differences", F.greatest(comparisons - F.col("differences"), F.lit(0)).alias("matches"), "ignored", "types")


def measured(df: DataFrame, metrics: Observation) -> DataFrame:
    """df, which counts itself as it is computed: metrics.get has rows (and differences, where there is a difference_type) once an action has run. No second pass."""
    counts = [F.count(F.lit(1)).alias("rows")]
    if "difference_type" in df.columns:
        counts.append(F.count_if(F.col("difference_type").isNotNull()).alias("differences"))
    return df.observe(metrics, *counts)


def rates(n_files: int, n_differences: int, seconds: float) -> dict[str, float]:
    """What a run took, from its own counts: total milliseconds, files and differences a second."""
    safe = max(seconds, 1e-9)
    return {"total_processing_ms": 1000 * seconds, "files_per_second": n_files / safe, "comparisons_per_second": n_differences / safe}


def error_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(account, package, category, report, file, error_type, error_message) of files with an error.

    docs are (path, error); groups (dir, account, package_name, category). A file stands where the nearest group folder at or above its own one stands, under the
    root if there is none. Each file looks up the folders of its own path, one join on equal folders, and takes the longest that is known.
    """
    bad = docs.filter("error IS NOT NULL").select("path", "error", names.folder(F.col("path")).alias("dir"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    places = groups.select(F.col("dir").alias("folder"), "account", "package_name", "category").groupBy("folder").agg(F.min(F.struct("account", "package_name", "category")).alias("at"))
    met = bad.select("path", F.explode(above).alias("folder")).join(places, "folder").groupBy("path").agg(F.max_by("at", F.length("folder")).alias("at"))
    told = bad.join(met, "path", "left")
    name = names.file_name(F.col("path"))
    return told.select(
        F.coalesce("at.account", F.lit(ROOT)).alias("account"), F.coalesce("at.package_name", F.lit(ROOT)).alias("package"), F.coalesce("at.category", F.lit("")).alias("category"),
        names.split_version(name)["stem"].alias("report"), name.alias("file"), F.lit("ParseError").alias("error_type"), F.when(F.col("error") == "", "Unknown error").otherwise(F.col("error")).alias("error_message"),
    )


def account_breakdown(groups: DataFrame) -> DataFrame:
    """(account, n_groups)."""
    return groups.groupBy("account").agg(F.count("*").alias("n_groups"))


def distinct_counts(places: DataFrame) -> DataFrame:
    """One row: accounts, packages (of an account each), and categories, distinct names over all accounts; empty names are none."""
    return places.agg(
        F.countDistinct("account").alias("accounts"), F.countDistinct("account", "package_name").alias("packages"), F.countDistinct(F.when(F.col("category") != "", F.col("category"))).alias("categories")
    )


def chain_rows(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each report (keys) and pair of formats that has differences: their number, and the pair's label.

    Formats are baseline_format and comparing_format. Pairs without differences have no row.
    """
    counted = diffs.groupBy(*keys, "baseline_format", "comparing_format").agg(F.count("*").alias("n_differences"))
    return counted.withColumns({"chain": F.concat_ws(" → ", "baseline_format", "comparing_format"), "result": F.lit("Differences Found")})


def issue_lists(found: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """The issues of each report in order: one row an issue, numbered within its report by difference id. A report with most of all issues is sorted, not gathered."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy("diff_id"))
    return found.select(*keys, number.alias("issue"), "diff_id", *wanted)


def visible_counts(found: DataFrame) -> DataFrame:
    """(report, n_all, n_ignored, n_visible)."""
    ignored = F.count_if(F.col("status") == "Ignored")
    return found.groupBy("report").agg(F.count("*").alias("n_all"), ignored.alias("n_ignored"), (F.count("*") - ignored).alias("n_visible"))


ROOT = "(root)"


def report_model(found: DataFrame, groups: DataFrame) -> DataFrame:
    """One row an issue, with its place in the hierarchy: found are issues with group_id and group_label, groups
    (group_id, account, package_name, category, stem), one row a group.

    An issue of an unknown group stands under the root and is named by its own label. Texts are one line each: 120
    characters of the baseline, 160 of the other version. One join by group, many issues to one group.
    """
    placed = found.join(groups.select("group_id", *(F.col(c).alias(f"_{c}") for c in ("account", "package_name", "category", "stem"))), "group_id", "left")
    return placed.select(
        F.coalesce("_account", F.lit(ROOT)).alias("account"), F.coalesce("_package_name", F.lit(ROOT)).alias("package_name"), F.coalesce("_category", F.lit("")).alias("category"),
        humanize(F.coalesce("_stem", "group_label")).alias("report_name"), "group_id", "diff_id", "location_label", "code", "severity", "status",
        one_line(F.col("reference_text"), 120).alias("baseline"), one_line(F.col("version_text"), 160).alias("different"), "description",
    )


def report_tree(found: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a report (group) with issues or without: its place, its issues, the issues of its package and account, and
    its position in each in natural order.

    A package without a name is the root one. all_matched: no issue of the report is reported. Issues of unknown groups have
    no report. Issues are counted by group before any other shuffle, so that only rows of groups are sorted.
    """
    counts = found.groupBy("group_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("status") == "Reported").alias("n_reported"))
    package = F.when(F.coalesce("package_name", F.lit("")) == "", ROOT).otherwise(F.col("package_name"))
    reports = groups.join(counts, "group_id", "left").na.fill(0, ["n_issues", "n_reported"]).select("group_id", "account", package.alias("package"), "category", humanize(F.col("stem")).alias("report_name"), "n_issues", "n_reported")
    packages = reports.groupBy("account", "package").agg(F.sum("n_issues").alias("package_issues"))
    accounts = packages.groupBy("account").agg(F.sum("package_issues").alias("account_issues"))
    at_account = numbered(accounts, natural_key(F.col("account")), "account").withColumnRenamed("number", "account_position")
    at_package = packages.withColumn("package_position", F.row_number().over(W.partitionBy("account").orderBy(natural_key(F.col("package")), "package")))
    position = F.row_number().over(W.partitionBy("account", "package").orderBy(natural_key(F.col("report_name")), "report_name", "group_id"))
    placed = reports.withColumn("report_position", position).join(at_package, ["account", "package"]).join(at_account, "account")
    return placed.withColumn("all_matched", F.col("n_reported") == 0)
