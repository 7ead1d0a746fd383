"""Queries of file names, groups and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.functions import names
from foliodiff.operators import grouping as g
from foliodiff.operators import report
from foliodiff.plans import workloads as w


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.documents(w.frame(spark, sf_dir, w.MANIFEST))


def scan_manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.frame(spark, sf_dir, w.MANIFEST).filter(names.extension(F.col("path")).isin(*names.KINDS)).select("doc_id", names.extension(F.col("path")).alias("ext"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, p = w.frame(spark, sf_dir, w.MANIFEST), F.col("path")
    return m.select("doc_id", names.folder(p).alias("dir"), names.file_name(p).alias("file_name"), F.concat_ws("::", p, F.col("size").cast("string")).alias("id"))


def split_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = names.split_version(names.file_name(F.col("path")))
    return w.frame(spark, sf_dir, w.MANIFEST).select("doc_id", s["stem"].alias("stem"), s["version"].alias("version_tag"))


def hierarchy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = names.hierarchy(names.folder(F.col("path")), 2)
    return w.frame(spark, sf_dir, w.MANIFEST).select("doc_id", h["account"].alias("account"), h["package_name"].alias("package_name"), h["category"].alias("category"))


def account_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.account_level(_docs(spark, sf_dir)).select(F.col("level").cast("int").alias("level"))


def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.level_histogram(_docs(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.versions(_docs(spark, sf_dir))


def group_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with the names of their files in order; only this report writes them into one text."""
    each = _versions(spark, sf_dir)
    files = F.array_join(F.array_sort(F.collect_list(F.struct("position", "file_name")))["file_name"], "|")
    listed = each.groupBy("dir", "stem").agg(files.alias("files"))
    return g.group_documents(each).join(listed, ["dir", "stem"]).select("dir", "stem", "n_docs", F.array_join("formats", ",").alias("formats"), "files")


def default_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.default_baseline(_versions(spark, sf_dir))


def comparison_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.comparison_chain(_versions(spark, sf_dir)).drop("baseline_path", "comparing_path")


def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison_chain(spark, sf_dir).groupBy("baseline_format", "comparing_format").agg(F.count("*").alias("n_pairs"))


def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.version_rows(_versions(spark, sf_dir))


def versions_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.usual_version_count(g.group_documents(_versions(spark, sf_dir)))


#: Differences of a run, by rules on the keys of documents.
_FOUND = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'value_mismatch' WHEN 1 THEN 'missing_content' ELSE 'added_content' END AS difference_type, CASE WHEN doc_id % 11 = 0 THEN 'Ignored' ELSE 'Reported' END AS status FROM {documents} WHERE doc_id % 5 = 0"


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("account", names.hierarchy(F.col("dir"), 1)["account"])
    found = report.run_stats(docs, g.group_documents(g.versions(docs)), w.frame(spark, sf_dir, _FOUND))
    return found.withColumn("types", F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


#: Files that could not be read, some in folders below those of groups and some in folders that no group has.
_ERRORS = "SELECT concat(CASE doc_id % 6 WHEN 0 THEN concat('stray_', CAST(doc_id % 4 AS STRING)) WHEN 1 THEN concat(substr(path, 1, length(path) - position('/' IN reverse(path))), '/deep/er') WHEN 2 THEN concat('client_', CAST(doc_id % 3 AS STRING)) ELSE substr(path, 1, length(path) - position('/' IN reverse(path))) END, '/', 'lost_file-v', CAST(doc_id AS STRING), '.docx') AS path, CASE doc_id % 4 WHEN 0 THEN '' ELSE concat('cannot read ', CAST(doc_id AS STRING)) END AS error FROM (" + w.MANIFEST + ") m WHERE failed OR doc_id % 6 < 3"


def report_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = _docs(spark, sf_dir).select("dir").distinct()
    place = names.hierarchy(F.col("dir"), 1)
    groups = dirs.select("dir", place["account"].alias("account"), place["package_name"].alias("package_name"), place["category"].alias("category"))
    return report.error_rows(w.frame(spark, sf_dir, _ERRORS), groups)


_M = w.oracle(w.MANIFEST)
_FILE = "string_split(path, '/')[-1]"
_EXT = "lower(regexp_extract(path, '\\.([^.]+)$', 1))"
_DIR = "regexp_replace(path, '/[^/]*$', '')"
_KINDS = ", ".join(f"'{k}'" for k in names.KINDS)
_WORDS = ", ".join(f"'{k}'" for k in names.VERSION_WORDS)
_IS_VERSION = f"(regexp_full_match(t, '[0-9]+') OR regexp_full_match(lower(t), 'v?[0-9]+(\\.[0-9]+)*') OR regexp_full_match(lower(t), 'rev ?[0-9]*') OR lower(t) IN ({_WORDS}))"
_SPLIT = f"""
b AS (SELECT *, {_FILE} AS file_name, {_EXT} AS ext, {_DIR} AS dir, regexp_replace({_FILE}, '\\.[^.]+$', '') AS base FROM {_M}),
tok AS (SELECT *, list_filter(string_split_regex(base, '[-_ \\t\\n.]+'), lambda t: t <> '') AS p FROM b),
cut AS (SELECT *, coalesce(list_max(list_filter(range(1, len(p) + 1), lambda i: NOT {_IS_VERSION.replace('(t', '(p[i]').replace('lower(t', 'lower(p[i]')})), 0) AS n FROM tok),
v AS (SELECT *, CASE WHEN n = 0 THEN base ELSE array_to_string(p[1:n], '_') END AS stem, array_to_string(p[n + 1:], '_') AS version_tag FROM cut),
docs AS (SELECT * FROM v WHERE ext IN ({_KINDS}))
"""
_NATURAL = "list_transform(list_filter(regexp_extract_all(version_tag, '[^0-9]*[0-9]*'), lambda t: t <> ''), lambda t: {'text': regexp_extract(t, '^[^0-9]*'), 'number': coalesce(try_cast(regexp_extract(t, '[0-9]*$') AS DECIMAL(38,0)), -1)})"
_GROUPS = f"""
WITH {_SPLIT},
ordered AS (SELECT *, lower(stem) AS s, row_number() OVER (PARTITION BY dir, lower(stem) ORDER BY {_NATURAL}, file_name) AS pos FROM docs)
"""
_RANK = "CASE ext WHEN 'pdf' THEN 1 WHEN 'docx' THEN 2 WHEN 'rtf' THEN 3 WHEN 'xlsx' THEN 4 WHEN 'xls' THEN 5 ELSE 6 END"
_CHAIN = (
    _GROUPS
    + f""", base AS (SELECT dir, s, replace(arg_min(ext, {_RANK}), 'xls', 'xlsx') AS b0 FROM ordered WHERE NOT failed GROUP BY dir, s),
b1 AS (SELECT dir, s, replace(b0, 'xlsxx', 'xlsx') AS b FROM base),
chain AS (SELECT * FROM (VALUES {", ".join(str((b, i, x, y)) for i, (b, x, y) in enumerate(g.CHAINS))}) t(b, ord, x, y)),
f AS (SELECT dir, s, CASE ext WHEN 'xls' THEN 'xlsx' ELSE ext END AS fmt, arg_min(file_name, pos) AS file FROM ordered WHERE NOT failed GROUP BY 1, 2, 3),
pairs AS (SELECT b1.dir, b1.s AS stem, ord::INT AS ord, x AS baseline_format, y AS comparing_format, f1.file AS baseline_file, f2.file AS comparing_file
  FROM b1 JOIN chain USING (b) JOIN f f1 ON f1.dir = b1.dir AND f1.s = b1.s AND f1.fmt = x JOIN f f2 ON f2.dir = b1.dir AND f2.s = b1.s AND f2.fmt = y)
"""
)

QUERIES = {
    "version_rows": (
        version_rows,
        _GROUPS
        + f""", c AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY dir, s ORDER BY pos) AS n FROM ordered WHERE NOT failed), first AS (SELECT dir, s, arg_min(ext, {_RANK}) AS baseline FROM c GROUP BY dir, s),
        f AS (SELECT c.dir, c.s, min(n) AS at_n FROM c JOIN first ON first.dir = c.dir AND first.s = c.s AND first.baseline = c.ext GROUP BY 1, 2)
        SELECT c.dir, c.s AS stem, 'V' || n AS version, file_name, CASE WHEN n = at_n THEN 'Baseline' ELSE 'Compared' END AS role FROM c JOIN f ON f.dir = c.dir AND f.s = c.s""",
    ),
    "versions_mode": (
        versions_mode,
        _GROUPS + ", c AS (SELECT dir, s, count(*) FILTER (WHERE NOT failed)::INT AS n FROM ordered GROUP BY 1, 2) SELECT n AS n_versions, count(*) AS n_groups FROM c GROUP BY n ORDER BY count(*) DESC, min((dir, s)) LIMIT 1",
    ),
    "run_stats": (
        run_stats,
        _GROUPS
        + """, c AS (SELECT dir, s, count(*) FILTER (WHERE NOT failed) AS n FROM ordered GROUP BY 1, 2)
        SELECT *, greatest(comparisons - differences, 0)::BIGINT AS matches FROM (SELECT count(*) AS files, (count(*) FILTER (WHERE NOT failed)) AS parsed, (count(*) FILTER (WHERE failed)) AS failed, count(DISTINCT string_split(dir, '/')[1]) AS accounts FROM docs),
        (SELECT count(*) AS groups, (count(*) FILTER (WHERE n >= 2)) AS comparable_groups, 2 * count(*) FILTER (WHERE n >= 2) AS comparisons FROM c),
        (SELECT sum(n)::BIGINT AS differences, sum(i)::BIGINT AS ignored, string_agg(difference_type || ':' || n, ',' ORDER BY difference_type) AS types FROM (SELECT difference_type, count(*) AS n, count(*) FILTER (WHERE status = 'Ignored') AS i FROM """
        + w.oracle(_FOUND)
        + """ GROUP BY 1))""",
    ),
    "scan_manifest_filter": (scan_manifest_filter, f"SELECT doc_id, {_EXT} AS ext FROM {_M} WHERE {_EXT} IN ({_KINDS})"),
    "path_parts": (path_parts, f"SELECT doc_id, {_DIR} AS dir, {_FILE} AS file_name, path || '::' || size::VARCHAR AS id FROM {_M}"),
    "split_version": (split_version, f"WITH {_SPLIT} SELECT doc_id, stem, version_tag FROM v"),
    "hierarchy_resolve": (
        hierarchy_resolve,
        f"SELECT doc_id, coalesce(s[2], '(root)') AS account, coalesce(s[3], '(root)') AS package_name, coalesce(s[4], '') AS category FROM (SELECT doc_id, list_filter(string_split({_DIR}, '/'), lambda x: x <> '') AS s FROM {_M})",
    ),
    "account_level": (
        account_level,
        f"WITH {_SPLIT} SELECT CASE WHEN count(DISTINCT string_split(dir, '/')[1]) = 1 AND count(DISTINCT string_split(dir, '/')[2]) >= 2 AND NOT regexp_full_match(min(string_split(dir, '/')[1]), '[0-9]+') THEN 2 ELSE 1 END AS level FROM docs",
    ),
    "level_histogram": (
        level_histogram,
        f"WITH {_SPLIT}, e AS (SELECT unnest(string_split(dir, '/')) AS name, generate_subscripts(string_split(dir, '/'), 1)::INT AS level FROM docs) SELECT level, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM e GROUP BY level",
    ),
    "group_docs": (
        group_docs,
        _GROUPS + "SELECT dir, s AS stem, count(*)::INT AS n_docs, string_agg(DISTINCT ext, ',' ORDER BY ext) AS formats, string_agg(file_name, '|' ORDER BY pos) AS files FROM ordered GROUP BY dir, s",
    ),
    "default_baseline": (default_baseline, _GROUPS + f"SELECT dir, s AS stem, arg_min(ext, {_RANK}) AS baseline FROM ordered WHERE NOT failed GROUP BY dir, s"),
    "comparison_chain": (comparison_chain, _CHAIN + "SELECT * FROM pairs"),
    "report_errors": (
        report_errors,
        f"""WITH {_SPLIT}, g AS (SELECT DISTINCT dir AS folder FROM docs), x AS (SELECT path, error, regexp_replace(path, '/[^/]*$', '') AS dir FROM {w.oracle(_ERRORS)}),
        p AS (SELECT x.*, arg_max(folder, length(folder)) AS folder FROM x LEFT JOIN g ON x.dir = folder OR starts_with(x.dir, folder || '/') GROUP BY ALL)
        SELECT coalesce(string_split(folder, '/')[1], '(root)') AS account, coalesce(string_split(folder, '/')[2], '(root)') AS package, coalesce(string_split(folder, '/')[3], '') AS category, 'lost_file' AS report, string_split(path, '/')[-1] AS file, 'ParseError' AS error_type,
        CASE error WHEN '' THEN 'Unknown error' ELSE error END AS error_message FROM p""",
    ),
    "chain_summary": (chain_summary, _CHAIN + "SELECT baseline_format, comparing_format, count(*) AS n_pairs FROM pairs GROUP BY 1, 2"),
}
