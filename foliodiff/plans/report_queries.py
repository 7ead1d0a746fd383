"""Queries of the report model, of matched elements, and of texts in many versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliodiff.functions.lines import clean_lines
from foliodiff.functions.names import natural_key
from foliodiff.operators import report, semantic, text_diff
from foliodiff.plans import compare_queries, sql
from foliodiff.plans import workloads as w

_GROUPS = """
SELECT c_custkey AS group_id, n_name AS account, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_mktsegment END AS package_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('cat ', CAST(c_custkey % 2 AS STRING)) END AS category,
  concat('monthlyTotals-', CAST(c_custkey % 12 AS STRING)) AS stem
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE c_custkey % 13 <> 0
"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by group; a tenth of the groups is ignored."""
    scope = F.when(F.col("pair_id") % 10 == 3, "account")
    found = compare_queries.canonical_diffs(spark, sf_dir).withColumns({"ignored_scope": scope, "diff_id": F.concat_ws("-", F.col("pair_id").cast("string"), "location_signature"), "group_label": F.lit("no_group")})
    return report.issues(found).withColumnRenamed("pair_id", "group_id")


def report_model_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_model(_issues(spark, sf_dir), w.frame(spark, sf_dir, _GROUPS))


def report_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_tree(_issues(spark, sf_dir), w.frame(spark, sf_dir, _GROUPS))


_NAMES = "SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'page ' ELSE 'Part' END, CAST(doc_id % 250 AS STRING), CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'b' ELSE concat('.', CAST(doc_id % 17 AS STRING)) END) AS name FROM {documents}"


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each distinct name; names are counted first."""
    names = w.frame(spark, sf_dir, _NAMES).groupBy("name").agg(F.count("*").alias("n")).withColumn("k", natural_key(F.col("name")))
    before = names.select(F.col("name").substr(1, 4).alias("head"), "name", "n", "k")
    return before.select("head", "name", "n", F.row_number().over(W.partitionBy("head").orderBy("k", "name")).cast("int").alias("position"))


#: Elements of customers: a third of the attributes is running text, worded the other way round in the other version; in every fourth
#: pair the baseline is one line that says what the fields of the other version hold. Some fields have another name there.
_TEXT = "(pair_id + idx) % 3 = 0"
_SECOND = f"SELECT pair_id, idx, CASE WHEN {_TEXT} THEN 'prose' ELSE 'key_value' END AS kind, CASE WHEN {_TEXT} THEN '' WHEN (3 * pair_id + idx) % 11 = 0 THEN 'Renamed' ELSE label END AS label, CASE WHEN {_TEXT} THEN concat(label, ' ', value) ELSE value END AS value FROM ({w.ITEMS_COMP}) c"
_FIRST = f"""
SELECT pair_id, idx, CASE WHEN {_TEXT} THEN 'prose' ELSE 'key_value' END AS kind, CASE WHEN {_TEXT} THEN '' ELSE label END AS label, CASE WHEN {_TEXT} THEN concat(value, ' ', label) ELSE value END AS value FROM ({w.ITEMS_BASE}) b WHERE pair_id % 4 <> 1
UNION ALL SELECT pair_id, 0, 'prose', '', concat_ws(' ', max(CASE WHEN idx = 0 THEN concat(label, ' ', value) END), max(CASE WHEN idx = 1 THEN concat(label, ' ', value) END), max(CASE WHEN idx = 2 THEN concat(label, ' ', value) END),
  max(CASE WHEN idx = 3 THEN concat(label, ' ', value) END), max(CASE WHEN idx = 9 THEN concat(label, ' ', value) END)) FROM ({_SECOND}) w WHERE pair_id % 4 = 1 AND kind = 'key_value' GROUP BY pair_id
"""


def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.match_elements(w.frame(spark, sf_dir, _FIRST), w.frame(spark, sf_dir, _SECOND))


def _phase(n: int, source: str, key: str, kinds: str) -> str:
    """Rank join of what source leaves open: r<n> ranks, m<n> pairs, o<n> what stays open."""
    return f"""r{n} AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, {key} ORDER BY idx) AS k FROM {source} WHERE {kinds}),
m{n} AS (SELECT b.pair_id, b.idx AS bi, c.idx AS ci, b.same = c.same AS eq FROM r{n} b JOIN r{n} c ON b.pair_id = c.pair_id AND b.{key} = c.{key} AND b.k = c.k WHERE b.side = 'base' AND c.side = 'comp'),
o{n} AS (SELECT * FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM m{n} m WHERE m.pair_id = s.pair_id AND CASE s.side WHEN 'base' THEN m.bi ELSE m.ci END = s.idx))"""


_CELL, _KEYED, _RUNNING = "kind IN ('key_value', 'table_cell', 'table_header')", "kind IN ('key_value', 'heading', 'table_cell', 'table_header')", "kind IN ('prose', 'list_item')"
def _matching(first: str, second: str) -> str:
    """CTEs up to told(pair_id, side, idx, phase, partner, status) for relations of elements."""
    return f"""
i AS (SELECT pair_id, 'base' AS side, idx, kind, label, value FROM {first} UNION ALL SELECT pair_id, 'comp', idx, kind, label, value FROM {second}),
e AS (SELECT *, {sql.normalize_key('label')} AS key, {sql.aggressive('value')} AS same, {sql.token_key('value')} AS words, {sql.token_key('label')} AS names FROM i),
{_phase(1, "e", "key", _KEYED)},
{_phase(2, "o1", "same", "true")},
held AS (SELECT pair_id, CASE side WHEN 'base' THEN 'comp' ELSE 'base' END AS side, list_distinct(flatten(list(names || words))) AS c FROM o2 WHERE {_CELL} GROUP BY ALL),
says AS (SELECT o.pair_id, o.side, min(idx) AS idx FROM o2 o JOIN held h ON h.pair_id = o.pair_id AND h.side = o.side WHERE {_RUNNING} AND len(words) BETWEEN greatest(1, len(c)) AND 2 * len(c) AND len(list_filter(words, lambda x: NOT list_contains(c, x))) = 0 GROUP BY 1, 2),
g AS (SELECT o.pair_id, o.side, o.idx, {_CELL} AS cell, s.idx AS by_idx FROM o2 o JOIN says s ON s.pair_id = o.pair_id AND ((o.side = s.side AND o.idx = s.idx) OR (o.side <> s.side AND {_CELL}))),
o3 AS (SELECT * FROM o2 o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.pair_id = o.pair_id AND g.side = o.side AND g.idx = o.idx)),
{_phase(4, "o3", "words", _RUNNING + " AND len(words) > 0")},
told AS ({" UNION ALL ".join(f"SELECT pair_id, '{side}' AS side, {a} AS idx, '{name}' AS phase, {b} AS partner, CASE WHEN {n} > 1 OR eq THEN 'identical' ELSE 'changed' END AS status FROM m{n}" for n, name in ((1, 'key'), (2, 'value'), (4, 'tokens')) for side, a, b in (('base', 'bi', 'ci'), ('comp', 'ci', 'bi')))}
UNION ALL SELECT pair_id, side, idx, 'gathered', CASE WHEN cell THEN by_idx END, 'identical' FROM g
UNION ALL SELECT pair_id, side, idx, NULL, NULL, CASE side WHEN 'base' THEN 'missing' ELSE 'added' END FROM o4)
"""


def text_nway_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each document: in one, lines are upper-cased; in the other, some are left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("group_id"), clean_lines(F.col("text")).alias("old"))
    changed = F.transform("old", lambda x, i: F.when((i + F.col("group_id")) % 7 == 3, F.upper(x)).otherwise(x))
    fewer = F.filter("old", lambda x, i: (i + F.col("group_id")) % 11 != 5)
    both = docs.select("group_id", "old", F.posexplode(F.array(changed, fewer)).alias("version", "new"))
    return text_diff.compare_versions(both)


_FOUND = (
    compare_queries._DIFF
    + f""", g AS {w.oracle(_GROUPS)}, i AS (SELECT d.*, pair_id AS group_id, pair_id || '-' || location_signature AS diff_id, CASE WHEN pair_id % 10 = 3 THEN 'Ignored' ELSE 'Reported' END AS status,
  CASE difference_type WHEN 'value_mismatch' THEN 'VALUE_MISMATCH' WHEN 'missing_content' THEN 'MISSING_CONTENT' ELSE 'ADDED_CONTENT' END AS code, CASE difference_type WHEN 'missing_content' THEN 'High' ELSE 'Medium' END AS severity FROM d)
"""
)
_ONE_LINE = "(CASE WHEN length(trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) > {n} THEN left(trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), {n}) || '…' ELSE trim(regexp_replace({x}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) END)"

QUERIES = {
    "report_model_flat": (
        report_model_flat,
        _FOUND
        + f"""SELECT coalesce(g.account, '(root)') AS account, coalesce(g.package_name, '(root)') AS package_name, coalesce(g.category, '') AS category, CASE WHEN g.stem IS NULL THEN 'No Group' ELSE 'Monthly Totals ' || (i.group_id % 12) END AS report_name,
        i.group_id, diff_id, location_label, code, severity, status, {_ONE_LINE.format(x="reference_text", n=120)} AS baseline, {_ONE_LINE.format(x="version_text", n=160)} AS different, description FROM i LEFT JOIN g USING (group_id)""",
    ),
    "report_tree": (
        report_tree,
        _FOUND
        + """, r AS (SELECT g.group_id, account, CASE package_name WHEN '' THEN '(root)' ELSE package_name END AS package, category, group_id % 12 AS number, count(i.group_id) AS n_issues, count(*) FILTER (status = 'Reported') AS n_reported FROM g LEFT JOIN i USING (group_id) GROUP BY ALL)
        SELECT group_id, account, package, category, 'Monthly Totals ' || number AS report_name, n_issues, n_reported, (sum(n_issues) OVER (PARTITION BY account, package))::BIGINT AS package_issues, (sum(n_issues) OVER (PARTITION BY account))::BIGINT AS account_issues,
        (dense_rank() OVER (ORDER BY regexp_extract(account, '[0-9]+')::INT))::INT AS account_position, (dense_rank() OVER (PARTITION BY account ORDER BY package))::INT AS package_position,
        (row_number() OVER (PARTITION BY account, package ORDER BY number, group_id))::INT AS report_position, n_reported = 0 AS all_matched FROM r""",
    ),
    "natural_order": (
        natural_order,
        f"""WITH n AS (SELECT name, count(*) AS n, regexp_extract(name, '[a-z ]([0-9]+)', 1)::INT AS a, regexp_extract(name, '[0-9]([b.]?)[0-9]*$', 1) AS t, try_cast(regexp_extract(name, '[.]([0-9]+)$', 1) AS INT) AS b FROM {w.oracle(_NAMES)} GROUP BY ALL)
        SELECT left(name, 4) AS head, name, n, (row_number() OVER (PARTITION BY left(name, 4) ORDER BY a, t, b NULLS FIRST, name))::INT AS position FROM n""",
    ),
    "semantic_match": (semantic_match, f"WITH {_matching(w.oracle(_FIRST), w.oracle(_SECOND))} SELECT * FROM told"),
    "text_nway_diff": (text_nway_diff, None),  # shortest scripts: tested against plain rules
}
