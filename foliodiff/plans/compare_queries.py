"""Queries of items, sheets, fields, rules, reports and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.durable import written
from foliodiff.functions.lines import clean_lines, line_class
from foliodiff.functions.text import equality_key
from foliodiff.operators import fields, items, layout, report, residue, rules, sheets, tables, text_diff, tokens
from foliodiff.sources.files import magic
from foliodiff.plans import sql
from foliodiff.plans import workloads as w


def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = w.frame(spark, sf_dir, w.KV_LINES).withColumn("p", items.extract_pair(F.col("line")))
    return found.select("pair_id", "idx", "p.field", "p.value")


def dedup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.deduplicate(w.frame(spark, sf_dir, w.ITEMS_REPEATED))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.match_by_key(w.frame(spark, sf_dir, w.ITEMS_BASE), w.frame(spark, sf_dir, w.ITEMS_COMP))


def match_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("pair_id", "key", "n", "base_idx", "comp_idx", "status")


def match_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).filter("status IN ('missing', 'added')").select("pair_id", "key", "status")


def canonical_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.difference_records(_matched(spark, sf_dir))


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.detect_header(w.frame(spark, sf_dir, w.CELLS_VER))


def sheet_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.table_items(sheets.comparable_sheets(w.frame(spark, sf_dir, w.CELLS_VER))).select("doc", "r", "c", "key", "header", "value")


def sheet_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.grid_items(w.frame(spark, sf_dir, w.CELLS_VER)).select("doc", "key", "label", "value")


def sheet_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.structure_changes(w.frame(spark, sf_dir, w.CELLS_REF), w.frame(spark, sf_dir, w.CELLS_VER))


def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.cell_changes(w.frame(spark, sf_dir, w.CELLS_REF), w.frame(spark, sf_dir, w.CELLS_VER))


_PLACE = "SELECT c_custkey AS pair_id, n_name AS account, c_mktsegment AS package_name, concat('Report ', CAST(c_custkey % 4 AS STRING)) AS group_label FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey"
_NAMED = "SELECT doc, CAST(doc % 3 AS INT) AS sheet_idx, CASE WHEN doc % 2 = 0 THEN 'Main' ELSE concat('S', CAST(doc % 5 AS STRING)) END AS sheet FROM (SELECT DISTINCT o_custkey AS doc FROM {orders}) t UNION ALL SELECT DISTINCT o_custkey, 3, 'Totals' FROM {orders}"
_OTHER = "SELECT doc, CAST(doc % 4 AS INT) AS sheet_idx, CASE WHEN doc % 3 = 0 THEN 'Main' ELSE concat('T', CAST(doc % 5 AS STRING)) END AS sheet FROM (SELECT DISTINCT o_custkey AS doc FROM {orders}) t UNION ALL SELECT DISTINCT o_custkey, 4, 'Totals' FROM {orders} WHERE o_custkey % 7 < 3"


def sheet_align_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet of both versions, with its position in each."""
    return sheets.align_sheets(w.frame(spark, sf_dir, _NAMED), w.frame(spark, sf_dir, _OTHER))


def sheet_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets of the reference, and what became of them."""
    return sheet_align_all(spark, sf_dir).filter("how <> 'added'").select("doc", "sheet", "other", "how")


def sheet_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.sheet_presence(*(w.frame(spark, sf_dir, x).withColumnRenamed("sheet_idx", "pos") for x in (_NAMED_FROM_0, _OTHER_FROM_0)))


def _from_0(relation: str) -> str:
    return f"SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY sheet_idx) - 1 AS INT) AS sheet_idx, sheet FROM ({relation}) s"


_NAMED_FROM_0, _OTHER_FROM_0 = _from_0(_NAMED), _from_0(_OTHER)


def header_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.header_changes(w.frame(spark, sf_dir, w.CELLS_REF), w.frame(spark, sf_dir, w.CELLS_VER))


_ENTRY_LINES = f"SELECT pair_id AS doc, CAST(idx + 1 AS INT) AS line_no, line FROM ({w.KV_LINES}) e"


def field_text_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.text_entries(w.frame(spark, sf_dir, _ENTRY_LINES))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences with the two formats of their comparison."""
    comparing = F.when(F.col("pair_id") % 3 == 0, "csv").when(F.col("pair_id") % 3 == 1, "docx").otherwise("pdf")
    return _diffs(spark, sf_dir).withColumns({"baseline_format": F.lit("xlsx"), "comparing_format": comparing})


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.chain_rows(_paired(spark, sf_dir), ["account", "package_name", "group_label"])


_HIERARCHY = f"SELECT account, package_name, CASE WHEN pair_id % 5 = 0 THEN '' ELSE group_label END AS category FROM ({_PLACE}) h"


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_counts(w.frame(spark, sf_dir, _HIERARCHY))


def account_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.account_breakdown(w.frame(spark, sf_dir, f"SELECT DISTINCT account, package_name, category FROM ({_HIERARCHY}) a"))


def visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.visible_counts(_issues(spark, sf_dir))


def issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issue_lists(_issues(spark, sf_dir), ["account", "package_name", "report"], ["code", "severity", "status"])


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference records with the hierarchy of their customer: nation, segment, report."""
    place = w.frame(spark, sf_dir, _PLACE)
    return canonical_diffs(spark, sf_dir).join(place, "pair_id").withColumns(
        {"doc_type": F.lit("xlsx"), "comparison_mode": F.lit("intelligent"), "diff_id": F.concat_ws("-", F.col("pair_id").cast("string"), "location_signature")}
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.fingerprints(_diffs(spark, sf_dir)).select("diff_id", "account_hash", "report_hash", "location_hash", F.sha2("location_key", 256).alias("fingerprint"))


def _rules(found: DataFrame) -> DataFrame:
    """Rules made from differences that a person might have picked, some of them twice."""
    picked = found.filter("pair_id % 41 = 3")
    return (
        picked.filter("pair_id % 3 = 0").select(F.lit("location").alias("scope"), F.col("location_key").alias("key"), F.col("diff_id").alias("rule_id"), F.col("pair_id").alias("ord"))
        .union(picked.filter("pair_id % 5 = 1").select(F.lit("report"), "report_key", "diff_id", "pair_id"))
        .union(picked.filter("pair_id % 82 = 3 AND difference_type = 'missing_content'").select(F.lit("account"), "account_key", "diff_id", "pair_id"))
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(rules.fingerprints(_diffs(spark, sf_dir)))  # rules and session are picked from the differences
    session = found.filter("pair_id % 97 = 5").select(F.col("diff_id").alias("occurrence"))
    # rules are unique by (scope, key, ord): several differences of one document tie, and the smallest id wins
    return rules.apply_rules(found, _rules(found), session)


def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("diff_id", "ignored_scope", "rule_id")


def visible_diffs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.visible(_judged(spark, sf_dir), search="revised", difference_type="value_mismatch").select("diff_id", "location_label", "version_text")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issues(_judged(spark, sf_dir)).withColumnRenamed("group_label", "report")


def severity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("difference_type", "code", "severity", "status").agg(F.count("*").alias("n"))


def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.issue_rollup(_issues(spark, sf_dir))


def row_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows_of(w.frame(spark, sf_dir, w.GLYPHS)).select("doc", "ord", "row")


def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gap_threshold(layout.rows_of(w.frame(spark, sf_dir, w.GLYPHS)))


_COLUMNS_AT = "SELECT DISTINCT user_id AS doc, CAST(event_id % 4 AS INT) AS `column`, CAST((event_id % 4) * 90 AS DOUBLE) AS x0 FROM {events}"


def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.nearest_column(w.frame(spark, sf_dir, w.GLYPHS), w.frame(spark, sf_dir, _COLUMNS_AT))
    return placed.select("doc", "ord", F.col("column").cast("int").alias("col"))


def artifact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(clean_lines(F.col("text"))).alias("line_no", "line"))


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = w.frame(spark, sf_dir, w.KV_LINES).select(line_class(F.col("line")).alias("line_class"))
    return artifact_filter(spark, sf_dir).select(line_class(F.col("line")).alias("line_class")).union(kv).groupBy("line_class").agg(F.count("*").alias("n"))


_VERSIONS = f"""
SELECT pair_id AS group_id, 0 AS version, idx AS ord, label, value FROM ({w.ITEMS_BASE}) v0
UNION ALL SELECT pair_id, 1, idx, label, value FROM ({w.ITEMS_COMP}) v1
UNION ALL SELECT pair_id, 2, idx, label, CASE WHEN (pair_id + idx) % 21 = 0 THEN '' ELSE value END FROM ({w.ITEMS_COMP}) v2 WHERE (pair_id + idx) % 31 <> 0
UNION ALL SELECT pair_id, 1, 20, CASE WHEN pair_id % 2 = 0 THEN 'Contact #2' ELSE 'Contact' END, value FROM ({w.ITEMS_BASE}) v3 WHERE idx = 0 AND pair_id % 9 = 0
"""


def field_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.compare_versions(w.frame(spark, sf_dir, _VERSIONS), 3)
    return found.select("group_id", "key", "n", "label", "reference_text", F.array_join("texts", "|").alias("texts"), F.array_join("kinds", "|").alias("kinds"))


_PROSE = f"SELECT pair_id, idx, CASE WHEN pair_id % 4 = 0 THEN 'paragraph' ELSE kind END AS kind, label, CASE pair_id % 16 WHEN 0 THEN concat(label, ' | ', value) WHEN 4 THEN concat(label, ' ', value) WHEN 8 THEN concat(label, ':') ELSE value END AS value FROM ({w.ITEMS_BASE}) p"


def canonical_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.match_residue(w.frame(spark, sf_dir, _PROSE), w.frame(spark, sf_dir, w.ITEMS_BASE))


def text_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", clean_lines(F.col("text")).alias("old"))
    changed = F.transform("old", lambda x, i: F.when((i + F.col("doc_id")) % 7 == 3, F.upper(x)).otherwise(x))
    return text_diff.line_differences(docs.withColumn("new", F.filter(changed, lambda x, i: (i + F.col("doc_id")) % 11 != 5)), key="doc_id")


_PIPES = f"""
SELECT doc, CAST(r * 2 + CASE WHEN r > 4 THEN 1 ELSE 0 END - r AS INT) AS line_no, concat(max(CASE WHEN c = 0 THEN value END), ' | ', max(CASE WHEN c = 1 THEN value END),
  CASE WHEN doc % 3 = 0 THEN '' WHEN r % 6 = 5 THEN '' ELSE concat(' | ', max(CASE WHEN c = 2 THEN value END)) END) AS line
FROM ({w.CELLS_REF}) x GROUP BY doc, r
"""


def pipe_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.pipe_blocks(w.frame(spark, sf_dir, _PIPES))
    return found.groupBy("doc", "block").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), F.min("line_no").alias("first_line"))


def pipe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.block_items(tables.pipe_blocks(w.frame(spark, sf_dir, _PIPES)))


def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = w.frame(spark, sf_dir, w.ITEMS_BASE).select("pair_id", "idx", F.concat_ws(": ", "label", "value").alias("value"))
    comp = w.frame(spark, sf_dir, w.ITEMS_COMP).select("pair_id", "idx", F.concat_ws(" | ", "value", "label").alias("value"))
    return tokens.match_by_tokens(base, comp)


def aggregated_cells_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = w.frame(spark, sf_dir, w.ITEMS_BASE).groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "label", "value"))), "; ").alias("prose"))
    comp = w.frame(spark, sf_dir, w.ITEMS_COMP).groupBy("pair_id").agg(F.collect_list(F.concat_ws(" ", "label", "value")).alias("cells"))
    return base.join(comp, "pair_id").select("pair_id", tokens.gathers(F.col("prose"), F.col("cells")).alias("gathers"))


def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, comp = (w.frame(spark, sf_dir, x).groupBy("pair_id", equality_key(F.col("value")).alias("eq")).agg(F.count("*").alias("n")) for x in (w.ITEMS_BASE, w.ITEMS_COMP))
    return base.join(comp.withColumnRenamed("n", "m"), ["pair_id", "eq"]).select("pair_id", "eq", F.least("n", "m").alias("n_pairs"))


def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.when(F.col("doc_id") % 4 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 4 == 1, "{\\rtf1 ").when(F.col("doc_id") % 8 == 2, F.concat(F.lit("PK"), F.char(F.lit(3)))).otherwise("")
    return docs.select("doc_id", magic(F.concat(head, "text").cast("binary")).alias("detected"))


_FORMS = {
    1: ("^([A-Za-z][^:|=]{0,79}?)[ \\t]*:[ \\t]*([^|]+)$",),
    2: ("^([A-Za-z][^:|=]{0,79}?)[ \\t]*=[ \\t]*([^|]+)$",),
    3: ("^([A-Za-z][A-Za-z ]{0,29}?)[ \\t]{2,}([^ \\t].*)$",),
    4: ("^([A-Za-z][A-Za-z ]{1,28}[A-Za-z]) ([0-9][0-9,.:/-]*)$",),
}
_LINE = sql.trim("line")


def _form(k: int) -> str:
    whens = " ".join(f"WHEN regexp_matches({_LINE}, '{f}') THEN trim(regexp_extract({_LINE}, '{f}', {k}))" for (f,) in _FORMS.values())
    return f"CASE {whens} END"


_BASE, _COMP = w.oracle(w.ITEMS_BASE), w.oracle(w.ITEMS_COMP)
_MATCH = f"""
WITH b AS (SELECT *, {sql.normalize_key('label')} AS key, row_number() OVER (PARTITION BY pair_id, {sql.normalize_key('label')} ORDER BY idx)::INT AS n FROM {_BASE}),
c AS (SELECT *, {sql.normalize_key('label')} AS key, row_number() OVER (PARTITION BY pair_id, {sql.normalize_key('label')} ORDER BY idx)::INT AS n FROM {_COMP}),
m AS (SELECT coalesce(b.pair_id, c.pair_id) AS pair_id, coalesce(b.key, c.key) AS key, coalesce(b.n, c.n) AS n, b.idx AS base_idx, c.idx AS comp_idx, b.label AS bl, c.label AS cl, b.value AS bv, c.value AS cv,
  CASE WHEN c.idx IS NULL THEN 'missing' WHEN b.idx IS NULL THEN 'added' WHEN {sql.equality_key('b.value')} = {sql.equality_key('c.value')} THEN 'identical' ELSE 'changed' END AS status
  FROM b FULL JOIN c ON b.pair_id = c.pair_id AND b.key = c.key AND b.n = c.n)
"""
_DIFF = (
    _MATCH
    + """, d AS (SELECT pair_id, CASE status WHEN 'missing' THEN 'missing_content' WHEN 'added' THEN 'added_content' ELSE 'value_mismatch' END AS difference_type,
  CASE status WHEN 'missing' THEN 'missing|' || key WHEN 'added' THEN 'added|' || key ELSE 'field_value|' || key || '|' || n END AS location_signature, coalesce(bl, cl) AS location_label,
  coalesce(bv, '') AS reference_text, coalesce(cv, '') AS version_text,
  CASE status WHEN 'missing' THEN bl || ' is missing; it was "' || bv || '".' WHEN 'added' THEN cl || ' was added: "' || cv || '".' ELSE bl || ' changed from "' || bv || '" to "' || cv || '".' END AS description
  FROM m WHERE status <> 'identical')
"""
)
_FINGER = (
    _DIFF
    + f""", p AS {w.oracle(_PLACE)},
f AS (SELECT d.*, p.account, p.package_name, p.group_label, d.pair_id || '-' || location_signature AS diff_id, {sql.hash_of('account', 'account')} AS account_hash, {sql.hash_of('report', 'group_label')} AS report_hash,
  {sql.hash_of('location', 'location_signature')} AS location_hash FROM d JOIN p USING (pair_id)),
k AS (SELECT *, account_hash || '|' || report_hash || '|' || location_hash || '|xlsx|' || difference_type || '|intelligent' AS location_key, account_hash || '|' || report_hash || '|xlsx|' || difference_type || '|intelligent' AS report_key,
  account_hash || '|xlsx|' || difference_type || '|intelligent' AS account_key FROM f)
"""
)
_RULED = (
    _FINGER
    + """, picked AS (SELECT * FROM k WHERE pair_id % 41 = 3),
r1 AS (SELECT location_key AS key, arg_min(diff_id, (pair_id, diff_id)) AS rule_id FROM picked WHERE pair_id % 3 = 0 GROUP BY 1),
r2 AS (SELECT report_key AS key, arg_min(diff_id, (-pair_id, diff_id)) AS rule_id FROM picked WHERE pair_id % 5 = 1 GROUP BY 1),
r3 AS (SELECT account_key AS key, arg_min(diff_id, (-pair_id, diff_id)) AS rule_id FROM picked WHERE pair_id % 82 = 3 AND difference_type = 'missing_content' GROUP BY 1),
j AS (SELECT k.*, CASE WHEN pair_id % 97 = 5 THEN 'occurrence' WHEN r1.key IS NOT NULL THEN 'location' WHEN r2.key IS NOT NULL THEN 'report' WHEN r3.key IS NOT NULL THEN 'account' END AS ignored_scope,
  CASE WHEN pair_id % 97 <> 5 THEN coalesce(r1.rule_id, r2.rule_id, r3.rule_id) END AS rule_id
  FROM k LEFT JOIN r1 ON r1.key = location_key LEFT JOIN r2 ON r2.key = report_key LEFT JOIN r3 ON r3.key = account_key),
i AS (SELECT *, CASE difference_type WHEN 'value_mismatch' THEN 'VALUE_MISMATCH' WHEN 'missing_content' THEN 'MISSING_CONTENT' ELSE 'ADDED_CONTENT' END AS code,
  CASE difference_type WHEN 'missing_content' THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN ignored_scope IS NULL THEN 'Reported' ELSE 'Ignored' END AS status FROM j)
"""
)
_REF, _VER = w.oracle(w.CELLS_REF), w.oracle(w.CELLS_VER)
_FILLED = f"(SELECT * FROM {_VER} WHERE {sql.trim('value')} <> '')"
_ROWS = f"(SELECT *, sum(s) OVER (PARTITION BY doc ORDER BY ord)::INT AS row FROM (SELECT *, coalesce((abs(y - lag(y) OVER (PARTITION BY doc ORDER BY ord)) > 2.5)::INT, 0) AS s FROM {w.oracle(w.GLYPHS)}))"

_CLEAN = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, i, regexp_replace(x, '[ \\t\\r\\f\\v]+$', '') AS line FROM l),
c AS (SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no FROM t WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(word/|xl/|ppt/|_rels/|\\[Content_Types\\])')
  AND NOT regexp_matches(trim(line), '^PK[\\x00-\\x03\\x05-\\x1f]') AND NOT (length(trim(line)) < 8 AND regexp_matches(line, '[\\x00-\\x08\\x0e-\\x1f]'))
  AND NOT regexp_matches(trim(line), '^\\{?\\\\(rtf|ansi|deff|fonttbl|colortbl|stylesheet|info|pict|pard|par|tab|fs[0-9]|b|i|ul|cf[0-9]|highlight[0-9])'))
"""
_CLASS = """CASE WHEN regexp_matches(trim(line), '^[|\\-+:]+$') THEN 'separator' WHEN regexp_matches(trim(line), '^#{1,6} ') THEN 'heading' WHEN regexp_matches(trim(line), '^[-*\u2022] ') THEN 'list_item'
  WHEN contains(line, '|') THEN 'pipe_row' WHEN regexp_matches(trim(line), '^[A-Za-z][^:|=]{0,79}[ \\t]*[:=][ \\t]*[^|]+$') THEN 'field' ELSE 'paragraph' END"""

_BLOCKS = f"""
WITH p AS (SELECT doc, line_no, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM {w.oracle(_PIPES)}),
f AS (SELECT * FROM p WHERE len(cells) >= 2 AND NOT contains(cells[1], ':')),
m AS (SELECT *, coalesce((line_no <> lag(line_no) OVER o + 1 OR len(cells) <> lag(len(cells)) OVER o)::INT, 1) AS fresh FROM f WINDOW o AS (PARTITION BY doc ORDER BY line_no)),
k AS (SELECT doc, line_no, cells, (sum(fresh) OVER (PARTITION BY doc ORDER BY line_no))::BIGINT AS block FROM m),
b AS (SELECT *, (row_number() OVER (PARTITION BY doc, block ORDER BY line_no) - 1)::INT AS r FROM k)
"""

QUERIES = {
    "artifact_filter": (artifact_filter, _CLEAN + "SELECT doc_id, line_no, line FROM c"),
    "line_classify": (line_classify, _CLEAN + f"SELECT {_CLASS} AS line_class, count(*) AS n FROM (SELECT line FROM c UNION ALL SELECT line FROM {w.oracle(w.KV_LINES)}) GROUP BY 1"),
    "field_nway": (
        field_nway,
        f"""WITH r AS (SELECT *, {sql.normalize_key('label')} AS key, row_number() OVER (PARTITION BY group_id, version, {sql.normalize_key('label')} ORDER BY ord)::INT AS n FROM {w.oracle(_VERSIONS)}),
        k AS (SELECT group_id, key, bool_or(version = 0) AS known FROM r GROUP BY 1, 2),
        g AS (SELECT group_id, key, n, arg_min(label, (version, ord)) AS label, coalesce(max(value) FILTER (WHERE version = 0), '') AS a, coalesce(max(value) FILTER (WHERE version = 1), '') AS b, coalesce(max(value) FILTER (WHERE version = 2), '') AS c FROM r GROUP BY 1, 2, 3)
        SELECT group_id, key, n, label, a AS reference_text, b || '|' || c AS texts, (CASE WHEN b = a THEN 'unchanged' WHEN b = '' THEN 'removed' WHEN a = '' THEN 'added' ELSE 'changed' END) || '|' || (CASE WHEN c = a THEN 'unchanged' WHEN c = '' THEN 'removed' WHEN a = '' THEN 'added' ELSE 'changed' END) AS kinds
        FROM g JOIN k USING (group_id, key) WHERE (a <> b OR a <> c) AND NOT (a = '' AND (b = c OR b = '' OR c = '') AND NOT (regexp_matches(label, ' #[0-9]+$') AND NOT known))""",
    ),
    "pipe_blocks": (pipe_blocks, _BLOCKS + "SELECT doc, block, count(*) AS n_rows, max(len(cells))::INT AS n_cols, min(line_no) AS first_line FROM b GROUP BY 1, 2"),
    "pipe_items": (
        pipe_items,
        _BLOCKS
        + f""", h AS (SELECT doc, block, arg_min(cells, r) AS head, count(*) AS n FROM b GROUP BY 1, 2),
        hh AS (SELECT *, n >= 2 AND list_bool_and(list_transform(head, lambda x: regexp_matches(x, '^[A-Za-z]') AND NOT {sql.is_numeric('x')} AND length(x) <= CASE WHEN len(head) = 2 THEN 12 ELSE 50 END)) AS headed FROM h),
        e AS (SELECT b.doc, b.block, r, headed, head, cells, unnest(cells) AS value, generate_subscripts(cells, 1) - 1 AS c FROM b JOIN hh USING (doc, block))
        SELECT doc, block, r, c::INT AS c, {sql.normalize_key('head[c + 1]')} AS key, value FROM e WHERE headed AND r > 0
        UNION ALL SELECT doc, block, r, c::INT, {sql.normalize_key('cells[c]')}, value FROM e WHERE NOT headed AND c % 2 = 1""",
    ),
    "token_match": (
        token_match,
        f"""WITH b AS (SELECT pair_id, idx, k, row_number() OVER (PARTITION BY pair_id, k ORDER BY idx) AS n FROM (SELECT *, {sql.token_key("label || ': ' || value")} AS k FROM {_BASE})),
        c AS (SELECT pair_id, idx, k, row_number() OVER (PARTITION BY pair_id, k ORDER BY idx) AS n FROM (SELECT *, {sql.token_key("value || ' | ' || label")} AS k FROM {_COMP}))
        SELECT b.pair_id, b.idx AS base_idx, c.idx AS comp_idx FROM b JOIN c ON b.pair_id = c.pair_id AND b.k = c.k AND b.n = c.n WHERE len(b.k) > 0""",
    ),
    "aggregated_cells_match": (
        aggregated_cells_match,
        f"""WITH b AS (SELECT pair_id, {sql.token_key("string_agg(label || ' ' || value, '; ')")} AS p FROM {_BASE} GROUP BY pair_id), c AS (SELECT pair_id, list_distinct({sql.token_key("string_agg(label || ' ' || value, ' ')")}) AS s FROM {_COMP} GROUP BY pair_id)
        SELECT pair_id, len(list_filter(p, lambda x: NOT list_contains(s, x))) = 0 AND len(p) BETWEEN len(s) AND 2 * len(s) AND len(p) > 0 AS gathers FROM b JOIN c USING (pair_id)""",
    ),
    "value_classes": (
        value_classes,
        f"SELECT pair_id, eq, least(n, m) AS n_pairs FROM (SELECT pair_id, {sql.equality_key('value')} AS eq, count(*) AS n FROM {_BASE} GROUP BY 1, 2) JOIN (SELECT pair_id, {sql.equality_key('value')} AS eq, count(*) AS m FROM {_COMP} GROUP BY 1, 2) USING (pair_id, eq)",
    ),
    "magic_bytes": (magic_bytes, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pdf' WHEN doc_id % 4 = 1 THEN 'rtf' WHEN doc_id % 8 = 2 THEN 'zip' END AS detected FROM documents"),
    "canonical_residue": (canonical_residue, f"WITH RECURSIVE {sql.residue(w.oracle(_PROSE), w.oracle(w.ITEMS_BASE))} SELECT * FROM matched"),
    "text_line_diff": (text_line_diff, None),
    "kv_extract": (kv_extract, f"SELECT pair_id, idx, {_form(1)} AS field, {_form(2)} AS value FROM {w.oracle(w.KV_LINES)}"),
    "dedup_items": (
        dedup_items,
        f"""SELECT pair_id, kind, key, idx, label, value FROM (SELECT *, {sql.normalize_key('label')} AS key, row_number() OVER (PARTITION BY pair_id, kind, {sql.normalize_key('label')},
        CASE WHEN kind = 'field_value' THEN '' ELSE {sql.normalize_text('value')} END ORDER BY CASE WHEN kind = 'field_value' THEN length(value) ELSE 0 END, idx) AS rn FROM {w.oracle(w.ITEMS_REPEATED)}) WHERE rn = 1""",
    ),
    "match_by_key": (match_by_key, _MATCH + "SELECT pair_id, key, n, base_idx, comp_idx, status FROM m"),
    "match_residue": (match_residue, _MATCH + "SELECT pair_id, key, status FROM m WHERE status IN ('missing', 'added')"),
    "canonical_diffs": (canonical_diffs, _DIFF + "SELECT * FROM d"),
    "header_detect": (
        header_detect,
        f"SELECT doc, sheet_idx, sheet, count(*) >= 2 AND regexp_matches(arg_min(value, c), '^[ \\t]*[A-Za-z]') AND NOT bool_or({sql.is_numeric('value')}) AS has_header FROM {_FILLED} WHERE r = 0 GROUP BY 1, 2, 3",
    ),
    "sheet_unpivot": (
        sheet_unpivot,
        f"""WITH f AS (SELECT * FROM {_FILLED}), h AS (SELECT doc, c, value AS header FROM f WHERE r = 0),
        n AS (SELECT f.*, coalesce(header, {sql.column_letters('f.c')}) AS header FROM f LEFT JOIN h ON h.doc = f.doc AND h.c = f.c WHERE r > 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc, header ORDER BY r, c) - 1 AS n FROM n)
        SELECT doc, r, c, {sql.normalize_key("CASE WHEN n > 0 THEN header || ' #' || n ELSE header END")} AS key, header, value FROM k""",
    ),
    "sheet_grid_cells": (sheet_grid_cells, f"SELECT doc, 'cell_' || r || '_' || c AS key, {sql.cell_address('r', 'c')} AS label, value FROM {_FILLED}"),
    "sheet_structure": (
        sheet_structure,
        f"""WITH a AS (SELECT doc, sheet, max(r) + 1 AS ar, max(c) + 1 AS ac FROM {_REF} WHERE value <> '' GROUP BY 1, 2), b AS (SELECT doc, sheet, max(r) + 1 AS br, max(c) + 1 AS bc FROM {_VER} WHERE value <> '' GROUP BY 1, 2)
        SELECT doc, sheet, CASE WHEN br > ar THEN 'rows_added' ELSE 'rows_removed' END AS difference_type, abs(br - ar) AS n FROM a JOIN b USING (doc, sheet) WHERE br <> ar
        UNION ALL SELECT doc, sheet, CASE WHEN bc > ac THEN 'cols_added' ELSE 'cols_removed' END, abs(bc - ac) FROM a JOIN b USING (doc, sheet) WHERE bc <> ac""",
    ),
    "cell_diff": (
        cell_diff,
        f"""WITH j AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.sheet, b.sheet) AS sheet, coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, coalesce(a.value, '') AS old, coalesce(b.value, '') AS new
          FROM (SELECT * FROM {_REF} WHERE value <> '') a FULL JOIN (SELECT * FROM {_VER} WHERE value <> '') b ON a.doc = b.doc AND a.sheet = b.sheet AND a.r = b.r AND a.c = b.c)
        SELECT doc, sheet, {sql.cell_address('r', 'c')} AS address, CASE WHEN r = 0 AND trim(old) <> '' AND NOT {sql.is_numeric('old')} AND {sql.trim('new')} <> '' THEN 'header_changed' ELSE 'cell_changed' END AS difference_type, old, new
        FROM j WHERE old <> new AND NOT (old = '' AND {sql.trim('new')} = '')""",
    ),
    "sheet_align": (sheet_align, sql.sheet_claims(w.oracle(_NAMED), w.oracle(_OTHER)) + "SELECT doc, sheet, other, how FROM claims WHERE how <> 'added'"),
    "sheet_align_all": (sheet_align_all, sql.sheet_claims(w.oracle(_NAMED), w.oracle(_OTHER)) + "SELECT * FROM claims"),
    "fingerprints": (fingerprints, _FINGER + "SELECT diff_id, account_hash, report_hash, location_hash, sha256(location_key) AS fingerprint FROM k"),
    "rule_cascade": (rule_cascade, _RULED + "SELECT diff_id, ignored_scope, rule_id FROM j"),
    "visible_diffs_search": (
        visible_diffs_search,
        _RULED + "SELECT diff_id, location_label, version_text FROM j WHERE ignored_scope IS NULL AND difference_type = 'value_mismatch' AND contains(lower(concat_ws(chr(10), group_label, location_label, reference_text, version_text)), 'revised')",
    ),
    "severity_map": (severity_map, _RULED + "SELECT difference_type, code, severity, status, count(*) AS n FROM i GROUP BY 1, 2, 3, 4"),
    "issue_rollup": (
        issue_rollup,
        _RULED + "SELECT coalesce(account, '(all)') AS account, coalesce(package_name, '(all)') AS package_name, coalesce(group_label, '(all)') AS report, count(*) AS n_issues, sum((severity = 'High')::BIGINT)::BIGINT AS n_high FROM i WHERE status = 'Reported' GROUP BY ROLLUP(account, package_name, group_label)",
    ),
    "row_segmentation": (row_segmentation, f"SELECT doc, ord, row FROM {_ROWS}"),
    "gap_threshold": (
        gap_threshold,
        f"""WITH g AS (SELECT doc, x - lag(x + 5 * length(str)) OVER (PARTITION BY doc, row ORDER BY x, ord) AS gap FROM {_ROWS}), l AS (SELECT doc, list(gap ORDER BY gap) FILTER (WHERE gap > 0) AS g FROM g GROUP BY doc)
        SELECT doc, coalesce(least(greatest(g[len(g) // 2 + 1] * 1.5, 20.0), 80.0), 30.0)::DOUBLE AS threshold FROM l""",
    ),
    "nearest_column": (
        nearest_column,
        f"""WITH c AS {w.oracle(_COLUMNS_AT).replace('`column`', 'col')}, g AS {w.oracle(w.GLYPHS)},
        n AS (SELECT g.doc, g.ord, arg_min(col, (abs(x - x0), col)) AS col, min(abs(x - x0)) AS far FROM g JOIN c ON c.doc = g.doc GROUP BY 1, 2) SELECT doc, ord, CASE WHEN far <= 20 THEN col ELSE -1 END AS col FROM n""",
    ),
}
QUERIES |= {
    "field_sheet_presence": (
        sheet_presence,
        f"""WITH a AS {w.oracle(_NAMED_FROM_0)}, b AS {w.oracle(_OTHER_FROM_0)}, n AS (SELECT doc, max(sheet_idx) + 1 AS n FROM a GROUP BY doc)
        SELECT b.doc, 'sheet_added' AS difference_type, b.sheet, '' AS other FROM b JOIN n ON n.doc = b.doc WHERE b.sheet_idx >= n.n
        UNION ALL SELECT a.doc, 'sheet_removed', a.sheet, '' FROM a WHERE a.doc IN (SELECT doc FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND (b.sheet_idx = a.sheet_idx OR b.sheet = a.sheet))
        UNION ALL SELECT a.doc, 'sheet_renamed', a.sheet, b.sheet FROM a JOIN b ON b.doc = a.doc AND b.sheet_idx = a.sheet_idx WHERE a.sheet <> b.sheet""",
    ),
    "header_diff": (
        header_diff,
        f"""WITH a AS (SELECT doc, sheet_idx AS pos, c, {sql.trim('value')} AS old FROM {_REF} WHERE r = 0), b AS (SELECT doc, sheet_idx AS pos, c, {sql.trim('value')} AS new FROM {_VER} WHERE r = 0)
        SELECT doc, pos, c, old, new FROM a JOIN b USING (doc, pos, c) WHERE old <> '' AND new <> '' AND old <> new AND NOT {sql.is_numeric('old')}""",
    ),
    "field_text_entries": (
        field_text_entries,
        f"""WITH l AS (SELECT doc, line_no AS ord, {sql.trim('line')} AS line FROM {w.oracle(_ENTRY_LINES)}), m AS (SELECT *, regexp_matches(line, $f${fields.FIELD_LINE}$f$) AS is_field FROM l WHERE line <> ''),
        e AS (SELECT doc, ord, is_field, {sql.trim(f"regexp_extract(line, $f${fields.FIELD_LINE}$f$, 1)")} AS lab, {sql.trim(f"regexp_extract(line, $f${fields.FIELD_LINE}$f$, 2)")} AS val, line, count(*) FILTER (WHERE NOT is_field) OVER (PARTITION BY doc ORDER BY ord) - 1 AS place FROM m)
        SELECT doc, ord, CASE WHEN is_field THEN {sql.normalize_key('lab')} ELSE 'text#' || place END AS key, CASE WHEN is_field THEN lab ELSE 'Text · Line ' || ord END AS label, CASE WHEN is_field THEN val ELSE line END AS value FROM e""",
    ),
    "chain_rows": (
        chain_rows,
        _FINGER
        + """SELECT account, package_name, group_label, 'xlsx' AS baseline_format, CASE pair_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'docx' ELSE 'pdf' END AS comparing_format, count(*) AS n_differences,
        'xlsx → ' || CASE pair_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'docx' ELSE 'pdf' END AS chain, 'Differences Found' AS result FROM f GROUP BY ALL""",
    ),
    "distinct_counts": (
        distinct_counts,
        f"SELECT count(DISTINCT account) AS accounts, count(DISTINCT (account, package_name)) AS packages, count(DISTINCT category) FILTER (WHERE category <> '') AS categories FROM {w.oracle(_HIERARCHY)}",
    ),
    "account_breakdown": (account_breakdown, f"SELECT account, count(*) AS n_groups FROM (SELECT DISTINCT account, package_name, category FROM {w.oracle(_HIERARCHY)}) GROUP BY 1"),
    "visible_count": (
        visible_count,
        _RULED + "SELECT group_label AS report, count(*) AS n_all, count(*) FILTER (WHERE status = 'Ignored') AS n_ignored, count(*) FILTER (WHERE status <> 'Ignored') AS n_visible FROM i GROUP BY 1",
    ),
    "issue_list": (
        issue_list,
        _RULED + "SELECT account, package_name, group_label AS report, row_number() OVER (PARTITION BY account, package_name, group_label ORDER BY diff_id)::INT AS issue, diff_id, code, severity, status FROM i",
    ),
}
