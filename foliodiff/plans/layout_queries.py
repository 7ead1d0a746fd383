"""Queries of page lines and of sheets that list fields in one or two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliodiff.operators import layout, sheets
from foliodiff.plans import sql
from foliodiff.plans import workloads as w

_PAIRS = f"""
SELECT pair_id AS doc, 0 AS sheet_idx, 'Fields' AS sheet, CAST(idx + 1 AS INT) AS r, 0 AS c, label AS value FROM ({w.ITEMS_BASE}) a
UNION ALL SELECT pair_id, 0, 'Fields', CAST(idx + 1 AS INT), 1, CASE WHEN (pair_id + idx) % 7 = 0 THEN ' ' ELSE value END FROM ({w.ITEMS_BASE}) b
UNION ALL SELECT c_custkey, 0, 'Fields', 0, 0, CASE WHEN c_custkey % 3 = 0 THEN 'Name' WHEN c_custkey % 3 = 1 THEN 'FIELD' ELSE 'Field' END FROM {{customer}}
UNION ALL SELECT c_custkey, 0, 'Fields', 0, 1, ' value ' FROM {{customer}}
"""

_COLUMN = f"""
SELECT pair_id AS doc, 0 AS sheet_idx, 'List' AS sheet, CAST(idx * 3 AS INT) AS r, 0 AS c, label AS value FROM ({w.ITEMS_BASE}) a
UNION ALL SELECT pair_id, 0, 'List', CAST(idx * 3 + 1 AS INT), 0, value FROM ({w.ITEMS_BASE}) b
UNION ALL SELECT pair_id, 0, 'List', CAST(idx * 3 + 2 AS INT), 0, CASE (pair_id + idx) % 4 WHEN 0 THEN concat(label, ' : ', value) WHEN 1 THEN '' WHEN 2 THEN upper(label) ELSE concat(label, ' | ', value) END FROM ({w.ITEMS_BASE}) d
UNION ALL SELECT c_custkey, 0, 'List', 1, 1, 'second column' FROM {{customer}} WHERE c_custkey % 10 = 0
"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_lines(w.frame(spark, sf_dir, w.GLYPHS))


def sheet_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.pair_table_items(w.frame(spark, sf_dir, _PAIRS)).select("doc", "r", "key", "label", "value")


def sheet_single_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.single_column_items(w.frame(spark, sf_dir, _COLUMN)).select("doc", "r", "kind", "key", "label", "value")


_PAIR_ROWS = f"(SELECT doc, r, max({sql.trim('value')}) FILTER (c = 0) AS label, max({sql.trim('value')}) FILTER (c = 1) AS value FROM {w.oracle(_PAIRS)} WHERE {sql.trim('value')} <> '' GROUP BY doc, r)"

# Recursion row by row, unlike the windows of the operator.
_COLUMN_SQL = rf"""
WITH RECURSIVE cells AS MATERIALIZED (
  SELECT doc, r, c, {sql.trim("value")} AS value FROM {w.oracle(_COLUMN)} WHERE {sql.trim("value")} <> ''),
rows AS MATERIALIZED (SELECT doc, r, value FROM cells WHERE doc NOT IN (SELECT doc FROM cells WHERE c > 0)),
judged AS MATERIALIZED (
  SELECT a.doc, a.r, a.value, b.value AS below, length(a.value) < 30 AND regexp_full_match(a.value, '[A-Za-z]+( [A-Za-z]+)*')
    AND coalesce(length(b.value) < 50 AND NOT contains(b.value, ':') AND NOT contains(b.value, '|'), false) AS starts
  FROM rows a LEFT JOIN rows b ON b.doc = a.doc AND b.r = a.r + 1),
walk AS (
  SELECT *, starts AS label, false AS used FROM judged WHERE r = 0
  UNION ALL SELECT j.doc, j.r, j.value, j.below, j.starts, j.starts AND NOT (k.label AND j.r = k.r + 1), k.label AND j.r = k.r + 1
  FROM walk k JOIN judged j ON j.doc = k.doc AND j.r = (SELECT min(n.r) FROM judged n WHERE n.doc = k.doc AND n.r > k.r)),
told AS (
  SELECT *, NOT label AND regexp_matches(value, '^[A-Za-z][A-Za-z0-9 _/().&''*-]+?[ \t]*:[ \t]*.') AS colon FROM walk WHERE NOT used)
SELECT doc, r, CASE WHEN label OR colon THEN 'field_value' ELSE 'table_cell' END AS kind,
  CASE WHEN label THEN {sql.normalize_key("value")} WHEN colon THEN {sql.normalize_key("split_part(value, ':', 1)")} ELSE 'cell_' || r || '_0' END AS key,
  CASE WHEN label THEN value WHEN colon THEN trim(split_part(value, ':', 1)) ELSE 'A' || (r + 1) END AS label,
  CASE WHEN label THEN below WHEN colon THEN trim(substr(value, strpos(value, ':') + 1)) ELSE value END AS value
FROM told
"""

QUERIES = {
    "page_lines": (page_lines, None),  # first fit of columns: tested against a plain page scan
    "sheet_pair_table": (
        sheet_pair_table,
        f"SELECT doc, r, {sql.normalize_key('label')} AS key, label, value FROM {_PAIR_ROWS} WHERE r > 0 AND label IS NOT NULL AND value IS NOT NULL"
        f" AND doc IN (SELECT doc FROM {_PAIR_ROWS} WHERE r = 0 AND lower(label) = 'field' AND lower(value) = 'value')",
    ),
    "sheet_single_column": (sheet_single_column, _COLUMN_SQL),
}
