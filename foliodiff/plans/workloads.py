"""Relations derived from the star schema, as SQL that Spark and DuckDB both run. Tables are written {customer}.

EACH_n() numbers n rows from 0; LISTED[[a, b, c]] AS i, x makes a row of each expression and numbers it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A file manifest: folders, names with versions, and six kinds of file. Packages grow in number with the table, so reports have a few versions each.
MANIFEST = """
SELECT doc_id, concat('client_', CAST(doc_id % 3 AS STRING), '/pkg_', CAST(CAST(floor(doc_id / 200) AS BIGINT) AS STRING), '/', lang, '/', CASE CAST(floor(doc_id / 15) AS BIGINT) % 4 WHEN 0 THEN 'salesReport' WHEN 1 THEN 'report' WHEN 2 THEN 'q1_report' ELSE 'invoice-list' END,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE '-x' END, CASE doc_id % 5 WHEN 0 THEN '_v' WHEN 1 THEN '_final_' WHEN 2 THEN '.rev.' WHEN 3 THEN '-draft-' ELSE '_' END, CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING),
  '.', CASE doc_id % 7 WHEN 0 THEN 'docx' WHEN 1 THEN 'rtf' WHEN 2 THEN 'XLSX' WHEN 3 THEN 'csv' WHEN 4 THEN 'pdf' WHEN 5 THEN 'xls' ELSE 'txt' END) AS path,
  n_chars AS size, doc_id % 31 = 0 AS failed
FROM {documents}
"""

_ATTRIBUTES = (
    ("0", "'Customer Name'", "c.c_name"),
    ("1", "'Market Segment'", "c.c_mktsegment"),
    ("2", "'Account Balance'", "CAST(CAST(c.c_acctbal AS DECIMAL(15,2)) AS STRING)"),
    ("3", "'Nation'", "n.n_name"),
)
_FROM = "FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey"



def _case(column: str, cases: list[tuple[int | str, str]]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {x}" for k, x in cases) + " END"


#: Named values of a customer, one row an attribute: a baseline document for each pair. One scan; EACH_n() numbers rows from 0.
ITEMS_BASE = f"""
SELECT pair_id, idx, 'field_value' AS kind, {_case("idx", [(i, label) for i, label, _ in _ATTRIBUTES])} AS label, {_case("idx", [(i, f"v{i}") for i, _, _ in _ATTRIBUTES])} AS value
FROM (SELECT c.c_custkey AS pair_id, {", ".join(f"{value} AS v{i}" for i, _, value in _ATTRIBUTES)}, EACH_4() AS idx {_FROM}) each_attribute
"""

#: The same, with values changed, dropped, added, and recased by rules on the keys.
ITEMS_COMP = f"""
SELECT pair_id, idx, kind, CASE WHEN (pair_id + idx) % 5 = 0 THEN upper(label) ELSE label END AS label,
  concat(CASE WHEN (pair_id + idx) % 7 = 0 THEN lower(value) ELSE value END, CASE WHEN (4 * pair_id + idx) % 17 = 0 THEN ' revised' ELSE '' END) AS value
FROM ({ITEMS_BASE}) b WHERE (4 * pair_id + idx) % 19 <> 0
UNION ALL SELECT c_custkey, 9, 'field_value', 'Country', 'India' FROM {{customer}} WHERE c_custkey % 23 = 0
"""

#: Items of a document that repeat keys and values.
ITEMS_REPEATED = f"""
SELECT pair_id, idx, kind, label, value FROM ({ITEMS_BASE}) a
UNION ALL SELECT pair_id, idx + 4, kind, label, concat(value, CASE WHEN pair_id % 3 = 0 THEN '' ELSE ' (copy)' END) FROM ({ITEMS_BASE}) b WHERE pair_id % 2 = 0
UNION ALL SELECT pair_id, idx + 8, 'paragraph', label, concat('  ', value, '  ') FROM ({ITEMS_BASE}) c WHERE pair_id % 5 < 2
UNION ALL SELECT pair_id, idx + 12, 'paragraph', label, value FROM ({ITEMS_BASE}) d WHERE pair_id % 5 = 0
"""

_CELLS = "SELECT o_custkey AS doc, 0 AS sheet_idx, 'Orders' AS sheet, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r, o_orderkey, o_orderstatus, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS price FROM {orders}"
_COLUMNS = ((0, "'Order'", "CAST(o_orderkey AS STRING)"), (1, "'Status'", "o_orderstatus"), (2, "'Priority'", "o_orderpriority"), (3, "'Total Price'", "price"))

#: Spreadsheet cells: a header row, then the customer's orders; 0-based rows and columns.
CELLS_REF = f"""
SELECT doc, sheet_idx, sheet, r, c, {_case("c", [(c, value) for c, _, value in _COLUMNS])} AS value FROM (SELECT t.*, EACH_4() AS c FROM ({_CELLS}) t) each_cell
UNION ALL SELECT doc, sheet_idx, sheet, 0 AS r, c, {_case("c", [(c, head) for c, head, _ in _COLUMNS])} AS value
FROM (SELECT doc, sheet_idx, sheet, EACH_4() AS c FROM (SELECT DISTINCT o_custkey AS doc, 0 AS sheet_idx, 'Orders' AS sheet FROM {{orders}}) d) each_head
"""

#: The same sheets in another version: cells changed and emptied, rows dropped and added, a header renamed.
CELLS_VER = f"""
SELECT doc, sheet_idx, sheet, r, c, CASE WHEN r = 0 AND c = 1 AND doc % 11 = 0 THEN 'State' WHEN r > 0 AND (doc + r + c) % 29 = 0 THEN concat(value, '*')
  WHEN r > 0 AND (doc + r + c) % 37 = 0 THEN '' ELSE value END AS value
FROM ({CELLS_REF}) x WHERE NOT (doc % 13 = 0 AND r = 3)
UNION ALL SELECT DISTINCT doc, sheet_idx, sheet, 99, 0, 'extra' FROM ({CELLS_REF}) y WHERE doc % 17 = 0
UNION ALL SELECT DISTINCT doc, sheet_idx, sheet, 0, 4, 'Remark' FROM ({CELLS_REF}) z WHERE doc % 19 = 0
"""

#: Lines of text that state a field in one of several notations.
KV_LINES = f"""
SELECT pair_id, idx, CASE (pair_id + idx) % 6 WHEN 0 THEN concat(label, ': ', value) WHEN 1 THEN concat(label, ' = ', value) WHEN 2 THEN concat(label, '    ', value)
  WHEN 3 THEN concat('  ', label, ':   ', value, ' ') WHEN 4 THEN concat(label, ' ', value) ELSE concat('see ', lower(value)) END AS line
FROM ({ITEMS_BASE}) k
"""

#: Text items of a page with coordinates: rows of words with gaps.
GLYPHS = """
SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS ord, event_type AS str,
  CAST((event_id % 5) * 83 + (event_id % 3) AS DOUBLE) AS x, CAST(700 - 12 * floor(row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 4) + (event_id % 3) AS DOUBLE) AS y
FROM {events}
"""


def tables_in(sql: str) -> set[str]:
    return set(re.findall(r"{(\w+)}", sql))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The relation over the Parquet tables of sf_dir."""
    numbered = re.sub(r"EACH_(\d+)\(\)", lambda m: f"explode(sequence(0, {int(m[1]) - 1}))", sql)
    numbered = re.sub(r"LISTED\[\[(.*?)\]\] AS (\w+), (\w+)", r"posexplode(array(\1)) AS (\2, \3)", numbered, flags=re.S)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_in(sql)}
    if "LISTED[[" in sql:  # a row becomes many lines: a small file would leave all of them to the one task that reads it
        tables = {t: x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) for t, x in tables.items()}
    return spark.sql(numbered, **tables)


def oracle(sql: str) -> str:
    """The relation as DuckDB text, in parentheses."""
    numbered = re.sub(r"EACH_(\d+)\(\)", lambda m: f"CAST(unnest(range({m[1]})) AS INT)", sql)
    numbered = re.sub(r"LISTED\[\[(.*?)\]\] AS (\w+), (\w+)", r"CAST(generate_subscripts([\1], 1) - 1 AS INT) AS \2, unnest([\1]) AS \3", numbered, flags=re.S)
    return "(" + re.sub(r"{(\w+)}", r"\1", numbered) + ")"
