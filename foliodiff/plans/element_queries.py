"""Queries of the older engine's elements, and of smaller parts of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliodiff.functions.lines import clean_lines
from foliodiff.functions.text import stamp
from foliodiff.operators import elements, fields, grouping, rules, sheets
from foliodiff.operators.word_segments import word_segments
from foliodiff.plans import canonical_queries, compare_queries, naming_queries, report_queries, run_queries, sql
from foliodiff.plans import workloads as w


def semantic_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements.with_stated_pairs(elements.text_elements(w.frame(spark, sf_dir, canonical_queries.LINES)))


def semantic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of text documents from lines to the records of the older engine."""
    base, comp = (elements.text_elements(w.frame(spark, sf_dir, x)).withColumnRenamed("doc", "pair_id") for x in (canonical_queries.LINES, canonical_queries.LATER))
    return elements.element_records(base, comp, F.lit("docx"), F.lit("rtf"))


def sheet_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sheet_lines(w.frame(spark, sf_dir, run_queries._BOOK_LATER))


def cell_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sheets.compare_sheets(w.frame(spark, sf_dir, run_queries._BOOK), w.frame(spark, sf_dir, run_queries._BOOK_LATER))
    return sheets.cell_locations(found, w.frame(spark, sf_dir, run_queries._BOOK)).select("doc", "location_signature", "location")


def groups_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.in_order(grouping.group_documents(naming_queries._versions(spark, sf_dir))).select("number", "dir", "stem")


def enabled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_documents(naming_queries._versions(spark, sf_dir))
    switches = groups.filter("length(stem) % 3 < 2").select("dir", "stem", (F.length("stem") % 2 == 0).alias("enabled"))
    return grouping.enabled_groups(groups, switches).select("dir", "stem", "n_comparable")


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", stamp(F.timestamp_seconds(F.col("o_orderkey") * 86_399)).alias("stamp"))


def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report's differences with the hidden ones, that hold a text."""
    return rules.visible(compare_queries._judged(spark, sf_dir), search="india", group="Report 2", show_ignored=True).select("diff_id", "ignored_scope", "version_text")


def changed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fields.changed_and_kept(fields.compare_versions(w.frame(spark, sf_dir, compare_queries._VERSIONS), 3))
    return found.select("group_id", "key", "n", F.concat_ws(",", "changed").alias("changed"), F.concat_ws(",", "kept").alias("kept"))


def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents and another version of each: words left out, changed, and put in."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pair_id"), F.posexplode(clean_lines(F.col("text"))).alias("line", "old"))
    words = F.split("old", " ")
    changed = F.transform(words, lambda x, i: F.when((i + F.col("pair_id")) % 13 == 5, F.upper(x)).when((i + F.col("pair_id")) % 19 == 7, F.concat(x, F.lit(" more"))).otherwise(x))
    return word_segments(lines.withColumn("new", F.array_join(F.filter(changed, lambda x, i: (i + F.col("pair_id")) % 17 != 3), " ")))


def _elements(relation: str) -> str:
    """CTEs up to el(doc, idx, kind, key, label, value, location), prose that states fields as fields."""
    key_value, colon, equals = "^([A-Za-z][A-Za-z0-9 _/().\\-&''*]+)[ \\t]*[:=][ \\t]*(.+)$", "^([A-Za-z][A-Za-z0-9 _/().\\-&''*]+?)[ \\t]*:[ \\t]*(.+)$", "^([A-Za-z][A-Za-z0-9 _/().\\-&''*]+?)[ \\t]*=[ \\t]*(.+)$"
    group = lambda x, form, k: sql.trim(f"regexp_extract({x}, '{form}', {k})")
    name = lambda x: f"(length({x}) BETWEEN 1 AND 29 AND regexp_full_match({x}, '[A-Za-z][A-Za-z ]*'))"
    heading, item = "^#{1,6}[ \\t]+(.+)$", "^[-•*][ \\t]+(.+)$"
    return f"""
x0 AS (SELECT doc, line, {sql.trim('line')} AS t, row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1 AS p FROM {relation}),
x1 AS (SELECT *, lead(t) OVER (PARTITION BY doc ORDER BY p) AS below, count(*) OVER (PARTITION BY doc) AS n FROM x0),
st AS (SELECT doc, min(p) AS s FROM x1 a WHERE {name('t')} AND {name('below')} AND p + 3 < n AND NOT EXISTS (SELECT 1 FROM x1 b WHERE b.doc = a.doc AND b.p >= a.p + 2 AND (b.p - a.p) % 2 = 0 AND b.below IS NOT NULL
  AND (b.t = '' OR b.below = '' OR length(b.t) > 50 OR regexp_full_match(b.t, '[0-9.]+'))) GROUP BY doc),
x2 AS (SELECT x1.doc, p, CASE WHEN p >= s AND below IS NOT NULL THEN t || ' | ' || below ELSE line END AS line FROM x1 LEFT JOIN st ON st.doc = x1.doc WHERE s IS NULL OR p < s OR (p - s) % 2 = 0),
x3 AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY p) AS p, {sql.trim('line')} AS t, list_transform(string_split({sql.trim('line')}, '|'), lambda x: {sql.trim('x')}) AS c FROM x2),
x4 AS (SELECT *, len(list_filter(c, lambda x: x <> '')) >= 2 AS tab FROM x3),
x5 AS (SELECT *, tab AND NOT coalesce(lag(tab) OVER (PARTITION BY doc ORDER BY p), false) AND len(list_filter(c, lambda x: NOT regexp_matches(x, '^[A-Za-z]'))) = 0 AS head FROM x4),
x6 AS (SELECT *, CASE WHEN head THEN 'header' WHEN tab THEN CASE WHEN c[1] <> '' AND c[2] <> '' THEN 'row' END WHEN t = '' OR regexp_full_match(t, '[|+:-]+') THEN NULL WHEN regexp_matches(t, '{heading}') THEN 'heading'
  WHEN regexp_matches(t, '{item}') THEN 'list_item' WHEN regexp_matches(t, '{key_value}') THEN 'field' ELSE 'prose' END AS shape FROM x5),
x7 AS (SELECT *, (row_number() OVER o - 1)::INT AS idx, count(*) FILTER (WHERE shape IN ('header', 'list_item', 'prose')) OVER o - 1 AS k FROM x6 WHERE shape IS NOT NULL WINDOW o AS (PARTITION BY doc ORDER BY tab DESC, p)),
x8 AS (SELECT doc, idx, shape, k, 'Line ' || p AS location, CASE WHEN shape IN ('row', 'field') THEN 'key_value' WHEN shape IN ('header', 'prose') THEN 'prose' ELSE shape END AS kind,
  CASE shape WHEN 'row' THEN c[1] WHEN 'field' THEN {group('t', key_value, 1)} WHEN 'list_item' THEN 'List item · Line ' || p WHEN 'header' THEN array_to_string(c, ' | ') ELSE t END AS label,
  CASE shape WHEN 'row' THEN c[2] WHEN 'field' THEN {group('t', key_value, 2)} WHEN 'list_item' THEN {group('t', item, 1)} WHEN 'heading' THEN {group('t', heading, 1)} WHEN 'header' THEN array_to_string(c, ' | ') ELSE t END AS value FROM x7),
x9 AS (SELECT *, CASE shape WHEN 'header' THEN 'header#' || k WHEN 'list_item' THEN 'list#' || k WHEN 'prose' THEN 'text#' || k WHEN 'heading' THEN {sql.normalize_key('value')} ELSE {sql.normalize_key('label')} END AS key,
  list_filter(list_transform(string_split(value, '|'), lambda x: {sql.trim('x')}), lambda x: x <> '') AS parts FROM x8),
xa AS (SELECT *, CASE WHEN kind <> 'prose' THEN NULL WHEN contains(value, '|') THEN CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda x: NOT (length(x) < 30 AND regexp_matches(x, '^[A-Za-z]') AND NOT regexp_matches(x, '[0-9]')))) > 0 THEN [parts[1], parts[2]] END
  WHEN regexp_matches(value, '{colon}') THEN [{group('value', colon, 1)}, {group('value', colon, 2)}] WHEN regexp_matches(value, '{equals}') THEN [{group('value', equals, 1)}, {group('value', equals, 2)}] END AS s FROM x9),
el AS (SELECT doc, idx, CASE WHEN s IS NULL THEN kind ELSE 'key_value' END AS kind, CASE WHEN s IS NULL THEN key ELSE {sql.normalize_key('s[1]')} END AS key, coalesce(s[1], label) AS label, coalesce(s[2], value) AS value, location FROM xa)"""


_BOTH_ELEMENTS = f"WITH {_elements(w.oracle(run_queries._BOTH))}"
_SIDE = "(SELECT doc // 2 AS pair_id, idx, kind, label, value FROM el WHERE doc % 2 = {v})"
_OLDER = f"""
{_BOTH_ELEMENTS},
{report_queries._matching(_SIDE.format(v=0), _SIDE.format(v=1)).strip()},
j AS (SELECT t.*, b AS b, c AS c FROM told t LEFT JOIN el b ON b.doc = 2 * t.pair_id AND b.idx = CASE t.side WHEN 'base' THEN t.idx END LEFT JOIN el c ON c.doc = 2 * t.pair_id + 1 AND c.idx = CASE t.side WHEN 'base' THEN t.partner ELSE t.idx END
  WHERE t.status <> 'identical' AND (t.side = 'base' OR t.status = 'added'))
SELECT pair_id, side, idx, CASE WHEN status = 'missing' THEN 'missing_content' WHEN status = 'added' THEN 'added_content' WHEN b.kind IN ('key_value', 'heading') THEN 'value_mismatch' ELSE 'text_changed' END AS difference_type,
  CASE status WHEN 'missing' THEN 'missing|' || b.key WHEN 'added' THEN 'added|' || c.key ELSE 'semantic|' || b.key || '|' || b.location END AS location_signature, coalesce(b.label, c.label) AS location_label, coalesce(b.value, '') AS reference_text, coalesce(c.value, '') AS version_text,
  CASE WHEN status = 'missing' THEN 'The baseline DOCX contains the field "' || b.label || '" with the value "' || b.value || '" at ' || b.location || '. The comparing RTF does not contain this content. Because the content is missing from the comparing document, this difference has been classified as MISSING_CONTENT.'
    WHEN status = 'added' THEN 'The comparing RTF contains the field "' || c.label || '" with the value "' || c.value || '" at ' || c.location || ' that is not present in the baseline DOCX. This is classified as ADDED_CONTENT.'
    WHEN b.kind IN ('key_value', 'heading') THEN 'The baseline DOCX contains the field "' || b.label || '" with the value "' || b.value || '". The comparing RTF contains the same field with the value "' || c.value || '". Since the values are different, this has been identified as a VALUE_MISMATCH. Baseline location: ' || b.location || '. Comparing location: ' || c.location || '.'
    ELSE 'The baseline DOCX contains the text "' || b.value || '" at ' || b.location || '. The comparing RTF contains "' || c.value || '" at ' || c.location || '. The text content differs.' END AS description FROM j
"""
_NWAY = compare_queries.QUERIES["field_nway"][1]

QUERIES = {
    "semantic_elements": (semantic_elements, f"WITH {_elements(w.oracle(canonical_queries.LINES))} SELECT * FROM el"),
    "semantic_records": (semantic_records, _OLDER),
    "aligned_words": (aligned_words, None),  # tested against a plain longest common subsequence
    "sheet_text_lines": (
        sheet_text_lines,
        f"""WITH v AS (SELECT * FROM {w.oracle(run_queries._BOOK_LATER)}), e AS (SELECT doc, sheet_idx, sheet, r, max(c) AS last FROM v WHERE value <> '' GROUP BY ALL), z AS (SELECT doc, sheet_idx, sheet, unnest(range(0, m + 1)) AS r FROM (SELECT doc, sheet_idx, sheet, max(r) AS m FROM e GROUP BY ALL)),
        g AS (SELECT z.*, last, unnest(range(0, coalesce(last, 0) + 1)) AS c FROM z LEFT JOIN e USING (doc, sheet_idx, sheet, r)),
        l AS (SELECT g.doc, g.sheet_idx, g.sheet, g.r, string_agg(CASE WHEN g.last IS NULL THEN '' ELSE coalesce(v.value, '') END, chr(9) ORDER BY g.c) AS line FROM g LEFT JOIN v ON v.doc = g.doc AND v.sheet_idx = g.sheet_idx AND v.sheet = g.sheet AND v.r = g.r AND v.c = g.c GROUP BY ALL
          UNION ALL SELECT DISTINCT doc, sheet_idx, sheet, -1, '[' || sheet || ']' FROM v)
        SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY sheet_idx, sheet, r) - 1)::INT AS line_no, line FROM l""",
    ),
    "cell_locations": (
        cell_locations,
        f"""WITH k AS (SELECT * FROM ({run_queries._RECORDS})), f AS (SELECT doc, sheet, r, c, arg_min({sql.trim('value')}, sheet_idx) AS t FROM {run_queries._A} WHERE {sql.trim('value')} <> '' GROUP BY ALL),
        a AS (SELECT k.*, regexp_extract(address, '[0-9]+')::INT - 1 AS r, ascii(address[1]) - 65 AS c FROM k),
        m AS (SELECT doc, sheet, r, arg_min(t, c) AS t FROM f GROUP BY ALL)
        SELECT a.doc, location_signature, CASE WHEN difference_type = 'cell_changed' THEN a.sheet || ' → ' || coalesce(h.t, m.t, address) ELSE location_label END AS location
        FROM a LEFT JOIN f h ON h.doc = a.doc AND h.sheet = a.sheet AND h.r = 0 AND h.c = a.c LEFT JOIN m ON m.doc = a.doc AND m.sheet = a.sheet AND m.r = a.r""",
    ),
    "groups_in_order": (groups_in_order, naming_queries._GROUPS + "SELECT row_number() OVER (ORDER BY dir, s) AS number, dir, s AS stem FROM ordered GROUP BY dir, s"),
    "enabled_groups": (
        enabled_groups,
        naming_queries._GROUPS + "SELECT dir, s AS stem, (count(*) FILTER (WHERE NOT failed))::INT AS n_comparable FROM ordered WHERE length(s) % 3 = 2 OR length(s) % 2 = 0 GROUP BY dir, s HAVING count(*) FILTER (WHERE NOT failed) >= 2",
    ),
    "stamps": (stamps, "SELECT o_orderkey, strftime(epoch_ms(o_orderkey * 86399000), '%Y-%m-%d-%H-%M-%S') AS stamp FROM orders"),
    "explorer": (
        explorer,
        compare_queries._RULED + "SELECT diff_id, ignored_scope, version_text FROM j WHERE group_label = 'Report 2' AND contains(lower(concat_ws(chr(10), group_label, location_label, reference_text, version_text)), 'india')",
    ),
    "changed_versions": (
        changed_versions,
        f"""SELECT group_id, key, n, concat_ws(',', CASE WHEN k[1] <> 'unchanged' THEN 1 END, CASE WHEN k[2] <> 'unchanged' THEN 2 END) AS changed, concat_ws(',', CASE WHEN k[1] = 'unchanged' THEN 1 END, CASE WHEN k[2] = 'unchanged' THEN 2 END) AS kept
        FROM (SELECT *, string_split(kinds, '|') AS k FROM ({_NWAY}))""",
    ),
}
