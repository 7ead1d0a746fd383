"""The scalar functions of foliodiff.functions as DuckDB expressions, for the oracles."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def trim(x: str) -> str:
    return f"trim({x}, {WHITE})"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def normalize_text(x: str) -> str:
    x = sub(x, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", "")
    x = sub(x, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " ")
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = sub(x, r"[ \t\f\v]+", " ")
    return trim(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def normalize_key(x: str) -> str:
    return f"trim({sub(f'lower({trim(x)})', '[^a-z0-9]+', ' ')})"


def equality_key(x: str) -> str:
    return f"trim({sub(f'lower({sub(normalize_text(x), chr(92) + chr(124), chr(32))})', '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'v]+', ' ')})"


def aggressive(x: str) -> str:
    return f"trim({sub(f'lower({x})', '[|;,\\-_:=/\\\\ \\t\\n\\r\\f\\v]+', ' ')})"


def token_key(x: str) -> str:
    return f"list_sort(list_filter(string_split({aggressive(x)}, ' '), lambda t: t <> ''))"


def normalize_for_hash(x: str) -> str:
    return sub(f"lower({trim(x)})", r"[ \t\n\r\f\v]+", " ")


def hash_of(kind: str, x: str) -> str:
    return f"sha256('{kind}|' || {normalize_for_hash(x)})"


def is_numeric(x: str) -> str:
    return f"regexp_full_match({trim(x)}, '[-+]?[0-9]*\\.?[0-9]+([eE][-+]?[0-9]+)?')"


def column_letters(c: str) -> str:
    return f"CASE WHEN {c} < 26 THEN chr((65 + {c})::INT) WHEN {c} < 702 THEN chr((64 + {c} // 26)::INT) || chr((65 + {c} % 26)::INT) ELSE chr((65 + ({c} - 702) // 676)::INT) || chr((65 + (({c} - 702) // 26) % 26)::INT) || chr((65 + {c} % 26)::INT) END"


def cell_address(r: str, c: str) -> str:
    return f"({column_letters(c)} || ({r} + 1)::VARCHAR)"


def sheet_claims(ref: str, ver: str) -> str:
    """WITH ... claims: which sheet of ver each sheet of ref claims, one after the other."""
    return f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sheet_idx) AS k FROM (SELECT DISTINCT doc, sheet_idx, sheet FROM {ref})),
b AS (SELECT doc, list({{'i': sheet_idx, 's': sheet}} ORDER BY sheet_idx) AS others FROM (SELECT DISTINCT doc, sheet_idx, sheet FROM {ver}) GROUP BY doc),
w(doc, k, taken, named, sheet_idx, sheet, f, how) AS (
  SELECT doc, 0::BIGINT, []::INT[], []::VARCHAR[], NULL::INT, NULL::VARCHAR, NULL::STRUCT(i INT, s VARCHAR), NULL::VARCHAR FROM a WHERE k = 1
  UNION ALL SELECT doc, k, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f.i) END, CASE WHEN byname IS NULL THEN named ELSE list_append(named, sheet) END, sheet_idx, sheet, f, CASE WHEN f IS NULL THEN 'removed' WHEN f.s = sheet THEN 'same' ELSE 'renamed' END FROM (
    SELECT *, coalesce(byname, list_filter(free, lambda o: o.i = sheet_idx)[1]) AS f FROM (
      SELECT *, list_filter(free, lambda o: o.s = sheet AND NOT list_contains(named, o.s))[1] AS byname FROM (
        SELECT a.doc, a.k, w.taken, w.named, a.sheet_idx, a.sheet, list_filter(coalesce(b.others, []), lambda o: NOT list_contains(w.taken, o.i)) AS free FROM w JOIN a ON a.doc = w.doc AND a.k = w.k + 1 LEFT JOIN b ON b.doc = a.doc)))),
n AS (SELECT doc, count(*) AS n FROM a GROUP BY doc), last AS (SELECT doc, arg_max(taken, k) AS taken FROM w GROUP BY doc),
extra AS (SELECT doc, unnest(list_filter(others, lambda o: NOT list_contains(coalesce(taken, []), o.i) AND o.i >= coalesce(n, 0))) AS o FROM b LEFT JOIN last USING (doc) LEFT JOIN n USING (doc)),
claims AS (SELECT doc, sheet_idx, sheet, f.i AS other_idx, coalesce(f.s, '') AS other, how FROM w WHERE k > 0 UNION ALL SELECT doc, NULL, '', o.i, o.s, 'added' FROM extra)
"""


def residue(base: str, comp: str) -> str:
    """CTEs (behind WITH RECURSIVE) up to matched(pair_id, phase, base_idx, comp_idx, identical): all pairs of rows that pass a phase, taken one after the other.

    closed holds what was taken: c for a version row, b for a baseline row, p for one that parts claimed, q for such a part.
    """

    def side(rel: str) -> str:
        return f"""SELECT pair_id, idx, kind IN ('field_value', 'heading') AS is_field, kind IN ('paragraph', 'list_item') AS is_prose, {normalize_key("coalesce(label, '')")} AS key, coalesce(value, '') AS value,
  lower({normalize_text("coalesce(value, '')")}) AS low, {equality_key("coalesce(value, '')")} AS eq FROM {rel}"""

    cells = lambda x: f"list_filter(list_transform(string_split({x}, '|'), lambda y: {trim('y')}), lambda y: y <> '')"
    plain = "NOT contains(p.value, '|') AND NOT contains(p.value, ':')"
    named = "f.key <> '' AND contains(p.low, f.key)"
    said = f"NOT contains(p.value, '|') AND length(p.low) <= 120 AND (p.low = f.low OR ({named}))"
    row = f"contains(p.value, '|') AND NOT contains(p.value, ':') AND len({cells('p.value')}) >= 2 AND {normalize_key(cells('p.value') + '[1]')} = f.key AND {equality_key(cells('p.value') + '[2]')} = f.eq"
    ends = "f.low <> '' AND suffix(p.low, f.low)"
    to_field, to_prose = "bs p JOIN cs f ON f.pair_id = p.pair_id AND p.is_prose AND f.is_field", "bs f JOIN cs p ON f.pair_id = p.pair_id AND p.is_prose AND f.is_field"

    def edge(rank: int, phase: str, a: str, b: str, c: str, source: str, test: str, z: str | None = None, part: str = "0") -> str:
        return f"SELECT {a}.pair_id, {rank} AS rank, '{phase}' AS phase, {z or b}.idx AS a, {part}::BIGINT AS part, {c if (z or b) == b else b}.idx AS z, {b}.idx AS bi, {c}.idx AS ci FROM {source} WHERE {test}"

    edges = [
        edge(0, "value", "p", "p", "f", "bs p JOIN cs f ON f.pair_id = p.pair_id AND f.eq = p.eq", "NOT (p.is_field AND f.is_field)"),
        edge(1, "prose_says_field", "p", "p", "f", to_field, said),
        edge(1, "pipe_parts_say_fields", "p", "p", "f", f"(SELECT pair_id, idx, unnest({cells('low')}) AS x, generate_subscripts({cells('low')}, 1) AS n FROM bs WHERE is_prose AND contains(value, '|')) p JOIN cs f ON f.pair_id = p.pair_id AND f.is_field",
             "p.x = f.low OR (f.low <> '' AND f.key <> '' AND contains(p.x, f.low) AND contains(p.x, f.key))", part="p.n"),
        edge(2, "prose_is_label", "p", "p", "f", to_field, f"regexp_matches(p.value, '[A-Za-z]:\\s*$') AND {normalize_key('p.value')} = f.key"),
        edge(3, "field_said_by_prose", "p", "f", "p", to_prose, said, z="p"),
        edge(4, "pipe_row_is_field", "p", "p", "f", to_field, row),
        edge(5, "field_is_pipe_row", "p", "f", "p", to_prose, row),
        edge(6, "prose_ends_in_field", "p", "p", "f", to_field, f"{plain} AND f.low <> '' AND (p.low = f.low OR ({named} AND (({ends}) OR p.low = f.key)))"),
        edge(7, "field_ends_prose", "p", "f", "p", to_prose, f"{plain} AND (({ends}) OR (f.key <> '' AND p.low = f.key))"),
    ]
    return f"""
bs AS ({side(base)}), cs AS ({side(comp)}),
edges AS ({" UNION ALL ".join(edges)}),
todo AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rank, a, part, z) AS k FROM edges),
taking(pair_id, k, closed, took) AS (
  SELECT DISTINCT pair_id, 0::BIGINT, []::VARCHAR[], false FROM todo
  UNION ALL SELECT pair_id, k, CASE WHEN took THEN closed || ['c' || ci] || CASE WHEN part > 0 THEN ['p' || bi, 'q' || bi || '/' || part] ELSE ['b' || bi] END ELSE closed END, took FROM (
    SELECT t.*, closed, NOT list_contains(closed, 'c' || ci) AND NOT list_contains(closed, 'b' || bi) AND CASE WHEN part > 0 THEN NOT list_contains(closed, 'q' || bi || '/' || part) ELSE NOT list_contains(closed, 'p' || bi) END AS took
    FROM taking w JOIN todo t ON t.pair_id = w.pair_id AND t.k = w.k + 1)),
matched AS (SELECT t.pair_id, phase, bi AS base_idx, ci AS comp_idx, phase <> 'prose_is_label' AS identical FROM taking w JOIN todo t ON t.pair_id = w.pair_id AND t.k = w.k WHERE took)
"""
