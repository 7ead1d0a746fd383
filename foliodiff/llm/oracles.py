"""DuckDB SQL of the contract queries, over whole tables."""

from __future__ import annotations

from . import quality_rules as q
from . import url_filter as u
from .common import LOWER, UPPER

_W = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*q.STOP_WORDS, *(w.capitalize() for w in q.STOP_WORDS)}))
_PACKED = r"regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g')"


def _rule(r: q.Rule) -> str:
    value = r.measure.replace("try_divide(", "(").replace(", ", "::DOUBLE / ")
    sides = [f"{value} < {r.low}"] * (r.low is not None) + [f"{value} > {r.high}"] * (r.high is not None)
    return f"(n_words < {r.min_words} OR NOT coalesce({' OR '.join(sides)}, false))"


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS w, {_PACKED} AS packed FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls FROM w),
g AS (SELECT doc_id, i, w[i:i + 4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
s AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(packed)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
    (length(packed) - length(regexp_replace(packed, '[A-Z]', '', 'g')))::BIGINT AS n_upper
  FROM l LEFT JOIN c ON c.doc_id = l.doc_id
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {" AND ".join(_rule(r) for r in q.RULES)} AS passed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept FROM b
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_W} AS w FROM documents),
g AS (SELECT doc_id, i, hash(w[i:i + 19]) AS a, md5_number(array_to_string(w[i:i + 19], ' ')) AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(20)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_WL = _W.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")
NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WL} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1]) AS a, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT doc_id, hash(w[1]), w[1] FROM w WHERE len(w) = 1
), ranked AS (
  -- rarest shingles first: two sets that are linked share one of the first n - ceil(0.8 n) + 1
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, a, g) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, count(*) OVER (PARTITION BY a, g) AS f FROM s)
), first AS (SELECT doc_id, a, g, n FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT x.doc_id AS p, y.doc_id AS q, x.n AS np, y.n AS nq FROM first x JOIN first y ON x.a = y.a AND x.g = y.g AND x.doc_id < y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
shared AS (SELECT p, q, np, nq, count(*) AS k FROM cand JOIN s x ON x.doc_id = p JOIN s y ON y.doc_id = q AND y.a = x.a AND y.g = x.g GROUP BY ALL),
link AS (SELECT p, q FROM shared WHERE 100 * k >= 80 * (np + nq - k)),
edge AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
reach(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.q, r.c FROM reach r JOIN edge e ON e.p = r.v WHERE r.c < e.q),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, comp.c = d.doc_id AS kept
FROM documents d JOIN comp ON comp.v = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) n ON n.doc_id = d.doc_id
"""


def _url_filter() -> str:
    n = u.N
    host = f"translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
    path = "coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '')"
    whens = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in whens) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in whens) + " END"
    smooth = "\n".join(
        f"""n0{k} AS (SELECT c, sum({k}) AS n FROM counts GROUP BY c), z{k} AS (SELECT sum(n) AS t, count(*) FILTER (WHERE n > 0) AS u FROM n0{k}),
n1{k} AS (SELECT h1, c, sum({k}) AS n FROM counts GROUP BY h1, c), t1{k} AS (SELECT h1, sum(n) AS t, count(*) FILTER (WHERE n > 0) AS u FROM n1{k} GROUP BY h1),
t2{k} AS (SELECT h2, h1, sum({k}) AS t, count(*) FILTER (WHERE {k} > 0) AS u FROM counts GROUP BY h2, h1),
p{k} AS (SELECT g.idx, (coalesce(x.{k}, 0) + (coalesce(t2{k}.u, 0) + 1) * ((coalesce(n1{k}.n, 0) + (coalesce(t1{k}.u, 0) + 1) * ((coalesce(n0{k}.n, 0) + coalesce(z{k}.u, 0) / {n} + 1 / {n}) / (coalesce(z{k}.t, 0) + coalesce(z{k}.u, 0) + 1)))
    / (coalesce(t1{k}.t, 0) + coalesce(t1{k}.u, 0) + 1))) / (coalesce(t2{k}.t, 0) + coalesce(t2{k}.u, 0) + 1) AS p
  FROM (SELECT DISTINCT idx, c, h1, h2 FROM gram) g CROSS JOIN z{k} LEFT JOIN counts x ON x.idx = g.idx LEFT JOIN n0{k} ON n0{k}.c = g.c LEFT JOIN n1{k} ON n1{k}.h1 = g.h1 AND n1{k}.c = g.c
    LEFT JOIN t1{k} ON t1{k}.h1 = g.h1 LEFT JOIN t2{k} ON t2{k}.h2 = g.h2 AND t2{k}.h1 = g.h1),"""
        for k in ("yes", "no")
    )
    return f"""
WITH a AS (SELECT page_id, {host} AS host, {path} AS path FROM pages),
b AS (SELECT *, {rule} AS rule, {said} AS said, {said} = 'allow' AS ok, left(md5(host || path), 1) > '3' AS counted, translate(host || path, '{UPPER}', '{LOWER}') AS t FROM a),
coded AS (SELECT page_id, ok, counted, length(t) AS size, [0, 0] || list_transform(list_filter(string_split(t, ''), lambda x: x <> ''), lambda x: instr('{u.ALPHABET}', x) % {n}) AS k FROM b),
gram AS (SELECT page_id, ok, counted, k[i - 2] AS h2, k[i - 1] AS h1, k[i] AS c, (k[i - 2] * {n} + k[i - 1]) * {n} + k[i] AS idx FROM (SELECT *, unnest(range(3, len(k) + 1)) AS i FROM coded)),
counts AS (SELECT idx, h2, h1, c, count(*) FILTER (WHERE ok) AS yes, count(*) FILTER (WHERE NOT ok) AS no FROM gram WHERE ok IS NOT NULL AND counted GROUP BY ALL),
{smooth}
score AS (SELECT page_id, sum(ln(pyes.p / pno.p)) AS s FROM gram JOIN pyes ON pyes.idx = gram.idx JOIN pno ON pno.idx = gram.idx GROUP BY page_id),
v AS (SELECT coded.page_id, ok, counted, coalesce(s, 0) / greatest(size, 1) AS s FROM coded LEFT JOIN score ON score.page_id = coded.page_id),
m AS (SELECT avg(s) FILTER (WHERE ok) AS a, avg(s) FILTER (WHERE NOT ok) AS r, stddev_pop(s) FILTER (WHERE ok) AS sa, stddev_pop(s) FILTER (WHERE NOT ok) AS sr FROM v WHERE NOT counted),
seen AS (SELECT bool_or(ok) AND bool_or(NOT ok) AS two FROM v WHERE counted AND ok IS NOT NULL),
threshold AS (SELECT CASE WHEN two THEN coalesce(CASE WHEN sa + sr > 0 THEN (a * sr + r * sa) / (sa + sr) ELSE (a + r) / 2 END, 0) ELSE '-inf'::DOUBLE END AS h FROM m CROSS JOIN seen)
SELECT b.page_id, b.host, b.path, rule, coalesce(said, CASE WHEN v.s < h THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN v ON v.page_id = b.page_id CROSS JOIN threshold
"""


URL_FILTER = _url_filter()

_NORMAL = r"trim(regexp_replace(lower({x}), '[ \t\n\v\f\r]+', ' ', 'g'))"
_QUOTE = r"'^[ \t]*>[> \t]*'"
_UNITS = "list_filter(list_distinct([{whole}] || list_transform({lines}, lambda x: {one})), lambda x: length(x) > 0)"

QUOTATION_LINKING = f"""
WITH RECURSIVE msg AS (SELECT row_number() OVER () AS m, conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
split AS (SELECT m, conv_id, turn, unnest(string_split_regex(t, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(t, '\\r?\\n'), 1) AS i FROM msg),
line AS (SELECT m, conv_id, turn, i, length(regexp_replace(regexp_extract(x, {_QUOTE}), '[^>]', '', 'g')) AS level, regexp_replace(x, {_QUOTE}, '') AS x FROM split),
mark AS (SELECT *, level = 0 AND NOT (regexp_matches(x, '(?i)(wrote|schrieb|a écrit|escribió)\\s*:\\s*$') AND coalesce(lead(level) OVER o, 0) > 0) AS own, (level <> coalesce(lag(level) OVER o, -1))::INT AS fresh FROM line WINDOW o AS (PARTITION BY m ORDER BY i)),
body AS (SELECT m, any_value(conv_id) AS conv_id, any_value(turn) AS turn, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE own), ''), '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS body FROM mark GROUP BY m),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY m ORDER BY i) AS run FROM mark),
passage AS (SELECT m, conv_id, turn, run, min(level) AS level, list(x ORDER BY i) AS ls FROM run WHERE level > 0 GROUP BY m, conv_id, turn, run HAVING bool_or({_NORMAL.format(x='x')} <> '')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY run) AS p, array_to_string(ls, chr(10)) AS whole FROM passage),
counted AS (SELECT m, count(*) AS n_quotes, max(level) AS max_level FROM numbered GROUP BY m),
original AS (SELECT conv_id, unit, min(turn) AS original FROM (SELECT conv_id, turn, unnest({_UNITS.format(whole=_NORMAL.format(x='body'), lines="string_split(body, chr(10))", one=_NORMAL.format(x='x'))}) AS unit FROM body WHERE conv_id IS NOT NULL AND turn IS NOT NULL) GROUP BY 1, 2),
unit AS (SELECT conv_id, turn, p, whole, level, unnest({_UNITS.format(whole=_NORMAL.format(x='whole'), lines='ls', one=_NORMAL.format(x='x'))}) AS unit FROM numbered WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
weighed AS (SELECT u.conv_id, u.turn, p, whole, level, CASE WHEN original < u.turn THEN original END AS original, sum(length(u.unit)) AS weight FROM unit u LEFT JOIN original o ON o.conv_id = u.conv_id AND o.unit = u.unit GROUP BY ALL),
link AS (SELECT conv_id, turn, p, whole, level, arg_max(original, (weight, original)) FILTER (WHERE original IS NOT NULL) AS original FROM weighed GROUP BY ALL),
reply AS (SELECT conv_id, turn, arg_max(original, (-level, original)) FILTER (WHERE original IS NOT NULL) AS parent_turn, count(original) AS n_linked FROM link GROUP BY 1, 2),
up(conv_id, turn, at_turn, depth) AS (SELECT conv_id, turn, parent_turn, 1 FROM reply WHERE parent_turn IS NOT NULL UNION ALL SELECT up.conv_id, up.turn, r.parent_turn, depth + 1 FROM up JOIN reply r ON r.conv_id = up.conv_id AND r.turn = up.at_turn WHERE r.parent_turn IS NOT NULL),
top AS (SELECT conv_id, turn, arg_max(at_turn, depth) AS thread_turn, max(depth) AS depth FROM up GROUP BY 1, 2)
SELECT msg.conv_id, msg.turn, role, CASE WHEN r.parent_turn IS NOT NULL THEN r.parent_turn END AS parent_turn, coalesce(top.thread_turn, msg.turn) AS thread_turn, coalesce(top.depth, 0)::BIGINT AS depth,
  coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(CASE WHEN r.parent_turn IS NOT NULL THEN r.n_linked END, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level, sha256(body) AS body_sha256
FROM msg JOIN body ON body.m = msg.m LEFT JOIN counted c ON c.m = msg.m LEFT JOIN reply r ON r.conv_id = msg.conv_id AND r.turn = msg.turn LEFT JOIN top ON top.conv_id = msg.conv_id AND top.turn = msg.turn
"""
