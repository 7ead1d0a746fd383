"""Lines of pages against a plain scan of each page."""

import math
import random

from foliodiff.operators import layout


def plain(page):
    rows, last = [], None
    for s, x, y in page:
        if last is None or abs(y - last) > 2.5:
            rows.append([])
        rows[-1].append((x, s))
        last = y
    rows = [[it for it in sorted(r, key=lambda it: it[0]) if it[1].strip()] for r in rows]
    columns = {}
    for r in rows:
        for x in sorted({math.floor(x + 0.5) for x, _ in r}):
            near = next((k for k in columns if abs(k - x) <= 5), x)
            columns[near] = columns.get(near, 0) + 1
    columns = sorted(k for k, n in columns.items() if n > 1)
    lines = []
    for r in rows:
        if len(r) < 2:
            lines += [s.strip() for _, s in r]
            continue
        if len(columns) > 1:
            cells = {}
            for x, s in r:
                k = min(columns, key=lambda c: abs(x - c))
                cells.setdefault(k if abs(x - k) <= 20 else -1, []).append(s.strip())
            lines.append(" | ".join(" ".join(cells[k]) for k in sorted(cells)))
            continue
        gaps = [b[0] - a[0] - 5 * len(a[1]) for a, b in zip(r, r[1:])]
        wide = sorted(g for g in gaps if g > 0)
        limit = max(20, min(80, 1.5 * wide[len(wide) // 2])) if wide else 30
        line = r[0][1] + "".join((" | " if g > limit else " ") + s for g, (_, s) in zip(gaps, r[1:]))
        if "|" not in line and len(r) == 2 and r[1][0] - r[0][0] - 5 * len(r[0][1].strip()) > 15:
            line = f"{r[0][1].strip()} | {r[1][1].strip()}"
        lines.append(line.strip())
    return [x for x in lines if x]


def test_page_lines(spark):
    rng = random.Random(5)
    pages = {}
    for d in range(120):
        page, y = [], 700.0
        for _ in range(rng.randrange(7)):
            y -= rng.choice((1.0, 12.0))
            for _ in range(rng.randrange(5)):
                x = rng.choice((10, 13, 100, 250, 40 * rng.randrange(12))) + rng.choice((0, 0.5, 3)) if d % 2 else 400 * rng.random()
                page.append((rng.choice(("Net", " Gross sum", "7", " ", "long words here ")), float(x), y))
        pages[d] = page
    items = [(d, i, *it) for d, page in pages.items() for i, it in enumerate(page)]
    got = {d: [] for d in pages}
    for r in sorted(layout.page_lines(spark.createDataFrame(items, "doc long, ord int, str string, x double, y double")).collect()):
        got[r.doc].append(r.line)
    assert got == {d: plain(page) for d, page in pages.items()}


def test_page_lines_awkward(spark):
    schema = "doc long, ord int, str string, x double, y double"
    assert layout.page_lines(spark.createDataFrame([(1, 0, None, 1.0, 1.0), (1, 1, "a", 9.0, 1.0)], schema)).collect()[0].line == "a"
    assert layout.page_lines(spark.createDataFrame([], schema)).count() == 0
