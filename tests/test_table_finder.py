"""Tables by the places of words: a drawn page, two passes, and brute force on random pages."""

import random

from lectern.operators import table_finder

WORD = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string"
RULED = "doc_id long, page int, table_number int, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>"


def typed(text, x, y, width=5.0, height=10.0):
    """Words of a line that begins at x."""
    out = []
    for w in text.split():
        out.append((float(x), float(y), x + width * len(w), y + height, w))
        x += width * (len(w) + 1)
    return out


def page(doc, *lines):
    return [(doc, 1, *w) for line in lines for w in line]


def test_a_drawn_page(spark):
    text = typed("Some words of a paragraph", 10, 10)
    head = typed("Item name", 10, 40) + typed("Qty", 120, 41) + typed("Price", 200, 39)
    body = typed("Blue pen", 12, 60) + typed("3", 125, 60) + typed("1.20", 205, 60)
    gap = typed("Ink", 12, 80) + typed("0.50", 205, 80)
    rows = page(1, text, head, body, gap, typed("The end", 10, 110)) + page(2, text, typed("Only here", 10, 40) + typed("two", 100, 40), text)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, (1, 1, None, 1.0, 2.0, 3.0, "x"), (1, 1, 1.0, 1.0, 2.0, 3.0, " "), (3, 1, 1.0, 1.0, 2.0, 2.0, None)], WORD)
    got = table_finder.found(df).collect()
    assert [(r.doc_id, r.table_number, r.cells) for r in got] == [(1, 1, [["Item name", "Qty", "Price"], ["Blue pen", "3", "1.20"], ["Ink", "", "0.50"]])]
    assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (10.0, 39.0, 225.0, 90.0)
    assert table_finder.found(df.where("false")).count() == 0


def test_two_passes(spark):
    lines = [typed("a", 10, 10) + typed("b", 60, 10), typed("c", 10, 30) + typed("d", 60, 30)]
    words = spark.createDataFrame(page(1, *lines) + page(2, *lines) + page(3, *lines), WORD)
    ruled = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 9.0, 9.0, [["p", "q"], ["r", "s"]]), (2, 1, 1, 0.0, 0.0, 9.0, 9.0, [["p", "q"]])], RULED)
    got = {r.doc_id: r.cells for r in table_finder.detected(ruled, words).collect()}
    assert got == {1: [["p", "q"], ["r", "s"]], 2: [["a", "b"], ["c", "d"]], 3: [["a", "b"], ["c", "d"]]}


def brute(words):
    """The definition, word by word."""
    lines, bottom = [], None
    for w in sorted(words, key=lambda w: ((w[1] + w[3]) / 2, w[0], w[2], w[4])):
        if bottom is None or (w[1] + w[3]) / 2 > bottom:
            lines.append([])
        lines[-1].append(w)
        bottom = w[3] if bottom is None else max(bottom, w[3])
    split = []
    for line in lines:
        cells, right = [], None
        for w in sorted(line, key=lambda w: (w[0], w[2], w[4])):
            if right is None or w[0] > right + table_finder.GAP:
                cells.append([])
            cells[-1].append(w)
            right = w[2] if right is None else max(right, w[2])
        split.append([(min(w[0] for w in c), max(w[2] for w in c), " ".join(w[4] for w in c)) for c in cells])
    areas, now = [], []
    for cells in [*split, []]:
        if len(cells) > 1:
            now.append(cells)
        elif now:
            areas.append(now)
            now = []
    out = []
    for area in areas:
        columns, right = {}, None
        for k, c in sorted(((k, c) for k, row in enumerate(area) for c in row), key=lambda x: (x[1][0], x[1][1], x[0])):
            columns[k, c] = last = 0 if right is None else last + (c[0] > right)
            right = c[1] if right is None else max(right, c[1])
        grid = [[" ".join(c[2] for c in sorted(row) if columns[k, c] == j) for j in range(last + 1)] for k, row in enumerate(area)]
        full = [sum(x != "" for x in r) for r in grid]
        if len(grid) >= 2 and last >= 1 and sum(n >= 2 for n in full) >= 2 and sum(full) >= 4:
            out.append(grid)
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    pages = {}
    for doc in range(60):
        words = set()
        for y in range(rng.randrange(2, 8)):
            for x in sorted(rng.sample(range(6), rng.randrange(1, 5))):
                words.update(typed(" ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 3))), x * 40 + rng.randrange(8), y * 14 + rng.randrange(5)))
        pages[doc] = sorted(words)
    df = spark.createDataFrame([(d, 1, *map(float, w[:4]), w[4]) for d, ws in pages.items() for w in ws], WORD).repartition(5)
    got = {}
    for r in table_finder.found(df).orderBy("doc_id", "table_number").collect():
        got.setdefault(r.doc_id, []).append(r.cells)
    want = {d: x for d, ws in pages.items() if (x := brute(ws))}
    assert got == want and len(want) > 20
