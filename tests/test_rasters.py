"""Distances, centre lines and summed-area tables of masks against plain loops."""

import random

import numpy as np
import pytest

from boxwright.operators import distance, rasters, skeleton

CELLS = "image_id long, x long, y long"


def mask(seed, wide, high, share):
    r = random.Random(seed)
    return {(x, y) for x in range(wide) for y in range(high) if r.random() < share}


def strokes(seed, wide, high, n):
    """Thick crooked lines."""
    r, out = random.Random(seed), set()
    for _ in range(n):
        x, y, thick = r.randrange(wide), r.randrange(high), r.randint(1, 6)
        for _ in range(r.randint(5, 80)):
            out |= {(a, b) for a in range(x, x + thick) for b in range(y, y + thick) if 0 <= a < wide and 0 <= b < high}
            x, y = x + r.randint(-1, 2), y + r.randint(-2, 2)
    return out


def frame(spark, masks):
    return spark.createDataFrame([(i, x, y) for i, m in masks.items() for x, y in sorted(m)], CELLS).repartition(4)


def by_image(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], set()).add((r["x"], r["y"]))
    return out


def test_squared_distances_are_exact(spark):
    a = {0: mask(1, 20, 30, 0.2), 1: mask(2, 150, 140, 0.05), 2: {(5, 5), (-7, 200)}, 3: {(0, 0)}, 4: mask(3, 9, 7, 0.5)}
    b = {0: mask(4, 25, 10, 0.1), 1: mask(5, 150, 140, 0.01), 2: {(90, -3), (6, 6)}, 4: mask(6, 9, 7, 0.3), 5: {(1, 1)}}
    got = {(r["image_id"], r["x"], r["y"]): r["square"] for r in distance.nearest(frame(spark, a), frame(spark, b)).collect()}
    want = {(i, x, y): min(((x - p) ** 2 + (y - q) ** 2 for p, q in b.get(i, ())), default=None) for i, m in a.items() for x, y in m}
    assert got == want
    none = frame(spark, b).limit(0)
    assert distance.nearest(none, frame(spark, a)).count() == 0
    assert {r["square"] for r in distance.nearest(frame(spark, a), none).collect()} == {None}


def test_envelopes_meet_all_parabolas():
    r = np.random.default_rng(1)
    g = np.where(r.random((40, 60)) < 0.4, np.inf, r.integers(0, 900, (40, 60)).astype(float))
    g[3], g[4] = np.inf, 0.0
    q = np.arange(60)
    assert np.array_equal(distance.envelope(g), (g[:, None, :] + (q[None, :, None] - q[None, None, :]) ** 2).min(axis=2))


def test_hausdorff_of_a_large_mask(spark):
    line = spark.range(2000).selectExpr("1L as image_id", "id as x", "id as y")
    block = spark.range(2000 * 2000).selectExpr("1L as image_id", "id % 2000 as x", "id div 2000 as y")
    d = np.abs(np.subtract.outer(np.arange(2000), np.arange(2000))).ravel() / np.sqrt(2)
    want = np.percentile(np.concatenate([np.where(d * np.sqrt(2) % 2 == 0, d, np.sqrt(d * d + 0.5)), np.zeros(2000)]), 95)
    assert rasters.hausdorff(block, line).first()["distance"] == pytest.approx(want)


def erosions(m, wide, high):
    sides = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
    inside = lambda x, y: 0 <= x < wide and 0 <= y < high
    left, lines = set(m), set()
    while left:
        smaller = {(x, y) for x, y in left if all((x + a, y + b) in left or not inside(x + a, y + b) for a, b in sides)}
        lines |= left - {(x + a, y + b) for x, y in smaller for a, b in sides if inside(x + a, y + b)}
        if smaller == left:
            return left
        left = smaller
    return lines


def test_ridges_are_what_openings_lose(spark):
    masks = {0: mask(7, 30, 20, 0.8), 1: strokes(8, 60, 50, 6), 2: mask(9, 12, 12, 0.5), 3: {(x, y) for x in range(10) for y in range(6)}}
    for i, m in masks.items():
        wide, high = {0: (30, 20), 1: (60, 50), 2: (12, 12), 3: (14, 6)}[i]
        got = by_image(distance.ridges(frame(spark, {i: m}), wide, high))
        assert got[i] == erosions(m, wide, high), i
        deep = {(r["x"], r["y"]): r["depth"] for r in distance.depth(frame(spark, {i: m}), wide, high).collect()}
        out = [(x, y) for x in range(wide) for y in range(high) if (x, y) not in m]
        assert deep == {(x, y): min(abs(x - a) + abs(y - b) for a, b in out) for x, y in m}
    whole = {(x, y) for x in range(4) for y in range(3)}
    assert by_image(distance.ridges(frame(spark, {1: whole}), 4, 3)) == {1: whole}


def thinned_by_loop(m):
    now = set(m)
    while True:
        before = set(now)
        for half in (0, 1):
            gone = set()
            for x, y in now:
                n = [(x + dx, y + dy) in now for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
                up, right, down, left = n[0], n[2], n[4], n[6]
                turns = sum(not n[k] and n[(k + 1) % 8] for k in range(8))
                open_sides = (not (up and right and down) and not (right and down and left)) if half == 0 else (not (up and right and left) and not (up and down and left))
                if 2 <= sum(n) <= 6 and turns == 1 and open_sides:
                    gone.add((x, y))
            now -= gone
        if now == before:
            return now


@pytest.mark.parametrize(("tile", "margin"), [(256, 32), (8, 2), (10, 4), (16, 16)])
def test_thinning_in_tiles_meets_a_loop(spark, tile, margin):
    masks = {0: mask(10, 30, 20, 0.7), 1: strokes(11, 70, 60, 8), 2: {(x, y) for x in range(-20, 30) for y in range(-9, 14)}, 3: {(0, 0)}, 4: mask(12, 9, 7, 0.5)}
    assert by_image(skeleton.thinned(frame(spark, masks), tile, margin)) == {i: thinned_by_loop(m) for i, m in masks.items()}


def test_centre_lines_and_pieces(spark):
    p = {0: strokes(13, 40, 40, 3), 1: mask(14, 15, 15, 0.4), 2: {(0, 0), (5, 5)}, 3: {(1, 1)}}
    t = {0: strokes(15, 40, 40, 3), 1: mask(14, 15, 15, 0.4), 2: {(0, 1), (9, 9), (20, 20), (30, 30)}, 4: {(2, 2)}}
    got = {r["image_id"]: r["f"] for r in skeleton.centre_line_f(frame(spark, p), frame(spark, t)).collect()}
    for i in range(5):
        a, b = thinned_by_loop(p.get(i, set())), thinned_by_loop(t.get(i, set()))
        near = lambda m, o: sum(any((x - u) ** 2 + (y - v) ** 2 <= 4 for u, v in o) for x, y in m) / len(m) if m else 0
        pr, re = near(a, b), near(b, a)
        assert got[i] == pytest.approx(2 * pr * re / (pr + re) if pr + re else 0)
    pieces = {r["image_id"]: r["fragmentation"] for r in skeleton.fragmentation(frame(spark, p), frame(spark, t)).collect()}
    assert pieces[1] == 1 and pieces[2] == 0.5 and pieces[3] == 10 and pieces[4] == 0
    many = {0: {(2 * k, 0) for k in range(30)}}
    assert skeleton.fragmentation(frame(spark, many), frame(spark, {0: {(0, 0)}})).first()["fragmentation"] == 10
    o = {r["image_id"]: (r["precision"], r["recall"], r["dice"]) for r in skeleton.overlap(frame(spark, p), frame(spark, t)).collect()}
    assert o[1] == (1, 1, 1) and o[3] == (0, 0, 0) == o[4]
    assert skeleton.thinned(frame(spark, p).limit(0)).count() == 0


def test_sums_of_boxes_need_four_lookups(spark):
    r = random.Random(16)
    grid = {(i, x, y): r.randint(0, 9) for i in range(2) for x in range(12) for y in range(9)}
    values = spark.createDataFrame([(*k, float(v)) for k, v in grid.items()], f"{CELLS}, value double").repartition(3)
    boxes = [(i, *sorted(r.sample(range(13), 2)), *sorted(r.sample(range(10), 2))) for i in range(2) for _ in range(30)] + [(0, 3, 3, 1, 5)]
    df = spark.createDataFrame(boxes, "image_id long, a long, c long, b long, d long")
    got = {tuple(q[:5]): q[5] for q in distance.box_sums(values, df, ["a", "b", "c", "d"]).select("image_id", "a", "b", "c", "d", "total").collect()}
    assert got == {(i, a, b, c, d): sum(v for (j, x, y), v in grid.items() if j == i and a <= x < c and b <= y < d) for i, a, c, b, d in boxes}


def regions_by_loop(grid, wide, high, threshold, size, most, padding=1, least=0.15, overlap=0.3):
    """grid: {(x, y): value} of an image."""
    clip = lambda v: min(max(v, 0.0), 1.0)
    heat = {p: clip(0.6 * clip(1 - abs(v - threshold) / 0.5) + 0.4 * v) if 0.2 <= v <= 0.9 else 0.0 for p, v in grid.items()}
    over, left, pieces = [p for p in heat if heat[p] >= least], {p for p in heat if heat[p] >= least}, []
    while left:
        stack, piece = [left.pop()], []
        while stack:
            x, y = stack.pop()
            piece.append((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            stack += near
        pieces.append(piece)

    def box(cx, cy):
        x, y = max(0, min(cx - size // 2, max(0, wide - size))), max(0, min(cy - size // 2, max(0, high - size)))
        return x, y, min(x + size, wide), min(y + size, high)

    def middle(values, edge):
        return round((max(min(values) - padding, 0) + min(max(values) + 1 + padding, edge)) / 2)

    found = set()
    for x1, y1, x2, y2 in {box(middle([x for x, _ in p], wide), middle([y for _, y in p], high)) for p in pieces}:
        score = sum(heat[x, y] for x in range(x1, x2) for y in range(y1, y2)) / ((x2 - x1) * (y2 - y1))
        found.add((-round(score, 9), y1, x1, x2, y2))
    if len(pieces) < most:
        for x, y in sorted(over, key=lambda p: (-heat[p], p[1], p[0]))[: 4 * most - len(pieces)]:
            x1, y1, x2, y2 = box(x, y)
            found.add((-round(heat[x, y], 9), y1, x1, x2, y2))
    kept = []
    for s, y1, x1, x2, y2 in sorted(found):
        shared = [max(0, min(x2, b[2]) - max(x1, b[0])) * max(0, min(y2, b[3]) - max(y1, b[1])) for b in kept]
        sizes = [(b[2] - b[0]) * (b[3] - b[1]) + (x2 - x1) * (y2 - y1) - i for b, i in zip(kept, shared, strict=True)]
        if len(kept) < most and all(i / n <= overlap for i, n in zip(shared, sizes, strict=True)):
            kept.append((x1, y1, x2, y2, -s))
    return sorted(kept)


def test_refined_regions_meet_a_loop(spark):
    r = random.Random(17)
    grids = {i: {(x, y): round(r.random() ** (1 + i % 3 * 4), 2) for x in range(14) for y in range(11)} for i in range(8)}
    values = spark.createDataFrame([(i, x, y, v) for i, g in grids.items() for (x, y), v in g.items()], f"{CELLS}, value double").repartition(3)
    got = {}
    for q in rasters.refine_regions(values, 14, 11, 0.5, size=3, most=4).collect():
        got.setdefault(q["image_id"], []).append((q["x1"], q["y1"], q["x2"], q["y2"], q["score"]))
    for i, g in grids.items():
        want = regions_by_loop(g, 14, 11, 0.5, 3, 4)
        own = sorted(got.get(i, []))
        assert [b[:4] for b in own] == [b[:4] for b in want], i
        assert [b[4] for b in own] == pytest.approx([b[4] for b in want], abs=2e-9)


@pytest.mark.parametrize(("wide", "high"), [(14, 11), (300, 3)])
def test_regions_of_boxes_meet_a_loop_without_rows_of_cells(spark, wide, high):
    """The map is made where an image's boxes are: no table of cells is shuffled, unless a map is larger than a tile."""
    r = random.Random(18)
    boxes = []
    for i in range(6):
        for _ in range(12 * (wide // 14)):
            x, y = r.randrange(-2, wide), r.randrange(-1, high)
            boxes.append((i, r.choice([None, r.randint(1, 99) / 100]), x, y, x + r.randint(1, 5), y + r.randint(1, 3)))
    df = spark.createDataFrame(boxes + boxes[:9] + [(None, 0.5, 1, 1, 3, 3)], "image_id long, score double, x1 long, y1 long, x2 long, y2 long").repartition(3)
    found = rasters.refine_box_regions(df, wide, high, 0.5, size=3, most=4)
    got = {}
    for q in found.collect():
        got.setdefault(q["image_id"], []).append((q["x1"], q["y1"], q["x2"], q["y2"], q["score"]))
    assert set(got) <= set(range(6))
    for i in range(6):
        own = [b[1:] for b in boxes if b[0] == i]
        grid = {(x, y): max([s or 0 for s, x1, y1, x2, y2 in own if x1 <= x < x2 and y1 <= y < y2], default=0) for x in range(wide) for y in range(high)}
        want = regions_by_loop(grid, wide, high, 0.5, 3, 4)
        assert [b[:4] for b in sorted(got.get(i, []))] == [b[:4] for b in want], i
        assert [b[4] for b in sorted(got.get(i, []))] == pytest.approx([b[4] for b in want], abs=2e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Window" in plan) == (wide > 256)
