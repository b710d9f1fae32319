"""Masks within a tile are grids in a task; larger ones, and those with cells beyond the image, take the other way and give the same."""

import numpy as np
import pytest

from boxwright.operators import blocks, distance, rasters, skeleton
from test_rasters import frame, mask


def moved(cells, dx, dy):
    return {(x + dx, y + dy) for x, y in cells}


#: A small mask, one over the corner of four tiles, one that begins below 0.
A = {0: mask(1, 20, 30, 0.3), 1: moved(mask(2, 40, 40, 0.4), 236, 236), 2: moved(mask(3, 9, 7, 0.5), -4, -3), 3: {(5, 5)}}
B = {0: mask(4, 20, 30, 0.3), 1: moved(mask(5, 40, 40, 0.3), 236, 236), 2: moved(mask(6, 9, 7, 0.4), -4, -3), 4: {(1, 1)}}


def pieces(cells):
    left, out = set(cells), []
    while left:
        edge, piece = [left.pop()], set()
        while edge:
            x, y = edge.pop()
            piece.add((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            edge += near
        out.append(piece)
    return out


def test_components_of_small_and_large_masks(spark):
    got = {}
    for r in rasters.component_boxes(frame(spark, A)).collect():
        got.setdefault(r["image_id"], []).append(tuple(r)[1:])
    for i, m in A.items():
        want = [(min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1, len(p)) for p in pieces(m)]
        assert sorted(got[i]) == sorted(want)
    errors = {r["image_id"]: r["error"] for r in rasters.betti_error(frame(spark, A), frame(spark, B)).collect()}
    assert errors == {i: abs(len(pieces(A.get(i, ()))) - len(pieces(B.get(i, ())))) for i in range(5)}


def test_small_masks_take_no_rounds_and_no_join_of_cells(spark, monkeypatch):
    def none(*_):
        raise AssertionError("cells of a small mask were linked")

    monkeypatch.setattr(rasters, "components", none)
    monkeypatch.setattr(skeleton, "stored", none)
    small = {i: m for i, m in A.items() if i in (0, 3)}
    a, b = frame(spark, small), frame(spark, {0: B[0], 4: B[4]})
    made = [rasters.component_boxes(a, 2, 4), rasters.betti_error(a, b), rasters.boundary_f(a, b, 1), rasters.hausdorff(a, b)]
    made += [skeleton.centre_line_f(a, b), skeleton.fragmentation(a, b), skeleton.ridge_metrics(a, b, 20, 30), distance.depth_totals(a, 20, 30)]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert df.count()


@pytest.mark.parametrize("wide, high", [(20, 30), (300, 300)])
def test_both_ways_agree(spark, monkeypatch, wide, high):
    def results():
        a, b = frame(spark, A), frame(spark, B)
        made = [rasters.component_boxes(a, 2, 4), rasters.boundary_f(a, b, 1), rasters.hausdorff(a, b), skeleton.centre_line_f(a, b, 1), skeleton.fragmentation(a, b), skeleton.ridge_metrics(a, b, wide, high), distance.depth_totals(a, wide, high)]
        return [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str) for df in made]

    grids = results()
    split = blocks.split
    monkeypatch.setattr(blocks, "split", lambda *m, odd=None: split(*m, odd=~(blocks.F.col("x").isNull())))  # all take the other way
    assert grids == results()


def test_least_roots_of_a_long_chain():
    r = np.random.default_rng(1)
    names = r.permutation(5000)
    root = blocks.least_roots(5001, names[:-1], names[1:])
    assert (root[:5000] == 0).all() and root[5000] == 5000
