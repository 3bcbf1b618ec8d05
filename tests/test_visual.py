"""Changed regions against a flood fill."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from driftwatch.operators import visual


def flood(mask, least):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        seen[y, x] = True
        stack, cells = [(y, x)], []
        while stack:
            b, a = stack.pop()
            cells.append((b, a))
            for v, u in ((b + 1, a), (b - 1, a), (b, a + 1), (b, a - 1)):
                if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not seen[v, u]:
                    seen[v, u] = True
                    stack.append((v, u))
        if len(cells) > least:
            ys, xs = zip(*cells)
            out.append((min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), len(cells)))
    return sorted(out)


def told(regions):
    return sorted((r["x"], r["y"], r["width"], r["height"], r["area"]) for r in regions)


def test_regions_equal_flood_fill():
    rng = np.random.default_rng(7)
    for height, width in ((1, 1), (1, 9), (9, 1), (7, 5), (40, 33)):
        for share in (0.0, 0.2, 0.5, 0.62, 0.9, 1.0):
            mask = rng.random((height, width)) < share
            assert told(visual.label_regions(mask, 2)) == flood(mask, 2)
    snake = np.zeros((41, 41), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert told(visual.label_regions(snake, 0)) == flood(snake, 0) and len(visual.label_regions(snake, 0)) == 1


def test_regions_of_full_screens_are_quick():
    mask = np.random.default_rng(3).random((1080, 1920)) < 0.6
    start = time.time()
    assert visual.label_regions(mask, 100)
    assert time.time() - start < 10


def test_changed_regions_column(spark):
    black, spot = [0] * 48, [0] * 48
    for k in (9, 10, 17, 18, 30):
        spot[k] = 200
    rows = [(1, 8, 6, black, black, black, spot, spot, spot), (2, 8, 6, black, black, black, black, black, black), (3, 8, 0, [], [], [], [], [], [])]
    kinds = ", ".join(f"{side}_{c} array<int>" for side in ("old", "new") for c in "rgb")
    out = visual.changed_regions(spark.createDataFrame(rows, f"id int, width int, height int, {kinds}"), min_pixels=3)
    got = {r.id: [tuple(x) for x in r.changed_regions] for r in out.select("id", "changed_regions").collect()}
    assert got == {1: [(1, 1, 1, 1, 4)], 2: [], 3: []}
    assert out.select(F.size("changed_regions")).count() == 3
