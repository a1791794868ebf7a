"""Shapes over tiles against the kernels on whole regions."""

import numpy as np
import pandas as pd
import pytest

from terralume.operators import geometry, shapes


def figures():
    r = np.random.default_rng(4)
    yy, xx = np.mgrid[:30, :30]
    far = np.hypot(yy - 15, xx - 15)
    ring = (far < 14) & (far > 11)
    ring[15, 15] = True
    frame = np.ones((28, 36), bool)
    frame[2:-2, 2:-2] = False
    frame[12:15, 10:20] = True  # an island inside the hole: all is filled
    gap = frame.copy()
    gap[:2, 14:20] = False  # opens the hole
    blob = np.kron(r.random((6, 6)) < 0.6, np.ones((4, 4), bool))
    return {1: ring, 2: frame, 3: gap, 4: blob, 5: r.random((20, 20)) < 0.5, 6: np.ones((1, 20), bool), 7: np.eye(18, dtype=bool), 8: np.ones((2, 3), bool)}


@pytest.fixture(scope="module")
def regions(spark):
    parts = []
    for k, m in figures().items():
        y, x = np.nonzero(m)
        parts.append(pd.DataFrame({"scene": "a" if k % 2 else "b", "region": k, "x": x + 13 * k - 40, "y": y + 5 * k}))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark.createDataFrame(pd.concat(parts).astype({"region": "int64"})).cache()
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("tile", [8, 30])
def test_shapes_do_not_depend_on_tiles(spark, regions, tile):
    got = {r["region"]: r.asDict() for r in shapes.shapes(regions, ("scene", "region"), tile=tile).collect()}
    hulls = {r["region"]: (r["area"], r["hull_px"]) for r in shapes.hulls(regions, ("scene", "region"), tile=tile).collect()}
    for k, m in figures().items():
        y, x = np.nonzero(m)
        want = geometry.metrics(x, y)
        assert {n: got[k][n] for n in want} == pytest.approx(want), k
        full = geometry.fill_holes(geometry.close3(geometry.crop_mask(x, y)))
        h = geometry.hull(np.column_stack(np.nonzero(full)[::-1]))
        assert hulls[k] == (full.sum(), geometry.hull_pixels(h))


def test_hull_pixels_by_lines():
    r = np.random.default_rng(8)
    for _ in range(100):
        h = geometry.hull(r.integers(0, 25, (r.integers(3, 12), 2)))
        if len(h) < 3:
            continue
        yy, xx = np.mgrid[:25, :25]
        inside = np.ones((25, 25), bool)
        for a, b in zip(h, np.roll(h, -1, 0)):
            inside &= (b[0] - a[0]) * (yy - a[1]) - (b[1] - a[1]) * (xx - a[0]) >= 0
        assert geometry.hull_pixels(h) == inside.sum()


def test_no_region(spark, regions):
    assert shapes.shapes(regions.limit(0), ("scene", "region"), tile=8).count() == 0
