import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat.operators import grid
from arborstat.plans import fits


def extents(over):
    """Size of each cell's 4-connected component, 0 outside."""
    out, seen = np.zeros(over.shape), set()
    for start in zip(*np.nonzero(over), strict=True):
        if start in seen:
            continue
        part, stack = [], [start]
        seen.add(start)
        while stack:
            i, j = stack.pop()
            part.append((i, j))
            for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= p[0] < over.shape[0] and 0 <= p[1] < over.shape[1] and over[p] and p not in seen:
                    seen.add(p)
                    stack.append(p)
        for p in part:
            out[p] = len(part)
    return out


def test_hundred_heights_keep_weak_clusters(spark):
    """A hot peak of 100.3, and clusters under a tenth of it that touch only at their foot."""
    image = np.zeros((5, 7))
    image[0, 0] = 100.3
    image[2:4, 1:3], image[2:4, 4:6], image[3, 3] = 8.5, 7.5, 2.5
    heights = np.linspace(image.max() / 100, image.max(), 100)
    want = sum(np.sqrt(extents(image >= h)) * h * h for h in heights)
    rows = [(i * 7 + j, i, j, float(image[i, j])) for i in range(5) for j in range(7)]
    got = {r["vox"]: r["tfce"] for r in grid.enhance(spark.createDataFrame(rows, "vox long, i int, j int, stat double")).collect()}
    assert got[2 * 7 + 1] > 0
    for (i, j), v in np.ndenumerate(want):
        assert got[i * 7 + j] == pytest.approx(v)


def enhanced_both_ways(spark, monkeypatch, rows, **options):
    image = spark.createDataFrame(rows, "draw int, vox long, i int, j int, k int, stat double")
    found = []
    for most in (grid.IMAGE_CELLS, 0):
        monkeypatch.setattr(grid, "IMAGE_CELLS", most)
        found.append({(r["draw"], r["vox"]): r["tfce"] for r in grid.enhance(image, axes=("i", "j", "k"), keys=("draw",), **options).collect()})
    return found


@pytest.mark.parametrize("conn", [6, 26])
def test_tasks_and_joins_enhance_alike(spark, monkeypatch, conn):
    """Images with holes, unknown and equal statistics, one without a positive one and one all unknown."""
    rng, places = np.random.default_rng(7), [(i, j, k) for i in range(-3, 5) for j in range(6) for k in range(2)]
    rows = []
    for d in range(4):
        for vox, place in enumerate(places):
            stat = {2: -1.0, 3: None}.get(d, float(np.round(rng.normal(0.5, 1), 1)))
            if rng.random() < 0.85:
                rows.append((d, vox, *place, float("nan") if d == 1 and vox % 11 == 0 else stat))
    one, other = enhanced_both_ways(spark, monkeypatch, rows, conn=conn, steps=20)
    assert one.keys() == other.keys() and len(one) == len(rows)
    for key, value in other.items():
        assert one[key] == pytest.approx(value) if value is not None else one[key] is None
    assert any(v is None for v in one.values()) and any(v for v in one.values())


def test_no_row_a_step_is_written(spark, monkeypatch):
    monkeypatch.setattr(grid, "written", lambda *_: pytest.fail("a table of levels"))
    image = spark.createDataFrame([(v, v // 4, v % 4, float(v)) for v in range(16)], "vox long, i int, j int, stat double")
    assert grid.enhance(image).count() == 16


@pytest.mark.parametrize("fwhm", [2.0, 5.0])
def test_tiles_smooth_as_the_whole(spark, monkeypatch, fwhm):
    """Over tiles' borders, below 0, with holes and with unknown values."""
    rng = np.random.default_rng(3)
    rows = []
    for e in ("a", "b"):
        for vox, (i, j) in enumerate((i, j) for i in range(-37, 40, 1 if e == "a" else 3) for j in range(5)):
            if rng.random() < 0.8:
                rows.append((e, vox, i, j, 0, [None if vox in (0, 40) and p == 1 else float(x) for p, x in enumerate(rng.normal(size=3))]))
    rows.append(("b", 9999, 500, 0, 0, [None, 1.0, None]))  # far from all others
    packed = spark.createDataFrame(rows, fits.PACKED)
    long = packed.select("exp_id", "vox", "i", "j", "k", F.posexplode("y").alias("place", "val"))
    want = {(r["exp_id"], r["vox"], r["place"]): r["val"] for r in grid.smooth(spark, long, fwhm, ("i", "j", "k"), ("exp_id", "place")).collect()}
    for numbers in (fits.TILE_NUMBERS, 1):
        monkeypatch.setattr(fits, "TILE_NUMBERS", numbers)
        got = {(r["exp_id"], r["vox"], p): x for r in fits.smoothed(packed, fwhm).collect() for p, x in enumerate(r["y"])}
        assert got.keys() == want.keys()
        for key, value in want.items():
            assert got[key] == pytest.approx(value) if value is not None else got[key] is None
