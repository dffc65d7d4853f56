import numpy as np

from arborstat.llm.jpeg import cell_overlaps, thumbnail_hashes


def test_hash_sees_every_pixel():
    flat = np.full((32, 36), 100, np.uint8)
    for i, j in np.ndindex(flat.shape):
        spot = flat.copy()
        spot[i, j] = 255
        assert thumbnail_hashes(spot) != thumbnail_hashes(flat)


def test_cells_are_area_means():
    pixels = np.random.default_rng(1).integers(0, 256, (24, 27))
    sums = cell_overlaps(24, 8) @ pixels @ cell_overlaps(27, 9).T
    assert np.allclose(sums / (24 * 27), pixels.reshape(8, 3, 9, 3).mean(axis=(1, 3)))
    assert all((cell_overlaps(n, c).sum(axis=1) == n).all() and (cell_overlaps(n, c).sum(axis=0) == c).all() for n in (1, 5, 8, 37) for c in (8, 9))
