import math
import time

import numpy as np
import pytest

from arborstat.functions import identity, mancova
from arborstat.operators import effects, grid, prune, report
from arborstat.operators.tree_kernels import grid_edges, label_map, layout, merge_movie, nearest_included, node_sums, parents, postorder, prefix_sums, sizes, ward
from arborstat.plans import fits
from arborstat.plans.fits import Design, cluster_values, node_llr
from arborstat.sources import files, gauss

TREE = np.array([[0, 1], [2, 3], [4, 5]])


def test_small_tree():
    assert node_sums(np.arange(4), TREE).tolist() == [0, 1, 2, 3, 1, 5, 6]
    assert prefix_sums(np.arange(4), TREE).tolist() == [0, 1, 2, 3, 1, 5, 6]
    assert list(postorder(TREE, 4)) == [0, 1, 4, 2, 3, 5, 6] and list(postorder(TREE, 4, only_leaves=True)) == [0, 1, 2, 3]
    assert parents(TREE[:2], 4).tolist() == [4, 4, 5, 5, -1, -1]
    order, low, high = layout(TREE, 4)
    assert (low[6], high[6]) == (0, 4)
    _, low, high = layout(TREE[:2], 4)
    assert [(low[n], high[n]) for n in (4, 5)] == [(0, 2), (2, 4)]
    assert nearest_included([0, 3, 6, 5], TREE, 4) == {0: 6, 3: 5, 5: 6, 6: -1}


def test_label_maps():
    assert label_map([4], TREE, 4).tolist() == [4, 4, -1, -1]
    assert label_map([4, 5], TREE, 4).tolist() == [4, 4, 5, 5]
    assert label_map([1, 4], TREE, 4).tolist() == [4, 1, -1, -1]
    with pytest.raises(ValueError):
        label_map([1, 4], TREE, 4, disjoint=True)


def cut_cost(values, leaves):
    part = values[leaves]
    return float(((part - part.mean(axis=0)) ** 2).sum())


@pytest.mark.parametrize("seed", range(4))
def test_ward_against_brute_force(seed):
    """Each merge is the cheapest of all that touch; the costs sum to the scatter."""
    rng = np.random.default_rng(seed)
    ijk = np.stack(np.unravel_index(np.arange(20), (4, 5)), axis=1)
    values, edges = rng.standard_normal((20, 3)), grid_edges(ijk)
    children, distance = ward(values, edges)
    held = {v: [v] for v in range(20)}
    touch = {(int(a), int(b)) for a, b in edges}
    for step, (a, b) in enumerate(children):
        costs = {}
        for x in held:
            for y in held:
                if x < y and any((min(p, q), max(p, q)) in touch for p in held[x] for q in held[y]):
                    costs[x, y] = cut_cost(values, held[x] + held[y]) - cut_cost(values, held[x]) - cut_cost(values, held[y])
        assert costs[int(a), int(b)] == pytest.approx(min(costs.values())) and distance[step] == pytest.approx(math.sqrt(2 * costs[int(a), int(b)]))
        held[20 + step] = held.pop(int(a)) + held.pop(int(b))
    assert (distance**2 / 2).sum() == pytest.approx(cut_cost(values, list(range(20))))


def test_ward_forest_and_nothing_to_merge():
    chain = np.array([(k, k + 1) for k in range(29)])
    children, _ = ward(np.random.default_rng(0).standard_normal((60, 2)), np.concatenate([chain, chain + 30]))
    assert len(children) == 58 and (parents(children, 60) < 0).sum() == 2
    assert ward(np.zeros((3, 1)), np.zeros((0, 2), int))[0].shape == (0, 2)


def every_antichain(nodes, children, n):
    for bits in range(1 << len(nodes)):
        chosen = [r for k, r in enumerate(nodes) if bits >> k & 1]
        if prune.is_antichain(chosen, children, n):
            yield chosen


@pytest.mark.parametrize("seed", range(5))
def test_pruning_against_every_antichain(seed):
    rng = np.random.default_rng(seed)
    n = 6
    alive, rows = list(range(n)), []
    while len(alive) > 1:
        a, b = (alive.pop(int(rng.integers(len(alive)))) for _ in range(2))
        rows.append((min(a, b), max(a, b)))
        alive.append(n + len(rows) - 1)
    children = np.array(rows)
    nodes = list(range(2 * n - 1))
    gain = {r: float(rng.normal()) for r in nodes}
    best = max(sum(gain[r] - 0.1 for r in c) for c in every_antichain(nodes, children, n))
    chosen = prune.best_antichain(nodes, children, n, gain, 0.1)
    assert prune.is_antichain(chosen, children, n) and sum(gain[r] - 0.1 for r in chosen) == pytest.approx(best)
    target = rng.random(n) < 0.5
    tp, size = node_sums(target.astype(int), children), sizes(children, n)
    top = max(prune.dice(c, tp, size, int(target.sum())) for c in every_antichain(nodes, children, n))
    assert prune.dice(prune.oracle(nodes, children, target), tp, size, int(target.sum())) == pytest.approx(top)
    for k, (score, picked) in enumerate(prune.oracle_by_count(children, target, 3), 1):
        want = max(prune.dice(c, tp, size, int(target.sum())) for c in every_antichain(nodes, children, n) if len(c) <= k)
        assert score == pytest.approx(want) and len(picked) <= k


def test_pruning_rules():
    stat = {4: 5.0, 0: 3.0, 5: -1.0, 2: 2.0, 6: 4.0}
    assert prune.greedy([0, 2, 4, 5, 6], TREE, 4, stat) == (2, 4)
    assert prune.prune("single_max", [0, 4], TREE, 4, stat) == (4,)
    for options in ({"penalty": 1.0}, {"expected_effects": 2}):
        with pytest.raises(ValueError):
            prune.prune("greedy", [0], TREE, 4, stat, **options)
    with pytest.raises(ValueError):
        prune.prune("none", [0], TREE, 4, stat)


def test_statistics_of_a_region():
    rng = np.random.default_rng(1)
    y, x, contrast = rng.standard_normal((2, 20, 5)), np.stack([np.ones(20), rng.standard_normal(20)]), np.array([False, True])
    q = mancova.bases(x, contrast)
    e, h, _ = mancova.error_hypothesis(y, q)
    mean = y.mean(axis=2) @ q[0].T
    total = sum(y[:, :, v] @ y[:, :, v].T for v in range(5)) - 5 * mean @ mean.T
    assert np.allclose(e + h, total)
    assert mancova.llr(e, h) == pytest.approx(-0.5 * math.log(1 - mancova.wilks(e, h)))
    assert mancova.roy(e, h) == pytest.approx(mancova.hotelling(e, h))  # one interest regressor
    assert math.isnan(mancova.llr(np.diag([1.0, -1.0]), h)) and math.isnan(mancova.hotelling(np.zeros((2, 2)), h))
    assert mancova.intercept_only(x, contrast) and not mancova.intercept_only(x, ~contrast)


def test_node_llr_is_the_region_model():
    rng = np.random.default_rng(2)
    y = rng.standard_normal((2, 12, 4))
    design = Design(np.stack([np.ones(12), rng.standard_normal(12), rng.standard_normal(12)]), np.array([False, False, True]))
    got = node_llr(y, TREE, design.q, [np.arange(12), rng.permutation(12)])
    for node, leaves in ((0, [0]), (4, [0, 1]), (6, [0, 1, 2, 3])):
        e, h, _ = mancova.error_hypothesis(y[:, :, leaves], design.q)
        assert got[0, node] == pytest.approx(mancova.llr(e, h, len(leaves)))


def test_effects():
    ijk = gauss.places((6, 6))
    assert effects.sphere(ijk, 14, radius=1).sum() == 5 and effects.sphere(ijk, 14, n_vox=7).sum() == 7
    assert effects.diameter(ijk) == 10
    a, b = effects.spectral_halves(ijk)
    assert not (a & b).any() and (a | b).all() and a.sum() == b.sum() == 18
    rng = np.random.default_rng(0)
    y, x, contrast = rng.standard_normal((2, 15, 10)), np.stack([np.ones(15), rng.standard_normal(15)]), np.array([False, True])
    q = mancova.bases(x, contrast)
    for offset in (effects.smallest_offset(y, x, contrast, 2.0), effects.offset_along(y, x, contrast, effects.beta_direction(1, 2, 20.0, 5), 2.0)):
        assert effects.region_llr(y + offset[:, :, None], q) == pytest.approx(2.0, abs=1e-6)
    with pytest.raises(ValueError):
        effects.beta_direction(1, 1, 0.0, 0)
    assert effects.effect_size(0.5, 5) == 2
    grown = effects.least_variance(ijk, rng.standard_normal((1, 3, 36)), 0, 9)
    assert grown.sum() == 9 and grown[0]


def test_identity():
    a = identity.recipe_id("plant", {"b": 1, "a": (1, 2), "s": {3, 1}})
    assert a == identity.recipe_id("plant", {"a": [1, 2], "s": {1, 3}, "b": np.int64(1)}) and len(a) == 32
    assert a != identity.recipe_id("plant", {"b": 1, "a": (1, 2), "s": {3, 1}}, version=2)
    with pytest.raises(ValueError):
        identity.canonical({"a": np.zeros(2000)})
    assert [identity.seconds(t) for t in ("5400", "90s", "30m", "2h", "1h30m")] == [5400, 90, 1800, 7200, 5400]
    for t in ("", "x", "1d", "h"):
        with pytest.raises(ValueError):
            identity.seconds(t)
    assert identity.differences({"a": [1, 2.0], "n": math.nan}, {"a": [1, 2.0 + 1e-12], "n": math.nan, "z": 1}) == {"a.1": "close", "z": "differs"}
    assert identity.bundle_name("demo_s12") == ("demo", 12)


def test_binomial_interval_and_gauss():
    assert report.binomial_interval(0, 10)[0] == 0 and report.binomial_interval(10, 10)[1] == 1
    assert report.binomial_interval(3, 20) == pytest.approx((0.0320709, 0.3789268), abs=1e-6)
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    y = gauss.sample(2, 10, (3, 4), 0, mu=[1, -1], cov=cov)
    assert np.allclose(np.cov(y.reshape(2, -1)), cov) and np.allclose(y.mean(axis=(1, 2)), [1, -1])


def test_image_files():
    volume = np.random.default_rng(0).standard_normal((3, 4, 2))
    affine = np.diag([2.0, 2.0, 3.0, 1.0])
    got, held = files.read_nifti(files.write_nifti(volume, affine))
    assert np.allclose(got, volume) and np.allclose(held, affine)
    with pytest.raises(ValueError):
        files.subject_of("/a/s1/s2.nii", r"s\d")
    with pytest.raises(ValueError):
        files.read_png(b"nothing")


def test_modes_of_clustering():
    rng = np.random.default_rng(3)
    y, design = rng.standard_normal((2, 10, 4)), Design(np.stack([np.ones(10), np.arange(10.0), rng.standard_normal(10)]), np.array([False, False, True]))
    q = design.q
    assert (cluster_values(y, q, "naive") == y.reshape(20, 4).T).all()
    left = cluster_values(y, q, "glm_error").T.reshape(2, 10, 4)
    assert np.allclose(np.einsum("ai,fiv->fav", q[0], left), 0) and np.allclose(np.einsum("ri,fiv->frv", q[2], left), np.einsum("ri,fiv->frv", q[2], y))
    assert np.allclose(cluster_values(y, q, "focus"), np.einsum("ri,fiv->vfr", q[1], y).reshape(4, -1))
    with pytest.raises(ValueError):
        cluster_values(y, q, "none")
    with pytest.raises(ValueError):
        Design(np.ones((2, 3)), np.array([True]))


def test_movie_of_merges():
    frames = [label.tolist() for _, label in merge_movie(TREE, 4)]
    assert frames == [[0, 0, 2, 3], [0, 0, 2, 2], [0, 0, 0, 0]]


def test_sizes_of_voxels_and_kernels():
    affine = np.array([[0, -2.0, 0, 5], [3.0, 0, 0, 5], [0, 0, 1.5, 5], [0, 0, 0, 1]])
    assert grid.voxel_sizes(affine).tolist() == [3.0, 2.0, 1.5]
    for fwhm, size in ((2.0, 1.0), (6.0, 2.0)):
        weights = grid.kernel(fwhm, size)
        assert sum(w for _, w in weights) == pytest.approx(1) and weights[-1][0] == grid.halo(fwhm, size)
        # Half of the middle's weight lies half a width away: read off the kernel's own Gaussian.
        ratio = dict(weights)[1] / dict(weights)[0]
        assert math.log(ratio) == pytest.approx(-4 * math.log(2) * (size / fwhm) ** 2)


def test_trees_of_experiments_by_mode(spark):
    y, ijk = gauss.sample(1, 12, (4, 4), 2), gauss.places((4, 4))
    packed = spark.createDataFrame(gauss.packed_frame("e", y, ijk), fits.PACKED)
    design = Design(np.stack([np.ones(12), np.arange(12.0)]), np.array([False, True]))
    for mode in fits.MODES:
        draws = fits.region_draws(packed, design, 1, 2, 3, mode)
        rows = draws.orderBy("draw").collect()
        assert [r["draw"] for r in rows] == [0, 1, 2] and rows[1]["nodes"] is None and len(rows[0]["nodes"]) == 31
        children = np.array([(n["left"], n["right"]) for n in rows[0]["nodes"][16:]])
        assert (children == fits.region_tree(y, ijk, design.q, mode)).all()
        want = node_llr(y, children, design.q, [np.arange(12)])[0]
        assert [n["llr"] for n in rows[0]["nodes"]] == pytest.approx(want.tolist())


def plain_ward(values, edges):
    """Every alive pair that touches, cheapest first, ties by the larger and then the smaller node."""
    centre, size, alive = list(values), [1] * len(values), set(range(len(values)))
    pairs, rows = {(max(a, b), min(a, b)) for a, b in edges.tolist()}, []

    def cost(a, b):
        d = centre[a] - centre[b]
        return float(d @ d) * size[a] * size[b] / (size[a] + size[b])

    while pairs:
        _, a, b = min((cost(a, b), a, b) for a, b in pairs)
        new = len(centre)
        centre.append((centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b]))
        size.append(size[a] + size[b])
        alive = alive - {a, b}
        pairs = {(new if x in (a, b) else x, new if y in (a, b) else y) for x, y in pairs}
        pairs = {(max(p), min(p)) for p in pairs if p[0] != p[1]}
        rows.append((min(a, b), max(a, b)))
    return rows


@pytest.mark.parametrize("features", [1, 3])
def test_ward_with_equal_costs(features):
    """Whole numbers, so that many costs are equal; a place apart keeps a forest."""
    ijk = np.concatenate([np.stack(np.unravel_index(np.arange(48), (8, 6)), axis=1), [[30, 30]]])
    values = np.random.default_rng(features).integers(0, 4, (49, features)).astype(float)
    children, _ = ward(values, grid_edges(ijk))
    assert [tuple(r) for r in children.tolist()] == plain_ward(values, grid_edges(ijk)) and len(children) == 47


def test_many_disjoint_regions_are_chosen_in_time():
    """Tens of thousands of significant pairs: each looks at its neighbours among the chosen and not at all of them."""
    n = 1 << 16
    children = np.stack([np.arange(0, n, 2), np.arange(1, n, 2)], axis=1)
    regions = list(range(n, n + n // 2))
    began = time.perf_counter()
    assert prune.greedy([0, *regions], children, n, {0: 9.0} | dict.fromkeys(regions, 1.0)) == (0, *regions[1:])
    assert time.perf_counter() - began < 20
