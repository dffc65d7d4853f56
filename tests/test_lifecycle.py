import warnings

import numpy as np
import pytest

from arborstat.functions import mancova
from arborstat.operators import effects
from arborstat.operators.experiment import Experiment, NoBiasTerm, bootstrap_images, sampled_design
from arborstat.sources import bundle
from arborstat.sources.contract import BundleSource, FileSource, GaussSource, build_clean, register_study
from arborstat.sources.gauss import places

from test_sources import GLOBS, study

BOX = GaussSource((4, 5, 3), 2, 12, 3, (1.0, -1.0), ((2.0, 0.5), (0.5, 1.0)), voxel=2.0)


def values(held):
    return np.array([r["y"] for r in held.packed.orderBy("i", "j", "k").collect()])


@pytest.fixture(scope="module")
def box(spark):
    return Experiment.of(spark, BOX, a=1, seed=1, bias=True)


@pytest.fixture(scope="module")
def core(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 2, 1), (9, 9, 9)], "i int, j int, k int")


def test_design_and_its_bias(box):
    assert box.x.shape == (2, 12) and box.contrast.tolist() == [False, True] and (box.x[0] == 1).all()
    assert (box.x[1] == np.random.default_rng(1).standard_normal((1, 12))[0]).all()
    with pytest.warns(NoBiasTerm):
        box.sampled(a=2, seed=0)
    for options in ({}, {"a": 1, "contrast": np.array([True])}):
        with pytest.raises(ValueError):
            sampled_design(5, **options)
    with pytest.raises(ValueError):
        box.designed(np.ones((2, 3)), [False, True])
    assert sampled_design(5, contrast=np.array([False, True]), seed=2)[1].tolist() == [False, True]


def test_images_are_drawn_with_all_that_is_theirs(box):
    drawn = box.bootstrap(20, 5)
    chosen = bootstrap_images(12, 20, 5)
    assert (chosen == np.random.default_rng(5).choice(12, 20)).all()
    assert (values(drawn) == values(box).reshape(60, 2, 12)[:, :, chosen].reshape(60, -1)).all()
    assert (drawn.x == box.x[:, chosen]).all() and drawn.subjects == tuple(str(c) for c in chosen) and drawn.source is None
    with pytest.raises(ValueError):
        box.images([12])
    with pytest.raises(ValueError):
        box.bootstrap(3, 0, -1.0)


def test_noise_of_a_bootstrap(box):
    still, noisy = box.bootstrap(200, 5), box.bootstrap(200, 5, 0.5)
    apart = (values(noisy) - values(still)).reshape(60, 2, 200).transpose(1, 0, 2).reshape(2, -1)
    assert np.allclose(np.cov(apart), 0.25 * still.covariance(), atol=0.03)
    assert noisy.value_hash() == box.bootstrap(200, 5, 0.5).value_hash() != still.value_hash()


def test_value_hash_is_of_the_values(box):
    moved = Experiment(box.packed.repartition(7, "j"), 12, box.features)
    assert moved.value_hash() == box.value_hash() != box.images(range(11, -1, -1)).value_hash()


def test_scaling_is_done_once_and_undone(box):
    scaled = box.scaled()
    mean, cov = scaled.moments()
    assert scaled.scaled() is scaled and np.allclose(mean, 0, atol=1e-9) and abs(cov[0, 1]) < 1e-9
    assert np.allclose(values(scaled.unscaled()), values(box)) and box.unscaled() is box


def test_masks_number_anew(box, core):
    held = box.masked(core).packed.orderBy("vox").collect()
    assert [(r["vox"], r["i"], r["j"], r["k"]) for r in held] == [(0, 1, 1, 1), (1, 1, 2, 1)]
    with pytest.raises(ValueError):
        box.masked(core.where("i = 9"))


@pytest.mark.parametrize("scaled", [False, True])
def test_growth_replays_offsets(spark, box, core, scaled):
    more = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "i int, j int, k int")
    planted = box.offset(np.arange(24).reshape(2, 12), places=more).offset(np.ones((2, 12)), places=core)
    planted = planted.scaled() if scaled else planted
    grown = planted.masked(core).inflated(halo=1)
    whole = planted.masked(grown.packed.select("i", "j", "k"))
    assert grown.packed.count() == 36 and np.allclose(values(grown), values(whole))
    assert sorted(r["vox"] for r in grown.packed.select("vox").collect()) == list(range(36))
    named = planted.masked(core).inflated(places=more)
    assert named.packed.count() == 3


def test_what_cannot_be_replayed_has_no_source(box, core):
    stretched = box.offset(np.zeros((2, 12)), places=core, stretch=2.0)
    assert stretched.source is None and len(stretched.patches) == 1
    inside = values(stretched.masked(core))
    before = values(box.masked(core))
    assert np.allclose(inside - inside.mean(axis=0), 2 * (before - before.mean(axis=0)))
    with pytest.raises(ValueError):
        stretched.inflated(halo=1)
    with pytest.raises(ValueError):
        box.inflated()
    with pytest.raises(ValueError):
        box.offset(np.zeros((2, 12)), places=core, vox=[1])


def test_target_as_one_region(box, core):
    found = box.target_stats(core)
    y = values(box.masked(core)).reshape(2, 2, 12).transpose(1, 2, 0)
    e, h, scatter = mancova.error_hypothesis(y, mancova.bases(box.x, box.contrast))
    assert found["llr"] == pytest.approx(mancova.llr(e, h, 2)) and (found["tp"], found["tn"], found["fp"]) == (2, 58, 0)
    assert box.target_stats(core.where("i = 9")) is None
    outer = sum(y[:, :, v] @ y[:, :, v].T for v in range(2))
    assert np.allclose(mancova.pooled_covariance(2, outer, y.mean(axis=2)), scatter / 2)


def test_sources_by_name(spark, core):
    with pytest.raises(ValueError):
        build_clean("nothing")
    noise = build_clean("wgn", seed=4, b=2, n_img=5, shape=(3, 3))
    assert Experiment.of(spark, noise).value_hash() == Experiment.of(spark, build_clean("wgn", seed=4, b=2, n_img=5, shape=(3, 3))).value_hash()
    register_study("box", lambda: BOX)
    assert build_clean("box") is BOX and BOX.affine[0] == 2.0 and BOX.features == ("y0", "y1")
    with pytest.raises(ValueError):
        BOX.load(spark, core)


def test_experiment_of_files(spark, tmp_path):
    held = study(tmp_path)
    source = FileSource.search(spark, f"file://{tmp_path}", r"\bs\d\d", GLOBS)
    got = Experiment.of(spark, source)
    assert got.subjects == ("s01", "s02", "s10") and got.features == ("fa", "md") and got.affine[0] == 1.0
    places_of = [(r["i"], r["j"], r["k"]) for r in got.packed.orderBy("i", "j", "k").collect()]
    want = [[held[s, f][p] for f in ("fa", "md") for s in got.subjects] for p in places_of]
    assert (values(got) == np.array(want)).all()
    assert (values(got.masked(got.packed.limit(3).select("i", "j", "k")).inflated(places=got.packed.select("i", "j", "k"))) == np.array(want)).all()


def test_experiment_of_a_bundle(spark, tmp_path):
    y, ijk = np.random.default_rng(1).standard_normal((2, 4, 6)), places((2, 3))
    panel = spark.createDataFrame([(v, i, float(y[0, i, v]), float(y[1, i, v])) for v in range(6) for i in range(4)], "vox long, img int, fa double, md double")
    bundle.write_bundle(panel, f"file://{tmp_path}/b", ["fa", "md"])
    where = spark.createDataFrame([(v, *map(int, p)) for v, p in enumerate(ijk)], "vox long, i int, j int, k int")
    got = Experiment.of(spark, BundleSource(f"file://{tmp_path}/b", where, ("md", "fa"), 4))
    assert np.allclose(values(got), y[::-1].reshape(8, 6).T)


def test_planting(box):
    y, ijk = np.random.default_rng(1).standard_normal((2, 12, 125)), places((5, 5, 5))
    x, contrast = np.stack([np.ones(12), np.linspace(-1, 1, 12)]), np.array([False, True])
    q = mancova.bases(x, contrast)
    for kind, angle, n in (("single", None, 1), ("split", 60, 2)):
        out, supports, offsets = effects.plant(y, ijk, x, contrast, 0.3, 3, kind, 0.1, angle)
        assert len(supports) == n and sum(s.sum() for s in supports) == effects.effect_size(0.1, 125)
        assert all(effects.region_llr(out[:, :, s], q) == pytest.approx(0.3) for s in supports)
        outside = ~np.any(supports, axis=0)
        assert (out[:, :, outside] == y[:, :, outside]).all()
    turned = [(o + y[:, :, s].mean(axis=2)) @ q[1].T for o, s in zip(offsets, supports, strict=True)]
    cosine = (turned[0] * turned[1]).sum() / np.linalg.norm(turned[0]) / np.linalg.norm(turned[1])
    assert np.degrees(np.arccos(cosine)) == pytest.approx(60)
    for options in ({"kind": "none"}, {"kind": "split"}):
        with pytest.raises(ValueError):
            effects.plant(y, ijk, x, contrast, 0.3, 3, **options)


def test_labels_of_plants():
    a, b = np.array([1, 1, 0, 0, 0], bool), np.array([0, 1, 1, 0, 0], bool)
    assert effects.planted_labels(5, [a, b]).tolist() == [0, 1, 1, 2, 2]
    assert effects.planted_labels(5, [a, a, b], np.array([1, 1, 1, 1, 0], bool)).tolist() == [0, 1, 1, 2, -1]
    assert effects.planted_labels(3, []).tolist() == [0, 0, 0]


def test_estimates_are_close_or_not():
    y, q = np.random.default_rng(0).standard_normal((1, 8, 6)), mancova.bases(np.stack([np.ones(8), np.arange(8.0)]), [False, True])
    inside = np.array([1, 1, 1, 0, 0, 0], bool)
    one = effects.EffectEstimate.of(y, q, inside, node=4, pval=0.01)
    assert one.is_close(effects.EffectEstimate.of(y + 1e-12, q, inside)) and not one.is_close(effects.EffectEstimate.of(y + 0.1, q, inside)) and not one.is_close(effects.EffectEstimate.of(y, q, ~inside))
    assert one.y_mean.shape == (1, 8) and one.e.shape == (1, 1) and (one.node, one.pval) == (4, 0.01)


@pytest.mark.parametrize("shape", [(6, 6), (5, 5, 5), (7, 3), (9, 1), (2, 1)])
def test_halves_differ_by_one_voxel(shape):
    ijk = places(shape)
    a, b = effects.spectral_halves(ijk)
    assert (a ^ b).all() and abs(int(a.sum()) - int(b.sum())) <= 1
    for part in (a, b):
        assert effects.connected_part(ijk, part, int(part.argmax())).sum() == part.sum()


def test_halves_of_odd_shapes():
    path = np.array([(0, 0), (0, 1), (0, 2), (1, 1)])  # a T: one end may wall the other in
    a, b = effects.spectral_halves(path)
    assert (a ^ b).all()
    one, none = effects.spectral_halves(path[:1])
    assert one.all() and not none.any()
    with pytest.raises(ValueError):
        effects.spectral_halves(np.array([(0, 0), (5, 5)]))


def test_directions_are_degrees_apart():
    held = [effects.beta_direction(2, 3, a, 5) for a in (0, 60, -30, 30)]
    assert all(np.linalg.norm(d) == pytest.approx(1) for d in held)
    for a, b in ((held[0], held[1]), (held[2], held[3])):
        assert np.degrees(np.arccos((a * b).sum())) == pytest.approx(60)
    u, w = np.random.default_rng(5).standard_normal((2, 6))
    u /= np.linalg.norm(u)
    assert np.allclose(held[0].ravel(), u) and (held[1].ravel() @ (w - (w @ u) * u)) > 0


def test_no_warning_with_a_bias(box):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        box.sampled(a=2, seed=0, bias=True)


def test_backgrounds_and_colours(spark, box):
    held = box.scaled().backgrounds().orderBy("i", "j", "k").collect()
    want = values(box).reshape(60, 2, 12)
    assert np.allclose([[r["y0"], r["y1"]] for r in held], want.mean(axis=2)) and held[0]["rgb"] is None
    one = box.backgrounds(3).orderBy("i", "j", "k").collect()
    assert np.allclose([r["y1"] for r in one], want[:, 1, 3])
    spans = {r["feature"]: (r["low"], r["high"]) for r in box.ranges().collect()}
    assert spans["y0"] == pytest.approx((want[:, 0].mean(axis=1).min(), want[:, 0].mean(axis=1).max()))
    flat = Experiment.of(spark, GaussSource((3, 2), 3, 4, 1))
    coloured = Experiment(flat.packed, 4, ("Blue", "red", "green")).backgrounds().collect()
    assert all(r["rgb"] == [r["red"], r["green"], r["Blue"]] for r in coloured)
    with pytest.raises(ValueError):
        box.backgrounds(12)


def test_masks_of_files(spark, tmp_path):
    from arborstat.sources import files

    mask = np.zeros((3, 4, 2))
    mask[1, 2, 1] = mask[0, 0, 0] = 2
    mask[2, 2, 0] = -1
    (tmp_path / "m.nii").write_bytes(files.write_nifti(mask))
    np.save(tmp_path / "m.npy", mask)
    np.save(tmp_path / "flat.npy", mask[:, :, 1] > 0)
    for name, want in (("m.nii", [(0, 0, 0), (1, 2, 1)]), ("m.npy", [(0, 0, 0), (1, 2, 1)]), ("flat.npy", [(1, 2, 0)])):
        assert sorted(map(tuple, files.read_mask(spark, f"file://{tmp_path}/{name}").collect())) == want


def test_fits_are_saved_and_listed(spark, tmp_path):
    base = f"file://{tmp_path}/fits"
    assert bundle.manifest(spark, base) == []
    for key in ("b", "a"):
        bundle.save_fit(f"{base}/{key}", {"nodes": spark.range(3), "draws": spark.range(2)}, {"blurb": key})
    assert {n: t.count() for n, t in bundle.load_fit(spark, f"{base}/a").items()} == {"nodes": 3, "draws": 2}
    assert [m["key"] for m in bundle.manifest(spark, base)] == ["a", "b"]
    (tmp_path / "fits" / "manifest.json").write_text('{"demos": [{"key": "b", "blurb": "second"}, {"key": "gone"}]}')
    assert bundle.manifest(spark, base) == [{"key": "b", "about": {"blurb": "second"}}]
    with pytest.raises(FileNotFoundError):
        bundle.load_fit(spark, f"{base}/gone")


def test_publishing_is_all_or_nothing(spark, tmp_path):
    import hashlib

    path = f"file://{tmp_path}/table"
    bundle.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["table"]
    with pytest.raises(FileExistsError):
        bundle.publish(spark.range(1), path)
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"abd")
    wanted = dict.fromkeys(("x.bin", "y.bin", "z.bin"), hashlib.md5(b"abc").hexdigest())
    assert bundle.verified_files(spark, f"file://{tmp_path}", wanted) == ["y.bin", "z.bin"]
