import struct
import warnings
import zlib

import numpy as np
import pytest

from arborstat.plans import fits
from arborstat.sources import bundle, files, gauss


@pytest.mark.parametrize("moments", [{}, {"mu": [1.0, -2.0], "cov": [[2.0, 0.5], [0.5, 1.0]]}])
def test_every_size_of_box_is_one_law(spark, monkeypatch, moments):
    """Blocks of a box are cut from the draw of the whole box, centred and turned as a whole."""
    monkeypatch.setattr(gauss, "BLOCK_VOXELS", 7)
    rows = gauss.experiment(spark, "e", 2, 5, (4, 5, 2), 9, **moments).orderBy("vox").collect()
    want = gauss.sample(2, 5, (4, 5, 2), 9, **{k: np.array(v) for k, v in moments.items()})
    assert np.allclose(np.array([r["y"] for r in rows]).T.reshape(2, 5, 40), want, atol=1e-12)
    assert [(r["i"], r["j"], r["k"]) for r in rows] == [tuple(p) for p in gauss.places((4, 5, 2)).tolist()]


def png(samples, depth, colour, kinds=(0,), palette=None):
    """A PNG of rows of raw bytes, filtered by the kinds in turn."""
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    high, wide = samples.shape[0], samples.shape[1] // channels
    if depth == 16:
        raw = np.stack([samples >> 8, samples & 255], axis=2).reshape(high, -1).astype(np.uint8)
    elif depth == 8:
        raw = samples.astype(np.uint8)
    else:
        raw = np.packbits(((samples[:, :, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).reshape(high, -1), axis=1)
    step, body, above = max(1, channels * depth // 8), b"", np.zeros(raw.shape[1], np.int64)
    for y, line in enumerate(raw.astype(np.int64)):
        kind = kinds[y % len(kinds)]
        left, corner = np.zeros_like(line), np.zeros_like(line)
        left[step:], corner[step:] = line[:-step], above[:-step]
        paeth = [min((a, b, c), key=lambda v, a=a, b=b, c=c: (abs(a + b - c - v), (a, b, c).index(v))) for a, b, c in zip(left.tolist(), above.tolist(), corner.tolist(), strict=True)]
        guess = (0, left, above, (left + above) // 2, np.array(paeth))[kind]
        body += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    return files.PNG_SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, 0)) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


@pytest.mark.parametrize("depth, colour", [(8, 0), (16, 0), (1, 0), (4, 0), (8, 2), (16, 2), (8, 6), (8, 4)])
def test_png_kinds(depth, colour):
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    samples = np.random.default_rng(3).integers(0, 1 << depth, (7, 5 * channels))
    assert (files.read_png(png(samples, depth, colour, (0, 1, 2, 3, 4))).reshape(7, -1) == samples).all()


def test_png_palette():
    palette = np.random.default_rng(1).integers(0, 256, (16, 3)).astype(np.uint8)
    samples = np.random.default_rng(2).integers(0, 16, (4, 6))
    assert (files.read_png(png(samples, 4, 3, (0, 2), palette)) == palette[samples]).all()


def study(folder, zero=False, affine=None):
    rng, held = np.random.default_rng(5), {}
    for sub in ("s02", "s01", "s10"):
        for feat in ("fa", "md"):
            volume = rng.integers(1, 9, (3, 4, 2)).astype(float)
            volume[0, 0, 0] = 0 if sub == "s01" else 5
            if zero and (sub, feat) == ("s10", "md"):
                volume[:] = 0
            path = folder / sub / f"{sub}_{feat}.nii"
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(files.write_nifti(volume, affine if (sub, feat) == ("s10", "md") else None))
            held[sub, feat] = volume
    return held


GLOBS = {"fa": "*_fa.nii", "md": "*_md.nii"}


def test_study_of_volumes(spark, tmp_path):
    held = study(tmp_path)
    table = files.search(spark, f"file://{tmp_path}", r"\bs\d\d", GLOBS)
    assert [r["subject"] for r in files.subjects(table).collect()] == ["s01", "s02", "s10"]
    rows = files.load(spark, table).collect()
    support = np.argwhere(np.all([v != 0 for v in held.values()], axis=0))
    assert len(rows) == 6 * len(support) and (0, 0, 0) not in {(r["i"], r["j"], r["k"]) for r in rows}
    for r in rows:
        assert tuple(support[r["vox"]]) == (r["i"], r["j"], r["k"]) and r["val"] == held[r["subject"], r["feature"]][r["i"], r["j"], r["k"]]
    mask = np.zeros((3, 4, 2))
    mask[0, :2] = 1
    (tmp_path / "mask.nii.gz").write_bytes(__import__("gzip").compress(files.write_nifti(mask)))
    masked = files.load(spark, table, mask=f"file://{tmp_path}/mask.nii.gz").collect()
    assert len(masked) == 6 * 4 and {r["val"] for r in masked if (r["i"], r["j"], r["k"], r["subject"]) == (0, 0, 0, "s01")} == {0.0}


def test_a_file_of_zeros_leaves_no_support(spark, tmp_path):
    study(tmp_path, zero=True)
    assert files.load(spark, files.search(spark, f"file://{tmp_path}", r"\bs\d\d", GLOBS)).count() == 0


def test_studies_that_are_refused(spark, tmp_path):
    study(tmp_path, affine=np.diag([2.0, 2.0, 2.0, 1.0]))
    table = files.search(spark, f"file://{tmp_path}", r"\bs\d\d", GLOBS)
    with pytest.raises(ValueError, match="affine"):
        files.load(spark, table)
    with pytest.raises(ValueError, match="one subject"):
        files.checked_paths(table.unionByName(table))
    with pytest.raises(ValueError, match="several"):
        files.search(spark, f"file://{tmp_path}", r"s\d|_[fm]", GLOBS)
    with pytest.raises(TypeError):
        files.checked_paths(spark.createDataFrame([("a", "f", "x.nii"), ("b", "f", "y.png")], "subject string, feature string, path string"))
    with pytest.warns(files.MissingImages, match="b"):
        files.checked_paths(spark.createDataFrame([("a", "f", "x.nii"), ("a", "g", "y.nii"), ("b", "f", "z.nii")], "subject string, feature string, path string"))


def test_pictures_and_their_channels(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {s: rng.integers(0, 256, (3, 4, 3)) for s in ("a1", "a2")}
    for s, p in pictures.items():
        (tmp_path / f"{s}.png").write_bytes(png(p.reshape(3, -1), 8, 2, (1, 4)))
    table = files.search(spark, f"file://{tmp_path}", r"/(a\d)\.", {"rgb": "*.png"})
    rows = files.load(spark, table, names={"rgb": ["red", "green"]}).collect()
    assert {r["feature"] for r in rows} == {"red", "green", "rgb2"} and len(rows) == 2 * 3 * 12
    assert all(r["val"] == pictures[r["subject"]][r["i"], r["j"], ["red", "green", "rgb2"].index(r["feature"])] for r in rows)


def test_bundles_and_ordered_exports(spark, tmp_path):
    panel = spark.createDataFrame([(v, i, float(v + i), float(v * i)) for v in range(4) for i in range(3)], "vox long, img int, fa double, md double")
    bundle.write_bundle(panel, f"file://{tmp_path}/b", ["fa", "md"])
    got = bundle.read_bundle(spark, f"file://{tmp_path}/b", ["md"], spark.createDataFrame([(2,), (2,)], "vox long")).collect()
    assert sorted((r["img"], r["val"]) for r in got) == [(0, 0.0), (1, 2.0), (2, 4.0)]
    assert bundle.write_csv(panel.where("vox > 2"), f"file://{tmp_path}/c", ["img"]) and not bundle.write_csv(panel.where("vox > 9"), f"file://{tmp_path}/d", ["img"])
    (part,) = (tmp_path / "c").glob("*.csv")
    assert [line.split(",")[1] for line in part.read_text().splitlines()[1:]] == ["0", "1", "2"] and not (tmp_path / "d").exists()


def test_two_experiments_have_two_nulls(spark):
    """A weak experiment is not judged by a strong one's maxima."""
    nodes = "array<struct<node:long,size:long,llr:double,z:double,left:long,right:long>>"
    rows = [("a", 0, 1.0, [(0, 1, 1.0, 1.0, -1, -1)]), ("a", 1, 0.5, None), ("b", 0, 9.0, [(0, 1, 9.0, 9.0, -1, -1)]), ("b", 1, 20.0, None)]
    got = fits.significant_nodes(spark.createDataFrame(rows, f"exp_id string, draw int, max_z double, nodes {nodes}")).collect()
    assert {r["exp_id"]: r["pval"] for r in got} == {"a": 0.5, "b": 1.0}


def test_gauss_has_no_warning(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert gauss.sample(1, 3, (2, 2), 1).shape == (1, 3, 4)
