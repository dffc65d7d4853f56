import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborstat import __main__ as cli
from arborstat.functions import identity
from arborstat.operators import figures, grid, provenance, report
from arborstat.plans import fits
from arborstat.streaming.ingest import latest_of, run_to_end
from arborstat.tables import new_path


class Named:
    def canon_spec(self):
        return {"kind": "sphere", "n": 3}


def test_canonical_forms():
    assert identity.canonical({"b": {3, "x"}, "a": (1, np.float64(2.5)), 1: None}) == '{"1":null,"a":[1,2.5],"b":["\\"x\\"","3"]}'
    assert identity.canonical([Named(), int, np.arange(3), {"k": frozenset()}]) == '[{"kind":"sphere","n":3},"builtins.int",[0,1,2],{"k":[]}]'
    assert identity.canonical("é") == '"\\u00e9"' and identity.plain(range(2)) == "range(0, 2)"
    assert identity.recipe_json("plant", {"seed": 1}, ["p"]) == '{"canon_version":1,"impl_version":0,"kwargs":{"seed":1},"op":"plant","parents":["p"]}'
    assert '"impl_version":1' in identity.recipe_json("run_ana") and '"impl_version":7' in identity.recipe_json("run_ana", version=7)
    assert identity.recipe_id("plant", {"seed": 1}, ["p", "q"]) != identity.recipe_id("plant", {"seed": 1}, ["q", "p"])
    with pytest.raises(identity.ComputedArray):
        identity.recipe_id("plant", {"y": np.zeros(1025)})


def test_names_and_hashes():
    assert identity.slug("GLOW (raw), b=1") == "glow_raw_b_1" and identity.demo_key("demo", 0) == "demo" and identity.demo_key("demo", 3) == "demo_s3"
    y = np.arange(24.0).reshape(2, 3, 4)
    assert identity.value_hash(y) == identity.value_hash(np.asfortranarray(y)) != identity.value_hash(y.reshape(2, 4, 3))
    assert identity.call_id("f", {"a": 1, "jobs": 8}, ["jobs"]) == identity.call_id("f", {"a": 1, "jobs": 2}, ["jobs"])


def test_calls_are_recorded(spark, tmp_path):
    keep, calls = provenance.Recorder(), []

    @keep(outputs=("total", "y"), ignore=("jobs",), version=2)
    def work(a, b=2, jobs=1):
        calls.append(a)
        if a < 0:
            raise RuntimeError("no")
        return a + b, np.zeros(2000)

    assert work(1)[0] == work(1, 2, jobs=4)[0] == 3 and calls == [1]
    with pytest.raises(RuntimeError):
        work(-1)
    assert len(keep.held) == 1
    folder = f"file://{tmp_path}/records"
    keep.write(spark, folder)
    (row,) = spark.read.schema(provenance.RECORD).json(folder).collect()
    assert json.loads(row["kwargs"]) == {"a": 1, "b": 2} and json.loads(row["outputs"])["total"] == 3 and row["impl_version"] == 2
    assert row["uid"] == identity.recipe_id(work.__qualname__, {"a": 1, "b": 2}, version=2)
    keep.write(spark, folder)
    twice = spark.read.schema(provenance.RECORD).json(folder)
    assert twice.count() == 2 and provenance.latest(twice, "hash", "time_sec").count() == 1
    assert provenance.read_records(spark, folder).count() == 2


def test_sweeps_go_on_after_failures():
    built = []

    def build(seed):
        built.append(seed)
        if seed == 2:
            raise RuntimeError("no cell")
        return seed

    def score(cell, ana):
        if ana == "bad":
            raise RuntimeError("no leaf")
        return {"dice": cell / 10}

    cells, leaves = provenance.grid(seed=[1, 2, 3]), provenance.grid(ana=["ok", "bad"])
    first = provenance.drive(cells, leaves, build, score)
    assert [(d["seed"], d["dice"]) for d in first.done] == [(1, 0.1), (3, 0.3)] and len(first.failed) == 3
    built.clear()
    again = provenance.drive(cells[:1], [{"ana": "ok"}], build, score, {d["uid"] for d in first.done})
    assert not built and len(again.skipped) == 1 and not again.done
    assert provenance.grid(a=[None], b=[1, 2]) == [{"a": None, "b": 1}, {"a": None, "b": 2}] and provenance.grid(a=[]) == []
    with pytest.raises(ValueError):
        provenance.check_workers({"n_jobs": 4}, 2)
    provenance.check_workers({"n_jobs": 4}, 1)


def test_records_are_replayed_within_a_budget():
    records = [{"uid": str(k), "outputs": json.dumps({"x": 1.0, "n": k}), "time_sec": t} for k, t in enumerate((1.0, 50.0, 1.0, 1.0))]

    def replay(record):
        if record["uid"] == "3":
            raise RuntimeError("gone")
        return {"x": 1.0 + 1e-12, "n": 0}

    got = provenance.validate(records, replay, 10.0)
    assert [(g["uid"], g["verdict"].split(":")[0]) for g in got] == [("0", "close"), ("2", "differs"), ("3", "failed")]


def test_chunks_and_archives(spark, tmp_path):
    for n, size, chunks, most in ((10, 8, 3, 1 << 28), (10, 100, 1, 250), (3, 8, 9, 1 << 28), (0, 8, 2, 100)):
        cut = provenance.chunk_slices(n, size, chunks, most)
        assert [i for s in cut for i in range(s.start, s.stop)] == list(range(n)) and all((s.stop - s.start) * size <= max(most, size) for s in cut)
    for name in ("cache", "records"):
        spark.range(3).write.parquet(f"file://{tmp_path}/{name}")
    out = provenance.archive(spark, [f"file://{tmp_path}/cache"], f"file://{tmp_path}/old", "2024-01-01")
    more = provenance.archive(spark, [f"file://{tmp_path}/records"], f"file://{tmp_path}/old", "2024-01-01")
    assert out[0].endswith("old/2024-01-01/cache") and more[0].endswith("old/2024-01-01-2/records") and spark.read.parquet(*out, *more).count() == 6


def test_catalogue_names():
    names = ["sweep_llr", "sweep_b", "null"]
    assert figures.resolve_names(["null", "sweep_*", "null"], names) == ["null", "sweep_llr", "sweep_b"]
    with pytest.raises(ValueError):
        figures.resolve_names(["x*"], names)
    leaves = [{"ana": "a", "n": 1}, {"ana": "b"}, {"n": 2}]
    assert figures.narrowed(leaves, ["a"], ["a", "b"]) == leaves[:1] and figures.narrowed(leaves, None, ["a"]) == leaves
    with pytest.raises(ValueError):
        figures.narrowed(leaves, ["z"], ["a", "b"])


def test_tables_as_text(spark):
    df = spark.createDataFrame([("a_b", 1.23456, 3), ("c", None, 4)], "name string, dice double, n long")
    assert figures.text_table(df, 2).splitlines() == ["name  dice  n", "a_b   1.23  3", "c     -     4"]
    assert r"a\_b & 1.235 & 3 \\" in figures.text_table(df, latex=True)


def test_saving_a_large_matrix_warns():
    with pytest.warns(ResourceWarning):
        assert figures.warn_if_large(1 << 31)
    assert not figures.warn_if_large(10)


def test_rank_correlation_is_of_complete_rows(spark):
    rows = [("k", float(a), float(b)) for a, b in ((1, 2), (2, 1), (3, 4), (4, 3), (5, 5))] + [("k", 0.0, None), ("k", None, 9.0), ("k", 2.5, None)]
    got = report.spearman(spark.createDataFrame(rows, "k string, a double, b double"), "k", "a", "b").first()
    assert got["spearman"] == pytest.approx(0.8)


def test_regressions_of_flat_regions(spark):
    df = spark.createDataFrame([(1, i, 2.0) for i in range(4)] + [(2, i, float(i)) for i in range(4)], "node int, img int, y double")
    got = {r["node"]: r for r in figures.region_regression(df, ["node"], "img", "img", "y").collect()}
    assert got[1]["r2"] is None and got[2]["r2"] == pytest.approx(1) and got[2]["slope"] == pytest.approx(1)


def test_agreement_of_groups_without_a_name(spark):
    rows = [(None, 1, None), (None, 2, None), ("a", 1, 5), ("a", 2, 6), ("b", 1, 7), ("b", 2, 7)]
    got = figures.deepest_agreement(spark.createDataFrame(rows, "g string, m int, reg int"), ["g"], "m", "reg").collect()
    assert {(r["g"], r["m"]): r["agree"] for r in got} == {(None, 1): True, (None, 2): True, ("a", 1): False, ("a", 2): True, ("b", 1): True, ("b", 2): True}


def test_frames_are_split_by_what_moves(spark):
    df = spark.createDataFrame([(0.1, 1, 5), (0.2, 2, 5), (0.3, 2, 5)], "llr double, b int, num_img int")
    assert figures.swept_axis(df, "llr", ["llr", "b"]) == "llr" and figures.swept_axis(df.withColumn("llr", F.lit(None).cast("double")), "llr", ["b"]) is None
    assert [(s, d.count()) for s, d in figures.split_frames(df, "llr", ["b", "num_img"])] == [("_b1", 1), ("_b2", 2)]
    assert [s for s, _ in figures.split_frames(df.where("b = 1"), "llr", ["b"], {"b": 3})] == ["_b1"] and figures.split_frames(df, "b", ["b", "num_img"])[0][0] == ""


def test_enhancement_hides_unknowns_and_keeps_draws_apart(spark):
    cells = [(k, v, 0, v, s) for k, stats in enumerate(((math.nan, 2.0, 1.0), (None, -1.0, 0.0), (4.0, 4.0, 0.5))) for v, s in enumerate(stats)]
    got = {(r["k"], r["vox"]): r["tfce"] for r in grid.enhance(spark.createDataFrame(cells, "k int, vox long, i int, j int, stat double"), steps=2, keys=("k",)).collect()}
    assert got[0, 0] is None and got[0, 1] == pytest.approx(math.sqrt(2) * 1 + 4) and got[0, 2] == pytest.approx(math.sqrt(2))
    assert got[1, 0] is None and got[1, 1] == got[1, 2] == 0 and got[2, 0] == pytest.approx(math.sqrt(2) * (4 + 16)) and got[2, 2] == 0


@pytest.mark.parametrize("conn, axes", [(4, ("i", "j")), (8, ("i", "j")), (6, ("i", "j", "k")), (18, ("i", "j", "k")), (26, ("i", "j", "k"))])
def test_components_by_image_are_those_by_joins(spark, conn, axes):
    rng = np.random.default_rng(conn)
    cells = [(s, int(v), int(v) // 36, int(v) // 6 % 6 if len(axes) == 3 else int(v) % 36, int(v) % 6) for s in range(3) for v in rng.permutation(216)[:90]]
    df = spark.createDataFrame([(s, 1000 - v, i, j, k) for s, v, i, j, k in cells], "s int, vox long, i int, j int, k int")
    one, two = (sorted(map(tuple, f(df, conn, axes, ("s",)).collect())) for f in (grid.labelled, grid.spread_labels))
    assert one == two and len(one) == 270


def test_statistics_in_one_product_are_those_one_by_one(spark):
    from arborstat.functions import mancova
    from arborstat.operators.permutation import seeded_permutation
    from arborstat.sources import gauss

    design = fits.Design(np.stack([np.ones(14), np.linspace(-1, 1, 14), np.cos(np.arange(14.0))]), np.array([False, False, True]))
    y, ijk = gauss.sample(2, 14, (3, 2), 4), gauss.places((3, 2))
    held = spark.createDataFrame(gauss.packed_frame("e", y, ijk), fits.PACKED)
    for name in mancova.STATISTICS:
        for r in fits.voxel_statistics(held, design, 2, 2, name).collect():
            move = mancova.freedman_lane(design.q[0], seeded_permutation(r["k"], 14))
            e, h, _ = mancova.error_hypothesis((y[:, :, r["vox"]] @ move)[:, :, None], design.q)
            assert r["stat"] == pytest.approx(mancova.STATISTICS[name](e, h), rel=1e-9), name
    with pytest.raises(ValueError):
        fits.voxel_statistics(held, design, 2, 2, "none")
    given = fits.voxel_statistics(held, design, 2, 2)
    assert fits.voxel_statistics(held, design, 2, 2, given=given) is given
    with pytest.raises(ValueError):
        fits.voxel_statistics(held, design, 2, 5, given=given)


def test_last_records_of_a_stream(spark):
    rows = [(1, "a", 1), (1, "b", 3), (2, "c", 2), (1, "d", 2)]
    folder = new_path(spark, "stream")
    spark.createDataFrame(rows, "key long, v string, ts long").write.parquet(folder)
    stream = spark.readStream.schema("key long, v string, ts long").parquet(folder)
    got = run_to_end(spark, latest_of(stream, "key", ["ts"]), new_path(spark, "state"), new_path(spark, "out"))
    assert {r["key"]: r["v"] for r in got.collect()} == {1: "b", 2: "c"}


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list", "tree_*"]) == 0 and "tree_llr_scan" in capsys.readouterr().out
    run = ["run", "grid_bbox", "entropy_bits", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]
    assert cli.main(run, spark) == 0 and "grid_bbox\twritten" in capsys.readouterr().out
    assert cli.main(run, spark) == 0 and capsys.readouterr().out.count("held") == 2
    assert len(list((tmp_path / "out" / "grid_bbox").glob("*.csv"))) == 1
    assert cli.main(["table", "grid_bbox", "--data", "/root/testdata/sf0.001", "--latex"], spark) == 0 and r"\begin{tabular}" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["list", "no_such_query"])
