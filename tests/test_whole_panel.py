"""Whole fits take every supplier, also those over 100 and supplier 0."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborstat.plans import fits, reporting

N_VOXELS, MONTHS = 130, 12


@pytest.fixture(scope="module")
def panel_dir(spark, tmp_path_factory):
    """A lineitem table of 130 suppliers with one line a month."""
    path, rng = tmp_path_factory.mktemp("panel"), np.random.default_rng(3)
    rows = [(v, datetime.date(1995, m + 1, 15), float(q), float(q) * 10, 0.05) for m in range(MONTHS) for v, q in enumerate(rng.uniform(1, 50, N_VOXELS))]
    columns = ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"]
    spark.createDataFrame(pd.DataFrame(rows, columns=columns)).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_experiment_has_all_suppliers(spark, panel_dir):
    held = reporting.experiment(spark, panel_dir).collect()
    assert sorted(r["vox"] for r in held) == list(range(N_VOXELS))
    assert len({(r["i"], r["j"]) for r in held}) == N_VOXELS and {len(r["y"]) for r in held} == {MONTHS}


def test_tree_spans_all_suppliers(spark, panel_dir):
    assert reporting.ward_tree(spark, panel_dir).agg(F.max("size")).first()[0] == N_VOXELS
    assert reporting.tree_layout(spark, panel_dir).count() == 2 * N_VOXELS - 1


def test_oracle_labels_all_suppliers(spark, panel_dir, monkeypatch):
    monkeypatch.setattr(fits, "oracle_regions", lambda packed, design, features, labels, **_: packed.join(labels, "vox").select("vox", "label"))
    got = {r["vox"]: r["label"] for r in reporting.oracle_fit(spark, panel_dir).collect()}
    planted = {v for v in range(N_VOXELS) if (v - 1) // 10 < 4 and (v - 1) % 10 < 4 or v == 0}
    assert set(got) == set(range(N_VOXELS)) and {v for v, label in got.items() if label == 0} == planted
