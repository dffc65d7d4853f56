"""Whole fits take enough draws to reach significance, and find the planted corner."""

import datetime

import numpy as np
import pandas as pd
import pytest

from arborstat.plans import fits, reporting

N_VOXELS, MONTHS = 130, 40


@pytest.fixture(scope="module")
def quiet_dir(spark, tmp_path_factory):
    """Quantities with little noise, so that the planted trend stands out."""
    path, rng = tmp_path_factory.mktemp("quiet"), np.random.default_rng(5)
    rows = [(v, datetime.date(1995 + m // 12, m % 12 + 1, 15), float(q), 1.0, 0.05) for m in range(MONTHS) for v, q in enumerate(rng.normal(25, 1, N_VOXELS))]
    columns = ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount"]
    spark.createDataFrame(pd.DataFrame(rows, columns=columns)).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


PLANTED = {v for v in range(N_VOXELS) if (v - 1) // 10 < 4 and (v - 1) % 10 < 4 or v == 0}


def test_cluster_fit_finds_the_plant(spark, quiet_dir):
    found = {r["vox"] for r in reporting.cluster_fit(spark, quiet_dir).where("sig").collect()}
    assert len(found & PLANTED) >= len(PLANTED) / 2 and len(found - PLANTED) <= 3


@pytest.mark.parametrize("fit", [reporting.region_fit, reporting.split_fit, reporting.oracle_fit, reporting.voxel_fit])
def test_least_pvalue(spark, quiet_dir, fit):
    assert min(r["pval"] for r in fit(spark, quiet_dir).collect()) == pytest.approx(1 / (fits.N_PERM + 1))
