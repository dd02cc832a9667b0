"""Every registered query with SQL gives the same rows as DuckDB on the smallest data set."""

import os

import duckdb
import pytest

from lattice_spectra.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Nations have 3 to 13 nodes there, too few for the default numbers of modes or members.
LARGER = {"multiscale", "multiscale_matrix", "band_split", "r2_subspace", "kfold_sizes", "cv_one_mode", "cv_estimator_one_mode", "permutation_exact", "comparison_panel", "comparison_statistics"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def sql_rows(sf, sql):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return con.execute(sql).df()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f":
            assert (a[c] - b[c].astype(float)).abs().max() <= 1e-6 * max(1, a[c].abs().max()) or not len(a)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name in LARGER else SF
    same(QUERIES[name](spark, sf).toPandas(), sql_rows(sf, ORACLES[name]))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["profile_summary", "bootstrap_ci", "compare_spectra", "ceiling_curve", "select_k_modes", "bottleneck_zones_nested", "control_sweep", "cv_transductive", "cv_inductive", "cv_estimator", "eigs_both_ends", "permutation_test"])
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_default_sizes(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["spectral_bound_default"](spark, sf).toPandas()
    assert len(rows) == 25 and (rows.k == 16).all() and (rows.r2_augmented >= rows[["r2_imd", "r2_spectral_only"]].max(axis=1) - 1e-9).all() and (rows.r2_augmented <= 1 + 1e-9).all()
    wide = QUERIES["augment_default"](spark, sf).toPandas()
    assert len(wide) == 1500 and (wide.groupby("network")[[f"mode_{i}" for i in range(16)]].std(ddof=0) - 1).abs().to_numpy().max() < 1e-9


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_nystrom_extend_counts_orders_once(spark):
    plan = QUERIES["nystrom_extend"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_custkey" not in plan
