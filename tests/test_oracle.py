"""Every query with an SQL oracle against DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from tabsieve.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, S = registry.queries(), registry.oracle_sql()
#: Compositions of model fits whose parts test_learning.py covers; fidelity_weights, refine_pipeline and cluster_folds_labels run here.
SLOW = {"fidelity_gbt_isotonic", "fidelity_mlp_sigmoid", "tstr_report", "utility_summary", "importance_comparison", "kmeans_sweep", "cluster_folds"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if hasattr(v, "as_tuple") or isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", [n for n in Q if n not in SLOW])
def test_query(spark, duck, name):
    df = Q[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in S:
        assert got
        return
    out = duck.execute(S[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in place) for r in out.fetchall())


def test_names():
    assert set(S) <= set(Q)
