"""Every registered query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return str(int(v)) if float(v) == int(v) else f"{float(v):.7g}"
    return str(v).removesuffix(" 00:00:00")


def table(df):
    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_report_order(spark):
    r = catalog.queries()["q01_measure_rollup"](spark, SF).toPandas()
    assert r["level"][0] == "total" and (r["level"] == "total").sum() == 1
    assert r.loc[r["level"] == "block", "row_count"].sum() >= r["row_count"][0] - 25
    block = None
    for x in r.itertuples():
        if x.level == "block":
            block = x.vineyard_id
        if x.level == "row":
            assert x.vineyard_id == block and math.isnan(x.canopy_area_m2)


def test_greedy_match(spark):
    got = catalog.queries()["q52_greedy_match"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and not got.duplicated(["part", "i"]).any() and not got.duplicated(["part", "j"]).any()


def test_suppressed_points(spark):
    got = catalog.queries()["q57_suppressed_points"](spark, SF).toPandas()
    for _, g in got.groupby("part"):
        xy = g[["x", "y"]].to_numpy()
        d = ((xy[:, None] - xy[None]) ** 2).sum(2) ** 0.5
        assert (d[~pd.isna(d) & (d > 0)] > 150).all()
