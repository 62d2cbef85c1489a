"""Windows in blocks, resampling options, groups by functions and arrays, selections on long axes."""

import time

import numpy as np
import pandas as pd
import pytest

from labelcube import Cube, SmallArray
from labelcube.errors import UnsupportedError
from labelcube.model import Axis, Group, key
from labelcube.operators import grouped, scans, windowed
from labelcube.sources import sales_month


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=57)
    x[[3, 20, 21, 22, 40]] = np.nan
    return x, Cube.from_arrays(spark, {"x": (("t",), x)}, {"t": np.arange(57)})


def along(plan):
    return plan.to_series().to_numpy(float) if hasattr(plan, "to_series") else plan


def numbers(plan, name="x"):
    return plan[name].to_numpy().astype(float)


@pytest.mark.parametrize("op", ["sum", "mean", "count", "min", "max", "prod", "std", "var", "median"])
def test_cumulative_in_blocks(series, op, monkeypatch):
    x, cube = series
    monkeypatch.setattr(windowed, "BLOCK", 4)
    got = numbers(getattr(cube.plan.cumulative("t"), op)())
    window = pd.Series(x).expanding(1)
    want = window.apply(np.prod) if op == "prod" else getattr(window, op)(**({"ddof": 0} if op in ("std", "var") else {}))
    want = want.to_numpy(float)
    if op == "prod":
        want = pd.Series(x).fillna(1).cumprod().to_numpy()
    np.testing.assert_allclose(np.nan_to_num(got), np.nan_to_num(want), atol=1e-9)


@pytest.mark.parametrize(("size", "center", "least"), [(3, False, None), (12, False, 1), (12, True, 1), (57, False, 1), (9, True, None), (1, False, None)])
def test_rolling_in_blocks(series, size, center, least, monkeypatch):
    x, cube = series
    monkeypatch.setattr(windowed, "BLOCK", 4)
    got = numbers(cube.plan.rolling(t=size, center=center, min_periods=least).sum())
    padded = np.concatenate([np.full(size, np.nan), x, np.full(size, np.nan)])
    before = size // 2 if center else size - 1
    want = []
    for i in range(len(x)):
        w = padded[i + size - before : i + 2 * size - before]
        want.append(np.nansum(w) if (~np.isnan(w)).sum() >= (size if least is None else least) else np.nan)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_diff_and_interpolation_in_blocks(series, monkeypatch):
    x, cube = series
    monkeypatch.setattr(scans, "BLOCK", 4)
    for n in (1, 3, 6):
        np.testing.assert_allclose(numbers(cube.plan.diff("t", n=n)), np.diff(x, n), atol=1e-9)
    np.testing.assert_allclose(numbers(cube.plan.diff("t", label="lower")), np.diff(x), atol=1e-9)
    np.testing.assert_allclose(numbers(cube.plan.interpolate_na("t")), pd.Series(x).interpolate(limit_area="inside").to_numpy(), atol=1e-9)


@pytest.fixture(scope="module")
def hours(spark):
    at = pd.date_range("2020-01-30 05:00", periods=200, freq="7h")
    x = np.random.default_rng(5).normal(size=200)
    return pd.Series(x, at), Cube.from_arrays(spark, {"x": (("t",), x)}, {"t": at.to_numpy().astype("datetime64[us]")})


@pytest.mark.parametrize(
    ("code", "how"),
    [("1D", {}), ("12h", {"closed": "right"}), ("12h", {"closed": "right", "label": "right"}), ("1D", {"offset": "6h"}), ("2D", {"offset": "-5h", "label": "right"}), ("36h", {"origin": "epoch"}), ("5h", {"origin": "start"}),
     ("3D", {"origin": "2020-01-01 03:00"}), ("W", {}), ("W-WED", {}), ("2W", {"closed": "left"}), ("W", {"closed": "left", "label": "left"}), ("MS", {}), ("MS", {"closed": "right"}), ("MS", {"label": "right"}), ("ME", {}),
     ("ME", {"label": "left"}), ("ME", {"closed": "left"}), ("QS", {}), ("QE", {}), ("YE", {}), ("YS", {})],
)
def test_resampling_as_pandas_does(hours, code, how):
    x, cube = hours
    got = cube.plan.resample(t=code, **how).sum().to_frame().toPandas().sort_values("t")
    want = x.resample(code, **how).sum()
    have = pd.Series(got.x.to_numpy(), pd.DatetimeIndex(got.t))
    both = pd.concat([have, want], axis=1).fillna(0.0)
    np.testing.assert_allclose(both[0], both[1], atol=1e-9)


def test_what_resampling_cannot_do_raises(hours):
    _, cube = hours
    for how in ({"offset": "1D"}, {"origin": "epoch"}):
        with pytest.raises(UnsupportedError):
            cube.plan.resample(t="MS", **how).sum().collect()
    with pytest.raises(UnsupportedError):
        cube.plan.resample(t="1D", origin="end").sum().collect()
    with pytest.raises(ValueError):
        cube.plan.resample(t="1D", closed="middle").sum().collect()


def test_groups_by_functions_and_arrays(spark):
    rng = np.random.default_rng(6)
    T = rng.normal(size=(6, 4))
    T[2, 1] = np.nan
    cube = Cube.from_arrays(spark, {"x": (("t", "k"), T), "y": (("k",), np.arange(4.0))}, {"t": np.arange(6), "k": np.arange(4), "g": (("t",), np.array(["a", "b", "a", "b", "b", "a"]))})
    a, b = T[[0, 2, 5]], T[[1, 3, 4]]
    np.testing.assert_allclose(numbers(cube.plan[["x"]].groupby("g").reduce(np.nanmax)), [np.nanmax(a, 0), np.nanmax(b, 0)])
    np.testing.assert_allclose(numbers(cube.plan.groupby("g").reduce(np.nansum), "y"), [np.arange(4.0)] * 2)
    by = SmallArray(["a", "b", "a", "b", "b", "a"], "t")
    np.testing.assert_allclose(numbers(cube.plan[["x"]].groupby(by).mean()), [np.nanmean(a, 0), np.nanmean(b, 0)])
    np.testing.assert_allclose(numbers(cube.plan[["x"]].groupby("g").map(lambda c: c.plan.min("t"))), [np.nanmin(a, 0), np.nanmin(b, 0)])
    kept = numbers(cube.plan[["x"]].groupby("g").map(lambda c: c.plan.pipe(lambda one: one.plan.fillna(9.0).collect())))
    np.testing.assert_allclose(kept, np.nan_to_num(T, nan=9.0))
    np.testing.assert_allclose(numbers(cube.plan[["x"]].quantile([0.25, 0.5], "t")), np.nanquantile(T, [0.25, 0.5], axis=0))
    np.testing.assert_allclose(numbers(cube.plan[["x"]].groupby("g").quantile([0.5])), np.stack([[np.nanquantile(a, 0.5, axis=0), np.nanquantile(b, 0.5, axis=0)]]))


def test_windows_by_functions(spark):
    T = np.random.default_rng(7).normal(size=(6, 4))
    cube = Cube.from_arrays(spark, {"x": (("t", "k"), T)}, {"t": np.arange(6), "k": np.arange(4)})
    want = np.stack([np.full(4, np.nan), *[T[i - 1 : i + 1].max(0) for i in range(1, 6)]])
    np.testing.assert_allclose(numbers(cube.plan.rolling(t=2).reduce(np.nanmax)), want)
    np.testing.assert_allclose(numbers(cube.plan.coarsen(t=3).reduce(np.nanmax)), T.reshape(2, 3, 4).max(1))
    np.testing.assert_allclose(numbers(cube.plan.coarsen(t=3, keep_attrs=True).mean()), T.reshape(2, 3, 4).mean(1))


def test_interp_and_stack(spark):
    T = np.random.default_rng(8).normal(size=(5, 3))
    cube = Cube.from_arrays(spark, {"x": (("t", "k"), T)}, {"t": np.array([0.0, 1.0, 3.0, 4.0, 8.0]), "k": np.arange(3)})
    at = [0.0, 0.5, 2.5, 7.0, 9.0]
    got = numbers(cube.plan.interp(t=at))
    want = np.stack([np.interp(at, [0, 1, 3, 4, 8], T[:, j], right=np.nan) for j in range(3)], 1)
    np.testing.assert_allclose(got, want)
    np.testing.assert_allclose(numbers(cube.plan.stack(both=("t", "k"))), T.ravel())
    frame = cube.plan.stack(both=("t", "k")).to_frame().toPandas().sort_values("both") if "both" in cube.plan.stack(both=("t", "k")).to_frame().columns else cube.plan.stack(both=("t", "k")).to_frame().toPandas()
    assert {"t", "k", "x"} <= set(frame.columns) and len(frame) == 15


def test_bins_are_told_apart():
    assert grouped.edge_names([100000, 100001, 100002], True) == ["(100000, 100001]", "(100001, 100002]"]
    assert grouped.edge_names([-1, 99, 249, 499], True) == ["(-1, 99]", "(99, 249]", "(249, 499]"]


def test_long_axes_stay_on_the_executors(spark):
    n = 10**9
    cube = Cube(spark, {"t": Axis("t", None, (), n)}, (Group(spark.range(n).selectExpr(f"id AS `{key('t')}`", "id * 2 AS x"), ("t",), ("x",), True),))
    began = time.time()
    part = cube.plan.isel(t=slice(0, None)).isel(t=slice(500_000_000, None, 7)).isel(t=slice(1, 3)).collect()
    assert time.time() - began < 5
    assert sorted(r["x"] for r in part.plan.to_frame().collect()) == [1_000_000_014, 1_000_000_028]
    back = cube.plan.isel(t=slice(None, None, -1)).isel(t=0).collect()
    assert [r["x"] for r in back.plan.to_frame().collect()] == [2 * (n - 1)]


def test_labels_are_found_by_aggregation(spark):
    at = pd.date_range("2020-01-01", periods=40, freq="D").to_numpy().astype("datetime64[us]")
    cube = Cube.from_arrays(spark, {"x": (("t",), np.arange(40.0))}, {"t": at})
    assert numbers(cube.plan.sel(t=slice("2020-01-05", "2020-01-07"))).tolist() == [4, 5, 6]
    assert numbers(cube.plan.sel(t="2020-02")).tolist() == list(range(31, 40))
    assert numbers(cube.plan.sel(t=["2020-01-03", "2020-01-02"])).tolist() == [2, 1]
    assert float(numbers(cube.plan.sel(t="2020-01-03T20", method="nearest"))) == 3
    assert numbers(cube.plan.isel(t=slice(10, 20)).sel(t=slice("2020-01-01", "2020-01-12"))).tolist() == [10, 11]
    with pytest.raises(KeyError):
        cube.plan.sel(t="2021-01-01").collect()


def test_a_cube_of_a_large_table_reads_it_once(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the sample tables aren't here")
    df = sales_month(spark, "/root/testdata/sf0.001").plan.mean("status").mean("flag").isel(month=14)[["qty"]].to_frame()
    assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()
