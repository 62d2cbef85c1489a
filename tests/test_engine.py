"""Chains against numpy, missing cells included."""

import warnings

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelcube import Cube, InvalidExpressionError, SmallArray, UnsupportedError

warnings.filterwarnings("ignore", category=RuntimeWarning)
RNG = np.random.default_rng(0)
T = RNG.normal(size=(4, 3, 5)).round(3)
T[0, 1, 2] = T[3, :, 0] = T[1:3, 0, 4] = np.nan
E = RNG.normal(size=(3, 5)).round(3)
DAYS = pd.date_range("2000-01-30", periods=4).to_numpy()


@pytest.fixture(scope="module")
def cube(spark):
    return Cube.from_arrays(
        spark, {"temperature": (("time", "lat", "lon"), T), "elevation": (("lat", "lon"), E)},
        {"time": np.arange(4), "lat": np.arange(3) * 10, "lon": np.arange(5), "area": (("lat", "lon"), np.abs(E)), "region": (("lat",), np.array(["a", "b", "b"]))},
    )


@pytest.fixture(scope="module")
def dated(spark):
    return Cube.from_arrays(spark, {"t": (("time", "lat"), T[:, :, 1])}, {"time": DAYS, "lat": np.arange(3)})


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [("x", 1, 2.0), ("x", 3, float("nan")), ("y", 2, 5.0), ("y", 3, 0.0)]
    return Cube.from_frame(spark.createDataFrame(rows, "a string, b int, v double"), ["a", "b"], ["v"])


def same(got, expected):
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(expected, float), atol=1e-9)


@pytest.mark.parametrize(
    ("op", "func"),
    [("mean", np.nanmean), ("sum", np.nansum), ("min", np.nanmin), ("max", np.nanmax), ("std", np.nanstd), ("var", np.nanvar), ("median", np.nanmedian), ("prod", np.nanprod), ("count", lambda x, axis: (~np.isnan(x)).sum(axis))],
)
@pytest.mark.parametrize("dims", [("lat",), ("time", "lon")])
def test_reductions(cube, op, func, dims):
    axis = tuple("time lat lon".split().index(d) for d in dims)
    same(getattr(cube.plan["temperature"], op)(list(dims)).to_numpy(), func(T, axis=axis))


def test_reductions_of_truth(cube):
    x = cube.plan["temperature"].where("temperature > 0", 0.0)
    positive = np.where(T > 0, T, 0.0)
    assert (x.any("lat").to_numpy() == positive.any(1)).all()
    assert (x.all("lat").to_numpy() == positive.all(1)).all()


def test_a_variable_without_the_dimension_is_reduced_cell_by_cell(cube):
    out = cube.plan.std("time")
    same(out["elevation"].to_numpy(), np.zeros_like(E))
    same(cube.plan.mean("time")["elevation"].to_numpy(), E)


def test_options_of_reductions(cube):
    same(cube.plan["temperature"].var("time", ddof=1).to_numpy(), np.nanvar(T, axis=0, ddof=1))
    same(cube.plan["temperature"].sum("time", min_count=4).to_numpy(), np.where(np.isnan(T).any(0), np.nan, np.nansum(T, 0)))
    same(cube.plan["temperature"].mean("time", skipna=False).to_numpy(), T.mean(0))
    same(cube.plan["temperature"].reduce(np.nanmax, "lat").to_numpy(), np.nanmax(T, 1))
    same(cube.plan["temperature"].reduce(lambda x, axis: np.nanmax(x, axis=axis) - np.nanmin(x, axis=axis), "lat").to_numpy(), np.nanmax(T, 1) - np.nanmin(T, 1))
    kept = cube.plan["temperature"].mean("lat", keepdims=True)
    assert kept.to_numpy().shape == (4, 1, 5) and "lat" not in kept.coords


def test_errors(cube):
    with pytest.raises(InvalidExpressionError):
        cube.plan.mean("lon").isel(lon=0).explain()
    with pytest.raises(ValueError, match="no dimension"):
        cube.plan.mean("depth").collect()
    with pytest.raises(IndexError):
        cube.plan.isel(time=9).collect()
    with pytest.raises(KeyError):
        cube.plan.sel(lat=5).collect()
    with pytest.raises(ValueError, match="has no value"):
        cube.plan.isel(time=[]).max("time").collect()
    with pytest.raises(ValueError, match="divide"):
        cube.plan.coarsen(lon=2).mean().collect()
    with pytest.raises(UnsupportedError):
        cube.plan.to_netcdf("x")
    with pytest.raises(AttributeError):
        _ = cube.plan._hidden


INDEXES = [0, -1, slice(1, 3), slice(None, None, 2), slice(-3, None), slice(None, None, -1), [2, 0], [1, 1], [], [True, False, True, False], np.array([0, 3])]


@pytest.mark.parametrize("index", INDEXES, ids=str)
def test_positions(cube, index):
    same(cube.plan["temperature"].isel(time=index).to_numpy(), T[index if not isinstance(index, list) else np.array(index, bool if index and isinstance(index[0], bool) else int)])


def test_labels(cube, dated):
    same(cube.plan["temperature"].sel(lat=slice(5, 20)).to_numpy(), T[:, 1:])
    same(cube.plan["temperature"].sel(lat=[20, 0]).to_numpy(), T[:, [2, 0]])
    same(cube.plan["temperature"].sel(lat=13, method="nearest").to_numpy(), T[:, 1])
    same(cube.plan["temperature"].sel(lat=19, method="ffill").to_numpy(), T[:, 1])
    same(dated.plan["t"].sel(time="2000-01").to_numpy(), T[:2, :, 1])
    same(dated.plan["t"].sel(time="2000-01-31").to_numpy(), T[1, :, 1])
    same(dated.plan["t"].sel(time=slice("2000-01-31", "2000-02-01")).to_numpy(), T[1:3, :, 1])
    with pytest.raises(KeyError):
        cube.plan.sel(lat=13, method="nearest", tolerance=1).collect()


def test_coordinates_live_and_go(cube):
    assert set(cube.plan.isel(lat=0).coords) == {"time", "lat", "lon", "region", "area"}
    assert set(cube.plan.isel(lat=0, drop=True).coords) == {"time", "lon"}
    assert set(cube.plan.mean("lat").coords) == {"time", "lon"}
    assert set(cube.plan[["elevation"]].coords) == {"lat", "lon", "region", "area"}
    assert cube.plan.isel(lat=1).to_frame().select("region").distinct().first()[0] == "b"
    same(cube.plan["area"].to_numpy(), np.abs(E))


def test_names(cube):
    out = cube.plan.rename({"lat": "y", "temperature": "elevation", "elevation": "temperature"}).collect()
    same(out.plan["temperature"].to_numpy(), E)
    assert out.group_of("elevation").dims == ("time", "y", "lon")
    assert cube.plan.drop_vars("elevation").data_vars == ("temperature",)
    with pytest.raises(ValueError, match="called"):
        cube.plan.drop_vars(["nothing"]).collect()


def test_scans(cube):
    t = cube.plan["temperature"]
    same(t.cumsum("time").to_numpy(), np.nancumsum(T, 0))
    same(t.cumprod("lat").to_numpy(), np.nancumprod(T, 1))
    same(t.diff("time").to_numpy(), np.diff(T, axis=0))
    same(t.diff("lon", 2, "lower").to_numpy(), np.diff(T, 2, axis=2))
    same(t.isel(time=slice(None, None, 2)).diff("time").to_numpy(), np.diff(T[::2], axis=0))
    same(cube.plan["elevation"].isel(lat=0).cumsum("lon").to_numpy(), np.cumsum(E[0]))
    same(cube.plan["elevation"].cumsum().to_numpy(), np.cumsum(np.cumsum(E, 0), 1))


def test_single_cells(cube):
    t = cube.plan["temperature"]
    same(t.fillna(7).to_numpy(), np.nan_to_num(T, nan=7))
    same(t.clip(-0.5, 0.5).to_numpy(), np.clip(T, -0.5, 0.5))
    same(t.round(1).to_numpy(), np.round(T, 1))
    assert (t.isnull().to_numpy() == np.isnan(T)).all() and (t.notnull().to_numpy() == ~np.isnan(T)).all()
    assert cube.plan["elevation"].astype("float32").collect().groups[0].type_of("elevation").typeName() == "float"
    same(t.fillna(cube.plan["elevation"].collect()).to_numpy(), np.where(np.isnan(T), E[None], T))


def test_absent_rows_are_missing_cells(sparse):
    v = sparse.plan["v"]
    assert (v.isnull().to_numpy() == [[False, True, True], [True, False, False]]).all()
    same(v.sum("a").to_numpy(), [2, 5, 0])
    same(v.count("a").to_numpy(), [1, 1, 1])
    assert v.any("a").to_numpy().tolist() == [True, True, True]
    same(v.clip(1, 3).to_numpy(), [[2, np.nan, np.nan], [np.nan, 3, 1]])
    same(v.cumsum("b").to_numpy(), [[2, 2, 2], [0, 5, 5]])
    same(v.rolling(b=2, min_periods=1).sum().to_numpy(), [[2, 2, np.nan], [np.nan, 5, 5]])
    same(v.diff("b").to_numpy(), [[np.nan, np.nan], [np.nan, -5]])


def test_groups(dated, cube):
    t = T[:, :, 1]
    same(dated.plan["t"].groupby("time.month").mean().to_numpy(), [np.nanmean(t[:2], 0), np.nanmean(t[2:], 0)])
    same(dated.plan["t"].resample(time="2D").sum().to_numpy(), [np.nansum(t[:2], 0), np.nansum(t[2:], 0)])
    same(dated.plan["t"].groupby("time.month").mean(["time", "lat"]).to_numpy(), [np.nanmean(t[:2]), np.nanmean(t[2:])])
    same(dated.plan["t"].groupby("time.month")[2].to_numpy(), t[2:])
    out = cube.plan.groupby("region").mean().collect()
    same(out.plan["elevation"].to_numpy(), [E[0], E[1:].mean(0)])
    out = cube.plan.groupby("time").std().collect()
    assert out.group_of("elevation").dims == ("time", "lat", "lon")
    same(out.plan["elevation"].to_numpy(), np.zeros((4, 3, 5)))
    out = cube.plan.groupby("time").mean("lat").collect()
    same(out.plan["elevation"].to_numpy(), np.broadcast_to(E.mean(0), (4, 5)))
    bins = cube.plan["elevation"].groupby_bins("lat", [-1, 5, 25]).sum().collect()
    same(bins.plan.to_numpy(), [E[0], E[1:].sum(0)])


def test_windows(cube):
    t = cube.plan["temperature"]
    frame = lambda x, **k: np.stack([[pd.Series(x[:, i, j]).rolling(**k).agg("mean") for j in range(5)] for i in range(3)]).transpose(2, 0, 1)
    same(t.rolling(time=2).mean().to_numpy(), frame(T, window=2))
    same(t.rolling(time=3, center=True, min_periods=1).mean().to_numpy(), frame(T, window=3, center=True, min_periods=1))
    median = np.stack([[pd.Series(T[:, i, j]).rolling(3, min_periods=2).median() for j in range(5)] for i in range(3)]).transpose(2, 0, 1)
    same(t.rolling(time=3, min_periods=2).median().to_numpy(), median)
    assert t.rolling(time=2, lat=2, min_periods=1).sum().to_numpy()[1, 1, 0] == pytest.approx(T[:2, :2, 0].sum())
    same(t.coarsen(lon=2, boundary="trim").sum().to_numpy(), np.nansum(T[:, :, :4].reshape(4, 3, 2, 2), 3))
    same(t.coarsen(lon=2, boundary="pad").max().to_numpy(), np.nanmax(np.concatenate([T, np.full((4, 3, 1), np.nan)], 2).reshape(4, 3, 3, 2), 3))
    same(cube.plan["elevation"].isel(lat=0).rolling(lon=2).sum().to_numpy(), pd.Series(E[0]).rolling(2).sum())
    assert cube.plan.coarsen(lat=3).mean().to_frame().select("lat").distinct().first()[0] == 10


def test_weights(cube):
    t, w = cube.plan["temperature"], np.array([1.0, 2.0, 3.0])
    held = np.where(np.isnan(T), 0, w[None, :, None])
    mean = np.nansum(T * w[None, :, None], 1) / held.sum(1)
    same(t.weighted(SmallArray(w, "lat")).mean("lat").to_numpy(), mean)
    same(t.weighted(SmallArray(w, "lat")).sum("lat").to_numpy(), np.nansum(T * w[None, :, None], 1))
    var = np.nansum(w[None, :, None] * (T - mean[:, None]) ** 2, 1) / held.sum(1)
    same(t.weighted(SmallArray(w, "lat")).std("lat").to_numpy(), np.sqrt(var))
    same(t.weighted(SmallArray([1.0, 3.0], "lat", {"lat": [10, 20]})).sum("lat").to_numpy(), np.nansum(T[:, 1:] * np.array([1, 3])[None, :, None], 1))
    assert set(t.weighted(SmallArray([1.0, 2.0], "member")).mean("lat").dims) == {"time", "lon", "member"}
    same(t.weighted(cube.plan["area"].collect()).mean(["lat", "lon"]).to_numpy(), np.nansum(T * np.abs(E), (1, 2)) / np.where(np.isnan(T), 0, np.abs(E)).sum((1, 2)))
    same(t.weighted(SmallArray(w, "lat")).sum_of_weights("lat").to_numpy(), np.where(held.sum(1) == 0, np.nan, held.sum(1)))
    with pytest.raises(ValueError, match="have no dimension"):
        cube.plan.weighted(SmallArray(w, "lat")).mean("time").collect()


def test_calls_without_a_model(cube):
    same(cube.plan["temperature"].where("temperature > 0").to_numpy(), np.where(T > 0, T, np.nan))
    same(cube.plan["temperature"].where("lat > 5").to_numpy(), np.where(np.arange(3)[None, :, None] > 0, T, np.nan))
    same(cube.plan.pipe(lambda x: x.plan.mean("lat").collect())["elevation"].to_numpy(), E.mean(0))
    same(cube.plan["elevation"].transpose("lon", "lat").to_numpy(), E.T)
    same(cube.plan["temperature"].first("time").to_numpy(), pd.DataFrame(T.reshape(4, -1)).bfill().iloc[0].to_numpy().reshape(3, 5))
    same(cube.plan["elevation"].isel(lat=SmallArray([0, 2], "p"), lon=SmallArray([1, 4], "p")).to_numpy(), E[[0, 2], [1, 4]])
    same(cube.plan["elevation"][1:, 0].to_numpy(), E[1:, 0])


def test_a_discarded_error_does_not_run(cube):
    out = cube.plan.assign(name="'buoy'").std("time")[["temperature"]]
    same(out["temperature"].to_numpy(), np.nanstd(T, 0))


def test_results(cube, tmp_path):
    r = cube.plan["elevation"]
    assert r.to_pandas().loc[(0, 3)] == pytest.approx(E[0, 3])
    assert r.to_dict()["dims"] == {"lat": 3, "lon": 5}
    assert cube.plan["temperature"].to_masked_array().mask.sum() == np.isnan(T).sum()
    assert cube.plan["lat"].isel(lat=slice(1, None)).to_index().tolist() == [10, 20]
    assert cube.plan.mean("time").to_array().count() == 30
    assert cube.plan.mean("time").to_stacked_array("z", "lat").count() == 30
    assert cube.plan.chunk({"lon": 2}).to_parquet(str(tmp_path / "out")) is None
    assert cube.plan.sizes == {"time": 4, "lat": 3, "lon": 5}


def test_written_cubes_open_and_prune(cube, spark, tmp_path):
    path = str(tmp_path / "cube")
    cube.plan.chunk({"time": 2}).isel(time=slice(1, None)).to_parquet(path)
    back = Cube.open(spark, path)
    same(back.plan["temperature"].to_numpy(), T[1:])
    assert back.sizes == {"time": 3, "lat": 3, "lon": 5} and set(back.plan.coords) == set(cube.plan.coords)
    df = back.plan.mean("lat").mean("lon").isel(time=2)[["temperature"]].collect().groups[0].df
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(`@time`,2)" in text and "elevation" not in text
    assert back.plan.rolling(lat=2).mean().isel(time=0)["elevation"].to_numpy().shape == (3, 5)


def test_axes_can_be_given(spark):
    cells = spark.createDataFrame([("b", 1.0), ("z", 9.0)], "k string, v double")
    cube = Cube.from_frame(cells, ["k"], ["v"], labels={"k": spark.createDataFrame([("a",), ("b",), ("c",)], "k string")})
    same(cube.plan["v"].fillna(0).to_numpy(), [0, 1, 0])
    numbered = spark.createDataFrame([("z", 0), ("b", 1)], "k string, `@k` long")
    same(Cube.from_frame(cells, ["k"], ["v"], labels={"k": numbered}).plan["v"].to_numpy(), [9, 1])


CALLS = st.sampled_from([
    ("isel", (), {"time": slice(0, 3)}), ("isel", (), {"lat": 1}), ("isel", (), {"lon": [0, 2, 4]}), ("isel", (), {"lon": slice(1, None, 2)}), ("isel", (), {"time": []}), ("sel", (), {"lon": slice(1, 3)}), ("mean", ("lat",), {}), ("sum", ("time",), {}),
    ("std", ("lon",), {}), ("cumsum", ("lon",), {}), ("diff", ("time",), {}), ("fillna", (0.5,), {}), ("clip", (-1, 1), {}), ("chunk", ({"lat": 2},), {}), ("groupby", ("lat",), {}), ("rolling", (), {"time": 2, "min_periods": 1}), ("coarsen", (), {"lon": 2, "boundary": "trim"}),
    ("weighted", (SmallArray([1.0, 2.0, 3.0], "lat"),), {}), ("__getitem__", (["temperature"],), {}), ("rename", ({"time": "t"},), {}),
])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow], derandomize=True)
@given(st.lists(CALLS, min_size=2, max_size=4))
def test_rewritten_chains_give_what_was_written(cube, calls):
    plan = cube.plan
    for name, args, kwargs in calls:
        plan = plan._then(name, args, kwargs)
        if name in ("groupby", "rolling", "coarsen"):
            plan = plan.mean()
        elif name == "weighted":
            plan = plan.mean("lat")
    try:
        written = plan.collect(optimize=False)
        expected = {v: written.plan._then("__getitem__", ([v],), {}).collect() for v in written.data_vars}
        values = {v: (c.group_of(v).dims, c.plan._then("__getitem__", (v,), {}).to_numpy()) for v, c in expected.items()}
    except (ValueError, KeyError, IndexError, InvalidExpressionError):
        return  # not a chain that can run
    try:
        rewritten = plan.collect()
    except InvalidExpressionError:
        raise AssertionError("refused a chain that runs") from None
    for v, (dims, value) in values.items():
        assert set(rewritten.group_of(v).dims) == set(dims)
        got = rewritten.plan._then("__getitem__", (v,), {}).transpose(*dims).to_numpy() if dims else rewritten.plan._then("__getitem__", (v,), {}).to_numpy()
        same(got, value)
