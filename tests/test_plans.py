"""Plans alone: what is recorded, paired, rewritten and shown. No Spark."""

import numpy as np
import pytest

from labelcube import InvalidExpressionError, SmallArray
from labelcube.plans.pairing import pair
from labelcube.plans.render import format_plan
from labelcube.plans.rules import rewrite
from labelcube.plans.shape import Shape, fold
from labelcube.plans.specs import Label, Pointwise, Positions, Scalar, Slice, classify_chunk, classify_index, compose
from labelcube.plans.steps import (
    EVERY, Dims, Elementwise, GroupedReduce, Opaque, Opener, Project, Rechunk, Reduce, Rename, Scan, Select, WeightedReduce, WindowedReduce, step_of,
)

SHAPE = Shape(
    {"temperature": ("time", "lat", "lon"), "elevation": ("lat", "lon"), "time": ("time",), "lat": ("lat",), "lon": ("lon",), "area": ("lat", "lon")},
    frozenset(["time", "lat", "lon", "area"]), {"time": 4, "lat": 3, "lon": 5},
)
WEIGHTS = SmallArray([1.0, 2.0, 3.0], "lat")


def chain(*calls):
    return [step_of(name, args, kwargs) for name, args, kwargs in calls]


def c(name, *args, **kwargs):
    return name, args, kwargs


def done(*calls, shape=SHAPE):
    return rewrite(pair(chain(*calls), shape), shape)


def names(steps):
    return [s.name for s in steps]


@pytest.mark.parametrize(
    ("value", "by_label", "kind"),
    [
        (0, False, Scalar(0)), (np.int64(2), False, Scalar(2)), (np.array(3), False, Scalar(3)), (slice(0, 10), False, Slice(0, 10)), (slice(-3, None), False, Slice(-3, None)), ([0, 2], False, Positions((0, 2))),
        ([], False, Positions(())), ([True, False, True], False, Positions((0, 2))), (np.array([False, True]), False, Positions((1,))), ("2020", True, Label("2020")), ([1, 2], True, Label([1, 2])),
        (SmallArray([1, 2], "time"), False, Positions((1, 2))),
    ],
)
def test_index_kinds(value, by_label, kind):
    assert classify_index("time", value, by_label) == kind


def test_an_array_along_another_dimension_selects_pointwise():
    assert isinstance(classify_index("time", SmallArray([1, 2], "pick"), False), Pointwise)


@pytest.mark.parametrize(
    ("outer", "inner", "both"),
    [
        (Slice(100, 1000), Slice(10, 20), Slice(110, 120, 1)), (Slice(10, 100, 2), Slice(1, 4), Slice(12, 18, 2)), (Slice(100, 1000), Scalar(5), Scalar(105)), (Slice(10, 20), Slice(50, 60), Slice(60, 20, 1)),
        (Positions((10, 20, 30)), Scalar(-1), Scalar(30)), (Positions((10, 20, 30)), Slice(None, 2), Positions((10, 20))), (Slice(5, None), Positions((0, 3)), Positions((5, 8))),
        (Slice(0, 10), Scalar(-1), None), (Slice(0, 10), Slice(None, None, -1), None), (Slice(0, 3), Scalar(7), None), (Scalar(1), Slice(0, 1), None), (Positions((1, 2)), Scalar(5), None), (Slice(-3, None), Scalar(0), None),
    ],
)
def test_composition(outer, inner, both):
    assert compose(outer, inner) == both


@pytest.mark.parametrize("n", [0, 1, 7, 30])
@pytest.mark.parametrize("outer", [slice(0, 10), slice(2, None, 3), slice(5, 6)])
@pytest.mark.parametrize("inner", [slice(1, 4), slice(None, None, 2), slice(0, 0)])
def test_composed_slices_select_the_same(n, outer, inner):
    both = compose(classify_index("d", outer, False), classify_index("d", inner, False))
    assert list(range(n))[both.raw()] == list(range(n))[outer][inner]


@pytest.mark.parametrize(("value", "kind", "crossable"), [(100, "size", True), (-1, "whole", True), (None, "same", True), ("auto", "auto", False), ("10MB", "bytes", False), ((2, 3), "blocks", False), (0, "odd", False), (-2, "odd", False), (True, "odd", False), (1.5, "odd", False)])
def test_chunk_kinds(value, kind, crossable):
    assert (classify_chunk(value).kind, classify_chunk(value).crossable) == (kind, crossable)


@pytest.mark.parametrize(
    ("call", "kind"),
    [
        (c("mean", "lat"), Reduce), (c("reduce", np.mean, "lat"), Reduce), (c("isel", time=0), Select), (c("sel", {"time": 1}), Select), (c("isel", time=SmallArray([1], "x")), Opaque), (c("cumsum", "time"), Scan),
        (c("fillna", 0), Elementwise), (c("fillna", {"a": 0}), Opaque), (c("fillna", WEIGHTS), Opaque), (c("chunk", {"time": 2}), Rechunk), (c("__getitem__", ["a"]), Project), (c("__getitem__", ("a", "b")), Project),
        (c("__getitem__", {"time": 0}), Opaque), (c("rename", {"a": "b"}), Rename), (c("groupby", "time.month"), Opener), (c("rolling_exp", time=2), Opener), (c("where", "x > 0"), Opaque), (c("first"), Opaque),
    ],
)
def test_calls_become_steps(call, kind):
    assert type(step_of(*call)) is kind


def test_dimensions_of_a_reduction():
    assert step_of("mean", (), {}).dims is EVERY
    assert step_of("mean", (...,), {}).dims is EVERY
    assert step_of("mean", ("lat",), {}).dims == Dims(frozenset(["lat"]))
    assert step_of("mean", (), {"dim": ["lat", "lon"]}).dims.names == {"lat", "lon"}


def test_every_spelling_of_an_index_is_the_same():
    for step in (step_of("isel", (), {"time": 0}), step_of("isel", ({"time": 0},), {}), step_of("isel", (), {"indexers": {"time": 0}})):
        assert step.index == {"time": Scalar(0)}


def test_the_known_chain():
    assert format_plan(done(c("mean", "lat"), c("mean", "lon"), c("isel", time=0))) == (
        "plan (3 ops):\n  1. Select  isel(time=0)\n  2. Reduce  mean('lat')  [consumes={lat}]\n  3. Reduce  mean('lon')  [consumes={lon}]"
    )


@pytest.mark.parametrize(
    ("steps", "text"),
    [
        ([], "plan (0 ops)"),
        (chain(c("mean", dim="lat")), "plan (1 ops):\n  1. Reduce  mean(dim='lat')  [consumes={lat}]"),
        (chain(c("mean")), "plan (1 ops):\n  1. Reduce  mean()  [consumes=every dim]"),
        (chain(c("mean", "lat", keepdims=True)), "plan (1 ops):\n  1. Reduce  mean('lat', keepdims=True)  [keeps {lat} at size 1]"),
        (chain(c("first")), "plan (1 ops):\n  1. Opaque  first()  [not modelled -- nothing crosses it]"),
        (chain(c("__getitem__", ["temperature"])), "plan (1 ops):\n  1. Project  [['temperature']]"),
        (chain(c("cumsum", "time")), "plan (1 ops):\n  1. Scan  cumsum('time')"),
    ],
)
def test_plans_as_text(steps, text):
    assert format_plan(steps) == text


def test_pairs_show_both_calls_on_one_line():
    assert format_plan(done(c("groupby", "time.month"), c("mean"))) == "plan (1 ops):\n  1. GroupedReduce  groupby('time.month').mean()  [time -> month]"
    assert format_plan(done(c("rolling", time=3), c("mean"))) == "plan (1 ops):\n  1. WindowedReduce  rolling(time=3).mean()"
    text = format_plan(done(c("weighted", WEIGHTS), c("mean", "time")))
    assert text == "plan (1 ops):\n  1. WeightedReduce  weighted(<SmallArray>).mean('time')  [weights over {lat}, consumes={time}]"


@pytest.mark.parametrize(
    ("opener", "closer", "kind"),
    [
        (c("groupby", "time.month"), c("mean"), GroupedReduce), (c("groupby", "lat"), c("sum"), GroupedReduce), (c("groupby_bins", "lat", [0, 1]), c("max"), GroupedReduce), (c("resample", time="2D"), c("mean"), GroupedReduce),
        (c("rolling", time=3), c("mean", "lat"), WindowedReduce), (c("rolling", {"time": np.int64(3)}), c("mean"), WindowedReduce), (c("coarsen", time=2, boundary="trim"), c("all"), WindowedReduce), (c("weighted", WEIGHTS), c("var"), WeightedReduce),
    ],
)
def test_pairs_fuse(opener, closer, kind):
    (step,) = pair(chain(opener, closer), SHAPE)
    assert type(step) is kind


@pytest.mark.parametrize(
    ("opener", "closer"),
    [
        (c("groupby", "region"), c("mean")), (c("groupby", "time.month"), c("mean", "lat")), (c("groupby", "time.month"), c("mean", keepdims=True)), (c("groupby", "time.month"), c("first")), (c("rolling", time=3), c("all")),
        (c("rolling", time=3, lat=2.5), c("mean")), (c("rolling_exp", time=3), c("mean")), (c("cumulative", "time"), c("sum")), (c("weighted", WEIGHTS), c("sum_of_weights")), (c("weighted", 3), c("mean")), (c("groupby", "time.month"), c("__getitem__", 1)),
    ],
)
def test_other_pairs_are_opaque_as_a_whole(opener, closer):
    steps = pair(chain(opener, closer), SHAPE)
    assert type(steps[0]) is Opaque
    assert all(type(s) in (Opaque, Project) for s in steps)


def test_pairing_twice_changes_nothing():
    steps = pair(chain(c("groupby", "time.month"), c("mean"), c("rolling_exp", lat=2), c("mean")), SHAPE)
    assert pair(steps, SHAPE) == steps


@pytest.mark.parametrize(
    ("calls", "expected"),
    [
        ((c("isel", time=slice(100, 1000)), c("isel", time=slice(10, 20))), ["isel(time=slice(110, 120, 1))"]),
        ((c("isel", time=0), c("isel", lat=1)), ["isel(time=0, lat=1)"]),
        ((c("isel", time=0, drop=True), c("isel", lat=1)), ["isel(time=0, drop=True)", "isel(lat=1)"]),
        ((c("isel", time=slice(0, 3)), c("isel", time=-1, lat=0)), ["isel(time=slice(0, 3, None))", "isel(time=-1, lat=0)"]),
        ((c("sel", time=0), c("isel", lat=1)), ["sel(time=0)", "isel(lat=1)"]),
        ((c("__getitem__", ["temperature", "elevation"]), c("__getitem__", ["elevation"])), ["[['elevation']]"]),
        ((c("chunk", {"time": 2, "lat": 1}), c("chunk", {"time": 4, "lat": None})), ["chunk({'time': 4, 'lat': 1})"]),
        ((c("chunk", {"time": 2}), c("isel", time=0)), ["isel(time=0)"]),
        ((c("chunk", {"time": "auto"}), c("isel", time=0)), ["chunk({'time': 'auto'})", "isel(time=0)"]),
        ((c("chunk", {"time": 2}, token="x"), c("isel", lat=0)), ["chunk({'time': 2}, token='x')", "isel(lat=0)"]),
        ((c("mean", "lat"), c("__getitem__", ["temperature"])), ["[['temperature']]", "mean('lat')"]),
        ((c("mean", "time"), c("__getitem__", ["elevation"])), ["mean('time')", "[['elevation']]"]),
        ((c("__getitem__", ["temperature"]), c("__getitem__", "lat")), ["['lat']"]),
        ((c("cumsum", "time"), c("isel", lat=0)), ["isel(lat=0)", "cumsum('time')"]),
        ((c("cumsum", "time"), c("isel", time=0)), ["cumsum('time')", "isel(time=0)"]),
        ((c("fillna", 0), c("isel", time=0)), ["isel(time=0)", "fillna(0)"]),
        ((c("rename", {"time": "t"}), c("isel", t=0)), ["rename({'time': 't'})", "isel(t=0)"]),
        ((c("rename", {"time": "t"}), c("isel", lat=0)), ["isel(lat=0)", "rename({'time': 't'})"]),
        ((c("groupby", "time.month"), c("mean"), c("isel", lat=0)), ["isel(lat=0)", "groupby('time.month').mean()"]),
        ((c("groupby", "time.month"), c("mean"), c("isel", month=0)), ["groupby('time.month').mean()", "isel(month=0)"]),
        ((c("rolling", time=3), c("mean"), c("isel", time=0)), ["rolling(time=3).mean()", "isel(time=0)"]),
        ((c("where", "x > 0"), c("isel", time=0)), ["where('x > 0')", "isel(time=0)"]),
        ((c("mean", "lat", keepdims=True), c("isel", lat=0)), ["mean('lat', keepdims=True)", "isel(lat=0)"]),
    ],
)
def test_rewrites(calls, expected):
    from labelcube.plans.render import calls as text

    steps = done(*calls)
    assert [text(s) for s in steps] == expected
    assert [text(s) for s in rewrite(steps, SHAPE)] == expected


def test_an_impossible_chain_is_refused_before_any_data():
    with pytest.raises(InvalidExpressionError, match=r"isel\(\) indexes \['lon'\], which mean\(\) has already reduced away"):
        done(c("mean", "lon"), c("isel", lon=0))
    assert names(done(c("mean", "lon"), c("isel", lon=0, missing_dims="ignore"))) == ["mean", "isel"]


def test_weighted_lets_projections_pass_that_keep_its_dimensions():
    assert names(done(c("weighted", WEIGHTS), c("mean", "time"), c("__getitem__", ["temperature"]))) == ["__getitem__", "weighted"]
    assert names(done(c("weighted", WEIGHTS), c("mean", "time"), c("isel", lon=0))) == ["weighted", "isel"]


@pytest.mark.parametrize(
    ("step", "blocks", "needs"),
    [
        (step_of("mean", ("lat",), {}), {"lat"}, {"lat"}), (step_of("fillna", (0,), {}), set(), set()), (step_of("cumsum", ("time",), {}), {"time"}, {"time"}), (step_of("rename", ({"a": "b"},), {}), {"b"}, None),
        (step_of("drop_vars", ("a",), {}), set(), None), (step_of("isel", (), {"lat": 0}), None, {"lat"}), (step_of("chunk", ({"time": 1},), {}), None, None), (step_of("first", (), {}), None, None),
    ],
)
def test_what_may_pass(step, blocks, needs):
    for dim in ("time", "lat", "lon", "b"):
        assert step.yields_to(frozenset([dim]), SHAPE) == (blocks is not None and dim not in blocks)
    for spans in (["time"], ["lat"], ["time", "lat"], []):
        assert step.takes([frozenset([d]) for d in spans], SHAPE) == (needs is not None and needs <= set(spans))


def test_shapes_through_a_plan():
    shapes = fold(SHAPE, pair(chain(c("isel", time=slice(1, 3)), c("mean", "lat"), c("groupby", "time.month"), c("mean")), SHAPE))
    assert shapes[1].sizes == {"time": 2, "lat": 3, "lon": 5}
    assert shapes[2].variables["temperature"] == ("time", "lon") and "area" not in shapes[2].variables
    assert shapes[3].variables["elevation"] == ("month", "lon") and shapes[3].sizes["month"] is None
    assert fold(SHAPE, chain(c("first"), c("mean")))[-1] is None
    assert fold(SHAPE, chain(c("diff", "time")))[-1].sizes["time"] == 3
    assert fold(SHAPE, pair(chain(c("coarsen", time=3, boundary="pad"), c("mean")), SHAPE))[-1].sizes["time"] == 2


def test_unknown_sizes_change_no_rewrite():
    blank = Shape(SHAPE.variables, SHAPE.coords, dict.fromkeys(SHAPE.sizes))
    calls = (c("mean", "lat"), c("cumsum", "lon"), c("isel", time=slice(0, 2)), c("isel", time=[0]), c("__getitem__", ["temperature"]))
    assert names(done(*calls)) == names(done(*calls, shape=blank))
