"""Queries over the sample tables, one or more for each operator, with DuckDB SQL for what SQL can say."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import SmallArray
from .sources import activity, by_nation, embeddings, sales_day, sales_month

Query = Callable[[SparkSession, str], DataFrame]
#: Added before rounding: sums that end on a half then round alike, in whatever order they were added up.
NUDGE = 1e-7

MONTH = "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, sum(l_extendedprice) AS price FROM lineitem GROUP BY ALL"
DAY = MONTH.replace("'month'", "'day'").replace("AS month", "AS day")
HOUR = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, sum(value) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL"
NATION = "SELECT n_name AS nation, r_name AS region, c_mktsegment AS segment, avg(c_acctbal) AS acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


def _ranked(cells: str, dim: str) -> str:
    """Cells with the position p of their label along dim."""
    return f"(SELECT *, CAST(dense_rank() OVER (ORDER BY {dim}) - 1 AS BIGINT) AS p FROM ({cells}))"


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, digits) for c in columns})


def _nudged(sql: str) -> str:
    """The same nudge in SQL: round(x, n) becomes round((x) + 1e-7, n)."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 6
        while depth or sql[end] != ",":
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        out += f"{sql[at:start]}round(({sql[start + 6 : end]}) + {NUDGE}"
        at = end
    return out + sql[at:]


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = _nudged(sql)


def _chain(source: Callable, chain: Callable[[Any], Any], *rounded: str, digits: int = 4) -> Query:
    return lambda spark, sf_dir: _rounded(chain(source(spark, sf_dir).plan).to_frame(), *rounded, digits=digits)


# Flagship
FLAGSHIP = _chain(sales_month, lambda p: p.mean("status").mean("flag").isel(month=14)[["qty"]], "qty")
_add("flagship_reduce_select", FLAGSHIP,
     f"SELECT month, round(avg(q), 4) AS qty FROM (SELECT month, p, flag, avg(qty) AS q FROM {_ranked(MONTH, 'month')} GROUP BY ALL) WHERE p = 14 GROUP BY month")

# Reductions
for _op, _sql in {
    "count": "CAST(count({v}) AS BIGINT)", "sum": "round(coalesce(sum({v}), 0), 4)", "mean": "round(avg({v}), 4)", "min": "round(min({v}), 4)", "max": "round(max({v}), 4)",
    "std": "round(stddev_pop({v}), 4)", "var": "round(var_pop({v}), 0)", "median": "round(median({v}), 4)",
}.items():
    _digits = 0 if _op == "var" else 4
    _add(f"reduce_{_op}", (lambda op, digits: lambda spark, sf_dir: (lambda df: df if op == "count" else _rounded(df, "qty", "price", digits=digits))(getattr(sales_month(spark, sf_dir).plan, op)("flag").to_frame()))(_op, _digits),
         f"WITH c AS ({MONTH}) SELECT month, status, {_sql.format(v='qty')} AS qty, {_sql.format(v='price')} AS price FROM c GROUP BY month, status"
         if _op not in ("count", "sum") else
         f"WITH c AS ({MONTH}), g AS (SELECT * FROM (SELECT DISTINCT month FROM c), (SELECT DISTINCT status FROM c)) SELECT g.month, g.status, {_sql.format(v='qty')} AS qty, {_sql.format(v='price')} AS price FROM g LEFT JOIN c USING (month, status) GROUP BY g.month, g.status")
_add("reduce_prod", lambda spark, sf_dir: _rounded(activity(spark, sf_dir).plan[["n"]].prod("event_type").to_frame(), "n"),
     f"WITH c AS ({HOUR}) SELECT hour, round(CAST(product(n) AS DOUBLE), 4) AS n FROM c GROUP BY hour")
_add("reduce_all", lambda spark, sf_dir: activity(spark, sf_dir).plan.assign(total=F.col("total") > 0)[["total"]].all("event_type").to_frame(),
     f"WITH c AS ({HOUR}) SELECT hour, bool_and(total > 0) AS total FROM c GROUP BY hour")
_add("reduce_any", lambda spark, sf_dir: activity(spark, sf_dir).plan.fillna(0.0).assign(total=F.col("total") > 200)[["total"]].any("event_type").to_frame(),
     f"WITH c AS ({HOUR}) SELECT hour, bool_or(total > 200) AS total FROM c GROUP BY hour")
_add("reduce_any_missing_is_true", lambda spark, sf_dir: activity(spark, sf_dir).plan[["n"]].any("hour").to_frame(),
     f"WITH c AS ({HOUR}) SELECT event_type, true AS n FROM c GROUP BY event_type")
_add("reduce_bare", _chain(sales_month, lambda p: p.mean(), "qty", "price"), f"WITH c AS ({MONTH}) SELECT round(avg(qty), 4) AS qty, round(avg(price), 4) AS price FROM c")
_add("reduce_two_dims", _chain(sales_day, lambda p: p.sum(["flag", "status"]), "qty", "price"),
     f"WITH c AS ({DAY}) SELECT day, round(sum(qty), 4) AS qty, round(sum(price), 4) AS price FROM c GROUP BY day")
_add("reduce_keepdims", _chain(sales_month, lambda p: p.mean("flag", keepdims=True), "qty", "price"),
     f"WITH c AS ({MONTH}) SELECT month, CAST(0 AS BIGINT) AS flag, status, round(avg(qty), 4) AS qty, round(avg(price), 4) AS price FROM c GROUP BY month, status")
_add("reduce_ddof", _chain(sales_month, lambda p: p[["qty"]].var("month", ddof=1), "qty", digits=2), f"WITH c AS ({MONTH}) SELECT flag, status, round(var_samp(qty), 2) AS qty FROM c GROUP BY flag, status")
_add("reduce_udf", _chain(sales_month, lambda p: p[["qty"]].reduce(lambda x, axis=None: np.nanmax(x, axis=axis) - np.nanmin(x, axis=axis), "flag"), "qty"),
     f"WITH c AS ({MONTH}) SELECT month, status, round(max(qty) - min(qty), 4) AS qty FROM c GROUP BY month, status")

# Selections
for _name, _chain_, _where in (
    ("isel_slice", lambda p: p.isel(day=slice(10, 40)), "p >= 10 AND p < 40"),
    ("isel_step", lambda p: p.isel(day=slice(5, 900, 7)), "p >= 5 AND p < 900 AND (p - 5) % 7 = 0"),
    ("isel_list", lambda p: p.isel(day=[0, 2, 4, 99]), "p IN (0, 2, 4, 99)"),
    ("isel_mask", lambda p: p.isel(day=[False, True, True, False, True]), "p IN (1, 2, 4)"),
    ("isel_neg", lambda p: p.isel(day=slice(-3, None)), "p >= (SELECT count(DISTINCT day) FROM c) - 3"),
    ("isel_compose", lambda p: p.isel(day=slice(100, 1000)).isel(day=slice(10, 20)), "p >= 110 AND p < 120"),
    ("isel_empty", lambda p: p.isel(day=[]), "false"),
    ("sel_slice", lambda p: p.sel(day=slice("1995-03-01", "1995-04-15")), "day BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-04-15'"),
    ("sel_partial_date", lambda p: p.sel(day="1996-02"), "day >= TIMESTAMP '1996-02-01' AND day < TIMESTAMP '1996-03-01'"),
):
    _add(_name, _chain(sales_day, _chain_, "qty", "price"), f"WITH c AS ({DAY}) SELECT day, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM {_ranked('SELECT * FROM c', 'day')} WHERE {_where}")
_add("isel_scalar", _chain(sales_day, lambda p: p.isel(day=3), "qty", "price"),
     f"WITH c AS ({DAY}) SELECT day, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM {_ranked('SELECT * FROM c', 'day')} WHERE p = 3")
_add("isel_scalar_drop", _chain(sales_day, lambda p: p.isel(day=3, drop=True), "qty", "price"),
     f"WITH c AS ({DAY}) SELECT flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM {_ranked('SELECT * FROM c', 'day')} WHERE p = 3")
_add("isel_repeats", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan.isel(month=[5, 2, 2]).to_frame(), "qty", "price"),
     f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM {_ranked('SELECT * FROM c', 'month')} JOIN (VALUES (5), (2), (2)) AS w(i) ON p = i")
_add("isel_reversed", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan.isel(month=slice(None, None, -1)).isel(month=0).to_frame(), "qty", "price"),
     f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM c WHERE month = (SELECT max(month) FROM c)")
_add("sel_label", _chain(sales_month, lambda p: p.sel(flag="R", status="F"), "qty", "price"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM c WHERE flag = 'R' AND status = 'F'")
_add("sel_list", _chain(sales_month, lambda p: p.sel(flag=["A", "R"]), "qty", "price"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM c WHERE flag IN ('A', 'R')")
_add("sel_nearest", lambda spark, sf_dir: _rounded(embeddings(spark, sf_dir).plan.sel(vec=17.4, method="nearest").isel(k=[0, 1, 2]).to_frame(), "x"),
     "SELECT vec_id AS vec, CAST(label AS INTEGER) AS label, CAST(k AS BIGINT) AS k, round(CAST(embedding[k + 1] AS DOUBLE), 4) AS x FROM embeddings, (VALUES (0), (1), (2)) AS w(k) WHERE vec_id = 17")
_add("isel_pointwise", lambda spark, sf_dir: _rounded(embeddings(spark, sf_dir).plan.drop_vars(["label"]).isel(vec=SmallArray([3, 5], "pick"), k=SmallArray([1, 2], "pick")).to_frame(), "x"),
     "SELECT CAST(i AS BIGINT) AS pick, round(CAST(embedding[k + 1] AS DOUBLE), 4) AS x FROM embeddings JOIN (VALUES (0, 3, 1), (1, 5, 2)) AS w(i, v, k) ON vec_id = v")

# Variables
_add("project_list", _chain(sales_month, lambda p: p[["qty"]], "qty"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty FROM c")
_add("project_single", _chain(sales_month, lambda p: p["price"], "price"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(price, 4) AS price FROM c")
_add("project_coord", lambda spark, sf_dir: by_nation(spark, sf_dir).plan["region"].to_frame(), f"WITH c AS ({NATION}) SELECT DISTINCT nation, region FROM c")
_add("array_positions", _chain(sales_month, lambda p: p["qty"][0], "qty"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty FROM c WHERE month = (SELECT min(month) FROM c)")
_add("drop_vars", _chain(sales_month, lambda p: p.drop_vars(["price"]), "qty"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty FROM c")
_add("rename", _chain(sales_month, lambda p: p.rename({"month": "shipped", "qty": "price", "price": "qty"}), "qty", "price"),
     f"WITH c AS ({MONTH}) SELECT month AS shipped, flag, status, round(price, 4) AS qty, round(qty, 4) AS price FROM c")

# Single cells, over the full grid where a missing cell gets a value
GRID = f"WITH c AS ({HOUR}), g AS (SELECT * FROM (SELECT DISTINCT hour FROM c), (SELECT DISTINCT event_type FROM c)), d AS (SELECT hour, event_type, total, n FROM g LEFT JOIN c USING (hour, event_type))"
_add("ew_fillna", _chain(activity, lambda p: p[["total"]].fillna(-1.0), "total"), f"{GRID} SELECT hour, event_type, round(coalesce(total, -1), 4) AS total FROM d")
_add("ew_astype", _chain(activity, lambda p: p[["total"]].astype("int64")), f"WITH c AS ({HOUR}) SELECT hour, event_type, CAST(trunc(total) AS BIGINT) AS total FROM c")
_add("ew_round", lambda spark, sf_dir: embeddings(spark, sf_dir).plan.drop_vars("label").round(2).to_frame(),
     "SELECT vec_id AS vec, CAST(k AS BIGINT) AS k, round_even(CAST(embedding[k + 1] AS DOUBLE), 2) + 0.0 AS x FROM embeddings, range(64) AS w(k)")
_add("ew_clip", _chain(activity, lambda p: p[["total"]].clip(20.0, 100.0), "total"), f"WITH c AS ({HOUR}) SELECT hour, event_type, round(greatest(20, least(100, total)), 4) AS total FROM c")
_add("ew_isnull", _chain(activity, lambda p: p[["total"]].isnull()), f"{GRID} SELECT hour, event_type, total IS NULL AS total FROM d")
_add("ew_notnull", _chain(activity, lambda p: p[["total"]].notnull()), f"{GRID} SELECT hour, event_type, total IS NOT NULL AS total FROM d")
_add("ew_fillna_dict", _chain(activity, lambda p: p.fillna({"n": 0}), "total"), f"{GRID} SELECT hour, event_type, round(total, 4) AS total, coalesce(n, 0) AS n FROM d")

# Scans
_add("scan_cumsum", _chain(activity, lambda p: p[["total"]].cumsum("hour"), "total", digits=3),
     f"{GRID} SELECT hour, event_type, round(coalesce(sum(total) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING), 0), 3) AS total FROM d")
_add("scan_cumsum_bare", _chain(activity, lambda p: p[["n"]].cumsum(), "n"),
     f"{GRID}, a AS (SELECT hour, event_type, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING), 0) AS n FROM d) SELECT hour, event_type, round(CAST(sum(n) OVER (PARTITION BY hour ORDER BY event_type ROWS UNBOUNDED PRECEDING) AS DOUBLE), 4) AS n FROM a")
_add("scan_cumprod", lambda spark, sf_dir: _rounded(activity(spark, sf_dir).plan.assign(rate="1 + (n - 5) / 10000.0")[["rate"]].cumprod("hour").to_frame(), "rate"),
     f"{GRID} SELECT hour, event_type, round(coalesce(product(1 + (n - 5) / CAST(10000.0 AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING), 1.0), 4) AS rate FROM d")
for _label, _edge in (("upper", "p >= 1"), ("lower", "p < (SELECT max(p) FROM r)")):
    _fn = "qty - lag(qty)" if _label == "upper" else "lead(qty) {w} - qty"
    _w = "OVER (PARTITION BY flag, status ORDER BY month)"
    _value = f"qty - lag(qty) {_w}" if _label == "upper" else f"lead(qty) {_w} - qty"
    _add("scan_diff" if _label == "upper" else "scan_diff_lower", _chain(sales_month, (lambda label: lambda p: p[["qty"]].diff("month", label=label))(_label), "qty"),
         f"WITH c AS ({MONTH}), g AS (SELECT month, flag, status, qty FROM (SELECT * FROM (SELECT DISTINCT month FROM c), (SELECT DISTINCT flag FROM c), (SELECT DISTINCT status FROM c)) LEFT JOIN c USING (month, flag, status)), r AS {_ranked('SELECT * FROM g', 'month')}, d AS (SELECT p, month, flag, status, {_value} AS qty FROM r) SELECT month, flag, status, round(qty, 4) AS qty FROM d WHERE {_edge}")

# Groups
_add("group_component", _chain(sales_day, lambda p: p.groupby("day.month").mean(), "qty", "price"),
     f"WITH c AS ({DAY}) SELECT CAST(month(day) AS BIGINT) AS month, flag, status, round(avg(qty), 4) AS qty, round(avg(price), 4) AS price FROM c GROUP BY ALL")
_add("group_season", _chain(sales_day, lambda p: p[["qty"]].groupby("day.season").max(), "qty"),
     f"WITH c AS ({DAY}) SELECT CASE WHEN month(day) IN (12, 1, 2) THEN 'DJF' WHEN month(day) < 6 THEN 'MAM' WHEN month(day) < 9 THEN 'JJA' ELSE 'SON' END AS season, flag, status, round(max(qty), 4) AS qty FROM c GROUP BY ALL")
_add("group_year_all", _chain(sales_day, lambda p: p.groupby("day.year").median(["day", "flag", "status"]), "qty", "price"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, round(median(qty), 4) AS qty, round(median(price), 4) AS price FROM c GROUP BY ALL")
_add("group_dim", _chain(sales_month, lambda p: p.groupby("flag").mean(), "qty", "price"), f"WITH c AS ({MONTH}) SELECT flag, month, status, round(avg(qty), 4) AS qty, round(avg(price), 4) AS price FROM c GROUP BY ALL")
_add("group_aux", _chain(by_nation, lambda p: p.groupby("region").mean(), "acctbal"), f"WITH c AS ({NATION}) SELECT region, segment, round(avg(acctbal), 4) AS acctbal FROM c GROUP BY ALL")
_add("group_bins", lambda spark, sf_dir: _rounded(embeddings(spark, sf_dir).plan.groupby_bins("vec", [-1, 99, 249, 10**9]).mean(["vec", "k"]).to_frame(), "x"),
     "WITH c AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CASE WHEN vec_id <= 99 THEN '(-1, 99]' WHEN vec_id <= 249 THEN '(99, 249]' ELSE '(249, 1e+09]' END AS vec_bins, round(avg(x), 4) AS x FROM c GROUP BY ALL")
_add("group_map", _chain(sales_day, lambda p: p[["qty"]].groupby("day.month").mean("flag"), "qty"), f"WITH c AS ({DAY}) SELECT day, status, round(avg(qty), 4) AS qty FROM c GROUP BY ALL")
_add("group_first", _chain(sales_day, lambda p: p[["qty"]].groupby("day.year").first(), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, flag, status, round(arg_min(qty, day), 4) AS qty FROM c GROUP BY ALL")
_add("group_last", _chain(sales_day, lambda p: p[["qty"]].groupby("day.year").last(), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, flag, status, round(arg_max(qty, day), 4) AS qty FROM c GROUP BY ALL")
_add("group_quantile", _chain(sales_day, lambda p: p[["qty"]].groupby("day.year").quantile(0.25), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, flag, status, round(quantile_cont(qty, 0.25), 4) AS qty FROM c GROUP BY ALL")
_add("group_pick", _chain(sales_day, lambda p: p[["qty"]].groupby("day.month")[2], "qty"), f"WITH c AS ({DAY}) SELECT day, flag, status, round(qty, 4) AS qty FROM c WHERE month(day) = 2")
_add("resample_2d", _chain(activity, lambda p: p[["total"]].resample(hour="2D").mean(), "total"),
     f"WITH c AS ({HOUR}), o AS (SELECT date_trunc('day', min(hour)) AS s FROM c) SELECT CAST(s + INTERVAL 1 DAY * (2 * (date_diff('day', s, hour) // 2)) AS TIMESTAMP) AS hour, event_type, round(avg(total), 4) AS total FROM c, o GROUP BY ALL")
_add("resample_month", _chain(sales_day, lambda p: p[["qty"]].resample(day="MS").max(), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(date_trunc('month', day) AS TIMESTAMP) AS day, flag, status, round(max(qty), 4) AS qty FROM c GROUP BY ALL")
_add("resample_year_end", _chain(sales_day, lambda p: p[["qty"]].resample(day="YE").mean(["day", "flag", "status"]), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(make_date(CAST(year(day) AS INTEGER), 12, 31) AS TIMESTAMP) AS day, round(avg(qty), 4) AS qty FROM c GROUP BY ALL")
_add("resample_closed_right", _chain(activity, lambda p: p[["total"]].resample(hour="6h", closed="right", label="right").mean(), "total"),
     f"WITH c AS ({HOUR}), o AS (SELECT date_trunc('day', min(hour)) AS s FROM c) SELECT CAST(s + INTERVAL 6 HOUR * CAST(ceil(date_diff('hour', s, hour) / 6.0) AS INTEGER) AS TIMESTAMP) AS hour, event_type, round(avg(total), 4) AS total FROM c, o GROUP BY ALL")
_add("resample_offset", _chain(activity, lambda p: p[["total"]].resample(hour="1D", offset="6h").max(), "total"),
     f"WITH c AS ({HOUR}) SELECT CAST(date_trunc('day', hour - INTERVAL 6 HOUR) + INTERVAL 6 HOUR AS TIMESTAMP) AS hour, event_type, round(max(total), 4) AS total FROM c GROUP BY ALL")
_add("resample_week", _chain(activity, lambda p: p[["total"]].resample(hour="W").max(), "total"),
     f"WITH c AS ({HOUR}) SELECT CAST(date_trunc('week', hour) + INTERVAL 6 DAY AS TIMESTAMP) AS hour, event_type, round(max(total), 4) AS total FROM c GROUP BY ALL")
_add("group_reduce", _chain(sales_day, lambda p: p[["qty"]].groupby("day.year").reduce(np.nanmax), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, flag, status, round(max(qty), 4) AS qty FROM c GROUP BY ALL")
_add("group_function", _chain(sales_day, lambda p: p[["qty"]].groupby("day.year").map(lambda cube: cube.plan.max("day")), "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(year(day) AS BIGINT) AS year, flag, status, round(max(qty), 4) AS qty FROM c GROUP BY ALL")
_add("group_array", _chain(sales_month, lambda p: p[["qty"]].groupby(SmallArray(["old", "new", "old"], "flag")).mean(), "qty"),
     f"WITH c AS ({MONTH}) SELECT month, CASE WHEN flag = 'N' THEN 'new' ELSE 'old' END AS \"group\", status, round(avg(qty), 4) AS qty FROM c GROUP BY ALL")
_add("quantiles", _chain(sales_month, lambda p: p[["qty"]].quantile([0.1, 0.9], "month"), "qty"),
     f"WITH c AS ({MONTH}), q AS (SELECT flag, status, quantile_cont(qty, 0.1) AS a, quantile_cont(qty, 0.9) AS b FROM c GROUP BY ALL) SELECT CAST(0.1 AS DOUBLE) AS quantile, flag, status, round(a, 4) AS qty FROM q UNION ALL SELECT CAST(0.9 AS DOUBLE), flag, status, round(b, 4) FROM q")
_add("interp", _chain(embeddings, lambda p: p.drop_vars("label").interp(k=[0.5, 10.25]), "x"),
     "SELECT vec_id AS vec, CAST(k AS DOUBLE) AS k, round(CASE WHEN k < 1 THEN (CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2 ELSE CAST(embedding[11] AS DOUBLE) * 0.75 + CAST(embedding[12] AS DOUBLE) * 0.25 END, 4) AS x FROM embeddings, (VALUES (0.5), (10.25)) AS w(k)")
_add("stack", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].stack(both=("flag", "status")).to_frame().drop("both"), "qty"),
     f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty FROM c")
_add("weighted_quantile", _chain(sales_month, lambda p: p[["qty"]].sum("status").weighted(SmallArray([1.0, 1.0, 1.0], "flag", {"flag": ["A", "N", "R"]})).quantile(0.5, "flag"), "qty"),
     f"WITH c AS ({MONTH}), s AS (SELECT month, flag, sum(qty) AS qty FROM c GROUP BY ALL), g AS (SELECT month, flag, coalesce(qty, 0) AS qty FROM (SELECT * FROM (SELECT DISTINCT month FROM c), (SELECT DISTINCT flag FROM c)) LEFT JOIN s USING (month, flag)) SELECT month, round(median(qty), 4) AS qty FROM g GROUP BY month")
_add("isel_orthogonal", _chain(sales_month, lambda p: p.isel(month=[0, 4, 7], flag=[0, 2]), "qty", "price"),
     f"WITH c AS ({MONTH}), f AS (SELECT DISTINCT flag, dense_rank() OVER (ORDER BY flag) - 1 AS i FROM c) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM {_ranked('SELECT * FROM c', 'month')} JOIN f USING (flag) WHERE p IN (0, 4, 7) AND i IN (0, 2)")
_add("chunk_uniform", _chain(sales_month, lambda p: p.chunk(12).isel(month=0), "qty", "price"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM c WHERE month = (SELECT min(month) FROM c)")
_add("mean_keepdims", _chain(sales_month, lambda p: p[["qty"]].mean(["flag", "status"], keepdims=True).isel(flag=0, status=0, drop=True), "qty"), f"WITH c AS ({MONTH}) SELECT month, round(avg(qty), 4) AS qty FROM c GROUP BY month")

# Windows; frames are of positions, and a dense grid makes them frames of rows
FULL = f"WITH c AS ({MONTH}), g AS (SELECT month, flag, status, qty FROM (SELECT * FROM (SELECT DISTINCT month FROM c), (SELECT DISTINCT flag FROM c), (SELECT DISTINCT status FROM c)) LEFT JOIN c USING (month, flag, status))"
_OVER = "OVER (PARTITION BY flag, status ORDER BY month ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
for _name, _kw, _op, _fn, _a, _b, _least in (
    ("rolling_mean", {}, "mean", "avg(qty)", 2, 0, 3), ("rolling_center", {"center": True}, "sum", "sum(qty)", 1, 1, 3), ("rolling_minp", {"min_periods": 1}, "max", "max(qty)", 2, 0, 1),
    ("rolling_median", {}, "median", "median(qty)", 2, 0, 3), ("rolling_std", {"min_periods": 2}, "std", "stddev_pop(qty)", 2, 0, 2), ("rolling_count", {"min_periods": 1}, "count", "count(qty)", 2, 0, 1),
):
    _frame = _OVER.format(a=_a, b=_b)
    _add(_name, (lambda kw, op, dense: lambda spark, sf_dir: _rounded(getattr(sales_month(spark, sf_dir).plan[["qty"]].rolling(month=3, **kw), op)().to_frame(), "qty").where("qty is not null"))(_kw, _op, None),
         f"{FULL}, r AS (SELECT month, flag, status, CASE WHEN count(qty) {_frame} >= {_least} THEN round({_fn} {_frame}, 4) END AS qty FROM g) SELECT * FROM r WHERE qty IS NOT NULL")
_add("rolling_two_dims", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].rolling(month=3, flag=2, min_periods=1).sum().to_frame(), "qty").where("qty is not null"),
     f"{FULL}, r AS (SELECT *, dense_rank() OVER (ORDER BY month) AS i, dense_rank() OVER (ORDER BY flag) AS j FROM g) SELECT a.month, a.flag, a.status, round(sum(b.qty), 4) AS qty FROM r a JOIN r b ON a.status = b.status AND b.i BETWEEN a.i - 2 AND a.i AND b.j BETWEEN a.j - 1 AND a.j GROUP BY ALL HAVING count(b.qty) >= 1")
for _name, _boundary, _keep in (("coarsen_trim", "trim", "WHERE p < 80"), ("coarsen_pad", "pad", "")):
    _add(_name, (lambda boundary: lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].coarsen(month=4, boundary=boundary, coord_func="min").mean().to_frame(), "qty"))(_boundary),
         f"WITH c AS ({MONTH}), r AS {_ranked('SELECT * FROM c', 'month')}, m AS (SELECT p // 4 AS q, min(month) AS month FROM r GROUP BY 1) SELECT m.month, flag, status, round(avg(qty), 4) AS qty FROM r JOIN m ON p // 4 = q {_keep} GROUP BY ALL")
_add("cumulative_max", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].cumulative("month").max().to_frame(), "qty").where("qty is not null"),
     f"{FULL}, r AS (SELECT month, flag, status, round(max(qty) OVER (PARTITION BY flag, status ORDER BY month ROWS UNBOUNDED PRECEDING), 4) AS qty FROM g) SELECT * FROM r WHERE qty IS NOT NULL")
_add("cumulative_long", lambda spark, sf_dir: _rounded(sales_day(spark, sf_dir).plan[["qty"]].sum(["flag", "status"]).cumulative("day").sum().to_frame(), "qty", digits=2),
     f"WITH c AS ({DAY}), t AS (SELECT day, sum(qty) AS qty FROM c GROUP BY day) SELECT day, round(sum(qty) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS qty FROM t")
_add("rolling_long", lambda spark, sf_dir: _rounded(sales_day(spark, sf_dir).plan[["qty"]].sum(["flag", "status"]).rolling(day=1000, min_periods=1).mean().to_frame(), "qty"),
     f"WITH c AS ({DAY}), t AS (SELECT day, sum(qty) AS qty FROM c GROUP BY day) SELECT day, round(avg(qty) OVER (ORDER BY day ROWS 999 PRECEDING), 4) AS qty FROM t")
_add("rolling_exp", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].sum(["flag", "status"]).rolling_exp(month=3).mean().to_frame(), "qty", digits=2),
     f"WITH c AS ({MONTH}), t AS (SELECT month, sum(qty) AS qty FROM c GROUP BY month), r AS (SELECT *, row_number() OVER (ORDER BY month) AS i FROM t) SELECT a.month, round(sum(pow(0.5, a.i - b.i) * b.qty) / sum(pow(0.5, a.i - b.i)), 2) AS qty FROM r a JOIN r b ON b.i <= a.i GROUP BY a.month")
_add("rolling_construct", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].rolling(month=2).construct("lag").mean("lag").to_frame(), "qty"),
     f"{FULL}, r AS (SELECT month, flag, status, avg(qty) {_OVER.format(a=1, b=0)} AS qty FROM g) SELECT month, flag, status, round(qty, 4) AS qty FROM r WHERE qty IS NOT NULL")

# Weights
_W = "(VALUES ('A', 1.0), ('N', 2.0), ('R', 4.0)) AS w(flag, weight)"
WEIGHTS = SmallArray([1.0, 2.0, 4.0], "flag", {"flag": ["A", "N", "R"]})
for _op, _fn in {
    "mean": "sum(qty * weight) / sum(weight)", "sum": "sum(qty * weight)", "std": "sqrt(sum(weight * (qty - m) * (qty - m)) / sum(weight))", "var": "sum(weight * (qty - m) * (qty - m)) / sum(weight)",
    "sum_of_weights": "sum(weight)", "sum_of_squares": "sum(weight * (qty - m) * (qty - m))",
}.items():
    _digits = 2 if _op in ("var", "sum_of_squares") else 4
    _add(f"weighted_{_op}", (lambda op, digits: lambda spark, sf_dir: _rounded(getattr(sales_month(spark, sf_dir).plan[["qty"]].weighted(WEIGHTS), op)("flag").to_frame(), "qty", digits=digits))(_op, _digits),
         f"WITH c AS ({MONTH}), x AS (SELECT c.month, c.status, c.qty, CAST(w.weight AS DOUBLE) AS weight FROM c JOIN {_W} ON c.flag = w.flag), m AS (SELECT month, status, sum(qty * weight) / sum(weight) AS m FROM x GROUP BY month, status) SELECT month, status, round({_fn}, {_digits}) AS qty FROM x JOIN m USING (month, status) GROUP BY month, status")
_add("weighted_bare", _chain(sales_month, lambda p: p[["qty"]].weighted(WEIGHTS).mean(), "qty"),
     f"WITH c AS ({MONTH}) SELECT round(sum(qty * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)), 4) AS qty FROM c JOIN {_W} ON c.flag = w.flag")
_add("weighted_broadcast", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].weighted(SmallArray([1.0, 3.0], "member", {"member": [10, 20]})).mean("flag").to_frame(), "qty"),
     f"WITH c AS ({MONTH}) SELECT month, status, CAST(member AS BIGINT) AS member, round(sum(qty * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)), 4) AS qty FROM c, (VALUES (10, 1.0), (20, 3.0)) AS w(member, weight) GROUP BY ALL")
_add("weighted_partial", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan[["qty"]].weighted(SmallArray([1.0, 3.0], "flag", {"flag": ["A", "R"]})).mean("flag").to_frame(), "qty"),
     f"WITH c AS ({MONTH}) SELECT month, status, round(sum(qty * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)), 4) AS qty FROM c JOIN (VALUES ('A', 1.0), ('R', 3.0)) AS w(flag, weight) ON c.flag = w.flag GROUP BY ALL")

# Chunks, rewrites and calls that no rule knows
_add("chunk_noop", _chain(sales_month, lambda p: p.chunk({"month": 12}).isel(month=0), "qty", "price"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty, round(price, 4) AS price FROM c WHERE month = (SELECT min(month) FROM c)")
_add("push_past_group", _chain(sales_day, lambda p: p.groupby("day.month").mean().isel(flag=0)[["qty"]], "qty"),
     f"WITH c AS ({DAY}) SELECT CAST(month(day) AS BIGINT) AS month, flag, status, round(avg(qty), 4) AS qty FROM c WHERE flag = (SELECT min(flag) FROM c) GROUP BY ALL")
_add("push_past_window", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan.rolling(month=3).mean().isel(flag=1)[["qty"]].to_frame(), "qty").where("qty is not null"),
     f"{FULL}, r AS (SELECT month, flag, status, CASE WHEN count(qty) {_OVER.format(a=2, b=0)} >= 3 THEN round(avg(qty) {_OVER.format(a=2, b=0)}, 4) END AS qty FROM g) SELECT * FROM r WHERE qty IS NOT NULL AND flag = 'N'")
_add("project_past_std", _chain(sales_month, lambda p: p.assign(name=F.lit("buoy")).std("flag")[["qty"]], "qty"), f"WITH c AS ({MONTH}) SELECT month, status, round(stddev_pop(qty), 4) AS qty FROM c GROUP BY ALL")
_add("where_opaque", _chain(sales_month, lambda p: p[["qty"]].where("qty > 500").mean("month"), "qty"), f"WITH c AS ({MONTH}) SELECT flag, status, round(avg(CASE WHEN qty > 500 THEN qty END), 4) AS qty FROM c GROUP BY ALL")
_add("pipe_opaque", _chain(sales_month, lambda p: p.pipe(lambda cube: cube.plan.assign(unit="price / qty")[["unit"]].collect()).max("flag"), "unit"), f"WITH c AS ({MONTH}) SELECT month, status, round(max(price / qty), 4) AS unit FROM c GROUP BY ALL")
_add("transpose_opaque", _chain(sales_month, lambda p: p.transpose("status", "flag", "month")[["qty"]], "qty"), f"WITH c AS ({MONTH}) SELECT month, flag, status, round(qty, 4) AS qty FROM c")
_add("quantile", _chain(sales_month, lambda p: p[["qty"]].quantile(0.9, "month"), "qty"), f"WITH c AS ({MONTH}) SELECT flag, status, round(quantile_cont(qty, 0.9), 4) AS qty FROM c GROUP BY ALL")
_add("to_array", lambda spark, sf_dir: _rounded(sales_month(spark, sf_dir).plan.sum("month").to_array(), "value"),
     f"WITH c AS ({MONTH}), s AS (SELECT flag, status, sum(qty) AS qty, sum(price) AS price FROM c GROUP BY ALL) SELECT 'qty' AS variable, flag, status, round(qty, 4) AS value FROM s UNION ALL SELECT 'price', flag, status, round(price, 4) FROM s")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sales_month(spark, sf_dir).plan.mean("status").mean("flag").isel(month=14)[["qty"]].explain()
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "line int, text string")


_add("explain", _explained)
