"""Cubes over the sample tables. Each reads only the columns that it needs, and aggregates them once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Axis, Cube, Group, key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that the session's checkpoints go to and read back.

    What a cube is made from is read for each of its axes and for its cells; so an aggregate over a large table is made once. The files stay as long as the folder does.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                return df  # no folder that all executors share
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="labelcube-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    path = f"{root.rstrip('/')}/labelcube-cells-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sales(spark: SparkSession, sf_dir: str, unit: str) -> Cube:
    rows = table(spark, sf_dir, "lineitem").select(
        F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz").alias(unit), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
    )
    cells = rows.groupBy(unit, "flag", "status").agg(F.sum("qty").alias("qty"), F.sum("price").alias("price"))
    return Cube.from_frame(written(cells), [unit, "flag", "status"], ["qty", "price"])


def sales_month(spark: SparkSession, sf_dir: str) -> Cube:
    """qty and price by month of shipping, return flag and line status."""
    return _sales(spark, sf_dir, "month")


def sales_day(spark: SparkSession, sf_dir: str) -> Cube:
    """qty and price by day of shipping, return flag and line status; the axis has the days that occur."""
    return _sales(spark, sf_dir, "day")


def activity(spark: SparkSession, sf_dir: str) -> Cube:
    """total (of value) and n (of events) by hour and event type."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", "value")
    cells = rows.groupBy("hour", "event_type").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return Cube.from_frame(written(cells), ["hour", "event_type"], ["total", "n"])


def embeddings(spark: SparkSession, sf_dir: str) -> Cube:
    """x by vector and component, with each vector's label along vec. Vectors' ids are their positions."""
    rows = table(spark, sf_dir, "embeddings")
    cells = rows.select(F.col("vec_id").alias(key("vec")), F.posexplode("embedding").alias(key("k"), "x"))
    cells = cells.select(F.col(f"`{key('vec')}`"), F.col(f"`{key('k')}`").cast("long").alias(key("k")), F.col("x").cast("double").alias("x"))
    vec = rows.select(F.col("vec_id").alias(key("vec")), F.col("vec_id").alias("vec"), "label")
    return Cube(spark, {"vec": Axis("vec", vec, ("vec", "label")), "k": Axis("k", None, (), 64)}, (Group(cells, ("vec", "k"), ("x",), True),))


def by_nation(spark: SparkSession, sf_dir: str) -> Cube:
    """acctbal (mean over customers) by nation and market segment, with each nation's region along it."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    cells = rows.groupBy("c_nationkey", "segment").agg(F.avg("c_acctbal").alias("acctbal"))
    cells = cells.join(names, cells["c_nationkey"] == names["n_nationkey"]).select("nation", "segment", "acctbal", "region")
    return Cube.from_frame(written(cells), ["nation", "segment"], ["acctbal"], {"nation": ["region"]})
