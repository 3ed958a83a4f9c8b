"""The driver's tables as images, object tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..raster import Raster, from_points

SIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_image(spark: SparkSession, sf_dir: str) -> Raster:
    """64 x 64: total quantity by supplier and part, modulo the side."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % SIDE).cast("int").alias("x"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), F.col("l_quantity").alias("q"))
    sums = rows.groupBy("x", "y").agg(F.sum("q").alias("v"))
    ids = spark.range(1).select(F.col("id").alias("image_id"))
    return from_points(sums.select(F.lit(0).cast("long").alias("image_id"), "x", "y", "v"), (SIDE, SIDE), ids=ids)


def lineitem_stack(spark: SparkSession, sf_dir: str) -> Raster:
    """One such image for each line number."""
    rows = table(spark, sf_dir, "lineitem")
    sums = rows.groupBy(F.col("l_linenumber").cast("long").alias("image_id"), (F.col("l_suppkey") % SIDE).cast("int").alias("x"), (F.col("l_partkey") % SIDE).cast("int").alias("y")).agg(F.sum("l_quantity").alias("v"))
    return from_points(sums, (SIDE, SIDE))


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[Raster, Raster]:
    """Two 64 x 64 images of orders by customer and order: their number, and the sum of whole prices."""
    rows = table(spark, sf_dir, "orders")
    sums = rows.groupBy((F.col("o_custkey") % SIDE).cast("int").alias("x"), (F.col("o_orderkey") % SIDE).cast("int").alias("y")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.floor("o_totalprice")).cast("double").alias("p")
    )
    ids = spark.range(1).select(F.col("id").alias("image_id"))
    one = lambda c: from_points(sums.select(F.lit(0).cast("long").alias("image_id"), "x", "y", F.col(c).alias("v")), (SIDE, SIDE), ids=ids)
    return one("n"), one("p")


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, label, v): one tensor pixel a vector."""
    return table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("x"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, w): items that customers of one nation order from suppliers of another."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = items.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").where("cn <> sn")
    return pairs.groupBy(F.least("cn", "sn").cast("long").alias("a"), F.greatest("cn", "sn").cast("long").alias("b")).agg(F.count("*").cast("double").alias("w"))


def wide_image(spark: SparkSession, sf_dir: str, side: int = 640) -> Raster:
    """side x side: total quantity by order and part, larger than a tile of the filters."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % side).cast("int").alias("x"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % side).cast("int").alias("y"), F.col("l_quantity").alias("q"))
    sums = rows.groupBy("x", "y").agg(F.sum("q").alias("v"))
    ids = spark.range(1).select(F.col("id").alias("image_id"))
    return from_points(sums.select(F.lit(0).cast("long").alias("image_id"), "x", "y", "v"), (side, side), ids=ids)
