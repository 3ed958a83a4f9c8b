"""Loops over DataFrames until nothing changes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, which the cluster names in spark.checkpoint.dir.

    A temporary folder stands in on a local master alone; elsewhere executors could not read it back.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint()


def fingerprint(df: DataFrame) -> tuple:
    """Row count and order-free digest; equal for equal contents."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Applies ``step`` until the contents stay the same; lineage is cut in each round.

    An unfinished result is never returned: if ``rounds`` don't suffice, it raises.
    """
    current = checkpointed(start)
    seen = fingerprint(current)
    for _ in range(rounds):
        current = checkpointed(step(current))
        now = fingerprint(current)
        if now == seen:
            return current
        seen = now
    raise RuntimeError(f"not settled after {rounds} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (a, b): the smallest id reachable.

    Star contraction: each round joins every id's neighbours to the least id near them, once for
    those above and once for those below, so the number of rounds grows with the logarithm of the
    longest path.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def contract(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        above = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = above.groupBy("a").agg(F.min("b").alias("m"))
        moved = above.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("p"), "m"), F.struct(F.col("b").alias("p"), "m"))).alias("e"))
        return moved.select(F.col("e.p").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()

    stars = fixpoint(start, contract)
    roots = stars.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
