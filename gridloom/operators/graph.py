"""Graphs as tables of vertices (id, value) and edges (a, b, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import checkpointed, components, fixpoint


def add_edge(edges: DataFrame, a: int, b: int, w: float = 1.0, sum_weight: bool = False) -> DataFrame:
    """With an edge more; one that exists keeps its weight, or gets the sum."""
    spark = edges.sparkSession
    one = spark.createDataFrame([(min(a, b), max(a, b), float(w), 1)], "a long, b long, w double, new int")
    both = edges.select("a", "b", "w", F.lit(0).alias("new")).unionByName(one)
    fold = F.sum("w") if sum_weight else F.min_by("w", "new")
    return both.groupBy("a", "b").agg(fold.alias("w"))


def add_edge_sum_weight(edges: DataFrame, a: int, b: int, w: float = 1.0) -> DataFrame:
    return add_edge(edges, a, b, w, True)


def delete_edge(edges: DataFrame, a: int, b: int) -> DataFrame:
    return edges.where(~((F.least("a", "b") == min(a, b)) & (F.greatest("a", "b") == max(a, b))))


def update_edge_weights(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Weights anew, as differences of vertex values."""
    va, vb = vertices.select(F.col("id").alias("a"), F.col("value").alias("va")), vertices.select(F.col("id").alias("b"), F.col("value").alias("vb"))
    return edges.select("a", "b").join(va, "a").join(vb, "b").select("a", "b", F.abs(F.col("va") - F.col("vb")).alias("w"))


def label(edges: DataFrame) -> DataFrame:
    """(id, root): components by their smallest vertex."""
    return components(edges)


def minimum_spanning_forest(edges: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """(a, b, w) of a minimum spanning forest by rounds of every component's lightest edge.

    With roots, the components that hold them; ties go by vertex numbers.  Each round at least
    halves the number of components, and nothing but edges is shuffled.
    """
    rest = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")))
    chosen = None
    while True:
        ends = rest.select("a", "b", "w", F.explode(F.array("p", "q")).alias("c"))
        light = ends.groupBy("c").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct()
        light = checkpointed(light.select("a", "b", "w"))
        if light.isEmpty():
            break
        chosen = light if chosen is None else chosen.union(light)
        root = components(chosen.select("a", "b"))
        pa, qa = root.select(F.col("id").alias("a"), F.col("root").alias("p")), root.select(F.col("id").alias("b"), F.col("root").alias("q"))
        rest = checkpointed(rest.select("a", "b", "w").join(pa, "a").join(qa, "b").where("p <> q").select("a", "b", "w", "p", "q"))
    found = chosen.distinct() if chosen is not None else edges.limit(0).select("a", "b", "w")
    if roots is None:
        return found
    root = components(edges.select("a", "b"))
    wanted = root.join(root.where(F.col("id").isin(list(roots))).select("root").distinct(), "root").select(F.col("id").alias("a"))
    return found.join(wanted, "a", "left_semi")


def remove_largest_edges(edges: DataFrame, n: int) -> DataFrame:
    """Without the n heaviest edges; ties go by vertex numbers."""
    heavy = edges.orderBy(F.desc("w"), "a", "b").limit(n).select("a", "b")
    return edges.join(heavy, ["a", "b"], "left_anti")


def is_connected_to(edges: DataFrame, root: int) -> DataFrame:
    """(id) of the vertices that directed edges reach from a root."""
    start = edges.sparkSession.createDataFrame([(root,)], "id long")

    def step(seen: DataFrame) -> DataFrame:
        new = edges.join(seen, edges["a"] == seen["id"], "left_semi").select(F.col("b").alias("id"))
        return seen.union(new).distinct()

    return fixpoint(start, step)


def directed(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def union_find(pairs: DataFrame, values: DataFrame, merge=F.sum) -> DataFrame:
    """(root, value): sets joined by pairs (a, b), with the values (id, value) of their members merged."""
    root = components(pairs.select("a", "b"))
    return values.join(root, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(merge("value").alias("value"))


def label_map(edges: DataFrame) -> DataFrame:
    """(label, target): consecutive numbers of components, for relabelling regions."""
    root = components(edges)
    order = Window.orderBy("root")
    numbered = root.select("root").distinct().select("root", F.row_number().over(order).cast("long").alias("target"))
    return root.join(numbered, "root").select(F.col("id").alias("label"), "target")
