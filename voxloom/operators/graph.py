"""Graphs as edge tables (src, dst, w): degrees, strengths, assortativity, paths, centrality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

#: The edges of the Coxeter graph (28 nodes, three edges a node), built by its symmetry.
#: Outer hubs 0..6 join a node of each of three seven-cycles with steps 1, 2 and 3.


def coxeter(spark: SparkSession) -> DataFrame:
    pairs = []
    for k in range(7):
        for ring, step in enumerate((1, 2, 3)):
            at = 7 + 7 * ring
            pairs += [(k, at + k), (at + k, at + (k + step) % 7)]
    return spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, w double")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, is_, os, degree, in_strength, out_strength, strength); row counts over src and dst.

    Both ends of an edge are summed in one pass: no join.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))
    rows = edges.filter("w <> 0").select("w", F.explode(ends).alias("e")).select("w", "e.id", "e.o")
    return rows.groupBy("id").agg(
        F.sum("o").cast("long").alias("out_degree"), F.sum(1 - F.col("o")).cast("long").alias("in_degree"), F.count("*").alias("degree"),
        F.sum(F.when(F.col("o") == 1, F.col("w")).otherwise(0.0)).alias("out_strength"), F.sum(F.when(F.col("o") == 0, F.col("w")).otherwise(0.0)).alias("in_strength"), F.sum("w").alias("strength"),
    )


def total(edges: DataFrame) -> DataFrame:
    return edges.agg(F.sum(F.when(F.col("w") != 0, 1).otherwise(0)).cast("long").alias("degree"), F.sum("w").alias("strength"))


def normalize(edges: DataFrame) -> DataFrame:
    edges = settled(edges)  # read twice: the total and the rows
    return edges.join(F.broadcast(edges.agg(F.sum("w").alias("_t")))).withColumn("w", F.try_divide("w", "_t")).drop("_t")


def assortativity(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Absolute correlation over the edges, each counted once, of what leaves the source and what enters the target; 1 where it is 0/0.

    Both are degrees (or strengths); the spread is that of what leaves and enters the source.
    """
    edges = settled(edges)  # read three times
    names = ("out_strength", "in_strength") if weighted else ("out_degree", "in_degree")
    k = settled(degrees(edges).select("id", *[F.col(c).cast("double").alias(n) for c, n in zip(names, ("o", "i"), strict=True)]))
    e = edges.filter("w <> 0").join(k.select(F.col("id").alias("src"), "o", "i"), "src").join(k.select(F.col("id").alias("dst"), F.col("i").alias("into")), "dst")
    m = e.agg(F.avg(F.col("o") * F.col("into")).alias("both"), F.avg((F.col("o") + F.col("into")) / 2).alias("mean"), F.avg((F.col("o") * F.col("o") + F.col("i") * F.col("i")) / 2).alias("own"))
    square = F.col("mean") * F.col("mean")
    spread, joint = F.col("own") - square, F.col("both") - square
    return m.select(F.when(F.abs(joint - spread) <= 1e-12 * F.col("own"), F.lit(1.0)).otherwise(F.abs(joint / F.when(spread == 0, F.lit(None)).otherwise(spread))).alias("assortativity"))


def shortest_paths(edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """(src, dst, dist, via): least sums of |w| by min-plus squaring to the fixpoint.

    via is the next node from src. Each round doubles the hops; rows are the pairs reached.
    """
    step = edges.filter("w <> 0 and src <> dst").groupBy("src", "dst").agg(F.min(F.abs("w")).alias("dist")).withColumn("via", F.col("dst"))
    current, hops = settled(step), 1
    while most_hops is None or hops < most_hops:
        far = current.alias("a").join(current.alias("b"), F.col("a.dst") == F.col("b.src")).filter("a.src <> b.dst").select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.dist") + F.col("b.dist")).alias("dist"), F.col("a.via").alias("via"))
        best = settled(current.unionByName(far).groupBy("src", "dst").agg(F.min(F.struct("dist", "via")).alias("m")).select("src", "dst", "m.dist", "m.via"))
        changed = best.select("src", "dst", "dist").join(current.select("src", "dst", F.col("dist").alias("_d")), ["src", "dst"], "left").filter("_d is null or dist < _d - 1e-12 * abs(_d)")
        done = changed.isEmpty()
        current, hops = best, hops * 2
        if done:
            break
    return current


def betweenness(paths: DataFrame) -> DataFrame:
    """(id, visits): how often a node lies inside a shortest path; walks all paths hop by hop together."""
    walk, found = paths.filter("via <> dst").select(F.col("src").alias("at"), "dst", F.col("via").alias("next")), None
    walk = settled(walk)
    while not walk.isEmpty():
        seen = settled(walk.groupBy(F.col("next").alias("id")).agg(F.count("*").alias("visits")))
        found = seen if found is None else settled(found.unionByName(seen).groupBy("id").agg(F.sum("visits").alias("visits")))
        walk = settled(walk.select(F.col("next").alias("at"), "dst").join(paths.select(F.col("src").alias("at"), "dst", F.col("via").alias("next")), ["at", "dst"]).filter("next <> dst"))
    nodes = paths.select(F.col("src").alias("id")).union(paths.select("dst")).distinct()
    if found is None:
        return nodes.withColumn("visits", F.lit(0).cast("long"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("visits", F.lit(0)).cast("long").alias("visits"))


def to_dense(edges: DataFrame, n: int, most: int = 4096) -> np.ndarray:
    """A small graph as a matrix on the driver; an error beyond ``most`` nodes."""
    if n > most:
        raise ValueError(f"{n} nodes are too many for a dense matrix on the driver")
    out = np.zeros((n, n))
    for r in edges.collect():
        out[r.src, r.dst] = r.w
    return out


def filter_matrix(edges: DataFrame, keep: DataFrame, rows: bool = True, columns: bool = True) -> DataFrame:
    """Entries whose row and column numbers are kept (id); semi joins."""
    k = keep.select("id")
    if rows:
        edges = edges.join(k.withColumnRenamed("id", "src"), "src", "left_semi")
    if columns:
        edges = edges.join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges
