"""Positional encodings: random walks and hop distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .sampling import union_of


def random_walk(edges: DataFrame, steps: int) -> DataFrame:
    """(node_id, step, pe, se): of the step-th power of the row-normalized adjacency the column sum without the diagonal, and the diagonal.

    Repeated edges add weight. Column sums pass from step to step as one number a node. A power's diagonal is met in the middle: that of
    k steps comes from the pairs of half as many, so pairs are made only for half the steps."""
    weight = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))
    total = weight.groupBy("src").agg(F.sum("w").alias("total"))
    p = materialize(weight.join(total, "src").select("src", "dst", (F.col("w") / F.greatest("total", F.lit(1))).alias("p")), "transition")
    powers = [p]
    for _ in range(2, (steps + 1) // 2 + 1):
        right = p.withColumnsRenamed({"src": "mid", "p": "q"})
        powers.append(materialize(powers[-1].withColumnRenamed("dst", "mid").join(right, "mid").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("p")), "power"))
    sums = p.groupBy(F.col("dst").alias("node_id")).agg(F.sum("p").alias("total"))
    parts = []
    for k in range(1, steps + 1):
        if k > 1:
            sums = sums.join(p, F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("total") * F.col("p")).alias("total"))
        sums = materialize(sums, "column_sums")
        if k == 1:
            home = p.where("src = dst").select(F.col("src").alias("_node"), F.col("p").alias("se"))
        else:
            back = powers[k // 2 - 1].select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
            home = powers[(k + 1) // 2 - 1].join(back, ["src", "dst"]).groupBy(F.col("src").alias("_node")).agg(F.sum(F.col("p") * F.col("q")).alias("se"))
        met = sums.join(home, F.col("node_id") == F.col("_node"), "left").withColumn("se", F.coalesce("se", F.lit(0.0)))
        parts.append(met.select("node_id", F.lit(k).alias("step"), F.greatest(F.col("total") - F.col("se"), F.lit(0.0)).alias("pe"), "se"))
    return union_of(parts)


def hop_distances(edges: DataFrame, most: int, direction: str = "out") -> DataFrame:
    """(src, dst, hops): the first hop at which dst is reached from src, up to ``most``; no diagonal, the unreachable is left out."""
    e = edges.select("src", "dst") if direction == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    e = e.where("src <> dst").distinct()
    found = e.withColumn("hops", F.lit(1))
    frontier = e
    for k in range(2, most + 1):
        step = frontier.withColumnRenamed("dst", "mid").join(e.withColumnsRenamed({"src": "mid"}), "mid").select("src", "dst").where("src <> dst").distinct()
        frontier = materialize(step.join(found.select("src", "dst"), ["src", "dst"], "left_anti"), "frontier")
        found = materialize(found.unionByName(frontier.withColumn("hops", F.lit(k))), "distances")
        if frontier.limit(1).count() == 0:
            break
    return found
