"""Dense integer ids for arbitrary identifiers, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def number_rows(df: DataFrame, *order: str, out: str = "number") -> DataFrame:
    """``df`` with its rows numbered densely from 0 in the order of some columns.

    No global window: rows are range-partitioned and sorted, numbered within each partition, and shifted by the counts of the
    partitions before it; only those counts, one per partition, pass through one task."""
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    placed = ranged.select(*df.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = materialize(placed, "numbered")  # counts and numbers must see the same ranges
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_offset") + F.col("_place")).alias(out))


def enumerate_ids(df: DataFrame, column: str, out: str = "int_id") -> DataFrame:
    """(column, out): the distinct identifiers in order, numbered densely from 0."""
    return number_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), column, out=out)


def enumerate_nodes(nodes: DataFrame, column: str, ids: DataFrame, out: str = "int_id") -> DataFrame:
    """``nodes`` with the integer id in place of the identifier."""
    return nodes.join(ids, column).drop(column).select(out, *[c for c in nodes.columns if c != column])


def enumerate_edges(edges: DataFrame, src: str, dst: str, src_ids: DataFrame, dst_ids: DataFrame, key: str, out: str = "int_id") -> DataFrame:
    """``edges`` with integer endpoints; an endpoint without an id becomes null."""
    a = src_ids.select(F.col(key).alias("_src_key"), F.col(out).alias("_src"))
    b = dst_ids.select(F.col(key).alias("_dst_key"), F.col(out).alias("_dst"))
    met = edges.join(a, F.col(src) == F.col("_src_key"), "left").join(b, F.col(dst) == F.col("_dst_key"), "left")
    return met.select(F.col("_src").alias(src), F.col("_dst").alias(dst), *[F.col(c) for c in edges.columns if c not in (src, dst)])


def unenumerate(assets: DataFrame, ids: DataFrame, key: str, int_id: str = "int_id", node_id: str = "node_id") -> DataFrame:
    """Assets by integer id, under their original identifier; one row for each identifier, the one of the least other columns."""
    met = assets.join(ids, assets[node_id] == ids[int_id]).drop(node_id, int_id)
    rest = [c for c in assets.columns if c != node_id]
    first = met.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*rest))).where("_rank = 1")
    return first.select(F.col(key).alias(node_id), *rest)


def check_counts(before: DataFrame, after: DataFrame, what: str) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{what}: {a} rows became {b}")
