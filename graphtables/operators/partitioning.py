"""Ranks and shards of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import slot


def hash_partition(nodes: DataFrame, ranks: int, column: str = "node_id") -> DataFrame:
    """Nodes with the rank that owns them, by hash."""
    return nodes.withColumn("rank", slot("rank", column, slots=ranks))


def range_partition(nodes: DataFrame, ranks: int, column: str = "node_id") -> DataFrame:
    """Dense ids with the rank of their range; ranges differ by one at most, the longer ones first."""
    total = nodes.agg(F.max(column).alias("_m"))
    n = F.col("_m") + 1
    base, more = F.floor(n / ranks), n % ranks
    border = more * (base + 1)
    rank = F.when(F.col(column) < border, F.floor(F.col(column) / (base + 1))).otherwise(more + F.floor((F.col(column) - border) / F.greatest(base, F.lit(1))))
    return nodes.join(F.broadcast(total)).withColumn("rank", rank.cast("long")).drop("_m")


def range_book(total: int, ranks: int) -> list[tuple[int, int]]:
    """(first, end) of each rank's range."""
    base, more = divmod(total, ranks)
    edges = [0]
    for r in range(ranks):
        edges.append(edges[-1] + base + (r < more))
    return list(zip(edges[:-1], edges[1:], strict=True))


def edges_by_owner(edges: DataFrame, owners: DataFrame, end: str = "dst") -> DataFrame:
    """Edges with the rank of the node that owns them."""
    return edges.join(owners.select(F.col("node_id").alias(end), "rank"), end)


def ids_on_rank(owners: DataFrame, rank: int) -> DataFrame:
    """(node_id) that a rank owns, of (node_id, rank)."""
    return owners.where(F.col("rank") == rank).select("node_id")


def ids_per_rank(owners: DataFrame) -> DataFrame:
    """(rank, n): how many ids each rank owns."""
    return owners.groupBy("rank").agg(F.count("*").alias("n"))


def ids_of_split(split: DataFrame, name: str, nodes: DataFrame | None = None, node_type: int | None = None) -> DataFrame:
    """(node_id) of a split (node_id, split), of one type of ``nodes`` if asked."""
    ids = split.where(F.col("split") == name).select("node_id")
    return ids if nodes is None else ids.join(nodes.where(F.col("node_type") == node_type).select("node_id"), "node_id", "left_semi")


def anchors_of_split(split: DataFrame, name: str, positive: DataFrame, negative: DataFrame | None = None) -> DataFrame:
    """(node_id, positive, negative): the anchors of a split with the sorted ends of their label edges (src, dst); none as empty arrays."""
    out = ids_of_split(split, name)
    for column, labels in (("positive", positive), ("negative", negative)):
        if labels is None:
            out = out.withColumn(column, F.array().cast("array<bigint>"))
            continue
        ends = labels.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("_ends"))
        out = out.join(ends, "node_id", "left").withColumn(column, F.coalesce("_ends", F.array().cast("array<bigint>"))).drop("_ends")
    return out


def contiguous_shard(total: int, shard: int, shards: int) -> tuple[int, int]:
    """(first, end) of a shard of numbered rows; the last takes the remainder."""
    size = total // shards
    return shard * size, total if shard == shards - 1 else (shard + 1) * size


def storage_slices(servers: int, ranks: int, rank: int) -> dict[int, tuple[float, float]]:
    """Of each server the fraction [first, end) that a compute rank reads: the overlap of its segment of all servers."""
    a, b = rank * servers / ranks, (rank + 1) * servers / ranks
    return {s: (max(a, s) - s, min(b, s + 1) - s) for s in range(servers) if max(a, s) < min(b, s + 1)}


def shard_files(files: list[str], rank: int, ranks: int) -> list[str]:
    """Sorted files cut contiguously over ranks; the first ranks take one more."""
    first, end = range_book(len(files), ranks)[rank]
    return sorted(files)[first:end]
