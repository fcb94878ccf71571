"""Edges: loading, direction, sets, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import feature_array
from ..plans.scratch import dealt, materialize, shuffle_tasks


def load_nodes(df: DataFrame, key: str, features: list[str], node_type: int = 0) -> DataFrame:
    """(node_id, features array<float>, node_type)."""
    return df.select(F.col(key).cast("long").alias("node_id"), feature_array(*features).alias("features"), F.lit(node_type).alias("node_type"))


def load_node_ids(nodes: DataFrame, node_type: int | None = None, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """(node_id) of one type, or of all; at most ``limit`` of them, the least, and dealt into so many partitions, if asked."""
    ids = (nodes if node_type is None else nodes.where(F.col("node_type") == node_type)).select("node_id").distinct()
    if limit is not None:
        ids = ids.orderBy("node_id").limit(limit)
    return ids if partitions is None else ids.repartition(partitions, "node_id")


def load_edges(df: DataFrame, src: str, dst: str, features: list[str] | None = None, edge_type: int = 0) -> DataFrame:
    """(src, dst, edge_type, features array<float>)."""
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.lit(edge_type).alias("edge_type"), feature_array(*(features or [])).alias("features"))


def load_typed_edges(parts: dict[tuple[tuple[str, str, str], str], DataFrame], usage: str = "main", codes: dict[tuple[str, str, str], int] | None = None) -> DataFrame:
    """(src, dst, src_type, relation, dst_type, edge_type, features): edge tables (src, dst, features...) of one usage as one table.

    ``parts``: tables by (edge type, usage); usages are main, positive and negative. ``codes`` numbers the edge types, else their order does."""
    kinds = list(dict.fromkeys(t for t, _ in parts))
    codes = codes or {t: i for i, t in enumerate(kinds)}
    if unknown := {u for _, u in parts} - {"main", "positive", "negative"}:
        raise ValueError(f"unknown usages {sorted(unknown)}")
    own = []
    for (kind, of), df in parts.items():
        if of == usage:
            more = [c for c in df.columns if c not in ("src", "dst")]
            rows = load_edges(df, "src", "dst", more, codes[kind])
            own.append(rows.withColumns(dict(zip(("src_type", "relation", "dst_type"), map(F.lit, kind), strict=True))))
    if not own:
        raise ValueError(f"no edges for {usage}")
    return union_types(*own).select("src", "dst", "src_type", "relation", "dst_type", "edge_type", "features")


def load_labels(df: DataFrame, key: str, label: str, label_type: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("node_id"), F.col(label).cast("int").alias("label"), F.lit(label_type).alias("label_type"))


def union_types(*tables: DataFrame) -> DataFrame:
    """All rows of tables by column name, columns that some lack as null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def lift(edges: DataFrame, edge_type: tuple[str, str, str] = ("node", "to", "node")) -> DataFrame:
    """Edges of one kind as typed ones: (src, dst, src_type, relation, dst_type, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *[F.lit(x).alias(c) for c, x in zip(("src_type", "relation", "dst_type"), edge_type, strict=True)], *rest)


def lower(edges: DataFrame) -> DataFrame:
    """Typed edges of a single type as edges of one kind; several types fail the query that reads them."""
    kind = F.concat_ws("|", "src_type", "relation", "dst_type")
    one = F.broadcast(edges.agg(F.min(kind).alias("_kind")))  # one row
    bad = F.raise_error(F.lit("edges of several types are not of one kind")).cast(edges.schema["src"].dataType)
    met = edges.join(one).withColumn("src", F.when(kind == F.col("_kind"), F.col("src")).otherwise(bad))
    return met.drop("_kind", "src_type", "relation", "dst_type")


def reverse_typed(edges: DataFrame) -> DataFrame:
    """Typed edges turned round: ends and their types change places, the relation stays."""
    turned = {"src": "dst", "dst": "src", "src_type": "dst_type", "dst_type": "src_type"}
    return edges.select(*[F.col(turned.get(c, c)).alias(c) for c in edges.columns])


def bidirect(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, one row for each (src, dst); of conflicting rows the one with the least other columns stays."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.inline(F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = dealt(edges.select(ends, *rest), "src", "dst")
    if not rest:
        return both.distinct()
    kept = both.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_x"))
    return kept.select("src", "dst", *[F.col(f"_x.{c}").alias(c) for c in rest])


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges once each: the smaller end first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def has_dangling_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    """Whether an edge lacks an end; stops at the first."""
    return edges.where(F.col(src).isNull() | F.col(dst).isNull()).limit(1).count() > 0


def dangling_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src).isNull() | F.col(dst).isNull())


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node ids that no edge has."""
    return nodes.select("node_id").distinct().join(endpoints(edges), "node_id", "left_anti")


def source_only(edges: DataFrame, bag: bool = False) -> DataFrame:
    """Nodes with outgoing edges only; ``bag``: those that are sources more often than destinations."""
    if bag:
        return edges.select(F.col("src").alias("node_id")).exceptAll(edges.select(F.col("dst").alias("node_id"))).distinct()
    return edges.select(F.col("src").alias("node_id")).distinct().join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def neighborless(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """Nodes without incoming edges: isolated ones, and in directed graphs those that are sources only."""
    if not directed:
        return isolated(nodes, edges)
    return nodes.select("node_id").distinct().join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def degrees(edges: DataFrame, direction: str = "both", most: int | None = None) -> DataFrame:
    """(node_id, degree); ``direction``: in, out or both; ``most`` clamps."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    rows = edges.select(F.explode(F.array(*ends)).alias("node_id")) if len(ends) == 2 else edges.select(F.col(ends[0]).alias("node_id"))
    n = F.count("*") if most is None else F.least(F.count("*"), F.lit(most))
    return rows.groupBy("node_id").agg(n.alias("degree"))


def degrees_by_type(edges: DataFrame, direction: str = "in", most: int = (1 << 31) - 1) -> DataFrame:
    """(node_id, node_type, degree) over typed edges: summed over all edge types that end at (or leave) the node's type, labels left out,
    clamped."""
    end = "dst" if direction == "in" else "src"
    rows = without_relations(edges).groupBy(F.col(end).alias("node_id"), F.col(f"{end}_type").alias("node_type"))
    return rows.agg(F.least(F.count("*"), F.lit(most)).alias("degree"))


def adjacency(edges: DataFrame, by: str = "dst") -> DataFrame:
    """(by, neighbors): sorted lists of the other ends, one for each node."""
    other = "src" if by == "dst" else "dst"
    return edges.groupBy(by).agg(F.array_sort(F.collect_list(other)).alias("neighbors"))


def neighbor_mean(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(node_id, mean, n): the mean of a value over a node's in-neighbors."""
    met = edges.join(values.select(F.col("node_id").alias("src"), F.col(value).alias("_v")), "src")
    return met.groupBy(F.col("dst").alias("node_id")).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))


def reindex(column: Column | str, offset: int) -> Column:
    """Ids of one type moved behind another's, into a shared id space."""
    return (F.col(column) if isinstance(column, str) else column) + F.lit(offset)


def labels_as_edges(positive: DataFrame, negative: DataFrame | None = None, direction: str = "out") -> DataFrame:
    """Label edges with a relation of their own; turned round when neighbors are sampled against direction."""
    parts = [positive.select("src", "dst", F.lit("positive_label").alias("relation"))]
    if negative is not None:
        parts.append(negative.select("src", "dst", F.lit("negative_label").alias("relation")))
    both = union_types(*parts)
    return reverse(both) if direction == "in" else both


def without_relations(edges: DataFrame, *suffixes: str) -> DataFrame:
    """Edges less those of label relations."""
    keep = F.lit(True)
    for s in suffixes or ("positive_label", "negative_label"):
        keep = keep & ~F.col("relation").endswith(s)
    return edges.where(keep)


def slotted_join(left: DataFrame, right: DataFrame, on: str, slots: int, how: str = "inner") -> DataFrame:
    """The join as ``slots`` smaller ones by the key's hash slot, each its own unit of shuffle; the same rows as one join.

    Both sides are kept in folders by slot, so each is read from its source once, and each smaller join reads its folders alone. Slots are
    written, and joined, by as many tasks as their bytes need."""
    at, n = F.pmod(F.xxhash64(on), F.lit(slots)).cast("int"), -(-max(shuffle_tasks(left), shuffle_tasks(right)) // slots)
    a, b = (materialize(x.withColumn("_slot", at).repartition(shuffle_tasks(x), on), "slots", by="_slot") for x in (left, right))
    one = lambda x, i: dealt(x.where(F.col("_slot") == i).drop("_slot"), on, tasks=n)
    return union_types(*[one(a, i).join(one(b, i), on, how) for i in range(slots)])


def merge_graphs(graphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of several graphs by key; the one with the greatest ``order`` wins."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return graphs.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
