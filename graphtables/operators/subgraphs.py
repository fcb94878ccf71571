"""Rooted subgraphs: hydration of sampled paths, assembly of samples, checks of what was assembled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dealt, dealt_alike, materialize
from .edges import neighborless, source_only
from .sampling import k_hop, uniform_rows, union_of

NODE = "struct<node_id:bigint,node_type:int,features:array<float>>"
EDGE = "struct<src:bigint,dst:bigint,edge_type:int,features:array<float>>"


def _node():
    return F.struct(F.col("node_id").cast("long").alias("node_id"), F.col("node_type").cast("int").alias("node_type"), F.col("features").cast("array<float>").alias("features")).cast(NODE)


def _edge():
    return F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("edge_type").cast("int").alias("edge_type"), F.col("features").cast("array<float>").alias("features")).cast(EDGE)


def sampled_edges(hops: list[DataFrame], dedup: bool = False) -> DataFrame:
    """(root, src, dst) of all sampled paths; an edge that two hops sampled comes twice, unless ``dedup``."""
    parts = []
    for k, paths in enumerate(hops, 1):
        parts.append(paths.select("root", F.col(f"hop{k}").alias("src"), F.col("root" if k == 1 else f"hop{k - 1}").alias("dst")))
    out = union_of(parts)
    return out.distinct() if dedup else out


def hydrate_nodes(ids: DataFrame, nodes: DataFrame, by: str | list[str] = "root", keep: bool = False) -> DataFrame:
    """(by, nodes): the set of node structs of each root. Where ``ids`` has node_type, ids and types both have to agree, so that the same
    id in another type isn't met. Ids without a row of features vanish, or with ``keep`` stay with null features."""
    by = [by] if isinstance(by, str) else by
    key = ["node_id", "node_type"] if "node_type" in ids.columns else ["node_id"]
    met = dealt(ids.select(*by, *key), *by, always=True).distinct().join(nodes, key, "left" if keep else "inner")
    return dealt(met, *by).groupBy(*by).agg(F.array_sort(F.collect_list(_node())).alias("nodes"))


def hydrate_edges(rows: DataFrame, edges: DataFrame, by: str | list[str] = "root", keep: bool = False) -> DataFrame:
    """(by, edges): the bag of edge structs of each root; parallel edges multiply. Where ``rows`` has edge_type, it has to agree too. Edges
    without a row of features vanish, or with ``keep`` stay with null features."""
    by = [by] if isinstance(by, str) else by
    key = ["src", "dst", "edge_type"] if "edge_type" in rows.columns else ["src", "dst"]
    rows, edges = dealt_alike(rows.select(*by, *key), edges, *key)
    met = rows.join(edges, key, "left" if keep else "inner")
    return dealt(met, *by).groupBy(*by).agg(F.array_sort(F.collect_list(_edge())).alias("edges"))


def rooted_subgraphs(nodes: DataFrame, edges: DataFrame, fanouts: list[int] | None = None, dedup_edges: bool = False) -> DataFrame:
    """(root, root_node, nodes, edges): the sampled neighborhood of every node with in-edges, the root among its nodes.

    Ids are sampled first; features meet them in one join for nodes and one for edges, whatever the number of hops. Edges and sampled
    paths are tables, so that neither is made again for each use."""
    edges = materialize(edges, "edges")
    rows = materialize(sampled_edges(k_hop(edges.select("src", "dst"), fanouts or [10, 10]), dedup_edges), "sampled")
    ids = rows.select("root", F.explode(F.array("src", "dst", "root")).alias("node_id"))
    root_node = nodes.select(F.col("node_id").alias("root"), _node().alias("root_node"))
    out = hydrate_nodes(ids, nodes).join(hydrate_edges(rows, edges), "root", "left").join(root_node, "root")
    return out.select("root", "root_node", "nodes", F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))


def with_neighborless(subgraphs: DataFrame, nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """One row for every node: its subgraph, or itself alone, with null edges."""
    alone = neighborless(nodes, edges, directed).join(nodes, "node_id").select(F.col("node_id").alias("root"), _node().alias("root_node"))
    alone = alone.select("root", "root_node", F.array("root_node").alias("nodes"), F.lit(None).cast(f"array<{EDGE}>").alias("edges"))
    return subgraphs.unionByName(alone)


def classification_samples(subgraphs: DataFrame, labels: DataFrame) -> DataFrame:
    """Subgraphs of labeled roots, with all their labels."""
    by = labels.groupBy(F.col("node_id").alias("root")).agg(F.array_sort(F.collect_list(F.struct("label_type", "label"))).alias("labels"))
    return subgraphs.join(by, "root")


def positive_edges(edges: DataFrame, n: int, salt: str = "positive", anchors: int | None = None) -> DataFrame:
    """(root, dst): at most n outgoing edges of each root, for at most ``anchors`` roots."""
    rows = uniform_rows(edges.select(F.col("src").alias("root"), "dst"), ["root"], "dst", n, salt)
    if anchors is not None:
        few = rows.select(F.col("root").alias("node_id")).distinct().orderBy(F.md5(F.col("node_id").cast("string")), "node_id").limit(anchors)
        rows = rows.join(few.select(F.col("node_id").alias("root")), "root", "left_semi")
    return rows


def _task_edges(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    rows, edges = dealt_alike(rows.withColumnRenamed("root", "src"), edges, "src", "dst")
    met = rows.join(edges, ["src", "dst"])
    return met.groupBy(F.col("src").alias("root")).agg(F.array_sort(F.collect_list(_edge())).alias(name))


def _neighborhoods(rows: DataFrame, subgraphs: DataFrame, name: str) -> DataFrame:
    """Nodes and edges of the other ends' subgraphs, as sets."""
    met = rows.join(subgraphs.select(F.col("root").alias("dst"), F.col("nodes").alias("_n"), F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("_e")), "dst")
    return met.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_list("_n"))).alias(f"{name}_nodes"), F.array_distinct(F.flatten(F.collect_list("_e"))).alias(f"{name}_edges_near"))


def link_samples(subgraphs: DataFrame, positives: DataFrame, positive_rows: DataFrame, negatives: DataFrame | None = None, negative_rows: DataFrame | None = None, keep_isolated: bool = False) -> DataFrame:
    """(root, root_node, nodes, edges, pos_edges, neg_edges): each anchor's own neighborhood and its label ends', merged.

    ``positives``/``negatives``: sampled (root, dst); ``*_rows``: the edges they are hydrated from. Anchors need a positive, unless
    ``keep_isolated``; negatives are optional for an anchor."""
    none_e, none_n = F.array().cast(f"array<{EDGE}>"), F.array().cast(f"array<{NODE}>")
    how = "left" if keep_isolated else "inner"
    out = subgraphs.join(_task_edges(positives, positive_rows, "pos_edges"), "root", how).join(_neighborhoods(positives, subgraphs, "pos"), "root", how)
    if negatives is not None:
        out = out.join(_task_edges(negatives, negative_rows, "neg_edges"), "root", "left").join(_neighborhoods(negatives, subgraphs, "neg"), "root", "left")
    else:
        out = out.withColumns({"neg_edges": none_e, "neg_nodes": none_n, "neg_edges_near": none_e})
    near = [F.coalesce(c, none_e) for c in ("edges", "pos_edges_near", "neg_edges_near")]
    nodes = [F.coalesce(c, none_n) for c in ("nodes", "pos_nodes", "neg_nodes")]
    return out.select(
        "root", "root_node", F.array_sort(F.array_distinct(F.concat(*nodes))).alias("nodes"), F.array_sort(F.array_distinct(F.concat(*near))).alias("edges"),
        F.coalesce("pos_edges", none_e).alias("pos_edges"), F.coalesce("neg_edges", none_e).alias("neg_edges"),
    )


def reference_subgraphs(subgraphs: DataFrame, nodes: DataFrame, edges: DataFrame, label_edges: DataFrame) -> DataFrame:
    """Subgraphs, and the nodes that only label edges or outgoing edges reach, alone."""
    more = source_only(edges).unionByName(label_edges.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct()
    more = more.join(subgraphs.select(F.col("root").alias("node_id")), "node_id", "left_anti").join(nodes, "node_id")
    alone = more.select(F.col("node_id").alias("root"), _node().alias("root_node"))
    return subgraphs.unionByName(alone.select("root", "root_node", F.array("root_node").alias("nodes"), F.lit(None).cast(f"array<{EDGE}>").alias("edges")))


def ego_nets(edges: DataFrame, n: int, hops: int = 2, post=None, nodes: DataFrame | None = None) -> DataFrame:
    """(root, neighbors): sampled in-neighbors up to ``hops``, as sorted sets of (hop, node_id); ``post`` maps the result.

    With ``nodes`` also the features: (root, root_node, neighbors, nodes, edges), nodes and edges as sets of structs by id and type."""
    paths = k_hop(edges.select("src", "dst"), [n] * hops)
    parts = [p.select("root", F.lit(k).alias("hop"), F.col(f"hop{k}").alias("node_id")) for k, p in enumerate(paths, 1)]
    out = dealt(union_of(parts), "root").groupBy("root").agg(F.array_sort(F.collect_set(F.struct("hop", "node_id"))).alias("neighbors"))
    if nodes is not None:
        rows = materialize(sampled_edges(paths, dedup=True), "ego_edges")
        ids = rows.select("root", F.explode(F.array("src", "dst", "root")).alias("node_id"))
        root_node = nodes.select(F.col("node_id").alias("root"), _node().alias("root_node"))
        out = out.join(hydrate_nodes(ids, nodes), "root").join(hydrate_edges(rows, edges), "root").join(root_node, "root")
        out = out.select("root", "root_node", "neighbors", "nodes", "edges")
    return post(out) if post else out


def invalid_subgraphs(subgraphs: DataFrame) -> DataFrame:
    """Rows with an edge whose end isn't among the nodes."""
    ids = F.transform("nodes", lambda n: n["node_id"])
    return subgraphs.where(F.exists(F.coalesce("edges", F.array().cast(f"array<{EDGE}>")), lambda e: ~F.array_contains(ids, e["src"]) | ~F.array_contains(ids, e["dst"])))


def validate(subgraphs: DataFrame) -> DataFrame:
    """The same rows; an edge with an unknown end fails the query that reads them."""
    ids = F.transform("nodes", lambda n: n["node_id"])
    ok = ~F.exists(F.coalesce("edges", F.array().cast(f"array<{EDGE}>")), lambda e: ~F.array_contains(ids, e["src"]) | ~F.array_contains(ids, e["dst"]))
    return subgraphs.withColumn("root", F.when(ok, F.col("root")).otherwise(F.raise_error(F.concat(F.lit("edge end not among the nodes of root "), F.col("root").cast("string"))).cast("long")))


def is_alone(nodes: str = "nodes"):
    """Whether a subgraph holds its root only."""
    return F.size(nodes) == 1


def local_index(subgraphs: DataFrame) -> DataFrame:
    """(root, src, dst): edges by their nodes' places in the subgraph."""
    ids = F.transform("nodes", lambda n: n["node_id"])
    e = subgraphs.select("root", ids.alias("ids"), F.explode("edges").alias("e"))
    return e.select("root", (F.array_position("ids", F.col("e.src")) - 1).alias("src"), (F.array_position("ids", F.col("e.dst")) - 1).alias("dst"))
