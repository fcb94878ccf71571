"""Neighborhood sampling with reproducible, hash-based randomness. Each site of sampling takes a salt of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_key, slot, uniform
from ..plans.scratch import dealt, dealt_alike, materialize
from .enumeration import number_rows


def _ranked(rows: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The n first rows of each group; the window's limit is pushed below its exchange by the planner."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def uniform_rows(rows: DataFrame, by: list[str], other: str, n: int, salt: str) -> DataFrame:
    """At most n rows of each group, at random by hash; one row for each (group, other). ``rank_key`` is md5, which any engine can
    recompute. Rows are dealt by group first, so that only they travel, not their keys."""
    rows = dealt(rows, *by, always=True).dropDuplicates([*by, other])
    return _ranked(rows, by, n, [rank_key(salt, *by, other), F.col(other)])


def weighted_rows(rows: DataFrame, by: list[str], other: str, weight: str, n: int, salt: str) -> DataFrame:
    """At most n rows of each group without replacement, with chances by weight: the n least -ln(u) / weight. Rows without a weight weigh 1, those of weight 0 or less are never drawn."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0))
    key = -F.log(uniform(salt, *by, other)) / w
    return _ranked(rows.where(w > 0), by, n, [key, F.col(other)])


def top_rows(rows: DataFrame, by: list[str], other: str, value: str, n: int) -> DataFrame:
    """The n rows of each group with the greatest value, ties to the smaller other."""
    return _ranked(rows, by, n, [F.desc(value), F.col(other)])


def with_replacement(lists: DataFrame, key: str, items: str, n: int, salt: str, out: str = "sampled") -> DataFrame:
    """n draws with replacement from the array of each row; empty and null arrays give empty ones."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(F.col(items), (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % F.size(items)).cast("int")))
    return lists.withColumn(out, F.when(F.size(items) > 0, draws).otherwise(F.slice(F.coalesce(F.col(items), F.array()), 1, 0)))


def permute(items: Column | str, key: Column | str, salt: str) -> Column:
    """The array in an order given by hashes of (salt, key, item)."""
    items, key = (F.col(x) if isinstance(x, str) else x for x in (items, key))
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string"), x.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda p: p["x"])


def permute_anew(items: Column | str, seed: int | None = None) -> Column:
    """The array in a random order, another one each time unless there is a seed."""
    return F.shuffle(F.col(items) if isinstance(items, str) else items, seed)


def downsample(nodes: DataFrame, n: int, salt: str = "downsample") -> DataFrame:
    """n rows at random, by hash: a distributed top-n, no full sort."""
    return nodes.orderBy(rank_key(salt, "node_id"), "node_id").limit(n)


def keep_fraction(rows: DataFrame, fraction: float, *key: str, salt: str = "fraction", legacy_inverted: bool = False) -> DataFrame:
    """About that fraction of rows, by hash; ``legacy_inverted`` keeps the others."""
    drawn = uniform(salt, *key) < fraction
    return rows.where(~drawn if legacy_inverted and fraction < 1 else drawn | F.lit(fraction >= 1))


def one_hop(edges: DataFrame, n: int, salt: str = "hop1") -> DataFrame:
    """(root, hop1): at most n in-neighbors of every node that has any."""
    rows = edges.select(F.col("dst").alias("root"), F.col("src").alias("hop1"))
    return uniform_rows(rows, ["root"], "hop1", n, salt)


def numbered_neighbors(edges: DataFrame, here: str = "dst", there: str = "src", types: tuple[str, ...] = (), salt: str = "hop1") -> DataFrame:
    """(node_id, *types, place, next, degree): each node's distinct neighbors in the order of their hashes, numbered from 0.

    Hashed and sorted once, whatever the number of paths that draw from them; dealt by node first, so that hashes don't travel."""
    rows = dealt(edges.select(F.col(here).alias("node_id"), F.col(there).alias("next"), *types), "node_id", *types, always=True).distinct()
    by = Window.partitionBy("node_id", *types)
    return rows.withColumns({"place": F.row_number().over(by.orderBy(rank_key(salt, "node_id", *types, "next"), "next")) - 1, "degree": F.count("*").over(by)})


def drawn_places(n: Column | int, degree: Column | str, salt: str, *by: Column | str) -> Column:
    """The places of n draws without replacement among ``degree``: a start by hash, then equal steps; all places if they are no more than n."""
    d = F.col(degree) if isinstance(degree, str) else degree
    n = F.lit(n) if isinstance(n, int) else n
    m = F.when(n < 0, d).otherwise(F.least(n, d))
    start = slot(salt, *by, slots=1 << 32) % d
    steps = F.transform(F.sequence(F.lit(0).cast("long"), m.cast("long") - 1), lambda i: (start + F.floor(i * d / m)) % d)
    return F.when(m > 0, steps).otherwise(F.array().cast("array<bigint>"))


def draw(paths: DataFrame, node: str, numbered: DataFrame, n: int, salt: str, by: list[str], types: tuple[str, ...] = ()) -> DataFrame:
    """``paths`` with a row for each neighbor (next) that is drawn for their ``node``: at most n, for each of ``types`` if there are any.

    A path draws places among its node's neighbors and meets just these: n rows a path, also where the node is a hub, whose neighbors lie
    apart by their places."""
    degrees = numbered.where("place = 0").select(F.col("node_id").alias(node), *types, "degree")
    at = paths.join(degrees, node).withColumn("place", F.explode(drawn_places(n, "degree", salt, *by, *types))).drop("degree")
    at, numbered = dealt_alike(at, numbered.select(F.col("node_id").alias(node), *types, "place", "next"), node, *types, "place")
    return at.join(numbered, [node, *types, "place"]).drop("place")


def next_hop(paths: DataFrame, numbered: DataFrame, n: int, k: int, salt: str | None = None) -> DataFrame:
    """Paths (root, hop1, ..., hop k-1) with at most n in-neighbors of their last node each, drawn anew for each path."""
    by = ["root", *[f"hop{i}" for i in range(1, k)]]
    return draw(paths, f"hop{k - 1}", numbered, n, salt or f"hop{k}", by).select(*by, F.col("next").alias(f"hop{k}"))


def k_hop(edges: DataFrame, fanouts: list[int]) -> list[DataFrame]:
    """Sampled paths of each length, one DataFrame per hop, each a table. Hops are drawn from ids alone; features are joined afterwards."""
    if len(fanouts) == 1:
        return [one_hop(edges, fanouts[0])]
    numbered = materialize(numbered_neighbors(edges), "neighbors")
    hops = [materialize(numbered.where(F.col("place") < fanouts[0]).select(F.col("node_id").alias("root"), F.col("next").alias("hop1")), "hop1")]
    for k, n in enumerate(fanouts[1:], 2):
        hops.append(materialize(next_hop(hops[-1], numbered, n, k), f"hop{k}"))
    return hops


#: Relations with these ends are labels, along which nothing is sampled.
LABEL_RELATIONS = ("positive_label", "negative_label")


def typed_frontier(edges: DataFrame, seeds: DataFrame, fanouts: dict[tuple[str, str, str], list[int]], direction: str = "in", salt: str = "typed") -> DataFrame:
    """(root, root_type, node_id, node_type, hop): nodes met by expanding only newly found ones, with a fanout for each edge type and hop.

    ``edges``: (src, dst, src_type, relation, dst_type); ids may repeat between types. An edge type without fanouts isn't followed, nor are
    label relations; a fanout of 0 leaves a type out of a hop, -1 takes all. ``seeds``: (node_id, node_type)."""
    if len({len(x) for x in fanouts.values()}) != 1:
        raise ValueError("all edge types need the same number of hops")
    if any(relation.endswith(LABEL_RELATIONS) for _, relation, _ in fanouts):
        raise ValueError("label relations are not sampled")
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    kind = F.concat_ws("|", "src_type", "relation", "dst_type")
    own = edges.select(here, there, kind.alias("kind"), F.col(f"{here}_type").alias("node_type"), F.col(f"{there}_type").alias("next_type"))
    own = own.where(F.col("kind").isin([  # types that no hop follows are not numbered
        "|".join(t) for t, x in fanouts.items() if any(x)]))
    numbered = materialize(numbered_neighbors(own, here, there, ("node_type", "next_type", "kind"), salt), "typed_neighbors")
    degrees = numbered.where("place = 0").select("node_id", "node_type", "kind", "degree")
    found = seeds.select(F.col("node_id").alias("root"), F.col("node_type").alias("root_type"), "node_id", "node_type", F.lit(0).alias("hop")).distinct()
    frontier, key = found, ["root", "root_type", "node_id", "node_type"]
    for k in range(1, len(next(iter(fanouts.values()))) + 1):
        fan = {"|".join(t): x[k - 1] for t, x in fanouts.items() if x[k - 1]}
        if not fan:
            break
        n = F.element_at(F.create_map(*[F.lit(x) for item in fan.items() for x in item]), F.col("kind"))
        at = frontier.select(*key).join(degrees.where(F.col("kind").isin(list(fan))), ["node_id", "node_type"])
        at = at.select(*key, "kind", F.explode(drawn_places(n, "degree", f"{salt}{k}", "root", "root_type", "node_id", "node_type", "kind")).alias("place"))
        at, ends = dealt_alike(at, numbered, "node_id", "node_type", "kind", "place")
        met = at.join(ends, ["node_id", "node_type", "kind", "place"]).select("root", "root_type", F.col("next").alias("node_id"), F.col("next_type").alias("node_type"))
        frontier = materialize(met.distinct().join(found.select(*key), key, "left_anti").withColumn("hop", F.lit(k)), f"typed_hop{k}")
        found = found.unionByName(frontier)
    return found


def anchor_and_label_seeds(anchors: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, node_id, place, is_anchor): for each anchor the seeds of its sample in a stable order, itself first, then its label ends by id.

    ``labels``: (src, dst); repeated label ends and the anchor among them come once."""
    ends = labels.select(F.col("src").alias("root"), F.col("dst").alias("node_id")).where("root <> node_id").distinct()
    ends = ends.join(anchors.select(F.col("node_id").alias("root")).distinct(), "root", "left_semi")
    both = anchors.select(F.col("node_id").alias("root"), "node_id", F.lit(True).alias("is_anchor")).distinct().unionByName(ends.withColumn("is_anchor", F.lit(False)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("is_anchor"), "node_id")) - 1)


def remap_labels(labels: DataFrame, sampled: DataFrame) -> DataFrame:
    """(root, label, place): label ends (src, dst) as places of the sampled nodes (root, node_id, place); one that was not sampled fails the
    query that reads them."""
    own = labels.select(F.col("src").alias("root"), F.col("dst").alias("label"))
    met = own.join(sampled.select("root", F.col("node_id").alias("label"), "place"), ["root", "label"], "left")
    missing = F.raise_error(F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" of anchor "), F.col("root").cast("string"), F.lit(" was not sampled"))).cast("int")
    return met.withColumn("place", F.when(F.col("place").isNull(), missing).otherwise(F.col("place")))


def k_hop_frontier(edges: DataFrame, seeds: DataFrame, fanouts: list[int], direction: str = "in", by_type: bool = False, salt: str = "frontier") -> DataFrame:
    """(root, node_id, hop): nodes met by expanding only newly found ones, per edge type if ``by_type``; a fanout of 0 ends a hop, -1 takes all.

    Neighbors are numbered once; each hop draws places among them, and is anti-joined with what was found."""
    here, there = ("dst", "src") if direction == "in" else ("src", "dst")
    found = seeds.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("hop"))
    frontier = found
    types = ("edge_type",) if by_type else ()
    numbered = materialize(numbered_neighbors(edges, here, there, types, salt), "neighbors")
    for k, n in enumerate(fanouts, 1):
        if n == 0:
            break
        drawn = draw(frontier.select("root", "node_id"), "node_id", numbered, n, f"{salt}{k}", ["root", "node_id"], types)
        new = drawn.select("root", F.col("next").alias("node_id")).distinct().join(found.select("root", "node_id"), ["root", "node_id"], "left_anti")
        frontier = materialize(new.withColumn("hop", F.lit(k)), f"frontier{k}")
        found = found.unionByName(frontier)
    return found


@dataclass(frozen=True)
class SamplingOp:
    """One step of a sampling plan: from the nodes of its inputs (or the root) along edges of one type.

    ``method``: uniform, weighted, top_k, or user (then ``choose`` maps candidate rows (root, node_id, next, ...) to those kept)."""

    name: str
    edge_type: tuple[str, str, str]
    n: int
    inputs: tuple[str, ...] = ()
    method: str = "uniform"
    value: str = "weight"
    direction: str = "in"
    choose: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


def check_plan(ops: list[SamplingOp], root_type: str) -> list[SamplingOp]:
    """The operations in an order in which inputs come first; errors on unknown inputs, cycles, and types that don't meet."""
    by_name = {o.name: o for o in ops}
    if len(by_name) < len(ops):
        raise ValueError("names of sampling operations repeat")
    ends = {o.name: (o.edge_type[2], o.edge_type[0]) if o.direction == "in" else (o.edge_type[0], o.edge_type[2]) for o in ops}
    ordered: list[SamplingOp] = []
    done: set[str] = set()
    for o in ops:
        for i in o.inputs:
            if i not in by_name:
                raise ValueError(f"{o.name}: no operation {i}")
            if ends[i][1] != ends[o.name][0]:
                raise ValueError(f"{o.name}: starts at {ends[o.name][0]}, its input {i} ends at {ends[i][1]}")
        if not o.inputs and ends[o.name][0] != root_type:
            raise ValueError(f"{o.name}: starts at {ends[o.name][0]}, the root is a {root_type}")
    while len(ordered) < len(ops):
        ready = [o for o in ops if o.name not in done and set(o.inputs) <= done]
        if not ready:
            raise ValueError("sampling operations form a cycle")
        ordered += ready
        done |= {o.name for o in ready}
    return ordered


def run_plan(roots: DataFrame, edges: DataFrame, ops: list[SamplingOp], root_type: str) -> DataFrame:
    """(root, op, src, dst, relation): the edges that each operation of the plan samples for each root, as sets.

    ``edges``: (src, dst, src_type, relation, dst_type, ...). An operation starts from the union of its inputs' result nodes."""
    results: dict[str, DataFrame] = {}
    out = []
    for op in check_plan(ops, root_type):
        here, there = ("dst", "src") if op.direction == "in" else ("src", "dst")
        own = edges.where((F.col("src_type") == op.edge_type[0]) & (F.col("relation") == op.edge_type[1]) & (F.col("dst_type") == op.edge_type[2]))
        start = roots.select(F.col("node_id").alias("root"), "node_id")
        if op.inputs:
            start = union_of([results[i] for i in op.inputs]).distinct()
        met = start.join(own.withColumnsRenamed({here: "node_id", there: "next"}), "node_id")
        if op.method == "uniform":
            numbered = materialize(numbered_neighbors(own, here, there, salt=op.name), op.name)
            kept = draw(start, "node_id", numbered, op.n, f"{op.name}start", ["root", "node_id"]).withColumn("relation", F.lit(op.edge_type[1]))
        elif op.method == "weighted":
            kept = weighted_rows(met, ["root", "node_id"], "next", op.value, op.n, op.name)
        elif op.method == "top_k":
            kept = top_rows(met, ["root", "node_id"], "next", op.value, op.n)
        elif op.method == "user" and op.choose is not None:
            kept = op.choose(met)
        else:
            raise ValueError(f"{op.name}: method {op.method}")
        results[op.name] = kept.select("root", F.col("next").alias("node_id"))
        out.append(kept.select("root", F.lit(op.name).alias("op"), F.col("next").alias(there), F.col("node_id").alias(here), "relation").select("root", "op", "src", "dst", "relation").distinct())
    return union_of(out)


def plan_positives(positives: DataFrame, edges: DataFrame, ops: list[SamplingOp], root_type: str, positive_type: str) -> DataFrame:
    """(root, positive, op, src, dst, relation): the plan run from each distinct positive end of (root, dst), for each anchor that has it.

    Positive ends have to be of the plan's root type."""
    if positive_type != root_type:
        raise ValueError(f"the plan starts at a {root_type}, positives are of type {positive_type}")
    found = run_plan(positives.select(F.col("dst").alias("node_id")).distinct(), edges, ops, root_type).withColumnRenamed("root", "positive")
    return positives.select("root", F.col("dst").alias("positive")).distinct().join(found, "positive").select("root", "positive", "op", "src", "dst", "relation")


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metapaths(edge_types: list[tuple[str, str, str]], root_type: str, hops: int) -> list[list[str]]:
    """All chains of relations of that length that end at the root type, found backwards; the relation next to the root comes first."""
    found: list[tuple[list[str], str]] = [([], root_type)]
    for _ in range(hops):
        found = [([*path, r], s) for path, at in found for s, r, d in edge_types if d == at]
    return [path for path, _ in found]


def metapath_sample(roots: DataFrame, edges: DataFrame, path: list[str], n: int) -> DataFrame:
    """(root, hop1, ..., hopk): paths along the relations, at most n neighbors a step."""
    out = roots.select(F.col("node_id").alias("root"))
    for k, relation in enumerate(path, 1):
        last = "root" if k == 1 else f"hop{k - 1}"
        by = ["root", *[f"hop{i}" for i in range(1, k)]]
        numbered = materialize(numbered_neighbors(edges.where(F.col("relation") == relation), salt=relation), "metapath")
        out = draw(out, last, numbered, n, f"{relation}{k}", by).select(*by, F.col("next").alias(f"hop{k}"))
    return out


def self_supervised_positives(edges: DataFrame, fraction: float, salt: str = "positive") -> DataFrame:
    """That fraction of the edges, the first by hash: ordered in ranges and numbered by their counts, so no task holds them all."""
    keyed = edges.withColumn("_key", rank_key(salt, "src", "dst"))
    numbered = number_rows(keyed, "_key", "src", "dst", out="_number")
    few = F.broadcast(numbered.agg(F.floor(F.count("*") * fraction).alias("_few")))  # one row
    return numbered.join(few).where("_number < _few").select(*edges.columns)


def negatives_uniform(relations: DataFrame, sizes: DataFrame, k: int, salt: str = "negative") -> DataFrame:
    """(relation, i, src, dst, label 0): k random pairs for each relation, ends drawn from the vocabularies of its node types."""
    n = sizes.select("node_type", "size")
    met = relations.join(F.broadcast(n.withColumnsRenamed({"node_type": "src_type", "size": "src_size"})), "src_type").join(F.broadcast(n.withColumnsRenamed({"node_type": "dst_type", "size": "dst_size"})), "dst_type")
    rows = met.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return rows.select("relation", "i", _pick(f"{salt}src", "src_size").alias("src"), _pick(f"{salt}dst", "dst_size").alias("dst"), F.lit(0).alias("label"))


def _pick(salt: str, size: str) -> Column:
    return F.conv(F.substring(rank_key(salt, "relation", "i"), 1, 8), 16, 10).cast("long") % F.col(size)


def negatives_in_batch(batch: DataFrame, k: int, corrupt: str = "dst", pool: DataFrame | None = None, salt: str = "contrast") -> DataFrame:
    """(id, src, dst): for each positive (id, batch, relation, src, dst) k corrupted pairs, ends taken from other rows of its batch and
    relation, or of ``pool`` (id, batch, relation, node_id). ``corrupt``: src, dst, or both (by the parity of a hash).

    Rows are numbered within their batch and relation, by hash; a positive draws k places and meets just these: k rows each, not all pairs."""
    group = ["batch", "relation"]
    own = Window.partitionBy(*group)
    place = lambda df: df.withColumns({"place": F.row_number().over(own.orderBy(rank_key(salt, "id"), "id")) - 1, "size": F.count("*").over(own)})
    if pool is None:
        numbered = materialize(place(batch), "batch")
        rows = numbered.withColumn("others", F.col("size") - 1)
        # places behind its own, round the batch: never itself
        drawn = F.transform(drawn_places(k, "others", f"{salt}start", "id"), lambda p: (F.col("place") + 1 + p) % F.col("size"))
        rows = rows.where("others > 0").withColumn("drawn", drawn).drop("place", "size", "others")
        other = numbered.select(*group, F.col("place").alias("at"), F.col("id").alias("other"), F.col("src" if corrupt == "src" else "dst").alias("node_id"))
    else:
        numbered = materialize(place(pool), "pool")
        sizes = numbered.where("place = 0").select(*group, "size")
        rows = batch.join(sizes, group).withColumn("drawn", drawn_places(k, "size", f"{salt}start", "id")).drop("size")
        other = numbered.select(*group, F.col("place").alias("at"), F.col("id").alias("other"), "node_id")
    kept = rows.withColumn("at", F.explode("drawn")).drop("drawn").join(other, [*group, "at"])
    head = F.lit(corrupt == "src") if corrupt != "both" else F.conv(F.substring(rank_key(f"{salt}side", "id", "other"), 8, 1), 16, 10).cast("int") % 2 == 0
    return kept.select("id", F.when(head, F.col("node_id")).otherwise(F.col("src")).alias("src"), F.when(head, F.col("dst")).otherwise(F.col("node_id")).alias("dst"))


def retrieval_masks(pairs: DataFrame) -> DataFrame:
    """Candidates (query, item, candidate) that must not count as negatives: the query's own item, and items that it also has."""
    known = pairs.select("query", F.col("item").alias("candidate"), F.lit(True).alias("accidental")).distinct()
    return pairs.select("query", "item").join(known, "query").where("item <> candidate")


def log_q(frequency: Column | str, batch: int, total: Column | str) -> Column:
    """Log of the chance that an item is in a batch: min(1, batch * frequency / total)."""
    f, t = (F.col(x) if isinstance(x, str) else x for x in (frequency, total))
    return F.log(F.least(F.lit(1.0), batch * f / t))
