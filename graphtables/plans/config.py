"""Configurations: fanouts, graph metadata, and plug-ins by name."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EdgeType = tuple[str, str, str]


def parse_fanouts(text: str) -> list[int] | dict[EdgeType, list[int]]:
    """``[10, 5]``, or one list for each edge type: ``{("a", "to", "b"): [10, 5]}``; all lists of one length, no negative fanouts, and none
    for label relations, which are never sampled."""
    value = ast.literal_eval(text)
    lists = list(value.values()) if isinstance(value, dict) else [value]
    if not lists or any(not isinstance(x, list) or not x or any(not isinstance(n, int) or n < 0 for n in x) for x in lists):
        raise ValueError(f"not fanouts: {text}")
    if len({len(x) for x in lists}) > 1:
        raise ValueError("all edge types need the same number of hops")
    if isinstance(value, dict) and any(not (isinstance(k, tuple) and len(k) == 3) for k in value):
        raise ValueError("edge types are (source type, relation, destination type)")
    if isinstance(value, dict) and (labels := [k for k in value if str(k[1]).endswith(("positive_label", "negative_label"))]):
        raise ValueError(f"label relations are not sampled: {labels}")
    return value


@dataclass(frozen=True)
class GraphMetadata:
    """Node and edge types with their codes."""

    node_types: tuple[str, ...]
    edge_types: tuple[EdgeType, ...]

    def __post_init__(self):
        if len(set(self.node_types)) < len(self.node_types) or len(set(self.edge_types)) < len(self.edge_types):
            raise ValueError("types repeat")
        for s, _, d in self.edge_types:
            if s not in self.node_types or d not in self.node_types:
                raise ValueError(f"edge type {(s, _, d)} of unknown node types")

    def node_code(self, column: Column) -> Column:
        """Code of a node type, as a map lookup."""
        return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(self.node_types) for x in (t, i)]), column)

    def node_type(self, column: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(self.node_types) for x in (i, t)]), column)

    def edge_code(self, relation: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(self.edge_types) for x in ("-".join(t), i)]), relation)

    def reversed(self) -> GraphMetadata:
        return GraphMetadata(self.node_types, tuple((d, r, s) for s, r, d in self.edge_types))


@dataclass
class Registry:
    """Plug-ins by name: split strategies, assigners, transforms, post-processors."""

    known: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str):
        def put(f: Callable) -> Callable:
            if name in self.known:
                raise ValueError(f"{name} is taken")
            self.known[name] = f
            return f

        return put

    def make(self, name: str, **args) -> Callable[[DataFrame], DataFrame]:
        if name not in self.known:
            raise KeyError(f"no plug-in {name}; there are {sorted(self.known)}")
        return lambda df: self.known[name](df, **args)


REGISTRY = Registry()


#: What a job's configuration may hold: names, whether they are needed, and their types.
TEMPLATE: dict[str, tuple[bool, type | tuple[type, ...]]] = {
    "task": (True, str), "node_types": (True, (list, tuple)), "edge_types": (True, (list, tuple)), "fanouts": (False, (list, dict, str)), "split": (False, dict),
    "positive_edges": (False, int), "supervision_edge_types": (False, (list, tuple)), "skip_training": (False, bool), "paths": (False, dict), "directed": (False, bool),
}
TASKS = ("node_classification", "link_prediction", "inference")


def check_config(config: dict, exists: Callable[[str], bool] | None = None) -> GraphMetadata:
    """The metadata of a job's configuration; an error that names every fault it has: unknown, missing or mistyped entries, types that don't
    meet, fanouts, split ratios, supervision types outside the graph, and with ``exists`` paths where nothing is."""
    faults = [f"unknown entry {k}" for k in config if k not in TEMPLATE]
    for name, (needed, kind) in TEMPLATE.items():
        if name not in config:
            faults += [f"{name} is missing"] if needed else []
        elif not isinstance(config[name], kind):
            faults.append(f"{name} is a {type(config[name]).__name__}")
    if faults:
        raise ValueError("; ".join(faults))
    if config["task"] not in TASKS:
        faults.append(f"task {config['task']}")
    edge_types = tuple(tuple(x) for x in config["edge_types"])
    metadata = None
    try:
        metadata = GraphMetadata(tuple(config["node_types"]), edge_types)
    except ValueError as e:
        faults.append(str(e))
    if "fanouts" in config:
        try:
            fanouts = parse_fanouts(config["fanouts"] if isinstance(config["fanouts"], str) else repr(config["fanouts"]))
            faults += [f"fanouts of unknown edge type {k}" for k in (fanouts if isinstance(fanouts, dict) else ()) if k not in edge_types]
        except (ValueError, SyntaxError) as e:
            faults.append(str(e))
    if (ratios := config.get("split")) is not None and (set(ratios) != {"TRAIN", "VAL", "TEST"} or any(x < 0 for x in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9):
        faults.append(f"split ratios {ratios}")
    if config["task"] == "link_prediction" and not config.get("supervision_edge_types"):
        faults.append("link prediction needs supervision_edge_types")
    faults += [f"supervision edge type {x} is not of the graph" for x in config.get("supervision_edge_types", ()) if tuple(x) not in edge_types]
    if config.get("positive_edges", 1) < 1:
        faults.append("positive_edges is below 1")
    if exists is not None:
        faults += [f"nothing at {name}: {uri}" for name, uri in config.get("paths", {}).items() if not exists(uri)]
    if faults or metadata is None:
        raise ValueError("; ".join(faults))
    return metadata
