"""The user's side of a preprocessing job: what to read, and how to transform it."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.impute import project
from ..operators.edges import has_dangling_edges
from ..operators.enumeration import enumerate_edges, enumerate_ids, enumerate_nodes
from ..sources.tables import EdgeReference, NodeReference


def pass_through(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Spec:
    """Feature columns with their types, label columns, and a function over the projected rows."""

    features: dict[str, str]
    labels: tuple[str, ...] = ()
    preprocess: Callable[[DataFrame], DataFrame] = pass_through


class PreprocessorConfig(ABC):
    """Subclasses say where nodes and edges are and what becomes of them."""

    def prepare(self, spark: SparkSession) -> None:
        """Runs before anything is read."""

    @abstractmethod
    def node_specs(self) -> dict[NodeReference, Spec]: ...

    @abstractmethod
    def edge_specs(self) -> dict[EdgeReference, Spec]: ...


@dataclass
class Preprocessed:
    ids: dict[str, DataFrame]
    nodes: dict[str, DataFrame]
    edges: dict[tuple[str, str, str, str], DataFrame]


def run(spark: SparkSession, config: PreprocessorConfig) -> Preprocessed:
    """Enumerate, check and transform all references; edges by (source, relation, destination, usage)."""
    config.prepare(spark)
    out = Preprocessed({}, {}, {})
    keys: dict[str, str] = {}
    for ref, spec in config.node_specs().items():
        rows = ref.load(spark)
        keys[ref.node_type] = ref.key
        ids = enumerate_ids(rows, ref.key)
        out.ids[ref.node_type] = ids
        kinds = dict(rows.dtypes)
        wanted = {ref.key: kinds[ref.key]} | spec.features | {x: kinds[x] for x in spec.labels}
        out.nodes[ref.node_type] = spec.preprocess(enumerate_nodes(project(rows, wanted), ref.key, ids))
    for ref, spec in config.edge_specs().items():
        rows = ref.load(spark)
        kinds = dict(rows.dtypes)
        source, relation, target = ref.edge_type
        rows = rows.select(ref.src, ref.dst, *spec.features)
        a = out.ids[source].withColumnRenamed(keys[source], "_key")
        b = out.ids[target].withColumnRenamed(keys[target], "_key")
        numbered = enumerate_edges(rows, ref.src, ref.dst, a, b, "_key")
        if has_dangling_edges(numbered, ref.src, ref.dst):
            raise ValueError(f"{ref.edge_type}: edges with unknown ends")
        kinds = dict(numbered.dtypes)
        out.edges[source, relation, target, ref.usage] = spec.preprocess(project(numbered, {ref.src: kinds[ref.src], ref.dst: kinds[ref.dst]} | spec.features))
    return out


def assets_exist(spark: SparkSession, *uris: str) -> dict[str, bool]:
    """Whether each path holds something, asked of the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        found[uri] = bool(path.getFileSystem(conf).exists(path))
    return found
