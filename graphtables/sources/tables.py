"""Reading and writing tables: files, shards, bucketed tables, catalog lookups."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import feature_array
from ..operators.partitioning import shard_files


def read(spark: SparkSession, uri: str, kind: str = "parquet", glob: str | None = None, schema=None, **options) -> DataFrame:
    """Files of one kind (parquet, json, csv, orc, text, binaryFile) below a path."""
    reader = spark.read.format(kind).options(**options)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return (reader.schema(schema) if schema else reader).load(uri)


def write(df: DataFrame, uri: str, kind: str = "parquet", mode: str = "overwrite", rows_per_file: int | None = None, files: int | None = None, by: list[str] | None = None, bytes_per_file: int | None = None) -> None:
    """Rows to files; their number or size may be bounded, and folders made by columns. ``bytes_per_file`` bounds the rows by their mean
    length as JSON, which costs a pass over them."""
    if bytes_per_file:
        mean = df.agg(F.avg(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 1.0
        rows_per_file = min(rows_per_file or 1 << 62, max(1, int(bytes_per_file / mean)))
    if files:
        df = df.repartition(files)
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).format(kind).save(uri)


def files_below(spark: SparkSession, uri: str) -> list[str]:
    """The data files of a folder, sorted, asked of the file system that Spark uses for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(path, True)
    out = []
    while found.hasNext():
        file = found.next().getPath()
        if file.getName()[0] not in "._":
            out.append(file.toString())
    return sorted(out)


def read_rank(spark: SparkSession, uri: str, rank: int, ranks: int, kind: str = "parquet") -> DataFrame:
    """The files of one rank: sorted files cut contiguously, sizes differ by one at most. A rank without files gets no rows."""
    own = shard_files(files_below(spark, uri), rank, ranks)
    whole = read(spark, uri, kind)
    return spark.read.schema(whole.schema).format(kind).load(own) if own else whole.limit(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class NodeReference:
    """Where nodes of a type are, and which column identifies them."""

    uri: str
    node_type: str
    key: str
    kind: str = "parquet"

    def load(self, spark: SparkSession) -> DataFrame:
        return read(spark, self.uri, self.kind)


@dataclass(frozen=True)
class EdgeReference:
    """Where edges of a type are, and their usage (main, positive, negative)."""

    uri: str
    edge_type: tuple[str, str, str]
    src: str
    dst: str
    usage: str = "main"
    kind: str = "parquet"

    def load(self, spark: SparkSession) -> DataFrame:
        return read(spark, self.uri, self.kind)


def check_references(nodes: list[NodeReference], edges: list[EdgeReference], node_types: set[str], edge_types: set[tuple[str, str, str]]) -> None:
    """Every type of the graph has its data, and no data lacks a type."""
    a, b = {n.node_type for n in nodes}, {e.edge_type for e in edges if e.usage == "main"}
    if a != node_types or b != edge_types:
        raise ValueError(f"references and graph differ: nodes {sorted(a ^ node_types)}, edges {sorted(b ^ edge_types)}")


def shard(df: DataFrame, key: str, i: int, n: int) -> DataFrame:
    """One of n disjoint shards by the key's hash."""
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == i)


def sharded(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """All rows, each shard in a partition of its own: one scan, dealt out by the key's hash."""
    return df.repartitionById(n, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int"))


def edge_table_with_features(df: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, features): all other columns as one array<float>, nulls as 0."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), feature_array(*[c for c in df.columns if c not in (src, dst)]).alias("features"))


def features_and_label(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    return df.select(feature_array(*features).alias("features"), feature_array(*labels).alias("labels"))


def split_weight(df: DataFrame, names: list[str], weight: str, features: str = "features") -> DataFrame:
    """The weight feature as a column of its own, and the features without it."""
    i = names.index(weight)
    rest = F.concat(F.slice(features, 1, i), F.slice(features, i + 2, len(names)))
    return df.withColumns({"weight": F.get(F.col(features), F.lit(i)), features: rest})


def bucketed(df: DataFrame, n: int, column: str, name: str) -> DataFrame:
    """``df`` kept as a table bucketed and sorted by a column, so that joins on it need no exchange."""
    df.repartition(n, column).write.mode("overwrite").bucketBy(n, column).sortBy(column).saveAsTable(name)
    return df.sparkSession.table(name)


def rows_and_columns(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def tables_matching(spark: SparkSession, part: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if part in t.name)


def latest_table(spark: SparkSession, prefix: str, most: str | None = None) -> str | None:
    """The table of that prefix with the greatest suffix, up to ``most``."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix) and (most is None or t.name[len(prefix) :] <= most)]
    return max(found, default=None)


def tables_by_pattern(spark: SparkSession, pattern: str, first: str = "", last: str = "￿") -> list[str]:
    """Tables whose name has the pattern, whose first group (a date suffix) lies between the bounds, newest first."""
    found = [(m[1], t.name) for t in spark.catalog.listTables() if (m := re.fullmatch(pattern, t.name)) and first <= m[1] <= last]
    return [name for _, name in sorted(found, reverse=True)]


def tables_created(spark: SparkSession, part: str, first: str = "", last: str = "\uffff") -> list[str]:
    """Tables whose name has the part and whose day of creation (yyyymmdd, UTC by the session's time zone) lies between the bounds, oldest first."""
    found = []
    for name in tables_matching(spark, part):
        rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").collect()}
        made = datetime.strptime(re.sub(r" [A-Z]+ (?=\d{4}$)", " ", rows["Created Time"]), "%a %b %d %H:%M:%S %Y")
        if first <= made.strftime("%Y%m%d") <= last:
            found.append((made, name))
    return [name for _, name in sorted(found)]


def with_date(prefix: str, day: date | str) -> str:
    """The name of a prefix's table of a day: the prefix, _ and yyyymmdd."""
    return f"{prefix}_{day if isinstance(day, str) else day.strftime('%Y%m%d')}"


def lookback(spark: SparkSession, prefix: str, day: str, days: int) -> str | None:
    """The newest table of the prefix from the days before ``day`` (yyyymmdd), as many as given; none if there is none."""
    last = datetime.strptime(day, "%Y%m%d").date()
    first, before = (last - timedelta(days=days)).strftime("%Y%m%d"), (last - timedelta(days=1)).strftime("%Y%m%d")
    return next(iter(tables_by_pattern(spark, re.escape(prefix) + r"_(\d{8})", first, before)), None)


def insert(df: DataFrame, name: str) -> None:
    """Rows into a table of the catalog by column name; the table is made if it isn't there."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df.select(*spark.table(name).columns).write.insertInto(name)
    else:
        df.write.saveAsTable(name)


def copy_files(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> int:
    """Copy a file or folder between any file systems that Spark knows, on the driver; how many files there are now."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    a, b = fs.Path(source), fs.Path(target)
    there = b.getFileSystem(conf)
    if there.exists(b):
        if not overwrite:
            raise FileExistsError(target)
        there.delete(b, True)
    fs.FileUtil.copy(a.getFileSystem(conf), a, there, b, False, conf)
    return there.getContentSummary(b).getFileCount()


def drop_matching(spark: SparkSession, part: str) -> list[str]:
    """Drop the tables that match; their names."""
    names = tables_matching(spark, part)
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS `{n}`")
    return names


def table_path(*parts: str) -> str:
    """project.dataset.table, from parts that may themselves hold dots or a colon."""
    out = [x for p in parts for x in p.replace(":", ".").split(".") if x]
    if not 2 <= len(out) <= 3:
        raise ValueError(f"a table path has two or three parts: {'.'.join(out)}")
    return ".".join(out)


def adjacency_text(spark: SparkSession, uri: str) -> DataFrame:
    """(src, dst) from lines of a node followed by its neighbors."""
    ids = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(uri).select(ids.alias("x")).where(F.size("x") > 1)
    return rows.select(F.col("x")[0].cast("long").alias("src"), F.explode(F.slice("x", 2, 1 << 30)).alias("dst")).withColumn("dst", F.col("dst").cast("long"))


def union_edge_tables(parts: dict[str, DataFrame]) -> DataFrame:
    """Edge tables of several relations as one, the relation as a column."""
    out: DataFrame | None = None
    for relation, df in parts.items():
        own = df.select("src", "dst", F.lit(relation).alias("relation"))
        out = own if out is None else out.unionByName(own)
    return out


def by_clauses(df: DataFrame, clauses: dict[str, str]) -> dict[str, DataFrame]:
    """One DataFrame for each split, by its SQL condition."""
    return {name: df.where(c) for name, c in clauses.items()}


def export_embeddings(df: DataFrame, uri: str, key: str = "node_id", value: str = "emb", rows_per_file: int = 1_000_000) -> None:
    """(node_id, emb array<float>) as Parquet."""
    write(df.select(F.col(key).alias("node_id"), F.col(value).cast("array<float>").alias("emb")), uri, rows_per_file=rows_per_file)


def export_predictions(df: DataFrame, uri: str, key: str = "node_id", value: str = "pred", rows_per_file: int = 1_000_000) -> None:
    write(df.select(F.col(key).alias("node_id"), F.col(value).cast("int").alias("pred")), uri, rows_per_file=rows_per_file)


def post_process(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for s in steps:
        df = df.transform(s)
    return df
