"""Tables that a plan reads more than once, kept in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bytes of the files read (compressed: some 300,000 order lines, or a million rows of two ids) whose rows one task of a shuffle gets.
BYTES_A_TASK = 4 << 20
#: Folders of this process's tables, by session, removed when the process ends.
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset and all run in one process (tests) a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphtables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, a file as often as it is read; inputs of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def shuffle_tasks(df: DataFrame) -> int:
    """Tasks among which a shuffle of the plan's rows is dealt: as many as the input needs, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // BYTES_A_TASK))


def dealt(df: DataFrame, *by: str, tasks: int | None = None, always: bool = False) -> DataFrame:
    """``df`` dealt by columns among as many tasks as its input needs, so that a task's share doesn't grow with the input; where one task
    a core is enough, unchanged, or with ``always`` dealt as Spark sees fit. What groups, joins or ranks by these columns afterwards needs no
    other shuffle."""
    n = tasks or shuffle_tasks(df)
    if n > df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(n, *by)
    return df.repartition(*by) if always else df


def dealt_alike(a: DataFrame, b: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, dealt by its keys among as many tasks as the greater needs."""
    n = max(shuffle_tasks(a), shuffle_tasks(b))
    return dealt(a, *by, tasks=n), dealt(b, *by, tasks=n)


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read back, in folders by the values of a column if ``by`` names one.

    It is computed once, its lineage ends there, and it survives lost executors; its size is known from its files, so plans over
    it, in loops too, get honest estimates."""
    if getattr(df, "_is_table", False) and not by:
        return df
    spark = df.sparkSession
    folder = new_folder(spark)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(f"{folder}/{name}")
    table = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    table._is_table = True  # is not written again
    return table


def new_folder(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir that goes when the process ends."""
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder


def add_rows(df: DataFrame, folder: str, **part: int) -> DataFrame:
    """All rows of a folder's table after those of ``df`` were written to it as a part, which a column names: one table, however many parts."""
    ((column, value),) = part.items()
    df.write.parquet(f"{folder}/{column}={value}")
    return df.sparkSession.read.schema(StructType([*df.schema, StructField(column, IntegerType())])).parquet(folder)


def remove_tables() -> None:
    """Remove all tables that this process has materialized; DataFrames over them can't be read afterwards."""
    while _made:
        spark, folder = _made.pop()
        local = folder.removeprefix("file://") if folder.startswith("file:///") else folder
        if local.startswith("/") and os.path.isdir(local):  # also where the session has ended
            shutil.rmtree(local, ignore_errors=True)
            continue
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


atexit.register(remove_tables)
