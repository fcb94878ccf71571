"""What the operators of this subpackage share: Arrow batches in and out, hashing, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of (id, small value) that may be broadcast; beyond, an exchange.
BROADCAST_IDS = 300_000

#: Words of every operator here: what is left between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table ``table`` of ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; only where it is unset and all run in one process (tests) use a local folder."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphtables-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: computed once, lineage cut, safe from lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``staged``, and the number of rows, observed while they are written."""
    seen = Observation()
    return staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder of the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/stages/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _open():
        _open()[-1].append((path, table))
    return table


_scopes = threading.local()


def _open() -> list[list[tuple[str, DataFrame]]]:
    return _scopes.__dict__.setdefault("stack", [])


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables that are staged inside are removed at the end, but for those given to the function that this yields."""
    made: list[tuple[str, DataFrame]] = []
    kept: list[DataFrame] = []
    _open().append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _open().pop()
        for path, table in made:
            if any(table is x for x in kept):
                if _open():  # for the scope around this one
                    _open()[-1].append((path, table))
                continue
            folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: What modules keep in a Python worker from task to task, by module.
_caches: dict[str, Callable[[], None]] = {}
_turn: list[str] = [""]
#: Fixed value: M_MMAP_THRESHOLD of the C library.
_MMAP_THRESHOLD = -3


def cached(module: str, clear: Callable[[], None]) -> None:
    """Register how to empty a module's cache: it is emptied when the worker turns to another module's functions."""
    _caches[module] = clear


def _turn_to(module: str) -> None:
    if _turn[0] == module:
        return
    if not _turn[0]:  # a new worker: large buffers go back to the system as soon as they are free
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).mallopt(_MMAP_THRESHOLD, 1 << 20)
    _turn[0] = module
    for name, clear in _caches.items():
        if name != module:
            clear()
    release()


def release() -> None:
    """Give unused memory back, so that what one task needed isn't held beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, one small task a core: a heap that grew for one stage goes back to the system, so that
    it isn't held beside the next one's Python workers. What is in use stays; an executor that gets no task keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the record batches that Spark hands to Python, at most; a smaller setting of the session stays.
BATCH_BYTES = 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Bound the batches in the session, so that neither the JVM nor Python holds tens of megabytes of texts for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def arrow_map(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` for a function that yields dicts of columns (arrays or lists) instead of record batches."""
    _bound_batches(df.sparkSession)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names
    module = function.__module__

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _turn_to(module)
        arrow = to_arrow_schema(kind)
        for columns in function(batches):
            arrays = []
            for field in arrow:
                value = columns[field.name]
                arrays.append(value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, field.type))
            del columns
            if arrays and len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        release()

    return df.mapInArrow(run, kind)


def widened(df: DataFrame, ddl: str) -> tuple[DataFrame, StructType]:
    """``df`` without columns of the new ones' names (whatever their case), and its schema with the new ones."""
    new = StructType.fromDDL(ddl)
    taken = {x.lower() for x in new.names}
    kept = df.select(*[F.col(f"`{x}`") for x in df.columns if x.lower() not in taken])
    return kept, StructType([*kept.schema.fields, *new.fields])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, size: str | None, most_rows: int = 2048, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of bounded rows and bytes (a longer single row stands alone), so memory doesn't follow the batch."""
    n = batch.num_rows
    if not n:
        return
    if size is None:
        for i in range(0, n, most_rows):
            yield batch.slice(i, most_rows)
        return
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(size)), 0), dtype=np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + most_bytes, side="right"))
        stop = min(max(stop, start + 1), start + most_rows, n)
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64), for whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that extra columns, whatever their names, neither travel nor clash."""
    return df.select(*[F.col(f"`{x}`") for x in names])


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
