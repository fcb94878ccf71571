"""Token counts of whole texts, without materialising ids.

Method: the distinct pre-tokens of the corpus, with the number of documents that hold each, are one table; pieces are counted there, once
per distinct pre-token. That table is joined to the documents' pre-token frequencies, and the products are summed per document.

Scale: a pre-token that is in very many documents would be a hot key of that join, so the table is joined in two parts. The most frequent
pre-tokens, a fixed number at most, are broadcast to where texts are read, and their share of each document's sum is made there. What is
left, rare by rank, meets the rest of the table in a shuffled join; only those (pre-token, document, count) rows travel, no text, no ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, only, slices, staged, temporary
from .pretokens import codec, split_batch

#: Most pre-tokens that are broadcast, and bytes of each.
HOT, HOT_BYTES = 1 << 18, 48
#: Distinct pre-tokens that a task sums up before it passes them on.
HELD = 400_000


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of each (pre-token, row) of the texts that occurs: the pre-token's number, the row, how often; and the pre-tokens."""
    rows, parts, keys = split_batch(texts)
    pairs, counts = np.unique(parts.astype(np.int64) << 20 | rows, return_counts=True)
    return pairs >> 20, pairs & 0xFFFFF, counts, keys


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(whole, "text", most_rows=20_000, most_bytes=4 << 20)


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    held: dict[str, int] = {}
    for whole in batches:
        for batch in _slices(whole):
            part, _, _, keys = _pairs(batch.column("text"))
            for key, n in zip(keys, np.bincount(part, minlength=len(keys)).tolist(), strict=True):
                held[key] = held.get(key, 0) + n
            if len(held) > HELD:
                yield {"part": list(held), "n": list(held.values())}
                held.clear()
    yield {"part": list(held), "n": list(held.values())}


def _encode(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        encode = codec(path)
        for whole in batches:
            for batch in slices(whole, "part"):
                yield {"part": batch.column("part"), "n": batch.column("n"), "pieces": [len(encode(x)) for x in batch.column("part").to_pylist()]}

    return run


def piece_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(part, n, pieces): each distinct pre-token of ``docs`` once, in how many documents it is, and its pieces."""
    parts = arrow_map(only(docs, "text"), _distinct, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return arrow_map(parts, _encode(tokenizer), "part string, n long, pieces long")


def hot_pieces(table: DataFrame, most: int) -> dict[str, int]:
    """The pieces of the most frequent pre-tokens, ``most`` at most: those of the highest classes of a histogram of how many documents hold
    them, four classes to each doubling."""
    level = F.floor(4 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
    short = table.where(F.octet_length("part") <= HOT_BYTES).withColumn("level", level)
    histogram = {x["level"]: x["rows"] for x in short.groupBy("level").agg(F.count("*").alias("rows")).collect()}
    least, total = max(histogram, default=0) + 1, 0
    while least > 0 and total + histogram.get(least - 1, 0) <= most:
        least -= 1
        total += histogram.get(least, 0)
    rows = short.where(F.col("level") >= least).select("part", "pieces").toArrow()
    return dict(zip(rows.column("part").to_pylist(), rows.column("pieces").to_pylist(), strict=True))


def _frequencies(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """A row of each document with the sum over its hot pre-tokens, and one of each of its other pre-tokens with its count."""
        hot, number = shared.value, TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in _slices(whole):
                part, row, counts, keys = _pairs(batch.column("text"))
                known = np.fromiter((hot.get(x, -1) for x in keys), np.int64, len(keys))[part]
                n, rare = batch.num_rows, np.flatnonzero(known < 0)
                total = np.bincount(row, weights=np.maximum(known, 0) * counts, minlength=n).astype(np.int64)
                place = number + np.arange(n)
                number += n
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield {"row": place, "doc_id": batch.column("doc_id"), "n_bytes": size, "n": total, "part": pa.nulls(n, pa.string())}
                if len(rare):
                    nothing = pa.nulls(len(rare), pa.int64())
                    yield {"row": place[row[rare]], "doc_id": nothing, "n_bytes": nothing, "n": counts[rare], "part": pa.array(keys, pa.string()).take(pa.array(part[rare]))}

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", hot: int = HOT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, as the library gives them for the whole text.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids each keep their row; other columns are ignored, whatever
    their names; an empty table gives no rows. ``hot`` is the bound of the pre-tokens that are broadcast; the result doesn't depend on it."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        table = staged(piece_table(docs, tokenizer), "token_counts")
        shared = spark.sparkContext.broadcast(hot_pieces(table, hot))
        found = staged(arrow_map(only(docs, "doc_id", "text"), _frequencies(shared), "row long, doc_id long, n_bytes long, n long, part string"), "token_counts")
        rare = found.where("part IS NOT NULL").select("row", F.col("n").alias("count"), "part").join(table.select("part", "pieces"), "part")
        sums = staged(rare.groupBy(F.col("row").alias("_row")).agg(F.sum(F.col("count") * F.col("pieces")).alias("more")), "token_counts")
        shared.unpersist()
        keep(found, sums)
    whole = found.where("part IS NULL").join(sums, F.col("row") == F.col("_row"), "left")
    return whole.select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
