"""Best-fit packing of tokenised documents into sequences of fixed length.

Method: bounded-space online best-fit. Pieces arrive in a fixed order; each goes to the open bin with the least free space
that holds it, found in a bitset keyed by free space; when a new bin is needed and the fixed number of bins is open, the
fullest closes.

Scale: texts are encoded where they are read and never shuffled; only pieces' lengths are, in groups of bounded size that
are packed independently, so memory is a fixed number of bins and the work divides over any number of tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cached, cut, only, shuffle_partitions, slices
from .pretokens import encode_parts, split_batch

SEQUENCE = 2048
OPEN_BINS = 1024
GROUP = 8192
END = 0
#: Most pre-tokens whose ids a Python worker keeps.
CACHE = 100_000
_ids: dict[str, bytes] = {}
cached(__name__, _ids.clear)


def encode_batch(texts: pa.Array, path: str) -> list[bytes]:
    """The ids of each whole text, little-endian unsigned 32-bit. Each distinct pre-token of the texts is encoded once, all that aren't
    kept from earlier ones together."""
    rows, parts, keys = split_batch(texts)
    own = list(map(_ids.get, keys))
    new = [i for i, ids in enumerate(own) if ids is None]
    flat, lengths = encode_parts([keys[i] for i in new], path)
    raw, ends = flat.tobytes(), (4 * np.cumsum(lengths)).tolist()
    for i, a, b in zip(new, [0, *ends], ends, strict=False):
        own[i] = raw[a:b]
    for i in new[: max(0, CACHE - len(_ids))]:  # those met first are the frequent ones
        _ids[keys[i]] = own[i]
    lengths = np.fromiter(map(len, own), np.int64, len(own)) >> 2
    flat = np.frombuffer(b"".join(own), np.uint32)
    starts = np.cumsum(lengths) - lengths
    per_part = lengths[parts]
    ends = np.cumsum(per_part)
    total = int(ends[-1]) if len(ends) else 0
    out = flat[np.repeat(starts[parts] - (ends - per_part), per_part) + np.arange(total)]
    per_row = np.bincount(rows, weights=per_part, minlength=len(texts)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(per_row)])
    return [out[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def pieces(tokenizer: str, sequence: int, end: int):
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, "text", most_bytes=1 << 20):
                out: dict[str, list] = {x: [] for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_batch(batch.column("text"), tokenizer), strict=True):
                    ids += last
                    n = len(ids) >> 2
                    edges = [0, *range((n - 1) % sequence + 1, n + 1, sequence)]
                    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        out["doc_id"].append(doc_id)
                        out["piece"].append(i)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(ids[4 * a : 4 * b]))
                yield out

    return run


class Bins:
    """Open bins by free space: a bitset of the free spaces that occur, and the bins of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> tuple[int, int]:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number, used = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, used, free = self.made, 0, self.capacity
            self.made += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append((number, used + length))
            self.open += 1
        return number, used


def _place(sequence: int, open_bins: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by group and arrival; each group has its own bins, and numbers of its own."""
        group, bins = None, None
        for batch in batches:
            out = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            number, place = [], []
            for g, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, bins = g, Bins(sequence, open_bins)
                b, at = bins.put(length)
                number.append((g << 32) + b)
                place.append(at)
            yield out | {"sequence_id": number, "offset": place}

    return run


def best_fit_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, end: int = END, group: int = GROUP) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), each placed in a sequence of at most ``sequence`` tokens.

    A document is the ids of its whole text (null: empty) and ``end``. Only longer ones are cut, into full pieces; the first may
    be shorter. Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed as often as they
    come, null ids keep their rows, an empty table gives no rows."""
    spark = docs.sparkSession
    made = cut(arrow_map(only(docs, "doc_id", "text"), pieces(tokenizer, sequence, end), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    groups = max(1, -(-made.count() // group))
    # the place among the written pieces tells repeated rows apart, so that they too divide over the groups
    arrival = F.xxhash64("doc_id", "ids_crc32", "length", "piece", F.monotonically_increasing_id())
    dealt = made.withColumn("arrival", arrival).withColumn("grp", F.pmod(F.col("arrival"), F.lit(groups)))
    dealt = dealt.repartition(min(groups, shuffle_partitions(spark)) if groups > 1 else 1, "grp").sortWithinPartitions("grp", "arrival", "doc_id", "piece", "ids_crc32")
    return arrow_map(dealt, _place(sequence, open_bins), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
