"""Exact top-k search by inner product, with pivot-table elimination.

A table of the distances of every vector to many pivots is worked out once and stands beside the vectors as a column. For a query q and a
candidate x the triangle inequality gives, over all pivots, the greatest lower bound of their distance, and with the known norms an upper
bound of their inner product: (|q|^2 + |x|^2 - bound^2) / 2. Candidates lie in blocks, and there in tiles, of vectors near the same pivot;
a tile's bound comes from the range of its members' distances to each pivot. Each query evaluates tiles in the order of their bounds, until
its k-th best score beats every bound that is left; so the result is exact.

Scale: blocks have a bounded number of rows, one task each. Every query first searches the block it lies in; the k-th score found there
is its threshold elsewhere, and blocks whose bound stays below it aren't visited. Per query and block only k + 1 rows leave. Nothing is
broadcast but the pivots, whose number is fixed, and the blocks' ranges while they are few."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_partitions, staged, temporary

PIVOTS = 64
#: Rows from whose vectors the pivots are picked.
PIVOT_SAMPLE = 4096
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 512, 1 << 16, 32
#: Queries that search a block together; candidates of a tile.
CHUNK, TILE = 256, 128
#: Blocks whose ranges are broadcast, to skip those that hold nothing for a query; of more blocks none is skipped.
MOST_RANGES = 20_000
_NO_ID = np.iinfo(np.int64).max
#: Components up to this are integers of 64 bits whose products are exact; larger ones are Python's.
_SMALL = 2.0**24
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Below every score of such components.
_NOTHING = -(1 << 62)


def quantise(vectors: list, scale: float = 64.0) -> list[np.ndarray | None]:
    """floor(scale * x) of each component: 64-bit integers, or Python's where one is large; None for null vectors and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        a = None if v is None or None in v else np.asarray(v, np.float64)
        if a is None or not np.isfinite(a).all():
            out.append(None)
        elif (np.abs(a) * scale < _SMALL).all():
            out.append(np.floor(a * scale).astype(np.int64))
        else:
            out.append(np.array([math.floor(x * scale) if abs(x) < 2.0**50 else int(x) * int(scale) for x in a.tolist()], object))
    return out


def _pack(v: np.ndarray) -> bytes:
    """Integers as 16, 64 or any number of bits."""
    if v.dtype == object:
        return b"\2" + ",".join(map(str, v)).encode()
    small = not len(v) or int(np.abs(v).max()) < 1 << 15
    return b"\0" + v.astype(np.int16).tobytes() if small else b"\1" + v.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if raw[0] == 2:
        return np.array([int(x) for x in raw[1:].decode().split(",")], object)
    return np.frombuffer(raw, np.int16 if raw[0] == 0 else np.int64, offset=1).astype(np.int64)


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    m = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        m[i, : len(x)] = x
    return m


def _exact(m: np.ndarray, most: int, width: int) -> np.ndarray:
    """As floats, if sums of products stay exact in them."""
    whole = most * most * max(width, 1)
    return m.astype(np.float32) if whole < 1 << 24 else m.astype(np.float64) if whole < 1 << 53 else m


def pick_pivots(sample: list[np.ndarray], n: int = PIVOTS) -> list[np.ndarray]:
    """The origin's farthest vector, then each time the one farthest from all picked so far."""
    sample = [x for x in sample if x.dtype != object]
    if not sample:
        return []
    m = _matrix(sample, max(map(len, sample))).astype(np.float64)
    far = (m * m).sum(axis=1)
    picked = []
    for _ in range(min(n, len(sample))):
        i = int(far.argmax())
        picked.append(sample[i])
        far = np.minimum(far, ((m - m[i]) ** 2).sum(axis=1))
    return picked


def distances(rows: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Distances of the rows to the origin and to each pivot; of rows with large components, none (they lie anywhere)."""
    width = max([1, *map(len, rows), *map(len, pivots)])
    m, p = (_matrix([x if x.dtype != object else np.zeros(0, np.int64) for x in each], width).astype(np.float64) for each in (rows, pivots))
    mm = (m * m).sum(axis=1)
    out = np.sqrt(np.maximum(np.concatenate([mm[:, None], mm[:, None] + (p * p).sum(axis=1) - 2 * m @ p.T], axis=1), 0))
    return out.astype(np.float32)


def _table(pivots: list[np.ndarray], scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = quantise(batch.column("embedding").to_pylist(), scale)
            keep = [i for i, x in enumerate(own) if x is not None]
            rows = [own[i] for i in keep]
            d = distances(rows, pivots)
            large = np.fromiter((x.dtype == object for x in rows), bool, len(rows))
            near = np.where(large, -1, d[:, 1:].argmin(axis=1) if len(pivots) else 0)
            yield {"vec_id": batch.column("vec_id").take(pa.array(keep, pa.int64())), "v": [_pack(x) for x in rows], "d": [x.tobytes() for x in d], "near": near.astype(np.int32)}

    return run


def _upper(qq: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each query and each set of vectors whose distances lie between ``low`` and ``high``, an upper bound of the inner products."""
    gap = np.zeros((len(dq), len(low)), np.float32)
    for j in range(dq.shape[1]):
        np.maximum(gap, np.maximum(low[:, j] - dq[:, j, None], dq[:, j, None] - high[:, j]), out=gap)
    # |x|^2 is at most the square of the greatest distance to the origin; where x is nearer to it, so is the bound lower. Rounding never makes it too low
    top = np.square(high[:, 0], dtype=np.float64)
    return (qq[:, None] + top - np.square(gap, dtype=np.float64)) / 2 * (1 + 1e-6) + 1e-4 * (qq[:, None] + top) + 1


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores, ties to smaller ids."""
    if scores.shape[1] > 4 * k:  # all that reach the k-th score, then sort
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        most = max(k, int((scores >= kth).sum(axis=1).max()))
        keep = np.argpartition(-scores, min(most, scores.shape[1]) - 1, axis=1)[:, :most]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Block:
    """Candidates of one block, in tiles by their distances to the pivots, and its exact search."""

    def __init__(self, ids: list[int], rows: list[np.ndarray], d: np.ndarray):
        order = np.lexsort((d[:, 1:].min(axis=1), d[:, 1:].argmin(axis=1))) if d.shape[1] > 1 else np.argsort(d[:, 0], kind="stable")
        self.ids, self.rows = np.array(ids, np.int64)[order], [rows[i] for i in order]
        d = d[order]
        self.width = max([1, *map(len, rows)])
        self.m = _matrix(self.rows, self.width)
        self.most = int(np.abs(self.m).max(initial=0))
        starts = np.arange(0, len(rows), TILE)
        self.low, self.high = np.minimum.reduceat(d, starts, axis=0), np.maximum.reduceat(d, starts, axis=0)
        self.evaluated = 0

    def search(self, rows: list[np.ndarray], dq: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best candidates (scores, ids; the least integer where there are fewer) of every query with ``floor`` at least."""
        width = max([self.width, *map(len, rows)])
        q = _matrix(rows, width)
        c = self.m if width == self.width else np.pad(self.m, ((0, 0), (0, width - self.width)))
        most = max(self.most, int(np.abs(q).max(initial=0)))
        q, c = _exact(q, most, width), _exact(c, most, width)
        qq = np.square(dq[:, 0], dtype=np.float64)
        upper = _upper(qq, dq, self.low, self.high)
        order = np.argsort(-upper, axis=1, kind="stable")
        scores, names = np.full((len(rows), k), float(_NOTHING)), np.full((len(rows), k), _NO_ID)
        if c.dtype.kind == "i":
            scores = scores.astype(np.int64)
        start, step, tiles = 0, 1, upper.shape[1]
        while start < tiles:  # each query's next best tiles, twice as many each time
            least = np.maximum(scores[:, -1], floor)
            want: dict[int, list[int]] = {}
            for i, tile in zip(*np.nonzero(np.take_along_axis(upper, order[:, start : start + step], 1) >= least[:, None]), strict=True):
                want.setdefault(int(order[i, start + tile]), []).append(int(i))
            if not want:
                break
            for tile, each in want.items():
                own = np.array(each)
                if start:  # meanwhile others may have been better
                    own = own[upper[own, tile] >= np.maximum(scores[own, -1], floor[own])]
                at = slice(tile * TILE, (tile + 1) * TILE)
                new = q[own] @ c[at].T
                self.evaluated += new.size
                better = new.max(axis=1) >= scores[own, -1]
                own, new = own[better], new[better]
                if not len(own):
                    continue
                found = _top(np.concatenate([scores[own], new.astype(scores.dtype)], axis=1), np.concatenate([names[own], np.broadcast_to(self.ids[at], new.shape)], axis=1), k)
                scores[own], names[own] = found
            start, step = start + step, 2 * step
        return scores, names


def _plain(rows: list[np.ndarray], ids: list[int], query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, in Python's integers: for vectors with large components."""
    q = [int(x) for x in query]
    scored = sorted((-sum(a * int(b) for a, b in zip(q, x, strict=False)), i) for i, x in zip(ids, rows, strict=True))
    return [(-s, i) for s, i in scored[:k]]


def _search(k: int, seen: Callable[[int, int], None] | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by block, its candidates before its queries. Scores are text: exact, however large."""
        block, ids, rows, d, built = None, [], [], [], None
        waiting: list[tuple] = []

        def answer():
            nonlocal built
            if not waiting or not rows:
                waiting.clear()
                return
            plain = [i for i, x in enumerate(rows) if x.dtype == object]
            if built is None and len(plain) < len(rows):
                kept = [i for i, x in enumerate(rows) if x.dtype != object]
                built = Block([ids[i] for i in kept], [rows[i] for i in kept], np.stack([d[i] for i in kept]))
            out: dict[str, list] = {x: [] for x in ("query_id", "query_key", "own", "vec_id", "score")}

            def put(query: tuple, score: int, name: int):
                out["query_id"].append(query[0])
                out["query_key"].append(query[1])
                out["own"].append(str(sum(int(x) ** 2 for x in query[2]) if query[2].dtype == object else int(query[2] @ query[2])))
                out["vec_id"].append(None if name == _NO_ID else name)
                out["score"].append(str(score))

            fast = [x for x in waiting if x[2].dtype != object]
            if built is not None and fast:
                scores, names = built.search([x[2] for x in fast], np.stack([x[3] for x in fast]), np.array([x[4] for x in fast]), k + 1)
                for query, own, name in zip(fast, scores.tolist(), names.tolist(), strict=True):
                    for s, i in zip(own, name, strict=True):
                        if s > _NOTHING and s >= query[4]:  # what is below the threshold isn't among its best anywhere
                            put(query, int(s), i)
            for query in waiting:
                odd = query[2].dtype == object
                if odd or plain:
                    which = range(len(rows)) if odd else plain
                    for s, i in _plain([rows[j] for j in which], [ids[j] for j in which], query[2], k + 1):
                        put(query, s, i)
            if seen and built is not None:
                seen(built.evaluated, len(fast) * len(built.ids))
            waiting.clear()
            yield out

        for batch in batches:
            for b, is_query, vec_id, key, v, dist, least in zip(*(batch.column(x).to_pylist() for x in ("block", "is_query", "vec_id", "query_key", "v", "d", "least")), strict=True):
                if b != block:
                    yield from answer()
                    block, ids, rows, d, built = b, [], [], [], None
                own = np.frombuffer(dist, np.float32)
                if not is_query:
                    ids.append(_NO_ID if vec_id is None else vec_id)
                    rows.append(_unpack(v))
                    d.append(own)
                    continue
                waiting.append((vec_id, key, _unpack(v), own, -math.inf if least is None else least))
                if len(waiting) >= CHUNK:
                    yield from answer()
        yield from answer()

    return run


def _deal(counts: dict[int, int], pivots: list[np.ndarray]) -> dict[int, tuple[int, int]]:
    """Of each pivot the first block of the vectors nearest to it and the number of its blocks; small neighbours share one. -1: large vectors."""
    target = min(MOST_BLOCK, max(LEAST_BLOCK, -(-sum(counts.values()) // BLOCKS)))
    left = [x for x in counts if x >= 0]
    chain: list[int] = []
    if left:
        width = max(map(len, pivots), default=1)
        m = _matrix(pivots, width).astype(np.float64) if pivots else np.zeros((1, 1))
        chain = [left.pop(0)]
        while left:  # next to the one before it, roughly
            chain.append(left.pop(int(((m[left] - m[chain[-1]]) ** 2).sum(axis=1).argmin())))
    out: dict[int, tuple[int, int]] = {}
    block, filled = 0, 0
    for p in [*chain, *([-1] if -1 in counts else [])]:
        if filled and (filled + counts[p] > target or p == -1):
            block, filled = block + 1, 0
        splits = -(-counts[p] // target)
        out[p] = (block, splits)
        filled += counts[p]
        if splits > 1:
            block, filled = block + splits, 0
    return out


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("d").to_pylist(), strict=True):
            x = np.frombuffer(raw, np.float32)
            low[b], high[b] = np.minimum(low.get(b, x), x), np.maximum(high.get(b, x), x)
    yield {"block": list(low), "low": [x.tobytes() for x in low.values()], "high": [x.tobytes() for x in high.values()]}


def _visits(blocks: list[int], low: np.ndarray | None, high: np.ndarray | None, odd: set[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Queries with a threshold, once for every other block that may hold something for them."""
        number = np.array(blocks)
        always = np.array([b in odd for b in blocks], bool)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                dq = np.stack([np.frombuffer(x, np.float32) for x in batch.column("d").to_pylist()])
                least = np.array([-math.inf if x is None else x for x in batch.column("least").to_pylist()])
                may = np.ones((len(dq), len(number)), bool)
                if low is not None:
                    may = (_upper(np.square(dq[:, 0], dtype=np.float64), dq, low, high) >= least[:, None]) | always
                may |= np.array([x[0] == 2 for x in batch.column("v").to_pylist()])[:, None]  # large ones are not bounded
                may &= number != np.asarray(batch.column("block"))[:, None]
                which, at = np.nonzero(may)
                take = pa.array(which)
                yield {"block": number[at]} | {x: batch.column(x).take(take) for x in ("is_query", "vec_id", "query_key", "v", "d", "least")}

    return run


_DEALT = "block long, is_query boolean, vec_id long, query_key long, v binary, d binary, least double"
_FOUND = "query_id long, query_key long, own string, vec_id long, score string"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """For each query (rows of ``vectors`` whose vec_id is divisible by ``every``) its k best other rows by the inner product of the
    integers floor(scale * x): query_id, rank, vec_id, score; ties to the smaller vec_id, a null one last.

    Vectors that are null or hold null or non-finite components take no part; any finite one does (a score beyond 64 bits is ranked
    exactly and given as the nearest 64-bit integer). Shorter vectors count as filled with zeros; rows that repeat a query's id and vector
    are one query and each a candidate, but for the query itself; extra columns are ignored; no rows give no rows."""
    spark = vectors.sparkSession
    n_parts = shuffle_partitions(spark)
    with temporary(spark) as keep:
        whole = vectors.select("vec_id", "embedding")
        drawn = whole.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(PIVOT_SAMPLE).select("embedding").collect()
        picked = pick_pivots([x for x in quantise([r["embedding"] for r in drawn], scale) if x is not None], pivots)
        table = staged(arrow_map(whole, _table(picked, scale), "vec_id long, v binary, d binary, near int"), "top_k")
        counts = {x["near"]: x["n"] for x in table.groupBy("near").agg(F.count("*").alias("n")).collect()}
        dealt = _deal(counts, picked)
        first, splits = (F.coalesce(F.element_at(F.create_map(*(F.lit(y) for p, x in dealt.items() for y in (p, x[i]))), F.col("near")), F.lit(0)) if dealt else F.lit(0) for i in (0, 1))
        hashed = F.xxhash64("v", "vec_id")
        placed = table.withColumn("block", (first + F.pmod(hashed, F.greatest(splits, F.lit(1)))).cast("long"))
        nothing = F.lit(None).cast("double").alias("least")
        candidates = placed.select("block", F.lit(False).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("query_key"), "v", "d", nothing)
        queries = placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
        queries = queries.select("block", F.lit(True).alias("is_query"), "vec_id", hashed.alias("query_key"), "v", "d", nothing)
        met = lambda own: candidates.unionByName(own).repartition(n_parts, "block").sortWithinPartitions("block", "is_query")
        home = staged(arrow_map(met(queries), _search(k), _FOUND), "top_k")

        # the (k + 1)-th score at home, which may count the query itself, is the least that matters elsewhere
        by_score = F.sort_array(F.collect_list(F.col("score").cast("double")), asc=False)
        least = home.groupBy("query_id", "query_key").agg(by_score.alias("s")).where(F.size("s") > k)
        kth = F.element_at("s", k + 1)
        least = least.select(F.col("query_id").alias("_id"), F.col("query_key").alias("_key"), (kth - F.abs(kth) * 1e-12).alias("_least"))
        sure = queries.join(least, (F.col("vec_id") == F.col("_id")) & (F.col("query_key") == F.col("_key")), "left").withColumn("least", F.col("_least")).drop("_id", "_key", "_least")
        blocks = sorted({b + i for b, m in dealt.values() for i in range(m)})
        low = high = None
        if blocks and len(blocks) <= MOST_RANGES:
            found = arrow_map(placed.select("block", "d"), _ranges, "block long, low binary, high binary").collect()
            edge = {b: [np.frombuffer(x[w], np.float32) for w in ("low", "high") for x in found if x["block"] == b] for b in blocks}
            blocks = [b for b in blocks if edge[b]]
            low = np.stack([np.min(edge[b], axis=0) for b in blocks])
            high = np.stack([np.max(edge[b], axis=0) for b in blocks])
        odd = {b + i for p, (b, m) in dealt.items() if p == -1 for i in range(m)}
        away = arrow_map(sure, _visits(blocks, low, high, odd), _DEALT)
        rest = staged(arrow_map(met(away), _search(k), _FOUND), "top_k")
        keep(home, rest)
    return ranked(home.unionByName(rest), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from what its blocks found, without the query itself; ties to the smaller vec_id, a null one last."""
    # scores are ordered by sign, length and digits
    digits = F.translate("score", "-", "")
    negative = F.col("score").startswith("-")
    sized = F.when(negative, -F.length(digits)).otherwise(F.length(digits))
    order = [F.desc("sized"), F.desc("score_"), F.asc_nulls_last("vec_id")]
    turned = F.when(negative, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    best = Window.partitionBy("query_id", "query_key").orderBy(*order)
    placed = found.withColumns({"sized": sized, "score_": turned}).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    # the query itself, where it is among its best, goes: one row of its id and of its own score
    mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))
    placed = placed.withColumn("self", F.min(mine).over(Window.partitionBy("query_id", "query_key")))
    rank = (F.col("place") - F.when(F.col("self") < F.col("place"), 1).otherwise(0)).cast("int")
    kept = placed.where(~F.col("place").eqNullSafe(F.col("self"))).withColumn("rank", rank).where(F.col("rank") <= k)
    clamped = F.coalesce(F.expr("try_cast(score AS bigint)"), F.when(F.col("score").startswith("-"), F.lit(_LEAST)).otherwise(F.lit(_MOST)))
    return kept.select("query_id", "rank", "vec_id", clamped.alias("score"))
