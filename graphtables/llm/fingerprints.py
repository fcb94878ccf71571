"""Document fingerprints: threshold-scaled sketches.

Of all hashes of a text's character shingles the sketch keeps those below a fixed fraction of the hash range. Sketches of any two
texts are samples by the same rule, so they merge by union and estimate both similarity and containment, also between texts of very
unequal length. A sketch's size follows its text; nothing is kept per corpus.

Texts travel once at most (for the edited texts, which need the next document); the sketches are made in one map."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, only, shuffle_partitions, slices, texts_of, widened

SHINGLE = 12
#: One hash of so many is kept.
SCALE = 16
_B = np.uint64(0x9E3779B97F4A7C15)


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE code points, by doubling: 2, 4, 8, then 8 + 4."""
    with np.errstate(over="ignore"):
        b2 = _B * _B
        b4 = b2 * b2
        two = codes[:-1] * _B + codes[1:]
        four = two[:-2] * b2 + two[2:]
        eight = four[:-4] * b4 + four[4:]
        return mix64(eight[:-4] * b4 + four[8:])


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted sketch of each text: 32-bit hashes, all below 2^32 / SCALE. A text shorter than a shingle is one shingle; the empty text has none."""
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    lengths = np.fromiter(map(len, points), np.int64, len(points))
    codes = np.concatenate([*points, np.zeros(SHINGLE, np.uint32)]).astype(np.uint64) + np.uint64(1)
    hashed = (_shingles(codes) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    low = np.flatnonzero(hashed < np.uint32((1 << 32) // SCALE))
    a = np.searchsorted(low, starts)
    b = np.searchsorted(low, np.maximum(ends - SHINGLE + 1, starts))
    out = []
    for i, text in enumerate(texts):
        if lengths[i] < SHINGLE:
            one = xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))
            out.append(np.array([one] if text and one < (1 << 32) // SCALE else [], np.uint32))
        else:
            out.append(np.unique(hashed[low[a[i] : b[i]]]))
    return out


def encode(sketch: np.ndarray, text: str) -> str:
    """The fingerprint as text: a digest of the text, then the sketch."""
    return f"{xxhash.xxh64_hexdigest(text.encode('utf-8', 'surrogatepass'))}:{base64.b64encode(sketch.astype('<u4').tobytes()).decode()}"


def decode(fingerprint: str) -> tuple[str, np.ndarray]:
    digest, _, body = fingerprint.partition(":")
    return digest, np.frombuffer(base64.b64decode(body), "<u4")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    """Estimated Jaccard similarity; where neither sketch holds anything, 1 for equal texts, else 0."""
    if same:
        return 1.0
    both = _common(a, b)
    return both / max(1, len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 0 where ``a``'s sketch is empty."""
    return _common(a, b) / max(1, len(a))


def merge(*each: np.ndarray) -> np.ndarray:
    """The sketch of the texts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *each]))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (null: empty). Equal texts have equal fingerprints; one map, no shuffle.

    Repeated rows each keep theirs; an empty table stays empty; other columns stay, one of the name ``out`` is replaced."""
    docs, schema = widened(docs, f"`{out}` string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, text, most_bytes=2 << 20):
                texts = texts_of(batch, text)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                yield columns | {out: [encode(s, x) for s, x in zip(sketches(texts), texts, strict=True)]}

    return arrow_map(docs, run, schema)


#: Documents of one run of neighbours, and most cuts between ids; more documents make longer runs, which are streamed.
RUN, MOST_CUTS = 512, 1 << 15
#: A run of one id (or none) is cut by its texts' hashes from so many documents on.
HEAVY = 4 * RUN
#: Documents of one task, about.
TASK = 1 << 14
#: The seed of Spark's xxhash64.
_SEED = 42


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=_SEED)
    return h - (1 << 64) if h >> 63 else h


def _runs(ids: pa.Array, edges: np.ndarray) -> np.ndarray:
    """The run of each id; null: -1."""
    known = ~np.asarray(ids.is_null())
    return np.where(known, np.searchsorted(edges, np.asarray(ids.fill_null(0), dtype=np.int64), side="right"), -1).astype(np.int64)


def _part(hashed: int, parts: int) -> int:
    """Which of ``parts`` equal ranges a 64-bit hash is in, the greatest hashes in the last."""
    return ((hashed + (1 << 63)) * parts) >> 64


def neighbours(docs: DataFrame) -> DataFrame:
    """(place, halo, doc_id, hash, text): every row in a run of neighbours, and as halo of the run before it, each run's first rows.

    Documents follow one another by descending id (null ids: last), those of one id by descending hash of their texts, then by these;
    after the last comes the first. Runs are cut at quantiles of the ids, those of a single id that many documents share (or of none) by
    ranges of the hash; texts travel in one exchange, dealt evenly by the runs' places."""
    spark = docs.sparkSession
    ids = only(docs, "doc_id")
    n = ids.count()
    runs = min(MOST_CUTS, max(1, n // RUN))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [(i + 1) / runs for i in range(runs - 1)], 20 * runs)).first()[0] or [])) if runs > 1 else []
    edges = np.array(cuts, np.int64)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"run": _runs(batch.column("doc_id"), edges), "doc_id": batch.column("doc_id")}

    held = arrow_map(ids, number, "run long, doc_id long").groupBy("run").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("top")).collect()
    heavy = {x["run"]: -(-x["n"] // RUN) for x in held if x["least"] == x["top"] and x["n"] >= HEAVY}
    # the first rows of each part: its greatest id, or of a run cut by hashes its greatest hash
    first: dict[tuple[int, int], int | None] = {(x["run"], 0): x["top"] for x in held if x["run"] not in heavy}

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        most: dict[tuple[int, int], int] = {}
        for batch in batches:
            run = _runs(batch.column("doc_id"), edges)
            for r, h in zip(run.tolist(), batch.column("hash").to_pylist(), strict=True):
                if r in heavy:
                    key = r, _part(h, heavy[r])
                    most[key] = max(most.get(key, h), h)
        yield {"run": [r for r, _ in most], "part": [p for _, p in most], "hash": list(most.values())}

    hashed = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    if heavy:
        for x in arrow_map(hashed, hashes, "run long, part long, hash long").groupBy("run", "part").agg(F.max("hash").alias("hash")).collect():
            first[x["run"], x["part"]] = x["hash"]
    order = sorted(first, reverse=True)  # as documents follow one another
    place = {key: i for i, key in enumerate(order)}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, "text"):
                run, own = _runs(batch.column("doc_id"), edges).tolist(), batch.column("hash").to_pylist()
                keys = [(r, _part(h, heavy[r]) if r in heavy else 0) for r, h in zip(run, own, strict=True)]
                begins = [i for i, (k, h, x) in enumerate(zip(keys, own, batch.column("doc_id").to_pylist(), strict=True)) if first[k] == (h if k[0] in heavy else x)]
                for which, halo in ((np.arange(len(keys)), False), (np.array(begins, np.int64), True)):
                    if len(which):
                        at = [(place[keys[i]] - halo) % len(order) for i in which]
                        yield {"place": at, "halo": np.full(len(which), halo)} | {x: batch.column(x).take(pa.array(which)) for x in ("doc_id", "hash", "text")}

    with_hash = only(docs, "doc_id", "text").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = arrow_map(with_hash, deal, "place long, halo boolean, doc_id long, hash long, text string")
    tasks = max(shuffle_partitions(spark), -(-n // TASK))
    even = dealt.repartitionById(tasks, (F.col("place") % tasks).cast("int"))
    return even.sortWithinPartitions("place", "halo", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").asc_nulls_first())


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows come sorted; a row is done when the next of its run, or the first of the run's halo, is there."""
    held: tuple | None = None  # run, doc_id, text, its sketch
    closed = None  # the run that has met its halo
    for whole in batches:
        for batch in slices(whole, "text", most_rows=1024, most_bytes=2 << 20):
            texts = texts_of(batch)
            own = sketches(texts)
            done = []
            for run, halo, doc_id, text, sketch in zip(batch.column("place").to_pylist(), batch.column("halo").to_pylist(), batch.column("doc_id").to_pylist(), texts, own, strict=True):
                if halo and closed == run:
                    continue
                if held is not None:
                    k = len(held[2]) // 2
                    done.append((held[1], held[2], held[3], held[2][: len(held[2]) - k] + text[:k], text, sketch))
                held = None if halo else (run, doc_id, text, sketch)
                closed = run if halo else None
            if done:
                edited = [x[3] for x in done]
                news = sketches(edited)
                yield {
                    "doc_id": [x[0] for x in done],
                    "n_chars": [len(x[1]) for x in done],
                    "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
                    "fingerprint": [encode(x[2], x[1]) for x in done],
                    "edited_fingerprint": [encode(s, x) for s, x in zip(news, edited, strict=True)],
                    "near_edited": [likeness(x[2], s, x[1] == x[3]) for s, x in zip(news, done, strict=True)],
                    "near_next": [likeness(x[2], x[5], x[1] == x[4]) for x in done],
                }


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text (its last half from the next document), and how near they are.

    The next document follows by descending id, null ids last, rows of one id by a hash of their texts; after the last comes the first (a
    lone row follows itself). Null texts count as empty, repeated rows each keep their row, an empty table gives no rows, other columns are
    ignored, whatever their names. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(neighbours(docs), _edited, schema)
