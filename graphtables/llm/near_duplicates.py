"""Near-duplicate documents by a chosen-path set similarity join.

Each document is its set of word shingles, and a sketch of SKETCH minwise tokens of it. Documents of equal sets form one class. In
each of TREES independent trees classes branch, level by level, by the tokens that a node selects: one coordinate of the sketch, or
two in a quarter of the nodes, so that a pair of the threshold's similarity meets in about one child per level. Nodes that are small
are compared exhaustively by sketch. The members of a large node are compared with its pivot, the member that the most large nodes hold:
those like it make the pivot's crowd and leave the trees, the others branch on. Distances of sketches obey the triangle inequality, so
members about as far from the pivot as a link may reach beyond the crowd's edge do both, and no linked pair is parted. What is still
large after DEPTH levels is crowd as well. Candidate pairs are confirmed on the full sets, each class's best first, then all that would
still join two components; links make components. A crowd of one component is done; in the others each member outside the largest
component is compared with those of other components, in blocks, confirmed on full sets where they meet.

Scale: texts and sets of only those documents travel that have a candidate; trees travel as pairs of 64-bit numbers; components come
from label propagation with pointer jumping. Nothing is collected on the driver but row counts. Copies count once, whatever their
number, and large groups of near copies cost a star and their stragglers, not all their pairs."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common
from .common import BROADCAST_IDS, arrow_map, mix64, only, shuffle_partitions, slices, staged

SKETCH = 128
TREES = 12
FIRST_LEVELS, DEPTH = 3, 7
#: Members of a node that is compared exhaustively; side of a block of larger ones.
SMALL, BLOCK = 32, 512
#: Bytes of full sets in one side of a pair of blocks, about.
BLOCK_BYTES = 8 << 20
#: Agreement with the pivot from which a member of a large node is of its crowd; how far below that edge a linked one may lie, or above.
CROWD, REACH = 0.5, 0.25
#: Agreement of sketches below the threshold by so much is no candidate (over four standard errors).
SLACK = 0.15

#: Pivots whose sketches may be broadcast; beyond, an exchange.
BROADCAST_PIVOTS = 30_000

_GAMMA = np.uint64(0x9E3779B97F4A7C15)
_A = (mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * _GAMMA) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. Its size is known from its files; a checkpoint's estimate is the product of
    all joins before it, a number that outgrows the driver's memory after some rounds."""
    return staged(df, "near_duplicates")


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    return common.counted(df, "near_duplicates")


class _Words(dict):
    """Hashes of words; those met first, which are the frequent ones, are kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


_words = _Words()
common.cached(__name__, _words.clear)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words (A-Z lower-cased); of fewer words the whole sequence; of none, none."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: just A-Z, just ASCII white space
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(h) - words + 1)
    key = np.full(n, min(len(h), words), np.uint64)
    for i in range(min(words, len(h))):
        key = mix64(key + _GAMMA) * np.uint64(0x100000001B3) + h[i : i + n]
    return np.unique(mix64(key))


def sketch(found: np.ndarray) -> np.ndarray:
    """Minwise tokens: of each of SKETCH hash functions the low half of the least value."""
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 2048):
        x, y = low[at : at + 2048], high[at : at + 2048]
        v = x * _A[:, None] + (y ^ _B[:, None])
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(axis=1), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, cid, own = [], [], []
                for text in batch.column("text").to_pylist():
                    found = shingle_set(text, words)
                    n.append(len(found))
                    cid.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))) if len(found) else None)
                    own.append(sketch(found).tobytes() if len(found) else None)
                yield {"doc_id": batch.column("doc_id"), "n_shingles": n, "cid": cid, "sketch": own}

    return run


def _full_sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, "text"):
                cid, own = [], []
                for want, text in zip(batch.column("cid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    raw = shingle_set(text, words).tobytes()
                    if int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)) == want:  # rows may share an id
                        cid.append(want)
                        own.append(raw)
                yield {"cid": cid, "full": own}

    return run


def _children(index: np.ndarray, node: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: member and node of every child."""
    r = mix64(node ^ np.uint64(0xA5A5A5A55A5A5A5A))
    first = (r & np.uint64(SKETCH - 1)).astype(np.int64)
    second = ((r >> np.uint64(8)) & np.uint64(SKETCH - 1)).astype(np.int64)
    two = ((r >> np.uint64(20)) & np.uint64(3)) == 0
    two &= first != second
    index, node, coordinate = np.concatenate([index, index[two]]), np.concatenate([node, node[two]]), np.concatenate([first, second[two]])
    token = sketches[index, coordinate].astype(np.uint64) | (coordinate.astype(np.uint64) << np.uint64(16))
    return index, mix64(mix64(node + _GAMMA) + token * np.uint64(0x9FB21C651E98DF25))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), SKETCH)


def _plant(trees: int, levels: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in slices(whole, None, most_rows=8192):
                own = _matrix(batch.column("sketch"))
                cid = batch.column("cid").to_numpy()
                n = batch.num_rows
                index = np.tile(np.arange(n), trees)
                node = np.repeat(mix64(np.arange(1, trees + 1, dtype=np.uint64) * _GAMMA), n)
                for _ in range(levels):
                    index, node = _children(index, node, own)
                yield {"node": node.astype(np.int64), "cid": cid[index]}

    return run


def _route(least: float, crowd: float, reach: float, last: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Members of large nodes with the pivot's sketch: (no node, member, pivot, agreement) of those near it, (child, member) of those that branch on."""
        for whole in batches:
            for batch in slices(whole, None, most_rows=8192):
                own, cid = _matrix(batch.column("sketch")), batch.column("cid").to_numpy()
                agree = (own == _matrix(batch.column("other"))).sum(axis=1).astype(np.int32)
                near = np.arange(len(cid)) if last else np.flatnonzero(agree >= min(crowd, least) * SKETCH)
                yield {"node": pa.nulls(len(near), pa.int64()), "cid": cid[near], "pivot": batch.column("pivot").to_numpy()[near], "agree": agree[near]}
                if last:
                    continue
                on = np.flatnonzero(agree < (crowd + reach) * SKETCH)
                index, node = _children(on, batch.column("node").to_numpy()[on].astype(np.uint64), own)
                yield {"node": node.astype(np.int64), "cid": cid[index], "pivot": cid[index], "agree": np.zeros(len(index), np.int32)}

    return run


def _compare(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by node; pairs of different components in a node whose sketches agree enough."""
        node, members = None, []

        def pairs():
            n = len(members)
            if n < 2:
                return
            cid = np.array([x[0] for x in members], np.int64)
            comp = np.array([x[1] for x in members], np.int64)
            own = np.frombuffer(b"".join(x[2] for x in members), np.uint16).reshape(n, SKETCH)
            for i in range(n - 1):
                agree = (own[i + 1 :] == own[i]).sum(axis=1)
                hit = np.flatnonzero((agree >= least * SKETCH) & (comp[i + 1 :] != comp[i]) & (cid[i + 1 :] != cid[i])) + i + 1
                if len(hit):
                    out[0].append(np.minimum(cid[i], cid[hit]))
                    out[1].append(np.maximum(cid[i], cid[hit]))
                    out[2].append(agree[hit - i - 1])

        def flush():
            if out[0]:
                a, b, agree = map(np.concatenate, out)
                _, first = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)
                yield {"a": a[first], "b": b[first], "agree": agree[first].astype(np.int32)}
                for x in out:
                    x.clear()

        out: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for v, c, p, s in zip(*(batch.column(x).to_pylist() for x in ("node", "cid", "comp", "sketch")), strict=True):
                if v != node:
                    pairs()
                    node = v
                    members.clear()
                members.append((c, p, s))
            if len(out[0]) > 20_000:
                yield from flush()
        pairs()
        yield from flush()

    return run


def _settle(least: float, numerator: int, denominator: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by node: links, confirmed on full sets, of stragglers and others that join components within each node."""
        node, members = None, []

        def links():
            n = len(members)
            own = np.frombuffer(b"".join(x[3] for x in members), np.uint16).reshape(n, SKETCH)
            full = [np.frombuffer(x[4], np.uint64) for x in members]
            size = np.array([len(x) for x in full])
            _, comp = np.unique([x[2] for x in members], return_inverse=True)  # joined components take one number
            a, b = [], []
            for i in [i for i, x in enumerate(members) if x[0]]:
                alike = np.flatnonzero((comp != comp[i]) & (denominator * np.minimum(size, size[i]) >= numerator * np.maximum(size, size[i])))
                agree = (own[alike] == own[i]).sum(axis=1)
                near = agree >= least * SKETCH
                for j in alike[near][np.argsort(-agree[near], kind="stable")].tolist():
                    if comp[i] == comp[j]:
                        continue
                    both = len(np.intersect1d(full[i], full[j], assume_unique=True))
                    if denominator * both >= numerator * (size[i] + size[j] - both):
                        a.append(members[i][1])
                        b.append(members[j][1])
                        comp[comp == comp[j]] = comp[i]
            return {"a": a, "b": b}

        for whole in batches:
            for batch in slices(whole, "full"):
                for v, *x in zip(*(batch.column(c).to_pylist() for c in ("node", "straggler", "cid", "comp", "sketch", "full")), strict=True):
                    if v != node:
                        if len(members) > 1:
                            yield links()
                        node = v
                        members.clear()
                    members.append(x)
        if len(members) > 1:
            yield links()

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for whole in batches:
            for batch in (y for x in slices(whole, "full", most_bytes=4 << 20) for y in slices(x, "other", most_bytes=4 << 20)):
                keep = []
                for i, (own, other) in enumerate(zip(batch.column("full"), batch.column("other"), strict=True)):
                    p, q = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if denominator * both >= numerator * (len(p) + len(q) - both):
                        keep.append(i)
                yield {x: batch.column(x).take(pa.array(keep, pa.int64())) for x in ("a", "b")}

    return run


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every end of ``links`` (a, b): the least number reachable. Labels pass along links, then each takes its label's label."""
    ends = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("cid"), F.least("u", "v").alias("comp")))
    while True:
        near = ends.join(labels.withColumnRenamed("cid", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        near = cut(labels.join(near.withColumnRenamed("u", "cid"), "cid").select("cid", F.least("comp", "near").alias("comp"), F.col("comp").alias("old")))
        up = near.select(F.col("cid").alias("comp"), F.col("comp").alias("up"))
        changed = Observation()
        jumped = near.join(up, "comp").select("cid", F.least("comp", "up").alias("comp"), "old")
        labels = cut(jumped.observe(changed, F.count_if(F.col("comp") != F.col("old")).alias("n")).select("cid", "comp"))
        if changed.get["n"] == 0:
            return labels


class _Join:
    """State of one run: the classes, and their components so far."""

    def __init__(self, docs: DataFrame, words: int, threshold: tuple[int, int], trees: int):
        self.docs, self.words, self.threshold, self.trees = docs, words, threshold, trees
        self.n = shuffle_partitions(docs.sparkSession)
        self.least = threshold[0] / threshold[1] - SLACK
        self.rows = cut(arrow_map(docs, _sets(words), "doc_id long, n_shingles long, cid long, sketch binary"))
        self.classes = cut(self.rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")))
        self.labels: DataFrame | None = None

    def labelled(self, df: DataFrame, column: str = "cid", out: str = "comp") -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(column))
        known = self.labels.select(F.col("cid").alias("_cid"), F.col("comp").alias("_comp"))
        return df.join(known, F.col(column) == F.col("_cid"), "left").withColumn(out, F.coalesce("_comp", column)).drop("_cid", "_comp")

    def crossing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components, with these (ca, cb)."""
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb")

    def link(self, found: DataFrame) -> None:
        """Join components by confirmed pairs: only components that are met move."""
        if self.labels is None:
            self.labels = components(found)
            return
        moved = components(self.crossing(found).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        to = moved.select(F.col("cid").alias("comp"), F.col("comp").alias("to"))
        old = self.labels.join(to, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp"))
        self.labels = cut(old.unionByName(moved.join(self.labels.select("cid"), "cid", "left_anti")))

    def compared(self, members: DataFrame) -> DataFrame:
        """Candidate pairs of nodes (node, cid, comp)."""
        full = members.join(self.classes.select("cid", "sketch"), "cid").select("node", "cid", "comp", "sketch")
        return arrow_map(full.repartition(self.n, "node").sortWithinPartitions("node"), _compare(self.least), "a long, b long, agree int")

    def routed(self, large: DataFrame, last: bool) -> DataFrame:
        """Members of large nodes (node, cid) against their pivots, as ``_route`` gives them."""
        held = large.join(large.groupBy("cid").agg(F.count("*").alias("nodes")), "cid")
        pivots, n = counted(held.groupBy("node").agg(F.max(F.struct("nodes", "cid")).alias("x")).select("node", F.col("x.cid").alias("pivot")))
        sketches = self.classes.select(F.col("cid").alias("pivot"), F.col("sketch").alias("other"))
        sketches = sketches.join(F.broadcast(pivots.select("pivot").distinct()) if n <= BROADCAST_PIVOTS else pivots.select("pivot").distinct(), "pivot", "left_semi")
        rows = large.join(F.broadcast(pivots) if n <= BROADCAST_IDS else pivots, "node").join(self.classes.select("cid", "sketch"), "cid")
        met = rows.join(F.broadcast(sketches) if n <= BROADCAST_PIVOTS else sketches, "pivot").select("node", "cid", "pivot", "sketch", "other")
        return cut(arrow_map(met, _route(self.least, CROWD, REACH, last), "node long, cid long, pivot long, agree int").distinct())

    def confirm(self, candidates: DataFrame) -> None:
        """Confirm candidates on full sets: first each class's best, then all that would still join two components."""
        pairs, n = counted(candidates.groupBy("a", "b").agg(F.max("agree").alias("agree")))
        if not n:
            return
        ends = pairs.withColumn("end", F.explode(F.array("a", "b")))
        best = cut(ends.groupBy("end").agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b").distinct())
        self.link(self.full(best))
        left, n = counted(self.crossing(pairs.join(best, ["a", "b"], "left_anti")).select("a", "b"))
        if n:
            self.link(self.full(left))

    def sets(self, need: DataFrame) -> DataFrame:
        """(cid, full): the full sets of the wanted classes, made from the text of one document each."""
        need, n = counted(need.join(self.classes.select("cid", "first"), "cid").select("cid", F.col("first").alias("_doc_id")))
        right = F.broadcast(need) if n <= BROADCAST_IDS else need
        texts = self.docs.join(right, F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("cid", "text")
        return cut(arrow_map(texts, _full_sets(self.words), "cid long, full binary").dropDuplicates(["cid"]))

    def full(self, pairs: DataFrame) -> DataFrame:
        """Those pairs whose full sets are alike enough."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
        half = pairs.join(sets.withColumnRenamed("cid", "a"), "a")
        both = half.join(sets.select(F.col("cid").alias("b"), F.col("full").alias("other")), "b")
        return cut(arrow_map(both, _confirm(*self.threshold), "a long, b long"))

    def run(self) -> None:
        frontier, candidates, crowds = arrow_map(self.classes, _plant(self.trees, FIRST_LEVELS), "node long, cid long"), [], []
        for level in range(FIRST_LEVELS, DEPTH + 1):
            sizes = cut(frontier.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
            members, n = counted(frontier.join(sizes, "node"))
            if not n:
                break
            candidates.append(self.compared(members.where(F.col("n") <= SMALL).withColumn("comp", F.col("cid"))))
            routed = self.routed(members.where(F.col("n") > SMALL).select("node", "cid"), level == DEPTH)
            near = routed.where("node IS NULL")
            star = near.where((F.col("pivot") != F.col("cid")) & (F.col("agree") >= F.lit(self.least * SKETCH)))
            candidates.append(star.select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b"), "agree"))
            crowds.append(near.where(F.lit(level == DEPTH) | (F.col("agree") >= F.lit(CROWD * SKETCH))).select("pivot", "cid"))
            frontier = routed.where("node IS NOT NULL").select("node", "cid")
        if candidates:
            self.confirm(functools.reduce(DataFrame.unionByName, candidates))
            self.exhaust(functools.reduce(DataFrame.unionByName, crowds).distinct())

    def exhaust(self, crowds: DataFrame) -> None:
        """Crowds (pivot, cid) of several components: their stragglers, outside the crowd's largest component, against all its members, by
        pairs of blocks, confirmed on full sets where they meet."""
        own = cut(self.labelled(crowds).join(self.classes.select("cid", "n_shingles"), "cid"))
        parts = own.groupBy("pivot", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
        whole = parts.groupBy("pivot").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.sum("held").alias("held"), F.max(F.struct("n", "comp", "held")).alias("largest"))
        mixed = whole.where(F.col("n") > F.col("most.n")).select("pivot", F.col("most.comp").alias("main"), "n", "held", (F.col("n") - F.col("most.n")).alias("s"), (F.col("held") - F.col("largest.held")).alias("s_held"))
        blocks = lambda n, held: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(held) * 8 / BLOCK_BYTES)).cast("long")
        mixed, n = counted(mixed.select("pivot", "main", blocks("n", "held").alias("across"), blocks("s", "s_held").alias("down")))
        if not n:
            return
        members = cut(own.join(F.broadcast(mixed) if n <= BROADCAST_IDS else mixed, "pivot").drop("n_shingles"))
        places = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
        down = members.where("comp <> main").withColumns({"straggler": F.lit(True), "i": F.pmod(F.xxhash64("cid"), "down"), "j": F.explode(places("across"))})
        across = members.withColumns({"straggler": F.lit(False), "j": F.pmod(F.xxhash64("cid"), "across"), "i": F.explode(places("down"))})
        dealt = down.unionByName(across).select(F.xxhash64("pivot", "i", "j").alias("node"), "straggler", "cid", "comp")
        dealt = dealt.join(self.classes.select("cid", "sketch"), "cid").join(self.sets(members.select("cid").distinct()), "cid")
        self.link(cut(arrow_map(dealt.repartition(self.n, "node").sortWithinPartitions("node"), _settle(self.least, *self.threshold), "a long, b long").distinct()))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), trees: int = TREES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id (the least doc_id reachable over links), kept (it is that document).

    Documents are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``threshold`` at least; with fewer words
    the whole sequence is one shingle. Null, empty and blank texts are linked with nothing. Repeated rows are copies; a null id never
    names a component unless all its members have none. An empty table gives no rows."""
    with common.temporary(docs.sparkSession) as keep:
        join = _Join(only(docs, "doc_id", "text"), words, threshold, trees)
        join.run()
        named = cut(join.labelled(join.classes.select("cid", "first")))
        leaders = cut(named.groupBy("comp").agg(F.min("first").alias("component_id")))
        by_class = cut(named.join(leaders, "comp").select(F.col("cid").alias("_cid"), "component_id"))
        keep(join.rows, by_class)
    met = join.rows.select("doc_id", "n_shingles", "cid", F.coalesce("cid", F.xxhash64("doc_id")).alias("_key")).join(by_class, F.col("_key") == F.col("_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = met.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), trees: int = TREES) -> DataFrame:
    """The rows of ``docs`` less all but one document (the least doc_id) of each group of near duplicates; all columns stay.

    Of rows that are equal in id and text one stays. Rows without an id can't be told apart and all stay."""
    with common.temporary(docs.sparkSession) as keep:
        judged = cut(near_duplicates(docs, words, threshold, trees))
        gone, n = counted(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone_id")).distinct())
        repeated = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
        keep(gone)
    if n <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    if repeated:
        known, unknown = left.where("doc_id IS NOT NULL"), left.where("doc_id IS NULL")
        left = known.dropDuplicates(["doc_id", "text"]).unionByName(unknown)
    return left
