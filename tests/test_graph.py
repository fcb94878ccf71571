"""Operators on small graphs with the cases that data seldom has, against golden values and brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphtables.functions import hashing, impute, vectors
from graphtables.operators import edges as E
from graphtables.operators import enumeration, partitioning, positional, ppr, sampling, splitting, statistics, subgraphs
from graphtables.plans import config
from graphtables.plans.graph import GraphTables, preprocess, split_all
from graphtables.sources import tables as S

# a wheel: 0 in its middle, tied both ways to the rim 1 to 8, of which 1 is tied to 2 and 3; apart from it 9 alone, 10 that only points at 11,
# and 12 that points at itself
RIM = range(1, 9)
PAIRS = [pair for i in RIM for pair in ((0, i), (i, 0))] + [pair for i in (2, 3) for pair in ((1, i), (i, 1))] + [(10, 11), (12, 12)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, i % 2, [float(i), 0.5]) for i in range(13)], "node_id long, node_type int, features array<float>")
    edges = spark.createDataFrame([(a, b, 0, [float(a + b)]) for a, b in PAIRS], "src long, dst long, edge_type int, features array<float>")
    return nodes, edges


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.collect())


def test_integer_mix_goldens(spark):
    # fixed values: what the mixer gives for 0 to 3
    rows = spark.range(4).select(hashing.integer_mix("id", 32).alias("a"), hashing.integer_mix("id").alias("b")).collect()
    assert [r.a for r in rows] == [1492470133, 1071609072, 81290992, 325464930]
    assert [r.b for r in rows] == [1622107259858988186, 3834912982681189024, 2886753494712499930, 5597559336455034305]


def test_composite_ids(spark):
    df = spark.createDataFrame([(3, 4_000_000_000), (0, 0)], "t int, i long").select(hashing.composite_id("t", "i").alias("c"), "t", "i")
    t, i = hashing.split_composite_id("c")
    assert [(r[0], r[1]) for r in df.select(t, i).collect()] == [(3, 4_000_000_000), (0, 0)]


def test_quantize_goldens(spark):
    df = spark.createDataFrame([([-1.0, 0.0, 1.0, 2.0, 4.0],)], "x array<double>")
    assert df.select(vectors.codes("x", 2, 0, 3)).first()[0] == [0, 0, 1, 2, 3]
    bits = spark.createDataFrame([(bytearray([170]), bytearray([168]))], "a binary, b binary")
    r = bits.select(vectors.dequantize(vectors.unpack("a", 1, 8), 1, -1.5, 2.5), vectors.dequantize(vectors.unpack("b", 1, 5), 1, -1.5, 2.5)).first()
    assert r[0] == [2.5, -1.5] * 4 and r[1] == [2.5, -1.5, 2.5, -1.5, 2.5]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9))
def test_pack_round_trip(spark, codes):
    df = spark.createDataFrame([(codes,)], "c array<int>").select(vectors.pack("c", 2).alias("p"))
    assert df.select(vectors.unpack("p", 2, len(codes))).first()[0] == codes and len(df.first()[0]) == -(-len(codes) // 4)


def test_relation_operators(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.5, 1.0, 2.0, 0.0], [[1.0, 0.0, 0.0, 1.0], [0.0, 2.0, 0.0, 0.0]])], "a array<double>, r array<double>, m array<array<double>>")
    a, r = np.array([1, 2, 3, 4.0]), np.array([0.5, 1, 2, 0])
    z = (a[:2] + 1j * a[2:]) * (r[:2] + 1j * r[2:])
    got = df.select(vectors.translate("a", "r"), vectors.diagonal("a", "r"), vectors.complex_diagonal("a", "r"), vectors.linear("a", "m"), vectors.l2_normalize("a")).first()
    for have, want in zip(got, (a + r, a * r, [*z.real, *z.imag], [5, 4], a / np.linalg.norm(a)), strict=True):
        assert np.allclose(have, want)


def test_impute_and_project(spark):
    df = spark.createDataFrame([(None, None, None, None)], "i int, f double, b boolean, s string")
    assert tuple(impute.impute(df).first()) == (0, 0.0, False, "MISSING")
    with pytest.raises(KeyError):
        impute.project(df, {"nope": "int"})
    assert df.select(impute.fill_features(F.lit(None).cast("array<float>"), 3)).first()[0] == [0, 0, 0]


def test_sets(graph):
    nodes, edges = graph
    assert ids(E.isolated(nodes, edges)) == [9] and ids(E.source_only(edges)) == [10] and ids(E.neighborless(nodes, edges)) == [9, 10]
    assert ids(E.neighborless(nodes, E.bidirect(edges), directed=False)) == [9]


def test_source_only_bag(spark):
    e = spark.createDataFrame([(1, 9), (1, 8), (2, 1)], "src long, dst long")
    assert ids(E.source_only(e)) == [2] and ids(E.source_only(e, bag=True)) == [1, 2]


def test_bidirect_conflicts_and_dangling(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 1, 3), (1, 2, 4), (7, 7, 1)], "src long, dst long, w int")
    assert sorted(map(tuple, E.bidirect(e).collect())) == [(1, 2, 3), (2, 1, 3), (7, 7, 1)]
    assert not E.has_dangling_edges(e) and E.has_dangling_edges(e.withColumn("dst", F.when(F.col("dst") != 7, F.col("dst"))))


def test_slotted_join_is_the_join(spark):
    r = random.Random(3)
    e = spark.createDataFrame([(r.randint(-4, 9), i) for i in range(40)], "k long, v long")
    o = spark.createDataFrame([(r.randint(-4, 9), i) for i in range(15)], "k long, w long")
    assert sorted(E.slotted_join(e, o, "k", 3).collect()) == sorted(e.join(o, "k").collect())


def test_enumeration(spark):
    towns = [("Ulm", 126), ("Bergen", 285), ("Poznań", 541), ("Aarhus", 285)]
    nodes = spark.createDataFrame(towns, "town string, size int").repartition(3)
    roads = [("Ulm", "Aarhus"), ("Bergen", "Poznań")]
    edges = spark.createDataFrame(roads, "a string, b string")
    number = {name: i for i, name in enumerate(sorted(x for x, _ in towns))}
    table, numbered, e = preprocess(nodes, "town", edges, "a", "b")
    assert {r.town: r.int_id for r in table.collect()} == number
    assert sorted(map(tuple, e.collect())) == sorted((number[a], number[b]) for a, b in roads) and sorted(map(tuple, numbered.collect())) == sorted((number[x], n) for x, n in towns)
    back = enumeration.unenumerate(numbered.withColumnRenamed("int_id", "node_id"), table, "town")
    assert sorted(map(tuple, back.collect())) == sorted(towns)
    with pytest.raises(ValueError):
        preprocess(nodes.unionByName(nodes), "town", edges, "a", "b")
    with pytest.raises(ValueError):
        preprocess(nodes, "town", edges.withColumn("b", F.lit("Atlantis")), "a", "b")


def test_sampling_is_bounded_and_reproducible(graph):
    _, edges = graph
    one = sampling.one_hop(edges, 3)
    by = defaultdict(set)
    for r in one.collect():
        by[r.root].add(r.hop1)
    near = defaultdict(set)
    for a, b in PAIRS:
        near[b].add(a)
    assert all(len(by[n]) == min(3, len(near[n])) and by[n] <= near[n] for n in near) and set(by) == set(near)
    assert sorted(one.collect()) == sorted(sampling.one_hop(edges.repartition(5), 3).collect())


def test_weighted_sampling_follows_weights(spark):
    rows = spark.range(400).select((F.col("id")).alias("g"), F.explode(F.array([F.struct(F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in ((1, 8.0), (2, 1.0), (3, 1.0), (4, 0.0))])).alias("x")).select("g", "x.o", "x.w")
    n = {r.o: r["count"] for r in sampling.weighted_rows(rows, ["g"], "o", "w", 1, "s").groupBy("o").count().collect()}
    assert sum(n.values()) == 400 and n[1] > 280 and 4 not in n


def test_with_replacement(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "k long, a array<long>")
    got = {r.k: r.sampled for r in sampling.with_replacement(df, "k", "a", 10, "s").collect()}
    assert len(got[1]) == 10 and set(got[1]) <= {1, 2, 3} and got[2] == [] and got[3] == []


def test_frontier_expands_new_nodes_only(graph):
    _, edges = graph
    seeds = edges.sparkSession.createDataFrame([(4,), (9,)], "node_id long")
    got = {(r.root, r.node_id): r.hop for r in sampling.k_hop_frontier(edges, seeds, [-1, -1, -1]).collect()}
    assert got == {(4, 4): 0, (9, 9): 0, (4, 0): 1} | {(4, i): 2 for i in (1, 2, 3, 5, 6, 7, 8)}
    assert len(sampling.k_hop_frontier(edges, seeds, [-1, 0, -1]).collect()) == 3


def test_plan_checks():
    a = sampling.SamplingOp("a", ("story", "seen_by", "user"), 2)
    b = sampling.SamplingOp("b", ("user", "sees", "story"), 2, ("a",))
    assert [o.name for o in sampling.check_plan([b, a], "user")] == ["a", "b"]
    for ops, root in (([a], "story"), ([b], "user"), ([sampling.SamplingOp("x", ("user", "r", "user"), 1, ("y",)), sampling.SamplingOp("y", ("user", "r", "user"), 1, ("x",))], "user"), ([a, a], "user"), ([a, sampling.SamplingOp("c", ("user", "r", "user"), 1, ("a",))], "user")):
        with pytest.raises(ValueError):
            sampling.check_plan(ops, root)


def test_subgraphs_and_samples(graph):
    nodes, edges = graph
    g = GraphTables(nodes, edges)
    sub = {r.root: r for r in g.inference_samples([10, 10]).collect()}
    assert set(sub) == set(range(13)) and sub[9].edges is None and [n.node_id for n in sub[9].nodes] == [9] and sub[9].root_node.node_id == 9
    assert {n.node_id for n in sub[4].nodes} == set(range(9)) and {(e.src, e.dst) for e in sub[4].edges} == {(0, 4)} | {(i, 0) for i in range(1, 9)}
    assert sub[12].edges[0].src == 12
    assert subgraphs.invalid_subgraphs(g.subgraphs([3, 3])).count() == 0 and subgraphs.validate(g.subgraphs([2])).count() == 12
    labels = nodes.select("node_id", F.col("node_type").alias("label"), F.lit("kind").alias("label_type")).where("node_id < 3")
    assert ids(g.classification_samples([2], labels), "root") == [0, 1, 2]
    assert subgraphs.local_index(g.subgraphs([2])).where("src < 0 OR dst < 0").count() == 0


def test_duplicate_edges_between_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    hops = sampling.k_hop(e, [5, 5])
    assert len(subgraphs.sampled_edges(hops).collect()) == 4
    loop = sampling.k_hop(spark.createDataFrame([(1, 1)], "src long, dst long"), [5, 5])
    assert len(subgraphs.sampled_edges(loop).collect()) == 2 and len(subgraphs.sampled_edges(loop, dedup=True).collect()) == 1


def test_link_samples_with_user_labels(graph):
    nodes, edges = graph
    spark = nodes.sparkSession
    kind = "src long, dst long, edge_type int, features array<float>"
    pos = spark.createDataFrame([(4, 9, 1, []), (10, 5, 1, [])], kind)
    neg = spark.createDataFrame([(4, 12, 2, [])], kind)
    got = {r.root: r for r in GraphTables(nodes, edges, directed=True).link_samples([10], 3, pos, neg).collect()}
    assert set(got) == {4, 10}
    assert {n.node_id for n in got[4].nodes} == {0, 4, 9, 12} and [(e.src, e.dst) for e in got[4].neg_edges] == [(4, 12)]
    assert got[10].neg_edges == [] and [(e.src, e.dst) for e in got[10].pos_edges] == [(10, 5)]


def test_splits_keep_supervision_out(graph):
    nodes, edges = graph
    samples = GraphTables(nodes, edges).link_samples([10], 10)
    key = lambda e: (min(e.src, e.dst), max(e.src, e.dst))
    parts = {s: df.collect() for s, df in split_all(samples).items()}
    sup = {s: {key(e) for r in rows for e in r.pos_edges} for s, rows in parts.items()}
    assert not sup["TRAIN"] & sup["VAL"] and not sup["TRAIN"] & sup["TEST"] and not sup["VAL"] & sup["TEST"]
    assert all(not {key(e) for e in r.edges} & (sup["VAL"] | sup["TEST"]) for r in parts["TRAIN"]) and all(r.pos_edges for r in parts["TRAIN"])
    assert all({n.node_id for n in r.nodes} == {x for e in [*r.edges, *r.pos_edges] for x in (e.src, e.dst)} | {r.root} for rows in parts.values() for r in rows)
    assert list(split_all(samples, skip_training=True)) == ["TEST"]
    anchored = [splitting.anchor_supervision_split(samples, s).collect() for s in splitting.RATIOS]
    assert all(not {key(e) for e in r.edges} & {key(e) for e in r.pos_edges} for rows in anchored for r in rows)
    n = [len(splitting.classification_split(samples, s).collect()) for s in splitting.RATIOS]
    assert sum(n) == samples.count()
    assert all({x.node_id for x in r.nodes} >= {e.src for e in r.edges} for r in splitting.classification_split(samples, "TRAIN", inductive=True).collect())


def test_anchor_split_goldens(spark):
    def split(values, val, test, **options):
        df = spark.createDataFrame([(v,) for v in values], "node_id long")
        out = defaultdict(set)
        for r in splitting.anchor_split(df, F.col("node_id"), val, test, **options).collect():
            out[r.split].add(r.node_id)
        return out

    a = split(range(10), 0.1, 0.1, normalization="legacy")
    assert a["TRAIN"] == set(range(8)) and a["VAL"] == {8} and a["TEST"] == {9}
    b = split([1, 2, 20, 5, 200], 0.2, 0.2, normalization="legacy")
    assert b["TRAIN"] == {1, 2, 5, 20} and b["TEST"] == {200} and not b["VAL"]
    assert split([7], 0.1, 0.1)["TRAIN"] == {7}


def test_edge_split_is_symmetric_and_near_its_ratios(spark):
    df = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") * 3 + 1).alias("b"))
    s, u = splitting.edge_split("a", "b", F.lit(0), disjoint=0.25)
    t, v = splitting.edge_split("b", "a", F.lit(0), disjoint=0.25)
    rows = df.select(s.alias("s"), u.alias("u"), ((s == t) & (u == v)).alias("same")).groupBy("s", "u", "same").count().collect()
    assert all(r.same for r in rows)
    n = {(r.s, r.u): r["count"] / 20_000 for r in rows}
    assert n["TRAIN", "SUPERVISION"] == pytest.approx(0.2, abs=0.02) and n["TRAIN", "MESSAGE"] == pytest.approx(0.6, abs=0.02) and n["TEST", "MESSAGE_AND_SUPERVISION"] == pytest.approx(0.1, abs=0.02)


def test_ppr_against_power_iteration(spark):
    r = random.Random(4)
    pairs = {(i, j) for i in range(14) for j in r.sample(range(14), 3) if i != j} | {(13, 0)}
    alpha, w = 0.5, np.zeros((14, 14))
    for a, b in pairs:
        w[a, b] = 1
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1)
    want = alpha * np.linalg.inv(np.eye(14) - (1 - alpha) * w)
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    seeds = spark.createDataFrame([(0,), (5,)], "node_id long")
    pushed = ppr.forward_push(e, seeds, alpha, 1e-4)
    for x in pushed.collect():
        assert abs(x.score - want[x.seed, x.node_id]) < 2e-3
    best = ppr.top_ppr(pushed, 4).collect()
    assert all(b.node_id == b.seed for b in best if b.rank == 1)
    s = ppr.sequences(ppr.top_ppr(pushed, 4), 6).collect()
    assert all(x.tokens[0] == x.seed and x.tokens[-1] == -1 and x.valid == [True] * 4 + [False] * 2 for x in s)


def test_positional(graph):
    _, edges = graph
    want = {}
    near = defaultdict(set)
    for a, b in PAIRS:
        near[a].add(b)
    for s in list(near):
        seen, front = {s: 0}, {s}
        for k in (1, 2, 3):
            front = {y for x in front for y in near[x]} - set(seen)
            seen |= dict.fromkeys(front, k)
        want |= {(s, x): k for x, k in seen.items() if k}
    assert {(r.src, r.dst): r.hops for r in positional.hop_distances(edges, 3).collect()} == want
    m = np.zeros((13, 13))
    for a, b in PAIRS:
        m[a, b] += 1
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
    for r in positional.random_walk(edges, 3).collect():
        q = np.linalg.matrix_power(p, r.step)
        assert r.se == pytest.approx(q[r.node_id, r.node_id]) and r.pe == pytest.approx(q[:, r.node_id].sum() - q[r.node_id, r.node_id])


def test_metrics(spark):
    df = spark.createDataFrame([(1, True, 0.5), (1, False, 0.9), (1, False, 0.5), (1, False, 0.1), (2, True, 0.3)], "query long, positive boolean, score double")
    a = {r.query: (r.hit_at_1, r.mrr) for r in statistics.ranking_metrics(df, (1,)).collect()}
    b = {r.query: r.mrr for r in statistics.ranking_metrics(df, (1,), "pessimistic").collect()}
    assert a == {1: (0.0, 0.5), 2: (1.0, 1.0)} and b[1] == pytest.approx(1 / 3)
    clip = statistics.pooled_clip(spark.createDataFrame([([2.0, 2.0],)], "f array<double>"), "f").first()
    assert clip.clip_max > clip.clip_min == 2.0


def test_partitioning():
    assert partitioning.range_book(10, 3) == [(0, 4), (4, 7), (7, 10)]
    assert [partitioning.contiguous_shard(10, i, 3) for i in range(3)] == [(0, 3), (3, 6), (6, 10)]
    assert partitioning.storage_slices(2, 4, 1) == {0: (0.5, 1.0)} and partitioning.storage_slices(3, 2, 0) == {0: (0, 1), 1: (0, 0.5)}
    assert partitioning.shard_files(["c", "a", "b"], 0, 2) == ["a", "b"]


def test_config(spark):
    assert config.parse_fanouts("[10, 5]") == [10, 5] and config.parse_fanouts("{('a', 'to', 'b'): [1, 2]}") == {("a", "to", "b"): [1, 2]}
    for bad in ("[]", "{('a', 'to', 'b'): [1], ('b', 'to', 'a'): [1, 2]}", "3", "[-2]", "[-1]", "{('a', 'to_positive_label', 'b'): [1]}"):
        with pytest.raises(ValueError):
            config.parse_fanouts(bad)
    meta = config.GraphMetadata(("user", "story"), (("user", "to", "story"),))
    df = spark.createDataFrame([("story",)], "t string")
    assert df.select(meta.node_code(F.col("t")), meta.node_type(meta.node_code(F.col("t")))).first() == (1, "story")
    with pytest.raises(ValueError):
        config.GraphMetadata(("user",), (("user", "to", "story"),))
    config.REGISTRY.register("limit")(lambda df, n: df.limit(n))
    assert config.REGISTRY.make("limit", n=0)(df).count() == 0


def test_sources(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"), F.lit(1.5).alias("x"))
    S.write(df, f"{tmp_path}/a", by=["g"])
    S.write(df, f"{tmp_path}/b", "json", files=2)
    assert S.read(spark, f"{tmp_path}/a").count() == 100 and S.read(spark, f"{tmp_path}/b", "json").count() == 100
    assert S.sharded(df, "k", 7).count() == 100 and sum(S.shard(df, "k", i, 7).count() for i in range(7)) == 100
    t = S.bucketed(df, 4, "k", "emb_20240101")
    assert t.count() == 100
    S.bucketed(df, 4, "k", "emb_20240103")
    assert S.tables_matching(spark, "emb_") == ["emb_20240101", "emb_20240103"] and S.latest_table(spark, "emb_", "20240102") == "emb_20240101"
    assert S.tables_by_pattern(spark, r"emb_(\d{8})")[0] == "emb_20240103"
    plan = t.join(spark.table("emb_20240103"), "k")._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan
    assert S.drop_matching(spark, "emb_") == ["emb_20240101", "emb_20240103"]
    assert S.table_path("p:d", "t") == "p.d.t"
    (tmp_path / "adj.txt").write_text("0 1 2\n1\n2 0\n")
    assert sorted(map(tuple, S.adjacency_text(spark, f"{tmp_path}/adj.txt").collect())) == [(0, 1), (0, 2), (2, 0)]
    S.export_embeddings(spark.createDataFrame([(1, [1.0, 2.0])], "node_id long, emb array<double>"), f"{tmp_path}/e")
    assert S.read(spark, f"{tmp_path}/e").dtypes == [("node_id", "bigint"), ("emb", "array<float>")]
    e = S.edge_table_with_features(spark.createDataFrame([(1, 2, None, 3)], "a long, b long, f double, g int"), "a", "b")
    assert e.first().features == [0.0, 3.0]


def test_preprocessor(spark, tmp_path):
    from graphtables.plans import jobs

    spark.createDataFrame([("Aarhus", 1.5, None), ("Bergen", None, 2)], "person string, height double, age int").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([("Aarhus", "Bergen", 3)], "a string, b string, w int").write.parquet(f"{tmp_path}/e")

    class Config(jobs.PreprocessorConfig):
        def node_specs(self):
            return {S.NodeReference(f"{tmp_path}/n", "person", "person"): jobs.Spec({"height": "float", "age": "int"})}

        def edge_specs(self):
            return {S.EdgeReference(f"{tmp_path}/e", ("person", "knows", "person"), "a", "b"): jobs.Spec({"w": "int"}, preprocess=lambda df: df.withColumn("w", F.col("w") * 2))}

    out = jobs.run(spark, Config())
    assert sorted(map(tuple, out.nodes["person"].collect())) == [(0, 1.5, 0), (1, 0.0, 2)]
    assert list(map(tuple, out.edges["person", "knows", "person", "main"].collect())) == [(0, 1, 6)]
    assert jobs.assets_exist(spark, f"{tmp_path}/n", f"{tmp_path}/zzz") == {f"{tmp_path}/n": True, f"{tmp_path}/zzz": False}
    S.check_references(list(Config().node_specs()), list(Config().edge_specs()), {"person"}, {("person", "knows", "person")})
    with pytest.raises(ValueError):
        S.check_references([], [], {"person"}, set())


def test_later_hops_draw_distinct_neighbors(spark):
    """A path through a hub gets n distinct neighbors of it, others for other paths, and the draws cover the hub's neighbors evenly."""
    hub = [(i, 0) for i in range(1, 41)] + [(0, 100 + i) for i in range(300)]
    paths = sampling.k_hop(spark.createDataFrame(hub, "src long, dst long"), [5, 4])[1].collect()
    by = defaultdict(list)
    for r in paths:
        by[r.root].append(r.hop2)
    assert len(by) == 300 and all(len(x) == len(set(x)) == 4 and set(x) <= set(range(1, 41)) for x in by.values())
    n = np.bincount([x for each in by.values() for x in each], minlength=41)[1:]
    assert n.sum() == 1200 and n.min() > 10 and n.max() < 55 and len({tuple(sorted(x)) for x in by.values()}) > 8


def test_drawn_places(spark):
    rows = spark.range(200).select("id", (F.col("id") % 13).alias("d")).select("id", "d", sampling.drawn_places(5, "d", "s", "id").alias("p"), sampling.drawn_places(F.lit(-1), "d", "s", "id").alias("all"))
    for r in rows.collect():
        assert len(set(r.p)) == len(r.p) == min(5, r.d) and all(0 <= x < r.d for x in r.p) and sorted(r["all"]) == list(range(r.d))


def test_typed_frontier_follows_types_and_no_labels(spark):
    kind = "src long, dst long, src_type string, relation string, dst_type string"
    e = spark.createDataFrame([(1, 1, "b", "to", "a"), (2, 1, "b", "to", "a"), (1, 1, "a", "likes", "b"), (7, 1, "a", "likes", "b"), (9, 1, "b", "x_positive_label", "a")], kind)
    seeds = spark.createDataFrame([(1, "a"), (5, "a")], "node_id long, node_type string")
    got = {(r.root, r.node_id, r.node_type, r.hop) for r in sampling.typed_frontier(e, seeds, {("b", "to", "a"): [-1, 0], ("a", "likes", "b"): [0, 5]}).collect()}
    assert got == {(1, 1, "a", 0), (5, 5, "a", 0), (1, 1, "b", 1), (1, 2, "b", 1), (1, 7, "a", 2)}
    for bad in ({("b", "x_positive_label", "a"): [1]}, {("b", "to", "a"): [1], ("a", "likes", "b"): [1, 2]}):
        with pytest.raises(ValueError):
            sampling.typed_frontier(e, seeds, bad)


def test_hydration_by_type(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0])], "node_id long, node_type int, features array<float>")
    ids = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 1, 0)], "root long, node_id long, node_type int")
    whole = subgraphs.hydrate_nodes(ids, nodes, keep=True).first().nodes
    assert [(n.node_id, n.node_type, n.features) for n in whole] == [(1, 0, [1.0]), (1, 1, [2.0]), (2, 1, None)]
    assert len(subgraphs.hydrate_nodes(ids, nodes).first().nodes) == 2
    edges = spark.createDataFrame([(1, 2, 0, [1.0]), (1, 2, 1, [2.0])], "src long, dst long, edge_type int, features array<float>")
    rows = spark.createDataFrame([(7, 1, 2, 1), (7, 3, 4, 1)], "root long, src long, dst long, edge_type int")
    assert [(e.src, e.edge_type, e.features) for e in subgraphs.hydrate_edges(rows, edges, keep=True).first().edges] == [(1, 1, [2.0]), (3, 1, None)]


def test_ego_nets_of_three_hops(graph):
    nodes, edges = graph
    got = {r.root: r for r in subgraphs.ego_nets(edges, 50, 3, nodes=nodes).collect()}
    near = defaultdict(set)
    for a, b in PAIRS:
        near[b].add(a)
    for root, r in got.items():
        hops = [{root}]
        for _ in range(3):
            hops.append({y for x in hops[-1] for y in near[x]})
        assert {(x.hop, x.node_id) for x in r.neighbors} == {(k, x) for k in (1, 2, 3) for x in hops[k]}
        assert {n.node_id for n in r.nodes} == set().union(*hops) and all(n.features[0] == n.node_id for n in r.nodes)
        assert {(e.src, e.dst) for e in r.edges} == {(a, b) for k in range(3) for b in hops[k] for a in near[b]} and r.root_node.node_id == root
    assert subgraphs.ego_nets(edges, 2, 1, post=lambda df: df.limit(1)).count() == 1


def test_label_seeds_and_remap(spark):
    labels = spark.createDataFrame([(4, 9), (4, 2), (4, 9), (4, 4), (5, 1), (6, 1)], "src long, dst long")
    seeds = sampling.anchor_and_label_seeds(spark.createDataFrame([(4,), (5,), (8,)], "node_id long"), labels)
    assert sorted((r.root, r.place, r.node_id) for r in seeds.collect()) == [(4, 0, 4), (4, 1, 2), (4, 2, 9), (5, 0, 5), (5, 1, 1), (8, 0, 8)]
    own = labels.where("src < 6 AND src <> dst").distinct()
    assert sorted(map(tuple, sampling.remap_labels(own, seeds).collect())) == [(4, 2, 1), (4, 9, 2), (5, 1, 1)]
    with pytest.raises(Exception, match="was not sampled"):
        sampling.remap_labels(labels.where("src <> dst"), seeds).collect()


def test_unfinished_push_is_an_error(spark):
    e = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node_id long")
    with pytest.raises(RuntimeError, match="isn't done"):
        ppr.forward_push(e, seeds, most_rounds=3)
    assert ppr.forward_push(e, seeds, most_rounds=3, unfinished="return").count() == 4


def test_channels_sequences_and_reach(spark):
    pushed = spark.createDataFrame([(0, i, 1.0 / i, 0.0, 1) for i in range(1, 7)], "seed long, node_id long, score double, residual double, hop int")
    types = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(1, 7)], "node_id long, node_type string")
    got = [(r.node_id, r.channel) for r in sorted(ppr.by_channel(pushed, types, {"a": 1, "b": 2}).collect(), key=lambda r: r["rank"])]
    assert got == [(1, "b"), (2, "a"), (3, "b")]
    line = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(0, 9)], "src long, dst long")
    reached = ppr.reachable(line, spark.createDataFrame([(0,)], "node_id long"), 2, 10).collect()
    assert {(r.node_id, r.hop) for r in reached} == {(0, 0), (1, 1), (9, 1), (2, 2)} and sorted(r["rank"] for r in reached) == [1, 2, 3, 4]
    assert {(r.src, r.dst) for r in ppr.induced_edges(spark.createDataFrame([(0, i) for i in (0, 1, 2)], "seed long, node_id long"), line).collect()} == {(0, 1), (1, 2)}


def test_thresholds_statistics_and_losses(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.95)], "node_id long, cosine double")
    assert statistics.assert_threshold(df, "cosine", 0.4, 1.0).count() == 2
    for low, high in ((0.9, None), (None, 0.6)):
        with pytest.raises(Exception, match="beyond its threshold"):
            statistics.assert_threshold(df, "cosine", low, high).collect()
    x = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5, 9, 2, 6)] + [(None,)], "x double").repartition(4)
    got = statistics.quantiles(x, "x", (0.0, 0.3, 0.5, 1.0)).first()
    assert [got[i] for i in range(4)] == pytest.approx(np.quantile([3, 1, 4, 1, 5, 9, 2, 6], (0.0, 0.3, 0.5, 1.0)))
    far = spark.createDataFrame([(-2000.0, 0.0), (2000.0, 0.0)], "positive_score double, negative_score double")
    assert statistics.bpr_loss(far).first().bpr == pytest.approx(1000)
    few = spark.createDataFrame([(i % 7,) for i in range(100)], "v int")
    sketch = statistics.count_min(few, "v", 4, 64)
    assert {r.v: r.estimate for r in statistics.count_min_estimate(sketch, few, "v", 4, 64).collect()} == {v: 100 // 7 + (v < 100 % 7) for v in range(7)}
    log_q = spark.createDataFrame([(5, 100), (100, 100)], "f long, t long").select(sampling.log_q("f", 4, "t").alias("q")).collect()
    assert [r.q for r in log_q] == pytest.approx([np.log(0.2), 0.0])


def test_self_supervised_takes_the_share(graph):
    _, edges = graph
    pairs = edges.select("src", "dst")
    few = {tuple(r) for r in sampling.self_supervised_positives(pairs, 0.5).collect()}
    assert len(few) == len(PAIRS) // 2 and few <= set(PAIRS) and few == {tuple(r) for r in sampling.self_supervised_positives(pairs.repartition(6), 0.5).collect()}


def test_in_batch_negatives_are_others(spark):
    rows = spark.createDataFrame([(i, i % 3, "r" if i < 40 else "s", i, 100 + i) for i in range(42)], "id long, batch long, relation string, src long, dst long")
    by = defaultdict(list)
    for r in sampling.negatives_in_batch(rows, 4).collect():
        by[r.id].append(r.dst - 100)
    assert all(len(set(by[i])) == 4 and all(j != i and j % 3 == i % 3 and j < 40 for j in by[i]) for i in range(40)) and 40 not in by
    sides = sampling.negatives_in_batch(rows, 4, corrupt="both").collect()
    assert {(r.src == r.id, r.dst == r.id + 100) for r in sides} == {(True, False), (False, True)}


def test_quantize_checks(spark):
    df = spark.createDataFrame([([1.0, float("nan")],)], "f array<double>")
    with pytest.raises(ValueError):
        vectors.codes("f", 3, 0, 1)
    with pytest.raises(Exception, match="not finite"):
        df.select(vectors.codes("f", 4, 0, 1)).collect()


def test_check_config():
    good = {"task": "link_prediction", "node_types": ["u", "v"], "edge_types": [("u", "to", "v")], "fanouts": {("u", "to", "v"): [2, 2]}, "split": {"TRAIN": 0.8, "VAL": 0.1, "TEST": 0.1}, "supervision_edge_types": [("u", "to", "v")], "paths": {"nodes": "a"}}
    assert config.check_config(good, lambda uri: uri == "a").edge_types == (("u", "to", "v"),)
    faults = {"task": "nothing", "fanouts": "[1, -3]", "split": {"TRAIN": 0.5, "VAL": 0.1, "TEST": 0.1}, "positive_edges": 0, "supervision_edge_types": [("v", "to", "u")], "node_types": ["u"], "paths": {"nodes": "b"}, "surprise": 1, "directed": 1}
    for k, v in faults.items():
        with pytest.raises(ValueError):
            config.check_config(good | {k: v}, lambda uri: uri == "a")
    with pytest.raises(ValueError, match="task is missing"):
        config.check_config({})


def test_typed_edges_by_usage(spark):
    e = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double")
    parts = {(("a", "to", "b"), "main"): e, (("b", "of", "a"), "main"): E.reverse(e), (("a", "to", "b"), "positive"): e.withColumn("dst", F.lit(3).cast("long"))}
    assert {(r.src, r.dst, r.relation, r.edge_type) for r in E.load_typed_edges(parts).collect()} == {(1, 2, "to", 0), (2, 1, "of", 1)}
    assert [(r.dst, r.features) for r in E.load_typed_edges(parts, "positive").collect()] == [(3, [0.5])]
    with pytest.raises(ValueError):
        E.load_typed_edges(parts, "negative")
    assert E.without_relations(E.labels_as_edges(e, e).unionByName(e.select("src", "dst", F.lit("to").alias("relation")))).count() == 1


def test_attributes(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0, 3.0]), (2, None, [4.0])], "k long, f array<float>, g array<float>")
    assert [r[0] for r in df.orderBy("k").select(impute.concat_attributes("f", "g")).collect()] == [[1.0, 2.0, 3.0], [4.0]]
    more = spark.createDataFrame([(1, 7)], "k long, n int")
    assert {r.k: r.n for r in impute.add_attribute(df, more, "k", "n", 0).collect()} == {1: 7, 2: 0}
    with pytest.raises(ValueError):
        impute.add_attribute(df, more.withColumnRenamed("n", "f"), "k", "f")
    assert impute.constant_feature(df, "c", 2.0, 2).first().c == [2.0, 2.0]


def test_catalog_and_files(spark, tmp_path):
    from datetime import date

    df = spark.range(5).withColumnRenamed("id", "k")
    names = [S.with_date("drift", x) for x in ("20240101", date(2024, 1, 5), "20240109")]
    for name in names:
        S.insert(df, name)
    S.insert(df, names[0])
    assert spark.table(names[0]).count() == 10 and S.rows_and_columns(spark.table(names[1])) == (5, 1) and S.has_columns(df, "k") and not S.has_columns(df, "z")
    assert S.lookback(spark, "drift", "20240109", 30) == names[1] and S.lookback(spark, "drift", "20240109", 2) is None
    assert S.tables_created(spark, "drift_", "20200101") == names or set(S.tables_created(spark, "drift_", "20200101")) == set(names)
    assert S.tables_created(spark, "drift_", "20990101") == []
    S.drop_matching(spark, "drift_")
    S.write(df, f"{tmp_path}/a")
    S.write(df, f"{tmp_path}/a", mode="append")
    assert S.read(spark, f"{tmp_path}/a").count() == 10
    assert S.copy_files(spark, f"{tmp_path}/a", f"{tmp_path}/b") > 0 and S.read(spark, f"{tmp_path}/b").count() == 10
    with pytest.raises(FileExistsError):
        S.copy_files(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    S.export_predictions(spark.createDataFrame([(1, 2.0)], "node_id long, pred double"), f"{tmp_path}/p")
    assert S.read(spark, f"{tmp_path}/p").first() == (1, 2)
    assert S.features_and_label(spark.createDataFrame([(1, 2, 3)], "a int, b int, y int"), ["a", "b"], ["y"]).first() == ([1.0, 2.0], [3.0])
    assert {k: v.count() for k, v in S.by_clauses(df, {"low": "k < 2", "high": "k >= 2"}).items()} == {"low": 2, "high": 3}
    assert S.post_process(df, lambda x: x.limit(2), lambda x: x.limit(1)).count() == 1


def test_types_ranks_and_orders(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    typed = E.lift(e, ("a", "to", "b"))
    assert sorted(map(tuple, E.lower(typed).collect())) == [(1, 2), (3, 2)] and E.reverse_typed(typed).first()[:5] == (2, 1, "b", "to", "a")
    with pytest.raises(Exception, match="several types"):
        E.lower(typed.unionByName(E.reverse_typed(typed))).collect()
    labels = typed.withColumn("relation", F.lit("to_positive_label"))
    assert [tuple(r) for r in E.degrees_by_type(typed.unionByName(labels)).collect()] == [(2, "b", 2)]
    owners = partitioning.hash_partition(spark.range(50).withColumnRenamed("id", "node_id"), 4)
    n = {r["rank"]: r.n for r in partitioning.ids_per_rank(owners).collect()}
    assert sum(n.values()) == 50 and all(partitioning.ids_on_rank(owners, i).count() == k for i, k in n.items())
    split = spark.createDataFrame([(1, "VAL"), (2, "VAL"), (3, "TEST")], "node_id long, split string")
    kinds = spark.createDataFrame([(1, 0), (2, 1)], "node_id long, node_type int")
    assert ids(partitioning.ids_of_split(split, "VAL", kinds, 1)) == [2]
    assert {r.node_id: (r.positive, r.negative) for r in partitioning.anchors_of_split(split, "VAL", e).collect()} == {1: ([2], []), 2: ([], [])}
    with pytest.raises(ValueError):
        sampling.plan_positives(e, typed, [], "a", "b")
    x = spark.range(1).select(F.array(*map(F.lit, range(20))).alias("x")).select(sampling.permute_anew("x", 5).alias("y")).first().y
    assert sorted(x) == list(range(20)) and x != sorted(x)
    assert ids(E.load_node_ids(kinds, limit=1)) == [1]
    S.write(spark.range(1000), f"{tmp_path}/s", files=1, bytes_per_file=2000)
    files = S.files_below(spark, f"{tmp_path}/s")
    assert len(files) > 3 and sum(S.read_rank(spark, f"{tmp_path}/s", i, 3).count() for i in range(3)) == 1000
    assert S.read_rank(spark, f"{tmp_path}/s", 98, 99).count() == 0


def test_user_sampling_and_fractions(spark):
    e = E.lift(spark.createDataFrame([(i, i % 2) for i in range(10)], "src long, dst long"), ("a", "to", "a")).withColumn("weight", F.lit(1.0))
    roots = spark.createDataFrame([(0,), (1,)], "node_id long")
    op = sampling.SamplingOp("own", ("a", "to", "a"), 3, method="user", choose=lambda met: met.where("next > 5"))
    assert {(r.root, r.src, r.dst) for r in sampling.run_plan(roots, e, [op], "a").collect()} == {(0, 6, 0), (0, 8, 0), (1, 7, 1), (1, 9, 1)}
    with pytest.raises(ValueError):
        sampling.run_plan(roots, e, [sampling.SamplingOp("own", ("a", "to", "a"), 3, method="none")], "a")
    rows = spark.range(1000)
    kept, others = (ids(sampling.keep_fraction(rows, 0.3, "id", legacy_inverted=x), "id") for x in (False, True))
    assert sorted(kept + others) == list(range(1000)) and 250 < len(kept) < 350 and ids(sampling.keep_fraction(rows, 1.0, "id", legacy_inverted=True), "id") == list(range(1000))


def test_push_rounds_write_what_they_reach(spark):
    r = random.Random(7)
    pairs = sorted({(a, b) for i in range(120) for j in r.sample(range(40), 6) for a, b in ((i, 1000 + j), (1000 + j, i))} | {(5, 5)})
    e, seeds = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in range(60)], "node_id long")
    rounds = ppr.push_rounds(e, seeds, epsilon=1e-2).cache()
    n = dict(rounds.groupBy("round").count().collect())
    assert max(n) >= 2 and n[max(n)] < rounds.select("seed", "node_id").distinct().count() / 2
    # the state by plain rounds over dictionaries
    near = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
    want = {}
    for s in range(60):
        score, residual, hop = defaultdict(float), defaultdict(float, {s: 0.5}), {s: 0}
        while todo := {v: x for v, x in residual.items() if x > 0 and x >= 0.5 * 1e-2 * len(near[v])}:
            for v, x in todo.items():
                score[v] += x
                residual[v] -= x
            for v, x in todo.items():
                for u in near[v]:
                    residual[u] += x * 0.5 / len(near[v])
                    hop[u] = min(hop.get(u, 99), hop[v] + 1)
        want |= {(s, v): (score[v], residual[v], hop[v]) for v in hop}
    got = {(x.seed, x.node_id): (x.score, x.residual, x.hop) for x in ppr._latest(rounds).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    a, b = (sorted((x.seed, x["rank"], x.node_id) for x in df.collect()) for df in (ppr.top_pushed(rounds, 30), ppr.top_ppr(ppr._latest(rounds), 30)))
    assert a == b and len(a) > 60


def test_slots_are_dealt_by_their_size(spark, monkeypatch):
    from graphtables.plans import scratch

    monkeypatch.setattr(scratch, "BYTES_A_TASK", 1 << 13)
    left = scratch.materialize(spark.range(20_000).selectExpr("id % 5000 AS k", "id AS a"))
    right = scratch.materialize(spark.range(5000).selectExpr("id AS k", "id * 2 AS b"))
    met = E.slotted_join(left, right, "k", 2)
    assert met.count() == 20_000 and met.where("b <> 2 * k").count() == 0
    parts = met.groupBy(F.spark_partition_id().alias("p")).count()
    assert parts.count() > 8 and parts.agg(F.max("count")).first()[0] < 5000  # not a task a slot


def test_shuffles_are_dealt_by_their_input(spark, monkeypatch):
    from graphtables.plans import scratch

    edges = scratch.materialize(spark.range(30_000).selectExpr("id % 700 AS src", "1000 + id * 7 % 900 AS dst", "float(id) AS w"))
    few = E.bidirect(edges).collect()
    monkeypatch.setattr(scratch, "BYTES_A_TASK", 1 << 13)
    want = scratch.shuffle_tasks(edges)
    assert want > 8 and scratch.shuffle_tasks(edges.unionByName(edges)) >= 2 * want - 1
    both = E.bidirect(edges)
    assert both.rdd.getNumPartitions() == want and sorted(both.collect()) == sorted(few)
    assert E.bidirect(edges.select("src", "dst")).rdd.getNumPartitions() == want
    for sampled in (sampling.one_hop(edges, 3), sampling.numbered_neighbors(edges)):  # one shuffle: of ids, not of their hashes
        assert sampled.rdd.getNumPartitions() == want
        assert sampled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    rows = edges.select(F.col("src").alias("root"), "src", "dst")
    full = edges.select("src", "dst", F.lit(0).alias("edge_type"), F.array("w").alias("features"))
    assert subgraphs.hydrate_edges(rows, full).rdd.getNumPartitions() > 8


def test_a_table_is_not_written_again(spark):
    from graphtables.plans.scratch import materialize

    table = materialize(spark.range(5))
    assert materialize(table) is table and materialize(table.where("id > 1")) is not table
