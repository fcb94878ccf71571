"""The engine's operators over the driver's tables, each with SQL that another engine can run for comparison.

The graph: customers and parts are nodes (parts moved behind an offset), what customers ordered are weighted edges; nations trade with
nations in a small dense graph; events link users with event types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, impute, vectors
from .operators import edges as E
from .operators import enumeration, partitioning, positional, ppr, sampling, splitting, statistics, subgraphs
from .plans.config import GraphMetadata
from .plans.graph import GraphTables, split_all
from .plans.scratch import dealt, materialize, shuffle_tasks
from .sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PARTS = 1_000_000


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with their orders; both sides dealt by their keys among as many tasks as they need together."""
    line, orders = S.table(spark, d, "lineitem"), S.table(spark, d, "orders")
    n = max(shuffle_tasks(line), shuffle_tasks(orders))
    return dealt(line, "l_orderkey", tasks=n).join(dealt(orders, "o_orderkey", tasks=n), F.col("l_orderkey") == F.col("o_orderkey"))


def bought(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight, n): customers and the parts they ordered."""
    rows = order_lines(spark, d).select(F.col("o_custkey").alias("src"), E.reindex("l_partkey", PARTS).alias("dst"), "l_quantity")
    return dealt(rows, "src", "dst").groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("n"))


BOUGHT = f"SELECT o_custkey AS src, {PARTS} + l_partkey AS dst, SUM(l_quantity) AS weight, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
BOTH = f"e AS ({BOUGHT}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


def both(spark: SparkSession, d: str) -> DataFrame:
    return E.bidirect(bought(spark, d).select("src", "dst"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): nations of customers and of their suppliers, once for each order line."""
    t = lambda n: S.table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


TRADE = "SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.lit(0).alias("node_type"), vectors.feature_array("c_acctbal", "c_nationkey").alias("features"))
    p = S.table(spark, d, "part").select(E.reindex("p_partkey", PARTS).alias("node_id"), F.lit(1).alias("node_type"), vectors.feature_array("p_retailprice", "p_size").alias("features"))
    return c.unionByName(p)


NODES = f"SELECT c_custkey AS node_id, 0 AS node_type FROM customer UNION ALL SELECT {PARTS} + p_partkey, 1 FROM part"


def full_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.load_edges(bought(spark, d), "src", "dst", ["weight"])


def _cents(x) -> Column:
    return F.round(x.cast("double") * 100).cast("long").cast("string")


def node_digest(nodes: str = "nodes") -> Column:
    """One text of all nodes with types and features, in order."""
    return F.md5(F.array_join(F.transform(nodes, lambda n: F.concat_ws(":", n["node_id"].cast("string"), n["node_type"].cast("string"), _cents(F.get(n["features"], F.lit(0))), _cents(F.get(n["features"], F.lit(1))))), "|"))


def edge_digest(edges: str = "edges") -> Column:
    """One text of all edges with types and features, in order."""
    return F.md5(F.array_join(F.transform(edges, lambda e: F.concat_ws(":", e["src"].cast("string"), e["dst"].cast("string"), e["edge_type"].cast("string"), _cents(F.get(e["features"], F.lit(0))))), "|"))


# the same in SQL: features of nodes (nf) and edges (ef) in hundredths, and digests of rows in order
NF = f"nf AS (SELECT c_custkey AS id, 0 AS t, round(c_acctbal::FLOAT::DOUBLE * 100)::BIGINT AS f0, (c_nationkey * 100)::BIGINT AS f1 FROM customer UNION ALL SELECT {PARTS} + p_partkey, 1, round(p_retailprice::FLOAT::DOUBLE * 100)::BIGINT, (p_size * 100)::BIGINT FROM part)"
EF = "ef AS (SELECT src, dst, round(weight * 100)::BIGINT AS w FROM e UNION ALL SELECT dst, src, round(weight * 100)::BIGINT FROM e)"
NODE_DIGEST = "md5(string_agg(concat_ws(':', id, t, f0, f1), '|' ORDER BY id))"
EDGE_DIGEST = "md5(coalesce(string_agg(concat_ws(':', src, dst, 0, w), '|' ORDER BY src, dst), ''))"


# ---- scans, projection, shaping


@query(f"SELECT node_id, node_type FROM ({NODES})")
def load_nodes(spark, d):
    return nodes(spark, d).select("node_id", "node_type")


@query("SELECT p_partkey AS node_id, round(p_retailprice::FLOAT::DOUBLE, 3) AS f0, p_size::DOUBLE AS f1 FROM part")
def node_features(spark, d):
    n = E.load_nodes(S.table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"])
    return n.select("node_id", F.round(F.col("features")[0].cast("double"), 3).alias("f0"), F.col("features")[1].cast("double").alias("f1"))


@query(f"SELECT src, dst, 3 AS edge_type, round(weight * 100)::BIGINT AS weight, n::BIGINT AS n FROM ({BOUGHT})")
def load_edges(spark, d):
    e = E.load_edges(bought(spark, d), "src", "dst", ["weight", "n"], 3)
    return e.select("src", "dst", "edge_type", F.round(F.col("features")[0].cast("double") * 100).cast("long").alias("weight"), F.col("features")[1].cast("long").alias("n"))


def typed_parts(spark, d):
    """Edge tables by (type, usage): ids of customers, parts and suppliers all begin at 1."""
    line = order_lines(spark, d)
    own = dealt(line.select(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    made = dealt(S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return {
        (("customer", "buys", "part"), "main"): own, (("part", "bought_by", "customer"), "main"): E.reverse(own),
        (("supplier", "supplies", "part"), "main"): made, (("part", "supplied_by", "supplier"), "main"): E.reverse(made),
        (("customer", "buys", "part"), "positive"): own.where("n > 1"), (("customer", "buys", "part"), "negative"): own.where("n = 1"),
    }


OWN = "SELECT o_custkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
MADE = "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2"
TYPED = f"o AS ({OWN}), m AS ({MADE}), t AS (SELECT src, dst, 'customer' AS src_type, 'buys' AS relation, 'part' AS dst_type, 0 AS code, n FROM o UNION ALL SELECT dst, src, 'part', 'bought_by', 'customer', 1, n FROM o UNION ALL SELECT src, dst, 'supplier', 'supplies', 'part', 2, n FROM m UNION ALL SELECT dst, src, 'part', 'supplied_by', 'supplier', 3, n FROM m)"


@query(f"WITH {TYPED} SELECT src, dst, relation, code AS edge_type, n::DOUBLE AS n FROM t")
def load_edges_by_type(spark, d):
    return E.load_typed_edges(typed_parts(spark, d)).select("src", "dst", "relation", "edge_type", F.col("features")[0].cast("double").alias("n"))


@query(f"SELECT src, dst, 'buys' AS relation, n::DOUBLE AS n FROM ({OWN}) WHERE n > 1")
def load_edges_by_usage(spark, d):
    return E.load_typed_edges(typed_parts(spark, d), "positive").select("src", "dst", "relation", F.col("features")[0].cast("double").alias("n"))


@query("SELECT count(*)::BIGINT AS n, sum(l_orderkey)::BIGINT AS s FROM lineitem")
def sharded_read(spark, d):
    return S.sharded(S.table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", 8).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s"))


@query("SELECT doc_id, coalesce(lang, 'MISSING') AS lang, coalesce(n_chars, 0) AS n_chars FROM documents")
def imputed(spark, d):
    return impute.project(S.table(spark, d, "documents"), {"doc_id": "bigint", "lang": "string", "n_chars": "bigint"})


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS weight, len(embedding)::INTEGER - 1 AS width FROM embeddings")
def weight_column(spark, d):
    e = S.table(spark, d, "embeddings").withColumnRenamed("embedding", "features")
    return S.split_weight(e, [f"f{i}" for i in range(64)], "f0").select("vec_id", F.round(F.col("weight").cast("double"), 5).alias("weight"), F.size("features").alias("width"))


@query("SELECT vec_id, round(embedding[3]::DOUBLE + embedding[10]::DOUBLE + embedding[11]::DOUBLE, 5) AS s FROM embeddings")
def selected_features(spark, d):
    f = impute.select_features("embedding", {"a": (0, 2), "b": (2, 3), "c": (9, 11)}, ["c", "b"])
    total = F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return S.table(spark, d, "embeddings").select("vec_id", F.round(total, 5).alias("s"))


@query("SELECT doc_id AS node_id, quality AS label, 'quality' AS label_type FROM labels")
def load_labels(spark, d):
    return E.load_labels(S.table(spark, d, "labels"), "doc_id", "quality", "quality")


@query("SELECT user_id AS src, event_type AS dst, 'event' AS relation FROM events UNION ALL SELECT c_custkey, c_mktsegment, 'segment' FROM customer")
def union_relations(spark, d):
    return S.union_edge_tables({"event": S.table(spark, d, "events").selectExpr("user_id AS src", "event_type AS dst"), "segment": S.table(spark, d, "customer").selectExpr("c_custkey AS src", "c_mktsegment AS dst")})


@query(f"WITH e AS ({BOUGHT}) SELECT dst AS src, src AS dst, 'positive_label' AS relation FROM e WHERE n > 1 UNION ALL SELECT dst, src, 'negative_label' FROM e WHERE weight < 3")
def label_edges(spark, d):
    e = bought(spark, d)
    return E.labels_as_edges(e.where("n > 1"), e.where("weight < 3"), "in")


# ---- enumeration


@query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS int_id, c_custkey FROM customer")
def enumerate_nodes(spark, d):
    c = S.table(spark, d, "customer").select("c_name", "c_custkey")
    return enumeration.enumerate_nodes(c, "c_name", enumeration.enumerate_ids(c, "c_name"))


@query("WITH u AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)), v AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) SELECT event_id, v.i AS src, u.i AS dst FROM events LEFT JOIN u USING (event_type) LEFT JOIN v USING (user_id)")
def enumerate_edges(spark, d):
    ev = S.table(spark, d, "events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), "event_id")
    users = enumeration.enumerate_ids(S.table(spark, d, "events"), "user_id").select(F.col("user_id").cast("string").alias("key"), "int_id")
    types = enumeration.enumerate_ids(S.table(spark, d, "events"), "event_type").withColumnRenamed("event_type", "key")
    return enumeration.enumerate_edges(ev, "src", "dst", users, types, "key").select("event_id", "src", "dst")


@query("SELECT c_name AS node_id, round(c_acctbal, 2) AS pred FROM customer")
def unenumerated(spark, d):
    c = S.table(spark, d, "customer")
    ids = enumeration.enumerate_ids(c, "c_name")
    assets = c.join(ids, "c_name").select(F.col("int_id").alias("node_id"), F.round("c_acctbal", 2).alias("pred"))
    return enumeration.unenumerate(assets.unionByName(assets), ids, "c_name")


# ---- sets and joins of edges


@query(f"WITH {BOTH} SELECT src, dst FROM b")
def bidirected(spark, d):
    return both(spark, d)


@query(f"WITH e AS ({BOUGHT}), x AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) SELECT src, dst, min(weight) AS weight FROM x GROUP BY 1, 2")
def bidirected_weighted(spark, d):
    return E.bidirect(bought(spark, d).select("src", "dst", "weight"))


@query(f"WITH t AS ({TRADE}) SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM t")
def canonical_edges(spark, d):
    return E.canonical(trade(spark, d))


@query(f"WITH e AS ({BOUGHT}), n AS ({NODES} UNION ALL SELECT 2000000 + s_suppkey, 2 FROM supplier) SELECT node_id FROM n WHERE node_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def isolated_nodes(spark, d):
    """Suppliers have no edges here."""
    suppliers = S.table(spark, d, "supplier").select(E.reindex("s_suppkey", 2_000_000).alias("node_id"), F.lit(2).alias("node_type"))
    return E.isolated(nodes(spark, d).select("node_id", "node_type").unionByName(suppliers), bought(spark, d))


@query(f"WITH e AS ({BOUGHT}), n AS ({NODES}) SELECT node_id FROM n WHERE node_id NOT IN (SELECT dst FROM e)")
def neighborless_nodes(spark, d):
    return E.neighborless(nodes(spark, d), bought(spark, d))


@query(f"WITH e AS ({BOUGHT} UNION ALL SELECT {PARTS} + l_partkey, 2000000 + l_suppkey, 0, 0 FROM lineitem) SELECT DISTINCT src AS node_id FROM e WHERE src NOT IN (SELECT dst FROM e)")
def source_only_nodes(spark, d):
    """Customers buy parts, which are made by suppliers: customers alone are sources only."""
    made = S.table(spark, d, "lineitem").select(E.reindex("l_partkey", PARTS).alias("src"), E.reindex("l_suppkey", 2_000_000).alias("dst"))
    return E.source_only(bought(spark, d).select("src", "dst").unionByName(made))


@query("WITH e AS (SELECT o_custkey AS src, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS dst FROM orders) SELECT src, dst FROM e WHERE src IS NULL OR dst IS NULL")
def dangling(spark, d):
    e = S.table(spark, d, "orders").selectExpr("o_custkey AS src", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS dst")
    return E.dangling_edges(e)


@query(f"WITH e AS ({BOUGHT}) SELECT node_id, count(*)::BIGINT AS degree FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def node_degrees(spark, d):
    return E.degrees(bought(spark, d))


@query(f"WITH e AS ({BOUGHT}) SELECT dst AS node_id, least(count(*), 20)::BIGINT AS degree FROM e GROUP BY 1")
def in_degrees_clamped(spark, d):
    return E.degrees(bought(spark, d), "in", 20).withColumn("degree", F.col("degree").cast("long"))


@query(f"WITH {TYPED} SELECT dst AS node_id, dst_type AS node_type, least(count(*), 30)::BIGINT AS degree FROM t GROUP BY 1, 2")
def degrees_by_type(spark, d):
    """Over all types of edges, but for labels."""
    labels = E.load_typed_edges(typed_parts(spark, d), "positive").withColumn("relation", F.lit("buys_positive_label"))
    return E.degrees_by_type(E.load_typed_edges(typed_parts(spark, d)).unionByName(labels), most=30).withColumn("degree", F.col("degree").cast("long"))


@query(f"SELECT l_partkey AS src, o_custkey AS dst, 'part' AS src_type, 'buys' AS relation, 'customer' AS dst_type FROM (SELECT DISTINCT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def reversed_types(spark, d):
    own = typed_parts(spark, d)[("customer", "buys", "part"), "main"].select("src", "dst")
    return E.reverse_typed(E.lift(own, ("customer", "buys", "part")))


@query("SELECT DISTINCT c_custkey AS node_id FROM customer ORDER BY 1 LIMIT 40")
def load_node_ids(spark, d):
    return E.load_node_ids(nodes(spark, d), 0, 40, 3)


@query(f"WITH e AS ({BOUGHT}) SELECT dst, array_to_string(list(src ORDER BY src), ',') AS neighbors FROM e GROUP BY 1")
def adjacency(spark, d):
    return E.adjacency(bought(spark, d)).select("dst", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"WITH e AS ({BOUGHT}) SELECT dst AS node_id, round(avg(c_acctbal), 4) AS mean, count(*)::BIGINT AS n FROM e JOIN customer ON src = c_custkey GROUP BY 1")
def neighbor_mean(spark, d):
    v = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), "c_acctbal")
    return E.neighbor_mean(bought(spark, d), v, "c_acctbal").withColumn("mean", F.round("mean", 4))


@query("SELECT o_orderkey AS k, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def slotted_join(spark, d):
    a = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    b = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return E.slotted_join(a, b, "k", 4)


@query("WITH g AS (SELECT o_custkey AS id, o_orderkey AS v FROM orders) SELECT id, max(v) AS v FROM g GROUP BY id")
def merged_graphs(spark, d):
    return E.merge_graphs(S.table(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderkey AS v"), ["id"], "v")


# ---- sampling

def numbered_sql(rows: str, salt: str, here: str = "dst", there: str = "src") -> str:
    """Neighbors in the order of their hashes."""
    return f"SELECT {here} AS node_id, {there} AS nxt, row_number() OVER (PARTITION BY {here} ORDER BY md5(concat_ws('|', '{salt}', {here}, {there})), {there}) - 1 AS place, count(*) OVER (PARTITION BY {here}) AS degree FROM {rows}"


def drawn_sql(paths: str, node: str, by: str, n: int, salt: str, nb: str = "nb") -> str:
    """Each path with the neighbors at the places that it draws among its node's."""
    start = f"(('0x' || substr(md5(concat_ws('|', '{salt}', {by})), 1, 8))::UBIGINT)::BIGINT % degree"
    at = f"SELECT {by}, degree, least({n}, degree) AS m, {start} AS s, unnest(range(0, least({n}, degree))) AS i FROM (SELECT {by} FROM {paths}) JOIN (SELECT node_id AS z, degree FROM {nb} WHERE place = 0) ON z = {node}"
    return f"SELECT {', '.join('x.' + c for c in by.split(', '))}, q.nxt FROM ({at}) x JOIN {nb} q ON q.node_id = x.{node} AND q.place = (s + i * x.degree // m) % x.degree"


DRAWN_POSITIVES = "SELECT src AS root, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', 'positive', src, dst)), dst) AS r FROM e) WHERE r <= 3"
HOP1 = f"nb AS ({numbered_sql('b', 'hop1')})" + ", h1 AS (SELECT node_id AS root, nxt AS hop1 FROM nb WHERE place < {n})"
HOP2 = f"h2 AS (SELECT root, hop1, nxt AS hop2 FROM ({drawn_sql('h1', 'hop1', 'root, hop1', 3, 'hop2')}))"


@query(f"WITH {BOTH}, {HOP1.format(n=10)} SELECT root, hop1 FROM h1")
def sample_one_hop(spark, d):
    return sampling.one_hop(both(spark, d), 10)


@query(f"WITH {BOTH}, {HOP1.format(n=4)}, {HOP2} SELECT root, hop1, hop2 FROM h2")
def sample_two_hop(spark, d):
    return sampling.k_hop(both(spark, d), [4, 3])[1]


@query(f"WITH e AS ({BOUGHT}), w AS (SELECT *, -ln((('0x' || substr(md5(concat_ws('|', 'w', src, dst)), 1, 8))::UBIGINT + 0.5) / 4294967296.0) / weight AS k FROM e) SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k, dst) AS r FROM w) WHERE r <= 5")
def sample_weighted(spark, d):
    return sampling.weighted_rows(bought(spark, d), ["src"], "dst", "weight", 5, "w").select("src", "dst")


@query(f"WITH e AS ({BOUGHT}) SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) WHERE r <= 5")
def sample_top(spark, d):
    return sampling.top_rows(bought(spark, d), ["src"], "dst", "weight", 5).select("src", "dst")


@query(f"WITH e AS ({BOUGHT}), l AS (SELECT dst, list(src ORDER BY src) AS a FROM e GROUP BY 1), i AS (SELECT unnest(range(1, 6)) AS i) SELECT dst, i::INTEGER AS i, a[(('0x' || substr(md5(concat_ws('|', 'wr', dst, i)), 1, 8))::UBIGINT % len(a))::BIGINT + 1] AS src FROM l, i")
def sample_with_replacement(spark, d):
    rows = sampling.with_replacement(E.adjacency(bought(spark, d)), "dst", "neighbors", 5, "wr")
    return rows.select("dst", F.posexplode("sampled").alias("i", "src")).select("dst", (F.col("i") + 1).alias("i"), "src")


@query(f"WITH e AS ({BOUGHT}) SELECT dst, array_to_string(list(src ORDER BY md5(concat_ws('|', 'p', dst, src)), src), ',') AS neighbors FROM e GROUP BY 1")
def permuted_neighbors(spark, d):
    a = E.adjacency(bought(spark, d))
    return a.select("dst", F.array_join(sampling.permute("neighbors", "dst", "p").cast("array<string>"), ",").alias("neighbors"))


@query("SELECT c_custkey AS node_id FROM customer ORDER BY md5(concat_ws('|', 'downsample', c_custkey)), c_custkey LIMIT 50")
def downsampled(spark, d):
    return sampling.downsample(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), 50)


@query("SELECT c_custkey FROM customer WHERE (('0x' || substr(md5(concat_ws('|', 'fraction', c_custkey)), 1, 8))::UBIGINT + 0.5) / 4294967296.0 < 0.3")
def fraction_kept(spark, d):
    return sampling.keep_fraction(S.table(spark, d, "customer").select("c_custkey"), 0.3, "c_custkey")


FRONTIER = (
    f"nb AS ({numbered_sql('b', 'frontier')}), s AS (SELECT c_custkey AS root, c_custkey AS node_id FROM customer), "
    f"n1 AS (SELECT DISTINCT root, nxt AS node_id FROM ({drawn_sql('s', 'node_id', 'root, node_id', 4, 'frontier1')}) WHERE root <> nxt), "
    f"n2 AS (SELECT root, nxt AS node_id FROM ({drawn_sql('n1', 'node_id', 'root, node_id', 3, 'frontier2')}) WHERE root <> nxt EXCEPT SELECT root, node_id FROM n1)"
)


@query(f"WITH {BOTH}, {FRONTIER} SELECT root, node_id, 0 AS hop FROM s UNION ALL SELECT root, node_id, 1 FROM n1 UNION ALL SELECT root, node_id, 2 FROM n2")
def frontier_sampling(spark, d):
    seeds = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return sampling.k_hop_frontier(both(spark, d), seeds, [4, 3])


FANOUTS = {("part", "bought_by", "customer"): [3, 0], ("customer", "buys", "part"): [0, 2], ("supplier", "supplies", "part"): [0, 2]}


def typed_frontier(spark, d):
    edges = E.load_typed_edges(typed_parts(spark, d))
    labels = E.load_typed_edges(typed_parts(spark, d), "positive").withColumn("relation", F.lit("buys_positive_label"))  # not followed
    seeds = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.lit("customer").alias("node_type"))
    return sampling.typed_frontier(edges.unionByName(labels), seeds, FANOUTS)


def _draw(rows: str, hop: int, n: int, kinds: str) -> str:
    """SQL of one typed hop from rows (root, node_id, node_type) along some kinds of edges."""
    start = f"(('0x' || substr(md5(concat_ws('|', 'typed{hop}', root, 'customer', y.node_id, y.node_type, kind)), 1, 8))::UBIGINT)::BIGINT % degree"
    drawn = f"SELECT root, z.node_id, z.node_type, kind, degree, least({n}, degree) AS m, {start} AS s, unnest(range(0, least({n}, degree))) AS i FROM {rows} y JOIN nb z ON z.node_id = y.node_id AND z.node_type = y.node_type AND z.place = 0 AND kind IN ({kinds})"
    return f"SELECT DISTINCT root, nb.nxt AS node_id, nb.next_type AS node_type FROM ({drawn}) x JOIN nb ON nb.node_id = x.node_id AND nb.node_type = x.node_type AND nb.kind = x.kind AND nb.place = (s + i * x.degree // m) % x.degree"


TYPED_FRONTIER = (
    f"{TYPED}, k AS (SELECT *, concat_ws('|', src_type, relation, dst_type) AS kind FROM t), "
    "nb AS (SELECT dst AS node_id, dst_type AS node_type, src AS nxt, src_type AS next_type, kind, row_number() OVER (PARTITION BY dst, dst_type, kind ORDER BY md5(concat_ws('|', 'typed', dst, dst_type, src_type, kind, src)), src) - 1 AS place, count(*) OVER (PARTITION BY dst, dst_type, kind) AS degree FROM k), "
    "f0 AS (SELECT c_custkey AS root, c_custkey AS node_id, 'customer' AS node_type FROM customer), "
    f"f1 AS ({_draw('f0', 1, 3, repr('part|bought_by|customer'))}), f2 AS ({_draw('f1', 2, 2, repr('customer|buys|part') + ', ' + repr('supplier|supplies|part'))} EXCEPT SELECT * FROM f0), "
    "f AS (SELECT *, 0 AS hop FROM f0 UNION ALL SELECT *, 1 FROM f1 UNION ALL SELECT *, 2 FROM f2)"
)


@query(f"WITH {TYPED_FRONTIER} SELECT root, node_id, node_type, hop FROM f")
def typed_frontier_sampling(spark, d):
    return typed_frontier(spark, d).select("root", "node_id", "node_type", "hop")


@query(
    f"WITH {TYPED_FRONTIER}, c AS (SELECT 'customer' AS node_type, 0 AS t, c_custkey AS node_id, round(c_acctbal::FLOAT::DOUBLE * 100)::BIGINT AS f0 FROM customer UNION ALL SELECT 'part', 1, p_partkey, round(p_retailprice::FLOAT::DOUBLE * 100)::BIGINT FROM part) "
    "SELECT root, count(*)::INTEGER AS nodes, md5(string_agg(concat_ws(':', f.node_id, CASE f.node_type WHEN 'customer' THEN 0 WHEN 'part' THEN 1 ELSE 2 END, f0), '|' ORDER BY f.node_id, CASE f.node_type WHEN 'customer' THEN 0 WHEN 'part' THEN 1 ELSE 2 END)) AS node_digest FROM f LEFT JOIN c ON c.node_id = f.node_id AND c.node_type = f.node_type GROUP BY 1"
)
def typed_hydration(spark, d):
    """By id and type: the same numbers are customers, parts and suppliers; suppliers have no features and stay."""
    meta = GraphMetadata(("customer", "part", "supplier"), tuple(FANOUTS))
    ids = typed_frontier(spark, d).select("root", "node_id", meta.node_code(F.col("node_type")).alias("node_type"))
    c = E.load_nodes(S.table(spark, d, "customer"), "c_custkey", ["c_acctbal"], 0)
    p = E.load_nodes(S.table(spark, d, "part"), "p_partkey", ["p_retailprice"], 1)
    out = subgraphs.hydrate_nodes(ids, c.unionByName(p), keep=True)
    return out.select("root", F.size("nodes").alias("nodes"), node_digest().alias("node_digest"))


@query(f"WITH {TYPED}, r AS (SELECT src AS root, src, dst, code FROM t WHERE code IN (0, 2)) SELECT root, md5(string_agg(concat_ws(':', r.src, r.dst, r.code, n * 100), '|' ORDER BY r.src, r.dst, r.code)) AS edge_digest FROM r JOIN t USING (src, dst, code) GROUP BY 1")
def typed_edge_hydration(spark, d):
    """By both ends and type: customers and suppliers of one number have edges to the same parts."""
    edges = E.load_typed_edges(typed_parts(spark, d))
    rows = edges.where("edge_type IN (0, 2)").select(F.col("src").alias("root"), "src", "dst", "edge_type")
    return subgraphs.hydrate_edges(rows, edges, keep=True).select("root", edge_digest().alias("edge_digest"))


@query("WITH l AS (SELECT DISTINCT o_custkey AS root, o_orderkey AS node_id FROM orders), x AS (SELECT c_custkey AS root, c_custkey AS node_id, 0 AS k FROM customer UNION ALL SELECT root, node_id, 1 FROM l WHERE root <> node_id AND root IN (SELECT c_custkey FROM customer)) SELECT root, node_id, (row_number() OVER (PARTITION BY root ORDER BY k, node_id) - 1)::INTEGER AS place FROM x")
def anchor_label_seeds(spark, d):
    labels = S.table(spark, d, "orders").selectExpr("o_custkey AS src", "o_orderkey AS dst")
    return sampling.anchor_and_label_seeds(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), labels).select("root", "node_id", F.col("place").cast("int").alias("place"))


@query("WITH l AS (SELECT DISTINCT o_custkey AS root, o_orderkey AS label FROM orders WHERE o_custkey <> o_orderkey) SELECT root, label, row_number() OVER (PARTITION BY root ORDER BY label)::INTEGER AS place FROM l")
def label_remap(spark, d):
    labels = S.table(spark, d, "orders").selectExpr("o_custkey AS src", "o_orderkey AS dst").where("src <> dst").distinct()
    seeds = sampling.anchor_and_label_seeds(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), labels)
    return sampling.remap_labels(labels, seeds).select("root", "label", F.col("place").cast("int").alias("place"))


def typed_edges(spark, d):
    a = bought(spark, d).select("src", "dst", "weight", F.lit("customer").alias("src_type"), F.lit("buys").alias("relation"), F.lit("part").alias("dst_type"))
    b = bought(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("part").alias("src_type"), F.lit("bought_by").alias("relation"), F.lit("customer").alias("dst_type"))
    return a.unionByName(b)


@query(
    f"WITH e AS ({BOUGHT}), s AS (SELECT c_custkey AS root FROM customer), "
    "a AS (SELECT root, nxt FROM (SELECT root, e.dst AS nxt, row_number() OVER (PARTITION BY root ORDER BY weight DESC, e.dst) AS r FROM s JOIN e ON e.src = root) WHERE r <= 3), "
    f"nb AS ({numbered_sql('e', 'others')}), o AS (SELECT root, node_id AS nxt, nxt AS src FROM ({drawn_sql('(SELECT root, nxt AS node_id FROM a)', 'node_id', 'root, node_id', 2, 'othersstart')})) "
    "SELECT root, 'own' AS op, nxt AS src, root AS dst, 'bought_by' AS relation FROM a UNION ALL SELECT root, 'others', src, nxt, 'buys' FROM o"
)
def sampling_plan(spark, d):
    ops = [sampling.SamplingOp("own", ("part", "bought_by", "customer"), 3, method="top_k"), sampling.SamplingOp("others", ("customer", "buys", "part"), 2, ("own",))]
    roots = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return sampling.run_plan(roots, typed_edges(spark, d), ops, "customer")


@query(
    f"WITH e AS ({BOUGHT}), q AS ({DRAWN_POSITIVES}), a AS (SELECT positive, dst AS nxt FROM (SELECT positive, x.src AS dst, row_number() OVER (PARTITION BY positive ORDER BY weight DESC, x.src) AS r FROM (SELECT DISTINCT dst AS positive FROM q) JOIN e x ON x.dst = positive) WHERE r <= 2) "
    "SELECT root, positive, 'buyers' AS op, nxt AS src, positive AS dst, 'buys' AS relation FROM (SELECT root, dst AS positive FROM q) JOIN a USING (positive)"
)
def plan_of_positives(spark, d):
    """What customers buy most, and who buys that most."""
    positives = subgraphs.positive_edges(bought(spark, d), 3)
    ops = [sampling.SamplingOp("buyers", ("customer", "buys", "part"), 2, method="top_k")]
    return sampling.plan_positives(positives, typed_edges(spark, d), ops, "part", "part")


@query(
    f"WITH e AS ({BOUGHT}), u AS ({numbered_sql('e', 'bought_by', 'src', 'dst')}), v AS ({numbered_sql('e', 'buys')}), a AS (SELECT root, nxt AS hop1 FROM ({drawn_sql('(SELECT c_custkey AS root FROM customer)', 'root', 'root', 2, 'bought_by1', 'u')})) "
    f"SELECT root, hop1, nxt AS hop2 FROM ({drawn_sql('a', 'hop1', 'root, hop1', 2, 'buys2', 'v')})"
)
def metapath_sampling(spark, d):
    path = sampling.metapaths([("part", "bought_by", "customer"), ("customer", "buys", "part")], "customer", 2)[0]
    roots = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return sampling.metapath_sample(roots, typed_edges(spark, d), path, 2)


SUB = f"{BOTH}, {HOP1.format(n=4)}, {HOP2}, p AS (SELECT root, hop1 AS src, root AS dst FROM h1 UNION ALL SELECT root, hop2, hop1 FROM h2)"


#: Digests of rooted paths (p) of the roots: their nodes, with the root, and their edges as a bag.
DIGESTS = f"ids AS (SELECT root, src AS id FROM p UNION SELECT root, dst FROM p UNION SELECT root, root FROM p), nd AS (SELECT root, count(*)::INTEGER AS nodes, {NODE_DIGEST} AS node_digest FROM ids JOIN nf USING (id) GROUP BY 1), ed AS (SELECT root, count(*)::INTEGER AS edges, {EDGE_DIGEST} AS edge_digest FROM p JOIN ef USING (src, dst) GROUP BY 1)"
ONE = f"{BOTH}, {NF}, {EF}, {HOP1.format(n=3)}, p AS (SELECT root, hop1 AS src, root AS dst FROM h1), {DIGESTS}"


@query(f"WITH {SUB}, {NF}, {EF}, {DIGESTS} SELECT root, nodes, node_digest, edges, edge_digest FROM nd JOIN ed USING (root)")
def rooted_subgraphs(spark, d):
    sub = subgraphs.rooted_subgraphs(nodes(spark, d), E.bidirect(full_edges(spark, d)), [4, 3])
    return sub.select("root", F.size("nodes").alias("nodes"), node_digest().alias("node_digest"), F.size("edges").alias("edges"), edge_digest().alias("edge_digest"))


@query(f"WITH {ONE}, own AS (SELECT id AS root, {NODE_DIGEST} AS own_digest FROM nf GROUP BY 1) SELECT root, nd.root IS NULL AS alone, coalesce(node_digest, own_digest) AS node_digest, edge_digest FROM own LEFT JOIN nd USING (root) LEFT JOIN ed USING (root)")
def inference_samples(spark, d):
    g = GraphTables(nodes(spark, d), full_edges(spark, d))
    return g.inference_samples([3]).select("root", subgraphs.is_alone().alias("alone"), node_digest().alias("node_digest"), edge_digest().alias("edge_digest"))


@query("SELECT o_custkey AS root, dst FROM (SELECT o_custkey, 1000000 + l_partkey AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat_ws('|', 'positive', o_custkey, 1000000 + l_partkey)), l_partkey) AS r FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE r <= 3")
def positive_edges(spark, d):
    return subgraphs.positive_edges(bought(spark, d), 3)


LINK = (
    f"{BOTH}, {NF}, {EF}, {HOP1.format(n=3)}, q AS (SELECT root, dst FROM (SELECT src AS root, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', 'positive', src, dst)), dst) AS r FROM b) WHERE r <= 2), "
    "own AS (SELECT root, hop1 AS src, root AS dst FROM h1), near AS (SELECT root, src, dst FROM own UNION SELECT q.root, own.src, own.dst FROM q JOIN own ON own.root = q.dst)"
)


@query(
    f"WITH {LINK}, ids AS (SELECT root, src AS id FROM near UNION SELECT root, dst FROM near UNION SELECT root, root FROM own UNION SELECT root, dst FROM q), "
    f"nd AS (SELECT root, {NODE_DIGEST} AS node_digest FROM ids JOIN nf USING (id) GROUP BY 1), ed AS (SELECT root, {EDGE_DIGEST} AS edge_digest FROM near JOIN ef USING (src, dst) GROUP BY 1), "
    f"pd AS (SELECT root, {EDGE_DIGEST} AS pos_digest FROM (SELECT root, root AS src, dst FROM q) JOIN ef USING (src, dst) GROUP BY 1) SELECT root, node_digest, edge_digest, pos_digest FROM nd JOIN ed USING (root) JOIN pd USING (root)"
)
def link_samples(spark, d):
    g = GraphTables(nodes(spark, d), full_edges(spark, d))
    return g.link_samples([3], 2).select("root", node_digest().alias("node_digest"), edge_digest().alias("edge_digest"), edge_digest("pos_edges").alias("pos_digest"))


def _split_sql(a: str, b: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '', concat_ws('-', least({a}, {b}), 0, greatest({a}, {b})))), 1, 8))::UBIGINT % 10000"


@query(
    f"WITH {LINK}, s AS (SELECT * FROM (VALUES ('TRAIN', 0, 8000, 8000), ('VAL', 8000, 9000, 8000), ('TEST', 9000, 10000, 9000)) v(split, lo, hi, message)), "
    f"nh AS (SELECT *, {_split_sql('src', 'dst')} AS h FROM near), qh AS (SELECT *, {_split_sql('root', 'dst')} AS h FROM q), "
    f"ed AS (SELECT root, split, count(*)::INTEGER AS edges, {EDGE_DIGEST} AS edge_digest FROM nh JOIN s ON h < message JOIN ef USING (src, dst) GROUP BY 1, 2), "
    f"pd AS (SELECT root, split, count(*)::INTEGER AS pos, {EDGE_DIGEST} AS pos_digest FROM (SELECT root, split, root AS src, dst FROM qh JOIN s ON h >= lo AND h < hi) JOIN ef USING (src, dst) GROUP BY 1, 2) "
    "SELECT root, split, coalesce(edges, 0) AS edges, coalesce(edge_digest, md5('')) AS edge_digest, coalesce(pos, 0) AS pos, coalesce(pos_digest, md5('')) AS pos_digest FROM (SELECT DISTINCT root FROM own) CROSS JOIN s LEFT JOIN ed USING (root, split) LEFT JOIN pd USING (root, split) WHERE split <> 'TRAIN' OR pos > 0"
)
def link_split(spark, d):
    """All three splits of link samples: supervision by its own split, messages along training edges."""
    parts = split_all(GraphTables(nodes(spark, d), full_edges(spark, d)).link_samples([3], 2))
    rows = [df.select("root", F.lit(s).alias("split"), F.size("edges").alias("edges"), edge_digest().alias("edge_digest"), F.size("pos_edges").alias("pos"), edge_digest("pos_edges").alias("pos_digest")) for s, df in parts.items()]
    return sampling.union_of(rows)


def label_samples(spark, d):
    """Link samples with labels of their own: what was bought more than once is positive, what was bought once is negative."""
    e = bought(spark, d)
    kind = lambda df, code: E.load_edges(df, "src", "dst", ["weight"], code)
    return GraphTables(nodes(spark, d), full_edges(spark, d)).link_samples([3], 2, kind(e.where("n > 1"), 0), kind(e.where("n = 1"), 0))


DRAWN = "SELECT src AS root, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', '{salt}', src, dst)), dst) AS r FROM e WHERE {where}) WHERE r <= 2"
LABELS = f"{BOTH}, {NF}, {EF}, pos AS ({DRAWN.format(salt='positive', where='n > 1')}), neg AS ({DRAWN.format(salt='negative', where='n = 1')} AND src IN (SELECT root FROM pos))"
DIRECTED = "('0x' || substr(md5(concat_ws('|', '', concat_ws('-', root, 0, dst))), 1, 8))::UBIGINT % 10000"


def _label_digest(rows: str, name: str) -> str:
    return f"{name}d AS (SELECT root, split, {EDGE_DIGEST} AS {name}_digest FROM (SELECT root, split, root AS src, dst FROM {rows}) JOIN ef USING (src, dst) GROUP BY 1, 2)"


@query(
    f"WITH {LABELS}, s AS (SELECT * FROM (VALUES ('TRAIN', 0, 8000), ('VAL', 8000, 9000), ('TEST', 9000, 10000)) v(split, lo, hi)), "
    f"ps AS (SELECT root, dst, split FROM (SELECT *, {DIRECTED} AS h FROM pos) JOIN s ON h >= lo AND h < hi), ns AS (SELECT root, dst, split FROM (SELECT *, {DIRECTED} AS h FROM neg) JOIN s ON h >= lo AND h < hi), "
    f"{_label_digest('ps', 'pos')}, {_label_digest('ns', 'neg')} SELECT root, split, coalesce(pos_digest, md5('')) AS pos_digest, coalesce(neg_digest, md5('')) AS neg_digest FROM (SELECT DISTINCT root FROM pos) CROSS JOIN s LEFT JOIN posd USING (root, split) LEFT JOIN negd USING (root, split) WHERE split <> 'TRAIN' OR pos_digest IS NOT NULL"
)
def label_split(spark, d):
    """User-defined labels: supervision by its own split, neighborhoods whole."""
    samples = materialize(label_samples(spark, d), "label_samples")
    return sampling.union_of([splitting.supervision_split(samples, s).select("root", F.lit(s).alias("split"), edge_digest("pos_edges").alias("pos_digest"), edge_digest("neg_edges").alias("neg_digest")) for s in splitting.RATIOS])


ANCHOR = "CASE WHEN {h} < 8000 THEN 'TRAIN' WHEN {h} < 9000 THEN 'VAL' ELSE 'TEST' END"
NODE_SLOT = "(('0x' || substr(md5(concat_ws('|', '', concat_ws('-', {id}, {t}))), 1, 8))::UBIGINT % 10000)"


@query(
    f"WITH {LINK}, kept AS (SELECT n.root, n.src, n.dst FROM near n WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.root = n.root AND (n.src = q.root AND n.dst = q.dst OR n.src = q.dst AND n.dst = q.root))), "
    f"ed AS (SELECT root, {EDGE_DIGEST} AS edge_digest FROM kept JOIN ef USING (src, dst) GROUP BY 1) SELECT root, {ANCHOR.format(h=NODE_SLOT.format(id='root', t=0))} AS split, edge_digest FROM ed WHERE root IN (SELECT root FROM own)"
)
def anchor_label_split(spark, d):
    """The anchor decides; its label edges, either way round, leave its neighborhood."""
    samples = materialize(GraphTables(nodes(spark, d), full_edges(spark, d)).link_samples([3], 2), "samples")
    return sampling.union_of([splitting.anchor_supervision_split(samples, s).select("root", F.lit(s).alias("split"), edge_digest().alias("edge_digest")) for s in splitting.RATIOS])


@query(
    f"WITH {ONE}, w AS (SELECT id, {ANCHOR.format(h=NODE_SLOT.format(id='id', t='t'))} AS split FROM nf), "
    f"ni AS (SELECT root, split, {NODE_DIGEST} AS node_digest FROM (SELECT ids.root, a.split, nf.* FROM ids JOIN w a ON a.id = ids.root JOIN w b ON b.id = ids.id AND a.split = b.split JOIN nf ON nf.id = ids.id) GROUP BY 1, 2), "
    f"ei AS (SELECT root, {EDGE_DIGEST} AS edge_digest FROM (SELECT p.root, p.src, p.dst, ef.w FROM p JOIN ef USING (src, dst) JOIN w a ON a.id = p.root JOIN w b ON b.id = p.src AND b.split = a.split JOIN w c ON c.id = p.dst AND c.split = a.split) GROUP BY 1) "
    "SELECT root, split, node_digest, coalesce(edge_digest, md5('')) AS edge_digest FROM ni JOIN (SELECT DISTINCT root FROM p) USING (root) LEFT JOIN ei USING (root)"
)
def inductive_split(spark, d):
    """Samples by their root's split, with only nodes of that split and the edges between them."""
    samples = materialize(GraphTables(nodes(spark, d), full_edges(spark, d)).subgraphs([3]), "samples")
    return sampling.union_of([splitting.classification_split(samples, s, inductive=True).select("root", F.lit(s).alias("split"), node_digest().alias("node_digest"), edge_digest().alias("edge_digest")) for s in splitting.RATIOS])


@query("SELECT doc_id AS node_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unsplit_nodes(spark, d):
    """Documents without labels get no split."""
    split = splitting.anchor_split(S.table(spark, d, "labels").select(F.col("doc_id").alias("node_id")))
    return splitting.unsplit(S.table(spark, d, "documents").select(F.col("doc_id").alias("node_id")), split)


@query(f"WITH {ONE} SELECT root, c_nationkey AS label, node_digest, edge_digest FROM customer JOIN nd ON root = c_custkey JOIN ed USING (root)")
def classification_samples(spark, d):
    g = GraphTables(nodes(spark, d), full_edges(spark, d))
    labels = E.load_labels(S.table(spark, d, "customer"), "c_custkey", "c_nationkey", "nation")
    return g.classification_samples([3], labels).select("root", F.col("labels")[0]["label"].alias("label"), node_digest().alias("node_digest"), edge_digest().alias("edge_digest"))


@query(
    f"WITH {BOTH}, {NF}, {EF}, {HOP1.format(n=3)}, {HOP2}, p AS (SELECT root, hop1 AS src, root AS dst FROM h1 UNION SELECT root, hop2, hop1 FROM h2), {DIGESTS}, "
    "hops AS (SELECT root, md5(string_agg(concat_ws(':', hop, id), '|' ORDER BY hop, id)) AS neighbors FROM (SELECT root, 1 AS hop, hop1 AS id FROM h1 UNION SELECT root, 2, hop2 FROM h2) GROUP BY 1) SELECT root, neighbors, node_digest, edge_digest FROM hops JOIN nd USING (root) JOIN ed USING (root)"
)
def ego_nets(spark, d):
    own = subgraphs.ego_nets(E.bidirect(full_edges(spark, d)), 3, nodes=nodes(spark, d))
    near = F.md5(F.array_join(F.transform("neighbors", lambda x: F.concat_ws(":", x["hop"].cast("string"), x["node_id"].cast("string"))), "|"))
    return own.select("root", near.alias("neighbors"), node_digest().alias("node_digest"), edge_digest().alias("edge_digest"))


@query(f"WITH {ONE} SELECT count(DISTINCT root)::BIGINT AS invalid FROM p WHERE src % 7 = 0 OR dst % 7 = 0")
def invalid_subgraphs(spark, d):
    """Samples from whose nodes some are taken away: their edges have ends that aren't there."""
    sub = subgraphs.rooted_subgraphs(nodes(spark, d), E.bidirect(full_edges(spark, d)), [3])
    broken = sub.withColumn("nodes", F.filter("nodes", lambda n: n["node_id"] % 7 != 0))
    return subgraphs.invalid_subgraphs(broken).agg(F.count("*").alias("invalid"))


@query()
def personalized_pagerank(spark, d):
    seeds = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    return ppr.top_pushed(ppr.push_rounds(both(spark, d), seeds), 20)


@query()
def ppr_sequences(spark, d):
    seeds = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"))
    return ppr.sequences(ppr.top_ppr(ppr.forward_push(trade(spark, d), seeds, epsilon=1e-3), 8), 8)


@query(
    f"WITH t AS (SELECT DISTINCT src, dst FROM ({TRADE})), g AS (SELECT src, count(*) AS deg FROM t GROUP BY 1), s AS (SELECT n_nationkey::BIGINT AS seed FROM nation), "
    "a AS (SELECT seed, dst AS node, 0.25 / deg AS r, 1 AS hop FROM s JOIN t ON src = seed JOIN g USING (src)), z AS (SELECT seed, node, 0.0 AS score, r AS residual, hop FROM a UNION ALL SELECT seed, seed, 0.5, 0.0, 0 FROM s), "
    "y AS (SELECT seed, node, sum(score) AS score, sum(residual) AS residual, min(hop) AS hop FROM z GROUP BY 1, 2), "
    "x AS (SELECT seed, node, score + residual AS score, 0.0 AS residual, hop FROM y UNION ALL SELECT seed, dst, 0.0, residual * 0.5 / deg, hop + 1 FROM y JOIN t ON src = node JOIN g USING (src) WHERE residual > 0) "
    "SELECT seed, node AS node_id, round(sum(score), 9) AS score, round(sum(residual), 9) AS residual, min(hop)::INTEGER AS hop FROM x GROUP BY 1, 2"
)
def pagerank_two_rounds(spark, d):
    """The state of forward push after two rounds, in which all that holds a residual is pushed."""
    seeds = S.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"))
    out = ppr.forward_push(trade(spark, d), seeds, epsilon=1e-12, most_rounds=2, unfinished="return")
    return out.select("seed", "node_id", F.round("score", 9).alias("score"), F.round("residual", 9).alias("residual"), "hop")


def channel_scores(spark, d):
    """(seed, node_id, score, residual, hop): customers as seeds, what they bought and what that costs as scores."""
    e = bought(spark, d)
    return e.select(F.col("src").alias("seed"), F.col("dst").alias("node_id"), F.col("weight").cast("double").alias("score"), F.lit(0.0).alias("residual"), F.lit(1).alias("hop"))


@query(
    f"WITH e AS ({BOUGHT}), r AS (SELECT src AS seed, dst AS node_id, weight::DOUBLE AS score, p_brand AS channel FROM e JOIN part ON dst = {PARTS} + p_partkey), w AS (SELECT *, CASE channel WHEN 'Brand#11' THEN 1 ELSE 2 END AS target FROM r WHERE channel IN ('Brand#11', 'Brand#12')), "
    "p AS (SELECT *, row_number() OVER (PARTITION BY seed, channel ORDER BY score DESC, node_id) <= target AS chosen FROM w), q AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY chosen DESC, score DESC, channel, node_id) AS r FROM p) SELECT seed, node_id, channel, r::INTEGER AS rank FROM q WHERE r <= 3"
)
def channel_ranking(spark, d):
    types = S.table(spark, d, "part").select(E.reindex("p_partkey", PARTS).alias("node_id"), F.col("p_brand").alias("node_type"))
    return ppr.by_channel(channel_scores(spark, d), types, {"Brand#11": 1, "Brand#12": 2})


TOP3 = f"e AS ({BOUGHT}), top AS (SELECT src AS seed, dst AS node_id, r::INTEGER AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM e) WHERE r <= 3)"


@query(f"WITH {TOP3}, sel AS (SELECT seed, node_id FROM top UNION ALL SELECT DISTINCT seed, seed FROM top) SELECT a.seed, e.src, e.dst FROM sel a JOIN e ON e.src = a.node_id JOIN sel b ON b.seed = a.seed AND b.node_id = e.dst")
def induced_edges(spark, d):
    top = ppr.top_ppr(channel_scores(spark, d), 3).select("seed", "node_id")
    return ppr.induced_edges(top.unionByName(top.select("seed", F.col("seed").alias("node_id")).distinct()), bought(spark, d))


@query(f"WITH {TOP3}, tok AS (SELECT seed, 0 AS i, seed AS node FROM (SELECT DISTINCT seed FROM top) UNION ALL SELECT seed, rank, node_id FROM top) SELECT a.seed, a.i::INTEGER AS i, b.i::INTEGER AS j, e.weight::DOUBLE AS weight FROM tok a JOIN tok b USING (seed) JOIN e ON e.src = a.node AND e.dst = b.node")
def token_relations(spark, d):
    tokens = ppr.sequences(ppr.top_ppr(channel_scores(spark, d), 3), 4)
    return ppr.token_relations(tokens, bought(spark, d).withColumn("weight", F.col("weight").cast("double")), "weight")


@query(f"WITH {TOP3}, g AS (SELECT seed, list(node_id ORDER BY rank) AS x FROM top GROUP BY 1) SELECT seed, array_to_string(list_prepend(seed, x), ',') || repeat(',-1', 4 - len(x)::INTEGER) AS tokens FROM g")
def ranked_sequences(spark, d):
    tokens = ppr.sequences(ppr.top_ppr(channel_scores(spark, d), 3), 5)
    return tokens.select("seed", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(
    "WITH e AS (SELECT 1000000 + c_custkey AS src, 100 + c_nationkey AS dst FROM customer UNION SELECT 100 + n_nationkey, n_regionkey FROM nation), s AS (SELECT 1000000 + c_custkey AS seed FROM customer), "
    "x AS (SELECT seed, seed AS node_id, 0 AS hop FROM s UNION ALL SELECT seed, dst, 1 FROM s JOIN e ON src = seed UNION ALL SELECT seed, b.dst, 2 FROM s JOIN e a ON a.src = seed JOIN e b ON b.src = a.dst) SELECT seed, node_id::BIGINT AS node_id, hop, (hop + 1)::INTEGER AS rank FROM x"
)
def reachability_sequences(spark, d):
    """From customers over nations to regions."""
    seeds = S.table(spark, d, "customer").select(E.reindex("c_custkey", PARTS).alias("node_id"))
    return ppr.reachable(places(spark, d), seeds, 2, 5).select("seed", "node_id", "hop", "rank")


def places(spark, d):
    """(src, dst): customers in nations, nations in regions."""
    c = S.table(spark, d, "customer").select(E.reindex("c_custkey", PARTS).cast("long").alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    return c.unionByName(S.table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst")))


@query(
    f"WITH w AS (SELECT src, dst, count(*) AS w FROM ({TRADE}) GROUP BY 1, 2), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), q AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.dst = b.src GROUP BY 1, 2), "
    "x AS (SELECT 1 AS step, * FROM p UNION ALL SELECT 2, * FROM q) SELECT dst AS node_id, step, round(sum(CASE WHEN src <> dst THEN p ELSE 0 END), 6) AS pe, round(sum(CASE WHEN src = dst THEN p ELSE 0 END), 6) AS se FROM x GROUP BY 1, 2"
)
def random_walk_encodings(spark, d):
    out = positional.random_walk(trade(spark, d), 2)
    return out.select("node_id", "step", F.round("pe", 6).alias("pe"), F.round("se", 6).alias("se"))


@query("WITH c AS (SELECT 1000000 + c_custkey AS src, 100 + c_nationkey AS dst FROM customer), n AS (SELECT 100 + n_nationkey AS src, n_regionkey AS dst FROM nation) SELECT src, dst, 1 AS hops FROM c UNION ALL SELECT src, dst, 1 FROM n UNION ALL SELECT c.src, n.dst, 2 FROM c JOIN n ON n.src = c.dst")
def hop_distances(spark, d):
    return positional.hop_distances(places(spark, d), 3)


@query(f"WITH e AS ({BOUGHT}) SELECT src, dst FROM e ORDER BY md5(concat_ws('|', 'positive', src, dst)), src, dst LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM e)")
def self_supervised(spark, d):
    return sampling.self_supervised_positives(bought(spark, d), 0.1).select("src", "dst")


BATCH = "SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey // 256)::BIGINT AS batch, min(l_returnflag) AS relation, min(l_orderkey) AS src, min(l_partkey) AS dst FROM lineitem GROUP BY 1"


@query(
    f"WITH x AS ({BATCH}), n AS (SELECT *, row_number() OVER (PARTITION BY batch, relation ORDER BY md5(concat_ws('|', 'contrast', id)), id) - 1 AS place, count(*) OVER (PARTITION BY batch, relation) AS size FROM x), "
    "y AS (SELECT *, size - 1 AS o, least(3, size - 1) AS m, (('0x' || substr(md5(concat_ws('|', 'contraststart', id)), 1, 8))::UBIGINT)::BIGINT % (size - 1) AS s FROM n WHERE size > 1), z AS (SELECT *, unnest(range(0, m)) AS i FROM y) "
    "SELECT z.id, z.src, n.dst FROM z JOIN n ON n.batch = z.batch AND n.relation = z.relation AND n.place = (z.place + 1 + (s + i * o // m) % o) % z.size"
)
def in_batch_negatives(spark, d):
    """All order lines, in batches of 256 order keys, whose size doesn't follow the table's."""
    return sampling.negatives_in_batch(batches(spark, d), 3)


def batches(spark, d):
    rows = S.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return rows.agg(F.min(F.floor(F.col("l_orderkey") / 256)).alias("batch"), F.min("l_returnflag").alias("relation"), F.min("l_orderkey").alias("src"), F.min("l_partkey").alias("dst"))


@query(
    f"WITH x AS ({BATCH}), p AS (SELECT *, row_number() OVER (PARTITION BY batch, relation ORDER BY md5(concat_ws('|', 'contrast', id)), id) - 1 AS place, count(*) OVER (PARTITION BY batch, relation) AS size FROM (SELECT id, batch, relation, dst AS node_id FROM x)), "
    "z AS (SELECT x.*, size, least(2, size) AS m, (('0x' || substr(md5(concat_ws('|', 'contraststart', x.id)), 1, 8))::UBIGINT)::BIGINT % size AS s, unnest(range(0, least(2, size))) AS i FROM x JOIN p ON p.batch = x.batch AND p.relation = x.relation AND p.place = 0) "
    "SELECT z.id, z.src, p.node_id AS dst FROM z JOIN p ON p.batch = z.batch AND p.relation = z.relation AND p.place = (s + i * z.size // m) % z.size"
)
def pool_negatives(spark, d):
    b = batches(spark, d)
    return sampling.negatives_in_batch(b, 2, pool=b.select("id", "batch", "relation", F.col("dst").alias("node_id")))


@query("WITH r AS (SELECT * FROM (VALUES ('buys', 'customer', 'part'), ('trades', 'nation', 'nation')) t(relation, s, t)), z AS (SELECT 'customer' AS k, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation), i AS (SELECT unnest(range(1, 101)) AS i) SELECT relation, i::INTEGER AS i, (('0x' || substr(md5(concat_ws('|', 'negativesrc', relation, i)), 1, 8))::UBIGINT % a.n)::BIGINT AS src, (('0x' || substr(md5(concat_ws('|', 'negativedst', relation, i)), 1, 8))::UBIGINT % b.n)::BIGINT AS dst, 0 AS label FROM r JOIN z a ON a.k = s JOIN z b ON b.k = t, i")
def uniform_negatives(spark, d):
    relations = spark.createDataFrame([("buys", "customer", "part"), ("trades", "nation", "nation")], "relation string, src_type string, dst_type string")
    sizes = None
    for t in ("customer", "part", "nation"):
        n = S.table(spark, d, t).agg(F.lit(t).alias("node_type"), F.count("*").alias("size"))
        sizes = n if sizes is None else sizes.unionByName(n)
    return sampling.negatives_uniform(relations, sizes, 100)


@query("WITH p AS (SELECT DISTINCT o_custkey AS query, o_orderpriority AS item FROM orders) SELECT a.query, a.item, b.item AS candidate FROM p a JOIN p b ON a.query = b.query AND a.item <> b.item")
def retrieval_masks(spark, d):
    pairs = S.table(spark, d, "orders").selectExpr("o_custkey AS query", "o_orderpriority AS item").distinct()
    return sampling.retrieval_masks(pairs).select("query", "item", "candidate")


# ---- splits


@query("SELECT c_custkey AS node_id, CASE WHEN h < 8000 THEN 'TRAIN' WHEN h < 9000 THEN 'VAL' ELSE 'TEST' END AS split FROM (SELECT c_custkey, ('0x' || substr(md5(concat_ws('|', '', concat_ws('-', c_custkey, 0))), 1, 8))::UBIGINT % 10000 AS h FROM customer)")
def node_split(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), splitting.node_split("c_custkey", F.lit(0)).alias("split"))


@query(f"WITH e AS ({BOUGHT}), h AS (SELECT src, dst, ('0x' || substr(md5(concat_ws('|', '', concat_ws('-', least(src, dst), 0, greatest(src, dst)))), 1, 8))::UBIGINT % 10000 AS h FROM e) SELECT src, dst, CASE WHEN h < 8000 THEN 'TRAIN' WHEN h < 9000 THEN 'VAL' ELSE 'TEST' END AS split, CASE WHEN h < 2400 THEN 'SUPERVISION' WHEN h < 8000 THEN 'MESSAGE' ELSE 'MESSAGE_AND_SUPERVISION' END AS usage FROM h")
def edge_split(spark, d):
    split, usage = splitting.edge_split("src", "dst", F.lit(0), disjoint=0.3)
    return bought(spark, d).select("src", "dst", split.alias("split"), usage.alias("usage"))


@query(f"WITH {ONE}, h AS (SELECT *, {_split_sql('src', 'dst')} AS h FROM p), x AS (SELECT root, count(*)::INTEGER AS edges, {EDGE_DIGEST} AS edge_digest FROM h JOIN ef USING (src, dst) WHERE h < 9000 GROUP BY 1), y AS (SELECT root, src AS id FROM h WHERE h < 9000 UNION SELECT DISTINCT root, root FROM p), z AS (SELECT root, {NODE_DIGEST} AS node_digest FROM y JOIN nf USING (id) GROUP BY 1) SELECT root, coalesce(edges, 0) AS edges, coalesce(edge_digest, md5('')) AS edge_digest, node_digest FROM z LEFT JOIN x USING (root)")
def transductive_split(spark, d):
    g = GraphTables(nodes(spark, d), full_edges(spark, d))
    return splitting.transductive_link_split(g.subgraphs([3]), "TEST").select("root", F.size("edges").alias("edges"), edge_digest().alias("edge_digest"), node_digest().alias("node_digest"))


@query("WITH h AS (SELECT c_custkey AS node_id, (('0x' || substr(md5(concat_ws('|', 'anchor', c_custkey)), 1, 8))::UBIGINT % 1073741824)::DOUBLE AS h FROM customer), s AS (SELECT min(h) AS lo, max(h) AS hi FROM h) SELECT node_id, CASE WHEN (h - lo) / (hi - lo) >= 1 - 0.1 THEN 'TEST' WHEN (h - lo) / (hi - lo) >= 1 - 0.1 - 0.1 THEN 'VAL' ELSE 'TRAIN' END AS split FROM h, s")
def anchor_split(spark, d):
    return splitting.anchor_split(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")))


@query(
    f"WITH e AS ({BOUGHT}), h AS (SELECT o_custkey AS node_id, (('0x' || substr(md5(concat_ws('|', 'anchor', o_custkey)), 1, 8))::UBIGINT % 1073741824)::DOUBLE AS h FROM (SELECT DISTINCT o_custkey FROM orders)), s AS (SELECT min(h) AS lo, max(h) AS hi FROM h), "
    "v AS (SELECT node_id FROM h, s WHERE (h - lo) / (hi - lo) >= 1 - 0.1 - 0.1 AND (h - lo) / (hi - lo) < 1 - 0.1) "
    "SELECT node_id, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = node_id AND n > 1), '') AS positive, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = node_id AND n = 1), '') AS negative FROM v"
)
def split_anchors(spark, d):
    """Anchors of the validation split with their labels."""
    e = bought(spark, d)
    split = splitting.anchor_split(S.table(spark, d, "orders").select(F.col("o_custkey").alias("node_id")))
    out = partitioning.anchors_of_split(split, "VAL", e.where("n > 1"), e.where("n = 1"))
    return out.select("node_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("positive", "negative")])


@query("SELECT (('0x' || substr(md5(concat_ws('|', 'rank', c_custkey)), 1, 8))::UBIGINT % 7)::BIGINT AS rank, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def ids_per_rank(spark, d):
    return partitioning.ids_per_rank(partitioning.hash_partition(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), 7))


@query(f"WITH e AS ({BOUGHT}), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM e) SELECT src, array_to_string(list(dst ORDER BY dst), ',') || repeat(',-1', 5 - count(*)::INTEGER) AS labels FROM r WHERE r <= 5 GROUP BY 1")
def anchor_labels(spark, d):
    return splitting.labels_per_anchor(bought(spark, d), 5, 5).select("src", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


# ---- statistics


@query("SELECT label, round(coalesce(avg(CASE WHEN x <= 0 THEN x END), 0), 5) AS neg_mean, round(coalesce(avg(CASE WHEN x > 0 THEN x END), 0), 5) AS pos_mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def sign_means(spark, d):
    x = S.table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return statistics.sign_means(x, "x", "label").select("label", F.round("neg_mean", 5).alias("neg_mean"), F.round("pos_mean", 5).alias("pos_mean"))


@query("SELECT count(c_acctbal)::BIGINT AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, " + ", ".join(f"round(quantile_cont(c_acctbal, {p / 100}), 4) AS p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) + ", max(c_acctbal) AS max FROM customer")
def described(spark, d):
    out = statistics.describe(S.table(spark, d, "customer"), "c_acctbal")
    return out.select("count", *[F.round(c, 4).alias(c) if c not in ("min", "max") else F.col(c) for c in out.columns if c != "count"])


@query("WITH a AS (SELECT vec_id, embedding AS x FROM embeddings), b AS (SELECT vec_id - 1 AS vec_id, embedding AS y FROM embeddings) SELECT vec_id AS node_id, round(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[]))), 6) AS cosine FROM a JOIN b USING (vec_id)")
def embedding_drift(spark, d):
    e = S.table(spark, d, "embeddings")
    a, b = e.selectExpr("vec_id AS node_id", "embedding AS emb"), e.selectExpr("vec_id - 1 AS node_id", "embedding AS emb")
    return statistics.embedding_drift(a, b).select("node_id", F.round("cosine", 6).alias("cosine"))


@query("WITH s AS (SELECT l_orderkey AS q, l_returnflag = 'R' AS p, l_extendedprice AS v FROM lineitem), r AS (SELECT a.q, 1 + (SELECT count(*) FROM s b WHERE b.q = a.q AND NOT b.p AND b.v > a.v) AS r FROM s a WHERE a.p) SELECT q AS query, avg((r <= 1)::INTEGER) AS hit_at_1, avg((r <= 5)::INTEGER) AS hit_at_5, round(avg(1.0 / r), 6) AS mrr FROM r GROUP BY 1")
def ranking_metrics(spark, d):
    s = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_returnflag") == "R").alias("positive"), F.col("l_extendedprice").alias("score"))
    return statistics.ranking_metrics(s, (1, 5)).withColumn("mrr", F.round("mrr", 6))


@query("SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS positive_mean, round(avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 6) AS negative_mean FROM lineitem")
def mean_scores(spark, d):
    s = S.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("positive"), F.col("l_quantity").alias("score"))
    return statistics.mean_scores(s).select(F.round("positive_mean", 6).alias("positive_mean"), F.round("negative_mean", 6).alias("negative_mean"))


@query("SELECT l_partkey, count(*)::BIGINT AS frequency, round(least(1.0, 64 * count(*) / (SELECT count(*) FROM lineitem)), 9) AS probability FROM lineitem GROUP BY 1")
def in_batch_probability(spark, d):
    return statistics.in_batch_probability(S.table(spark, d, "lineitem"), "l_partkey", 64).withColumn("probability", F.round("probability", 9))


CELLS = "SELECT l_partkey, i AS row, (('0x' || substr(md5(concat_ws('|', '7', i, l_partkey)), 1, 8))::UBIGINT % 512)::BIGINT AS cell FROM lineitem, (SELECT unnest(range(0, 4)) AS i)"


@query(f"SELECT row::INTEGER AS row, cell, count(*)::BIGINT AS n FROM ({CELLS}) GROUP BY 1, 2")
def count_min(spark, d):
    return statistics.count_min(S.table(spark, d, "lineitem"), "l_partkey", 4, 512)


@query(f"WITH c AS ({CELLS}), n AS (SELECT row, cell, count(*) AS n FROM c GROUP BY 1, 2) SELECT l_partkey, min(n)::BIGINT AS estimate FROM (SELECT DISTINCT l_partkey, row, cell FROM c) JOIN n USING (row, cell) GROUP BY 1")
def count_min_estimate(spark, d):
    line = S.table(spark, d, "lineitem")
    return statistics.count_min_estimate(statistics.count_min(line, "l_partkey", 4, 512), line, "l_partkey", 4, 512)


@query("SELECT 'c_acctbal' AS \"column\", count(*)::BIGINT AS n, count(*) FILTER (c_acctbal IS NULL)::BIGINT AS missing, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal)::DOUBLE AS least, max(c_acctbal)::DOUBLE AS most FROM customer UNION ALL SELECT 'c_name', count(*), count(*) FILTER (c_name IS NULL), NULL, NULL, NULL, NULL FROM customer")
def dataset_statistics(spark, d):
    out = statistics.dataset_statistics(S.table(spark, d, "customer"), "c_acctbal", "c_name")
    return out.select("column", "n", "missing", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "least", "most")


@query("WITH s AS (SELECT l_extendedprice / 1e4 - l_quantity AS x FROM lineitem) SELECT round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) AS bpr FROM s")
def bpr_loss(spark, d):
    s = S.table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("positive_score"), F.col("l_quantity").alias("negative_score"))
    return statistics.bpr_loss(s).select(F.round("bpr", 6).alias("bpr"))


@query()
def pooled_clip(spark, d):
    return statistics.pooled_clip(S.table(spark, d, "embeddings"), "embedding")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def vocabulary(spark, d):
    return statistics.vocabulary(S.table(spark, d, "events"), "event_type")


@query("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part)::DOUBLE, 6) AS p_size FROM part")
def scaled(spark, d):
    return statistics.scale_columns(S.table(spark, d, "part").select("p_partkey", "p_size"), "p_size").withColumn("p_size", F.round("p_size", 6))


@query("SELECT vec_id, array_to_string([round_even((greatest(least(x::DOUBLE, 0.5), -0.5) + 0.5) / 1.0 * 15, 0)::INTEGER FOR x IN embedding], ',') AS codes FROM embeddings")
def quantized(spark, d):
    c = vectors.codes("embedding", 4, -0.5, 0.5)
    return S.table(spark, d, "embeddings").select("vec_id", F.array_join(c.cast("array<string>"), ",").alias("codes"))


@query("SELECT vec_id, array_to_string([(x > 0)::INTEGER FOR x IN embedding], '') AS bits FROM embeddings")
def packed_round_trip(spark, d):
    packed = vectors.pack(vectors.codes("embedding", 1, 0, 1), 1)
    rows = S.table(spark, d, "embeddings").select("vec_id", packed.alias("packed"))
    return rows.select("vec_id", F.array_join(vectors.unpack("packed", 1, 64).cast("array<string>"), "").alias("bits"))


NEXT = "x AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def pairs_of_vectors(spark, d):
    """(vec_id, a, b): each vector and the one after it."""
    e = S.table(spark, d, "embeddings")
    return e.selectExpr("vec_id", "embedding AS a").join(e.selectExpr("vec_id - 1 AS vec_id", "embedding AS b"), "vec_id")


@query(f"WITH {NEXT} SELECT vec_id, round(list_dot_product(a, b), 5) AS d, round(-(list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b)), 5) AS e FROM x")
def similarities(spark, d):
    return pairs_of_vectors(spark, d).select("vec_id", F.round(vectors.dot("a", "b"), 5).alias("d"), F.round(vectors.negative_squared_distance("a", "b"), 5).alias("e"))


@query(f"WITH {NEXT}, i AS (SELECT unnest(range(1, 65)) AS i) SELECT vec_id, i::INTEGER AS i, round(a[i] + b[i], 5) AS t, round(a[i] * b[i], 5) AS m, round(CASE WHEN i <= 32 THEN a[i] * b[i] - a[i + 32] * b[i + 32] ELSE a[i - 32] * b[i] + a[i] * b[i - 32] END, 5) AS c FROM x, i")
def relation_operators(spark, d):
    wide = [F.col(c).cast("array<double>").alias(c) for c in ("a", "b")]
    rows = pairs_of_vectors(spark, d).select("vec_id", *wide)
    parts = F.arrays_zip(vectors.translate("a", "b").alias("t"), vectors.diagonal("a", "b").alias("m"), vectors.complex_diagonal("a", "b").alias("c"))
    return rows.select("vec_id", F.posexplode(parts).alias("i", "x")).select("vec_id", (F.col("i") + 1).alias("i"), *[F.round(f"x.{k}", 5).alias(k) for k in ("t", "m", "c")])


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x, round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS y FROM embeddings")
def normalized(spark, d):
    n = vectors.l2_normalize(F.col("embedding").cast("array<double>"))
    return S.table(spark, d, "embeddings").select("vec_id", n.alias("n")).select("vec_id", F.round(F.col("n")[0], 6).alias("x"), F.round(F.col("n")[63], 6).alias("y"))


@query("SELECT c_custkey, c_acctbal, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*)::BIGINT AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def added_attribute(spark, d):
    n = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("total")).withColumnRenamed("key", "c_custkey")
    return impute.add_attribute(S.table(spark, d, "customer").select("c_custkey", "c_acctbal"), n, "c_custkey", "total", 0)


# ---- hashes, partitions


@query("SELECT c_custkey, (5::BIGINT << 32) | c_custkey AS composite FROM customer")
def composite_ids(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", hashing.composite_id(F.lit(5), "c_custkey").alias("composite"))


def _mixed(bits: int) -> str:
    """SQL of the mixer: a step for each shift and factor, on signed numbers that wrap."""
    ctes, last, whole, half = ["m0 AS (SELECT c_custkey, c_custkey::BIGINT + 1 AS h FROM customer)"], 0, 1 << bits, 1 << (bits - 1)
    for _ in range(2):
        for shift, factor in hashing.MIX[bits]:
            step = f"xor(h, h >> {shift})"
            if factor is not None:
                step = f"((({step})::HUGEINT * {factor} % {whole} + {whole} + {half}) % {whole} - {half})::BIGINT"
            ctes.append(f"m{last + 1} AS (SELECT c_custkey, {step} AS h FROM m{last})")
            last += 1
    return f"WITH {', '.join(ctes)} SELECT c_custkey, h::{'INTEGER' if bits == 32 else 'BIGINT'} AS h{bits} FROM m{last}"


@query(_mixed(32))
def integer_mix(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", hashing.integer_mix("c_custkey", 32).alias("h32"))


@query(_mixed(64))
def integer_mix_64(spark, d):
    return S.table(spark, d, "customer").select("c_custkey", hashing.integer_mix("c_custkey").alias("h64"))


@query(f"WITH e AS ({BOUGHT}) SELECT src, dst, (('0x' || substr(md5(concat_ws('|', 'rank', dst)), 1, 8))::UBIGINT % 7)::BIGINT AS rank FROM e")
def edges_by_owner(spark, d):
    owners = partitioning.hash_partition(nodes(spark, d).select("node_id"), 7)
    return partitioning.edges_by_owner(bought(spark, d).select("src", "dst"), owners).select("src", "dst", "rank")


@query("SELECT c_custkey AS node_id, (('0x' || substr(md5(concat_ws('|', 'rank', c_custkey)), 1, 8))::UBIGINT % 7)::BIGINT AS rank FROM customer")
def hash_partition(spark, d):
    return partitioning.hash_partition(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), 7)


@query("WITH n AS (SELECT c_custkey AS node_id, (SELECT max(c_custkey) + 1 FROM customer) AS t FROM customer) SELECT node_id, (CASE WHEN node_id < (t % 7) * (t // 7 + 1) THEN node_id // (t // 7 + 1) ELSE t % 7 + (node_id - (t % 7) * (t // 7 + 1)) // (t // 7) END)::BIGINT AS rank FROM n")
def range_partition(spark, d):
    return partitioning.range_partition(S.table(spark, d, "customer").select(F.col("c_custkey").alias("node_id")), 7)
