"""Queries of operators on node names and what is known of nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import nodes
from lodestone.operators.graph import stored
from lodestone.sources import views as V


@query("""WITH p AS (SELECT *, replace(p_type, ' ', '_') AS t, 'f' || p_partkey AS m FROM part)
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'src.' || t || '.' || m WHEN 1 THEN 'src.' || t || '.' || m WHEN 2 THEN 'src.' || m WHEN 3 THEN 'a b.' || m END AS names,
CASE WHEN p_partkey % 5 IN (0, 1) THEN t END AS owner FROM p""")
def sca_22_descriptors(spark, sf):
    t, m, i = F.replace("p_type", F.lit(" "), F.lit("_")), F.concat(F.lit("f"), "p_partkey"), F.col("p_partkey")
    tails = [F.concat(F.lit("src/"), t, F.lit("#"), m, F.lit("().")), F.concat(F.lit("src/impl#["), t, F.lit("][Show]"), m, F.lit("(+1).")), F.concat(F.lit("src/impl#"), m, F.lit(".")), F.concat(F.lit("`a b`/"), m, F.lit("!"))]
    tail = F.coalesce(*[F.when(i % 5 == k, x) for k, x in enumerate(tails)])
    s = F.coalesce(F.concat(F.lit("scheme cargo pkg 1.0 "), tail), F.lit("local 5"))
    d = V.read(spark, sf, "part").select(i.alias("id"), nodes.descriptors(s).alias("d"))
    return d.select("id", F.array_join(F.transform("d", lambda x: x["name"]), ".").alias("names"), nodes.owner(F.col("d")).alias("owner"))


_CRATES = "named AS (SELECT 'd' || n_nationkey AS directory, CASE WHEN n_nationkey % 5 = 0 THEN 'same' || n_nationkey // 10 WHEN n_nationkey % 5 = 1 THEN 'd' || (n_nationkey + 1) ELSE n_name END AS name FROM nation)"


@query(f"WITH {_CRATES}, ok AS (SELECT * FROM named n WHERE (SELECT count(*) FROM named o WHERE o.name = n.name) = 1 AND n.name NOT IN (SELECT directory FROM named WHERE directory <> n.directory)) SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN coalesce(name, 'd' || c_nationkey) ELSE 'd' || c_nationkey END || '.m' || c_custkey AS path FROM customer LEFT JOIN ok ON directory = 'd' || c_nationkey")
def add_11_canonical(spark, sf):
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("same"), F.floor(k / 10))).when(k % 5 == 1, F.concat(F.lit("d"), k + 1)).otherwise(F.col("n_name"))
    crates = V.read(spark, sf, "nation").select(F.concat(F.lit("d"), k).alias("directory"), name.alias("name"))
    ids = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "python").otherwise("rust").alias("language"), F.array(F.concat(F.lit("d"), "c_nationkey"), F.concat(F.lit("m"), "c_custkey")).alias("module_path"))
    return nodes.canonical(ids, crates).select("id", F.array_join("module_path", ".").alias("path"))


@query("""WITH l AS (SELECT event_id AS path, ts AS modified, event_id % 7 AS len FROM events), n AS (SELECT max(ts) AS t FROM events),
k AS (SELECT event_id AS path, CASE WHEN event_id % 4 = 1 THEN ts - INTERVAL 1 SECOND ELSE ts END AS modified, event_id % 7 + CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS len, 'h' || event_id AS hash FROM events WHERE event_id % 4 > 0)
SELECT l.path, CASE WHEN k.path IS NOT NULL THEN hash END AS hash, k.path IS NULL AS read, k.path IS NOT NULL OR coalesce(epoch_us(t) - epoch_us(l.modified) >= 3000000, false) AS trusted FROM n, l LEFT JOIN k ON l.path = k.path AND l.modified = k.modified AND l.len = k.len""")
def str_03_stat_gate(spark, sf):
    e, i = V.read(spark, sf, "events"), F.col("event_id")
    listing = e.select(i.alias("path"), F.col("ts").alias("modified"), (i % 7).alias("len"))
    kept = e.where(i % 4 > 0).select(i.alias("path"), F.when(i % 4 == 1, F.col("ts") - F.expr("interval 1 second")).otherwise(F.col("ts")).alias("modified"), (i % 7 + F.when(i % 4 == 2, 1).otherwise(0)).alias("len"), F.concat(F.lit("h"), i).alias("hash"))
    return nodes.stat_gate(listing, kept, F.lit(e.agg(F.max("ts")).first()[0]))


@query("SELECT o_orderkey AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'file' ELSE 'commit' END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 'order ' || o_orderpriority END AS subject, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE END AS date FROM orders")
def add_23_commit_cards(spark, sf):
    o = V.read(spark, sf, "orders")
    cards = o.select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") % 3 == 0, "file").otherwise("commit").alias("kind"))
    commits = o.select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("order "), "o_orderpriority", F.lit("\n\nby "), "o_custkey").alias("message"), F.col("o_orderdate").cast("date").alias("date"))
    return nodes.commit_cards(cards, commits)


@query("WITH g AS (SELECT p_name || p_size // 5 AS query, p_partkey AS gold_id FROM part WHERE p_size % 5 = 0) SELECT p_partkey AS run_id, CASE WHEN n = 1 THEN id END AS gold_id, CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM part LEFT JOIN (SELECT query, count(*) AS n, min(gold_id) AS id FROM g GROUP BY query) ON query = p_name || p_size // 5")
def joi_26_gold_query(spark, sf):
    p = V.read(spark, sf, "part").withColumn("query", F.concat("p_name", F.floor(F.col("p_size") / 5)))
    return nodes.gold_query(p.select(F.col("p_partkey").alias("run_id"), "query"), p.where("p_size % 5 = 0").select("query", F.col("p_partkey").alias("gold_id")))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, p_size AS node, CASE WHEN p_partkey >= 8 THEN p_partkey // 8 END AS parent FROM part WHERE p_partkey > 0),
c AS (SELECT id, node, 0 AS depth, [node] AS chain FROM s WHERE parent IS NULL UNION ALL SELECT s.id, s.node, depth + 1, list_append(chain, s.node) FROM s JOIN c ON s.parent = c.id),
w AS (SELECT id AS path_id, CASE WHEN id % 2 = 0 THEN chain ELSE list_append(chain[:-2], node % 10) END AS nodes FROM c)
SELECT path_id, nodes IN (SELECT chain FROM c) AS found FROM w""")
def gra_13_spelled(spark, sf):
    i = F.col("p_partkey")
    up = lambda x: F.floor(x / 8)
    p = V.read(spark, sf, "part").where("p_partkey > 0").select(i.alias("id"), F.col("p_size").alias("node"), F.when(i >= 8, up(i)).alias("parent"))
    c = level = stored(p.where("parent is null").withColumn("chain", F.array("node")))
    for _ in range(8 * 21):
        level = stored(p.join(level.select(F.col("id").alias("parent"), "chain"), "parent").withColumn("chain", F.concat("chain", F.array("node"))).select(*c.columns))
        if level.isEmpty():
            break
        c = c.unionByName(level)
    states = c.select("id", "node", "parent", (F.size("chain") - 1).alias("depth"))
    nodes_of = F.when(F.col("id") % 2 == 0, F.col("chain")).otherwise(F.concat(F.expr("slice(chain, 1, size(chain) - 1)"), F.array(F.col("node") % 10)))
    return nodes.spelled(states, c.select(F.col("id").alias("path_id"), nodes_of.alias("nodes")))
