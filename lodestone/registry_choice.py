"""Queries of operators that choose: prices, picks, entities, gold matches, fitted weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import selection
from lodestone.sources import views as V

_STEP = "w{i} AS MATERIALIZED (SELECT any_value(wa) - {s} * ({l2} * any_value(wa) - avg(a / (1 + exp(m)))) AS wa, any_value(wb) - {s} * ({l2} * any_value(wb) - avg(b / (1 + exp(m)))) AS wb FROM (SELECT x.*, w.*, a * wa + b * wb AS m FROM x, w{j} w))"
_L2 = 0.1


@query(V.with_views("edges") + ", c AS (SELECT src, dst, max(conf) AS score, any_value(0.5 + (dst % 5) / 10) AS prior FROM edges GROUP BY src, dst), r AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) - 1 AS place FROM c) SELECT src, dst, round(CASE WHEN n <= 8 THEN prior ELSE prior / (1 + place) END, 9)::DOUBLE AS price FROM r WHERE n <= 8 OR place < 16")
def win_18_hop_price(spark, sf):
    c = V.edges(spark, sf).groupBy("src", "dst").agg(F.max("conf").alias("score")).withColumn("prior", 0.5 + (F.col("dst") % 5) / 10)
    return selection.hop_price(c).withColumn("price", F.round("price", 9))


@query(V.with_views("files") + " SELECT path, language FROM files WHERE language <> 'en' AND path LIKE 'src1%' ORDER BY content_hash, path LIMIT 25")
def set_04_pick(spark, sf):
    return selection.pick(V.files(spark, sf), (F.col("language") != "en") & F.col("path").startswith("src1"), 25, "content_hash", "path").select("path", "language")


_ASKED = [(1, "widg", 0), (1, "promo", 1), (2, "larg", 0), (2, "rod", 1), (3, "economy", 0), (3, "cold", 1), (3, "o", 2)]


@query("WITH e AS (SELECT p_partkey AS id, [string_split(lower(p_name), ' '), string_split(lower(p_brand), ' '), string_split(lower(p_type), ' ')] AS fields FROM part), l AS (SELECT *, len(flatten(fields)) AS n FROM e), t(query_id, term, ord) AS (VALUES " + ", ".join(f"({q}, '{t}', {o})" for q, t, o in _ASKED) + "), h AS (SELECT * FROM (SELECT query_id, term, ord, id, n, len(list_filter(fields, lambda f: len(list_filter(f, lambda x: CASE WHEN length(term) <= 3 THEN x = term ELSE contains(x, term) END)) > 0)) AS tf FROM l, t) WHERE tf > 0), w AS (SELECT count(*) AS n_files, avg(n) AS avg_n FROM l), df AS (SELECT query_id, term, ord, count(*) AS df FROM h GROUP BY ALL), c AS (SELECT *, df > 0.25 * n_files AS common, min((df > 0.25 * n_files)::INT) OVER (PARTITION BY query_id) = 1 AS all_common FROM df, w), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, ord) AS rn FROM c WHERE NOT common OR all_common), kept AS (SELECT query_id, term, ln((n_files - df + 0.5) / (df + 0.5) + 1) AS idf FROM k WHERE rn <= 12), s AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))), 6) AS score FROM h JOIN kept USING (query_id, term), w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10")
def rnk_03_entity_bm25(spark, sf):
    words = lambda *cols: F.split(F.lower(F.concat_ws(" ", *cols)), " ")
    e = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(words("p_name"), words("p_brand"), words("p_type")).alias("fields"))
    return selection.entity_bm25(e, _ASKED)


_GOLD = "g AS (SELECT p_partkey AS gold_id, 'sym' || p_partkey AS symbol, p_brand || '/' || p_type || '/' || p_partkey // 50 AS path, p_size * 10 AS first, p_size * 10 + 9 AS last, p_name || ' ' || p_partkey // 3 AS name, split_part(p_name, ' ', 1) AS bare FROM part)"
_ANSWERS = "a AS (SELECT gold_id AS answer_id, CASE gold_id % 4 WHEN 0 THEN 'sym' || (gold_id + 1) END AS symbol, CASE WHEN gold_id % 4 IN (1, 2) THEN path END AS path, CASE gold_id % 4 WHEN 1 THEN first + gold_id % 20 END AS line, CASE gold_id % 4 WHEN 2 THEN 'x::' || upper(bare) WHEN 3 THEN name END AS name FROM g)"


@query(f"WITH {_GOLD}, {_ANSWERS} SELECT DISTINCT answer_id, gold_id FROM a JOIN g ON a.symbol = g.symbol OR (a.path = g.path AND a.line BETWEEN first AND last) OR (a.line IS NULL AND (a.path IS NULL OR a.path = g.path) AND (lower(a.name) = lower(g.name) OR lower(a.name) = lower(bare) OR lower(regexp_extract(a.name, '([^:.#/]*)$', 1)) = lower(bare)))")
def joi_32_gold_matching(spark, sf):
    i, size = F.col("p_partkey"), F.col("p_size")
    g = V.read(spark, sf, "part").select(i.alias("gold_id"), F.concat(F.lit("sym"), i).alias("symbol"), F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.floor(i / 50)).alias("path"), (size * 10).alias("first"), (size * 10 + 9).alias("last"), F.concat("p_name", F.lit(" "), F.floor(i / 3)).alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("bare"))
    i = F.col("gold_id")
    turn = lambda *k: (i % 4).isin(*k)
    a = g.select(i.alias("answer_id"), F.when(turn(0), F.concat(F.lit("sym"), i + 1)).alias("symbol"), F.when(turn(1, 2), F.col("path")).alias("path"), F.when(turn(1), F.col("first") + i % 20).alias("line"), F.when(turn(2), F.concat(F.lit("x::"), F.upper("bare"))).when(turn(3), F.col("name")).alias("name"))
    return selection.gold_matches(a, g)


@query("WITH d AS MATERIALIZED (SELECT (l_quantity - 25)::DOUBLE AS a, (l_discount - 0.05)::DOUBLE AS b FROM lineitem), s AS MATERIALIZED (SELECT sqrt(avg(a * a)) AS sa, sqrt(avg(b * b)) AS sb FROM d), x AS MATERIALIZED (SELECT a / sa AS a, b / sb AS b FROM d, s), w0 AS (SELECT 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb), " + ", ".join(_STEP.format(i=i, j=i - 1, s=1 / (0.5 + _L2), l2=_L2) for i in range(1, 6)) + " SELECT 'a' AS name, round(wa / sa, 6) AS weight FROM w5, s UNION ALL SELECT 'b', round(wb / sb, 6) FROM w5, s")
def agg_26_pairwise_fit(spark, sf):
    d = V.read(spark, sf, "lineitem").select((F.col("l_quantity") - 25).cast("double").alias("a"), (F.col("l_discount") - 0.05).cast("double").alias("b"))
    return selection.pairwise_fit(d, ["a", "b"], _L2, 5).withColumn("weight", F.round("weight", 6))
