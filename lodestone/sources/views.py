"""Relational views of the fixture tables: the corpus as files, lines and chunks, and a graph of typed edges.

Each view has the same definition as DuckDB SQL in SQL, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_LINES = 20
TASK_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".py").otherwise(".toml")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.sha2("text", 256).alias("content_hash"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line_text")).select("path", (F.col("pos") + 1).cast("long").alias("line"), "line_text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("chunk", F.floor((F.col("line") - 1) / CHUNK_LINES))
    return rows.groupBy("path", "chunk").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("n_lines"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that touch parts."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # dealt by the order, of a fixed number of rows a task, for the distinct rows, the join and what counts by commit
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS)
    li = rows.repartition(n, "l_orderkey").distinct()
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"), F.col("o_orderdate").cast("date").alias("day"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges part -> supplier, one of each order line; its flags say which of four maps found it. Confidence 1..100."""
    conf = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100 + 1).cast("long")
    kind = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "exact").otherwise("heuristic")).when(F.col("l_returnflag") == "N", "text").otherwise("vector")
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), kind.alias("map"), conf.alias("conf"), F.col("l_orderkey").alias("site"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer -> order -> part -> supplier -> nation -> customer of the whole tables; node() numbers the nodes."""
    return hops(spark, sf_dir).distinct()


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges as often as the tables have them, for operators that need no distinct ones: no shuffle of all edges."""
    steps = (("orders", "o_custkey", 0, "o_orderkey", 1), ("lineitem", "l_orderkey", 1, "l_partkey", 2), ("lineitem", "l_partkey", 2, "l_suppkey", 3), ("supplier", "s_suppkey", 3, "s_nationkey", 4), ("customer", "c_nationkey", 4, "c_custkey", 0))
    parts = [read(spark, sf_dir, t).select(node(a, i).alias("src"), node(b, j).alias("dst")) for t, a, i, b, j in steps]
    return reduce(DataFrame.unionByName, parts)


def node(key: str, kind: int) -> Column:
    """Node of a key: kinds are 0 customer, 1 order, 2 part, 3 supplier, 4 nation."""
    return F.col(key).cast("long") * 8 + kind


SQL = {
    "files": "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.rs' WHEN 'fr' THEN '.py' ELSE '.toml' END AS path, lang AS language, sha256(text) AS content_hash, text FROM documents)",
    "lines": "lines AS (SELECT path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS line_text FROM (SELECT path, string_split(text, chr(10)) AS p FROM files))",
    "chunks": "chunks AS (SELECT path, (line - 1) // 20 AS chunk, min(line) AS start_line, max(line) AS end_line, count(*) AS n_lines FROM lines GROUP BY ALL)",
    "commit_files": "commit_files AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "edges": "edges AS (SELECT l_partkey AS src, l_suppkey AS dst, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'exact' ELSE 'heuristic' END WHEN l_returnflag = 'N' THEN 'text' ELSE 'vector' END AS map, ((l_orderkey * 7 + l_linenumber) % 100 + 1)::BIGINT AS conf, l_orderkey AS site FROM lineitem)",
    "links": "links AS MATERIALIZED (SELECT o_custkey::BIGINT * 8 AS src, o_orderkey::BIGINT * 8 + 1 AS dst FROM orders UNION SELECT l_orderkey::BIGINT * 8 + 1, l_partkey::BIGINT * 8 + 2 FROM lineitem UNION SELECT l_partkey::BIGINT * 8 + 2, l_suppkey::BIGINT * 8 + 3 FROM lineitem UNION SELECT s_suppkey::BIGINT * 8 + 3, s_nationkey::BIGINT * 8 + 4 FROM supplier UNION SELECT c_nationkey::BIGINT * 8 + 4, c_custkey::BIGINT * 8 FROM customer)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names)
