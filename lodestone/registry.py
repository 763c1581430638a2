"""Every query of the engine: name -> function of (spark, sf_dir), and the same as DuckDB SQL.

Names begin with the inventory row they cover, such as rnk_02 or joi_14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import QUERIES, SQL, query  # noqa: F401 - readers of the catalogue import it from here
from lodestone.functions import text as T
from lodestone.operators import evaluation, graph, incremental, lexical, names, ranking, traversal
from lodestone.plans.steps import run_plan
from lodestone.sources import views as V
from lodestone.streaming import events as E

def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- lexical search --------------------------------------------------------------------------------

_TERMS = [(1, "theaere", 0), (1, "anthese", 1), (1, "thion", 2), (2, "ération", 0), (2, "onthe", 1), (2, "ement", 2), (3, "license", 0), (3, "version", 1), (3, "schaft", 2)]
_TERMS_SQL = "terms(query_id, term, ord) AS (VALUES " + ", ".join(f"({q}, '{t}', {o})" for q, t, o in _TERMS) + ")"
_HITS_SQL = "hits AS (SELECT query_id, term, ord, path, line FROM lines JOIN terms ON contains(lower(line_text), term))"
_KEPT_SQL = """n AS (SELECT count(DISTINCT path) AS n_files FROM lines),
df AS (SELECT query_id, term, ord, count(DISTINCT path) AS df FROM hits GROUP BY ALL),
c AS (SELECT *, df > 0.25 * n_files AS common, min((df > 0.25 * n_files)::INT) OVER (PARTITION BY query_id) = 1 AS all_common FROM df, n),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, ord) AS rn FROM c WHERE NOT common OR all_common),
kept AS (SELECT query_id, term, df, ln((n_files - df + 0.5) / (df + 0.5) + 1) AS idf FROM k WHERE rn <= 12)"""


def _terms(spark) -> DataFrame:
    return spark.createDataFrame(_TERMS, "query_id int, term string, ord int")


@query(V.with_views("files", "lines", "chunks") + f", {_TERMS_SQL}, {_HITS_SQL}, {_KEPT_SQL}, " + """
tf AS (SELECT query_id, term, path, (line - 1) // 20 AS chunk, count(*) AS tf FROM hits GROUP BY ALL),
a AS (SELECT avg(greatest(n_lines, 1)::DOUBLE) AS avg_lines FROM chunks),
s AS (SELECT query_id, path, chunk, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(n_lines, 1) / avg_lines))), 6) AS score
      FROM tf JOIN kept USING (query_id, term) JOIN chunks USING (path, chunk), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, chunk) AS rank FROM s)
SELECT query_id, path, chunk, score, rank FROM r WHERE rank <= 8""")
def rnk_02_bm25(spark, sf):
    return lexical.bm25(V.lines(spark, sf), V.chunks(spark, sf), _terms(spark))


@query(V.with_views("files", "lines") + f", {_TERMS_SQL}, {_HITS_SQL}, {_KEPT_SQL} SELECT query_id, term, df, round(idf, 6) AS idf FROM kept")
def fil_06_df_cut(spark, sf):
    rows = V.lines(spark, sf)
    kept = lexical.scoring_terms(lexical.credited(rows, _terms(spark)), rows.agg(F.countDistinct("path").alias("n_files")))
    return kept.withColumn("idf", F.round("idf", 6))


@query(V.with_views("files", "lines") + f", {_TERMS_SQL}, {_HITS_SQL} SELECT query_id, term, count(DISTINCT path) AS df FROM hits GROUP BY ALL")
def agg_01_document_frequency(spark, sf):
    return lexical.credited(V.lines(spark, sf), _terms(spark)).groupBy("query_id", "term").agg(F.countDistinct("path").alias("df"))


@query(V.with_views("files", "lines") + f", {_TERMS_SQL}, {_HITS_SQL} SELECT path, (line - 1) // 20 AS chunk, count(*) AS credits, count(DISTINCT line) AS credited_lines FROM hits GROUP BY ALL")
def agg_02_term_frequency(spark, sf):
    return lexical.credited(V.lines(spark, sf), _terms(spark)).groupBy("path", F.floor((F.col("line") - 1) / 20).alias("chunk")).agg(F.count("*").alias("credits"), F.countDistinct("line").alias("credited_lines"))


@query(V.with_views("files", "lines", "chunks") + " SELECT round(avg(greatest(n_lines, 1)), 6) AS avg_lines FROM chunks")
def agg_03_average_length(spark, sf):
    return V.chunks(spark, sf).agg(F.round(F.avg(F.greatest("n_lines", F.lit(1))), 6).alias("avg_lines"))


@query(V.with_views("files", "lines") + " SELECT path, count(*) AS n_lines, sum(contains(lower(line_text), 'license')::BIGINT)::BIGINT AS hits FROM lines GROUP BY path")
def src_10_line_matches(spark, sf):
    return V.lines(spark, sf).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.contains(F.lower("line_text"), F.lit("license")).cast("long")).alias("hits"))


@query(V.with_views("files", "lines") + """, m AS (SELECT path, line, instr(line_text, 'License') AS col FROM lines WHERE contains(line_text, 'License')),
r AS (SELECT *, row_number() OVER (ORDER BY path, line) AS place FROM m) SELECT path, line, col::BIGINT AS col, place FROM r WHERE place <= 50""")
def src_11_live_grep(spark, sf):
    hits = V.lines(spark, sf).where(F.contains("line_text", F.lit("License"))).select("path", "line", F.instr("line_text", "License").cast("long").alias("col"))
    return hits.orderBy("path", "line").limit(50).withColumn("place", F.row_number().over(Window.orderBy("path", "line")).cast("long"))


# ---- text and paths --------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short, sha256(text) || chr(31) || source AS vkey FROM documents")
def sca_08_09_10_hashes(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("digest"), T.short_hash(F.col("text")).alias("short"), T.vector_key(T.content_hash(F.col("text")), F.col("source")).alias("vkey"))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_#]+'), lambda w: w <> ''), ' ') AS words FROM documents""")
def sca_04_words(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.array_join(T.split_words(F.col("text")), " ").alias("words"))


@query()
def sca_01_02_03_05_tokenizers(spark, sf):
    q = F.col("text")
    return V.read(spark, sf, "benchmark").select("item_id", T.query_terms(q).alias("terms"), T.symbol_terms(q).alias("symbols"), T.question_terms(q).alias("question"), T.split_identifier(F.lit("parseHTTPHeader2_fast")).alias("parts"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 400 THEN 'whole' ELSE 'cut' END AS kind, strlen(text) // 4 AS est_tokens, ceil(length(text) / 4.0)::BIGINT AS sim_tokens FROM documents")
def sca_11_27_sizes(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.when(F.octet_length("text") <= 400, "whole").otherwise("cut").alias("kind"), F.floor(F.octet_length("text") / 4).alias("est_tokens"), F.ceil(F.length("text") / 4).alias("sim_tokens"))


@query("SELECT event_id, round(least(greatest(value / 50, 0), 1) * 100)::INT AS pct, round(least(greatest(ln(p / (1 - p)), -3), 3), 6) AS logit, round(0.2 + 0.8 * p, 6) AS factor FROM (SELECT *, least(greatest(value / 100, 1e-6), 1 - 1e-6) AS p FROM events)")
def sca_15_33_34_scores(spark, sf):
    e = V.read(spark, sf, "events")
    p = F.least(F.greatest(F.col("value") / 100, F.lit(1e-6)), F.lit(1 - 1e-6))
    return e.select("event_id", T.percent(F.col("value") / 50).alias("pct"), F.round(T.capped_logit(p), 6).alias("logit"), F.round(T.relevance_factor(p, 0.2), 6).alias("factor"))


@query(V.with_views("files") + """ SELECT path, CASE WHEN regexp_matches(path, '\\.md$') THEN 'documentation' WHEN regexp_matches(path, '\\.toml$') THEN 'configuration' ELSE 'source' END AS role,
lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files""")
def fil_03_source_role(spark, sf):
    return V.files(spark, sf).select("path", T.source_role(F.col("path")).alias("role"), T.extension(F.col("path")).alias("ext"))


@query(V.with_views("files") + " SELECT path, language FROM files WHERE language IN ('en', 'de') AND (regexp_matches(path, '^src1[^/]*/.*$') OR regexp_matches(path, '^src[0-3]/.*\\.rs$')) AND NOT regexp_matches(path, '^src11/.*$')")
def fil_01_02_request_filter(spark, sf):
    f = V.files(spark, sf)
    p = F.col("path")
    return f.where(F.col("language").isin("en", "de") & T.matches_any(p, ["src1*/**", "src[0-3]/**/*.rs"]) & ~T.matches_any(p, ["src11/**"])).select("path", "language")


@query(V.with_views("files") + " SELECT path FROM files WHERE CASE WHEN (SELECT count(*) FROM files WHERE language = 'en') > 0 THEN language = 'en' ELSE true END")
def fil_04_lane_split(spark, sf):
    f = V.files(spark, sf)
    lane = f.agg((F.count_if(F.col("language") == "en") > 0).alias("has_code"))
    return f.crossJoin(F.broadcast(lane)).where(~F.col("has_code") | (F.col("language") == "en")).select("path")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('s1' || doc_id::VARCHAR), 1, 16))::UBIGINT % 100 < 30")
def fil_16_hold_out(spark, sf):
    return V.read(spark, sf, "documents").where(evaluation.in_hold_out(F.col("doc_id").cast("string"), 30, "s1")).select("doc_id")


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, url LIKE '%?%' AS has_query FROM pages")
def sca_16_paths(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"), F.contains("url", F.lit("?")).alias("has_query"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(when|who).*(creat|add|introduc)') THEN 'creation' WHEN regexp_matches(lower(text), 'last (chang|modif)') THEN 'last' WHEN regexp_matches(lower(text), '\\bwhy\\b') THEN 'why' ELSE 'other' END AS kind FROM conversations")
def sca_19_question_kind(spark, sf):
    low = F.lower("text")
    kind = F.when(low.rlike("(when|who).*(creat|add|introduc)"), "creation").when(low.rlike("last (chang|modif)"), "last").when(low.rlike(r"\bwhy\b"), "why").otherwise("other")
    return V.read(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def sca_30_timestamps(spark, sf):
    return V.read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query(V.with_views("files", "lines", "chunks") + " SELECT path, chunk, start_line, end_line, n_lines FROM chunks")
def src_05_chunks(spark, sf):
    return V.chunks(spark, sf).select("path", "chunk", "start_line", "end_line", "n_lines")


@query(V.with_views("files") + " SELECT DISTINCT language FROM files")
def src_16_languages(spark, sf):
    return V.files(spark, sf).select("language").distinct()


@query(V.with_views("files") + " SELECT path, language, content_hash FROM files WHERE path = 'src7/en/7.md'")
def src_14_point_lookup(spark, sf):
    return V.files(spark, sf).where(F.col("path") == "src7/en/7.md").select("path", "language", "content_hash").limit(1)


@query("SELECT count(*) FILTER (text LIKE '<?xml%' OR text LIKE '<TS %') AS skipped, count(*) FILTER (contains(text, chr(65533))) AS lossy, count(*) AS parsed FROM documents")
def src_03_04_agg_31_scan_counters(spark, sf):
    t = F.ltrim("text")
    return V.read(spark, sf, "documents").agg(F.count_if(t.startswith("<?xml") | t.startswith("<TS ")).alias("skipped"), F.count_if(F.contains("text", F.lit("�"))).alias("lossy"), F.count("*").alias("parsed"))


# ---- vectors, fusion, windows ------------------------------------------------------------------------

_KNN_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id, label, round(list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""


def _knn(spark, sf, k, where="true"):
    e = V.read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return ranking.nearest(q, e.where(where).select("vec_id", F.col("embedding").alias("v")), k)


@query(f"WITH {_KNN_SQL} SELECT query_id, rank, vec_id, score FROM knn WHERE rank <= 10")
def srt_01_win_01_exact_knn(spark, sf):
    return _knn(spark, sf, 10)


@query(f"WITH {_KNN_SQL}, f AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE label < 4) SELECT query_id, rank, vec_id, score FROM f WHERE rank <= 10")
def srt_02_filtered_knn(spark, sf):
    return _knn(spark, sf, 10, "label < 4")


_CHANNELS = "a AS (SELECT doc_id, source AS file, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, source AS file, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR)) AS rank FROM documents), c AS (SELECT doc_id, source AS file, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents)"
_FUSED = _CHANNELS + ", f AS (SELECT doc_id, file, round(sum(s), 9) AS score, array_to_string(list_sort(list(DISTINCT ch)), ',') AS channels FROM (SELECT doc_id, file, 'a' AS ch, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT doc_id, file, 'b', 0.7::DOUBLE / (60 + rank) FROM b UNION ALL SELECT doc_id, file, 'c', 1.0::DOUBLE / (60 + rank) FROM c) GROUP BY ALL)"


def _channel(spark, sf, *order):
    d = V.read(spark, sf, "documents").select("doc_id", F.col("source").alias("file"), "n_chars", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return ranking.ranked(d, "rank", *order).select("doc_id", "file", "rank")


def _channels(spark, sf):
    return {"a": (_channel(spark, sf, F.desc("n_chars"), "doc_id"), 1.0), "b": (_channel(spark, sf, "h"), 0.7), "c": (_channel(spark, sf, "n_chars", "doc_id"), 1.0)}


def _fused(spark, sf):
    return ranking.fuse(_channels(spark, sf), ["doc_id", "file"])


@query(f"WITH {_FUSED} SELECT * FROM f")
def rnk_01_joi_01_rrf(spark, sf):
    return _fused(spark, sf)


@query(f"WITH {_FUSED}, r AS (SELECT doc_id, file, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) AS nth FROM r) SELECT doc_id, file, score, rank, row_number() OVER (ORDER BY (nth > 2)::INT, rank) AS capped_rank, row_number() OVER (ORDER BY (nth > 2)::INT, rank) <= 24 AS shortlisted FROM n")
def win_03_05_srt_04_cap(spark, sf):
    r = ranking.ranked(_fused(spark, sf), "rank", F.desc("score"), "doc_id").drop("channels")
    return ranking.cap_per_file(r, 2).withColumn("shortlisted", F.col("capped_rank") <= 24)


@query(f"WITH {_CHANNELS}, u AS (SELECT doc_id, rank AS turn, 0 AS list FROM a UNION ALL SELECT doc_id, rank, 1 FROM b UNION ALL SELECT doc_id, rank, 2 FROM c), m AS (SELECT doc_id, min(turn * 10 + list) AS place FROM u GROUP BY 1) SELECT doc_id, row_number() OVER (ORDER BY place) AS pos FROM m QUALIFY pos <= 30")
def win_12_interleave(spark, sf):
    return ranking.interleave([d.select("doc_id", "rank") for d, _ in _channels(spark, sf).values()], "doc_id", 30)


@query(f"WITH {_CHANNELS} SELECT doc_id FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b) AND file IN (SELECT file FROM c)")
def set_02_03_sets(spark, sf):
    ch = {k: d for k, (d, _) in _channels(spark, sf).items()}
    return ranking.intersect(ranking.minus(ch["a"], [ch["b"]], "doc_id"), [ch["c"]], "file").select("doc_id")


@query(f"WITH {_CHANNELS}, u AS (SELECT doc_id, 0 AS list, rank AS pos FROM a UNION ALL SELECT doc_id, 1, rank FROM b UNION ALL SELECT doc_id, 2, rank FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list, pos) AS rn FROM u) SELECT doc_id, list::BIGINT AS list, pos FROM r WHERE rn = 1")
def set_01_05_06_union_ordered(spark, sf):
    return ranking.union_ordered([d.select("doc_id", F.col("rank").alias("pos")) for d, _ in _channels(spark, sf).values()], "doc_id")


@query(f"WITH {_CHANNELS}, w(source, weight) AS (VALUES ('a', 1.0::DOUBLE), ('b', 0.5::DOUBLE), ('c', 0.25::DOUBLE)), d AS (SELECT doc_id AS item, 'a' AS source, (3 - rank / 10.0)::DOUBLE AS logit FROM a UNION ALL SELECT doc_id, 'b', (3 - rank / 10.0)::DOUBLE FROM b UNION ALL SELECT doc_id, 'c', (3 - rank / 10.0)::DOUBLE FROM c), i AS (SELECT DISTINCT item FROM d) SELECT i.item, round(sum(w.weight * coalesce(d.logit, -3)), 6) AS score FROM i CROSS JOIN w LEFT JOIN d ON d.item = i.item AND d.source = w.source GROUP BY 1")
def rnk_07_log_odds(spark, sf):
    said = None
    for name, (d, _) in _channels(spark, sf).items():
        part = d.select(F.col("doc_id").alias("item"), F.lit(name).alias("source"), (3 - F.col("rank") / 10.0).alias("logit"))
        said = part if said is None else said.unionByName(part)
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.25)], "source string, weight double")
    return ranking.log_odds(said.select("item").distinct(), said, weights)


@query(V.with_views("files") + " SELECT path, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) - 1 AS ordinal FROM files")
def win_04_ordinal(spark, sf):
    return V.files(spark, sf).select("path", "content_hash", (F.row_number().over(Window.partitionBy("content_hash").orderBy("doc_id")) - 1).cast("long").alias("ordinal"))


@query("SELECT event_id, user_id, sum(cast(json_extract_string(props, '$.k') AS BIGINT)) OVER w::BIGINT AS tokens, sum(cast(json_extract_string(props, '$.k') AS BIGINT)) OVER w > 2000 AS stopped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def win_14_cumulative(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    k = F.get_json_object("props", "$.k").cast("long")
    return V.read(spark, sf, "events").select("event_id", "user_id", F.sum(k).over(w).alias("tokens"), (F.sum(k).over(w) > 2000).alias("stopped"))


@query("SELECT event_id, list_sort(list(value) OVER w)[(len(list(value) OVER w) // 2) + 1] AS p50 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)")
def agg_33_rolling_p50(spark, sf):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-63, 0)
    seen = F.array_sort(F.collect_list("value").over(w))
    return V.read(spark, sf, "events").select("event_id", F.get(seen, F.floor(F.size(seen) / 2).cast("int")).alias("p50"))


# ---- edges and graph ------------------------------------------------------------------------------------


@query(V.with_views("edges") + ", b AS (SELECT src, dst, map, max(conf) AS c FROM edges GROUP BY ALL) SELECT src, dst, CASE WHEN max(c) >= 100 THEN 100 ELSE round((1 - exp(sum(ln(1 - least(c, 99) / 100.0)))) * 100, 6) END::DOUBLE AS conf, count(*) AS maps FROM b GROUP BY ALL")
def agg_04_06_noisy_or(spark, sf):
    return graph.noisy_or(V.edges(spark, sf))


@query(V.with_views("edges") + " SELECT src, dst, map, conf, site FROM edges QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY conf DESC, map, site) = 1")
def agg_05_best_edge(spark, sf):
    return graph.best_edge(V.edges(spark, sf))


@query(V.with_views("edges") + " SELECT src, dst, map, conf, site, row_number() OVER (PARTITION BY src ORDER BY conf DESC, dst, map, site) AS place FROM edges QUALIFY place <= 16")
def srt_06_win_18_top_edges(spark, sf):
    return graph.top_edges(V.edges(spark, sf), 16)


@query(V.with_views("edges") + ", t AS (SELECT DISTINCT src, dst FROM edges WHERE map = 'exact'), a AS (SELECT src FROM t GROUP BY src HAVING count(*) < 256) SELECT e.src, e.dst, e.map, e.conf, e.site FROM edges e LEFT JOIN a ON a.src = e.src LEFT JOIN t ON t.src = e.src AND t.dst = e.dst WHERE e.map = 'text' AND (a.src IS NULL OR t.src IS NOT NULL)")
def fil_11_arbitration(spark, sf):
    return graph.arbitrate(V.edges(spark, sf), "exact", "text")


@query(V.with_views("commit_files") + """, z AS (SELECT commit, day, count(*) AS n FROM commit_files GROUP BY ALL ORDER BY day DESC, commit DESC LIMIT 500),
r AS (SELECT c.commit, c.file FROM commit_files c JOIN z USING (commit) WHERE n <= 30), p AS (SELECT file, count(*) AS of_a FROM r GROUP BY 1),
t AS (SELECT x.file AS a, y.file AS b, count(*) AS together FROM r x JOIN r y ON x.commit = y.commit AND x.file <> y.file GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, together, greatest(1, least(90, floor(90 * together / (of_a + 1))))::BIGINT AS conf FROM t JOIN p ON p.file = a""")
def joi_14_co_change(spark, sf):
    return graph.co_change(V.commit_files(spark, sf))


@query(V.with_views("commit_files") + " SELECT file, commit, 100 - (row_number() OVER (PARTITION BY file ORDER BY day DESC, commit DESC) - 1) AS conf FROM commit_files QUALIFY row_number() OVER (PARTITION BY file ORDER BY day DESC, commit DESC) <= 20")
def joi_15_touched_by(spark, sf):
    return graph.touched_by(V.commit_files(spark, sf))


@query(V.with_views("commit_files") + ", n AS (SELECT commit, count(*) AS n FROM commit_files GROUP BY 1) SELECT commit, file, CASE WHEN n <= 8 THEN 100 ELSE greatest(10, least(100, floor(800 / n))) END::BIGINT AS conf FROM commit_files JOIN n USING (commit)")
def joi_16_touches(spark, sf):
    return graph.touches(V.commit_files(spark, sf))


@query(V.with_views("commit_files") + " SELECT file, count(*) AS commits FROM commit_files GROUP BY file")
def agg_16_churn(spark, sf):
    return V.commit_files(spark, sf).groupBy("file").agg(F.count("*").alias("commits"))


@query(V.with_views("edges") + " SELECT dst, count(DISTINCT src) AS callers FROM edges GROUP BY dst")
def agg_17_in_degree(spark, sf):
    return V.edges(spark, sf).groupBy("dst").agg(F.countDistinct("src").alias("callers"))


@query(V.with_views("edges") + " SELECT src, dst, count(*) AS sites, bool_and(map = 'text') AS all_text, min(site) AS first_site FROM edges GROUP BY ALL")
def agg_18_07_call_pairs(spark, sf):
    return V.edges(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("sites"), F.bool_and(F.col("map") == "text").alias("all_text"), F.min("site").alias("first_site"))


@query(V.with_views("edges") + ", f AS (SELECT map, count(DISTINCT dst) AS n FROM edges GROUP BY 1 ORDER BY n DESC, map LIMIT 2), m AS (SELECT count(*) AS again FROM (SELECT dst FROM edges WHERE map IN (SELECT map FROM f) GROUP BY dst HAVING count(DISTINCT map) = 2)) SELECT round(CASE WHEN again > 0 THEN (SELECT min(n) * max(n) FROM f)::DOUBLE / again END, 6) AS estimate FROM m")
def agg_08_mark_recapture(spark, sf):
    pairs = V.edges(spark, sf).select("map", "dst").distinct()
    two = pairs.groupBy("map").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "map").limit(2)
    again = pairs.join(F.broadcast(two), "map").groupBy("dst").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") == 2).alias("again"))
    return two.agg((F.min("n") * F.max("n")).alias("prod")).crossJoin(again).select(F.round(F.when(F.col("again") > 0, F.col("prod").cast("double") / F.col("again")), 6).alias("estimate"))


@query(V.with_views("files") + " SELECT source AS region, count(*) AS seen, count(*) FILTER (lang = 'en') AS explored FROM documents GROUP BY source ORDER BY seen DESC, region LIMIT 8")
def agg_09_regions(spark, sf):
    d = V.read(spark, sf, "documents").groupBy(F.col("source").alias("region")).agg(F.count("*").alias("seen"), F.count_if(F.col("lang") == "en").alias("explored"))
    return d.orderBy(F.desc("seen"), "region").limit(8)


@query(V.with_views("edges") + " SELECT DISTINCT dst FROM edges WHERE map IN ('text', 'vector') AND dst NOT IN (SELECT dst FROM edges WHERE map = 'exact' AND conf > 90)")
def agg_10_disagreements(spark, sf):
    e = V.edges(spark, sf)
    return e.where(F.col("map").isin("text", "vector")).select("dst").distinct().join(e.where((F.col("map") == "exact") & (F.col("conf") > 90)).select("dst"), "dst", "left_anti")


@query(V.with_views("edges") + " SELECT map, count(*) AS edges, count(DISTINCT src) AS calls, (count(*) * 12)::BIGINT AS tokens FROM edges GROUP BY map")
def agg_11_map_statistics(spark, sf):
    return V.edges(spark, sf).groupBy("map").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("calls"), (F.count("*") * 12).alias("tokens"))


def _seed(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


_REACH = "{name} AS (SELECT {seed}::BIGINT AS node, 0 AS hops UNION SELECT {to}, hops + 1 FROM {name} JOIN links ON {at} = node WHERE hops < {depth})"


@query(V.with_views("links", recursive=True) + ", " + _REACH.format(name="r", seed=8, to="dst", at="src", depth=3) + " SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node")
def gra_05_reach(spark, sf):
    return graph.reach(V.hops(spark, sf), _seed(spark, 8), 3)


@query(V.with_views("links", recursive=True) + ", " + _REACH.format(name="r", seed=11, to="src", at="dst", depth=3) + " SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node")
def gra_06_reverse_reach(spark, sf):
    return graph.reach(graph.reverse(V.hops(spark, sf)), _seed(spark, 11), 3)


@query(V.with_views("links") + ", r1 AS (SELECT DISTINCT src AS node FROM links WHERE dst = 18), r2 AS (SELECT DISTINCT src AS node FROM links WHERE dst IN (SELECT node FROM r1)) SELECT node, 1::BIGINT AS ring FROM r1 WHERE node <> 18 UNION ALL SELECT node, 2 FROM r2 WHERE node <> 18 AND node NOT IN (SELECT node FROM r1)")
def gra_08_rings(spark, sf):
    return graph.rings(V.hops(spark, sf), _seed(spark, 18))


@query(V.with_views("links", recursive=True) + ", " + _REACH.format(name="r", seed=8, to="dst", at="src", depth=4) + ", " + _REACH.format(name="b", seed=12, to="src", at="dst", depth=4) + ", x AS (SELECT node, min(r.hops) AS hops, min(r.hops) + min(b.hops) AS whole FROM r JOIN b USING (node) GROUP BY node) SELECT node, hops::BIGINT AS hops FROM x WHERE whole = (SELECT min(whole) FROM x)")
def gra_07_shortest_paths(spark, sf):
    return graph.on_shortest_paths(V.hops(spark, sf), _seed(spark, 8), _seed(spark, 12), 4)


_PR_STEP = "r{i} AS MATERIALIZED (SELECT p.node, 0.15 * p.p + 0.85 * (coalesce(sum(l.rank / l.n), 0) + any_value(lost) * p.p) AS rank FROM p LEFT JOIN (SELECT dst, rank, n FROM links JOIN o ON links.src = o.src JOIN r{j} ON r{j}.node = links.src) l ON l.dst = p.node, (SELECT coalesce(sum(rank), 0) AS lost FROM r{j} WHERE node NOT IN (SELECT src FROM o)) GROUP BY p.node, p.p)"


@query(V.with_views("links") + ", o AS (SELECT src, count(*) AS n FROM links GROUP BY 1), nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links UNION SELECT 8 UNION SELECT 16), p AS (SELECT node, CASE WHEN node IN (8, 16) THEN 0.5 ELSE 0 END::DOUBLE AS p FROM nodes), r0 AS (SELECT node, p AS rank FROM p), " + ", ".join(_PR_STEP.format(i=i, j=i - 1) for i in (1, 2, 3)) + " SELECT node, round(rank, 9) AS rank FROM r3")
def rnk_05_pagerank(spark, sf):
    jump = spark.createDataFrame([(8, 0.5), (16, 0.5)], "node long, p double")
    return graph.pagerank(V.links(spark, sf), jump, 3).select("node", F.round("rank", 9).alias("rank"))


@query(V.with_views("links") + ", a AS (SELECT DISTINCT src AS node FROM links WHERE dst = 18 AND src <> 18), b AS (SELECT DISTINCT dst AS node FROM links WHERE src IN (8, 24) AND dst NOT IN (8, 24)) SELECT 3::BIGINT AS step, node FROM (SELECT node FROM a UNION SELECT node FROM b)")
def gra_12_plan(spark, sf):
    links = V.hops(spark, sf)
    names = links.select(F.col("src").alias("node"), F.concat(F.lit("n"), F.col("src")).alias("name")).distinct()
    return run_plan([{"op": "closure", "of": [18]}, {"op": "reach", "of": [8, 24], "depth": 1}, {"op": "union", "of": "$s1", "with": ["$s2"]}], links, names)


# ---- joins over snapshots and ranges -------------------------------------------------------------------

_SNAP = "old AS (SELECT path, content_hash FROM files WHERE path NOT LIKE 'src3/%'), new AS (SELECT path, CASE WHEN language = 'de' THEN sha256(text || 'x') ELSE content_hash END AS content_hash FROM files WHERE path NOT LIKE 'src5/%')"


def _snapshots(spark, sf):
    f = V.files(spark, sf)
    new = f.where(~F.col("path").startswith("src5/")).select("path", F.when(F.col("language") == "de", F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return f.where(~F.col("path").startswith("src3/")).select("path", "content_hash"), new


@query(V.with_views("files") + f", {_SNAP} SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.content_hash = new.content_hash THEN 'same' ELSE 'changed' END AS state FROM old FULL JOIN new ON old.path = new.path")
def joi_05_29_snapshot_diff(spark, sf):
    return incremental.diff(*_snapshots(spark, sf))


@query(V.with_views("files") + f", {_SNAP} SELECT DISTINCT content_hash FROM new WHERE content_hash NOT IN (SELECT content_hash FROM old)")
def joi_06_str_05_missing_vectors(spark, sf):
    old, new = _snapshots(spark, sf)
    return incremental.missing_keys(new, old, "content_hash")


@query("""SELECT e.event_id, max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY 1""")
def joi_28_as_of(spark, sf):
    """Latest order of a user before each event: one ordered pass over both sides, no pairs."""
    e = V.read(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_id", F.lit(None).cast("long").alias("o"))
    o = V.read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy(F.col("t"), F.col("event_id").isNotNull(), F.col("o")).rowsBetween(Window.unboundedPreceding, 0)
    rows = e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w))
    return rows.where("event_id IS NOT NULL AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@query(V.with_views("files", "lines", "chunks") + ", m AS (SELECT path, line FROM lines WHERE contains(lower(line_text), 'license')) SELECT m.path, m.line, c.chunk, c.start_line FROM m JOIN chunks c ON c.path = m.path AND m.line BETWEEN c.start_line AND c.end_line")
def joi_02_line_to_chunk(spark, sf):
    hits = V.lines(spark, sf).where(F.contains(F.lower("line_text"), F.lit("license"))).select("path", "line")
    c = V.chunks(spark, sf)
    joined = hits.join(c, "path").where("line BETWEEN start_line AND end_line")
    first = Window.partitionBy("path", "line").orderBy("chunk")
    return joined.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("path", "line", "chunk", "start_line")


# ---- evaluation ---------------------------------------------------------------------------------------------

_GOLD = f"{_KNN_SQL}, t AS (SELECT knn.*, label = (SELECT label FROM embeddings x WHERE x.vec_id = query_id) AS hit FROM knn), g AS (SELECT x.vec_id AS query_id, n - 1 AS n_gold FROM embeddings x JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label) WHERE x.vec_id % 20 = 0)"


@query(f"""WITH {_GOLD}, m AS (SELECT query_id, min(rank) FILTER (hit) AS first, sum(CASE WHEN hit AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (hit AND rank <= 3) AS n3, count(*) FILTER (hit AND rank <= 8) AS n8 FROM t WHERE rank <= 20 GROUP BY 1)
SELECT query_id, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS rr, coalesce((first <= 1)::BIGINT, 0) AS hit1, coalesce((first <= 3)::BIGINT, 0) AS hit3, coalesce((first <= 8)::BIGINT, 0) AS hit8, round(n3 / n_gold, 6)::DOUBLE AS recall3, round(n8 / n_gold, 6)::DOUBLE AS recall8, round(dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10 FROM m JOIN g USING (query_id) WHERE n_gold > 0""")
def eva_01_win_07_11_metrics(spark, sf):
    e = V.read(spark, sf, "embeddings").select("vec_id", "label")
    own = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    ranked = _knn(spark, sf, 20).join(e, "vec_id").join(own, "query_id").withColumn("hit", F.col("label") == F.col("own"))
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_gold"))
    gold = own.join(sizes, F.col("label") == F.col("own")).select("query_id", "n_gold")
    return evaluation.query_metrics(ranked, gold)


@query("SELECT event_type, median(value) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top, count(*) AS n FROM events GROUP BY event_type")
def agg_14_percentiles(spark, sf):
    return V.read(spark, sf, "events").groupBy("event_type").agg(F.median("value").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("top"), F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def agg_12_13_by_tag(spark, sf):
    V.read(spark, sf, "events").createOrReplaceTempView("lodestone_events")
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM lodestone_events GROUP BY GROUPING SETS ((event_type), ())")


@query("SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 6) AS intercept, round(coalesce(regr_r2(value, user_id), 0), 6) AS r2 FROM events GROUP BY event_type")
def agg_24_ols(spark, sf):
    y, x = F.col("value"), F.col("user_id")
    return V.read(spark, sf, "events").groupBy("event_type").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.coalesce(F.regr_r2(y, x), F.lit(0.0)), 6).alias("r2"))


@query("SELECT lang, k, n, round((p + z2 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n), 6) AS high FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS p, 1.959963984540054 ** 2 AS z2 FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def agg_25_wilson(spark, sf):
    rows = V.read(spark, sf, "documents").join(V.read(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", low.alias("low"), high.alias("high"))


@query("SELECT lang, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE round(tp / (tp + fn), 6) END::DOUBLE AS recall FROM (SELECT lang, count(*) FILTER (n_chars > 500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 500 AND quality = 0) AS fp, count(*) FILTER (n_chars <= 500 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)")
def agg_27_set_metrics(spark, sf):
    long, good = F.col("n_chars") > 500, F.col("quality") == 1
    rows = V.read(spark, sf, "documents").join(V.read(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.count_if(long & good).alias("tp"), F.count_if(long & ~good).alias("fp"), F.count_if(~long & good).alias("fn"))
    ratio = lambda other, none: F.when(F.col("tp") + F.col(other) == 0, none).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col(other)), 6))
    return rows.select("lang", ratio("fp", 0.0).alias("precision"), ratio("fn", 1.0).alias("recall"))


@query(f"WITH {_CHANNELS}, b2 AS (SELECT a.doc_id, a.rank AS x, d.n_chars % 97 * 1000 + d.doc_id AS y FROM a JOIN documents d USING (doc_id) WHERE a.rank <= 40) SELECT round(sum(sign((q.y - p.y)::DOUBLE)) / count(*), 6)::DOUBLE AS tau, count(*) AS n FROM b2 p JOIN b2 q ON p.x < q.x")
def agg_28_kendall(spark, sf):
    a = _channels(spark, sf)["a"][0].where("rank <= 40")  # two short result lists, as the measure is for
    d = V.read(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 97 * 1000 + F.col("doc_id")).alias("rank"))
    return evaluation.kendall(a.select(F.col("doc_id").alias("item"), "rank"), a.select("doc_id").join(d, "doc_id").select(F.col("doc_id").alias("item"), "rank"))


@query("WITH r AS (SELECT event_type AS type, user_id % 5 AS map, count(*) AS n, count(*) FILTER (value > 20) AS k FROM events GROUP BY ALL), w AS (SELECT *, (k + 4 * 0.3) / (n + 4) AS raw, sum(k) OVER (PARTITION BY type) AS any_k FROM r), t AS (SELECT *, max(raw) OVER (PARTITION BY type) AS top FROM w) SELECT type, map, round(raw / top, 6)::DOUBLE AS prior FROM t WHERE any_k > 0")
def agg_20_prior_fit(spark, sf):
    trials = V.read(spark, sf, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 5).alias("map"), (F.col("value") > 20).alias("hit"))
    return evaluation.prior_fit(trials, 0.3, 4)


@query()
def agg_21_bootstrap(spark, sf):
    # paired differences by day: all events, summed up before the shuffle, one row per type and day
    d = V.read(spark, sf, "events").groupBy(F.col("event_type").alias("tag"), F.to_date("ts").alias("day")).agg((F.avg("value") - 20).alias("delta")).select("tag", "delta")
    return evaluation.bootstrap(d, 200)


@query("SELECT lang, round(avg(sign((n_chars - 1500)::DOUBLE)), 6) AS mean, count(*) FILTER (n_chars > 1500) AS wins, count(*) FILTER (n_chars < 1500) AS losses, count(*) FILTER (n_chars = 1500) AS ties FROM documents GROUP BY lang")
def agg_23_win_loss(spark, sf):
    n = F.col("n_chars")
    return V.read(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(F.signum((n - 1500).cast("double"))), 6).alias("mean"), F.count_if(n > 1500).alias("wins"), F.count_if(n < 1500).alias("losses"), F.count_if(n == 1500).alias("ties"))


# ---- event time ----------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str_tumbling_windows(spark, sf):
    return E.tumbling(V.read(spark, sf, "events"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, sid")
def str_sessions(spark, sf):
    return E.sessions(V.read(spark, sf, "events"))


# ---- scored traversal and names ---------------------------------------------------------------------------------

_HOP = "s{i} AS (SELECT node, max(p) AS p FROM (SELECT l.dst AS node, round(s.p * conf / 100, 12) AS p FROM s{j} s JOIN l ON l.src = s.node) GROUP BY node)"
_LINK_CONF = "l AS (SELECT src, dst, 40 + (src * 7 + dst * 13) % 60 AS conf FROM links)"


@query(V.with_views("links") + f", {_LINK_CONF}, s0 AS (SELECT unnest([8, 16])::BIGINT AS node, 1.0::DOUBLE AS p), " + ", ".join(_HOP.format(i=i, j=i - 1) for i in (1, 2, 3)) + ", a AS (" + " UNION ALL ".join(f"SELECT node, p, {i} AS hops FROM s{i}" for i in range(4)) + "), b AS (SELECT node, max(p) AS potential FROM a GROUP BY node), r AS (SELECT b.node, min(hops)::BIGINT AS hops, potential FROM b JOIN a ON a.node = b.node AND a.p = b.potential GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY potential DESC, node) AS place FROM r) SELECT * FROM o WHERE place <= 64")
def gra_01_03_04_best_first(spark, sf):
    links = V.links(spark, sf).withColumn("conf", 40 + (F.col("src") * 7 + F.col("dst") * 13) % 60)
    return traversal.best_first(links, spark.createDataFrame([(8,), (16,)], "node long"), 3, 64)


@query(V.with_views("edges") + ", t AS (SELECT DISTINCT src, dst FROM edges WHERE map = 'exact'), p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY conf DESC, dst, site) AS place FROM edges WHERE map = 'text'), r AS (SELECT p.*, CASE WHEN place <= 5 AND EXISTS (FROM t WHERE t.src = p.src AND t.dst = p.dst) THEN 'confirmed' WHEN place <= 5 AND p.src IN (SELECT src FROM t) THEN 'refuted' ELSE 'open' END AS label FROM p) SELECT src, dst, site, CASE WHEN label = 'confirmed' THEN greatest(conf, 90) ELSE conf END AS conf, label FROM r WHERE label <> 'refuted'")
def gra_16_confirmation(spark, sf):
    return traversal.confirm(V.edges(spark, sf), "text", "exact", 5)


@query(V.with_views("edges") + " SELECT src, dst, count(DISTINCT map) AS maps, round(max(conf) / 100 * (1 + 0.1::DOUBLE * (count(DISTINCT map) - 1)), 6) AS score FROM edges GROUP BY ALL")
def rnk_10_corroboration(spark, sf):
    return traversal.corroborate(V.edges(spark, sf))


@query(V.with_views("edges") + ", r AS (SELECT src, dst, map, row_number() OVER (PARTITION BY src, map ORDER BY max(conf) DESC, dst) AS rank FROM edges GROUP BY src, dst, map), s AS (SELECT src, dst, CASE WHEN map IN ('text', 'vector') THEN 'words' ELSE map END AS source, min(rank) AS rank, max(CASE map WHEN 'exact' THEN 1.0 WHEN 'heuristic' THEN 0.5 WHEN 'text' THEN 0.7 ELSE 0.6 END)::DOUBLE AS w FROM r GROUP BY ALL) SELECT src, dst, round(sum(w / (2 + rank)), 9) AS score FROM s GROUP BY ALL")
def rnk_06_source_rrf(spark, sf):
    return traversal.source_rrf(V.edges(spark, sf), {"exact": ("exact", 1.0), "heuristic": ("heuristic", 0.5), "text": ("words", 0.7), "vector": ("words", 0.6)})


@query(V.with_views("edges") + ", s AS (SELECT src, dst, map, site, round(CASE map WHEN 'exact' THEN 0.9 WHEN 'text' THEN 0.3 ELSE 0.5 END::DOUBLE * conf, 6) AS strength FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY strength DESC, site, map) AS rn FROM s) SELECT src, dst, map, site, strength FROM r WHERE rn = 1")
def add_15_rnk_15_collapse(spark, sf):
    return traversal.collapse(V.edges(spark, sf), spark.createDataFrame([("exact", 0.9), ("text", 0.3)], "map string, prior double"))


@query("WITH q AS (SELECT unnest(['ECONOMY', 'promo']) AS query), m AS (SELECT query, p_partkey AS id, (p_type <> query)::BIGINT AS class FROM part JOIN q ON lower(p_type) = lower(query)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY class, id) AS place FROM m) SELECT * FROM r WHERE place <= 20")
def rnk_13_declared(spark, sf):
    rows = V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return names.declared(rows, spark.createDataFrame([("ECONOMY",), ("promo",)], "query string"), 20)


@query("WITH t AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS t FROM part), d AS (SELECT w, count(*) FILTER (list_contains(t, w)) AS df, count(*) AS n FROM t, (SELECT unnest(['cold', 'widget', 'zeppelin']) AS w) GROUP BY w), i AS (SELECT w, CASE WHEN df > 0 THEN ln(1 + n / df) ELSE 0 END AS idf FROM d) SELECT id, count(*) FILTER (list_contains(t, w)) AS shared, round(count(*) FILTER (list_contains(t, w)) / 3, 6) AS plain, round(coalesce(sum(idf) FILTER (list_contains(t, w)), 0) / sum(idf), 6) AS weighted FROM t, i GROUP BY id HAVING shared > 0")
def rnk_04_add_13_14_overlap(spark, sf):
    return names.overlap(V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "cold widget zeppelin")


@query(V.with_views("commit_files") + ", m AS (SELECT commit, count(DISTINCT p_name) AS matched, max(day) AS day FROM commit_files JOIN part ON file = p_partkey WHERE p_name IN ('cold widget', 'small widget', 'large bolt') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY matched DESC, day DESC, commit) AS place FROM m) SELECT commit, matched, place FROM r WHERE place <= 50")
def rnk_14_history(spark, sf):
    p = V.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("token"))
    return names.history(V.commit_files(spark, sf).join(p, "file"), ["cold widget", "small widget", "large bolt"], 50)


@query(V.with_views("files", "lines", "chunks") + " SELECT path, language, count(*) AS chunks FROM chunks JOIN files USING (path) GROUP BY ALL")
def add_05_indexed_files(spark, sf):
    return V.chunks(spark, sf).groupBy("path").agg(F.count("*").alias("chunks")).join(V.files(spark, sf).select("path", "language"), "path")


@query("SELECT p_partkey AS id, array_to_string(list_filter([l, upper(l[1]) || l[2:], upper(p_type), p_type], lambda x, i: list_position([l, upper(l[1]) || l[2:], upper(p_type), p_type], x) = i), ' ') AS spellings FROM (SELECT *, lower(p_type) AS l FROM part)")
def add_37_spellings(spark, sf):
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(names.spellings(F.col("p_type")), " ").alias("spellings"))


@query("SELECT doc_id, len(i) AS n, array_to_string(i, ' ') AS identifiers FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS i FROM documents)")
def add_35_identifiers(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", names.identifiers(F.col("text")).alias("i")).select("doc_id", F.size("i").cast("long").alias("n"), F.array_join("i", " ").alias("identifiers"))


from lodestone import registry_choice, registry_nodes, registry_search  # noqa: E402,F401 - their queries enter the same catalogue
