"""More queries of the engine: names and places, walks under steering, replayed rankings and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.functions import text as T
from lodestone.functions.numbers import round_half
from lodestone.operators import evaluation, replay, steering, structure
from lodestone.sources import markdown
from lodestone.sources import views as V

# ---- words and names -------------------------------------------------------------------------------------


_STOPPED = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(V.with_views("files", "lines") + ", c AS (SELECT path, line, regexp_matches(line_text, '(^|[^A-Za-z0-9])[dD][eE][rR]([^A-Za-z0-9]|[A-Z]|$)') AS short, contains(lower(line_text), 'schaft') AS long FROM lines) SELECT * FROM c WHERE short OR long")
def sca_06_fil_05_term_credit(spark, sf):
    t = F.col("line_text")
    return V.lines(spark, sf).select("path", "line", T.credits(t, "der").alias("short"), T.credits(t, "schaft").alias("long")).where("short OR long")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') THEN 0 WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])und($|[^A-Za-z0-9_])') THEN 1 END::INT AS needle FROM conversations")
def sca_07_first_needle(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", T.whole_word_at(F.col("text"), ["the", "und"]).alias("needle"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 400 THEN text ELSE text[:list_max(list_filter(range(0, 401), lambda i: strlen(text[:i]) <= 400))] || '…' END AS snippet FROM documents")
def sca_11_snippet(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(V.with_views("files") + " SELECT path, sha256(path || chr(10) || CASE WHEN strlen(text) <= 4096 THEN text ELSE text[:list_max(list_filter(range(1024, 4097), lambda i: strlen(text[:i]) <= 4096))] END) AS digest FROM files")
def sca_12_rerank_document(spark, sf):
    return V.files(spark, sf).select("path", F.sha2(T.rerank_document(F.col("path"), F.col("text")), 256).alias("digest"))


@query("SELECT page_id, 'open ' || url || ' as ' || page_id::VARCHAR AS filled FROM pages")
def sca_13_template(spark, sf):
    return V.read(spark, sf, "pages").select("page_id", T.fill("open {path} as {code}", path=F.col("url"), code=F.col("page_id").cast("string")).alias("filled"))


_ASKED = "'where do ' || p_name || 's use `' || p_type || '::' || split_part(p_name, ' ', 2) || '()` or `' || p_brand || '` inside'"


def _asked(spark, sf):
    name, kind = F.col("p_name"), F.col("p_type")
    text = F.concat(F.lit("where do "), name, F.lit("s use `"), kind, F.lit("::"), F.split_part(name, F.lit(" "), F.lit(2)), F.lit("()` or `"), F.col("p_brand"), F.lit("` inside"))
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("q"))


@query()
def sca_14_symbol_queries(spark, sf):
    # the table is few megabytes for its rows, so few tasks read it
    asked = _asked(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return asked.select("id", F.array_join(T.symbol_queries(F.col("q")), " ").alias("queries"))


@query("SELECT p_partkey AS id, p_type || '::' || split_part(p_name, ' ', 2) AS names, 1::BIGINT AS rejected, split_part(p_name, ' ', 2) AS needles FROM part WHERE length(split_part(p_name, ' ', 2)) >= 4")
def sca_17_21_code_names(spark, sf):
    rows = _asked(spark, sf).select("id", T.code_names(F.col("q")).alias("n"), F.size(T.code_spans(F.col("q"))).alias("all"), T.literal_needles(F.col("q")).alias("needles"))
    return rows.where(F.size("needles") > 0).select("id", F.array_join("n", " ").alias("names"), (F.col("all") - F.size("n")).cast("long").alias("rejected"), F.array_join("needles", " ").alias("needles"))


@query("SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[:8], ' ') AS tokens FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 6 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.WHY_STOP_WORDS) + ")) AS w FROM conversations)")
def sca_18_why_tokens(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.why_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT p_partkey AS id, p_size % 6 IN (0, 3, 4) AS declares FROM part")
def sca_20_declaration_line(spark, sf):
    lines = ["pub struct Widget {", "let w = Widget::new(1);", "// fn Widget is told of", "impl Shape for Widget {", "func (r *Box) Widget(x int) {", "fn draw(a: Widget) {"]
    line = F.get(F.array(*[F.lit(x) for x in lines]), F.col("p_size") % 6)
    return V.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.declares(line, "Widget").alias("declares"))


@query(V.with_views("files") + " SELECT path, regexp_replace(path, '[.][^./]+$', '') AS module, regexp_extract(path, '([^/]+)[.][^.]+$', 1) AS bare FROM files")
def sca_22_23_24_module_path(spark, sf):
    p = F.col("path")
    return V.files(spark, sf).select("path", F.array_join(T.module_path(p), "/").alias("module"), F.element_at(T.module_path(p), -1).alias("bare"))


@query("SELECT page_id, 'page:' || replace(replace(replace(url, '%', '%25'), ':', '%3A'), '#', '%23') || '#n' || page_id AS node, url AS path, 'n' || page_id AS name FROM pages")
def sca_25_node_codec(spark, sf):
    rows = V.read(spark, sf, "pages").select("page_id", T.node_id(F.lit("page"), F.col("url"), F.concat(F.lit("n"), F.col("page_id"))).alias("node"))
    return rows.withColumn("p", T.node_parts(F.col("node"))).select("page_id", "node", "p.path", "p.name")


@query("SELECT doc_id, 2::BIGINT AS wild, 1::BIGINT AS recursive, -(length(source) + length(lang) + 6)::BIGINT AS literal FROM documents")
def sca_26_specificity(spark, sf):
    pattern = F.concat("source", F.lit("/**/"), "lang", F.lit("-?.md"))
    return V.read(spark, sf, "documents").select("doc_id", T.specificity(pattern).alias("s")).select("doc_id", "s.wild", "s.recursive", "s.literal")


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10))[:3], lambda x: CASE WHEN length(x) > 120 THEN x[:120] || '…' ELSE x END), chr(10)) AS excerpt FROM documents")
def sca_28_excerpt(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), 3, 120).alias("excerpt"))


@query("SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=***' AS url FROM pages")
def sca_29_redaction(spark, sf):
    given = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("token=abc"), "page_id")
    return V.read(spark, sf, "pages").select("page_id", T.redact(given).alias("url"))


@query(V.with_views("edges") + ", c AS (SELECT repeat('part/', 40) || src::VARCHAR AS node, ' | ' || map || ' | p0.50 d' || (conf % 7)::VARCHAR AS tail, site, dst FROM edges) SELECT site, dst, CASE WHEN length(node) + length(tail) <= 160 THEN node ELSE '~' || right(node, (159 - length(tail))::INT) END || tail AS card FROM c")
def sca_31_node_card(spark, sf):
    e = V.edges(spark, sf)
    node = F.concat(F.repeat(F.lit("part/"), 40), F.col("src").cast("string"))
    return e.select("site", "dst", T.node_card(node, F.col("map"), F.lit(0.5), (F.col("conf") % 7).cast("int")).alias("card"))


@query(V.with_views("files") + " SELECT path, CASE WHEN language IN ('de', 'fr') THEN 0.004 ELSE 0.0 END::DOUBLE AS prior FROM files")
def sca_32_role_prior(spark, sf):
    return V.files(spark, sf).select("path", T.role_prior(T.source_role(F.col("path"))).cast("double").alias("prior"))


_TOML_SQL = "keys AS (SELECT p_type AS section, split_part(p_name, ' ', 1) AS key, p_partkey FROM part)"


def _toml(spark, sf):
    """Each type of parts as a section, each part as a key line of one file; sections start at lines of their own."""
    p = V.read(spark, sf, "part").select(F.col("p_type").alias("t"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("k"), "p_partkey", "p_size")
    at = F.crc32(F.col("t").cast("binary")) * 10_000_000
    rows = p.select((at + 1 + F.col("p_partkey")).alias("line"), F.concat(F.when(F.col("p_size") > 25, "# ").otherwise(""), "k", F.lit(" = "), "p_size").alias("text"))
    heads = p.select("t").distinct().select(at.alias("line"), F.concat(F.lit("["), "t", F.lit("]")).alias("text"))
    return rows.unionByName(heads).select(F.concat(F.lit("conf"), (F.floor(F.col("line") / 10_000_000) % 64).cast("string")).alias("path"), "line", "text")


@query(f"WITH {_TOML_SQL} SELECT section, key, count(*) AS n FROM keys GROUP BY ALL")
def sca_36_toml_keys(spark, sf):
    return structure.toml_keys(_toml(spark, sf)).groupBy("section", "key").agg(F.count("*").alias("n"))


@query(f"WITH {_TOML_SQL}, k AS (SELECT DISTINCT section, key FROM keys), a AS (SELECT DISTINCT key AS asked FROM k UNION SELECT DISTINCT section || '.' || key FROM k) SELECT asked, asked AS key_id FROM a WHERE contains(asked, '.') UNION ALL SELECT key, min(section || '.' || key) FROM k GROUP BY key HAVING count(*) = 1")
def add_16_17_key_resolution(spark, sf):
    keys = structure.toml_keys(_toml(spark, sf)).select("section", "key").distinct()
    asked = keys.select(F.col("key").alias("asked")).unionByName(keys.select(F.concat_ws(".", "section", "key").alias("asked"))).distinct()
    return structure.resolve_keys(asked, keys)


@query("SELECT doc_id, w AS term, strlen(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.COMMON_NAMES) + ") AS names FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_#]+'))) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN (" + _STOPPED + ")")
def fil_07_08_usable_terms(spark, sf):
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_#]+")))
    return V.read(spark, sf, "documents").select("doc_id", words.alias("term")).where(T.usable_term(F.col("term"))).withColumn("names", T.usable_name(F.col("term")))


@query(V.with_views("files") + " SELECT path, (regexp_matches(path, '^src1[^/]*/') AND language = 'en' OR NOT path LIKE 'src2/%') AS held FROM files")
def fil_09_10_predicate(spark, sf):
    spec = {"any": [{"all": [{"path_glob": "src1*/**"}, {"kind": "en"}]}, {"not": {"path_glob": "src2/**"}}]}
    return V.files(spark, sf).select("path", F.col("language").alias("kind")).select("path", steering.predicate(spec).alias("held"))


@query("SELECT item_id, bool_or(contains(lower(text), w)) AS leaks FROM benchmark, (SELECT unnest(['the', 'schaft', 'tion']) AS w) GROUP BY item_id")
def fil_15_leaks(spark, sf):
    return V.read(spark, sf, "benchmark").select("item_id", F.exists(F.array(F.lit("the"), F.lit("schaft"), F.lit("tion")), lambda w: F.contains(F.lower("text"), w)).alias("leaks"))


@query(V.with_views("edges") + ", b AS (SELECT src, dst, max_by(map, (conf, map)) AS best, min(site) AS site, bool_or(map = 'exact') AS proven FROM edges GROUP BY ALL) SELECT src, dst, site FROM b WHERE best = 'text' AND NOT proven")
def fil_12_text_proposals(spark, sf):
    best = V.edges(spark, sf).groupBy("src", "dst").agg(F.max_by("map", F.struct("conf", "map")).alias("best"), F.min("site").alias("site"), F.bool_or(F.col("map") == "exact").alias("proven"))
    return best.where("best = 'text' AND NOT proven").select("src", "dst", "site")


@query(V.with_views("files") + " SELECT path, regexp_matches(path, '^src1[0-9]/') AS test, language = 'es' OR language = 'en' AS connective FROM files")
def fil_13_14_units(spark, sf):
    moved = F.regexp_replace("path", "^(src1[0-9])/", "$1/tests/")
    kind = F.when(F.col("language").isin("de", "fr"), "symbol").otherwise("file")
    return V.files(spark, sf).select("path", (T.source_role(F.regexp_replace(moved, r"\.md$", ".rs")) == "test").alias("test"), kind.isin("file", "commit", "key").alias("connective"))


# ---- sources ------------------------------------------------------------------------------------------------


@query(V.with_views("files") + " SELECT path, CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown' END AS adapter FROM files WHERE path NOT LIKE '%.toml' AND path NOT LIKE '%/.git/%'")
def src_01_02_dispatch(spark, sf):
    adapters = F.create_map(*[F.lit(x) for kv in {"rs": "rust", "py": "python", "md": "markdown"}.items() for x in kv])
    rows = V.files(spark, sf).where(~F.contains("path", F.lit("/.git/"))).withColumn("adapter", adapters[T.extension(F.col("path"))])
    return rows.where("adapter IS NOT NULL").select("path", "adapter")


@query()
def src_06_markdown_chunks(spark, sf):
    return markdown.chunks(V.files(spark, sf).select("path", "text"))


@query(V.with_views("files") + " SELECT path, language, content_hash FROM files")
def src_13_projection(spark, sf):
    return V.files(spark, sf).select("path", "language", "content_hash")


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def src_15_25_vector_checks(spark, sf):
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return V.read(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.sqrt(square), 4).alias("norm"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_valid(props)")
def src_22_json_lines(spark, sf):
    return V.read(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("j")).where("j IS NOT NULL").select("event_id", "j.k")


# ---- places and what encloses them ----------------------------------------------------------------------------

_SECONDS = "t AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s FROM events)"
_SPAN_SQL = f"{_SECONDS}, pts AS (SELECT user_id AS key, event_id AS point, s // 60 AS \"at\" FROM t), spans AS (" + " UNION ALL ".join(
    f"SELECT user_id AS key, '{name}' || (s // {w})::VARCHAR AS id, min(s) // 60 AS start, max(s) // 60 AS \"end\" FROM t GROUP BY user_id, s // {w}" for name, w in (("day", 86400), ("hour", 3600))
) + ")"


def _spans(spark, sf):
    """Events as points on a minute axis of each user; the user's active hours and days as nested spans."""
    e = V.read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("point"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("s"))
    at = F.floor(F.col("s") / 60)
    spans = [e.groupBy("key", F.floor(F.col("s") / w).alias("n")).agg(F.min(at).alias("start"), F.max(at).alias("end")).select("key", F.concat(F.lit(name), F.col("n").cast("string")).alias("id"), "start", "end") for name, w in (("day", 86400), ("hour", 3600))]
    return e.select("key", "point", at.alias("at")), spans[0], spans[1]


@query("WITH " + _SPAN_SQL + ", m AS (SELECT key, point, \"at\", id, row_number() OVER (PARTITION BY key, point ORDER BY \"end\" - start, -start, id) AS rn FROM pts JOIN spans USING (key) WHERE \"at\" BETWEEN start AND \"end\") SELECT key, point, \"at\", id FROM m WHERE rn = 1")
def joi_07_13_innermost(spark, sf):
    points, days, hours = _spans(spark, sf)
    return structure.innermost(points, days.unionByName(hours), 1440)


@query("WITH " + _SPAN_SQL + ", m AS (SELECT i.key, i.id, o.id AS parent, row_number() OVER (PARTITION BY i.key, i.id ORDER BY o.\"end\" - o.start, o.id) AS rn FROM spans i JOIN spans o ON i.key = o.key AND o.start <= i.start AND i.\"end\" <= o.\"end\" AND o.\"end\" - o.start > i.\"end\" - i.start) SELECT key, id, parent FROM m WHERE rn = 1")
def joi_08_contains(spark, sf):
    _, days, hours = _spans(spark, sf)
    return structure.enclosing(days.unionByName(hours), 1440)


@query("WITH " + _SPAN_SQL + " SELECT a.key, a.id, b.id AS other FROM spans a JOIN spans b ON a.key = b.key AND a.start <= b.\"end\" AND b.start <= a.\"end\" WHERE a.id LIKE 'hour%' AND b.id LIKE 'day%'")
def joi_12_33_overlap(spark, sf):
    _, days, hours = _spans(spark, sf)
    return structure.overlapping(hours, days, 1440)


@query(V.with_views("files") + ", r AS (SELECT DISTINCT upper(language) || '/' || doc_id::VARCHAR || '.MD' AS reported FROM files) SELECT reported, path FROM r JOIN files ON lower(path) = lower(reported) OR ends_with(lower(path), '/' || lower(reported))")
def joi_03_suffix(spark, sf):
    f = V.files(spark, sf)
    return structure.by_suffix(f.select(F.concat(F.upper("language"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".MD")).alias("reported")).distinct(), f)


@query("WITH h AS (SELECT l_partkey AS symbol, l_suppkey AS unit, count(*) AS held FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY held DESC, unit) AS place FROM h")
def joi_10_11_closure(spark, sf):
    rows = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("unit"), (F.col("l_linenumber") == 1).alias("definition"))
    return structure.ranked_closure(rows)


@query(V.with_views("edges") + ", w AS (SELECT src AS key, dst AS reader, bool_or(map = 'exact') AS a, bool_or(map = 'text') AS b, bool_or(map = 'vector') AS c FROM edges GROUP BY ALL) SELECT key, reader, CASE WHEN a AND b THEN 100 WHEN a THEN 80 WHEN b THEN 35 ELSE 15 END::BIGINT AS conf FROM w WHERE a OR b OR c")
def joi_17_gra_10_key_readers(spark, sf):
    m = F.col("map")
    return structure.key_readers(V.edges(spark, sf).select(F.col("src").alias("key"), F.col("dst").alias("reader"), (m == "exact").alias("closure"), (m == "text").alias("text"), (m == "vector").alias("literal")))


@query(V.with_views("files", "lines") + " SELECT path AS dst, count(*) AS n, min(line) AS first_line, (40 + (least(count(*), 4) - 1) * 10)::BIGINT AS conf FROM lines WHERE contains(lower(line_text), 'license') GROUP BY path")
def joi_18_mentions(spark, sf):
    hits = V.lines(spark, sf).where(F.contains(F.lower("line_text"), F.lit("license"))).select(F.col("path").alias("dst"), "line")
    return structure.mentions(hits, 40, 10)


@query(V.with_views("files", "lines") + ", m AS (SELECT path AS dst, count(*) AS n, min(line) AS first_line, (30 + (least(count(*), 4) - 1) * 5)::BIGINT AS conf FROM lines WHERE contains(lower(line_text), 'the') AND path LIKE '%.md' GROUP BY path) SELECT * FROM m ORDER BY conf DESC, dst LIMIT 200")
def joi_19_docs_mentions(spark, sf):
    rows = V.lines(spark, sf).where((T.source_role(F.col("path")) == "documentation") & F.contains(F.lower("line_text"), F.lit("the")))
    return structure.mentions(rows.select(F.col("path").alias("dst"), "line"), 30, 5, 200)


@query("SELECT l_partkey AS symbol, l_suppkey AS unit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <> 1 AND s_nationkey < 5 GROUP BY ALL")
def joi_20_tested_by(spark, sf):
    rows = V.read(spark, sf, "lineitem").where("l_linenumber <> 1").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("unit")).distinct()
    tests = V.read(spark, sf, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("unit"))
    return rows.join(tests, "unit", "left_semi")


@query(V.with_views("files", "lines", "chunks") + ", d AS (SELECT path, (line - 1) // 7 AS symbol, min(line) AS first_line FROM lines GROUP BY ALL) SELECT d.path, symbol, chunk FROM d JOIN chunks USING (path) WHERE first_line BETWEEN start_line AND end_line")
def joi_04_22_head_chunk(spark, sf):
    """Chunks have a fixed number of lines here, so the chunk of a line is an equality."""
    d = V.lines(spark, sf).groupBy("path", F.floor((F.col("line") - 1) / 7).alias("symbol")).agg(F.min("line").alias("first_line"))
    return d.withColumn("chunk", F.floor((F.col("first_line") - 1) / V.CHUNK_LINES)).join(V.chunks(spark, sf), ["path", "chunk"]).where("first_line BETWEEN start_line AND end_line").select("path", "symbol", "chunk")


@query("WITH " + ", ".join(f"{n} AS (SELECT user_id, event_type, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = '{t}')" for n, t in (("a", "click"), ("b", "view"))) + " SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, a.value AS base, b.value AS cand FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k")
def joi_25_win_17_pairing(spark, sf):
    e = V.read(spark, sf, "events").select("user_id", F.col("ts").alias("at"), "value", "event_type")
    return replay.pair_reports(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"])


_PARENTS = "p AS (SELECT dst, min(src) AS src FROM links GROUP BY dst)"


@query(V.with_views("links", recursive=True) + f", {_PARENTS}, c AS (SELECT p.src, p.dst, 1 AS n FROM p WHERE dst IN (11, 18) UNION SELECT p.src, p.dst, n + 1 FROM c JOIN p ON p.dst = c.src WHERE n < 4) SELECT DISTINCT src, dst FROM c")
def joi_27_trace_labels(spark, sf):
    return structure.labelled_chains(V.hops(spark, sf), spark.createDataFrame([(11,), (18,)], "node long"), 4)


@query("WITH RECURSIVE r AS (SELECT s_suppkey AS was, s_suppkey + 7 AS now, s_suppkey AS at FROM supplier), s AS (SELECT s_suppkey AS path, s_suppkey AS name, -1::BIGINT AS since, 0 AS n FROM supplier UNION ALL SELECT s.path, r.now, r.at, n + 1 FROM s JOIN r ON r.was = s.name AND r.at > s.since WHERE n < 3) SELECT path, max_by(name, n) AS now FROM s GROUP BY path")
def joi_30_renames(spark, sf):
    s = V.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"))
    return structure.follow_renames(s.withColumn("since", F.lit(-1).cast("long")), s.select(F.col("path").alias("was"), (F.col("path") + 7).alias("now"), F.col("path").alias("at")), 3)


@query(V.with_views("edges") + ", known AS (SELECT DISTINCT dst FROM edges WHERE map = 'exact') SELECT e.dst, count(DISTINCT map) AS maps, array_to_string(list_sort(list(DISTINCT map)), ',') AS which FROM edges e JOIN known USING (dst) GROUP BY e.dst")
def joi_31_evidence(spark, sf):
    e = V.edges(spark, sf)
    rows = e.select("dst", "map").distinct().join(e.where("map = 'exact'").select("dst"), "dst", "left_semi")
    return rows.groupBy("dst").agg(F.count("*").alias("maps"), F.array_join(F.array_sort(F.collect_list("map")), ",").alias("which"))


# ---- aggregates ---------------------------------------------------------------------------------------------------


@query(V.with_views("files") + " SELECT source, CASE WHEN path LIKE '%.md' THEN 'documentation' WHEN path LIKE '%.toml' THEN 'configuration' ELSE 'source' END AS role, count(*) AS n FROM files JOIN documents USING (doc_id) GROUP BY ALL")
def agg_15_roles(spark, sf):
    return V.files(spark, sf).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("source"), T.source_role(F.col("path")).alias("role")).agg(F.count("*").alias("n"))


@query(V.with_views("edges") + ", d AS (SELECT dst, count(DISTINCT src) AS df FROM edges GROUP BY dst), n AS (SELECT count(*) AS n FROM d) SELECT dst, round(ln((n + 1) / (df + 1)) / ln(n + 1), 6) AS idf FROM d, n")
def agg_19_idf(spark, sf):
    d = V.edges(spark, sf).groupBy("dst").agg(F.countDistinct("src").alias("df"))
    return d.crossJoin(F.broadcast(d.agg(F.count("*").alias("n")))).select("dst", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) / F.log(F.col("n") + 1), 6).alias("idf"))


@query()
def agg_22_clustered_bootstrap(spark, sf):
    """Whole users are drawn: their means are the units, one row each."""
    means = V.read(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("delta"))
    return evaluation.bootstrap(means.select(F.col("event_type").alias("tag"), "delta"), 100)


@query(V.with_views("edges") + ", t AS (SELECT DISTINCT src, dst FROM edges WHERE map = 'exact') SELECT map, count(*) FILTER (t.src IS NOT NULL) AS confirmed, count(*) FILTER (t.src IS NULL) AS overruled FROM edges e LEFT JOIN t ON t.src = e.src AND t.dst = e.dst WHERE map <> 'exact' GROUP BY map")
def agg_32_arbitration_counts(spark, sf):
    e = V.edges(spark, sf)
    told = e.where("map = 'exact'").select("src", "dst").distinct().withColumn("named", F.lit(True))
    return e.where("map <> 'exact'").join(told, ["src", "dst"], "left").groupBy("map").agg(F.count_if("named").alias("confirmed"), F.count_if(F.col("named").isNull()).alias("overruled"))


@query("SELECT event_type AS kind, ceil(avg(json_extract_string(props, '$.k')::BIGINT))::BIGINT AS tokens FROM events GROUP BY 1")
def agg_34_kind_cost(spark, sf):
    return V.read(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.ceil(F.avg(F.get_json_object("props", "$.k").cast("long"))).cast("long").alias("tokens"))


@query("SELECT source, lang, count(*) AS items, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (source, lang)")
def agg_29_add_31_strata(spark, sf):
    rows = V.read(spark, sf, "documents").join(V.read(spark, sf, "labels"), "doc_id")
    return rows.cube("source", "lang").agg(F.count("*").alias("items"), F.count_if(F.col("quality") == 1).alias("good"))


# ---- walks under steering -------------------------------------------------------------------------------------------

_RULES = [{"when": {"all": [{"witness": ["exact"]}, {"score": {"ge": 90}}]}, "then": {"boost": 4}}, {"when": {"any": [{"score": {"lt": 10}}, {"map": "vector"}]}, "then": {"prune": True}}, {"when": {"depth": {"gt": 5}}, "then": {"prune": True}}]
_FRONTIER_SQL = "f AS (SELECT src, dst, site, map, conf AS score, site % 8 AS depth, CASE WHEN map = 'exact' AND conf >= 90 THEN 0 WHEN conf < 10 OR map = 'vector' THEN 1 WHEN site % 8 > 5 THEN 2 END::INT AS rule FROM edges)"


def _frontier(spark, sf):
    return V.edges(spark, sf).select("src", "dst", "site", "map", F.col("map").alias("witness"), F.col("conf").alias("score"), (F.col("site") % 8).alias("depth"))


@query(V.with_views("edges") + f", {_FRONTIER_SQL} SELECT src, dst, site, score, rule, CASE rule WHEN 0 THEN 'boost' WHEN 1 THEN 'prune' WHEN 2 THEN 'prune' ELSE 'continue' END AS action, CASE rule WHEN 0 THEN 4.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS factor FROM f")
def udf_06_rules(spark, sf):
    return steering.apply_rules(_frontier(spark, sf), _RULES).select("src", "dst", "site", "score", "rule", "action", "factor")


@query(V.with_views("edges") + f", {_FRONTIER_SQL}, h AS (SELECT rule, [map = 'exact' AND score >= 90, score < 10 OR map = 'vector', depth > 5] AS m FROM f), u AS (SELECT rule AS r, unnest([0, 1, 2]) AS rule, unnest(m) AS holds FROM h) SELECT rule::BIGINT AS rule, count(*) FILTER (holds) AS holds, count(*) FILTER (r = rule) AS decides FROM u GROUP BY rule")
def udf_08_idle_rules(spark, sf):
    return steering.idle_rules(_frontier(spark, sf), _RULES)


_POPS_SQL = "pops AS (SELECT user_id AS walk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pop, event_type = 'purchase' AS fresh FROM events)"


@query(f"WITH {_POPS_SQL}, l AS (SELECT *, coalesce(lag(pop) OVER w, 0) AS prev, coalesce(max(CASE WHEN fresh THEN pop END) OVER (PARTITION BY walk ORDER BY pop ROWS UNBOUNDED PRECEDING), 0) AS last_fresh FROM pops WINDOW w AS (PARTITION BY walk ORDER BY pop)) SELECT walk, pop, pop % 10 = 0 AS every_pops, pop * 100 // 2000 > prev * 100 // 2000 AS budget_share, pop = last_fresh + 6 AS stagnation FROM l")
def win_15_stop_triggers(spark, sf):
    e = V.read(spark, sf, "events")
    pop = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return steering.stop_triggers(e.select(F.col("user_id").alias("walk"), pop.alias("pop"), (F.col("event_type") == "purchase").alias("fresh")), 10, 20, 100, 6)


@query(V.with_views("edges") + ", h AS (SELECT src AS walk, dst, max(conf) AS score, count(*) AS edges FROM edges GROUP BY ALL), s AS (SELECT *, (sum(edges * 12) OVER (PARTITION BY walk ORDER BY score DESC, dst ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM h) SELECT * FROM s WHERE spent <= 100")
def win_16_affordable(spark, sf):
    hops = V.edges(spark, sf).groupBy(F.col("src").alias("walk"), "dst").agg(F.max("conf").alias("score"), F.count("*").alias("edges"))
    return steering.affordable(hops, 100)


@query(V.with_views("edges") + ", i AS (SELECT dst, count(DISTINCT src) AS in_seen FROM edges GROUP BY dst) SELECT src, e.dst, site, map, round(CASE map WHEN 'exact' THEN 0.9 WHEN 'heuristic' THEN 0.4 ELSE 0.3 END::DOUBLE * 0.8::DOUBLE * conf / 100 * (1 / (1 + 50 / 100.0::DOUBLE)) * (0.1::DOUBLE + 0.3::DOUBLE * least(greatest(ln(5001.0::DOUBLE / (in_seen + 1)) / ln(5001.0::DOUBLE), 0), 1) + 0.6::DOUBLE * (conf % 3 / 3.0::DOUBLE)), 9) AS score FROM edges e JOIN i USING (dst)")
def rnk_08_hop_score(spark, sf):
    e = V.edges(spark, sf)
    seen = e.groupBy("dst").agg(F.countDistinct("src").alias("in_seen"))
    rows = e.join(seen, "dst").select("src", "dst", "site", "map", F.col("map").alias("witness"), F.lit(0.8).alias("prior"), "conf", F.lit(50.0).alias("cost_ms"), "in_seen", (F.col("conf") % 3 / 3).alias("overlap"))
    return steering.hop_score(rows, 5000).select("src", "dst", "site", "map", "score")


@query(V.with_views("edges") + " SELECT src, dst, site, map, row_number() OVER (PARTITION BY src ORDER BY sha256('7:' || dst::VARCHAR || ':' || site::VARCHAR), map, conf) AS place FROM edges")
def rnk_09_eva_16_random_control(spark, sf):
    """The random control as a seeded order by hash, the same on any number of machines."""
    draw = F.sha2(F.concat(F.lit("7:"), F.col("dst").cast("string"), F.lit(":"), F.col("site").cast("string")), 256)
    return V.edges(spark, sf).select("src", "dst", "site", "map", F.row_number().over(Window.partitionBy("src").orderBy(draw, "map", "conf")).cast("long").alias("place"))


@query(V.with_views("edges") + ", r AS (SELECT src AS item, dst AS node, max(conf) // 10 AS potential, count(DISTINCT map) AS n_maps, count(*) AS fanout, min(site) AS found FROM edges GROUP BY ALL), t AS (SELECT *, round(0.5::DOUBLE * n_maps + -0.25::DOUBLE * ln(1 + fanout), 9) AS tie FROM r) SELECT item, node, tie, row_number() OVER (PARTITION BY item ORDER BY potential DESC, tie DESC, found, node) AS place FROM t")
def srt_08_10_tie_break(spark, sf):
    rows = V.edges(spark, sf).groupBy(F.col("src").alias("item"), F.col("dst").alias("node")).agg(F.floor(F.max("conf") / 10).alias("potential"), F.countDistinct("map").alias("n_maps"), F.count("*").alias("fanout"), F.min("site").alias("found"))
    return steering.tie_break(rows, {"n_maps": 0.5, "fanout": -0.25}).select("item", "node", "tie", "place")


_STAGES_SQL = "a AS (SELECT src AS query, dst AS node, min(site) AS rank FROM edges WHERE map = 'text' GROUP BY ALL), w AS (SELECT src AS query, dst AS node, min(site) AS rank FROM edges WHERE map = 'exact' GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, node) AS n FROM a QUALIFY n <= 3), b AS (SELECT w.*, row_number() OVER (PARTITION BY w.query ORDER BY w.rank, w.node) AS n FROM w ANTI JOIN f ON f.query = w.query AND f.node = w.node QUALIFY n <= 5), u AS (SELECT query, node, n, 0 AS list FROM f UNION ALL SELECT query, node, n, 1 FROM b)"


def _stages(spark, sf, mode):
    of = lambda m: V.edges(spark, sf).where(F.col("map") == m).groupBy(F.col("src").alias("query"), F.col("dst").alias("node")).agg(F.min("site").alias("rank"))
    return steering.merge_stages(of("text"), of("exact"), mode, 3, 5)


@query(V.with_views("edges") + f", {_STAGES_SQL}, p AS (SELECT query, node, CASE list WHEN 0 THEN 'first' ELSE 'walk' END AS origin, row_number() OVER (PARTITION BY query ORDER BY n, list) AS place FROM u) SELECT * FROM p WHERE place <= 5")
def win_13_first_stage_merge(spark, sf):
    return _stages(spark, sf, "interleave")


@query(V.with_views("edges") + f", {_STAGES_SQL} SELECT query, count(*) FILTER (list = 0) AS first, count(*) FILTER (list = 1) AS walk FROM u GROUP BY query")
def agg_30_origins(spark, sf):
    return _stages(spark, sf, "append").groupBy("query").agg(F.count_if(F.col("origin") == "first").alias("first"), F.count_if(F.col("origin") == "walk").alias("walk"))


# ---- rankings and their replay ------------------------------------------------------------------------------------------

_POOL_SQL = "pool AS (SELECT source AS query, lang AS file, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a_rank, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS b_rank, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS r FROM documents), fused AS (SELECT *, round(1.0::DOUBLE / (60 + a_rank) + 0.7::DOUBLE / (60 + b_rank), 9) AS fusion FROM pool)"


def _pool(spark, sf):
    by = lambda *o: F.row_number().over(Window.partitionBy("source").orderBy(*o)).cast("long")
    key = F.col("doc_id").cast("string")
    rows = V.read(spark, sf, "documents").select("source", "lang", "doc_id", by(F.desc("n_chars"), "doc_id").alias("a_rank"), by(F.sha2(key, 256)).alias("b_rank"), by(F.md5(key.cast("binary"))).alias("r"))
    rows = rows.select(F.col("source").alias("query"), F.col("lang").alias("file"), F.col("doc_id").alias("item"), "a_rank", "b_rank", "r")
    return rows.withColumn("recorded", round_half(1.0 / (60 + F.col("a_rank")) + 0.7 / (60 + F.col("b_rank")), 9)).withColumn("rerank_rank", F.when(F.col("r") <= 12, F.col("r")))


@query(f"WITH {_POOL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY query, file ORDER BY fusion DESC, item) AS nth FROM fused), c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (nth > 2)::INT, fusion DESC, item) AS cut FROM n) SELECT query, item, fusion, true AS verified, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN cut <= 24 THEN round(fusion + coalesce(CASE WHEN r <= 12 THEN 0.5::DOUBLE / (60 + r) END, 0), 9) END DESC NULLS LAST, cut) AS place FROM c")
def eva_04_rnk_12_replay(spark, sf):
    return replay.refuse(_pool(spark, sf), {"a": 1.0, "b": 0.7}, 60, 24, 2, 0.5)


@query(f"WITH {_POOL_SQL}, s AS (SELECT query, item, fusion, CASE WHEN query <> 'src3' THEN 1.0::DOUBLE / r END AS score, row_number() OVER (PARTITION BY query ORDER BY fusion DESC, item) AS rank FROM fused) SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, rank) AS place FROM s")
def rnk_11_rerank_replace(spark, sf):
    p = _pool(spark, sf)
    ranked = p.select("query", "item", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("recorded"), "item")).alias("rank"))
    return replay.reranked(ranked, p.where("query <> 'src3'").select("query", "item", (1.0 / F.col("r")).alias("score")))


@query(f"WITH {_POOL_SQL}, a AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY (file <> 'en')::INT, a_rank) AS rank FROM pool) SELECT * FROM a")
def add_01_02_lanes(spark, sf):
    p = _pool(spark, sf).select("query", "item", "file", F.col("a_rank").alias("rank"))
    return replay.lane([p.where("file = 'en'"), p.where("file <> 'en'")])


@query(f"WITH {_POOL_SQL}, f AS (SELECT query, file, min(a_rank) AS best FROM pool GROUP BY ALL) SELECT query, file, best, row_number() OVER (PARTITION BY query ORDER BY best) AS file_rank FROM f")
def win_09_file_rank(spark, sf):
    f = _pool(spark, sf).groupBy("query", "file").agg(F.min("a_rank").alias("best"))
    return f.withColumn("file_rank", F.row_number().over(Window.partitionBy("query").orderBy("best")).cast("long"))


@query(f"WITH {_POOL_SQL}, h AS (SELECT query, min(a_rank) FILTER (file = 'de') AS first FROM pool GROUP BY query) SELECT query, count(*) FILTER (file = 'fr' AND a_rank < coalesce(first, 1000000)) AS before FROM pool JOIN h USING (query) GROUP BY query")
def win_08_disfavoured(spark, sf):
    w = Window.partitionBy("query")
    rows = _pool(spark, sf).withColumn("first", F.coalesce(F.min(F.when(F.col("file") == "de", F.col("a_rank"))).over(w), F.lit(1000000)))
    return rows.groupBy("query").agg(F.count_if((F.col("file") == "fr") & (F.col("a_rank") < F.col("first"))).alias("before"))


@query(f"WITH {_POOL_SQL}, g AS (SELECT query, 'de' AS slot, 2 AS gain FROM (SELECT DISTINCT query FROM pool) UNION ALL SELECT query, 'fr', 1 FROM (SELECT DISTINCT query FROM pool)), m AS (SELECT query, file AS slot, min(a_rank) AS rank FROM pool WHERE a_rank <= 10 AND file IN ('de', 'fr') GROUP BY ALL) SELECT g.query, round(sum(coalesce(gain / log2(rank + 1), 0)) / (2 / log2(2) + 1 / log2(3)), 6) AS ndcg10 FROM g LEFT JOIN m USING (query, slot) GROUP BY g.query")
def win_10_graded_ndcg(spark, sf):
    p = _pool(spark, sf)
    slots = F.explode(F.array(F.struct(F.lit("de").alias("slot"), F.lit(2).alias("gain")), F.struct(F.lit("fr").alias("slot"), F.lit(1).alias("gain"))))
    gold = p.select("query").distinct().select("query", slots.alias("s")).select("query", "s.slot", "s.gain")
    return replay.graded(p.select("query", F.col("a_rank").alias("rank"), "item", F.when(F.col("file").isin("de", "fr"), F.col("file")).alias("slot")), gold)


@query(f"WITH {_POOL_SQL}, t AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY fusion DESC, item) AS place, count(*) OVER (PARTITION BY query) AS pool FROM fused) SELECT query, item, place, pool > 24 AS cut_short FROM t WHERE place <= 8")
def srt_05_07_window(spark, sf):
    of = Window.partitionBy("query")
    rows = _pool(spark, sf).withColumn("place", F.row_number().over(of.orderBy(F.desc("recorded"), "item")).cast("long")).withColumn("cut_short", F.count("*").over(of) > 24)
    return rows.where("place <= 8").select("query", "item", "place", "cut_short")


@query(f"WITH {_POOL_SQL} SELECT query, max(fusion) FILTER (k = 5) AS fifth FROM (SELECT query, fusion, row_number() OVER (PARTITION BY query ORDER BY fusion DESC) AS k FROM fused) GROUP BY query")
def srt_09_kth(spark, sf):
    k = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("recorded")))
    return _pool(spark, sf).withColumn("k", k).where("k <= 5").groupBy("query").agg(F.max(F.when(F.col("k") == 5, F.col("recorded"))).alias("fifth"))


@query(f"WITH {_POOL_SQL}, x AS (SELECT query, item, fusion, file = 'en' AS good, round(fusion, 4) AS tie FROM fused) SELECT g.query, g.item AS better, b.item AS worse, round(g.fusion - b.fusion, 9) AS delta FROM x g JOIN x b ON g.query = b.query AND g.tie = b.tie AND g.good AND NOT b.good")
def add_28_tie_pairs(spark, sf):
    x = _pool(spark, sf).select("query", "item", F.col("recorded").alias("fusion"), (F.col("file") == "en").alias("good"), round_half(F.col("recorded"), 4).alias("tie"))
    g = x.where("good").select("query", "tie", F.col("item").alias("better"), F.col("fusion").alias("x"))
    b = x.where("NOT good").select("query", "tie", F.col("item").alias("worse"), F.col("fusion").alias("y"))
    return g.join(b, ["query", "tie"]).select("query", "better", "worse", F.round(F.col("x") - F.col("y"), 9).alias("delta"))


@query("WITH a AS (SELECT user_id AS item, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS item, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT count(*) AS n, round(avg(b.v - a.v), 6) AS mean, count(*) FILTER (b.v > a.v) AS wins, count(*) FILTER (b.v < a.v) AS losses FROM a JOIN b USING (item)")
def eva_03_12_compare(spark, sf):
    of = lambda t, n: V.read(spark, sf, "events").where(F.col("event_type") == t).groupBy(F.col("user_id").alias("item")).agg(F.max("value").alias(n))
    rows = of("click", "a").join(of("view", "b"), "item")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("mean"), F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"))


@query("SELECT c_nationkey AS wave, c_mktsegment AS set, min(c_custkey) AS row FROM customer WHERE c_nationkey >= 5 GROUP BY ALL")
def eva_11_add_43_trend(spark, sf):
    c = V.read(spark, sf, "customer").select(F.col("c_nationkey").alias("wave"), F.col("c_mktsegment").alias("set"), F.col("c_custkey").alias("row"))
    c = c.groupBy("wave", "set").agg(F.min("row").alias("row"))
    return replay.new_rows(c.where("wave < 5"), c, ["wave", "set"]).select("wave", "set", "row")


@query(V.with_views("files") + " SELECT f.path, CASE WHEN f.path LIKE 'src5/%' THEN 'gone' WHEN f.language = 'de' THEN 'changed' ELSE 'fresh' END AS state FROM files f")
def add_20_21_verify_on_read(spark, sf):
    f = V.files(spark, sf)
    tree = f.where(~F.col("path").startswith("src5/")).select("path", F.when(F.col("language") == "de", F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("now"))
    state = F.when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("content_hash"), "changed").otherwise("fresh")
    return f.select("path", "content_hash").join(tree, "path", "left").select("path", state.alias("state"))


@query("SELECT event_type AS arm, median(value) AS p50, quantile_disc(value, 0.95) AS p95, count(DISTINCT user_id) AS calls, count(*) FILTER (value < 1) AS failures FROM events GROUP BY 1")
def add_30_arm_costs(spark, sf):
    return V.read(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(F.median("value").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.countDistinct("user_id").alias("calls"), F.count_if(F.col("value") < 1).alias("failures"))


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9_#]+'))) AS term FROM documents), d AS (SELECT term, count(*) AS files, min(doc_id) AS first_seen FROM w WHERE length(term) >= 6 GROUP BY term) SELECT term, files, row_number() OVER (ORDER BY files, first_seen, term) AS place FROM d ORDER BY place LIMIT 100")
def add_36_agent_frontier(spark, sf):
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_#]+")))
    d = V.read(spark, sf, "documents").select("doc_id", words.alias("term")).where(F.length("term") >= 6).groupBy("term").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_seen"))
    top = d.orderBy("files", "first_seen", "term").limit(100)
    return top.select("term", "files", F.row_number().over(Window.orderBy("files", "first_seen", "term")).cast("long").alias("place"))


@query("SELECT user_id, sha256('{' || array_to_string(list(k ORDER BY k), ',') || '}') AS profile FROM (SELECT DISTINCT user_id, '\"' || event_type || '\":1' AS k FROM events) GROUP BY user_id")
def add_40_profile_hash(spark, sf):
    k = V.read(spark, sf, "events").select("user_id", F.concat(F.lit('"'), "event_type", F.lit('":1')).alias("k")).distinct()
    return k.groupBy("user_id").agg(F.sha2(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("k")), ","), F.lit("}")), 256).alias("profile"))


@query("SELECT DISTINCT path, line, col FROM (SELECT l_orderkey AS path, l_linenumber AS line, l_partkey AS col FROM lineitem)")
def add_04_symbol_order(spark, sf):
    return V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("col")).distinct()


@query(V.with_views("files", "lines", "chunks") + " SELECT language, count(DISTINCT path) AS files, count(*) AS chunks, max(n_lines) AS longest FROM chunks JOIN files USING (path) GROUP BY language")
def add_06_status(spark, sf):
    return V.chunks(spark, sf).join(V.files(spark, sf).select("path", "language"), "path").groupBy("language").agg(F.countDistinct("path").alias("files"), F.count("*").alias("chunks"), F.max("n_lines").alias("longest"))
