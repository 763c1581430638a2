"""Places and what encloses them: range joins by bins, reported paths, mentions, closures, witnesses of configuration keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import small, stored


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins of `width` that start..end (whole numbers, inclusive) touches."""
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def innermost(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Adds to each point (key, at, ...) the id of the shortest span (key, id, start, end) that holds it; ties to the later start, then the lesser id.

    Points and spans meet in bins of the key, so that a key with many of both is dealt over its bins. Points outside all spans are left out.
    """
    s = spans.withColumn("bin", bins(F.col("start"), F.col("end"), width))
    met = points.withColumn("bin", F.floor(F.col("at") / width)).join(s, ["key", "bin"]).where("at BETWEEN start AND end")
    order = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("later"), F.col("id").alias("id"))
    return met.groupBy("key", "at", "point").agg(F.min(order).alias("best")).select("key", "point", "at", F.col("best.id").alias("id"))


def enclosing(spans: DataFrame, width: int) -> DataFrame:
    """(key, id, parent): the shortest span that strictly holds each span; spans without one are left out."""
    inner = spans.withColumn("bin", F.floor(F.col("start") / width))
    outer = spans.select("key", F.col("id").alias("parent"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("bin", bins(F.col("s"), F.col("e"), width))
    held = inner.join(outer, ["key", "bin"]).where("s <= start AND end <= e AND e - s > end - start")
    return held.groupBy("key", "id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("size"), F.col("parent").alias("parent"))).alias("best")).select("key", "id", F.col("best.parent").alias("parent"))


def overlapping(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs (key, id, other) of spans (key, id, start, end) that share a place, once each."""
    a = left.withColumn("bin", bins(F.col("start"), F.col("end"), width))
    b = right.select("key", F.col("id").alias("other"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("bin", bins(F.col("s"), F.col("e"), width))
    # a pair meets in the first bin that both touch
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("s") / width))
    return a.join(b, ["key", "bin"]).where((F.col("bin") == first) & (F.col("s") <= F.col("end")) & (F.col("start") <= F.col("e"))).select("key", "id", "other")


def suffixes(path: Column) -> Column:
    """The path and what follows each of its slashes, in lower case."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def by_suffix(reported: DataFrame, files: DataFrame) -> DataFrame:
    """(reported, path): a file is meant by its path or by any suffix of it after a slash, in any case."""
    ends = files.select("path", F.explode(suffixes(F.col("path"))).alias("ends"))
    return reported.select("reported", F.lower("reported").alias("ends")).join(ends, "ends").select("reported", "path")


def mentions(hits: DataFrame, base: int, step: int, most: int | None = None) -> DataFrame:
    """(dst, n, first_line, conf) of live matches (dst, line): conf rises by `step` for each match up to the fourth. most: of all, the strongest."""
    n = F.count("*")
    rows = hits.groupBy("dst").agg(n.alias("n"), F.min("line").alias("first_line"), (base + (F.least(n, F.lit(4)) - 1) * step).cast("long").alias("conf"))
    return rows if most is None else rows.orderBy(F.desc("conf"), "dst").limit(most)


def ranked_closure(occurrences: DataFrame) -> DataFrame:
    """(symbol, unit, held, place): units that hold uses of a symbol, most uses first. occurrences: (symbol, unit, definition)."""
    held = occurrences.where("NOT definition").groupBy("symbol", "unit").agg(F.count("*").alias("held"))
    order = Window.partitionBy("symbol").orderBy(F.desc("held"), "unit")
    return held.withColumn("place", F.row_number().over(order).cast("long"))


def key_readers(found: DataFrame) -> DataFrame:
    """(key, reader, conf): confidence by which witnesses saw the reader. found: (key, reader, closure, text, literal) booleans."""
    seen = found.groupBy("key", "reader").agg(*[F.bool_or(c).alias(c) for c in ("closure", "text", "literal")])
    conf = F.when(F.col("closure") & F.col("text"), 100).when(F.col("closure"), 80).when(F.col("text"), 35).when(F.col("literal"), 15)
    return seen.withColumn("conf", conf.cast("long")).where("conf IS NOT NULL").select("key", "reader", "conf")


def toml_keys(lines: DataFrame) -> DataFrame:
    """(path, section, key, line) of the key lines of configuration files; lines: (path, line, text). A commented key counts."""
    head = F.regexp_extract("text", r"^\s*\[+([^\]]+)\]+", 1)
    here = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.coalesce(F.last(F.when(head != "", head), ignorenulls=True).over(here), F.lit("")))
    key = F.regexp_extract("text", r"^\s*#?\s*([A-Za-z0-9_-]+)\s*=", 1)
    return rows.withColumn("key", key).where("key <> ''").select("path", "section", "key", "line")


def resolve_keys(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(asked, key_id): section.key as written; a bare name only if one section alone has it. keys: (section, key)."""
    k = keys.select("section", "key").distinct().withColumn("key_id", F.concat_ws(".", F.when(F.col("section") != "", F.col("section")), "key"))
    bare = k.groupBy("key").agg(F.count("*").alias("n"), F.min("key_id").alias("key_id")).where("n = 1").select(F.col("key").alias("asked"), "key_id")
    exact = asked.join(k.select("key_id").withColumn("asked", F.col("key_id")), "asked").select("asked", "key_id")
    return exact.unionByName(asked.join(bare, "asked").select("asked", "key_id")).distinct()


def labelled_chains(links: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """(src, dst): the hops on the chains that lead up from gold nodes, each node by the least src of its links. At most `depth` rounds.

    Only the links of the nodes of a round are grouped; links may repeat.
    """
    front, out = stored(gold.select(F.col("node").alias("dst")).distinct()), None
    for _ in range(depth):
        hop = stored(links.join(small(front), "dst", "left_semi").groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst"))
        out = hop if out is None else out.unionByName(hop)
        front = hop.select(F.col("src").alias("dst")).distinct()
    return out.distinct()


def follow_renames(paths: DataFrame, renames: DataFrame, rounds: int) -> DataFrame:
    """(path, now): each path followed through later renames (was, now, at), an earlier name only by a rename after the last one."""
    state = paths.select("path", F.col("path").alias("name"), F.col("since").alias("since"))
    r = renames.select("was", F.col("now").alias("next"), "at")
    for _ in range(rounds):
        met = state.join(r, (F.col("name") == F.col("was")) & (F.col("at") > F.col("since")), "left")
        first = met.groupBy("path", "name", "since").agg(F.min(F.struct("at", "next")).alias("step"))
        state = first.select("path", F.coalesce(F.when(F.col("step.at").isNotNull(), F.col("step.next")), F.col("name")).alias("name"), F.coalesce("step.at", "since").alias("since"))
    return state.select("path", F.col("name").alias("now"))
