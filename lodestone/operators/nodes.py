"""Node names and what is known of nodes: symbol descriptors, aliases, stamps of files, commit cards, gold of a run, spelled paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import stored

NAME = r"(?:`[^`]+`|[A-Za-z0-9_+$-]+)"
RACY_SECONDS = 3  # fixed value: a younger stamp can hide a second write


def descriptors(symbol: Column) -> Column:
    """Array of (name, is_type) of a symbol `scheme manager package version descriptors`, owners first; null if it has none.

    A type parameter list after `impl` stands for its first parameter, the implementing type; an `impl` alone names nothing.
    """
    tail = F.regexp_extract(symbol, r"^[^ ]+ [^ ]* [^ ]* [^ ]* (.+)$", 1)
    tail = F.regexp_replace(tail, rf"(^|[/#.])impl#\[({NAME})\](\[{NAME}\])*", "$1$2#")
    tail = F.regexp_replace(tail, r"(^|[/#.])impl#", "$1")
    found = F.regexp_extract_all(tail, F.lit(rf"(\[{NAME}\]|\({NAME}\)|{NAME}(?:\([^)]*\)\.|[/#.:!]))"), F.lit(1))
    name = lambda d: F.regexp_replace(F.regexp_extract(d, f"({NAME})", 1), "`", "")
    parts = F.transform(found, lambda d: F.struct(name(d).alias("name"), d.endswith("#").alias("is_type")))
    return F.when(F.size(parts) > 0, parts)


def owner(parts: Column) -> Column:
    """The type that a member belongs to, null for what is no member."""
    holder = F.try_element_at(parts, F.lit(-2))
    return F.when(holder["is_type"], holder["name"])


def canonical(ids: DataFrame, crates: DataFrame) -> DataFrame:
    """ids with the first segment of module_path, a known directory, replaced by its name.

    Names of several directories, and those that are another directory, are left out: they would merge two of them.
    """
    named = crates.groupBy("directory").agg(F.max("name").alias("name"))
    used = named.groupBy("name").agg(F.count("*").alias("uses"))
    taken = named.select(F.col("directory").alias("name"), F.lit(True).alias("taken"))
    plain = named.join(used, "name").join(taken, "name", "left").where((F.col("uses") == 1) & (F.col("taken").isNull() | (F.col("directory") == F.col("name"))))
    of = plain.select(F.col("directory").alias("first"), "name")
    rust = F.when(F.col("language") == "rust", F.get("module_path", F.lit(0)))
    joined = ids.withColumn("first", rust).join(of, "first", "left")
    rest = F.slice("module_path", 2, F.greatest(F.size("module_path") - 1, F.lit(0)))
    return joined.withColumn("module_path", F.when(F.col("name").isNull(), F.col("module_path")).otherwise(F.concat(F.array("name"), rest))).select(*ids.columns)


def stat_gate(listing: DataFrame, kept: DataFrame, now: Column) -> DataFrame:
    """listing (path, modified, len) against kept (path, modified, len, hash): (path, hash, read, trusted).

    A file of the same stamp is not read and keeps its hash; any other is read. What was read less than RACY_SECONDS after its
    stamp, or has none, is not trusted the next time. Files that are listed no more fall out.
    """
    old = kept.select("path", F.col("modified").alias("old"), F.col("len").alias("old_len"), "hash")
    same = F.coalesce((F.col("modified") == F.col("old")) & (F.col("len") == F.col("old_len")), F.lit(False))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("modified").cast("timestamp"))
    met = listing.join(old, "path", "left").withColumn("read", ~same)
    return met.select("path", F.when(same, F.col("hash")).alias("hash"), "read", (same | F.coalesce(age >= RACY_SECONDS * 1_000_000, F.lit(False))).alias("trusted"))


def commit_cards(cards: DataFrame, commits: DataFrame) -> DataFrame:
    """cards (node, kind) with subject (the first line of the message) and date where they are commits that are known."""
    known = commits.select(F.col("sha").alias("node"), F.split_part("message", F.lit("\n"), F.lit(1)).alias("subject"), "date", F.lit("commit").alias("kind"))
    return cards.join(known, ["node", "kind"], "left")


def gold_query(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """(run_id, gold_id, status) by the text of the query; gold_id only if exactly one gold query has it, else none or ambiguous."""
    one = gold.groupBy("query").agg(F.min("gold_id").alias("gold_id"), F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return runs.join(one, "query", "left").select("run_id", F.when(n == 1, F.col("gold_id")).alias("gold_id"), F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous").alias("status"))


def spelled(states: DataFrame, paths: DataFrame) -> DataFrame:
    """(path_id, found): does a chain of states (id, node, parent, depth) spell the path's nodes, the seed first.

    Chains grow from the seeds by one join of child and parent a step, up to the longest path's length; then paths meet the distinct
    chains as wholes. So rows grow with states and steps, not with how many states share a node.
    """
    steps = paths.agg(F.max(F.size("nodes"))).first()[0] or 0
    known = states.where("node is not null").select("id", "node", "parent", "depth")
    level, chains = known.where("parent is null").withColumn("chain", F.array("node")).select("id", "chain", "depth"), None
    for step in range(steps):
        if step:
            above = level.select(F.col("id").alias("parent"), F.col("chain").alias("before"))
            level = known.join(above, "parent").select("id", F.concat("before", F.array("node")).alias("chain"), "depth")
        level = stored(level)
        if level.isEmpty():
            break
        ends = level.where(F.col("depth") == step).select(F.col("chain").alias("nodes"))
        chains = ends if chains is None else chains.unionByName(ends)
    if chains is None:
        return paths.select("path_id", F.lit(False).alias("found"))
    hit = chains.distinct().withColumn("found", F.lit(True))
    return paths.join(hit, "nodes", "left").select("path_id", F.coalesce("found", F.lit(False)).alias("found"))
