"""Scored traversal of a graph of evidence: best potentials within a budget, confirmation, corroboration, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut


def best_first(edges: DataFrame, seeds: DataFrame, depth: int, pops: int) -> DataFrame:
    """(node, hops, potential, place): the `pops` nodes of the highest potential, the best product of confidences / 100 from any seed.

    edges: (src, dst, conf); seeds: nodes of potential 1. The frontier of a round holds only nodes whose potential rose,
    so a stronger route found later rewrites all that hangs below it. Each round is one join and one aggregation with map-side combine.
    """
    best = seeds.select("node").distinct().select("node", F.lit(1.0).alias("potential"), F.lit(0).cast("long").alias("hops"))
    front = best
    for step in range(1, depth + 1):
        offered = F.round(F.col("potential") * F.col("conf") / 100, 12)
        reached = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), offered.alias("offer")).groupBy("node").agg(F.max("offer").alias("offer"))
        both = cut(best.join(reached, "node", "full"))
        rose = F.col("offer") > F.coalesce("potential", F.lit(-1.0))
        now = both.select("node", F.when(rose, F.col("offer")).otherwise(F.col("potential")).alias("potential"), F.when(rose, F.lit(step)).otherwise(F.col("hops")).cast("long").alias("hops"), F.coalesce(rose, F.lit(False)).alias("rose"))
        best, front = now.drop("rose"), now.where("rose").select("node", "potential")
    top = best.orderBy(F.desc("potential"), "node").limit(pops)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("potential"), "node")).cast("long")).select("node", "hops", "potential", "place")


def confirm(edges: DataFrame, proposer: str, authority: str, most: int) -> DataFrame:
    """Checks the `most` strongest proposals of each source: what the authority names rises to 90 at least, what it answers otherwise goes."""
    order = Window.partitionBy("src").orderBy(F.desc("conf"), "dst", "site")
    told = edges.where(F.col("map") == authority).select("src", "dst").distinct().withColumn("named", F.lit(True))
    answered = told.select("src").distinct().withColumn("answered", F.lit(True))
    offered = edges.where(F.col("map") == proposer).withColumn("place", F.row_number().over(order))
    rows = offered.join(told, ["src", "dst"], "left").join(answered, "src", "left")
    asked = F.col("place") <= most
    label = F.when(asked & F.col("named"), "confirmed").when(asked & F.col("answered"), "refuted").otherwise("open")
    rows = rows.withColumn("label", label).where("label <> 'refuted'")
    return rows.select("src", "dst", "site", F.when(F.col("label") == "confirmed", F.greatest("conf", F.lit(90))).otherwise(F.col("conf")).cast("long").alias("conf"), "label")


def corroborate(edges: DataFrame, boost: float = 0.1) -> DataFrame:
    """(src, dst, maps, score): the best confidence, raised by `boost` for each further map that gives the edge."""
    best = edges.groupBy("src", "dst", "map").agg(F.max("conf").alias("conf")).groupBy("src", "dst").agg(F.max("conf").alias("conf"), F.count("*").alias("maps"))
    return best.select("src", "dst", "maps", F.round(F.col("conf") / 100 * (1 + boost * (F.col("maps") - 1)), 6).alias("score"))


def collapse(edges: DataFrame, priors: DataFrame, otherwise: float = 0.5) -> DataFrame:
    """One edge per (src, dst): the highest prior times confidence, the first site on ties. priors: a few rows (map, prior)."""
    rows = edges.join(F.broadcast(priors), "map", "left").withColumn("strength", F.round(F.coalesce("prior", F.lit(otherwise)) * F.col("conf"), 6))
    order = Window.partitionBy("src", "dst").orderBy(F.desc("strength"), "site", "map")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("src", "dst", "map", "site", "strength")


def source_rrf(edges: DataFrame, sources: dict[str, tuple[str, float]], rrf_k: int = 2) -> DataFrame:
    """(src, dst, score): reciprocal ranks by source. sources: map -> (source, weight); maps of one source depend on each other and count once, by the best rank and weight."""
    pairs = [F.lit(x) for m, (name, w) in sources.items() for x in (m, F.struct(F.lit(name).alias("name"), F.lit(w).alias("weight")))]
    known = F.create_map(*[x if i % 2 == 0 else pairs[i] for i, x in enumerate(pairs)])
    order = Window.partitionBy("src", "map").orderBy(F.desc("conf"), "dst")
    best = edges.groupBy("src", "dst", "map").agg(F.max("conf").alias("conf")).withColumn("rank", F.row_number().over(order)).withColumn("of", known[F.col("map")]).where("of IS NOT NULL")
    each = best.groupBy("src", "dst", F.col("of.name").alias("source")).agg(F.min("rank").alias("rank"), F.max("of.weight").alias("weight"))
    return each.groupBy("src", "dst").agg(F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 9).alias("score"))
