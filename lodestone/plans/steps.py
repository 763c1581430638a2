"""Composed plans: one to six named steps over a graph, each naming earlier steps as $s1, $s2, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph, ranking

MOST_STEPS, MOST_DEPTH = 6, 3


def run_plan(steps: list[dict], links: DataFrame, names: DataFrame) -> DataFrame:
    """(step, node) of the last step. Steps: {op, of | with, depth, like}; ops closure, reach, union, intersect, minus, filter.

    closure follows links backwards by one hop, reach forwards by `depth`; filter keeps nodes whose name fits a glob.
    """
    if not 1 <= len(steps) <= MOST_STEPS:
        raise ValueError(f"a plan has 1 to {MOST_STEPS} steps")
    made: dict[str, DataFrame] = {}
    for i, s in enumerate(steps, 1):

        def of(name, i=i):
            if isinstance(name, list):
                return links.sparkSession.createDataFrame([(x,) for x in name], "node long")
            if name not in made:
                raise ValueError(f"step {i} names {name}, which is no earlier step")
            return made[name]

        op, left = s.get("op"), of(s["of"])
        rest = [of(x) for x in s.get("with", [])]
        if op in ("union", "intersect", "minus") and not rest:
            raise ValueError(f"step {i}: {op} needs a second operand")
        if op == "closure":
            out = graph.reach(graph.reverse(links), left, 1).where("hops > 0").select("node")
        elif op == "reach":
            if not 1 <= s.get("depth", 1) <= MOST_DEPTH:
                raise ValueError(f"step {i}: depth is 1 to {MOST_DEPTH}")
            out = graph.reach(links, left, s.get("depth", 1)).where("hops > 0").select("node")
        elif op == "union":
            out = left
            for r in rest:
                out = out.unionByName(r)
            out = out.distinct()
        elif op == "intersect":
            out = ranking.intersect(left, rest, "node")
        elif op == "minus":
            out = ranking.minus(left, rest, "node")
        elif op == "filter":
            pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in s["like"]) + "$"
            out = left.join(names.where(F.col("name").rlike(pattern)).select("node"), "node", "left_semi")
        else:
            raise ValueError(f"step {i}: unknown op {op!r}")
        made[f"$s{i}"] = out
    return out.select(F.lit(len(steps)).cast("long").alias("step"), "node")
