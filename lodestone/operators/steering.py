"""Steering of walks: a predicate language compiled to columns, rules, stop triggers, budgets, hop scores and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Limits of the predicate language, and priors of witnesses.
MAX_RULES, MAX_NESTING, MAX_CHILDREN, MAX_GLOB, MAX_BOOST = 64, 8, 16, 128, 8.0
WITNESS_PRIORS = {"compiler": 1.0, "lsp": 0.9, "exact": 0.9, "text": 0.3, "vector": 0.3, "heuristic": 0.4, "agent": 0.5}
TOKENS_PER_EDGE = 12
_CMP = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b}
_NUMBERS = ("score", "fanout", "depth", "budget_left")


def predicate(spec: dict, nesting: int = 1) -> Column:
    """One condition on frontier rows (kind, path, witness, map, score, fanout, depth, budget_left, seen_before) as a column."""
    if nesting > MAX_NESTING or not isinstance(spec, dict) or len(spec) != 1:
        raise ValueError(f"bad predicate {spec!r}")
    (name, arg), = spec.items()
    if name in ("all", "any"):
        if not isinstance(arg, list) or not 0 < len(arg) <= MAX_CHILDREN:
            raise ValueError(f"{name} takes 1 to {MAX_CHILDREN} predicates")
        out = None
        for child in arg:
            c = predicate(child, nesting + 1)
            out = c if out is None else out & c if name == "all" else out | c
        return out
    if name == "not":
        return ~predicate(arg, nesting + 1)
    if name in ("kind", "map"):
        return F.coalesce(F.col(name) == arg, F.lit(False))
    if name == "path_glob":
        if len(arg) > MAX_GLOB:
            raise ValueError("pattern too long")
        return F.coalesce(T.matches_any(F.col("path"), [arg]), F.lit(False))
    if name == "witness":
        if not set(arg) <= set(WITNESS_PRIORS):
            raise ValueError(f"unknown witness in {arg!r}")
        return F.coalesce(F.col("witness").isin(list(arg)), F.lit(False))
    if name in _NUMBERS:
        (op, bound), = arg.items()
        if op not in _CMP:
            raise ValueError(f"unknown comparison {op!r}")
        return F.coalesce(_CMP[op](F.col(name), F.lit(bound)), F.lit(False))
    if name == "seen_before":
        return F.coalesce(F.col("seen_before") == F.lit(bool(arg)), F.lit(False))
    raise ValueError(f"unknown predicate {name!r}")


def apply_rules(frontier: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds rule (position of the first that holds, or null), action and factor. Rules: {"when": ..., "then": {"boost": 2} or {"prune": true} or {"continue": true}}."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules")
    rule, action, factor = F.lit(None).cast("int"), F.lit("continue"), F.lit(1.0)
    for i, r in reversed(list(enumerate(rules))):
        (verb, arg), = r["then"].items()
        if verb not in ("boost", "prune", "continue", "expand") or verb == "boost" and not 0 < arg <= MAX_BOOST:
            raise ValueError(f"bad action {r['then']!r}")
        holds = predicate(r["when"])
        rule, action = F.when(holds, F.lit(i)).otherwise(rule), F.when(holds, F.lit(verb)).otherwise(action)
        factor = F.when(holds, F.lit(float(arg) if verb == "boost" else 0.0 if verb == "prune" else 1.0)).otherwise(factor)
    return frontier.select("*", rule.alias("rule"), action.alias("action"), factor.alias("factor"))


def idle_rules(frontier: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, holds, decides): for how many rows each rule holds, and is the first to; a rule that never decides is idle."""
    marks = frontier.select(F.array(*[predicate(r["when"]).cast("int") for r in rules]).alias("m")).withColumn("first", F.array_position("m", 1))
    rows = marks.select(F.posexplode("m").alias("rule", "holds"), "first")
    return rows.groupBy(F.col("rule").cast("long").alias("rule")).agg(F.sum("holds").alias("holds"), F.count_if(F.col("first") == F.col("rule") + 1).alias("decides"))


def stop_triggers(pops: DataFrame, every: int, share: int, cap: int, stagnation: int) -> DataFrame:
    """Adds every_pops, budget_share and stagnation to the pops (walk, pop, fresh) of walks: where a walk would pause.

    share: a stop at each crossing of `share` percent of `cap`; stagnation: no fresh answer in that many pops, told once.
    """
    order = Window.partitionBy("walk").orderBy("pop")
    bucket = lambda p: F.floor(p * 100 / F.lit(cap * share))
    last_fresh = F.coalesce(F.max(F.when(F.col("fresh"), F.col("pop"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return pops.select(
        "walk", "pop", (F.col("pop") % every == 0).alias("every_pops"),
        (bucket(F.col("pop")) > bucket(F.lag("pop", 1, 0).over(order))).alias("budget_share"), (F.col("pop") == last_fresh + stagnation).alias("stagnation"),
    )


def affordable(hops: DataFrame, tokens: int) -> DataFrame:
    """The best hops (walk, dst, score, edges) of each walk that `tokens` pay for, in order, up to the first that does not fit."""
    order = Window.partitionBy("walk").orderBy(F.desc("score"), "dst").rowsBetween(Window.unboundedPreceding, 0)
    return hops.withColumn("spent", F.sum(F.col("edges") * TOKENS_PER_EDGE).over(order)).where(F.col("spent") <= tokens)


def hop_score(edges: DataFrame, nodes_seen: int, base: float = 0.1, by_idf: float = 0.3, by_overlap: float = 0.6) -> DataFrame:
    """Adds score to hops (witness, prior, conf, cost_ms, in_seen, overlap): witness x prior x confidence x cost x name evidence."""
    pairs = [F.lit(x) for kv in WITNESS_PRIORS.items() for x in kv]
    n = float(nodes_seen + 1)
    idf = F.least(F.greatest(F.log(F.lit(n) / (F.col("in_seen") + 1)) / F.greatest(F.log(F.lit(n)), F.lit(1e-300)), F.lit(0.0)), F.lit(1.0))
    cost = 1 / (1 + F.greatest(F.coalesce("cost_ms", F.lit(0.0)), F.lit(0.0)) / 100)
    return edges.withColumn("score", F.round(F.create_map(*pairs)[F.col("witness")] * F.col("prior") * F.col("conf") / 100 * cost * (base + by_idf * idf + by_overlap * F.col("overlap")), 9))


def tie_break(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Results (item, node, potential, found, ...) in order of potential, then of a weighted sum of features, then of discovery. Adds place."""
    extra = sum((F.lit(w) * (F.log(1 + F.col(c)) if c == "fanout" else F.col(c)) for c, w in weights.items()), F.lit(0.0))
    rows = results.withColumn("tie", F.round(extra, 9))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("potential"), F.desc("tie"), "found", "node")).cast("long"))


def merge_stages(first: DataFrame, walk: DataFrame, mode: str, first_k: int, top_k: int) -> DataFrame:
    """(query, node, origin, place) of two ranked lists (query, node, rank).

    off: the walk alone. append: the first stage (cut at first_k, 0 for all), then up to top_k walk cards not in it. interleave: by turns, the other
    list going on when one ends, top_k in all.
    """
    if mode not in ("off", "append", "interleave"):
        raise ValueError(mode)
    by = Window.partitionBy("query").orderBy("rank", "node")
    numbered = lambda d: d.withColumn("n", F.row_number().over(by))
    walk = walk.select("query", "node", "rank")
    if mode == "off":
        return numbered(walk).where(F.col("n") <= top_k).select("query", "node", F.lit("walk").alias("origin"), F.col("n").cast("long").alias("place"))
    a = numbered(first.groupBy("query", "node").agg(F.min("rank").alias("rank")))
    a = a.where(F.col("n") <= first_k) if first_k else a
    b = numbered(walk.join(a.select("query", "node"), ["query", "node"], "left_anti"))
    rows = a.select("query", "node", "n", F.lit(0).alias("list")).unionByName(b.select("query", "node", "n", F.lit(1).alias("list")).where(F.col("n") <= top_k))
    order = ["n", "list"] if mode == "interleave" else ["list", "n"]
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long"))
    out = out.where(F.col("place") <= top_k) if mode == "interleave" else out
    return out.select("query", "node", F.when(F.col("list") == 0, "first").otherwise("walk").alias("origin"), "place")
