"""Node operators on small cases."""

from pyspark.sql import functions as F

from lodestone.operators import nodes


def parsed(spark, *symbols):
    df = spark.createDataFrame([(s,) for s in symbols], "s string").select(nodes.descriptors(F.col("s")).alias("d"))
    return [(None if d is None else [p.name for p in d], o) for d, o in df.select("d", nodes.owner(F.col("d"))).collect()]


def test_descriptors(spark):
    head = "rust-analyzer cargo pkg 0.1.0 "
    assert parsed(spark, head + "a/b/Type#method().", head + "a/impl#[Type][Show]method().", head + "a/CONST.", head + "impl#f(+2).", head + "`x y`/m!", "local 3", "", None) == [
        (["a", "b", "Type", "method"], "Type"),
        (["a", "Type", "method"], "Type"),
        (["a", "CONST"], None),
        (["f"], None),
        (["x y", "m"], None),
        (None, None),
        (None, None),
        (None, None),
    ]


def test_canonical_keeps_ambiguous_names_apart(spark):
    crates = spark.createDataFrame([("core", "kern"), ("a", "two"), ("b", "two"), ("c", "core"), ("d", "d")], "directory string, name string")
    ids = spark.createDataFrame([(1, "rust", ["core", "x"]), (2, "rust", ["a"]), (3, "rust", ["c", "y"]), (4, "python", ["core"]), (5, "rust", []), (6, "rust", ["d", "z"])], "id int, language string, module_path array<string>")
    got = {r.id: r.module_path for r in nodes.canonical(ids, crates).collect()}
    assert got == {1: ["kern", "x"], 2: ["a"], 3: ["c", "y"], 4: ["core"], 5: [], 6: ["d", "z"]}


def test_spelled(spark):
    states = spark.createDataFrame([(0, 5, None, 0), (1, 6, 0, 1), (2, 7, 1, 2), (3, 6, None, 0)], "id int, node int, parent int, depth int")
    paths = spark.createDataFrame([(1, [5, 6, 7]), (2, [6, 7]), (3, [6]), (4, []), (5, [5, 7])], "path_id int, nodes array<int>")
    assert {r.path_id: r.found for r in nodes.spelled(states, paths).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert nodes.spelled(states, paths.limit(0)).count() == 0


def test_spelled_of_many_states_of_one_node(spark):
    """4,000 states and paths share a node: every path met every state of it."""
    states = spark.range(4000).select("id", F.lit(5).cast("long").alias("node"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent"), (F.col("id") > 0).cast("int").alias("depth"))
    paths = spark.range(4000).select(F.col("id").alias("path_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(5), F.lit(5))).otherwise(F.array(F.lit(5), F.lit(6))).alias("nodes"))
    got = nodes.spelled(states, paths)
    assert _most_rows(got) <= 8000
    assert got.where("found").count() == 2000


def test_spelled_needs_the_whole_chain(spark):
    """A chain must begin at a seed, be as long as its end says, and have no unknown node."""
    rows = [(0, 5, None, 0), (1, 6, 0, 2), (2, None, 0, 1), (3, 7, 2, 2), (4, 8, 9, 1), (9, 5, 8, 0)]
    states = spark.createDataFrame(rows, "id int, node int, parent int, depth int")
    paths = spark.createDataFrame([(1, [5, 6]), (2, [5, None]), (3, [5, None, 7]), (4, [5, 8]), (5, None), (6, [5])], "path_id int, nodes array<int>")
    assert {r.path_id: r.found for r in nodes.spelled(states, paths).collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}


def _most_rows(df):
    """The most rows that a join of the plan gave."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            plan.append(p.plan())
        plan += [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most
