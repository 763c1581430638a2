"""Walks over links against plain Python."""

import random

from lodestone.operators import graph, structure
from lodestone.registry import QUERIES


def _links(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long").coalesce(2)


def _nodes(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long").coalesce(1)


def _hops(pairs, seeds, depth):
    hops = dict.fromkeys(seeds, 0)
    for step in range(1, depth + 1):
        hops |= {b: step for a, b in pairs if hops.get(a) == step - 1 and b not in hops}
    return hops


def test_shortest_paths(spark):
    rng = random.Random(5)
    for case in (1, 2):
        pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] * 2
        start, end, depth = ([0], [29], 3) if case < 2 else ([1, 2], [3, 27], 2)
        a, b = _hops(pairs, start, depth), _hops([(y, x) for x, y in pairs], end, depth)
        whole = {n: a[n] + b[n] for n in a if n in b}
        want = {(n, a[n]) for n in whole if whole[n] == min(whole.values())}
        got = [tuple(r) for r in graph.on_shortest_paths(_links(spark, pairs), _nodes(spark, *start), _nodes(spark, *end), depth).collect()]
        assert len(got) == len(want) and set(got) == want
    chain = [(i, i + 1) for i in range(5)]
    for depth, want in ((2, set()), (3, {(2, 2), (3, 3)})):
        assert {tuple(r) for r in graph.on_shortest_paths(_links(spark, chain), _nodes(spark, 0), _nodes(spark, 5), depth).collect()} == want


def test_reach_and_chains_of_repeated_links(spark):
    pairs = [(1, 2), (1, 2), (2, 3), (3, 1), (0, 3), (5, 0)]
    assert sorted(tuple(r) for r in graph.reach(_links(spark, pairs), _nodes(spark, 1, 1), 5).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(tuple(r) for r in structure.labelled_chains(_links(spark, pairs), _nodes(spark, 3), 3).collect()) == [(0, 3), (5, 0)]


def test_walks_do_not_shuffle_all_links(spark):
    """What a walk shuffles is its fronts: 6,000 rows of lineitem alone were shuffled twice a step."""
    sc = spark.sparkContext._jsc.sc()
    for name in ("gra_05_reach", "gra_07_shortest_paths", "joi_27_trace_labels"):
        before = _shuffled(sc)
        QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert _shuffled(sc) - before < 5000, name


def _shuffled(sc):
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().executorList(False)
    return sum(stages.apply(i).totalShuffleWrite() for i in range(stages.size()))


def test_commit_files_are_dealt_by_rows(spark, monkeypatch):
    """Tasks hold a fixed number of rows, and sizes need no second pass over the files."""
    from lodestone.sources import views

    monkeypatch.setattr(views, "TASK_ROWS", 200)
    got = graph.touches(views.commit_files(spark, "/root/testdata/sf0.001"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and "], 3" in plan.replace("#", "") and plan.count("Relation [l_orderkey") == 1
