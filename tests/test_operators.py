"""Operators that SQL does not cover, against plain Python."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation, incremental
from lodestone.plans.steps import run_plan
from lodestone.streaming import events as E


def test_globs(spark):
    paths = ["a.py", "x/a.py", "x/y/a.py", "x/b.rs", "docs/x.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = lambda *g: sorted(r.p for r in df.where(T.matches_any(F.col("p"), list(g))).collect())
    assert got("*.py") == ["a.py"]
    assert got("**/*.py") == ["a.py", "x/a.py", "x/y/a.py"]
    assert got("x/?.rs", "docs/[!a].md") == ["docs/x.md", "x/b.rs"]
    for bad in ("", "/x", "a/../b", "a\\b"):
        with pytest.raises(ValueError):
            T.glob_regex(bad)


def test_identifiers_and_credit(spark):
    row = spark.range(1).select(
        T.split_identifier(F.lit("parseHTTPHeader2_fast")).alias("parts"), T.query_terms(F.lit("Where is parseHTTP used? 42 parseHTTP")).alias("terms"),
        T.credits(F.lit("see theParser"), "parse").alias("long"), T.credits(F.lit("a getX b"), "get").alias("word"), T.credits(F.lit("forget"), "get").alias("inside"),
    ).first()
    assert row.parts == ["parse", "HTTP", "Header", "2", "fast"]
    assert row.terms == ["where", "is", "parsehttp", "parse", "http", "used"]
    assert (row.long, row.word, row.inside) == (True, True, False)


def test_split_mix():
    rng = evaluation.SplitMix(0)
    assert [rng.next() for _ in range(2)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4]


def test_rebuild_equals_increment(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    derive = lambda f: f.select("path", F.concat("content_hash", F.lit("!")).alias("v"))
    got = incremental.apply(old, new, derive(old), derive)
    assert got.exceptAll(derive(new)).isEmpty() and derive(new).exceptAll(got).isEmpty()


def test_versions(spark, tmp_path):
    t = incremental.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.commit(spark.range(3)) == 1 and t.commit(spark.range(5)) == 2
    assert (t.read(1).count(), t.read().count()) == (3, 5)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    E.run_to_end(E.tumbling(E.stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    whole, seen = E.tumbling(rows), spark.read.parquet(f"{tmp_path}/out")
    assert seen.exceptAll(whole).isEmpty() and whole.count() - seen.count() <= 10  # windows the watermark has not closed


def test_plan_errors(spark):
    links, names = spark.createDataFrame([(1, 2)], "src long, dst long"), spark.createDataFrame([(2, "two")], "node long, name string")
    assert [r.node for r in run_plan([{"op": "reach", "of": [1]}, {"op": "filter", "of": "$s1", "like": "t*"}], links, names).collect()] == [2]
    for bad in ([], [{"op": "reach", "of": "$s9"}], [{"op": "no", "of": [1]}], [{"op": "union", "of": [1]}]):
        with pytest.raises(ValueError):
            run_plan(bad, links, names)


def test_ranked_over_all(spark):
    rows = [(i * 37 % 1001, i % 7) for i in range(1000)]
    from lodestone.operators import ranking

    got = {(r.a, r.b): r.place for r in ranking.ranked(spark.createDataFrame(rows, "a int, b int").repartition(5), "place", "b", "a").collect()}
    assert got == {(a, b): i + 1 for i, (a, b) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert ranking.ranked(spark.createDataFrame([], "a int"), "place", "a").count() == 0


def test_pagerank_to_a_tolerance(spark):
    from lodestone.operators import graph

    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {r.node: r.rank for r in graph.pagerank(links, spark.createDataFrame([(1, 1.0)], "node long, p double"), 60, tolerance=1e-9).collect()}
    rank = {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    for _ in range(300):
        rank = {1: 0.15 + 0.85 * (rank[3] / 2 + rank[4]), 2: 0.85 * rank[1], 3: 0.85 * rank[2], 4: 0.85 * rank[3] / 2}
    assert all(abs(got[n] - rank[n]) < 1e-6 for n in rank) and abs(sum(got.values()) - 1) < 1e-9


def test_hop_price_and_relative_places(spark):
    from lodestone.operators import selection

    c = spark.createDataFrame([(1, d, float(d), 0.5) for d in range(20)] + [(2, 7, 1.0, 0.9)], "src int, dst int, score double, prior double")
    got = {(r.src, r.dst): r.price for r in selection.hop_price(c).collect()}
    assert len(got) == 17 and got[1, 19] == 0.5 and got[1, 4] == 0.5 / 16 and got[2, 7] == 0.9
    share = {(r.src, r.dst): r.price for r in selection.hop_price(c, relative=True).collect()}
    assert abs(share[1, 14] - 0.5 / (1 + 5 * 8 / 20)) < 1e-12
