"""Chunker, text expressions and steering against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ranking, steering
from lodestone.sources import markdown


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "# A", "text é", "Title", "===", "```", "~~~", "---", "  ## b", "    code", "a `b"]), max_size=30), st.integers(5, 60))
def test_markdown_covers_lines(lines, target):
    text = "\n".join(lines)
    spans = markdown.spans(text, target)
    held = [i for a, b in spans for i in range(a, b + 1)]
    assert held == sorted(set(held))
    assert {i for i, x in enumerate(lines) if x.strip()} <= set(held)


def test_markdown_sections():
    text = "---\na: 1\n---\nintro\n\n# One\nx\n```\n# no heading\n\n```\nTwo\n===\ny"
    assert markdown.spans(text) == [(0, 2), (3, 3), (5, 10), (11, 13)]
    assert markdown.spans("a\n\nb", 2) == [(0, 0), (2, 2)] and markdown.spans("") == []


def test_byte_heads(spark):
    texts = ["", "abc", "é" * 10, "a" + "é" * 10, "€" * 9, "😀" * 5, "ab😀😀😀", None]
    for most in (4, 5, 6, 7, 8):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(T.head_bytes(F.col("t"), most)).collect()]
        assert got == [None if t is None else t.encode()[:most].decode("utf-8", "ignore") for t in texts]


def test_symbol_queries_and_declarations(spark):
    row = spark.range(1).select(
        T.symbol_queries(F.lit("parsers use bus")).alias("q"), T.declares(F.lit("delegate int Run(int x)"), "Run").alias("d"), T.declares(F.lit("Runner Run fn Run"), "Run").alias("first"),
        T.node_parts(F.lit("no id")).alias("none"), T.why_tokens(F.lit("why did `Foo::bar` change things for parsers")).alias("why"),
    ).first()
    assert row.q == ["parser#", "parsers#", "use#", "bus#"] or row.q == ["parser#", "parsers#", "bus#"]
    assert (row.d, row.first, row.none) == (True, False, None)
    assert row.why == ["Foo::bar", "things", "parsers"]  # "change" is one of the fixed stop words


def test_symbol_queries_make_the_list_once(spark):
    """The list of a text was made anew for each of its words."""
    df = spark.createDataFrame([("buses buses bus gets",), ("",), (None,)], "t string").select(T.symbol_queries(F.col("t")).alias("q"))
    assert [r.q for r in df.collect()] == [["buse#", "buses#", "bus#", "gets#"], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # words, and the parts of a word


def test_bad_predicates():
    deep = {"kind": "x"}
    for _ in range(8):
        deep = {"not": deep}
    for bad in ({}, {"kind": "a", "map": "b"}, {"all": []}, {"any": [{"kind": "x"}] * 17}, {"score": {"ne": 1}}, {"witness": ["guess"]}, {"path_glob": "a" * 129}, deep):
        with pytest.raises(ValueError):
            steering.predicate(bad)


def test_nearest_ties_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (7, []), (8, [1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    args = df.select(F.col("id").alias("query_id"), F.col("e").alias("q")).where("id IN (1, 2, 4)"), df.select(F.col("id").alias("vec_id"), F.col("e").alias("v"))
    for tile in (1, 4096):
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in ranking.nearest(*args, 2, tile).collect())
        assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3)]
    assert ranking.nearest(args[0].where("false"), args[1], 2).isEmpty()


def test_tile_search_is_bounded():
    """2,000 queries and batches of 10,000 rows, all alike or not: the k best of the whole task, in a memory of some blocks."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 20_000
    x = np.round(rng.normal(size=(n, 8)), 1).astype(np.float32)
    x[:5000] = 1.0
    q = x[:2000:1].astype(np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids = np.arange(n) * 7 % n
    batches = [pa.record_batch([pa.array(ids[i : i + 10_000]), pa.FixedSizeListArray.from_arrays(x[i : i + 10_000].reshape(-1), 8).cast(pa.list_(pa.float32()))], ["vec_id", "v"]) for i in (0, 10_000)]
    tracemalloc.start()
    out = list(ranking._tile_search(SimpleNamespace(value=(ids[:2000], q)), 3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 6000 and peak < 128 << 20
    for t in (0, 1, 1999):
        s = np.round(q[t] @ (x / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float64)).T, 6)
        want = [(int(ids[j]), float(s[j])) for j in sorted(range(n), key=lambda j: (-s[j], ids[j])) if ids[j] != ids[t]][:3]
        got = [(r["vec_id"], r["score"]) for b in out for r in b.to_pylist() if r["query_id"] == ids[t]]
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=1e-9)
