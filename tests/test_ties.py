"""Rounding that decides ties, against DuckDB."""

import hashlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.functions.numbers import round_half
from lodestone.registry import QUERIES, SQL


def test_halves_round_as_sql(spark):
    xs = [s * (2 * i + 1) / 20000 for i in range(500) for s in (1, -1)] + [0.0, 0.49999999999999994e-4, 1e300, 1e308, 12345678901234.56, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = dict(df.select("i", round_half(F.col("x"), 4)).collect())
    for i, x in enumerate(xs):
        want = duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0]
        assert got[i] == want or (want != want and got[i] != got[i]), x


def test_tie_pairs_at_a_half(spark, tmp_path):
    """A document whose fused score is a half that a double holds too low."""
    n = 800
    b_rank = {d: i for i, d in enumerate(sorted(range(n), key=lambda d: hashlib.sha256(str(d).encode()).hexdigest()), 1)}
    half = next((a, d) for d in range(n) for a in range(1, n + 1) for k in [round((1 / (60 + a) + 0.7 / (60 + b_rank[d])) * 1e9)] if k % 100_000 == 50_000 and k / 1e9 * 1e4 % 1 < 0.5)
    order = [d for d in range(n) if d != half[1]]
    order.insert(half[0] - 1, half[1])
    rows = {"doc_id": order, "text": ["x"] * n, "lang": ["en" if d % 2 or d == half[1] else "de" for d in order], "source": ["src0"] * n, "n_chars": list(range(2 * n, n, -1))}
    pq.write_table(pa.table(rows), f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = sorted(duck.execute(SQL["add_28_tie_pairs"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["add_28_tie_pairs"](spark, str(tmp_path)).collect()) == want
