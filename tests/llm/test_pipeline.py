"""Each stage of the pipeline against what it owes, worked out on a small corpus without Spark."""

import random

import corpus_pipeline
import pytest

rnd = random.Random(6)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string"


def some(n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "other") for i, t in rows], COLUMNS).repartition(3)


def texts(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    rows = df.collect()
    assert all(r[4] == len(r[1] or "") and r[5] == "other" for r in rows)
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    """The row of least id of each group, by comparing all pairs."""
    rows = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[0], r[1]) for r in rows})
    sets, root = [shingles(r[2]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted(((r[3], r[4]) for i, r in enumerate(rows) if top(i) == i), key=repr)


def test_near_dedup(spark):
    rows = []
    for i in range(0, 120, 3):
        w = some(rnd.choice((6, 40, 120)))
        near = list(w)
        near[rnd.randrange(len(near))] = "changed"
        rows += [(i, " ".join(w)), (i + 1, " ".join(near)), (i + 2, " ".join(w[: len(w) // 2]))]
    rows += [rows[5], rows[5], (5, " ".join(some(20))), (None, rows[0][1]), (None, " ".join(some(30))), (500, " ".join(some(3)))]
    assert texts(corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), "")) == plain_groups(rows)


def test_repeats(spark):
    passage = " ".join(some(30))
    rows = [(1, "aa " + passage + " bb"), (2, "cc " + passage + " dd"), (2, "ee"), (3, None), (4, "é" * 30 + passage + "é"), (4, "é" * 30 + passage + "é"), (None, " ".join(some(9)))]
    got = texts(corpus_pipeline.remove_repeated_passages(spark, frame(spark, rows), ""))
    want = [(i, t if i in (1, None, 3) or t == "ee" else "ccdd" if i == 2 else "é" * 30 + "é") for i, t in rows]
    assert [(i, (t or "").replace(" ", "") if i == 2 else t) for i, t in got] == sorted(want, key=repr)


def test_leaks_and_quality(spark, tmp_path):
    items = [some(40) for _ in range(5)]
    rows = [(i, " ".join(some(30) + (items[i // 4] if i % 4 == 0 else []) + some(30))) for i in range(20)]
    rows += [(1, " ".join(items[0])), (30, None), (None, ""), (None, " ".join(items[1]))]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(200, 400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = texts(corpus_pipeline.remove_leaks(spark, frame(spark, rows), f"{tmp_path}"))
    assert got == sorted([(i, t) for i, t in rows if not any(" ".join(w) in (t or "") for w in items)], key=repr)
    graded = [(i, " ".join(some(20) if i % 2 else ["#!$%"] * 20)) for i in range(200, 400)] + [(600, " ".join(some(20))), (600, "#!$% " * 20)]
    got = texts(corpus_pipeline.keep_quality(spark, frame(spark, graded), f"{tmp_path}"))
    assert got == sorted([r for r in graded if "#" not in r[1]], key=repr)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[1:3]])
def test_empty(spark, stage):
    assert stage(spark, frame(spark, []), "").count() == 0
