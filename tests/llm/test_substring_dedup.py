import hashlib
import random

from lodestone.llm.substring_dedup import remove_repeats


def brute(rows, width=50):
    """Straight from the definition: every string of `width` bytes and the least document it starts in."""
    least = {}
    texts = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, b), (raw, _) in zip(texts, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((raw, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def same(spark, rows, **more):
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more)
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_planted_and_odd(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12) for _ in range(5)] + ["x" * 120, "ab" * 60]
    rows = []
    for i in range(150):
        parts = [text(rnd.randint(0, 20))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            lo = rnd.randint(0, 30)
            parts += [s[lo : lo + rnd.randint(40, 120)], text(rnd.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(9)] + [(300, None), (301, ""), (302, "é" * 49), (5, rows[5][1]), (None, rows[3][1]), (303, "y" * 49), (304, "y" * 50), (305, "y" * 51)]
    rnd.shuffle(rows)
    same(spark, rows, block_bytes=4000)
    same(spark, rows, block_bytes=4000, hot=2)
    same(spark, rows)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a" * 60, "z", "q"), (2, "a" * 60, "z", "q")], "doc_id int, text string, TEXT string, block string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()) == [(1, 0), (2, 60)]
