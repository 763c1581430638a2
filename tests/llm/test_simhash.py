import random

import numpy as np
import xxhash

from lodestone.llm import simhash


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fps[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def test_components(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("ab cd éf gh ij KL Mn".split()) for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    rows = []
    for i in range(220):
        w = rnd.choice(base).split(" ")
        if w and rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(["zz", "\t", "É", ""])
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "\x0b \n"), (5003, "one"), (5004, "one two"), (5003, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for limit in (1, 256):
        got = simhash.near_duplicates(df, bucket_limit=limit).collect()
        assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_chain_and_hot_bucket(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    fps = [base]
    for _ in range(300):
        fps.append(fps[-1] ^ (1 << int(rng.integers(0, 30))) ^ (1 << int(rng.integers(0, 30))))
    fps += [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 300)]
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (10, 10_000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket_limit=limit)).collect()}
        again = {r.node: r.root for r in simhash.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
        assert roots == again


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
