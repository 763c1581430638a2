import random

import corpus_pipeline
from lodestone.llm import shingle_sets, simhash
from pyspark.sql import functions as F


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def brute(rows):
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 10 * len(x & y) >= 8 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rnd.choices(vocabulary, k=14))
    base = [[*rnd.choices(vocabulary, k=rnd.randint(6, 160)), *(line.split() if i % 2 else [])] for i in range(40)]
    rows = []
    for i in range(260):
        w = list(base[0] if i % 3 == 0 else rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(["zz", "É", "Q"]) + str(rnd.randrange(50))
        rows.append((i * 3 + 1, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "One"), (5003, "one two"), (None, rows[7][1]), (None, "alone here")]


def test_components_are_those_of_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shingle_sets.near_duplicates(df, bucket_limit=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_stage_removes_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    near = [" ".join(words), " ".join([*words[:50], "other", *words[51:]])]
    assert (simhash.fingerprint(near[0].encode()) ^ simhash.fingerprint(near[1].encode())).bit_count() > 2
    df = spark.createDataFrame([*enumerate(near), (2, "else"), (2, "else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect()) == [0, 2]


def test_posts_hold_no_sketches(spark, monkeypatch):
    """Until the shared shingles are known, a post is four numbers: where these are many, every post is shuffled."""
    plans = []

    def stash(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(shingle_sets, "stash", stash)
    monkeypatch.setattr(shingle_sets, "checked", lambda df: df)
    one = spark.createDataFrame([(0, b"k", 3, [1, 2], [5])], "id long, key binary, n int, first array<long>, bits array<long>")
    shingle_sets._met(one)
    posted = [p[p.index("Generate posexplode") :].split("Project")[1].splitlines()[0] for p in plans]
    assert len(posted) == 2 and not any(c in p for p in posted for c in ("bits", "key"))


def test_fingerprints_come_first(spark, monkeypatch):
    """The groups of SimHash fingerprints alone link changed copies at two bits or fewer; what they link needs no further search."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "tail"])), (2, "else"), (3, " ".join(words[:1500]))]
    sets = [shingle_sets.shingles(t.encode()) for _, t in rows]
    assert (simhash.majority(sets[0]) ^ simhash.majority(sets[1])).bit_count() <= 2
    one = spark.createDataFrame([(shingle_sets._key(s), simhash.majority(s) - (1 << 64) * (simhash.majority(s) >> 63)) for s in sets], "key binary, fp long")
    got = [{bytes(r.a), bytes(r.b)} for r in shingle_sets._near_fingerprints(one).collect()]
    assert got == [{shingle_sets._key(sets[0]), shingle_sets._key(sets[1])}]
    monkeypatch.setattr(shingle_sets, "_may", lambda x, y: F.lit(False))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, shingle_sets.near_duplicates(df).collect())) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_empty(spark):
    assert shingle_sets.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
