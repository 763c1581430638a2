"""Near duplicates by their shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as connected components.

The links are those of a comparison of all pairs. First come the groups of op3's operator: SimHash fingerprints of the shingles,
candidates through pivot tables, each set verified against one set of its group. Fingerprints at two bits find some links only (sets of similarity
0.8 lie some ten bits apart), so an exact search of what is still apart follows. Shingles stand in one order over all documents, and two similar
sets share one among the first n - ceil(0.8 n) + 1 of each, so pairs meet under these only; sizes and positions discard most
of them, and so does a sketch of 512 bits: each shingle flips one, so that sketches differ in no more bits than sets in shingles.
The whole sets of the rest are compared. Which shingles come last in the order changes the cost and no link, so
common ones, found in a part of the documents, do. Sets under shingles of more than `bucket_limit` distinct sets
are first compared with one leader each, a set with few shingles ahead of the common one; then sets and the leaders of their other shingles, and the sets under rarer
shingles, if that left them in different components; last, what is still apart under the common shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checked, components, pick, release, stash
from lodestone.llm.simhash import hashes, links, majority

SIZE = 5
LAST = 1 << 16  # shingles that are put last in the order
WORDS = 8  # of 64 bits in a sketch


def shingles(text: bytes | None) -> np.ndarray:
    return np.unique(hashes(text, SIZE))


def _key(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.astype("<u8").tobytes())


def similar(shared: int, n: int, m: int) -> bool:
    """shared / (n + m - shared) >= 0.8"""
    return 9 * shared >= 4 * (n + m)


def first_shingles(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shingles of a set (sorted) one of which every similar set has among its own first ones."""
    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own if len(last) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: len(own) - (4 * len(own) + 4) // 5 + 1]


def sketch(own: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of shingles falls; two sets differ in at least as many shingles as their sketches in bits."""
    odd = np.bincount((own % (64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _common(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[shingles(t.as_py()) for t in b.column(0)]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text")
    counts = some.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(LAST).select("token").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _first(last) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            n, first = pa.array([len(s) for s in sets], pa.int32()), _lists([first_shingles(s, last.value) for s in sets])
            bits = _lists([sketch(s) for s in sets])
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_key, sets), pa.binary()), n, first, bits, fps], ["doc_id", "key", "n", "first", "bits", "fp"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.binary()), _lists(sets)], ["key", "own"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column(2), b.column(3)
        good = [similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)) for p, q in ((x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(b.num_rows))]
        yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _apart(x: str, y: str) -> Column:
    """The number of bits in which the sketches of x and y differ."""
    return sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(WORDS)), F.lit(0))


def _may(x: str, y: str) -> Column:
    """By sizes, by what may be shared before and after a shared shingle, and by their sketches, the sets of x and y may be similar."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    most = F.least(f"{x}.before", f"{y}.before") + 1 + F.least(n - i - 1, m - j - 1)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (n + m)) & (9 * _apart(x, y) <= n + m)


def _met(one: DataFrame) -> DataFrame:
    """Posts under shingles that another set has among its first ones too, with the number of such shingles before each.

    Shingles of no other set can't be shared, so a set with too many of these is similar to none. Most posts go here, and
    until then they hold a number in place of the key and no sketch, as each is shuffled where the shared shingles are many.
    """
    posts = one.where("n > 0").select("id", "n", F.posexplode("first").alias("pos", "token"))
    shared = stash(posts.groupBy("token").count().where("count > 1"))
    met = posts.join(checked(shared), "token")
    met = met.withColumn("before", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1)
    met = met.where(5 * (F.col("n") - F.col("pos") + F.col("before")) >= 4 * F.col("n"))
    return stash(met.join(one.select("id", "key", "bits"), "id").drop("id"))


def _near_fingerprints(one: DataFrame) -> DataFrame:
    """(a, b) of keys: each set with one set of its group of SimHash fingerprints, as candidates come out of pivot tables at two bits.

    A pair for each set, however many fingerprints lie around it.
    """
    least = stash(one.groupBy("fp").agg(F.min("key").alias("a")))
    joined = stash(components(links(least.select("fp"))))
    roots = one.join(checked(joined.withColumnRenamed("node", "fp")), "fp", "left").select("key", F.coalesce("root", "fp").alias("fp"))
    return roots.join(checked(least), "fp").where("a <> key").select("a", F.col("key").alias("b"))


def _links(pairs: DataFrame, docs: DataFrame, one: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar; only texts of sets in a pair are read again."""
    pairs = stash(pairs)
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    need = stash(keys.join(one.select("key", "least"), "key"))
    texts = docs.join(checked(need), docs["doc_id"].eqNullSafe(F.col("least")), "left_semi").select("text")
    sets = texts.mapInArrow(_whole, "key binary, own array<long>").join(checked(need).select("key"), "key", "left_semi")
    sets = stash(sets.dropDuplicates(["key"]))
    left, met = sets.withColumnsRenamed({"key": "a", "own": "x"}), pairs
    often = stash(pairs.groupBy("a").count().where("count > 256").select("a"))
    if not often.isEmpty():
        met = pairs.join(checked(often), "a", "left_anti")
        some = pairs.join(checked(stash(left.join(checked(often), "a", "left_semi"))), "a")
        met = met.join(left, "a").unionByName(some)
    else:
        met = met.join(left, "a")
    met = met.join(sets.withColumnsRenamed({"key": "b", "own": "y"}), "b").select("a", "b", "x", "y")
    good = stash(met.mapInArrow(_verify, "a binary, b binary"))
    for done in (pairs, need, sets):
        release(done)
    return good


def _led(large: DataFrame) -> DataFrame:
    """(a, b, apart): each member of a large bucket with the bucket's leader, where the two may be similar.

    The leader has the fewest shingles ahead of the common one, so it is the least changed of a group of changed copies.
    """
    leaders = stash(large.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("key").alias("h"), "key", "n", "before", "bits")).alias("l")).select("token", "l.key", "l.n", "l.pos", "l.before", "l.bits"))
    met = large.alias("y").join(checked(leaders).alias("x"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") != F.col("y.key")) & _may("x", "y"))
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), _apart("x", "y").alias("apart"))


def _first_leaders(large: DataFrame) -> DataFrame:
    """For each member of large buckets the leader with the nearest sketch, so one pair however many buckets it lies in."""
    one = _led(large).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("l"))
    return one.select("l.a", "b")


def _split(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those pairs (a, b) that do not lie in one component already."""
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    met = pairs.join(checked(left), "a", "left").join(checked(right), "b", "left")
    return met.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _across(large: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs of members of one bucket in different components; one of each at least is not in the most frequent component of the bucket."""
    named = stash(large.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    split = named.groupBy("token").agg(F.unhex(F.mode(F.hex("root"))).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = named.join(checked(stash(split.select("token", "top"))), "token")
    rest = mixed.where("root <> top").alias("x").join(mixed.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & _may("x", "y"))
    return stash(rest.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct())


def near_duplicates(docs: DataFrame, bucket_limit: int = 32) -> DataFrame:
    """(doc_id, component_id) for every row: component_id is the least doc_id reachable over links, itself included.

    Texts without words are copies of each other. Repeated doc_ids give a row each; a null doc_id never names a
    component unless no other id lies in it.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    last = docs.sparkSession.sparkContext.broadcast(_common(docs))
    made = stash(docs.mapInArrow(_first(last), f"doc_id {kind}, key binary, n int, first array<long>, bits array<long>, fp long"))
    rows = stash(made.select("doc_id", "key"))
    sets = made.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits"), F.first("fp").alias("fp"))
    full = stash(sets.withColumn("id", F.monotonically_increasing_id()))
    release(made)
    met, columns = _met(full), ("token", "key", "n", "pos", "before", "bits")
    one = stash(full.select("key", "least", "fp"))
    release(full)
    found = _links(_near_fingerprints(one), docs, one)
    joined = stash(components(found))
    large = stash(met.where(F.col("count") > bucket_limit).select(*columns))
    small = met.where(F.col("count") <= bucket_limit).select(*columns)
    crowded = not large.isEmpty()
    if crowded:
        found = found.unionByName(_links(_split(_first_leaders(large), joined), docs, one))
        joined = stash(components(found))
    small = small.join(checked(joined.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _may("x", "y"))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    if crowded:
        more = _split(_led(large), joined)
        pairs = pairs.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    found = found.unionByName(_links(pairs.distinct(), docs, one))
    joined = components(found)
    if crowded:
        joined = stash(joined)
        rest = _across(large, joined)
        if not rest.isEmpty():
            joined = components(found.unionByName(_links(rest, docs, one)))

    of = joined.withColumnRenamed("node", "key").join(one.select("key", "least"), "key")
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.select("key", "root").join(names, "root").select("key", "component_id")
    alone = one.select("key", "least").join(linked, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    return rows.select("doc_id", "key").join(alone, "key").select("doc_id", "component_id")
