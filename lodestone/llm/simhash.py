"""SimHash near-duplicates: fingerprints of 64 bits, linked at a small Hamming distance, as connected components.

Each distinct fingerprint gets a pivot table: its distances to many reference fingerprints. Two fingerprints at
distance d differ by at most d in every coordinate, so a pair whose largest coordinate difference exceeds the
radius is discarded before its bits are compared; what survives is verified. Candidates meet in buckets: of
radius + 1 bands of the fingerprint, two linked ones agree in at least one. A bucket of more than `bucket_limit`
distinct fingerprints is not compared pair by pair: there, each fingerprint is listed under itself and
its 64 neighbours at one bit. Two fingerprints differ by at most two bits exactly if they share such a point, at
most 65 fingerprints share one, and so the links stay exact and linear in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, pick, stash

SEED = 42
PIVOTS = np.random.default_rng(7).integers(0, 1 << 64, 24, np.uint64)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Majority bits of the XXH64 of all shingles of lower-cased words; 0 for a text without words."""
    return majority(hashes(text, size))


def majority(h: np.ndarray) -> int:
    n = len(h)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        bits = np.unpackbits(h[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int((_BIT[2 * ones > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long. Null text counts as empty."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def bucket_links(fps: np.ndarray, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one bucket: pivot tables discard, the bits verify."""
    table, left, right = pivot_table(fps), [], []
    for lo in range(0, len(fps), tile):
        a = slice(lo, lo + tile)
        near = np.ones((len(fps[a]), len(fps)), bool)
        for c in range(table.shape[1]):
            near &= np.abs(table[a, c][:, None] - table[:, c][None, :]) <= radius
        i, j = np.nonzero(near)
        keep = lo + i < j
        i, j = lo + i[keep], j[keep]
        good = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        left.append(i[good])
        right.append(j[good])
    return np.concatenate(left), np.concatenate(right)


def _bands(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bands that together make up the 64 bits."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def links(distinct: DataFrame, radius: int = 2, bucket_limit: int = 256) -> DataFrame:
    """(a, b): pairs of fingerprints, or of a fingerprint and the least one around a shared point, within components."""
    if radius > 2:
        raise ValueError("large buckets are exact for a radius of up to 2")
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i, (lo, width) in enumerate(_bands(radius))
    ])
    dealt = distinct.select("fp", F.explode(bands).alias("k")).select("fp", "k.band", "k.value")
    sizes = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    large = stash(sizes.where(F.col("n") > bucket_limit))
    small = sizes.where(F.col("n") <= bucket_limit).select("band", "value")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in b.column(0):
                fps = np.array(members.as_py(), np.int64).astype(np.uint64)
                i, j = bucket_links(fps, radius)
                left.append(fps[i].astype(np.int64))
                right.append(fps[j].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    # buckets of bounded size, each an array of at most bucket_limit fingerprints
    members = dealt.join(small, ["band", "value"]).groupBy("band", "value").agg(F.collect_list("fp").alias("fps"))
    found = members.select("fps").mapInArrow(tiles, "a long, b long")
    crowded = dealt.join(large.select("band", "value"), ["band", "value"]).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)])
    points = crowded.select("fp", F.explode(around).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return found.unionByName(least.select("a", F.explode("fps").alias("b")).where("a <> b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, bucket_limit: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the least doc_id reachable over links, itself included.

    Texts without words have fingerprint 0 and link like others. Repeated doc_ids give a row each; a null doc_id never
    names a component unless no other id lies in it. Copies share a fingerprint, so they cost one row in every step but the last.
    """
    rows = stash(fingerprints(docs, size))
    least = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(least.select("fp"), radius, bucket_limit))
    of = joined.withColumnsRenamed({"node": "fp"}).join(least, "fp")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.select("fp", "root").join(named, "root").select("fp", "component_id")
    alone = least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(alone, "fp").select("doc_id", "fp", "component_id")
