"""Exact removal of long repeated byte strings, with a logarithmic family of suffix arrays.

Every text is bytes. A byte goes if a string of `width` bytes that covers it also starts in a document with a
smaller id. Equal strings choose equal anchors: among the k-grams of a string, the one with the least hash,
leftmost on ties. The strings of one anchor follow each other and form a context, a few dozen bytes more than one
string. So the family of suffix arrays is dealt to buckets by anchor, and strings meet all their equals in one bucket:

1. documents are put in order of doc_id and packed into blocks of a few MB, written once to the shared folder with
   the lengths and anchors of their contexts; blocks are the batches of the index, each later than all before it;
2. each block sends the hashes of its contexts to the buckets of their anchors. A bucket tells which contexts an
   earlier batch holds byte for byte, and which anchors stand in several contexts. Only the latter can share some
   strings and not others, and of these one of each kind, that of the earliest document, is indexed;
3. in a bucket, every batch in turn gets a suffix array: its strings in the order of their bytes. It is merge-scanned
   against the arrays of the levels, which hold earlier batches only; a match of `width` bytes in an earlier document marks a
   string. Then the array becomes a level, and levels of like size merge, so a string is moved a logarithmic number of times;
4. each block removes what the answers cover.

What crosses the shuffle is a row per block and bucket. An anchor in very many kinds of context is dealt by the hashes
of its strings instead, so that no bucket grows with it. Contexts count as the same if a 64-bit hash of all their bytes and
48 bits of their anchor's agree; strings of different contexts are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checked, pick, shared_dir, stash

WIDTH = 50
GRAM = 24
BLOCK_BYTES = 4 << 20
BATCH = 1 << 17  # strings, from one block or more, that get a suffix array at once
PIECE = 1 << 18  # strings whose anchors are sought at once
HOT = 512  # kinds of context of an anchor from which its strings are dealt by their own hash
_MULT = 0x9E3779B97F4A7C15
_POS = np.uint64((1 << 32) - 1)


def _in_pieces(f, data: np.ndarray, k: int, size: int = 1 << 15) -> np.ndarray:
    """f over overlapping pieces that fit a processor's cache; f maps n values to n - k + 1."""
    n = max(0, len(data) - k + 1)
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, size):
        out[lo : lo + size] = f(data[lo : lo + size + k - 1], k)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    return _in_pieces(_least_in, x, w)


def _least_in(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


REACH = 1 << 15  # bytes hashed at once: what they take fits a processor's cache
_UP, _DOWN = _powers(_MULT, 2 * REACH), _powers(pow(_MULT, -1, 1 << 64), 2 * REACH)


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums, from which a hash of any span follows by one subtraction (at most 2 * REACH bytes)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_UP[: len(data)] * data, out=out[1:])
    return out


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes in a row (data: uint8)."""

    def some(d: np.ndarray, k: int) -> np.ndarray:
        s = _sums(d)
        return _mixed((s[k:] - s[:-k]) * _DOWN[: len(d) - k + 1])

    return _in_pieces(some, data, k, REACH)


def span_hashes(data: np.ndarray, at: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The hashes of rolling() for spans (first byte, size) that begin and end within REACH bytes of the places at, which ascend."""
    out = [np.zeros(len(at), np.uint64) for _ in spans]
    cuts = np.searchsorted(at, np.arange(int(at[0]), int(at[-1]) + REACH, REACH)) if len(at) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            base = int(at[lo])
            s = _sums(data[base : int(at[hi - 1]) + REACH])
            for o, (first, size) in zip(out, spans, strict=True):
                i = first[lo:hi] - base
                o[lo:hi] = _mixed((s[i + (size[lo:hi] if np.ndim(size) else size)] - s[i]) * _DOWN[i])
    return out


def string_starts(lens: np.ndarray, width: int) -> np.ndarray:
    """Places in documents laid end to end where a string starts that ends in the same document."""
    n = np.maximum(lens - width + 1, 0)
    return _spread(np.cumsum(lens) - lens, n)


def contexts_of(data: np.ndarray, starts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of strings with one anchor: how many they are, and how far the anchor lies from the first.

    Strings are taken a piece at a time, so a context at the edge of a piece may be two.
    """
    sizes, offs = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    for lo in range(0, len(starts), PIECE):
        s = starts[lo : lo + PIECE]
        base = int(s[0])
        h = rolling(data[base : int(s[-1]) + width], gram)
        anchor = _sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        anchor = (anchor[s - base] & _POS).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        sizes.append(np.diff(np.r_[first, len(s)]).astype(np.uint16))
        offs.append((anchor[first] - (s[first] - base)).astype(np.uint16))
    return np.concatenate(sizes), np.concatenate(offs)


def by_value(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, in their order of place, and where each new key begins in it."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=np.uint64))  # places in the low bits: faster than sorting an index
    order = (packed & low).astype(np.int64)
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]]
    if ((packed[1:] ^ packed[:-1]) & ~low == 0)[new[1:]].any():  # two keys differ in their low bits only
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        new = np.r_[True, k[1:] != k[:-1]]
    return order, np.flatnonzero(new)


class Block:
    """Documents laid end to end, and the contexts of their strings."""

    def __init__(self, row: dict, width: int, gram: int):
        self.width, self.gram = width, gram
        self.ids, self.lens = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lens"], "<i8")
        self.data = np.frombuffer(_unz(row["data"]), np.uint8)
        self.n, off = (x.astype(np.int64) for x in _unpack(row["contexts"], "<u2", "<u2"))
        self.ends = np.cumsum(self.lens)
        strings = np.maximum(self.lens - width + 1, 0)
        before, at = np.cumsum(strings), np.cumsum(self.n) - self.n
        doc = np.searchsorted(before, at, side="right")
        self.first = at + (self.ends - self.lens - before + strings)[doc]
        self.doc = self.ids[doc]
        key, kind = span_hashes(self.data, self.first, (self.first + off, gram), (self.first, self.n + width - 1))
        key >>= np.uint64(16)
        order, new = by_value(kind)
        #: the first context of each kind (that of the least document), and the kind of every context
        self.one, self.of = order[new], np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(order)]))
        self.key, self.kind = key[self.one], kind[self.one]


def _z(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unz(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _pack(*arrays: np.ndarray, small: bool = True) -> bytes:
    """Arrays in one blob, compressed if that is likely to help."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return b"z" + _z(raw) if small else b"-" + raw


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _unz(blob[1:]) if blob[:1] == b"z" else blob[1:]
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BLOCKS = "block long, raw long, ids binary, lens binary, data binary, contexts binary"


def _blocks(docs: DataFrame, block_bytes: int, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        schema = pa.schema([("block", pa.int64()), ("raw", pa.int64()), *((c, pa.binary()) for c in ("ids", "lens", "data", "contexts"))])
        ids, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal ids, texts, size, count
            lens, data = np.array([len(t) for t in texts], "<i8"), b"".join(texts)
            contexts = contexts_of(np.frombuffer(data, np.uint8), string_starts(lens, width), width, gram)
            row = ((part << 32) + count, size, np.array(ids, "<i8").tobytes(), lens.tobytes(), _z(data), _pack(*contexts))
            ids, texts, size, count = [], [], 0, count + 1
            return _table([row], schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield made()
        if ids:
            yield made()

    return docs.mapInArrow(run, _BLOCKS)


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if n < 1 << 16 else bucket, kind="stable")  # small keys sort by radix
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("blob", pa.binary())])
_SENT_DDL = "bucket int, block long, low long, high long, blob binary"
_ANSWER = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_ANSWER_DDL = "bucket int, block long, blob binary"


def _send_kinds(n: int, width: int, gram: int):
    """Of each kind of context: its anchor, its hash, and whether its first document is the first or last of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, width, gram)
            low, high, out = int(b.ids[0]), int(b.ids[-1]), []
            doc = b.doc[b.one]
            edge = (doc == low).astype(np.uint8) + 2 * (doc == high).astype(np.uint8)
            for bucket, i in _by_bucket(_buckets(b.key, n), n):
                keys = b.key[i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((bucket, row["block"], low, high, _pack(keys, b.kind[i].astype("<u8"), edge[i], small=False)))
            if out:
                yield _table(out, _SENT)

    return run


def _answer_kinds(hot: int):
    """For each kind sent: 1 if an earlier document holds it, 2 if it is to be indexed, 4 if its anchor is hot."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = sorted(_rows(batches), key=lambda r: r["block"])
        parts = [_unpack(r.pop("blob"), "u1", "<u8", "u1") for r in sent]
        size = np.array([len(p[1]) for p in parts])
        batch = np.repeat(np.arange(len(parts)), size)
        keys = np.zeros((len(batch), 8), np.uint8)
        keys[:, :6] = np.concatenate([p[0] for p in parts]).reshape(-1, 6)
        keys, kinds, edge = keys.view("<u8").ravel(), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        low, high = (np.array([r[c] for r in sent]) for c in ("low", "high"))
        order, new = by_value(kinds)
        first = np.empty(len(order), np.int64)  # the entry of the earliest batch with the same context
        first[order] = np.repeat(order[new], np.diff(np.r_[new, len(order)]))
        # batches share a document only if one ends and the other begins with it
        own = first == np.arange(len(first))
        own |= (edge[first] & 2 > 0) & (edge & 1 > 0) & (high[batch[first]] == low[batch])
        one = order[new]
        by_key, begins = by_value(keys[one])
        held = np.diff(np.r_[begins, len(one)])
        many = np.zeros(len(first), np.int64)
        many[one[by_key]] = np.repeat(held, held)
        many = many[first]
        said = (~own + 2 * (own & (many > 1)) + 4 * (own & (many >= hot))).astype(np.uint8)
        for r, hi, k in zip(sent, np.cumsum(size), size, strict=True):
            yield _table([(int(key[0].as_py()), r["block"], _pack(said[hi - k : hi]))], _ANSWER)

    return run


def _gathered(rows: DataFrame) -> DataFrame:
    """One row per block with the answers of all buckets."""
    return rows.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))


def _told(answers: list[dict] | None, keys: np.ndarray, n: int) -> np.ndarray:
    said, told = np.zeros(len(keys), np.uint8), {a["bucket"]: a["blob"] for a in answers or []}
    for b, i in _by_bucket(_buckets(keys, n), n):
        said[i] = _unpack(told[b], "u1")[0]
    return said


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for all i."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def _indexed(b: Block, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block has indexed: first string, number of strings, key to deal by and kind. Strings of hot anchors go one by one."""
    plain, hot = np.flatnonzero((said & 6) == 2), np.flatnonzero((said & 6) == 6)
    hot = hot[np.argsort(b.one[hot])]  # in order of place
    c, h = b.one[plain], b.one[hot]
    alone = _spread(b.first[h], b.n[h])
    first, n = np.r_[b.first[c], alone], np.r_[b.n[c], np.ones(len(alone), np.int64)]
    key = np.r_[b.key[plain], span_hashes(b.data, alone, (alone, b.width))[0] >> np.uint64(16)]
    return first, n, key, np.r_[plain, np.repeat(hot, b.n[h])]


def _send_contexts(n_buckets: int, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, out = Block(row, width, gram), []
            first, n, key, kind = _indexed(b, _told(row["answers"], b.key, n_buckets))
            doc = b.doc[b.one[kind]]
            for bucket, i in _by_bucket(_buckets(key, n_buckets), n_buckets):
                text = b.data[_spread(first[i], n[i] + width - 1)]
                out.append((bucket, row["block"], 0, 0, _pack(text, n[i].astype("<u2"), doc[i].astype("<i8"))))
            if out:
                yield _table(out, _SENT)

    return run


class SuffixArray:
    """Strings in the order of their bytes, each different one once, with the least document it starts in."""

    def __init__(self, strings: np.ndarray, docs: np.ndarray):
        self.strings, self.docs = strings, docs

    def merged(self, other: SuffixArray) -> SuffixArray:
        both, docs = np.concatenate([self.strings, other.strings]), np.concatenate([self.docs, other.docs])
        order = np.argsort(both, kind="stable")  # two ascending runs: a merge
        both, docs = both[order], docs[order]
        new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        return SuffixArray(both[new], np.minimum.reduceat(docs, new))


class Levels:
    """A logarithmic family: every batch is scanned against the arrays of the batches before it, then joins them."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def add(self, strings: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each string of a batch (in any order), whether it also starts in a document less than its own."""
        if not len(strings):
            return np.zeros(0, bool)
        order = np.argsort(strings, kind="stable")
        ranked = strings[order]
        new = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        level = SuffixArray(ranked[new], np.minimum.reduceat(docs[order], new))
        least = level.docs.copy()
        for old in self.levels:  # both ascend: a merge-scan
            at = np.minimum(np.searchsorted(old.strings, level.strings), len(old.strings) - 1)
            hit = old.strings[at] == level.strings
            least[hit] = np.minimum(least[hit], old.docs[at[hit]])
        earlier = np.empty(len(order), bool)
        earlier[order] = np.repeat(least, np.diff(np.r_[new, len(order)])) < docs[order]
        while self.levels and len(self.levels[-1].strings) <= 2 * len(level.strings):
            level = self.levels.pop().merged(level)
        self.levels.append(level)
        return earlier


def _answer_contexts(width: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bucket = Levels(), int(key[0].as_py())
        held, size = [], 0

        def scanned() -> pa.RecordBatch:
            nonlocal held, size
            earlier = index.add(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            ends = np.cumsum([len(h[2]) for h in held])
            out = [(bucket, h[0], _pack(np.packbits(earlier[hi - len(h[2]) : hi]))) for h, hi in zip(held, ends, strict=True)]
            held, size = [], 0
            return _table(out, _ANSWER)

        for row in sorted(_rows(batches), key=lambda r: r["block"]):
            text, n, doc = _unpack(row["blob"], "u1", "<u2", "<i8")
            n = n.astype(np.int64)
            span = n + width - 1
            at = _spread(np.cumsum(span) - span, n)
            held.append((row["block"], np.ndarray((len(text) - width + 1,), f"S{width}", text, strides=(1,))[at], np.repeat(doc, n)))
            size += len(at)
            if size >= BATCH:
                yield scanned()
        if held:
            yield scanned()

    return run


def _covered(b: Block, said: np.ndarray, found: list[dict] | None, n_buckets: int) -> np.ndarray:
    """Which bytes of a block go."""
    size = len(b.data)
    edges = np.zeros(size + 1, np.int8)
    # a kind's answer holds for its first document; of later documents with the same context every string goes
    whole = (said[b.of] & 1 > 0) | (b.doc > b.doc[b.one[b.of]])
    edges[b.first[whole]] += 1
    edges[b.first[whole] + b.n[whole]] -= 1
    starts = np.cumsum(edges[:size], dtype=np.int8) > 0
    first, n, key, kind = _indexed(b, said)
    told, begins = {a["bucket"]: a["blob"] for a in found or []}, np.cumsum(n) - n
    earlier = np.zeros(int(n.sum()), bool)
    for bucket, i in _by_bucket(_buckets(key, n_buckets), n_buckets):
        bits = _unpack(told[bucket], "u1")[0]
        earlier[_spread(begins[i], n[i])] = np.unpackbits(bits, count=int(n[i].sum())).astype(bool)
    # the answers of a kind, string after string, hold for each context of it
    marked = _spread(first, n)[earlier] - np.repeat(b.first[b.one[kind]], n)[earlier]
    if len(marked):
        kinds = np.repeat(kind, n)[earlier]
        more = np.flatnonzero(np.isin(b.of, kinds) & ~whole)
        bits = np.zeros((len(b.one), int(b.n.max())), bool)
        bits[kinds, marked] = True
        at = _spread(b.first[more], b.n[more])
        starts[at[bits[np.repeat(b.of[more], b.n[more]), at - np.repeat(b.first[more], b.n[more])]]] = True
    seen = np.cumsum(starts, dtype=np.int32)
    seen[b.width :] -= seen[: -b.width].copy()
    return seen > 0


def _finish(n_buckets: int, width: int, gram: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b, out = Block(row, width, gram), []
            gone = _covered(b, _told(row["anchors"], b.key, n_buckets), row["found"], n_buckets)
            for i, lo, hi in zip(b.ids.tolist(), (b.ends - b.lens).tolist(), b.ends.tolist(), strict=True):
                g, source = gone[lo:hi], b.data[lo:hi]
                n = int(np.count_nonzero(g))
                kept = source[~g].tobytes() if n else source.tobytes()
                spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if n else 0
                out.append((i, hi - lo, n, spans, hashlib.sha256(kept).hexdigest(), *((kept, hashlib.sha256(source.tobytes()).hexdigest(), kept.decode("utf-8", "ignore")) if texts else (None,) * 3)))
            yield _table(out, pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("source_sha256", pa.string()), ("kept_text", pa.string())]))

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row. doc_id is an integer column.

    If texts is set, also kept (the remaining bytes), kept_text (these as text, without the halves of characters that a
    cut splits) and source_sha256 (of the whole text).

    Null text counts as empty. Rows with one doc_id count as one document for what is smaller, so they remove nothing
    of each other; each keeps its own row. A null doc_id comes before all others. Texts under `width` bytes keep all. An empty
    table gives no rows. Columns of other names, clashing ones too, are not looked at.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"doc_id must be an integer column, not {kind}")
    if not 1 <= gram <= width <= REACH // 2:
        raise ValueError(f"gram must be at least 1 and no more than width, and width at most {REACH // 2}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.col("text").cast("binary"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # a doc_id of very many rows is spread
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id").select("id", "text")
    path = shared_dir(spark)
    _blocks(rows, block_bytes, width, gram).write.option("compression", "uncompressed").parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    n = max(parts, -(-total // (8 << 20)))
    sent = blocks.mapInArrow(_send_kinds(n, width, gram), _SENT_DDL)
    anchors = stash(_gathered(sent.groupBy("bucket").applyInArrow(_answer_kinds(hot), _ANSWER_DDL)))
    known = blocks.join(checked(anchors), "block", "left")
    contexts = known.mapInArrow(_send_contexts(n, width, gram), _SENT_DDL)
    found = stash(_gathered(contexts.groupBy("bucket").applyInArrow(_answer_contexts(width), _ANSWER_DDL)))
    both = blocks.join(checked(anchors.withColumnRenamed("answers", "anchors")), "block", "left").join(checked(found.withColumnRenamed("answers", "found")), "block", "left")
    done = both.mapInArrow(_finish(n, width, gram, texts), "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, source_sha256 string, kept_text string")
    doc_id = F.when(F.col("row_id") == -(2**63), F.lit(None)).otherwise(F.col("row_id")).cast(kind).alias("doc_id")
    return done.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "source_sha256", "kept_text"] if texts else []))
