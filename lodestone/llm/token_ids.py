"""Token-ID output: encoded documents as Parquet list columns, and reading them back.

Layout: one directory of Parquet files, one per range of doc_id in ascending order. Columns are
doc_id, part (file number), n_tokens, local_start (ids of the file before the row) and ids. The writer
sets row-group and page sizes and the second page format: dictionary pages for the ids, delta encoding for
long runs of integers, column and offset indexes for skipping pages. A reader that wants only the metadata
columns never touches the ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import pick

CACHE_PIECES = 1_200_000  # pieces a worker remembers before it starts afresh
LONG_PIECE = 48  # longer pieces are encoded each time, not remembered
SLICE_CHARS = 1 << 21  # text split at once
ROW_PIECES = 4096  # new pieces encoded as one text
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: texts are cut into words, with a space before them that follows no other white space, and what lies between them
_PIECES = re.compile(rf" ?[{_LATIN}]+|[^{_LATIN}]+?(?=[{_LATIN}]|(?<!\s) [{_LATIN}]|\Z)")
#: texts with any of these between words
_UNUSUAL = re.compile(rf"\s\s|'|[^\x00-\x7f{_LATIN}«»„“”…–—€]")
#: are cut at single spaces between two characters that are no white space
_SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")


class ByteBpe:
    """A tokenizers file with a memory of pieces.

    Texts are cut only where the pre-tokenizer always cuts: before a single space between two characters that
    are no white space, and, in texts of Latin letters without apostrophes or runs of white space, between a
    word and what is not a word. Strings of special tokens count as ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.unusual: set[str] = set()  # pieces between words that texts are not cut around
        self.sizes = np.zeros(self.tok.get_vocab_size(), np.int64)  # bytes of each id: its characters stand for one byte each
        for token, i in self.tok.get_vocab().items():
            self.sizes[i] = len(token)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= SLICE_CHARS:
                yield from self._slice(some)
                some, size = [], 0
        yield from self._slice(some)

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        cut = [_PIECES.findall(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
            self.unusual.clear()
        new = set().union(*cut).difference(self.known)
        found = {w for w in new if _UNUSUAL.search(w)}
        if found or self.unusual:
            self.unusual |= {w for w in found if len(w) <= LONG_PIECE}
            found |= self.unusual
            cut = [c if found.isdisjoint(c) else _SAFE_SPACE.split(t) for c, t in zip(cut, texts, strict=True)]
            new = set().union(*cut).difference(self.known)
        known = fresh = self._new(list(new))
        if any(len(w) > LONG_PIECE for w in new):
            known = {w: x for w, x in fresh.items() if len(w) <= LONG_PIECE}
        self.known.update(known)
        known = self.known
        for pieces in cut:
            try:
                yield b"".join(map(known.__getitem__, pieces))
            except KeyError:
                yield b"".join([known[w] if w in known else fresh[w] for w in pieces])

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces of a space and a word are encoded many in a row, as the pre-tokenizer cuts before each; the ids' byte lengths tell them apart."""
        row = [w for w in pieces if len(w) > 1 and w[0] == " " and not (w[1].isspace() or w[-1].isspace())]
        rest = set(pieces).difference(row)
        out: dict[str, bytes] = {}
        parts = [row[lo : lo + ROW_PIECES] for lo in range(0, len(row), ROW_PIECES)]
        for part, got in zip(parts, self.tok.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter((len(w.encode()) for w in part), np.int64, len(part)))
            at = np.searchsorted(ends, wanted)
            if ends[-1] != wanted[-1] or (ends[at] != wanted).any():
                rest.update(part)
                continue
            blob, cuts = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
            out.update(zip(part, [blob[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        alone = list(rest)
        out.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False), strict=True))
        return out


_loaded: dict[str, ByteBpe] = {}


def _bpe(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Rows (doc_id, part, n_tokens, local_start, ids), range-partitioned and sorted by doc_id.

    Null text counts as empty, so its row holds the end id alone. A null doc_id sorts first; repeated doc_ids
    stay as rows of their own, in the order of a hash of the text. Spreading by (doc_id, hash) keeps a doc_id
    that holds many rows from filling one task.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = _bpe(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                blobs = [x + end for x in bpe.encode(s.column(1).to_pylist())]
                lens = np.array([len(x) // 4 for x in blobs], np.int64)
                starts = np.concatenate([[0], np.cumsum(lens)])
                values = pa.Array.from_buffers(pa.int32(), int(starts[-1]), [None, pa.py_buffer(b"".join(blobs))])
                ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(np.full(len(lens), part, np.int32)), pa.array(lens), pa.array(at + starts[:-1]), ids],
                    ["doc_id", "part", "n_tokens", "local_start", "ids"],
                )
                at += int(starts[-1])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, part int, n_tokens long, local_start long, ids array<int>")


def write_tokens(encoded: DataFrame, path: str, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes encode_sorted() rows; a lost task is redone by Spark's committer."""
    encoded.write.options(**{
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": "2000",
        "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "v2", "compression": "zstd", "parquet.compression.codec.zstd.level": "1",
    }).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens): where each document's ids lie in the whole sequence. Reads no ids."""
    rows = spark.read.parquet(path).select("doc_id", "part", "n_tokens", "local_start")
    return _with_start(rows, rows)


def _with_start(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds start from one total per file; a row per file is what tasks and broadcast hold, however many documents there are."""
    from pyspark.sql import Window

    per_file = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, n_tokens, ids, start) of every document."""
    rows = spark.read.parquet(path)
    return _with_start(rows, rows.select("part", "n_tokens"))


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(memoryview(flat[lo:hi])) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
