"""SentencePiece encoding with byte offsets, and decoding.

Text is normalised by the model's compiled character map: at each place the longest prefix that the map
knows is replaced, and every normalised byte keeps the source byte it came from. The normalised text is cut
where no piece can lie across, the parts are encoded by the library, and each piece is projected through the
kept alignment to a span of bytes of the original text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import pick

SPACE = "▁"  # stands for a space in pieces
CACHE_PARTS = 100_000  # parts a worker remembers before it starts afresh
SLICE_CHARS = 1 << 21
LONG_PART = 48
_CUT = re.compile(f"(?<=[^ {SPACE}]) ")
_UNIT = re.compile(rb"[\x00-\x7f]|[\xc2-\xf4][\x80-\xbf]{1,3}")


class CharacterMap:
    """A compiled map: a double-array trie over byte strings and a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of text[at:] and its replacement."""
        units, found = self.units, None
        if not units:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & 0x200) >> 6)

        node = offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            u = units[node]
            if u & 0x800000FF != text[i]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        norm = model.normalizer_spec
        self.map, self.dummy = CharacterMap(norm.precompiled_charsmap), norm.add_dummy_prefix
        self.squeeze = norm.remove_extra_whitespaces
        pieces = [p.piece for p in model.pieces]
        self.pieces = pieces
        self.n_bytes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.shown = np.array([1 if p.type == 6 else len(p.piece.replace(SPACE, " ").encode()) for p in model.pieces], np.int64)
        self.decimal = [str(i) for i in range(len(pieces))].__getitem__
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        #: parts can be encoded apart if no piece has a space after its first other character
        self.parted = norm.escape_whitespaces and self.dummy and not self.squeeze and not self.map.units and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.lone = self.sp.piece_to_id(SPACE)
        self.known: dict[str, list[int]] = {}

    # -- normalisation with alignment ----------------------------------------------------------------
    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and for the end, the source byte it starts at."""
        out, source, at, n = bytearray(), [], 0, len(text)
        space = SPACE.encode()
        if not text:
            return b"", np.zeros(1, np.int64)
        start = 0
        if self.squeeze:
            while at < n and (hit := self._unit(text, at)) and not hit[1].strip(b" "):
                at += hit[0]
            start = at
            if at == n:
                return b"", np.array([n], np.int64)
        if self.dummy:
            out += space
            source += [start] * len(space)
        blank = self.squeeze
        while at < n:
            took, new = self._unit(text, at)
            if blank and self.squeeze:
                new = new.lstrip(b" ")
            if new:
                piece = bytearray()
                for k in range(len(new)):
                    piece += space if new[k] == 32 else new[k : k + 1]
                out += piece
                source += [at] * len(piece) if self.map.units and took != len(piece) else _steps(at, took, len(piece))
                blank = new.endswith(b" ")
            at += took
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = source[len(out)]
                del source[len(out) :]
                n = end
        return bytes(out), np.array([*source, n], np.int64)

    def _unit(self, text: bytes, at: int) -> tuple[int, bytes]:
        hit = self.map.longest(text, at)
        if hit:
            return hit
        m = _UNIT.match(text, at)
        return (len(m[0]), m[0]) if m else (1, "�".encode())

    # -- encoding ------------------------------------------------------------------------------------
    def _lengths(self, ids: np.ndarray, text: str) -> np.ndarray:
        """Bytes of normalised text under each id; only unknown pieces need a second look at the text."""
        lens = self.n_bytes[ids]
        if len(ids) and (ids == self.sp.unk_id()).any():
            pieces = self.sp.encode(text, out_type=str)
            lens = np.array([1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, pieces, strict=True)], np.int64)
        return lens

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """For each text: ids, first byte and end byte of each piece in its UTF-8, and the ids in decimal joined by commas.

        A piece made only of the space put before the text has an empty span.
        """
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= SLICE_CHARS:
                yield from self._slice(some)
                some, size = [], 0
        yield from self._slice(some)

    def _slice(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        if not self.parted:
            yield from map(self._whole, texts)
            return
        cut = [t.split(" ") if "  " not in t and SPACE not in t and t[:1] != " " else _CUT.split(t) for t in texts]
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        new = [p for p in set().union(*cut).difference(self.known) if p]
        fresh = dict(zip(new, self.sp.encode(new, num_threads=1), strict=True))
        self.known.update(fresh if max(map(len, new), default=0) <= LONG_PART else {p: x for p, x in fresh.items() if len(p) <= LONG_PART})
        self.known[""] = [self.lone]
        known = self.known
        for text, parts in zip(texts, cut, strict=True):
            if not text:
                yield [], np.zeros(0, np.int64), np.zeros(0, np.int64), ""
                continue
            try:
                ids = list(chain.from_iterable(map(known.__getitem__, parts)))
            except KeyError:
                ids = list(chain.from_iterable([known[p] if p in known else fresh[p] for p in parts]))
            yield (ids, *self._spans(np.array(ids, np.int32), text), ",".join(map(self.decimal, ids)))

    def _spans(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        unknown = len(ids) and (ids == self.sp.unk_id()).any()
        if not self.map.units and self.dummy and not self.squeeze and SPACE not in text and not unknown and len(ids):
            # the map changes nothing and keeps every byte: a piece covers as many bytes as it shows
            ends = np.cumsum(self.shown[ids]) - 1
            return np.concatenate([[0], ends[:-1]]), ends
        to = self.normalise(text.encode())[1]
        lens = self._lengths(ids, text)
        ends = np.cumsum(lens)
        return to[ends - lens], to[ends]

    def _whole(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        ids = self.sp.encode(text)
        return (ids, *self._spans(np.array(ids, np.int32), text), ",".join(map(self.decimal, ids)))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def _steps(at: int, took: int, n: int) -> list[int]:
    return [at + min(i, took - 1) for i in range(n)] if n == took else [at] * n


_loaded: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row: ids with the spans of bytes they stand for.

    Null text counts as empty: no ids, empty decoded text. Row-wise and without a shuffle, so a lost executor
    costs only its own batches; a very long text is held once.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(c: PieceCodec, made: tuple) -> tuple:
        ids, starts, ends, _ = made
        return ids, starts, ends, c.decode(ids)

    kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
    return _each(docs, model, rows, kinds, f"doc_id {kind}, ids array<int>, starts array<long>, ends array<long>, decoded string", ["ids", "starts", "ends", "decoded"])


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes): digests of encode_pieces() taken where the rows are made.

    span_bytes is the number of source bytes under the spans.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(c: PieceCodec, made: tuple) -> tuple:
        ids, starts, ends, listed = made
        back = c.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), int((ends - starts).sum())

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return _each(docs, model, rows, kinds, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long", ["n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"])


def _each(docs: DataFrame, model: str, rows: Callable, kinds: list[pa.DataType], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                got = [rows(c, x) for x in c.encode_all(s.column(1).to_pylist())]
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], ["doc_id", *names])
        c.known.clear()  # an idle worker keeps no parts

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)
