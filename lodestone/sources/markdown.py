"""Chunks of Markdown files: sections by heading, packed to a size; fences and front matter stay whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET_BYTES = 6000
_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")


def _whole_blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Line ranges that are never cut, in order: front matter, then fences (an open fence runs to the end)."""
    out, at = [], 0
    if lines and lines[0].strip() == "---":
        end = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)
        if end is not None:
            out, at = [(0, end)], end + 1
    while at < len(lines):
        m = _FENCE.match(lines[at])
        if m:
            mark, n = m[1][0], len(m[1])
            closing = re.compile(rf" {{0,3}}{re.escape(mark)}{{{n},}}\s*$")
            end = next((i for i in range(at + 1, len(lines)) if closing.match(lines[i])), len(lines) - 1)
            out.append((at, end))
            at = end
        at += 1
    return out


def spans(text: str, target: int = TARGET_BYTES) -> list[tuple[int, int]]:
    """Zero-based inclusive line ranges of the chunks. Every line that is not blank lies in one; an empty text has none."""
    lines = text.split("\n")
    size = [len(x.encode()) + 1 for x in lines]
    whole = _whole_blocks(lines)
    kept = [False] * len(lines)
    for a, b in whole:
        kept[a : b + 1] = [True] * (b - a + 1)
    starts = {0}
    for i, x in enumerate(lines):
        if kept[i]:
            continue
        if _ATX.match(x):
            starts.add(i)
        elif i and _UNDERLINE.match(x) and lines[i - 1].strip() and not kept[i - 1] and not _ATX.match(lines[i - 1]):
            starts.add(i - 1)
    if whole and whole[0][0] == 0 and lines[0].strip() == "---":
        starts.add(whole[0][1] + 1)
    ends_of = dict(whole)
    out, edges = [], sorted(s for s in starts if s < len(lines))
    for a, b in zip(edges, [*edges[1:], len(lines)], strict=True):
        pieces, at = [], a
        while at < b:  # paragraphs and whole blocks
            if not lines[at].strip() and not kept[at]:
                at += 1
                continue
            end = ends_of.get(at)
            if end is None:
                end = at
                while end + 1 < b and lines[end + 1].strip() and not kept[end + 1]:
                    end += 1
            pieces.append((at, end))
            at = end + 1
        packed: list[tuple[int, int]] = []
        for p, q in pieces:
            if packed and sum(size[packed[-1][0] : q + 1]) - 1 <= target:
                packed[-1] = packed[-1][0], q
            else:
                packed.append((p, q))
        out += packed
    return out


def chunks(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(path, start_line, end_line, code) of files (path, text), lines from 1. Null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py() or ""
                lines = t.split("\n")
                rows += [(path, p + 1, q + 1, "\n".join(lines[p : q + 1])) for p, q in spans(t, target)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])], ["path", "start_line", "end_line", "code"])

    return files.select("path", "text").mapInArrow(run, "path string, start_line long, end_line long, code string")
