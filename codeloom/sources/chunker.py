"""Cutting texts into overlapping chunks by bytes, along the coarsest separators that fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import CHUNK_MIN, CHUNK_OVERLAP, CHUNK_SIZE

SEPARATORS = (b"\n\n", b"\n", b". ", b" ")


def _char_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _pieces(data: bytes, lo: int, hi: int, size: int, level: int) -> list[tuple[int, int]]:
    """Spans of at most size bytes that cover lo..hi; a separator stays with what is before it."""
    if hi - lo <= size:
        return [(lo, hi)]
    if level == len(SEPARATORS):
        out = []
        while hi - lo > size:
            cut = _char_start(data, lo + size)
            cut = cut if cut > lo else lo + size
            out.append((lo, cut))
            lo = cut
        return [*out, (lo, hi)]
    sep = SEPARATORS[level]
    ends, at = [], data.find(sep, lo, hi)
    while at >= 0:
        ends.append(at + len(sep))
        at = data.find(sep, at + len(sep), hi)
    if not ends or ends[-1] < hi:
        ends.append(hi)
    if len(ends) == 1:
        return _pieces(data, lo, hi, size, level + 1)
    out, start, last = [], lo, lo
    for e in ends:
        if e - start > size and last > start:
            out += _pieces(data, start, last, size, level + 1)
            start = last
        last = e
    return out + (_pieces(data, start, hi, size, level + 1) if start < hi else [])


def spans(text: str, size: int = CHUNK_SIZE, least: int = CHUNK_MIN, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    data = text.encode()
    if not data:
        return []
    merged: list[tuple[int, int]] = []
    for a, b in _pieces(data, 0, len(data), size, 0):
        if merged and merged[-1][1] - merged[-1][0] < least:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    if len(merged) > 1 and merged[-1][1] - merged[-1][0] < least:
        merged[-2:] = [(merged[-2][0], merged[-1][1])]
    out = merged[:1]
    for (_, before), (a, b) in zip(merged, merged[1:], strict=False):
        if overlap:
            back = _char_start(data, max(0, before - overlap))
            line = data.find(b"\n", back, a)
            a = line + 1 if line >= 0 else back
        out.append((a, b))
    return out


def chunk(text: str, size: int = CHUNK_SIZE, least: int = CHUNK_MIN, overlap: int = CHUNK_OVERLAP) -> list[tuple[str, int, int, int, int]]:
    """(text, start_line, end_line, start_byte, end_byte) of each chunk; a chunk that ends in a newline claims the next line."""
    data = text.encode()
    return [(data[a:b].decode(), data.count(b"\n", 0, a) + 1, data.count(b"\n", 0, b) + 1, a, b) for a, b in spans(text, size, least, overlap)]


def chunked(files: DataFrame, *, size: int = CHUNK_SIZE, least: int = CHUNK_MIN, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(file_path, language, content, start_line, end_line, start_byte, end_byte) of files (path, language, content as text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, g, *c) for p, g, t in zip(b["path"], b["language"], b["content"], strict=True) for c in chunk(t or "", size, least, overlap)]
            yield pd.DataFrame(rows, columns=["file_path", "language", "content", "start_line", "end_line", "start_byte", "end_byte"])

    return files.select("path", "language", "content").mapInPandas(run, "file_path string, language string, content string, start_line int, end_line int, start_byte int, end_byte int")
