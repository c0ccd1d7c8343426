"""Splitting oversized items at natural boundaries.

Dynamic programming over boundary positions minimises cut penalties and size imbalance, subject
to a maximum length and a specified overlap between consecutive pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4

_SENTENCE = re.compile(rb"[.!?;:}\])][\"')]*(?=\s)")
_SOFT = re.compile(rb"[\s,;(){}\[\]]+")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
_BLANK = re.compile(rb"[ \t\r\f\v]*\n?\Z")
_HEADING = re.compile(rb"#{1,6} |[=\-]{3,}")
_CLOSER = re.compile(rb"[)\]}]+[;,]?\s*\Z|end\s*\Z")

SCHEMA = "id long, piece_no int, content string, token_count int, line_start int, line_end int"


def _inside(line: bytes, gap: int) -> list[tuple[int, float]]:
    """Boundaries inside one long line, no two further apart than ``gap`` bytes: after a sentence,
    after white space or punctuation, else between two characters."""
    marks: dict[int, float] = {m.end(): 0.8 for m in _SOFT.finditer(line)}
    marks.update({m.end(): 0.6 for m in _SENTENCE.finditer(line)})
    marks.pop(len(line), None)
    out, last, step = [], 0, max(gap // 4, 1)
    for p in [*sorted(marks), len(line)]:
        while p - last > gap:
            q = last + gap
            while q > last + 1 and line[q] & 0xC0 == 0x80:
                q -= 1
            out.append((q, 1.0))
            last = q
        if p < len(line) and (p - last >= step or marks[p] < 0.7):
            out.append((p, marks[p]))
            last = p
    return out


def boundaries(data: bytes, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which a cut is possible (0 and the end among them) and its penalty."""
    pos, pen = [0], [0.0]
    at, before = 0, b""
    blank_before = False
    for m in _LINE.finditer(data):
        line = m.group()
        blank = _BLANK.match(line) is not None
        if at:
            if blank:
                p = 0.5
            else:
                indent = len(line) - len(line.lstrip(b" \t"))
                if _HEADING.match(line):
                    p = 0.05
                elif blank_before:
                    p = 0.0 if indent == 0 else 0.15 + 0.01 * min(indent, 10)
                elif indent == 0 and _CLOSER.match(before.strip()):
                    p = 0.1
                else:
                    p = 0.4 + 0.02 * min(indent, 10)
            pos.append(at)
            pen.append(p)
        if len(line) > gap:
            for q, p in _inside(line, gap):
                pos.append(at + q)
                pen.append(p)
        at += len(line)
        before, blank_before = line, blank
    pos.append(len(data))
    pen.append(0.0)
    return np.array(pos, dtype=np.int64), np.array(pen)


def split_bytes(data: bytes, limit: int, overlap: float) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``data``, none longer than ``limit`` bytes, each starting about
    ``overlap`` times the length of the piece before it ahead of that piece's end.

    f(s) is the least cost of covering the text from s; the piece that starts at s may end at any
    boundary e within the limit and settles where the next piece starts, so f needs one state per
    boundary: f(s) = min over e of cut(e) + imbalance(s, e) + f(next(s, e))."""
    n = len(data)
    if n <= limit:
        return [(0, n)]
    pos, pen = boundaries(data, max(4, limit // 16))
    m = len(pos)
    body = limit * (1 - overlap)
    count = max(2, int(np.ceil((n - limit * overlap) / body)))
    target = min(limit, n / (count - (count - 1) * overlap))
    far = np.searchsorted(pos, pos + limit, side="right")
    f, cut, then = np.full(m, np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
    f[m - 1] = 0.0
    for i in range(m - 2, -1, -1):
        hi = far[i]
        ends = pos[i + 1 : hi]
        size = ends - pos[i]
        want = ends - overlap * size
        k = np.searchsorted(pos, want)
        k -= (want - pos[k - 1]) < (pos[k] - want)
        js = np.arange(i + 1, hi)
        np.clip(k, i + 1, np.maximum(js - 1, i + 1) if overlap else js, out=k)
        if hi == m:
            k[-1] = m - 1
        cost = pen[i + 1 : hi] + (size / target - 1.0) ** 2 + 0.25 + f[k]
        b = int(cost.argmin())
        f[i], cut[i], then[i] = cost[b], i + 1 + b, k[b]
    out, i = [], 0
    while i < m - 1:
        out.append((int(pos[i]), int(pos[cut[i]])))
        i = int(then[i]) if cut[i] < m - 1 else m - 1
    return out


def split_text(text: str, max_tokens: int = 512, overlap: float = 0.12, first_line: int = 1) -> list[tuple[str, int, int, int]]:
    """Pieces of one text as (content, token_count, line_start, line_end)."""
    data = text.encode("utf-8", "surrogatepass")
    limit = max_tokens * BYTES_PER_TOKEN + BYTES_PER_TOKEN - 1
    out = []
    at, line = 0, first_line
    for s, e in split_bytes(data, limit, overlap):
        line += data.count(b"\n", at, s)
        at = s
        last = line + data.count(b"\n", s, max(s, e - 1))
        out.append((data[s:e].decode("utf-8", "surrogatepass"), (e - s) // BYTES_PER_TOKEN, line, last))
    return out


def split_oversized(
    df: DataFrame,
    id_col: str = "id",
    content_col: str = "content",
    line_start_col: str | None = "line_start",
    line_end_col: str | None = "line_end",
    max_tokens: int = 512,
    overlap: float = 0.12,
) -> DataFrame:
    """Pieces (id, piece_no, content, token_count, line_start, line_end) of the items over the limit.

    Tokens are UTF-8 bytes / 4, rounded down; a stored token count is never used. Items within the
    limit, null and empty contents give no row. The first line of an item is the smaller of its line
    numbers where both are at least 1, else the one that is, else 1. Exact repetitions of an item
    (same id and content) come out once; two different contents under one id both come out. Other
    columns of ``df`` are ignored, whatever their names. Each input row is handled alone, so one
    very long text costs its own length and no key is skewed."""
    if max_tokens < 2 or not 0 <= overlap < 0.5:
        raise ValueError("max_tokens must be at least 2 and overlap in [0, 0.5)")
    limit = max_tokens * BYTES_PER_TOKEN + BYTES_PER_TOKEN - 1
    a = F.col(line_start_col).cast("long") if line_start_col else F.lit(None).cast("long")
    b = F.col(line_end_col).cast("long") if line_end_col else F.lit(None).cast("long")
    a, b = F.when(a >= 1, a), F.when(b >= 1, b)
    first = F.coalesce(F.least(a, b), F.lit(1)).cast("int")
    rows = df.filter(F.octet_length(content_col) > limit).select(
        F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content"), first.alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece_no", "content", "token_count", "line_start", "line_end"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, text, first_line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for no, piece in enumerate(split_text(text, max_tokens, overlap, first_line)):
                    out.append((i, no, *piece))
                    held += len(piece[0])
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, SCHEMA)


def distinct_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of repeated rows once: a piece is told by its id, number and content."""
    return pieces.dropDuplicates(["id", "piece_no", "content"])


def oversized_ids(pieces: DataFrame) -> DataFrame:
    """chunk_id of each item that was split."""
    return pieces.filter("piece_no = 0").select(F.col("id").alias("chunk_id")).distinct()
