"""Elements of source files as chunks for an index: header, context before, splits, summaries.

Each file is handled alone in ``applyInPandas`` groups of its elements; a file is one task's work, as it is
one parse."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TOKENS = 512
CONTEXT_TOKENS, CONTEXT_LINES = 150, 10
_BODY = re.compile(r"^\s*(?:pub |export |public |private |static |async |def |fn |func |function |class |struct |impl |trait )")
_DECLARES = re.compile(r"^\s*(?:use |import |from |#include|const |type |let |var |package |mod |require)")
_METHOD = re.compile(r"^\s+(?:pub(?:\([^)]*\))? |public |private |protected |static |async |override )*(?:def |fn |func |function |\w+\s*\([^;]*\)\s*\{)")


def tokens(text: str) -> int:
    return max(1, len(text.encode()) // 4)


def backward_context(lines: list[str], start: int) -> list[str]:
    """Lines before index ``start``, nearest first taken, until 150 tokens or 10 lines."""
    out: list[str] = []
    used = 0
    for line in reversed(lines[max(0, start - CONTEXT_LINES) : start]):
        used += tokens(line)
        if used > CONTEXT_TOKENS:
            break
        out.append(line)
    return out[::-1]


def declarations(lines: list[str]) -> list[str]:
    """Imports, constants and types before the first body."""
    out = []
    for line in lines:
        if _BODY.match(line) and not _DECLARES.match(line):
            break
        if _DECLARES.match(line):
            out.append(line.strip())
    return out


def header(path: str, language: str, kind: str, name: str, declared: list[str], references: list[str]) -> str:
    parts = [f"// {language} {path}", f"// {kind} {name}"]
    if declared:
        parts.append("// uses " + "; ".join(declared[:8]))
    if references:
        parts.append("// calls " + ", ".join(references[:10]))
    return "\n".join(parts)


def split_points(lines: list[str], kind: str, most: int) -> list[int]:
    """Lines at which an element may be cut: methods of a type, statements at the base indent of a function,
    else every so many lines, at a blank one nearby if there is one."""
    if kind in ("class", "impl", "trait"):
        found = [i for i, line in enumerate(lines) if i and _METHOD.match(line)]
    elif kind in ("function", "test"):
        indents = [len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()]
        base = min(indents, default=0)
        found = [i for i, line in enumerate(lines) if i and line.strip() and len(line) - len(line.lstrip()) == base and not line.strip().startswith(("}", ")", "]", "else", "end"))]
    else:
        found = []
    if found:
        return found
    step = max(10, most * 4 // 80)
    out, at = [], step
    while at < len(lines):
        near = [j for j in range(max(1, at - 5), min(len(lines), at + 6)) if not lines[j].strip()]
        cut = min(near, key=lambda j: abs(j - at)) if near else at
        if out and cut <= out[-1]:
            cut = at
        out.append(cut)
        at = cut + step
    return out


def merged(points: list[int], lines: list[str], most: int) -> list[tuple[int, int]]:
    """Ranges between the points, small ones gathered while they hold less than a quarter of the limit."""
    bounds = [0, *points, len(lines)]
    out: list[tuple[int, int]] = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if out and tokens("\n".join(lines[out[-1][0] : out[-1][1]])) < most // 4:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


SCHEMA = "id long, symbol_path string, kind string, line_start int, line_end int, token_count int, content string"


def chunk_elements(elements: DataFrame, files: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Chunks of elements (id, name, kind, line_start, line_end, references) of files (id, path, language,
    content): header, context and body; bodies over the limit as ``name[i/n]``."""
    j = elements.select("id", "name", "kind", "line_start", "line_end", "references").join(files.select("id", "path", "language", "content"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text = str(pdf["content"].iloc[0]).replace("\r\n", "\n")
        lines = text.split("\n")
        declared = declarations(lines)
        rows = []
        for r in pdf.itertuples():
            head = header(r.path, r.language, r.kind, r.name, declared, list(r.references))
            before = backward_context(lines, r.line_start - 1)
            body = lines[r.line_start - 1 : r.line_end]
            whole = "\n".join([head, *before, *body])
            if tokens(whole) <= most:
                rows.append((r.id, r.name, r.kind, r.line_start, r.line_end, tokens(whole), whole))
                continue
            parts = merged(split_points(body, r.kind, most), body, most)
            for i, (a, b) in enumerate(parts, 1):
                t = "\n".join([head, *body[a:b]])
                rows.append((r.id, f"{r.name}[{i}/{len(parts)}]", r.kind, r.line_start + a, r.line_start + b - 1, tokens(t), t))
        return pd.DataFrame(rows, columns=["id", "symbol_path", "kind", "line_start", "line_end", "token_count", "content"])

    return j.groupBy("id").applyInPandas(run, SCHEMA)


#: A line that declares something, without the blanks around it: no comment, attribute or decorator.
_SIGNATURE = r"(?sU)^\s*+(?!//|#|/\*|\*|@)(.*\S)"


def summaries(chunks: DataFrame, least: int = 3, most: int = MOST_TOKENS) -> DataFrame:
    """(file_id, leaves, content) of files with ``least`` chunks: first lines, public ones first, under the limit.
    A chunk that has no such line (all comment, blank or empty) is a leaf and adds nothing to the content."""
    line = F.try_element_at(F.filter(F.split("content", "\n"), lambda x: x.rlike(_SIGNATURE)), F.lit(1))
    rows = chunks.select("file_id", (F.col("visibility") != "public").alias("p"), "line_start", "id", F.regexp_extract(line, _SIGNATURE, 1).alias("t"))
    item = F.when(F.col("t").isNotNull(), F.struct("p", "line_start", "id", "t"))
    g = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("s"), F.count(F.lit(1)).alias("leaves")).filter(F.col("leaves") >= least)
    kept = F.aggregate("s", F.lit(""), lambda t, x: F.when(F.length(t) + F.length(x["t"]) + 1 <= most * 4, F.concat(t, x["t"], F.lit("\n"))).otherwise(t))
    return g.select("file_id", "leaves", kept.alias("content"))


PARTS = "id long, name string, kind string, before string, declared string, points array<int>, ranges array<struct<start: int, stop: int>>"


def element_parts(elements: DataFrame, files: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Per element (id, name, kind, line_start, line_end) of files (id, content): the lines before it, what its file
    declares, the lines at which it may be cut, and the ranges that are left once small ones are gathered. A file's
    text goes with its own elements alone, gathered into one row, so nothing is shuffled but the elements."""
    item = F.struct("line_start", "line_end", "name", "kind")
    rows = elements.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("e")).join(files.select("id", "content"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, own, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = text.replace("\r\n", "\n").split("\n")
                declared = "\n".join(declarations(lines))
                for e in own:
                    body = lines[max(0, e["line_start"] - 1) : e["line_end"]]
                    points = split_points(body, e["kind"], most)
                    ranges = [{"start": x, "stop": y} for x, y in merged(points, body, most)]
                    out.append({"id": i, "name": e["name"], "kind": e["kind"], "before": "\n".join(backward_context(lines, e["line_start"] - 1)), "declared": declared, "points": points, "ranges": ranges})
            yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    return rows.select("id", "e", "content").mapInArrow(run, PARTS)


_PARTS = pa.schema([
    ("id", pa.int64()), ("name", pa.string()), ("kind", pa.string()), ("before", pa.string()), ("declared", pa.string()),
    ("points", pa.list_(pa.int32())), ("ranges", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
])
