"""Documents, code, diffs and logs taken apart into rows.

Line-based formats are declarative: lines with positions, a running sum over the marks that begin a
part. Code goes through a Python parser per file in ``mapInArrow`` batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) of each line, from 0; carriage returns dropped."""
    text = F.regexp_replace(text_col, "\r\n?", "\n")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def sections(docs: DataFrame, id_col: str, text_col: str, begins: Column, name: Column, keep_head: bool = False) -> DataFrame:
    """(id, section, name, line_start, line_end, content) of the parts that begin at lines with ``begins``
    (over the column ``line``); lines before the first are dropped if any follows, unless ``keep_head``."""
    l = lines(docs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = l.withColumn("b", F.when(begins, 1).otherwise(0)).withColumn("section", F.sum("b").over(w))
    out = l.groupBy("id", "section").agg(
        F.max(F.when(F.col("b") == 1, name)).alias("name"), (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )
    if not keep_head:
        most = out.groupBy("id").agg(F.max("section").alias("most"))
        out = out.join(most, "id").filter("section > 0 or most = 0").drop("most")
    return out


def markdown(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return sections(docs, id_col, text_col, F.col("line").startswith("#"), F.trim(F.regexp_replace("line", r"^#+\s*", "")))


def toml(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return sections(docs, id_col, text_col, F.col("line").rlike(r"^\s*\[\[?[^\]]+\]\]?\s*$"), F.regexp_extract("line", r"\[\[?([^\]]+)\]", 1))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block, name, line_start, line_end, content) of the parts between blank lines; ``block_i``."""
    l = lines(docs, id_col, text_col).withColumn("blank", F.trim("line") == "")
    w = Window.partitionBy("id").orderBy("pos")
    l = l.withColumn("b", F.when(~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True)), 1).otherwise(0))
    l = l.withColumn("block", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).filter("not blank")
    return l.groupBy("id", "block").agg(
        F.concat(F.lit("block_"), F.first("block").cast("string")).alias("name"), (F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("content"),
    )


HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def diff_hunks(diffs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, file, start_line, line_count, content) of the hunks of unified diffs; hunks without a changed
    line are dropped; a count left out is 1."""
    l = lines(diffs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file = F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w)
    head = F.col("line").rlike(HUNK)
    l = l.withColumn("file", file).withColumn("hunk", F.sum(F.when(head, 1).otherwise(0)).over(w))
    l = l.filter(~F.col("line").rlike(r"^(?:diff |index |--- |\+\+\+ )") & (F.col("hunk") > 0))
    count = F.regexp_extract("line", HUNK, 2)
    g = l.groupBy("id", "hunk").agg(
        F.max("file").alias("file"), F.max(F.when(head, F.regexp_extract("line", HUNK, 1).cast("int"))).alias("start_line"),
        F.max(F.when(head, F.when(count == "", 1).otherwise(count.try_cast("int")))).alias("line_count"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"].rlike(r"^[+\-]")), lambda s: s["line"]), "\n").alias("content"),
    )
    return g.filter("content <> ''").select("id", "file", "start_line", "line_count", "content")


def git_log(logs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, message, author, committed_at, files) of ``git log`` output whose records are hash, message,
    author and time, one a line, a blank line and the files."""
    record = F.explode(F.split(F.trim(F.col(text_col)), r"\n(?=[0-9a-f]{40}\n)"))
    p = F.split("r", "\n")
    return logs.select(record.alias("r")).select(
        p[0].alias("hash"), p[1].alias("message"), p[2].alias("author"), p[3].alias("committed_at"), F.filter(F.slice(p, 5, F.greatest(F.size(p), F.lit(1))), lambda x: F.trim(x) != "").alias("files")
    ).filter(F.col("hash").rlike("^[0-9a-f]{40}$"))


def plan_steps(plans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, step, text) of bulleted or numbered plans; lines that go on belong to the step before them."""
    l = lines(plans, id_col, text_col).withColumn("line", F.trim("line")).filter("line <> ''")
    mark = r"^(?:[-*+]|\d+[.)])\s+"
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = l.withColumn("step", F.sum(F.when(F.col("line").rlike(mark), 1).otherwise(0)).over(w)).filter("step > 0")
    return l.groupBy("id", "step").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("line", mark, "").alias("t")))), lambda s: s["t"]), " ").alias("text"))


def prose_chunks(text: str, target: int = 400) -> list[str]:
    """Paragraphs gathered to about ``target`` tokens (characters / 4 + 1 each)."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in re.split(r"\n\s*\n", text):
        p = p.strip()
        if not p:
            continue
        n = len(p) // 4 + 1
        if held and size + n > target:
            out.append("\n\n".join(held))
            held, size = [], 0
        held.append(p)
        size += n
    if held:
        out.append("\n\n".join(held))
    return out


def _python_elements(source: str) -> list[tuple[str, str, int, int, str | None, str, list[str]]]:
    out: list[tuple[str, str, int, int, str | None, str, list[str]]] = []

    def visibility(name: str) -> str:
        if name.startswith("__"):
            return "public" if name.endswith("__") else "private"
        return "protected" if name.startswith("_") else "public"

    def walk(node: ast.AST, prefix: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = prefix + n.name
                kind = "class" if isinstance(n, ast.ClassDef) else "test" if n.name.startswith("test_") else "function"
                refs = sorted({c.func.attr if isinstance(c.func, ast.Attribute) else c.func.id for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute | ast.Name)})
                out.append((name, kind, n.lineno, n.end_lineno or n.lineno, ast.get_docstring(n), visibility(n.name), refs))
                walk(n, name + "::")

    walk(ast.parse(source), "")
    return out


_HEADS = {
    "rust": [(re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), "function"), (re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"), "class"), (re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), "trait"), (re.compile(r"^\s*()impl(?:<[^>]*>)?\s+([\w:]+)"), "impl"), (re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)\s*:"), "const"), (re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?type\s+(\w+)"), "typedef"), (re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), "module")],
    "go": [(re.compile(r"^()func\s+(?:\([^)]*\)\s*)?(\w+)"), "function"), (re.compile(r"^()type\s+(\w+)\s+struct"), "class"), (re.compile(r"^()type\s+(\w+)\s+interface"), "trait"), (re.compile(r"^()type\s+(\w+)"), "typedef"), (re.compile(r"^()(?:const|var)\s+(\w+)"), "const")],
    "java": [(re.compile(r"^\s*((?:public|private|protected)\s+)?(?:static\s+|final\s+|abstract\s+)*class\s+(\w+)"), "class"), (re.compile(r"^\s*((?:public|private|protected)\s+)?interface\s+(\w+)"), "trait"), (re.compile(r"^\s*((?:public|private|protected)\s+)?enum\s+(\w+)"), "typedef"), (re.compile(r"^\s*((?:public|private|protected)\s+)(?:static\s+|final\s+|abstract\s+|synchronized\s+)*[\w<>\[\], ?.]+\s+(\w+)\s*\("), "function")],
    "typescript": [(re.compile(r"^\s*(export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(\w+)"), "function"), (re.compile(r"^\s*(export\s+)?(?:default\s+|abstract\s+)*class\s+(\w+)"), "class"), (re.compile(r"^\s*(export\s+)?interface\s+(\w+)"), "trait"), (re.compile(r"^\s*(export\s+)?type\s+(\w+)"), "typedef"), (re.compile(r"^\s*(export\s+)?(?:const|let)\s+(\w+)[^=\n]*=\s*(?:async\s*)?\([^)]*\)[^=\n]*=>"), "function"), (re.compile(r"^\s*(export\s+)?const\s+(\w+)"), "const")],
    "c": [(re.compile(r"^((?:static|inline|extern)\s+)*(?:const\s+)?(?:struct\s+)?\w+[\s*]+(\w+)\s*\([^;]*$"), "function"), (re.compile(r"^()(?:typedef\s+)?(?:struct|union)\s+(\w+)\s*\{?"), "class"), (re.compile(r"^()(?:typedef\s+)?enum\s+(\w+)"), "typedef"), (re.compile(r"^()#define\s+(\w+)"), "const")],
    "ruby": [(re.compile(r"^\s*()def\s+(?:self\.)?(\w+)"), "function"), (re.compile(r"^\s*()class\s+(\w+)"), "class"), (re.compile(r"^\s*()module\s+(\w+)"), "module")],
    "php": [(re.compile(r"^\s*((?:public|private|protected)\s+)?(?:static\s+)?function\s+(\w+)"), "function"), (re.compile(r"^\s*()(?:abstract\s+|final\s+)?class\s+(\w+)"), "class"), (re.compile(r"^\s*()interface\s+(\w+)"), "trait")],
    "swift": [(re.compile(r"^\s*((?:public|private|fileprivate|internal|open)\s+)?(?:static\s+)?func\s+(\w+)"), "function"), (re.compile(r"^\s*((?:public|private|internal|open)\s+)?(?:final\s+)?(?:class|struct)\s+(\w+)"), "class"), (re.compile(r"^\s*((?:public|private|internal)\s+)?protocol\s+(\w+)"), "trait")],
    "kotlin": [(re.compile(r"^\s*((?:public|private|protected|internal)\s+)?(?:suspend\s+|override\s+)*fun\s+(?:<[^>]*>\s*)?(\w+)"), "function"), (re.compile(r"^\s*((?:public|private|protected|internal)\s+)?(?:data\s+|open\s+|abstract\s+|sealed\s+)*(?:class|object)\s+(\w+)"), "class")],
    "csharp": [(re.compile(r"^\s*((?:public|private|protected|internal)\s+)?(?:static\s+|partial\s+|sealed\s+|abstract\s+)*(?:class|record|struct)\s+(\w+)"), "class"), (re.compile(r"^\s*((?:public|private|protected|internal)\s+)?interface\s+(\w+)"), "trait"), (re.compile(r"^\s*((?:public|private|protected|internal)\s+)?enum\s+(\w+)"), "typedef"), (re.compile(r"^\s*((?:public|private|protected|internal)\s+)(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\("), "function")],
    "css": [(re.compile(r"^()([.#][\w\-]+)[^{]*\{"), "class"), (re.compile(r"^()(@media|@keyframes|@supports)\b"), "module")],
}
_HEADS["javascript"] = _HEADS["typescript"]
_HEADS["cpp"] = [*_HEADS["c"], (re.compile(r"^\s*()class\s+(\w+)"), "class"), (re.compile(r"^\s*()namespace\s+(\w+)"), "module")]
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_FIRST = {"rust": "pub", "typescript": "export", "javascript": "export"}


def elements(source: str, language: str) -> list[tuple[str, str, int, int, str | None, str, list[str]]]:
    """(name, kind, line_start, line_end, doc, visibility, references) of the elements of a file; a Python
    file that doesn't parse is read by its heads like the other languages. The end of an element is the
    line before the next one that is indented no deeper."""
    if language == "python":
        try:
            return _python_elements(source)
        except (SyntaxError, ValueError, RecursionError):
            pass
    heads = _HEADS.get(language) or [(re.compile(r"^\s*()(?:async\s+)?def\s+(\w+)"), "function"), (re.compile(r"^\s*()class\s+(\w+)"), "class")]
    rows = source.replace("\r\n", "\n").split("\n")
    found = []
    for no, line in enumerate(rows, 1):
        for rx, kind in heads:
            m = rx.match(line)
            if m:
                mod, name = m.group(1) or "", m.group(2)
                if name in ("if", "for", "while", "switch", "return", "catch", "else"):
                    break
                k = "test" if kind == "function" and name.lower().startswith("test") else kind
                found.append((name, k, no, len(line) - len(line.lstrip()), mod.strip()))
                break
    out = []
    for i, (name, kind, no, indent, mod) in enumerate(found):
        end = next((n - 1 for _, _, n, d, _ in found[i + 1 :] if d <= indent), len(rows))
        b = no - 2
        doc: list[str] = []
        while b >= 0 and re.match(r"\s*(?:///?|#|\*|/\*)", rows[b]):
            doc.append(re.sub(r"^\s*(?:///?|#|\*/|\*|/\*\*?)\s?|\*/\s*$", "", rows[b]).strip())
            b -= 1
        if language == "go":
            vis = "public" if name[:1].isupper() else "private"
        elif language in _FIRST:
            vis = "crate" if mod.startswith("pub(crate") else "protected" if mod.startswith("pub(super") else "public" if mod.startswith(_FIRST[language]) else "private"
        else:
            vis = mod if mod in ("public", "private", "protected") else "public"
        body = "\n".join(rows[no:end])
        out.append((name, kind, no, end, "\n".join(x for x in reversed(doc) if x) or None, vis, sorted(set(_CALL.findall(body)))))
    return out


SCHEMA = "id long, name string, kind string, line_start int, line_end int, doc string, visibility string, references array<string>"


def parse_code(files: DataFrame, id_col: str, content_col: str, language_col: str) -> DataFrame:
    """Elements of source files (id, content, language), one row each."""
    rows = files.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("c"), F.coalesce(F.col(language_col), F.lit("unknown")).alias("l")).filter("c is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "name", "kind", "line_start", "line_end", "doc", "visibility", "references"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        for b in batches:
            out = [(i, *e) for i, c, l in zip(*(x.to_pylist() for x in b.columns), strict=True) for e in elements(c, l)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    return rows.mapInArrow(run, SCHEMA)


_IMPORT = re.compile(
    r"^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:static\s+)?([\w.]+)|use\s+([\w:]+)|#\s*include\s+[<\"]([^>\"]+)|(?:import|export)\b[^'\"\n]*['\"]([^'\"]+)|(?:const|let|var)[^=\n]*=\s*require\(['\"]([^'\"]+)|require(?:_relative)?\s+['\"]([^'\"]+)|using\s+([\w.]+)\s*;)",
    re.M,
)


def imports(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, target) of every import statement, once."""
    groups = F.regexp_extract_all(F.col(content_col), F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+(?:static\s+)?([\w.:]+)|use\s+([\w:.]+)|#\s*include\s+[<\"]([^>\"]+)|using\s+([\w.]+))"), F.lit(0))
    target = F.transform(groups, lambda g: F.regexp_replace(F.regexp_replace(g, r"^\s*(?:from|import\s+static|import|use|#\s*include|using)\s+[<\"]?", ""), r"\s+import$", ""))
    return files.select(F.col(id_col).alias("id"), F.explode(target).alias("target")).distinct()
