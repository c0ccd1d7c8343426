"""Edges taken from code: what a file inherits from, calls, creates and imports, resolved to the file that defines it.

Names are resolved against an index with one file per name, so a name that many files define doesn't multiply
rows; an edge from a file to itself is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INHERITS = r"\bclass\s+(\w+)(?:\s+extends\s+|\s*\(|\s*<\s*|\s*:\s*(?:public\s+)?)([A-Z]\w*)"
IMPLEMENTS = r"\bimpl\s+(\w+)\s+for\s+(\w+)|\bclass\s+(\w+)[^\n{]*?\simplements\s+([A-Z]\w*)"
CALL = r"([A-Za-z_]\w*)\s*\("
NEW = r"\bnew\s+([A-Z]\w*)\s*[(<]"
RUBY_NEW = r"\b([A-Z]\w*)\.new\b"
CAPITAL = r"(?:^|[^\w.])([A-Z]\w*)\s*\("
IMPORT = r"(?m)^[ \t]*(?:import|from|use|require)[ \t]+([A-Za-z_][\w.:/]*[\w])"
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx")


def inheritance(chunks: DataFrame) -> DataFrame:
    """(id, file_id, child, parent, kind) of the types that chunks (id, file_id, content) derive from others."""
    pairs = lambda rx, a, b, kind: F.zip_with(F.regexp_extract_all("content", F.lit(rx), F.lit(a)), F.regexp_extract_all("content", F.lit(rx), F.lit(b)), lambda x, y: F.struct(x.alias("child"), y.alias("parent"), F.lit(kind).alias("kind")))
    every = F.concat(pairs(INHERITS, 1, 2, "extends"), pairs(IMPLEMENTS, 2, 1, "implements"), pairs(IMPLEMENTS, 3, 4, "implements"))
    rows = chunks.filter("content is not null").select("id", "file_id", F.explode(every).alias("e")).select("id", "file_id", "e.child", "e.parent", "e.kind")
    return rows.filter("child <> '' and parent <> ''").distinct()


def references(chunks: DataFrame, pattern: str) -> DataFrame:
    """(file_id, name) of what chunks (file_id, content) match, once per file."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(pattern)))
    return chunks.filter("content is not null and file_id is not null").select("file_id", F.explode(found).alias("name")).distinct()


def class_name(reference: Column) -> Column:
    """The class of an instantiation: without ``new``, type arguments, arguments and ``.new``."""
    return F.regexp_replace(F.regexp_replace(F.trim(reference), r"^new\s+", ""), r"\s*(?:<[\s\S]*|\([\s\S]*|\.new[\s\S]*)$", "")


def instantiations(chunks: DataFrame, language: str = "language") -> DataFrame:
    """(file_id, name) of the classes that are created, by the way of the language of the file: ``new X``, ``X.new`` in
    Ruby, a call of a capitalised name in Python."""
    python, ruby = chunks.filter(F.col(language) == "python"), chunks.filter(F.col(language) == "ruby")
    rest = chunks.filter(~F.col(language).isin("python", "ruby"))
    return references(python, CAPITAL).union(references(ruby, RUBY_NEW)).union(references(rest, NEW)).distinct()


def name_files(symbols: DataFrame, files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(name, target_path): the first file by path that defines each name."""
    y = symbols if kinds is None else symbols.filter(F.col("kind").isin(*kinds))
    return y.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").groupBy("name").agg(F.min("path").alias("target_path"))


def file_edges(rows: DataFrame, files: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """(source_path, target_path, edge_type, weight) of references (file_id, name), each target once per source."""
    e = rows.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("source_path")), "file_id").join(index, "name")
    return e.filter("source_path <> target_path").select("source_path", "target_path").distinct().select("*", F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))


def imported(chunks: DataFrame) -> DataFrame:
    """(file_id, target) of the import statements of chunks (file_id, content)."""
    return references(chunks, IMPORT).withColumnRenamed("name", "target")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\..*$", "")


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def module_files(files: DataFrame) -> DataFrame:
    """(module, target_path): the first file by path of each stem."""
    return files.groupBy(stem(F.col("path")).alias("module")).agg(F.min("path").alias("target_path")).filter("module <> ''")


def by_convention(types: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, type, target_path) of types (source_path, type, language) by how files are named: in Python
    ``ClassName`` in class_name.py, in Java and Kotlin ``ClassName`` in ClassName with the extension, each beside the
    file that uses it."""
    own = F.lower(F.regexp_replace("type", r"([a-z0-9])([A-Z])", "$1_$2"))
    name = F.when(F.col("language") == "python", F.concat(own, F.lit(".py"))).when(F.col("language") == "java", F.concat("type", F.lit(".java"))).when(F.col("language") == "kotlin", F.concat("type", F.lit(".kt")))
    t = types.withColumn("target_path", F.concat_ws("/", folder(F.col("source_path")), name)).filter(name.isNotNull())
    return t.join(files.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi").select("source_path", "type", "target_path").distinct()


def resolve_types(types: DataFrame, index: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, type, target_path): the file that defines the type, else the one its name stands for."""
    known = types.join(index.withColumnRenamed("name", "type"), "type").select("source_path", "type", "target_path")
    rest = types.join(known.select("source_path", "type").distinct(), ["source_path", "type"], "left_anti")
    return known.unionByName(by_convention(rest, files)).distinct()


def resolve_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, target, target_path) of imports (source_path, target, language): Go by the folder of the last
    part, Java by the class of the last part, C by a header of that name beside the file, Rust by the module after
    ``crate::`` or ``super::``, the others by the module of the first part; the first file by path of several."""
    last = F.regexp_extract("target", r"([^./:]+)$", 1)
    head = F.regexp_extract(F.regexp_replace("target", r"^(?:crate|super|self)::", ""), r"^([^./:]+)", 1)
    name = F.when(F.col("language").isin("go", "java", "kotlin"), last).otherwise(head)
    rows = imports.withColumn("module", name)
    packages = files.filter("language = 'go'").groupBy(stem(folder(F.col("path"))).alias("module")).agg(F.min("path").alias("p"))
    modules = module_files(files).withColumnRenamed("target_path", "m")
    beside = files.filter("path like '%.h'").select(F.col("path").alias("h"))
    rows = rows.join(packages, "module", "left").join(modules, "module", "left")
    rows = rows.withColumn("h", F.concat_ws("/", folder(F.col("source_path")), F.concat("module", F.lit(".h")))).join(beside.withColumn("has", F.lit(True)), "h", "left")
    target = F.when(F.col("language") == "go", F.col("p")).when((F.col("language") == "c") & F.col("has"), F.col("h")).otherwise(F.col("m"))
    return rows.select("source_path", "target", target.alias("target_path")).filter("target_path is not null and target_path <> source_path").distinct()
