"""Generated, minified and vendored source files, told from those written by hand.

Declared paths come from attribute files, with glob precedence per directory. Repositories that declare
nothing get the equivalent patterns: the default attributes below, those that declaring repositories have in
common, and those mined from the corpus - features of path, language and size nearly all of whose files are
declared or show it in their contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.paths import plain_path, repository
from quillspan.session import materialize

#: The attributes of repositories that declare nothing, as lines of an attribute file at the root of
#: each: conventional names of folders and files that tools write or people copy in, by reason.
DEFAULTS = {
    "vendored": """
node_modules/ linguist-vendored
bower_components/ linguist-vendored
jspm_packages/ linguist-vendored
third_party/ linguist-vendored
third-party/ linguist-vendored
thirdparty/ linguist-vendored
vendor/ linguist-vendored
vendored/ linguist-vendored
Godeps/ linguist-vendored
""",
    "generated": """
generated/ linguist-generated
__generated__/ linguist-generated
autogen/ linguist-generated
gen/ linguist-generated
*.generated.* linguist-generated
*.gen.* linguist-generated
*.g.* linguist-generated
*.pb.* linguist-generated
*.pb-c.* linguist-generated
*.designer.* linguist-generated
*_pb.* linguist-generated
*_pb2.* linguist-generated
*_grpc.* linguist-generated
""",
    "minified": """
dist/ linguist-generated
*.min.* linguist-generated
*-min.* linguist-generated
*.bundle.* linguist-generated
*.chunk.* linguist-generated
""",
    "lock": """
*.lock.* linguist-generated
*-lock.* linguist-generated
yarn.lock linguist-generated
Cargo.lock linguist-generated
Gemfile.lock linguist-generated
poetry.lock linguist-generated
composer.lock linguist-generated
Pipfile.lock linguist-generated
flake.lock linguist-generated
uv.lock linguist-generated
go.sum linguist-generated
""",
}

#: What tools and copyists write into the first comment of a file.
_GENERATED = r"code generated by|@generated\b|auto-?generated file|<auto-generated|automatically (?:produced|generated|written) by|automatisch erzeugt|generado autom|automatiquement|generated automatically|do not (?:modify|edit|change) by hand|generated by .{0,60}do not (?:edit|modify)"
_VENDORED = r"vendored copy of|upstream: .{0,80}(?:local changes|tag )|bundled with its own licen[cs]e|taken verbatim from|copied (?:verbatim )?from .{0,60}(?:release|version|project)"
_SIGN = r"(?://|#|/\*|\*|--|;|<!--|%)"
_HEAD = r"(?is)\A(?:[^\n]*\n){0,2}?(?:[ \t]*+(?:" + _SIGN + r"[^\n]*+)?\r?\n)*?\s*" + _SIGN + r"[^\n]{0,40}?(?:"

#: A line of data: four or more numbers or short hexadecimal strings and nothing else.
_DATA_LINE = r"""(?m)^[ \t]*+(?:(?:"[0-9a-fA-F]{2,}+"|'[0-9a-fA-F]{2,}+'|[-+]?0[xX][0-9a-fA-F]++|[-+]?\d++(?:\.\d++)?+(?:[eE][-+]?\d++)?+)[ \t]*+[:,;]?+[ \t]*+){4,}+[\]})]*+;?+\r?$"""
_DATA_RUN = r"[A-Za-z0-9+/=_]{200,}+"

LEAST_SHARE = 0.2
#: Attribute files that are sent to every executor to pick their chunks: some 10 MB.
BROADCAST_FILES = 100_000
#: Folders with rules that are sent to every executor: else the files are shuffled to them.
BROADCAST_FOLDERS = 20_000
MINE_SUPPORT = 8
MINE_PRECISION = 0.9
DECLARED_REPOSITORIES = 3
ATTRIBUTES = ("linguist-generated", "linguist-vendored")


def content_evidence(chunks: DataFrame) -> DataFrame:
    """(file_id, marked, vendored, data_share, dense_share) of each file from its chunks.

    marked / vendored: the first block of comments of a chunk (after at most two lines) says so; data_share: the
    part of all characters in lines of numbers or in runs of 200 or more base64 characters; dense_share:
    the part in chunks of 400 characters a line and hardly a blank. Repeated chunk rows count once."""
    c = F.col("content")
    n = F.length(c)
    lines = n - F.length(F.translate(c, "\n", "")) + 1
    data = n - F.length(F.regexp_replace(F.regexp_replace(c, _DATA_RUN, ""), _DATA_LINE, ""))
    dense = (n >= 300) & (n / lines >= 400) & (n - F.length(F.translate(c, " ", "")) <= 0.08 * n)
    per = chunks.filter("file_id is not null and content is not null").select(
        "file_id", F.col("id").alias("chunk"), n.alias("n"), data.alias("data"), F.when(dense, n).otherwise(0).alias("dense"),
        c.rlike(_HEAD + _GENERATED + ")").alias("marked"), c.rlike(_HEAD + _VENDORED + ")").alias("vendored"),
    )
    once = per.groupBy("file_id", "chunk").agg(*(F.max(x).alias(x) for x in ("n", "data", "dense", "marked", "vendored")))
    total = F.greatest(F.sum("n"), F.lit(1))
    return once.groupBy("file_id").agg(
        F.max("marked").alias("marked"), F.max("vendored").alias("vendored"), (F.sum("data") / total).alias("data_share"), (F.sum("dense") / total).alias("dense_share")
    )


def _features(path: Column, language: Column, size: Column) -> Column:
    """The features by which patterns are mined: array of (kind, value); those of the path, and the language with
    the power of two of the size."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dotted = F.split(name, r"\.")
    stem = F.element_at(dotted, 1)

    def mark(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    dirs = F.transform(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))), lambda x: mark("dir", x))
    inner = F.transform(F.slice(dotted, 2, F.greatest(F.size(dotted) - 2, F.lit(0))), lambda x: mark("part", F.regexp_replace(x, r"^[0-9a-f]{6,}$", "#")))
    dash = F.when(F.instr(stem, "-") > 0, F.array(mark("dash", F.substring_index(stem, "-", -1))))
    under = F.when(F.instr(stem, "_") > 0, F.array(mark("under", F.substring_index(stem, "_", -1))))
    low = F.lower(F.trim(language))
    kind = F.when((low != "") & (low != "unknown"), low).otherwise(F.concat(F.lit("."), F.element_at(dotted, -1)))
    sized = F.when(size > 0, F.array(mark("size", F.concat(kind, F.lit(":"), F.floor(F.log2(size.cast("double"))).cast("string")))))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    return F.array_distinct(F.concat(dirs, inner, *(F.coalesce(x, none) for x in (dash, under, sized)), F.array(mark("name", name))))


def glob_regex(pattern: str, folder: str) -> str | None:
    """The regular expression (of whole plain paths) of a pattern in the attribute file of ``folder``.

    A pattern without a slash but at its end matches at any depth below the folder, one with a slash
    from the folder; ``*`` and ``?`` don't cross slashes, ``**`` does; a trailing slash or ``/**`` takes
    all below. Empty and negated patterns give None."""
    if not pattern or pattern[0] == "!":
        return None
    below = pattern.endswith("/")
    body = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (j := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", j + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    start = re.escape(folder + "/") if folder else ""
    return "^" + start + ("" if anchored else "(?:.*/)?") + out + ("/.*" if below else "") + "$"


def parse_attributes(content: str | None, folder: str) -> list[tuple]:
    """(line, regex, feature kind, feature value, attribute, value) of each rule of an attribute file; the value is
    None where the rule makes the attribute unspecified again (``!name``)."""
    out = []
    for no, line in enumerate((content or "").replace("\r", "").split("\n")):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        rx = glob_regex(words[0], folder)
        if rx is None:
            continue
        body = words[0].strip("/")
        body = body[3:] if body.startswith("**/") else body
        kind, value = None, None
        if m := re.fullmatch(r"([\w.@\-]+)(?:/\*\*|/\*)?", body):
            if words[0].endswith(("/", "/**", "/*")):
                kind, value = "dir", m.group(1)
            elif "/" not in body:
                kind, value = "name", body
        elif m := re.fullmatch(r"\*\.([\w\-]+)\.\w+", body):
            kind, value = "part", m.group(1)
        elif m := re.fullmatch(r"\*([_\-])(\w+)\.\w+", body):
            kind, value = {"_": "under", "-": "dash"}[m.group(1)], m.group(2)
        for w in words[1:]:
            name, _, val = w.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                out.append((no, rx, kind, value, name, None if w[0] == "!" else w[0] != "-" and val.lower() not in ("false", "0", "no")))
    return out


def default_regexes() -> dict[str, str]:
    """By reason one regular expression of paths below the repository: the default attributes that set it."""
    return {why: "|".join(r[1] for r in parse_attributes(text, "") if r[5]) for why, text in DEFAULTS.items()}


_RULE = pa.struct([("line", pa.int32()), ("regex", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("attribute", pa.string()), ("on", pa.bool_())])


def attribute_rules(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(folder, rules) of all attribute files of the corpus, in order of their lines."""
    at = materialize(files.filter(F.col("path").rlike(r"(?:^|/)\.gitattributes$")).select("file_id", "path"), "attribute-files")
    if at.count() <= BROADCAST_FILES:  # else the chunks are shuffled to them
        at = F.broadcast(at)
    texts = chunks.join(at, "file_id").select("path", "id", "line_start", "content").distinct()
    whole = texts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("line_start", F.lit(0)).alias("l"), "id", "content"))).alias("c"))
    whole = whole.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.concat_ws("\n", F.transform("c", lambda x: x["content"])).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _RULE]
        for b in batches:
            rules = [[dict(zip(names, r, strict=True)) for r in parse_attributes(c, f)] for f, c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, pa.list_(_RULE))], ["folder", "rules"])

    return whole.mapInArrow(run, "folder string, rules array<struct<line:int,regex:string,kind:string,value:string,attribute:string,on:boolean>>").filter("size(rules) > 0")


@lru_cache(maxsize=20_000)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex)


def declarations(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, declared) of the files (file_id, path) that ``rules`` (folder, rules) set or unset an attribute of.

    A file meets the rules of its own folders only. Of the rules of a folder that match the last one counts for
    an attribute, of several folders the deepest; ``declared`` is true if any attribute is set."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))
    each = files.select("file_id", "path", F.explode(up).alias("folder"))
    if rules.count() <= BROADCAST_FOLDERS:
        rules = F.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, path, folder, own in zip(*(x.to_pylist() for x in b.columns), strict=True):
                last = {r["attribute"]: r["on"] for r in own if _compiled(r["regex"]).match(path)}
                out += [(i, len(folder), name, on) for name, on in last.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["file_id", "depth", "attribute", "on"])

    met = each.join(rules, "folder").select("file_id", "path", "folder", "rules").mapInArrow(run, "file_id long, depth int, attribute string, on boolean")
    deepest = met.groupBy("file_id", "attribute").agg(F.max(F.struct("depth", "on")).alias("m"))
    return deepest.filter("m.on is not null").groupBy("file_id").agg(F.max("m.on").alias("declared"))


def classify_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, path, hand_written, reasons) of each file id.

    files: id, path, language, size_bytes, and what else; chunks: id, file_id, content, line_start. A file is not
    written by hand if an attribute file declares so, if its contents show it (a note of a tool or of a copy in the
    first comments, a fifth of its characters in data or in minified code), or if a pattern says so: a default
    attribute, a pattern declared in at least three repositories, or a mined feature. A feature is mined if at
    least 8 files have it and 0.9 of them are declared (of the files of declaring repositories, in at least three
    of them) or show it in their contents (of the files with chunks). Size and language stand in for contents
    where a file has no chunks. A declaration that unsets an attribute (``-linguist-generated``) overrides all
    inference for the path, ``!linguist-generated`` leaves it to inference.

    Rows of one id count once (the least of its paths and languages, the greatest of its sizes); null ids and paths
    are left out; a null, unknown or misspelled language is replaced by the extension and a null or zero size is no
    feature; files without chunks are judged by path and size; chunks of unknown files are ignored; empty tables
    give no rows."""
    f = files.select(F.col("id").cast("long").alias("file_id"), plain_path(F.col("path")).alias("path"), F.col("language").cast("string"), F.col("size_bytes").cast("long").alias("size"))
    f = f.dropna(subset=["file_id", "path"]).groupBy("file_id").agg(F.min("path").alias("path"), F.min("language").alias("language"), F.max("size").alias("size"))
    shown = content_evidence(chunks)
    base = f.join(shown, "file_id", "left").withColumn("repo", repository(F.col("path")))
    by_content = F.array_compact(F.array(
        F.when(F.col("marked"), F.lit("marked generated")), F.when(F.col("vendored"), F.lit("marked copy")),
        F.when(F.col("data_share") >= LEAST_SHARE, F.lit("data")), F.when(F.col("dense_share") >= LEAST_SHARE, F.lit("minified")),
    ))
    below = F.expr("substring(path, length(repo) + 2)")
    base = base.withColumn("by_content", by_content).withColumn("by_default", F.array_compact(F.array(*(F.when(below.rlike(rx), F.lit(why)) for why, rx in default_regexes().items()))))

    rules = materialize(attribute_rules(f, chunks), "attribute-rules")
    some = not rules.isEmpty()
    if some:
        base = base.join(declarations(f.select("file_id", "path"), rules), "file_id", "left")
        base = base.join(rules.select(repository(F.col("folder")).alias("repo")).distinct().withColumn("declaring", F.lit(True)), "repo", "left")
    else:
        base = base.withColumn("declared", F.lit(None).cast("boolean")).withColumn("declaring", F.lit(None).cast("boolean"))
    base = materialize(base.withColumn("features", _features(F.col("path"), F.col("language"), F.col("size"))).withColumn("seen", F.col("marked").isNotNull()), "file-evidence")

    each = base.select("file_id", "repo", "seen", "declaring", F.coalesce("declared", F.lit(False)).alias("declared"), (F.size("by_content") > 0).alias("shown"), F.explode("features").alias("e"))
    each = each.select("file_id", "repo", "seen", "declaring", "declared", "shown", "e.kind", "e.value")
    count = lambda c: F.sum(c.cast("long"))
    told = each.filter("seen or declaring").groupBy("kind", "value").agg(
        count(F.col("seen")).alias("n"), count(F.col("seen") & F.col("shown")).alias("good"), count(F.coalesce("declaring", F.lit(False))).alias("dn"), count(F.col("declared")).alias("dgood"),
        F.approx_count_distinct(F.when(F.col("declared"), F.col("repo"))).alias("repos"),
    )
    enough = lambda n, good: (F.col(n) >= MINE_SUPPORT) & (F.col(good) >= MINE_PRECISION * F.col(n))
    mined = told.filter((F.col("kind") != "name") & (enough("n", "good") | enough("dn", "dgood") & (F.col("repos") >= DECLARED_REPOSITORIES))).select("kind", "value", F.lit("mined").alias("why"))
    if some:
        lines = rules.select(repository(F.col("folder")).alias("repo"), F.explode("rules").alias("r")).filter("r.kind is not null and r.on is not null")
        common = lines.groupBy("r.kind", "r.value").agg(F.countDistinct("repo").alias("n"), F.min("r.on").alias("on")).filter(f"on and n >= {DECLARED_REPOSITORIES}")
        mined = mined.unionByName(common.select("kind", "value", F.lit("declared elsewhere").alias("why")))
    learned = each.filter("kind <> 'size' or not seen").select("file_id", "kind", "value").join(mined, ["kind", "value"])
    learned = learned.groupBy("file_id").agg(F.collect_set("why").alias("learned"))

    out = base.join(learned, "file_id", "left")
    inferred = F.array_distinct(F.concat("by_content", "by_default", F.coalesce("learned", F.array().cast("array<string>"))))
    reasons = F.when(F.col("declared"), F.array_union(F.array(F.lit("declared")), inferred)).when(F.col("declared").isNull(), inferred).otherwise(F.array().cast("array<string>"))
    return out.select("file_id", "path", (F.size(reasons) == 0).alias("hand_written"), reasons.alias("reasons"))
