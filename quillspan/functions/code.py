"""Scalar functions over code, queries and paths, as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGES = {
    "python": ["py"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "rust": ["rs"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "hh"],
    "csharp": ["cs"],
    "css": ["css", "scss"],
    "ruby": ["rb"],
    "php": ["php"],
    "swift": ["swift"],
    "kotlin": ["kt", "kts"],
    "html": ["html", "htm"],
    "shell": ["sh", "bash", "zsh"],
    "markdown": ["md", "mdx"],
    "toml": ["toml"],
    "yaml": ["yml", "yaml"],
    "json": ["json", "jsonc"],
}
DOCUMENT_LANGUAGES = ("html", "shell", "markdown", "toml", "yaml", "json")

#: Weights of chunk kinds and of visibilities.
KIND_WEIGHT = {"function": 0.85, "class": 0.95, "trait": 0.95, "impl": 0.85, "const": 0.70, "typedef": 0.90, "module": 0.60, "test": 0.60, "top_level": 0.50, "summary": 0.85}
VISIBILITY_WEIGHT = {"public": 1.0, "crate": 0.9, "protected": 0.85, "private": 0.70}

#: Words a keyword query leaves out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might can could must to of in for on with at by from as into through"
    " during before after above below and but or not no if then than that this these those it its i me my we our you your he she they them their what which who whom how"
    " when where why all each every both few more most other some such only own same so very just about there here find show get list explain describe"
).split()

#: The words of each intent, in the order in which intents are tried. Each inner list must
#: have a word in the query; two lists must both have one.
INTENT_WORDS = [
    ("data_flow", [["data flow", "dataflow", "pipeline", "pass through", "passes through", "transforms", "propagat"], ["from", "to", "through"]]),
    ("dependency", [["depend", "import", "require", "used by", "downstream", "upstream"]]),
    ("dependency", [["uses"], ["what"]]),
    ("test_coverage", [["test", "spec"], ["cover", "which", "where", "find", "missing"]]),
    ("debug", [["bug", "error", "fail", "crash", "issue", "problem", "broken", "debug", "trace", "exception"]]),
    ("refactor", [["rename", "refactor", "move", "reorganize", "restructure", "extract", "inline", "usages", "references", "callers"]]),
    ("explain", [["how", "what", "why", "explain", "understand", "describe", "overview", "architecture", "flow", "works"]]),
    ("generate", [["create", "implement", "generate", "write", "build", "make"]]),
    ("edit", [["fix", "change", "update", "modify", "edit", "improve", "optimize", "add", "new"]]),
]
INTENTS = ("explain", "edit", "debug", "refactor", "generate", "data_flow", "dependency", "test_coverage", "unknown")

#: Per intent architecture, implementation, tests, docs, recent changes, graph depth, high level first.
STRATEGY = {
    "explain": (True, False, False, True, False, 2, True),
    "edit": (False, True, True, False, False, 1, False),
    "debug": (False, True, True, False, True, 1, False),
    "refactor": (True, True, True, False, False, 3, False),
    "generate": (True, True, False, True, False, 1, True),
    "data_flow": (True, True, False, False, False, 4, False),
    "dependency": (True, False, False, True, False, 3, True),
    "test_coverage": (False, False, True, False, False, 1, False),
    "unknown": (True, True, True, True, False, 2, False),
}
BUDGET_FRACTION = {"debug": 0.6, "edit": 0.6, "test_coverage": 0.7, "refactor": 0.8, "dependency": 0.8}

#: Weights of dependency kinds in graph reasoning.
DEPENDENCY_WEIGHT = {"imports": 0.3, "calls": 0.6, "extends": 0.7, "implements": 0.7, "uses_type": 0.4, "instantiates": 0.5, "field_access": 0.3, "data_flow": 0.8, "error_flow": 0.9, "type_flow": 0.6, "historical_co_change": 0.5}

#: Names of methods that say nothing about a chain.
TRIVIAL_METHODS = ("unwrap", "expect", "clone", "to_string", "into", "as_ref", "as_mut", "iter", "collect", "len", "is_empty", "push", "get", "set", "new", "default", "from", "ok", "err", "map_err")


def lookup(value: Column, values: dict[str, object], default: object = None) -> Column:
    """Value of a small fixed map, ``default`` where it has none."""
    m = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(m[value], F.lit(default)) if default is not None else m[value]


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def language_of(path: Column) -> Column:
    """Language by extension, ``unknown`` for any other."""
    return lookup(extension(path), {e: lang for lang, es in LANGUAGES.items() for e in es}, "unknown")


def is_code(language: Column) -> Column:
    return language.isin([x for x in LANGUAGES if x not in DOCUMENT_LANGUAGES])


def is_document(language: Column) -> Column:
    return language.isin(list(DOCUMENT_LANGUAGES))


def known_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k.isin(list(KIND_WEIGHT)), k).otherwise("top_level")


def known_visibility(v: Column) -> Column:
    x = F.lower(F.trim(v))
    return F.when(x.isin(list(VISIBILITY_WEIGHT)), x).otherwise("private")


def kind_weight(kind: Column) -> Column:
    return lookup(kind, KIND_WEIGHT, 0.5)


def visibility_weight(v: Column) -> Column:
    return lookup(v, VISIBILITY_WEIGHT, 0.7)


def structural_boost(score: Column, kind: Column, visibility: Column, graph_boost: Column) -> Column:
    return score * (F.lit(0.4) + F.lit(0.6) * kind_weight(kind) * visibility_weight(visibility)) * graph_boost


def estimate_tokens(content: Column) -> Column:
    """Bytes / 4 rounded down, at least 1; 0 for null."""
    return F.when(content.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(content) / 4))).cast("int")


def is_flow(kind: Column) -> Column:
    """Whether a dependency carries data, errors or types."""
    return kind.isin("data_flow", "error_flow", "type_flow")


def cut_to_tokens(content: Column, most: int) -> Column:
    """The content up to 4 * most characters, back to the last line feed if it was cut and has one."""
    c = F.substring(content, 1, 4 * most)
    last = F.length(c) - F.instr(F.reverse(c), "\n")
    return F.when(F.length(content) <= 4 * most, content).when(F.instr(c, "\n") > 0, F.substring(c, F.lit(1), last)).otherwise(c)


def subject_of(name: Column) -> Column:
    """What a function is about: its name without the verb it begins with, in words."""
    verbs = "|".join(["get", "fetch", "set", "update", "create", "new", "delete", "remove", "validate", "check", "parse", "decode", "format", "encode", "handle", "process", "is", "has", "to", "from"])
    return F.concat(F.translate(F.regexp_replace(F.lower(name), f"^(?:{verbs})_", ""), "_", " "), F.lit(" data"))


def hunk_header(line: Column) -> list[Column]:
    """start_line and line_count of the new side of a hunk header; a count that isn't given is 1."""
    start = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    count = F.regexp_extract(line, r"^@@ -\d+(?:,\d+)? \+\d+,(\d+) @@", 1)
    return [F.when(start != "", start.cast("int")).alias("start_line"), F.when(count != "", count.cast("int")).otherwise(1).alias("line_count")]


def plain_space(content: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(content, r"\s+", " ")), r"^ | $", "")


def content_key(content: Column) -> Column:
    """Equal for contents that differ in white space only."""
    return F.xxhash64(plain_space(content))


def split_identifier(token: Column) -> Column:
    """Parts of a code identifier: at ``_ . : - /``, at lower-to-upper and before the last capital of a run."""
    t = F.regexp_replace(token, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "\x01")
    return F.filter(F.split(t, r"[_.:\-/\x01]"), lambda x: x != "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def module_path(symbol: Column) -> Column:
    """All but the last part of a symbol path (without a leading ``crate::``), null if there is none."""
    s = F.regexp_replace(symbol, r"^crate::", "")
    colons = F.regexp_extract(s, r"^(.*)::[^:]*$", 1)
    dots = F.regexp_extract(s, r"^(.*)\.[^.]*$", 1)
    out = F.when(F.instr(s, "::") > 0, colons).otherwise(dots)
    return F.when(out != "", out)


def query_type(q: Column) -> Column:
    """keyword, symbol, natural_language or mixed."""
    t = F.trim(q)
    low = F.lower(t)
    symbol = ~t.contains(" ") & (t.contains("::") | t.contains(".") | t.contains("__") | t.rlike(r"^[\p{L}\p{N}_]+$"))
    asks = low.endswith("?") | low.rlike(r"^(?:how|what|where|why|when|which|find|show) ")
    return (
        F.when(t == "", "keyword").when(symbol, "symbol").when(asks, "natural_language")
        .when(F.size(F.split(t, r"\s+")) <= 3, "mixed").otherwise("natural_language")
    )


def intent(q: Column) -> Column:
    """The first intent all of whose word lists have a word in the query."""
    low = F.lower(q)
    has = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    out = F.lit("unknown")
    for name, lists in reversed(INTENT_WORDS):
        out = F.when(reduce(lambda a, b: a & b, map(has, lists)), name).otherwise(out)
    return out


def keyword_tokens(q: Column) -> Column:
    """Content words of a query and the lower-cased parts of its identifiers, distinct without case."""
    words = F.transform(F.split(F.trim(q), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, F.lower(w)))
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.transform(split_identifier(w), F.lower), lambda p: (F.length(p) >= 2) & ~F.array_contains(stop, p)))))
    first = lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, F.lower), F.lower(p)) == i + 1)
    return F.transform(F.array(parts), first)[0]


def is_test_file(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    name = F.substring_index(p, "/", -1)
    stem = F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    low = F.lower(stem)
    by_name = low.rlike(r"^test_|_test$|_spec$|\.test$|\.spec$|^conftest$") | stem.rlike(r"^test\p{Lu}")
    by_dir = F.arrays_overlap(F.split(F.lower(p), "/"), F.array(*map(F.lit, ("tests", "test", "__tests__", "spec", "specs"))))
    return by_name | by_dir


def first_sentence(doc: Column) -> Column:
    """Up to the first ``". "``, else the first line without a closing dot; null if blank."""
    t = F.trim(doc)
    at = F.instr(t, ". ")
    line = F.trim(F.substring_index(t, "\n", 1))
    out = F.when(at > 1, F.substring(t, F.lit(1), at - 1)).otherwise(F.regexp_replace(line, r"\.$", ""))
    return F.when(out != "", out)


#: What a function does by the beginning of its name.
PURPOSE = [
    (("get", "fetch"), "It retrieves "), (("set", "update"), "It updates "), (("create", "new"), "It creates "), (("delete", "remove"), "It deletes "),
    (("validate", "check"), "It validates "), (("parse", "decode"), "It parses "), (("format", "encode"), "It formats "), (("handle", "process"), "It handles "),
    (("to",), "It converts to "), (("from",), "It converts from "),
]


def purpose(name: Column) -> Column:
    """What a function does, told by its name; null where the name doesn't tell."""
    n = F.lower(name)
    subject = F.concat(F.regexp_replace(F.regexp_replace(n, r"^(?:get|fetch|set|update|create|new|delete|remove|validate|check|parse|decode|format|encode|handle|process|to|from)_", ""), "_", " "), F.lit(" data"))
    out = F.when(n.rlike(r"^(?:is|has)_"), F.lit("It returns a boolean check result"))
    for verbs, text in PURPOSE:
        out = F.when(n.rlike("^(?:" + "|".join(verbs) + ")_"), F.concat(F.lit(text), subject)).otherwise(out)
    return out


def architectural_role(in_degree: Column, out_degree: Column) -> Column:
    return (
        F.when((in_degree >= 5) & (out_degree >= 5), "hub")
        .when((in_degree >= 5) & (in_degree > F.greatest(out_degree * 3, F.lit(1))), "gateway")
        .when((out_degree >= 5) & (out_degree > F.greatest(in_degree * 3, F.lit(1))), "orchestrator")
        .when((in_degree <= 1) & (out_degree <= 2), "utility")
        .otherwise("unknown")
    )


def risk_level(affected: Column) -> Column:
    return F.when(affected > 50, "critical").when(affected > 20, "high").when(affected > 5, "medium").otherwise("low")


def coverage_risk(dependents: Column, dependencies: Column) -> Column:
    """2 * sigmoid(x / 5) - 1 of x = (3 * dependents + dependencies) / 4, within 0 and 1."""
    x = (dependents * 3 + dependencies) / F.lit(4.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) / (1 + F.exp(-x / 5.0)) - 1))


def line_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared lines of two inclusive ranges, of the shorter one."""
    shared = F.least(a1, b1) - F.greatest(a0, b0) + 1
    return F.when(shared <= 0, 0.0).otherwise(shared / F.least(a1 - a0 + 1, b1 - b0 + 1).cast("double"))


def rrf(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    """weight / (k + rank), 0 where the list doesn't have the row."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def priority(score: Column, active: Column, test: Column, graph: Column) -> Column:
    return (
        F.when(active, "critical").when(test, "high").when(graph, "medium")
        .when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")
    )


def html_title(html: Column) -> Column:
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, a blank for every tag, the common entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def escape_xml(s: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s


def last_parts(path: Column, n: int) -> Column:
    p = F.split(path, "/")
    return F.array_join(F.slice(p, F.greatest(F.size(p) - n + 1, F.lit(1)), n), "/")


def word_shingles(content: Column, n: int = 3) -> Column:
    """Distinct hashes of the runs of n words; of the whole text if it has fewer."""
    words = F.filter(F.split(content, r"\s+"), lambda x: x != "")
    # inside the outer lambda the words are a bound value: as an expression they'd be made anew for every run
    runs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, n))))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.array_distinct(runs(w))).otherwise(F.array(F.xxhash64(content))))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def method_chains(content: Column) -> Column:
    """Chains of two or more telling method calls, one string per line that has one."""
    trivial = F.array(*map(F.lit, TRIVIAL_METHODS))
    per = F.transform(F.split(content, "\n"), lambda l: F.filter(F.regexp_extract_all(l, F.lit(r"\.([A-Za-z_]\w*)\s*\(")), lambda m: ~F.array_contains(trivial, m)))
    return F.transform(F.filter(per, lambda c: F.size(c) >= 2), lambda c: F.array_join(c, "."))
