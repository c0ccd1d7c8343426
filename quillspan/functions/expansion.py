"""Queries made wider: base forms, groups of related terms, and code a query might be answered by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that are taken off a word, in the order in which they are tried.
SUFFIXES = ("ing", "tion", "ment", "ness", "able", "ible", "ize", "ise", "ed", "er", "es", "ly", "ful", "less", "ous")

#: Words that stand for a concept, and the terms a query with one of them is widened by.
GROUPS = [
    ("auth authentication login", "authenticate verify credential token session password"),
    ("error exception failure", "error err fail panic unwrap Result anyhow"),
    ("config configuration settings", "config Config settings options preferences"),
    ("test testing", "test assert mock fixture expect"),
    ("database db storage", "database db sql query insert select connection"),
    ("api endpoint route", "handler route endpoint request response middleware"),
    ("cache caching", "cache memoize ttl invalidate evict"),
    ("parse parser parsing", "parse lexer tokenize ast syntax grammar"),
    ("search find query", "search find lookup retrieve index match"),
    ("serialize serialization", "serialize deserialize json serde encode decode"),
    ("async concurrent parallel", "async await spawn tokio future thread"),
    ("dependency import", "import use require include depend"),
]


def base_form(word: Column, known: list[str]) -> Column:
    """The word without the first suffix that leaves a known word, with or without an ``e``; else the word as it is."""
    listed = F.array(*map(F.lit, known))
    out = word
    for suffix in reversed(SUFFIXES):
        stem = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        fits = word.endswith(suffix) & (F.length(word) > len(suffix) + 2)
        with_e = F.concat(stem, F.lit("e"))
        out = F.when(fits & F.array_contains(listed, stem), stem).when(fits & F.array_contains(listed, with_e), with_e).otherwise(out)
    return out


def expanded_terms(query: Column) -> Column:
    """The query, the terms of every group with a word in it, and its own words of three letters or more; each once, in
    this order."""
    low = F.lower(query)
    none = F.array().cast("array<string>")
    groups = [F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words.split())), F.array(*map(F.lit, terms.split()))).otherwise(none) for words, terms in GROUPS]
    own = F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_:]+|[^\p{L}\p{N}_:]+$", ""))
    return F.array_distinct(F.concat(F.array(query), *groups, F.filter(own, lambda w: F.length(w) > 2)))


#: What code that answers a query of each intent looks like; {e} is what the query is about, {i} that as an identifier.
SHAPES = {
    "explain": "/// What {e} does.\nfn {i}(input: Input) -> Result<Output> { run(input) }",
    "debug": "fn {i}() -> Result<()> { check().map_err(|error| report(\"{e}\", error)) }",
    "edit": "impl Owner { fn {i}(&mut self) { self.change(); } } // {e}",
    "refactor": "impl Owner { fn {i}(&mut self) { self.change(); } } // {e}",
    "generate": "/// A new {e}.\nstruct New { {i}: Value }",
    "data_flow": "fn {i}(input: Input) -> Output { emit(transform(parse(input))) } // flow of {e}",
    "dependency": "use crate::{i};\n// what {e} depends on",
    "test_coverage": "#[test]\nfn test_{i}() { assert!({i}().is_ok()); } // {e}",
    "unknown": "fn {i}() {} // {e}",
}


def hypothetical(entity: Column, intent: Column) -> Column:
    """Code a query about ``entity`` of an intent might be answered by; null for an empty entity."""
    name = F.regexp_replace(F.lower(entity), r"[^a-z0-9]+", "_")
    out = F.lit(SHAPES["unknown"])
    for k, shape in SHAPES.items():
        out = F.when(intent == k, F.lit(shape)).otherwise(out)
    return F.when(entity != "", F.replace(F.replace(out, F.lit("{e}"), entity), F.lit("{i}"), name))
