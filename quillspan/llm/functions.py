"""Functions and methods paired with their documentation.

Heads of functions of eight languages are recognised in the text by a generalised LL parser with
error recovery, so that functions of cut or broken files are found too; documentation is taken where
the language puts it, and empty, trivial and template documentation is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.gll import Grammar, Recogniser
from quillspan.session import materialize

# ---------------------------------------------------------------- grammar of function heads
#
# Token kinds: the keywords below as themselves, NAME for other words, PAREN / BRACK / ANGLE for a
# balanced group of brackets, OPEN for a bracket that is never closed, NL for the end of a line, the
# signs : ; { = . , & * ? ! | @ and -> =>, LIT for a literal, X for anything else.

GRAMMAR: Grammar = {
    "HEAD": [("PY",), ("RUBY",), ("RUST",), ("GO",), ("JSFN",), ("ARROW",), ("TYPED",), ("METHOD",)],
    "PARAMS": [("PAREN",), ("!", "OPEN", "JUNK")],
    "JUNK": [(), ("JUNKONE", "JUNK")],
    "JUNKONE": [("NAME",), ("PAREN",), ("BRACK",), (":",), (",",), ("=",), ("*",), ("&",), (".",), ("LIT",), ("NL",), ("ANGLE",), ("?",), ("|",), ("->",), ("X",), ("const",), ("struct",), ("fn",), ("!sign",)],
    # def name(...) -> type:
    "PY": [("async", "PYDEF"), ("PYDEF",)],
    "PYDEF": [("def", "#NAME", "GENERIC", "PARAMS", "PYTYPE", ":")],
    "PYTYPE": [(), ("->", "TYPE")],
    # def name(...) or def self.name or def name, to the end of the line
    "RUBY": [("def", "RUBYNAME", "RUBYEND")],
    "RUBYNAME": [("#NAME", "SUFFIX"), ("NAME", ".", "#NAME", "SUFFIX")],
    "SUFFIX": [(), ("?",), ("!sign",)],
    "RUBYEND": [("NL",), ("PAREN", "NL"), ("PAREN", ";"), ("NAMES", "NL"), ("!", "OPEN", "JUNK")],
    "NAMES": [("NAME",), ("NAME", ",", "NAMES")],
    # pub(crate) async unsafe fn name<T>(...) -> type where ... {
    "RUST": [("RUSTMODS", "fn", "#NAME", "GENERIC", "PARAMS", "RUSTTYPE", "WHERE", "OPENBODY")],
    "RUSTMODS": [(), ("pub", "RUSTMODS"), ("pub", "PAREN", "RUSTMODS"), ("async", "RUSTMODS"), ("unsafe", "RUSTMODS"), ("const", "RUSTMODS"), ("extern", "RUSTMODS"), ("extern", "LIT", "RUSTMODS"), ("default", "RUSTMODS")],
    "RUSTTYPE": [(), ("->", "TYPE")],
    "WHERE": [(), ("where", "JUNK"), ("NL", "where", "JUNK")],
    # func (r *T) name[T any](...) (...) {
    "GO": [("func", "#NAME", "GENERIC", "PARAMS", "GOTYPE", "OPENBODY"), ("func", "PAREN", "#NAME", "PARAMS", "GOTYPE", "OPENBODY")],
    "GOTYPE": [(), ("PAREN",), ("TYPE",)],
    # export default async function* name<T>(...): type {
    "JSFN": [("JSMODS", "function", "STAR", "#NAME", "GENERIC", "PARAMS", "ANNOTATION", "OPENBODY")],
    "JSMODS": [(), ("export", "JSMODS"), ("default", "JSMODS"), ("async", "JSMODS"), ("declare", "JSMODS")],
    "STAR": [(), ("*",)],
    "ANNOTATION": [(), (":", "TYPE")],
    # export const name: type = async (...): type => {
    "ARROW": [("JSMODS", "BIND", "#NAME", "ANNOTATION", "=", "ARROWTAIL"), ("FIELDMODS", "#NAME", "ANNOTATION", "=", "ARROWTAIL")],
    "BIND": [("const",), ("let",), ("var",)],
    "ARROWTAIL": [("ASYNC", "GENERIC", "PARAMS", "ANNOTATION", "=>"), ("ASYNC", "NAME", "=>"), ("ASYNC", "function", "STAR", "PARAMS", "ANNOTATION", "OPENBODY"), ("ASYNC", "function", "STAR", "NAME", "PARAMS", "ANNOTATION", "OPENBODY")],
    "ASYNC": [(), ("async",)],
    "FIELDMODS": [("MOD", "FIELDMODS"), ("MOD",)],
    # class methods of scripts: async name(...): type {
    "METHOD": [("MODS", "#NAME", "GENERIC", "PARAMS", "ANNOTATION", "OPENBODY"), ("MODS", "*", "#NAME", "PARAMS", "OPENBODY"), ("MODS", "@", "#NAME", "PARAMS", "OPENBODY")],
    "MODS": [(), ("MOD", "MODS")],
    "MOD": [("public",), ("private",), ("protected",), ("static",), ("async",), ("export",), ("default",), ("override",), ("final",), ("abstract",), ("readonly",), ("get",), ("set",), ("virtual",), ("inline",), ("extern",), ("const",), ("unsafe",), ("native",), ("ANNO",)],
    # type name(...) throws X {
    "TYPED": [("MODS", "GENERIC", "CTYPE", "#NAME", "PARAMS", "THROWS", "OPENBODY")],
    "CTYPE": [("TYPEWORDS", "POINTERS")],
    "TYPEWORDS": [("TYPEWORD",), ("TYPEWORD", "TYPEWORDS")],
    "TYPEWORD": [("NAME", "GENERIC", "DIMS"), ("NAME", ".", "TYPEWORD"), ("struct",), ("const",), ("enum",)],
    "DIMS": [(), ("BRACK", "DIMS")],
    "POINTERS": [(), ("*", "POINTERS"), ("&", "POINTERS")],
    "THROWS": [(), ("throws", "JUNK"), ("NL", "throws", "JUNK"), ("const",), ("override",)],
    "GENERIC": [(), ("ANGLE",), ("BRACK",)],
    "TYPE": [("TYPEONE",), ("TYPEONE", "TYPE")],
    "TYPEONE": [("NAME",), ("ANGLE",), ("BRACK",), ("PAREN",), ("LIT",), ("&",), ("*",), (".",), ("|",), ("?",), ("->",), ("=>",), (",",), ("const",), ("async",), ("X",), ("func",), ("struct",), ("fn",), ("!sign",), ("default",)],
    "OPENBODY": [("{",), ("NL", "{")],
}

_KEYWORDS = frozenset(
    "async def pub fn unsafe const extern default where func function export declare let var public private protected static override final"
    " abstract readonly get set virtual inline native throws struct enum".split()
)
#: Words that begin a statement or an expression, so that none of them is a name or a type.
_STATEMENT = frozenset(
    "if else for while switch match select do try catch return new throw await go defer case in synchronized with lock foreach elif except"
    " unless until when yield assert import from package use mod impl class interface trait type raise begin ensure rescue elsif end not and or"
    " del global print typeof delete void0 loop chan map range fallthrough break continue finally pass lambda namespace using template".split()
)

#: Of the words above those that may be the name of a method before its parameters.
_METHOD_WORDS = frozenset("get set delete default final native map chan range print loop begin end del pass global type".split())
#: Words after which any word is a name; those that types are made of, and what stands before a type.
_DEFINERS = frozenset("def fn func function".split())
_TYPE_WORDS = frozenset("impl dyn map chan interface type for range typeof template use".split())
_BEFORE_TYPE = frozenset("PAREN -> NAME & * BRACK ANGLE : , = X | where".split())

_TOKEN = re.compile(r"[^\W\d]\w*|\n|->|=>|[()\[\]{}<>:;=.,&*?!|@]|\x01+|\d[\w.]*|[^\s\w]")


@lru_cache(maxsize=1)
def _recogniser() -> Recogniser:
    return Recogniser(GRAMMAR, "HEAD")


_BRACKET = re.compile(r"[()\[\]{}]")
_ANGLE = re.compile(r"<[^<>;{}()\n]*(?:<[^<>;{}()\n]*(?:<[^<>;{}()\n]*>[^<>;{}()\n]*)*>[^<>;{}()\n]*)*>")


def bracket_ends(text: str) -> dict[int, int]:
    """Place after each bracket group of the text, by its begin; groups that are never closed are missing. A
    bracket closes the nearest open one, whatever its kind."""
    open_at: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACKET.finditer(text):
        if m.group() in "([{":
            open_at.append(m.start())
        elif open_at:
            out[open_at.pop()] = m.end()
    return out


def head_tokens(text: str, at: int, ends_of: dict[int, int], heads: set[int], hashed: bool) -> tuple[list[str], list[int], list[int]]:
    """Kinds, begins and ends of the tokens from ``at`` to the sign that ends a head: a brace, a semicolon, an arrow,
    a word that begins a statement, the begin of the next head, or, in languages with ``def``, the colon or the
    end of the line."""
    kinds: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    i = at
    match = _TOKEN.search
    opened = False
    while True:
        m = match(text, i)
        if m is None:
            kinds.append("NL")
            begins.append(len(text))
            ends.append(len(text))
            break
        if kinds and m.start() in heads:
            break
        t, i = m.group(), m.end()
        stop = False
        last = kinds[-1] if kinds else ""
        if t == "(" or t == "[":
            end = ends_of.get(m.start(), -1)
            if end < 0:
                k, opened = "OPEN", True
            else:
                k, i = ("PAREN" if t == "(" else "BRACK"), end
        elif t == "<":
            g = _ANGLE.match(text, m.start())
            if g:
                k, i = "ANGLE", g.end()
            else:
                k = "X"
        elif t == "\n":
            k = "NL"
            stop = hashed and not opened
        elif t[0] == "\x01" or t[0].isdigit():
            k = "LIT"
        elif t in _STATEMENT or t in _KEYWORDS:
            if last in _DEFINERS or hashed and last == "." or t in _METHOD_WORDS and text.startswith("(", i):
                k = "NAME"
            elif t in _KEYWORDS:
                k = t
            elif t in _TYPE_WORDS and last in _BEFORE_TYPE:
                k = "NAME"
                if text.startswith("{}", i):
                    i += 2
            else:
                break
        elif t[0] == "_" or t[0].isalpha():
            k = "NAME"
        elif t == "!":
            k = "!sign"
        elif t == "{" or t == ";":
            k, stop = t, True
        elif t in (":", "=", ".", ",", "&", "*", "?", "|", "@", "->", "=>"):
            k, stop = t, t == "=>" or hashed and t == ":" and not opened
        else:
            k = "X"
        kinds.append(k)
        begins.append(m.start())
        ends.append(i)
        if stop:
            break
    return kinds, begins, ends


# ---------------------------------------------------------------- text of a chunk

_HASHED = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]", re.M)
_MASK_HASH = re.compile(r'(?:[rRbBuUfF]{0,2})("""|\'\'\').*?(?:\1|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|#[^\n]*', re.S)
_MASK_SLASH = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.[^\'\n]{0,8}|[^\'\\\n]+)\'|`(?:\\.|[^`\\])*`?', re.S)
_FIRST_HASH = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?=\w)", re.M)
_GROUP = r"\([^;{}()]*+\)"
for _ in range(5):  # groups within groups, without going back
    _GROUP = r"\((?:[^;{}()]|" + _GROUP + r")*+\)"
_FIRST_SLASH = re.compile(
    r"^[ \t]*(?=[A-Za-z_@#*$\[])(?!(?:if|else|for|while|switch|match|select|do|try|catch|return|new|throw|await|go|defer|case|import|use|class|impl|type|struct\s+\w+\s*\{)\b)"
    r"(?=[^\n;]*?(?:\b(?:fn|func|function)\b|=>|\w[ \t]*(?:<[^\n;()]*>)?(?:" + _GROUP + r"[^;{}=()\n]*+(?:\([^;{}()\n]*+\)[^;{}=()\n]*+)?\n?[ \t]*\{|\([^;{}()]*+\Z)|=[ \t]*(?:async[ \t]*)?\())",
    re.M,
)

_BLANKS = re.compile(r"[ \t]*")
_NOTE = re.compile(r"^\s*(?://|#|/\*|--)\s*(?:file|path|in|module|source)\s*:\s*\S*[/\\.]\S*.*$", re.I)
_ANNOTATION = re.compile(r"^\s*(?:@\w|#!?\[|\[\[)")


def _blank(m: re.Match) -> str:
    return "\x01" * (m.end() - m.start()) if "\n" not in m.group() else re.sub(r"[^\n]", "\x01", m.group())


def _python_doc(text: str, at: int) -> str | None:
    """The string that is the first statement of the body that begins at ``at``."""
    m = _DOCSTRING.match(text, at)
    if not m:
        return None
    return m.group(2) if m.group(2) is not None else m.group(3)[1:-1]


_DOCSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*[rRuUbB]{0,2}(?:(\"\"\"|''\')(.*?)(?:\1|\Z)|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')[ \t]*(?:\n|;|\Z))", re.S)


def _comment_above(lines: list[str], row: int, hashed: bool) -> str | None:
    """The comment that ends in the line above ``row``, annotations between them aside."""
    j = row - 1
    while j >= 0 and _ANNOTATION.match(lines[j]):
        j -= 1
    if j < 0:
        return None
    last = lines[j].strip()
    if hashed:
        if not last.startswith("#"):
            return None
        b = j
        while b > 0 and lines[b - 1].lstrip().startswith("#"):
            b -= 1
    elif last.endswith("*/"):
        b = j
        while b >= 0 and "/*" not in lines[b]:
            b -= 1
        if b < 0:
            b = 0
        elif not lines[b].lstrip().startswith("/*"):
            return None
    elif last.startswith("//"):
        kind = "///" if last.startswith("///") else "//"
        b = j
        while b > 0 and lines[b - 1].lstrip().startswith(kind):
            b -= 1
    else:
        return None
    kept = [x for x in lines[b : j + 1] if not _NOTE.match(x)]
    return "\n".join(kept) if kept else None


_DEF_LINE = re.compile(r"[^\n]*\n?")


def _indented_end(text: str, start: int, at: int) -> int:
    """End of the body of a function of a language with ``def`` whose head begins at ``start`` and whose body begins at
    ``at``: up to the first line that is indented no deeper, an ``end`` of the same depth included."""
    depth = len(text[text.rfind("\n", 0, start) + 1 : start].expandtabs(8))
    stop = at
    first = text.find("\n", at)
    if first < 0:
        return len(text)
    at = first + 1
    stop = at
    while at < len(text):
        m = _DEF_LINE.match(text, at)
        line = m.group()
        body = line.lstrip(" \t\n\x01")
        if body.strip():
            own = len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(8))
            if own <= depth:
                if own == depth and re.match(r"end\b", body):
                    stop = m.end()
                break
            stop = m.end()
        elif "\x01" in line:
            stop = m.end()  # a string or comment that goes on
        at = m.end()
    return stop


def _braced_end(text: str, at: int, ends_of: dict[int, int], heads: list[int], start: int) -> int:
    """End of the body that begins with the brace or expression at ``at``. One that is never closed, in a broken or cut
    text, ends before the next head that is indented no deeper than its own, or with the text."""
    if at < len(text) and text[at] == "{":
        end = ends_of.get(at, -1)
        if end >= 0:
            return end
        depth = start - text.rfind("\n", 0, start)
        for h in heads:
            if h > at and h - text.rfind("\n", 0, h) <= depth:
                stop = text.rfind("\n", 0, h) + 1
                while stop > at:  # the comment above it is not part of the body
                    above = text.rfind("\n", 0, stop - 1) + 1
                    if text[above:stop].strip(" \t\n\x01"):
                        break
                    stop = above
                return stop
        return len(text)
    i = at
    while i < len(text):  # the expression of an arrow function
        c = text[i]
        if c in "([{":
            i = ends_of.get(i, len(text))
            continue
        if c in ";,)]}" or c == "\n" and text[at:i].strip():
            return i
        i += 1
    return i


def extract_functions(content: str | None) -> list[tuple[str, str | None, str]]:
    """(name, documentation in its place or None, source) of every function with a body, in text order."""
    if not content:
        return []
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    hashed = _HASHED.search(text) is not None
    first = _FIRST_HASH if hashed else _FIRST_SLASH
    masked = (_MASK_HASH if hashed else _MASK_SLASH).sub(_blank, text)
    starts = [masked.rfind("\n", 0, m.end()) + 1 for m in first.finditer(masked)]
    if not starts:
        return []
    begins_at = [_BLANKS.match(masked, x).end() for x in starts]
    heads = set(begins_at)
    ends_of = bracket_ends(masked)
    out: list[tuple[str, str | None, str]] = []
    lines: list[str] = []
    at_line: list[int] = []
    parse = _recogniser().parse
    done = -1
    for start, begin in zip(starts, begins_at, strict=True):
        if start < done:
            continue
        kinds, begins, ends = head_tokens(masked, begin, ends_of, heads, hashed)
        got = parse(kinds)
        if got is None or got[2] < 0:
            continue
        _, stop, noted = got
        name = masked[begins[noted] : ends[noted]]
        end = ends[stop - 1]
        done = max(done, begins[stop - 1])
        last = kinds[stop - 1]
        if hashed and last == ":":
            if not masked[end:].strip():
                continue  # a head without a body
            doc = _python_doc(text, end)
            close = _indented_end(masked, begin, end)
        else:
            if not lines:
                lines = text.split("\n")
                at_line = list(accumulate((len(x) + 1 for x in lines), initial=0))
            doc = _comment_above(lines, bisect_right(at_line, start) - 1, hashed)
            if hashed:
                close = _indented_end(masked, begin, min(end, len(masked)) - 1 if last == "NL" else end)
            else:
                close = _braced_end(masked, begins[stop - 1] if last == "{" else end, ends_of, begins_at, begin)
        out.append((name, doc, text[start:close].rstrip()))
    return out


# ---------------------------------------------------------------- documentation that says something

_MARKS = re.compile(r"^\s*(?:[rRuUbBfF]{0,2}(?=\"\"\"|''')|/\*\*?|\*/|\*(?!\w)|//[/!]?|#+!?|\"\"\"|'''|--+|;+|<!--)+\s?|\s*(?:\*/|\"\"\"|'''|-->)\s*$")
_TAG = re.compile(r"^\s*(?:[@\\](?!code\b)\w+|:\w+(?:\s+[\w*.]+){0,2}\s*:|\{@\w+[^}]*\}|-\s*(?:param|returns?)\b)", re.I)
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|throws|yields|examples?|errors|panics|safety|see also|notes?|attributes|exceptions|since)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^\s*[*\-]?\s*`?\w+`?\s*(?:\([^)]*\))?\s*(?::|--?|–)\s+\S")
_TODO = re.compile(r"^\s*(?:todo|fixme|xxx|hack|tbd)\b(?:\([^)]*\))?\s*[:\-.]?\s*", re.I)
#: Notices of licence and copyright, and directives to tools.
_LICENCE = re.compile(
    r"spdx-|copyright|\(c\)\s|©|all rights reserved|licen[cs]ed under|\blicen[cs]e\b.*\b(?:file|named|terms|program|copy)|\bsee licen[cs]e|permission is hereby|without warrant|"
    r"may (?:run|use|copy|change|modify).*(?:program|software|as long as)|redistribut|warranty|lizenz|licence|urheber",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\s*(?:noqa|type:\s*ignore|pylint|flake8|mypy|pragma|fmt:|isort|yapf|ruff|nosec|eslint|tslint|jshint|jslint|prettier|istanbul|c8 |ts-(?:ignore|nocheck|expect)|@ts-|nolint|golint|lint:|go:|\+build|"
    r"clang-(?:format|tidy)|nolintnextline|cppcheck|coverity|gcov|lcov|rubocop|frozen_string_literal|sorbet|typed:|rustfmt|clippy|allow\(|cfg|checkstyle|noinspection|suppresswarnings|spotless|sonar|"
    r"region\b|endregion\b|vim:|-\*-|shellcheck|codespell|cspell|biome|deno-lint|webpack|@(?:formatter|generated|internal|inheritdoc|override|deprecated|ts-\w+)\b)",
    re.I,
)
#: Phrases that stand where a description should.
_PLACEHOLDER = re.compile(
    r"^(?:(?:no|missing|add|insert|write|needs?|todo|fixme)\s+)*(?:(?:a|the|proper|some|short)\s+)*(?:description|documentation|docs?|docstring|comment|summary)(?:\s+(?:here|provided|pending|missing|available|needed|goes here|to be (?:done|added|written)|follows|later|tbd|todo|block was left empty.*|of this (?:function|method).*))*\W*$"
    r"|^(?:this|the)?\s*(?:documentation|comment|doc)\s+(?:block|comment)?\s*(?:was|is|has been|will be)\b.*(?:empty|filled|written|later|purpose).*$"
    r"|^(?:this|a|the)?\s*(?:function|method|constructor|getter|setter|destructor|helper|accessor|implementation|internal|private|public|test|wrapper|stub|default|utility|callback|handler|main|init|initializer)(?:\s+(?:function|method|only|implementation|stub|use only|helper))?\W*$"
    r"|^auto-?generated\b.*$|^(?:undocumented|n/?a|none|null|nil|tbd|tba|wip|xxx|placeholder|lorem ipsum.*|self-?explanatory|obvious|see (?:above|below|name|title|code|source|docs?|also|base|parent|super|interface).{0,40}|same as above|ditto|as the name (?:says|suggests|implies)|inherit(?:ed|s)?(?:doc)?.{0,20}|document(?: me| this)?|implement me|not documented|unknown|and so on|\(?description\)?(?:\s*\(?(?:parameters|returns?|return value|exceptions|see also|since)\)?)*.*)\W*$"
    r"|^(?:write|add|insert|put|fill in|provide)\s+(?:a\s+|the\s+|some\s+)?(?:proper\s+|good\s+|better\s+)?(?:description|documentation|docs?|docstring|comment).*$",
    re.I | re.S,
)
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|const|let|var|import|def|fn|func|print|defer|go|await|yield|raise|throw|puts|log|self\.|this\.)\b.*[=({;:]|\w\s*(?:=|\+=|:=|==|=>|->)\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*>>>|^\s*\$\s|^\s*@\w+\(")
_CODE_MARK = re.compile(r"[{}=]|\w\(|\w_\w|\w\.\w|::|->|\);|[a-z][A-Z]|^//| //")
_WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")
_FILLER = frozenset("the a an this that function method routine procedure helper of to for and or in on with from by is does it its der die das le la el".split())


def _forms(w: str) -> set[str]:
    """A word with and without the endings of its inflected forms."""
    out = {w}
    for end, put in (("s", ""), ("es", ""), ("ies", "y"), ("ied", "y"), ("ed", ""), ("d", ""), ("ing", ""), ("ing", "e"), ("er", ""), ("or", "")):
        if len(w) > len(end) + 1 and w.endswith(end):
            stem = w[: -len(end)] + put
            out.add(stem)
            if len(stem) > 3 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    return out


_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def template_of(text: str, name: str) -> str:
    """A description without what differs between the uses of a template: case, white space, numbers, and the name of
    the function, as it is and in words."""
    low = _SPACE.sub(" ", text.lower()).strip(" .!:*-")
    parts = [p.lower() for p in _SPLIT.findall(name)]
    for own in (name.lower(), " ".join(parts), "_".join(parts)):
        if len(own) > 2:
            low = low.replace(own, "\x00")
    return _DIGITS.sub("0", low)


def described(doc: str | None, name: str, phrases: bool = True) -> str | None:
    """The words of the documentation that say what the function does, or None if there are none. Without
    ``phrases`` the fixed lists of placeholders are not looked at: they are left to the counts of templates.

    Marks, tags and their lists, sections of parameters, directives to tools, notices of licence, code,
    rulers, placeholders and the function's own name in words are no description."""
    if not doc:
        return None
    kept: list[str] = []
    listing, tagged, licence, directive = False, False, False, False
    for line in doc.replace("\r", "").split("\n"):
        if _NOTE.match(line):
            continue
        prev = None
        while prev != line:
            prev, line = line, _MARKS.sub("", line)
        s = line.strip()
        if not s or not _WORD.search(s):
            listing = listing and bool(s)
            tagged = tagged and bool(s)
            continue
        if _SECTION.match(s):
            listing = not re.match(r"(?i)#*\s*(?:errors|panics|safety|notes?)\b", s)
            tagged = False
            continue
        if _TAG.match(s):
            tagged = True
            continue
        if tagged and line[:1] in " \t":
            continue  # a tag that goes on
        tagged = False
        if listing and (_ITEM.match(s) or line[:1] in " \t"):
            continue
        if _DIRECTIVE.match(s) or directive:
            directive = s.endswith(",")
            continue
        if _LICENCE.search(s):
            licence = True
            continue
        kept.append(s)
    if licence:  # the notice goes on over the lines around it
        return None
    text = " ".join(kept).strip()
    if not text:
        return None
    lead = _TODO.match(text) if phrases else None
    if lead:
        text = text[lead.end() :]
        if re.match(r"(?i)\W*$|(?:document|write|describe|add|explain|fill|rename)\b[^.]*\W*$", text):
            return None
        text = re.sub(r"(?i)^(?:rename|document|refactor|clean ?up)\.\s*", "", text)
    if phrases and (_PLACEHOLDER.match(text.strip(" .*-_")) or _PLACEHOLDER.match(text)):
        return None
    if sum(bool(_CODE.search(x)) for x in kept) * 2 > len(kept) or len(_CODE_MARK.findall(text.replace(name, ""))) * 4 >= len(text.split()):
        return None
    words = [w.lower() for w in _WORD.findall(text)]
    wide = any(len(w) >= 3 and ord(w[0]) >= 0x2E80 for w in words)
    if len(words) < 2 and not wide:
        return None
    own = set().union(*(_forms(p.lower()) for p in _SPLIT.findall(name)), {name.lower()})
    rest = [w for w in words if w not in _FILLER and not _forms(w) & own]
    if not rest:
        return None
    return text


#: A description is a template if functions of so many names have it and it makes up this share of all pairs.
TEMPLATE_LEAST = 12
TEMPLATE_SHARE = 0.0015
BROADCAST_TEMPLATES = 100_000


def documented_functions(
    df: DataFrame,
    id_col: str = "id",
    content_col: str = "content",
    doc_col: str = "doc_comment",
    kind_col: str = "kind",
    symbol_col: str = "symbol_path",
    template_share: float = TEMPLATE_SHARE,
    template_least: int = TEMPLATE_LEAST,
    code: bool = True,
    phrases: bool = True,
) -> DataFrame:
    """(chunk_id, func_name, code_doc, code) of each documented function, once; ``code`` is its source from the
    head to the end of the body, left out if not ``code``.

    Chunks of kind ``test`` (in any case, blanks aside) are left out; a null kind is no test.
    Documentation is the comment above the function or its docstring, else ``doc_comment`` for the
    function that is the last part of the chunk's symbol path. A description that, but for the name of the
    function and numbers, functions of at least ``template_least`` different names have, and that makes up
    ``template_share`` of all pairs, is a template and dropped: a share, so that a larger corpus doesn't lose
    what a smaller one keeps. ``phrases``: of what the counts leave, fixed lists of placeholders are dropped too, for
    the rare ones and for small corpora.

    Null ids and contents give nothing; empty contents have no function; repeated rows count once; of several
    functions of one name in a chunk the least description stands, with its source; texts of any length are
    parsed whole, a head costs its own length; other columns are ignored; an empty table gives no rows."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content"), F.col(doc_col).alias("doc"), F.element_at(F.split(F.col(symbol_col), "::|\\.|#"), -1).alias("symbol")
    ).filter(F.col("id").isNotNull() & F.col("content").isNotNull() & (F.lower(F.trim(F.coalesce(F.col(kind_col), F.lit("")))) != "test"))
    # a function head and a place for documentation, or there is nothing to find
    rows = rows.filter(F.col("content").rlike(r"\b(?:def|fn|func|function)\b|=>|\)[^;{})]*+\{"))
    rows = rows.filter((F.length(F.trim("doc")) > 0) | F.col("content").rlike(r"//|#|/\*|\"\"\"|'''|(?m)^[ \t]*[rRuU]?[\"']"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, docs, template, listed, source = [], [], [], [], [], []
            for i, content, doc, symbol in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for name, own, body in extract_functions(content):
                    places = [own, doc] if name == symbol else [own]
                    text = next((t for p in places if (t := described(p, name))), None)
                    raw = text or next((t for p in places if (t := described(p, name, False))), None)
                    if raw is not None:
                        ids.append(i)
                        names.append(name)
                        docs.append(raw)
                        template.append(template_of(raw, name))
                        listed.append(text is None)
                        source.append(body if code else None)
            cols = [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (names, docs, template)), pa.array(listed, pa.bool_()), pa.array(source, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["chunk_id", "func_name", "code_doc", "template", "listed", "code"])

    found = rows.mapInArrow(run, "chunk_id long, func_name string, code_doc string, template string, listed boolean, code string")
    found = materialize(found.withColumn("h", F.xxhash64("template")).drop("template"), "functions")
    per = found.select("h", "func_name").groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.approx_count_distinct("func_name", 0.02).alias("names"))
    total = found.count()
    template = materialize(per.filter((F.col("names") >= template_least) & (F.col("c") >= max(1.0, template_share * total))).select("h"), "templates")
    if template.count() <= BROADCAST_TEMPLATES:  # at most 1 / template_share of them
        template = F.broadcast(template)
    kept = (found.filter("not listed") if phrases else found).join(template, "h", "left_anti")
    out = kept.groupBy("chunk_id", "func_name").agg(F.min(F.struct("code_doc", "code")).alias("m"))
    return out.select("chunk_id", "func_name", "m.code_doc", *(["m.code"] if code else []))
