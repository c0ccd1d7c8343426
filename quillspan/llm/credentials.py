"""Credentials embedded in source code: found by a logistic regression and masked in place.

Candidate values come from the places where credentials stand (assignments, addresses, commands,
headers, comments, key blocks). Weak labels come from patterns that are right nearly always and are used
for training alone; the regression learns from the character Markov likelihood of the value, its shape, the
identifiers around it and the path, and scores every candidate; scores are calibrated on held-out
candidates and those of 0.5 or more are findings.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.sampling import bounded_sample
from quillspan.session import materialize

#: About as many distinct candidates, chosen by hash, the regression is fitted on at most.
FIT_ROWS = 40_000
#: Rows with findings that are sent to every executor to pick the contents to be masked: some 30 MB.
BROADCAST_SPANS = 300_000

#: A line with none of these (in any case) holds no credential; the last are prefixes of issued keys.
_HINTS = [x.encode() for x in ("pass", "pwd", "secret", "token", "key", "_pw", "pw=", "cred", "authorization", "bearer", "-----begin", "://", "login", " -u", "--user", "eyj", "akia", "ghp_", "gho_", "xox", "sk_live", "glpat-", "aiza")]
_KEY = r"([A-Za-z_$][\w.\-$]*)[\"'`]?\]?"
_TYPE = r"(?:\s*:\s*[&\w<>*?\[\] ]{1,40}?(?=\s*=))?"
_QUOTED = re.compile(_KEY + _TYPE + r"\s*(?:=>|:=|\|\|=|=|:|(?P<comma>,)| is )\s*(?:\(\s*)?(?:[rbuf@$]{0,2}|new String\(|String\.valueOf\()(?P<q>[\"'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n]){4,})(?P=q)?", re.I)
_DEFINE = re.compile(r"#\s*define\s+(\w+)\s+(?P<q>[\"'])(?P<v>(?:\\.|(?!(?P=q))[^\\\n]){4,})(?P=q)(?P<comma>(?!))?")
_BARE = re.compile(r"^\s*(?:[-*>|]\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+)?([A-Za-z_][\w.\-]*)\s*(?:=|:\s)\s*([^\s\"'`{(\[#;,][^\s\"'`,;]{5,})\s*[,;]?\s*(?:#.*)?$")
_URL = re.compile(r"\b([A-Za-z][\w+.\-]*)://([^\s:/@\"'`<>]*):([^\s\"'`<>]+)@(?=[\w\[.\-])")
_CONN = re.compile(r"(?:[;?&]|(?<=[\"'`]))\s*(password|passwd|pwd|secret|accountkey|sharedaccesskey|token|pass)=([^;\"'`\s&]+)", re.I)
_ISSUED = re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[posu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|glpat-[\w\-]{20,}|AIza[\w\-]{35})")
_FLAG = re.compile(r"(?:(?<![\w\-.])--?(password|passwd|pass|pw|token|secret|api-?key|access-?key|auth-?token|client-secret|credential)(?:=|\s+))[\"']?([^\s\"'`]+)", re.I)
_SSHPASS = re.compile(r"\b(sshpass)\s+-p\s*[\"']?([^\s\"'`]+)")
_USER = re.compile(r"\s(-u|--user)[ =][\"']?[\w.\-]+:([^\s\"'`@]+)")
_HEADER = re.compile(r"\b(authorization|proxy-authorization|x-[\w\-]*(?:key|token|secret)[\w\-]*)\b[\"'`]?\]?\s*[:=,]\s*[\"'`]?(?:(?:bearer|basic|token|apikey)\s+)?([^\s\"'`]{8,})", re.I)
_BEARER = re.compile(r"\b(bearer|basic)\s+([A-Za-z0-9+/=_\-.]{12,})", re.I)
_JWT = re.compile(r"\b(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_SAID = re.compile(r"\b(?:creds?|credentials?|login|passw(?:or)?d|pass|pwd?|token|secret|api.?key|key)\b", re.I)
_COMMENT = re.compile(r"(?:(?<![:\"'\w])//|(?:^|\s)#|/\*|^\s*\*|(?:^|\s)--\s|<!--|\"\"\"|^\s*;)")
_SENTENCE = re.compile(r"^[\s\"'>*\-\d.]*[A-Za-z_]+[\"']?:?(?:\s+[\w,.:/\"'()=\-]+){2,}")
_PROSE_TOKEN = re.compile(r"(?<![\w/.\-+=:@])(?:(\w+)=)?((?=[^\s]*\d|[^\s]*[!?#$%*^~])(?=[^\s]*[A-Za-z])[^\s\"'`<>()\[\]{},;|&]{8,})")
_LEAD = re.compile(r"(?:\b(?:key|token|passw(?:or)?d|pass|pwd?|secret|api.?key)\s*(?:is|was|=|:)?\s*|\b(?:login|creds?)\b[^:]*:\s*\S+\s*/\s*|\bpass(?:word)?=)$", re.I)

STRONG = frozenset("password passwd passphrase pwd pw pass secret token credential credentials apikey bearer authorization sshpass creds passw login jwt".split())
PASSWORDS = frozenset("password passwd passphrase pwd".split())
KEYED = frozenset("api access private encryption signing auth secret session service client deploy master account shared admin license webhook smtp".split())
NEUTRAL = frozenset("id ids uuid guid sha sha1 sha256 sha512 md5 hash digest checksum etag fingerprint integrity commit rev revision version build trace request span nonce public pub cert certificate icon image data".split())

_PLACEHOLDER = re.compile(
    r"(?i)^[*x0.\-_#•?]+$|^<.*>$|^\$|^%|^\{\{|\}\}|\$\{|\$\(|%\(|#\{|^\[.*\]$|^@|your|change.?me|redacted|example|placeholder|dummy|sample|insert|replace|enter[_-]|todo|fixme|masked|hidden|removed|^(.)\1+$|"
    r"process\.env|os\.environ|getenv|env\[|vault|secretsmanager|config[.\[]|settings\.|^(?:none|null|nil|true|false|undefined|empty|secret|password|token|string|str)$|<[a-z_\- ]+>|^\.\.\.|\.\.\.$|xxxx|\*\*\*\*|0000000|1234567"
)
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_COLON = re.compile(r"^(?:[0-9a-fA-F]{2}:){3,}[0-9a-fA-F]{2}$")
_SRI = re.compile(r"^sha\d+[-:]")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]+$")
_FILE = re.compile(r"^[\w.\-/]+\.(?:py|rs|ts|tsx|js|go|java|rb|c|h|md|json|ya?ml|toml|css|sh|txt|lock|html?)$|^https?://[^@]*$|^data:")
_SEGMENT = re.compile(r"^(?:[a-z0-9_.\-]*|[A-Z0-9_]+|(?:[A-Z]?[a-z]+)(?:[A-Z][a-z]+)*)$")
_WORDS = re.compile(r"^(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+)(?:[_.\-:](?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]+))*$")
_CALL = re.compile(r"^[\w.]+[(\[]|^\w+(?:->|\?\.|::)|^[a-z_]\w*(?:\.[a-z_]\w*)+[?!]?$|^[A-Z0-9]*_[A-Z0-9_]*$|^[A-Z]+\d?$|^self\.|^this\.")
_REFERENCE = re.compile(r"^[\w.]+[(\[]|^\w+(?:->|\?\.|::)|^[a-z_]+(?:\.[a-z_]+)+[?!]?$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def key_parts(key: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(key)]


def names_secret(key: str) -> bool:
    """Whether an identifier says that what it holds is secret."""
    p = key_parts(key)
    if not p or p[-1] in ("id", "ids", "url", "count", "len", "size", "name", "type", "path", "file", "limit", "length"):
        return False
    if any(x in STRONG for x in p):
        return "public" not in p
    if p[-1].endswith(("password", "passwd", "passphrase", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "authkey", "signingkey", "encryptionkey", "credential", "credentials")):
        return True
    return p[-1] in ("key", "keys") and any(x in KEYED for x in p)


def names_password(key: str) -> bool:
    """Whether an identifier ends in a word for a password."""
    p = key_parts(key)
    return bool(p) and p[-1] in PASSWORDS


def candidates_of(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(line, start, end, place, key, value) of all values that might be a credential; start and end
    are places in the text, lines count from 1 and end at line feeds."""
    out: list[tuple[int, int, int, str, str, str]] = []
    data = text.encode("utf-8", "surrogatepass").lower()
    rows: set[int] = set()
    for hint in _HINTS:
        p = data.find(hint)
        row, seen = 0, 0
        while p >= 0:
            row += data.count(b"\n", seen, p)
            seen = p
            rows.add(row)
            p = data.find(b"\n", p)
            if p >= 0:
                p = data.find(hint, p)
    if not rows:
        return out
    lines = text.split("\n")
    begin, before, end_of_block = 0, 0, -1
    for row in sorted(rows):
        for j in range(before, row):
            begin += len(lines[j]) + 1
        before = row
        if begin >= end_of_block:
            end_of_block = _line_candidates(text, lines[row], begin, row + 1, out)
    return out


def _line_candidates(text: str, line: str, begin: int, no: int, out: list) -> int:
    """Candidates of one line are added to ``out``; returns where a key block that begins in it ends."""
    taken: list[tuple[int, int]] = []
    end_of_block = -1

    def add(place: str, key: str, s: int, e: int) -> None:
        if e > s and not any(a < e and s < b for a, b in taken):
            taken.append((s, e))
            out.append((no, begin + s, begin + e, place, key, line[s:e]))

    if "PRIVATE KEY" in line:
        for m in _PEM.finditer(line):
            close = _PEM_END.search(text, begin + m.end())
            stop = close.start() if close else begin + len(line)
            taken.append((m.start(), len(line)) if stop >= begin + len(line) else (m.start(), stop - begin + 30))
            out.append((no, begin + m.end(), stop, "pem", "private_key", text[begin + m.end() : stop]))
            end_of_block = max(end_of_block, stop)
    if "://" in line and "@" in line:
        for m in _URL.finditer(line):
            add("url", m.group(1), *m.span(3))
    if "eyJ" in line:
        for m in _JWT.finditer(line):
            add("jwt", "jwt", *m.span(1))
    for m in _ISSUED.finditer(line):
        add("jwt", "issued", *m.span(1))
    for rx, place in ((_SSHPASS, "flag"), (_FLAG, "flag"), (_USER, "flag"), (_HEADER, "header"), (_BEARER, "header")):
        for m in rx.finditer(line):
            add(place, m.group(1), *m.span(2))
    if "=" in line:
        for m in _CONN.finditer(line):
            add("conn", m.group(1), *m.span(2))
    for rx in (_DEFINE, _QUOTED):
        for m in rx.finditer(line):
            if " " not in m.group("v").strip():
                add("argument" if m.group("comma") else "quoted", m.group(1), *m.span("v"))
    m = _BARE.match(line)
    if m:
        add("bare", m.group(1), *m.span(2))
    if _SAID.search(line) and not any(x[0] == no and x[3] == "conn" for x in out[-4:]):
        m = _COMMENT.search(line)
        if not m and _SENTENCE.match(line) and not re.search(r"[;{}]\s*$|\w\(", line):
            m = re.match("", line)
        if m:
            for t in _PROSE_TOKEN.finditer(line, m.end()):
                if t.group(1) and not names_secret(t.group(1)):
                    continue
                v = t.group(2).rstrip(".,:;")
                if "-----" in v:  # the mark of a block of another kind
                    continue
                lead = _LEAD.search(line, m.end(), t.start(2)) is not None
                add("prose", t.group(1) or ("secret" if lead else "comment"), t.start(2), t.start(2) + len(v))
    return end_of_block


# ---------------------------------------------------------------- features

PLACES = ("url", "jwt", "pem", "flag", "header", "quoted", "argument", "conn", "bare", "prose")
PATHS = ("test", "docs", "config", "example", "vendor", "generated")
CLASSES = 30  # letters without case, digit, capital, other marks, begin and end
_CLASS = np.full(128, 28, np.int64)
_CLASS[ord("0") : ord("9") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1] = 26, 27, np.arange(26)


def _points(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le", "replace"), np.uint32)


def _codes(value: str) -> np.ndarray:
    """Classes of the characters between those of begin and end."""
    p = _points(value)
    return np.concatenate([[29], np.where(p < 128, _CLASS[np.minimum(p, 127)], 28), [29]])


def pathlike(value: str) -> bool:
    return bool(_FILE.match(value)) or "/" in value and all(_SEGMENT.match(x) for x in value.split("/"))


def _mixed(value: str) -> bool:
    """Letters among digits or marks, or long and not made of words."""
    return bool(re.search(r"[A-Za-z]", value)) and (bool(re.search(r"[\d!?#$%*^~&+=]", value)) or bool(re.fullmatch(r"[\w\-/+=]{12,}", value)) and not _WORDS.match(value))


#: What the regression holds of each feature before it has seen any candidate, for corpora with few of them.
PRIOR = {
    "bias": -3.0, "markov": -1.0, "entropy": 1.0, "hex": -0.5, "uuid": -4.0, "colon": -4.0, "sri": -4.0, "pathlike": -4.0, "words": -1.5, "call": -4.0, "placeholder": -6.0,
    "blank": -4.0, "digits": -4.0, "mixed": 1.0, "long_mixed": 1.0, "secret": 1.0, "neutral": -2.0, "url": 4.0, "jwt": 6.0, "pem": 8.0, "flag": 1.0, "header": 1.0, "conn": 2.0,
    "secret_mixed": 2.0, "secret_assigned": 2.0, "secret_argument": 0.5, "carried_mixed": 1.5, "password_words": 6.0,
}
NAMES = (
    "bias", "markov", "entropy", "length", "digit_share", "capital_share", "mark_share", "hex", "uuid", "colon", "sri", "pathlike", "words", "call", "placeholder", "blank", "digits", "mixed", "long_mixed",
    "secret", "strong", "neutral", *PLACES, *(f"in_{x}" for x in PATHS), "secret_mixed", "secret_assigned", "secret_argument", "secret_said", "carried_mixed", "password_words", "secret_long",
)
_PRIOR = np.array([PRIOR.get(x, 0.0) for x in NAMES])


def features(place: str, key: str, value: str, path: str, markov: np.ndarray) -> np.ndarray:
    c = _codes(value)
    n = max(len(value), 1)
    counts = np.bincount(c[1:-1], minlength=CLASSES)
    p = (np.unique(_points(value), return_counts=True)[1] if value else np.ones(1)) / n
    parts = set(key_parts(key))
    low = path.lower()
    block = place == "pem"
    mixed, secret = _mixed(value), names_secret(key)
    stands_in = not block and bool(_PLACEHOLDER.search(value))
    words = not stands_in and bool(_WORDS.match(value))
    shape = [
        markov[c[:-1], c[1:]].mean() + 3, -(p * np.log2(p)).sum() / 4, math.log(n) / 4, counts[26] / n, counts[27] / n, counts[28] / n,
        bool(_HEX.match(value)), bool(_UUID.match(value)), bool(_COLON.match(value)), bool(_SRI.match(value)), not block and pathlike(value),
        words, not block and (bool(_REFERENCE.match(value)) or bool(_CALL.match(value)) and not mixed), stands_in, not block and " " in value.strip(), value.isdigit(), mixed, mixed and n >= 8,
    ]
    about = [secret, bool(parts & STRONG), bool(parts & NEUTRAL) and not secret]
    both = [
        secret and mixed and n >= 8, secret and place == "quoted", secret and place == "argument", secret and place == "prose", mixed and place in ("flag", "conn", "header"),
        words and place == "quoted" and names_password(key), secret and n > 150]
    return np.array([1.0, *shape, *about, *(place == x for x in PLACES), *(x in low for x in PATHS), *both], dtype=float)


def weak_label(place: str, key: str, value: str) -> int:
    """1 or 0 where a pattern is right nearly always, -1 where none is; for training alone."""
    if place == "pem":
        return 1 if len(value.strip()) >= 8 else 0
    if _PLACEHOLDER.search(value) or value.isdigit() or " " in value.strip():
        return 0
    if place == "jwt":
        return 1
    if place == "url":
        return 1 if len(value) >= 4 else -1
    if _UUID.match(value) or _COLON.match(value) or _SRI.match(value) or pathlike(value):
        return 0
    mixed = _mixed(value)
    if _REFERENCE.match(value) or _CALL.match(value) and not mixed:
        return 0
    secret = names_secret(key)
    if place in ("flag", "conn", "header"):
        return 1 if mixed and len(value) >= 8 else -1
    if secret and mixed and len(value) >= 8:
        return 1 if place != "bare" or not _CALL.match(value) else -1
    if not secret and set(key_parts(key)) & NEUTRAL:
        return 0
    if _WORDS.match(value):
        return (1 if names_password(key) and len(value) >= 6 else -1) if secret and place == "quoted" else 0
    if not secret and len(value) > 150 and place in ("quoted", "argument", "bare"):
        return 0  # data kept in the code
    return -1


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression with a quadratic penalty on their distance from ``prior``, by Newton's method."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - prior)
        h = (x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d / max(1.0, np.abs(d).max() / 4)
        if np.abs(d).max() < 1e-6:
            break
    return w


class CredentialModel:
    """Markov table, weights and calibration; of fixed size, and sent to the executors as a whole."""

    def __init__(self, markov: np.ndarray, weights: np.ndarray, slope: float = 1.0, offset: float = 0.0) -> None:
        self.markov, self.weights, self.slope, self.offset = markov, weights, slope, offset

    @classmethod
    def fit(cls, markov: np.ndarray, x: np.ndarray, y: np.ndarray) -> CredentialModel:
        """From the features and weak labels of candidates; every fifth calibrates."""
        held = np.arange(len(y)) % 5 == 4
        if len(y) < 100 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            return cls(markov, _fit(x, y, _PRIOR))
        w = _fit(x[~held], y[~held], _PRIOR)
        s = np.clip(x[held] @ w, -30, 30)
        slope, offset = _fit(np.stack([s, np.ones(len(s))], 1), y[held], np.array([1.0, 0.0]), ridge=1.0)
        return cls(markov, w, float(slope), float(offset))

    def score(self, place: str, key: str, value: str, path: str) -> float:
        """Probability that a candidate is a credential."""
        z = float(features(place, key, value, path, self.markov) @ self.weights)
        return 1 / (1 + math.exp(-min(max(self.slope * z + self.offset, -30), 30)))

    def dumps(self) -> str:
        return json.dumps([x.tolist() if isinstance(x, np.ndarray) else x for x in (self.markov, self.weights, self.slope, self.offset)])

    @classmethod
    def loads(cls, text: str) -> CredentialModel:
        a = json.loads(text)
        return cls(*(np.array(x) for x in a[:2]), *a[2:])


def markov_model(values: DataFrame) -> np.ndarray:
    """Log probabilities of character classes after one another in ordinary values: the candidates of ``values``
    (place, key, value) that no credential can be, all of them; the counts are summed where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for place, key, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if weak_label(place, key, value) == 0:
                    c = _codes(value)
                    counts += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    sums = values.select("place", "key", "value").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.full(CLASSES * CLASSES, 0.5)
    for r in sums:
        counts[r["at"]] += r["n"]
    counts = counts.reshape(CLASSES, CLASSES)
    return np.log(counts / counts.sum(1, keepdims=True))


def fit_model(candidates: DataFrame, fit_rows: int = FIT_ROWS) -> CredentialModel:
    """The model of distinct candidates (place, key, value, path): Markov counts over all, the regression on about
    ``fit_rows`` at most, of which the features come to the driver (some 50 numbers each), never the values."""
    markov = markov_model(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, weak_label(*r[:3])) for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            x = [features(*r, markov).tolist() for r, y in rows if y >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array([y for _, y in rows if y >= 0], pa.float64())], ["x", "y"])

    sample = bounded_sample(candidates, fit_rows, "place", "key", "value", "path")
    got = sorted((r["x"], r["y"]) for r in sample.select("place", "key", "value", "path").mapInArrow(run, "x array<double>, y double").collect())
    x = np.array([r[0] for r in got]).reshape(-1, len(NAMES))
    order = np.random.default_rng(5).permutation(len(got))
    return CredentialModel.fit(markov, x[order], np.array([r[1] for r in got])[order])


def find_candidates(df: DataFrame, src: str, id_col: str, content_col: str, path_col: str) -> DataFrame:
    """(src, row_id, content_hash, line_no, start, stop, place, key, value, path) of all candidates of a table."""
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(content_col)).alias("h"), F.col(content_col).alias("content"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")
    ).filter("id is not null and content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row_id", "content_hash", "line_no", "start", "stop", "place", "key", "value", "path"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            out = []
            for i, h, content, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(i, h, no, s, e, place, key, value, path) for no, s, e, place, key, value in candidates_of(content)]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    found = rows.mapInArrow(run, "row_id long, content_hash long, line_no int, start long, stop long, place string, key string, value string, path string")
    return found.select(F.lit(src).alias("src"), "*")


def find_credentials(sources: list[DataFrame], fit_rows: int = FIT_ROWS) -> DataFrame:
    """(src, row_id, content_hash, line_no, start, stop, place, key, score) of the credentials among the candidates
    of ``find_candidates`` over one or more tables; start and stop are code points of the content of that hash.

    The regression is fitted on about ``fit_rows`` distinct candidates at most, chosen by hash, and scores
    all of them. Null ids and contents have no findings; repeated rows count once; an id with two contents has
    the findings of each; texts and values of any length are read whole; empty tables give no rows."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    every = materialize(every, "credential-candidates")
    model = fit_model(materialize(every.select("place", "key", "value", "path").distinct(), "credential-distinct"), fit_rows).dumps()
    names = ["src", "row_id", "content_hash", "line_no", "start", "stop", "place", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CredentialModel.loads(model)
        for b in batches:
            score = [m.score(*r) for r in zip(*(b.column(i).to_pylist() for i in (6, 7, 8, 9)), strict=True)]
            t = pa.RecordBatch.from_arrays([*b.columns[:8], pa.array(score, pa.float64())], [*names, "score"])
            yield t.filter(pa.array([s >= 0.5 for s in score], pa.bool_()))

    return every.mapInArrow(run, "src string, row_id long, content_hash long, line_no int, start long, stop long, place string, key string, score double")


_KEEP = re.compile(r"\\[nrt]|\s")


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every character of the spans as ``*``, but for white space and escaped line ends:
    quotes, brackets and line numbers stay as they were."""
    out, at = [], 0
    for s, e in sorted(spans):
        s = max(s, at)
        if e <= s or e > len(text):
            continue
        out.append(text[at:s])
        last = s
        for m in _KEEP.finditer(text, s, e):
            out.append("*" * (m.start() - last))
            out.append(m.group())
            last = m.end()
        out.append("*" * (e - last))
        at = e
    out.append(text[at:])
    return "".join(out)


def redact(df: DataFrame, findings: DataFrame, src: str, id_col: str, content_col: str) -> DataFrame:
    """(src, row_id, content) of the rows of a table with findings, masked; once per content. Of several contents
    of one id each is masked by its own findings."""
    key = ["row_id", "content_hash"]
    spans = findings.filter(F.col("src") == src).groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = materialize(spans, "credential-spans")
    if spans.count() <= BROADCAST_SPANS:  # else the contents are shuffled to them
        spans = F.broadcast(spans)
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(content_col).alias("content")).filter("content is not null")
    rows = rows.withColumn("content_hash", F.xxhash64("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [masked(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row_id", "content"])

    done = rows.join(spans, key).select("row_id", "content", "spans").mapInArrow(run, "row_id long, content string")
    return done.distinct().select(F.lit(src).alias("src"), "*")
