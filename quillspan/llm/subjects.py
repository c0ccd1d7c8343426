"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of terms and a subject; rules terms -> subject are
mined with parallel frequent-pattern growth, redundant rules are pruned, and every sentence of every
document is scored by the evidence of the rules it matches, at a threshold calibrated on held-out
documents. A document has the subjects that enough of its sentences are on.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.sampling import bounded_sample
from quillspan.session import materialize

#: About as many labelled documents the rules are mined from at most, by hash of their id; others are all used.
FIT_DOCUMENTS = 20_000
#: Ids of labelled documents left out, and terms, that are sent to every executor: else they are joined.
BROADCAST_IDS = 2_000_000
BROADCAST_TERMS = 200_000
#: Bytes of a batch that a Python worker takes or gives at once: the Python objects of texts have some twenty times as much.
SLICE_BYTES = 4_000_000
LEAST_SHARE = 0.2
MOST_SUBJECTS = 2
MIN_SUPPORT = 0.0004
LEAST_COUNT = 3
LEAST_LIFT = 2.5
CLASS = "\x1f"  # begins the items that are subjects

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)|<(pre|code|script|style)\b[^>]*>.*?(?:</\2>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|blockquote|body|html|head|title)\b[^<>]*>")
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_CODE = re.compile(r"`[^`\n]*`")
_MARK = re.compile(r"^(?:\s*(?:[-*+>•|]+|\d{1,3}[.)])(?=\s|$))+\s*")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}|-{3,}|\*{3,})")
_END = re.compile(r"(?<=[.!?…])[\"')\]*_]*\s+|(?<=[。！？])")
_BROKEN = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _mended(m: re.Match) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: what ends like one; no code, markup, headings or list marks. UTF-8 that
    was once read as a single-byte encoding is mended."""
    if not text:
        return []
    t = _BROKEN.sub(_mended, text.replace("\r\n", "\n").replace("\r", "\n"))
    t = _FENCE.sub("\n\n", t)
    t = _TAG.sub(" ", _BLOCK.sub("\n\n", t))
    if "&" in t:
        t = html.unescape(t)
    t = _CODE.sub("CODE", t)
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            for s in _END.split(" ".join(held)):
                s = _MARK.sub("", s).strip()
                if s and s[-1] in ".!?:…。！？)\"'" and len(_WORD.findall(s)) >= 2:
                    out.append(s)
            held.clear()

    for line in t.split("\n"):
        if not line.strip() or _HEADING.match(line):
            close()
            continue
        if _MARK.match(line):
            close()
            line = _MARK.sub("", line)
        held.append(line.strip())
        if line.rstrip()[-1] in ".!?:…。！？":
            close()
    close()
    return out


def terms(sentence: str) -> list[str]:
    """Words in lower case and pairs of neighbours, each once."""
    words = [w.lower() for w in _WORD.findall(sentence)]
    words = [w for w in words if w != "code" and len(w) > 1]
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches of at most ``rows`` rows and ``SLICE_BYTES``, so that the Python objects made of one stay
    few; a row of more is a batch of its own."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > SLICE_BYTES:
                n //= 2
            yield b.slice(at, n)
            at += n


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, no, items) of every sentence of (id, text), given as soon as the sentences at hand have SLICE_BYTES / 4:
    their terms, each word by itself and in pairs, have some three times as much."""

    def batch(own: list[int], no: list[int], items: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(no, pa.int32()), pa.array(items, pa.list_(pa.string()))], ["id", "no", "items"])

    for b in _slices(batches, 100):
        own, no, items, held = [], [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for j, s in enumerate(sentences(t)):
                if held and held + len(s) > SLICE_BYTES // 4:
                    yield batch(own, no, items)
                    own, no, items, held = [], [], [], 0
                own.append(i)
                no.append(j)
                items.append(terms(s))
                held += len(s)
        yield batch(own, no, items)


def _known_items(column: pa.Array, known: pa.Array) -> list[list[str]]:
    """Per row the items that are in ``known``; only those become Python objects."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(column) else column.values
    offsets = offsets - offsets[0] if len(offsets) else offsets
    hit = pc.is_in(flat, value_set=known).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(hit)])[offsets]
    found = flat.filter(pa.array(hit)).to_pylist()
    return [found[a:b] for a, b in zip(before.tolist(), before[1:].tolist(), strict=False)]


def _plain(c: str):  # noqa: ANN202
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"[\s\-]+", "_")


class RuleModel:
    """Rules (terms -> subject with a confidence) and the threshold of evidence; small, sent to the executors."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]], threshold: float) -> None:
        self.rules, self.threshold = rules, threshold
        self.by_term: dict[str, list[tuple[frozenset[str], str, float]]] = defaultdict(list)
        for left, subject, confidence in rules:
            self.by_term[left[0]].append((frozenset(left), subject, confidence))

    def known(self) -> pa.Array:
        """All terms of the rules."""
        return pa.array(sorted({t for left, _, _ in self.rules for t in left}), pa.string())

    def evidence(self, items: list[str]) -> dict[str, float]:
        """Per subject 1 - the product of (1 - confidence) over the matched rules that share no term."""
        have = set(items)
        matched = [(c, len(left), left, s) for t in items for left, s, c in self.by_term.get(t, ()) if left <= have]
        out: dict[str, float] = {}
        used: dict[str, set[str]] = defaultdict(set)
        for c, _, left, s in sorted(matched, key=lambda m: (-m[0], -m[1], m[3], sorted(m[2]))):
            words = {w for t in left for w in t.split(" ")}
            if words & used[s]:
                continue
            used[s] |= words
            out[s] = 1 - (1 - out.get(s, 0.0)) * (1 - c)
        return out

    def subject(self, items: list[str]) -> str | None:
        e = self.evidence(items)
        if not e:
            return None
        best = min(e, key=lambda s: (-e[s], s))
        return best if e[best] >= self.threshold else None

    def shares(self, text: str | None) -> dict[str, float]:
        """Share of the sentences on each subject."""
        ss = sentences(text)
        counts = Counter(x for s in ss if (x := self.subject(terms(s))))
        return {s: n / len(ss) for s, n in counts.items()}

    def document(self, text: str | None) -> list[tuple[str, float]]:
        got = sorted(((s, v) for s, v in self.shares(text).items() if v >= LEAST_SHARE - 1e-9), key=lambda x: (-x[1], x[0]))
        return got[:MOST_SUBJECTS]

    def dumps(self) -> str:
        return json.dumps([self.rules, self.threshold])

    @classmethod
    def loads(cls, text: str) -> RuleModel:
        rules, threshold = json.loads(text)
        return cls([(tuple(a), s, c) for a, s, c in rules], threshold)


def prune(rules: list[tuple[tuple[str, ...], str, float]], margin: float = 0.02) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules without the redundant ones: those no more confident than a rule to the same subject from a
    part of their terms."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    kept: dict[str, dict[str, list[tuple[frozenset[str], float]]]] = defaultdict(lambda: defaultdict(list))
    for left, subject, confidence in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        have = frozenset(left)
        if any(c + margin >= confidence for t in left for part, c in kept[subject][t] if part <= have):
            continue
        kept[subject][min(left)].append((have, confidence))
        out.append((tuple(sorted(left)), subject, confidence))
    return out


def _select(rows: DataFrame, prior: dict[str, float]) -> DataFrame:
    """(item) terms that speak for a subject: in enough documents and LEAST_LIFT times likelier with one subject
    than that is on the whole; a pair of words only if it says more than each of the two."""
    n = sum(prior.values())
    counts = rows.select("id", "subject", F.explode("items").alias("item")).distinct().groupBy("item", "subject").agg(F.count(F.lit(1)).alias("c"))
    part = F.create_map(*(F.lit(x) for s, v in prior.items() for x in (s, v / n)))
    best = counts.groupBy("item").agg(F.sum("c").alias("t"), F.collect_list(F.struct("c", part[F.col("subject")].alias("p"))).alias("s")).filter(f"t >= {LEAST_COUNT}")
    lift = best.select("item", F.array_max(F.transform("s", lambda x: (x["c"] + 0.5) / (F.col("t") + 2) / x["p"])).alias("v"))
    lift = materialize(lift, "rule-terms")
    words, two = lift.filter("instr(item, ' ') = 0"), lift.filter(f"instr(item, ' ') > 0 and v >= {LEAST_LIFT}")
    for at in (1, -1):
        one = words.select(F.col("item").alias("word"), F.col("v").alias("w"))
        two = two.withColumn("word", F.substring_index("item", " ", at)).join(one, "word", "left").filter("v > 1.3D * coalesce(w, 0)").select("item", "v")
    return words.filter(f"v >= {LEAST_LIFT}").select("item").union(two.select("item"))


def _mine(rows: DataFrame) -> list[tuple[tuple[str, ...], str, float]]:
    """Rules from transactions (id, items, subject), not pruned."""
    prior = {r["subject"]: float(r["n"]) for r in rows.select("id", "subject").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(prior.values())
    if not prior:
        return []
    chosen = materialize(_select(rows, prior), "rule-chosen")
    few = chosen.count()
    if not few:
        return []
    sel = rows.sparkSession.sparkContext.broadcast(sorted(r["item"] for r in chosen.collect()) if few <= BROADCAST_TERMS else None)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sel.value is None else pa.array(sel.value, pa.string())
        for b in _slices(batches, 20_000):
            own = b.column(0).to_pylist() if known is None else _known_items(b.column(0), known)
            items = [[*i, CLASS + s] for i, s in zip(own, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in items if len(x) > 1], pa.list_(pa.string()))], ["items"])

    baskets = rows.select("items", "subject")
    if few > BROADCAST_TERMS:
        each = materialize(baskets.withColumn("row", F.monotonically_increasing_id()), "rule-rows").select("row", "subject", F.explode("items").alias("item"))
        baskets = each.join(chosen, "item").groupBy("row", "subject").agg(F.collect_list("item").alias("items")).select("items", "subject")
    baskets = baskets.mapInArrow(keep, "items array<string>")
    baskets = materialize(baskets, "rule-baskets")
    size = baskets.count()
    if not size:
        return []
    support = max(LEAST_COUNT / size, MIN_SUPPORT)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.2).fit(baskets)
    mined = model.associationRules.filter(F.col("consequent")[0].startswith(CLASS) & (F.size("antecedent") <= 3))
    out = []
    for r in mined.select("antecedent", "consequent", "confidence", (F.col("support") * size / F.col("confidence")).alias("n")).collect():
        left, subject = r["antecedent"], r["consequent"][0][1:]
        if any(x.startswith(CLASS) for x in left):
            continue
        c = (r["confidence"] * r["n"] + 2 * prior[subject] / total) / (r["n"] + 2)
        if c >= LEAST_LIFT * prior[subject] / total or c >= 0.5:
            out.append((tuple(sorted(left)), subject, c))
    return out


def lines_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, no, items) of every sentence of the documents, whole texts, written once; null ids and texts have none."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    # the documents may come from few files: spread them over all cores
    spark = documents.sparkSession
    texts = docs.repartition(max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")

    return materialize(texts.select("id", "text").mapInArrow(_lines, "id long, no int, items array<string>"), "rule-sentences")


def fit_rules(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None
) -> RuleModel:
    """Rules from about FIT_DOCUMENTS labelled documents at most and all others; ``lines``: the sentences of
    the documents if they are at hand (``lines_of``).

    First every sentence of a labelled document is held to be on each of its subjects. The rules so found
    give subjects to the documents without labels, in which rarer terms are found the same way, and
    then to each sentence; the rules are mined again from that, so that sentences on a second subject,
    passing mentions and wrong labels no longer weigh. One labelled document in five is kept out to choose
    the threshold, that of the best F1 of the documents' subjects. Labels are compared in plain spelling;
    labels of unknown documents or subjects don't count; without labels there are no rules."""
    lab = labels.select(F.col(id_col).cast("long").alias("id"), _plain("subject").alias("subject")).dropna().distinct()
    if subjects is not None:
        lab = lab.join(subjects.select(_plain("subject").alias("subject")).distinct(), "subject", "left_semi")
    lines = lines if lines is not None else lines_of(documents, id_col, text_col)
    ids = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).isNotNull().alias("some")).filter("id is not null and some").select("id")
    labelled = materialize(ids.join(lab.select("id").distinct(), "id", "left_semi").distinct(), "rule-labelled")
    known = materialize(bounded_sample(labelled, FIT_DOCUMENTS, "id"), "rule-ids")
    beyond = labelled.join(F.broadcast(known), "id", "left_anti")
    left_out = beyond.count()
    if left_out:
        lines = lines.join(F.broadcast(beyond) if left_out <= BROADCAST_IDS else beyond, "id", "left_anti")
    lab = materialize(lab.join(F.broadcast(known), "id", "left_semi"), "rule-labels")
    rough = RuleModel(prune(_mine(lines.join(lab, "id").select("id", "items", "subject"))), 0.4)

    def assigned(model: RuleModel) -> DataFrame:
        dumped = model.dumps()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = RuleModel.loads(dumped)
            known = m.known()
            for b in _slices(batches, 20_000):
                got = [m.subject(x) or "-" for x in _known_items(b.column(2), known)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.string())], ["id", "no", "items", "subject"])

        return materialize(lines.mapInArrow(assign, "id long, no int, items array<string>, subject string"), "rule-assigned")

    per = assigned(rough).groupBy("id", "subject").agg(F.count(F.lit(1)).alias("c"))
    share = per.join(per.groupBy("id").agg(F.sum("c").alias("t")), "id").filter((F.col("subject") != "-") & (F.col("c") >= LEAST_SHARE * F.col("t")))
    every = share.select("id", "subject").join(lab.select("id").distinct(), "id", "left_anti").unionByName(lab.select("id", "subject"))
    wide = RuleModel(prune(_mine(lines.join(every, "id").select("id", "items", "subject"))), 0.4)
    again = assigned(wide)
    held = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    rules = [r for r in prune(_mine(again.filter(~held).select("id", "items", "subject"))) if r[1] != "-"]
    model = RuleModel(rules, 0.5)
    tries = [x / 20 for x in range(6, 19)]
    dumped = model.dumps()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RuleModel.loads(dumped)
        terms_of = m.known()
        for b in _slices(batches, 20_000):
            best, value = [], []
            for e in map(m.evidence, _known_items(b.column(1), terms_of)):
                top = min(e, key=lambda s: (-e[s], s)) if e else None
                best.append(top)
                value.append(e[top] if e else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(value, pa.float64())], ["id", "best", "value"])

    own = lines.filter(held).join(F.broadcast(lab.select("id").distinct()), "id", "left_semi").select("id", "items").mapInArrow(weigh, "id long, best string, value double")
    per = own.groupBy("id", "best").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("value") >= x, 1)).alias(f"c{i}") for i, x in enumerate(tries)))
    w = Window.partitionBy("id")
    per = per.withColumn("all", F.sum("n").over(w)).filter("best is not null")
    truth = lab.filter(held).select("id", F.col("subject").alias("best"), F.lit(1).alias("true"))
    sums = []
    for i in range(len(tries)):  # the subjects of each document at each threshold: at most two rows of a window
        c = F.col(f"c{i}")
        rank = F.row_number().over(w.orderBy(c.desc(), "best"))
        sums.append(F.when((c > 0) & (rank <= MOST_SUBJECTS) & (c >= LEAST_SHARE * F.col("all")), 1).otherwise(0).alias(f"g{i}"))
    got = per.select("id", "best", *sums).join(F.broadcast(truth), ["id", "best"], "left")
    hits = got.agg(*(F.sum(F.col(f"g{i}") * F.coalesce("true", F.lit(0))).alias(f"a{i}") for i in range(len(tries))), *(F.sum(f"g{i}").alias(f"b{i}") for i in range(len(tries)))).first()
    # documents without any sentence have no part in the choice
    wanted = truth.join(F.broadcast(own.select("id").distinct()), "id", "left_semi").count()
    score = {x: (hits[f"a{i}"] or 0, hits[f"b{i}"] or 0, wanted) for i, x in enumerate(tries)}
    f1 = {x: 2 * a / (b + c) if b + c else 0.0 for x, (a, b, c) in score.items()}
    best = max(f1.values())
    good = [x for x in tries if f1[x] >= best - 0.005]
    model.threshold = good[len(good) // 2]
    return model


def classify(documents: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, subject, share) of the at most two subjects that a fifth or more of a document's sentences
    are on; whole texts, at any length. Null, empty and blank texts and texts without a sentence have
    none; equal shares are in order of name; repeated ids come out once per different result; other
    columns are ignored."""
    dumped = model.dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RuleModel.loads(dumped)
        for b in _slices(batches, 500):
            out = [(i, s, v) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, v in m.document(t)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["doc_id", "subject", "share"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id long, subject string, share double")


def classify_lines(lines: DataFrame, model: RuleModel) -> DataFrame:
    """The same from the sentences of the documents (``lines_of``); an id with several texts is one document with
    the sentences of all."""
    dumped = model.dumps()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RuleModel.loads(dumped)
        known = m.known()
        for b in _slices(batches, 20_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.subject(x) for x in _known_items(b.column(1), known)], pa.string())], ["doc_id", "subject"])

    per = lines.select("id", "items").mapInArrow(run, "doc_id long, subject string").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("doc_id")  # at most one row per subject
    per = per.withColumn("share", F.col("n") / F.sum("n").over(own)).filter(F.col("subject").isNotNull() & (F.col("share") >= LEAST_SHARE - 1e-9))
    return per.withColumn("rn", F.row_number().over(own.orderBy(F.col("share").desc(), "subject"))).filter(F.col("rn") <= MOST_SUBJECTS).select("doc_id", "subject", "share")


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, part) of the corpus: how many documents have each subject, and their part of all."""
    total = documents.select(F.count(F.lit(1)).alias("all"))
    per = found.select("doc_id", "subject").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return per.join(total, how="cross").select("subject", "documents", (F.col("documents") / F.col("all")).alias("part"))
