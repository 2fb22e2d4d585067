"""Personal data: base patterns, then contextual extraction bootstrapped from what they find.

Base spans come from one linear pass per kind over the whole text. They are the seeds. What stands around a span forms
its lexical patterns: two words before, two after, one on each side (a punctuation mark is a word, digits are all
alike). Candidates are the identifier-like strings outside base spans: runs with a digit or an inner ``@``, and
digit groups joined by space, parenthesis, dot or hyphen, of any length. Spark holds the pattern-instance pairs of all
documents as one table and works on it in rounds:

* a pattern's confidence in a kind is the sum of its known instances' scores over all its different instances; it is
  promoted from ``min_confidence`` on with ``min_support`` different known ones;
* an unknown instance in a promoted pattern, if its form could be of that kind, becomes known with the pattern's
  confidence as its score (the best one, then the first kind); seeds count as 1 and keep their kind.

So what one round finds votes for further patterns in the next, damped by its score, until a round finds nothing.
Scores are whole millionths, so sums do not depend on their order. Candidates in promoted patterns are the spans
the method adds. Up to ``broadcast_patterns`` patterns are sent to the executors, more are joined with the candidates;
the result is the same. Statistics cover every document.

Null texts count as empty; such rows have no spans. Repeated rows are reported each, and copies count once as
instances. Null ids are ids like others. Very long texts and words cost time in proportion. Empty tables give no
rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, text_slices

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that each runs in linear time: a run is entered at its start and never given back.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates: runs of what identifiers are made of, the numbers among them, and what may stand between two digit groups.
RUN = re.compile(r"[A-Za-z0-9@._%+/:-]++")
NUMBER = re.compile(r"\+?[0-9]++(?:[.-]++[0-9]++)*+")
BETWEEN = re.compile(r"[ ().-]{1,3}")
EDGE = "@._%/:-"
HEX = re.compile(r"[0-9A-Fa-f:.]++")
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
WHOLE = 1_000_000
MIN_SUPPORT, MIN_CONFIDENCE, BROADCAST_PATTERNS = 3, 0.8, 100_000
EDGES = pa.schema([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("fits", pa.int32()), ("open", pa.bool_())])
CANDIDATES = pa.schema([("key", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("fits", pa.int32()), ("pattern", pa.string())])
#: Kind and confidence of each promoted pattern.
Promoted = dict[str, tuple[int, int]]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind, in code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        after = 0
        for m in EMAIL_HOST.finditer(text):
            start = m.start()
            while start > after and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found["email"].append((start, m.end()))
                after = m.end()
    if not DIGIT.search(text):
        return found
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _join(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def candidates(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Identifier-like spans of ``text[low:high]``, in order and without overlap."""
    number: tuple[int, int] | None = None

    def closed(span: tuple[int, int]) -> tuple[int, int]:
        a, b = span
        opened = text.rfind("(", a, b) > text.rfind(")", a, b)
        return (a, b + 1) if opened and b < high and text[b] == ")" else span

    for m in RUN.finditer(text, low, high):
        a, b = m.span()
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and (text[b - 1] in EDGE or text[b - 1] == "+"):
            b -= 1
        if a == b:
            continue
        if NUMBER.fullmatch(text, a, b):
            if number and a - number[1] <= 3 and BETWEEN.fullmatch(text, number[1], a):
                number = number[0], b
                continue
            if number:
                yield closed(number)
            number = (a - 1 if a > low and text[a - 1] == "(" else a), b
            continue
        if number:
            yield closed(number)
            number = None
        if DIGIT.search(text, a, b) or "@" in text[a:b]:
            yield a, b
    if number:
        yield closed(number)


def occurrences(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
    """Base spans (start, end, kind) and the candidates between them (kind -1)."""
    taken = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    yield from taken
    if not taken and "@" not in text and not DIGIT.search(text):
        return
    at = 0
    for a, b, _ in taken:
        if a > at:
            yield from ((x, y, -1) for x, y in candidates(text, at, a))
        at = max(at, b)
    yield from ((x, y, -1) for x, y in candidates(text, at, len(text)))


def _words(text: str, at: int, step: int) -> list[str]:
    """The two words that end before (step -1) or start after (step 1) ``at``, nearest first; fewer at the text's ends."""
    reach = 48
    while True:
        low, high = (max(0, at - reach), at) if step < 0 else (at, min(len(text), at + reach))
        found = WORD.findall(text, low, high)
        whole = low == 0 if step < 0 else high == len(text)
        if len(found) > 2 or whole:  # the third may be cut, the nearest two are not
            near = found[:-3:-1] if step < 0 else found[:2]
            return [re.sub(r"[0-9]+", "0", w.lower()) for w in near]
        reach *= 2


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands around a span: two words before, one on each side, two after. Long ones go by their digest."""
    left, right = ([*_words(text, at, step), "", ""] for at, step in ((start, -1), (end, 1)))
    named = (f"L {left[1]} {left[0]}", f"B {left[0]} {right[0]}", f"R {right[0]} {right[1]}")
    return [p if len(p) <= 80 else f"{p[0]}#{hashlib.blake2b(p.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}" for p in named]


def _digits(value: str) -> str | None:
    """The digits of a number in groups; null for anything else, and for four parts with dots."""
    if value.count(".") >= 3 or not re.fullmatch(r"[0-9 ().+-]+", value):
        return None
    return re.sub(r"[^0-9]", "", value)


def identity(value: str) -> str:
    """Names an instance: a number by its digits however they are grouped, anything else by its lower-cased text."""
    return hashlib.blake2b((_digits(value) or value.lower()).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def forms(value: str) -> int:
    """The kinds whose form ``value`` could be, as bits by their place in ``KINDS``."""
    digits = _digits(value)
    if digits is not None:
        return (4 if 12 <= len(digits) <= 19 else 0) | (8 if 7 <= len(digits) <= 15 else 0)
    name, mark, host = value.rpartition("@")
    if mark:
        return 1 if name and host else 0
    return 2 if HEX.fullmatch(value) and (value.count(".") >= 3 or value.count(":") >= 2) else 0


def pattern_instances(docs: DataFrame) -> DataFrame:
    """The graph, each pair once: ``pattern, instance``, the base ``kind`` (-1: none), the forms it ``fits``, and whether it is ``open``, that is, somewhere outside base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows: dict[tuple[str, str], tuple[int, int, bool]] = {}
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for a, b, kind in occurrences(text, base_spans(text)):
                    instance, fits = identity(text[a:b]), 0 if kind >= 0 else forms(text[a:b])
                    for p in patterns(text, a, b):
                        k, f, o = rows.get((p, instance), (-1, 0, False))
                        rows[p, instance] = max(k, kind), f | fits, o or kind < 0
            columns = [*zip(*((*key, *value) for key, value in rows.items()))] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EDGES)], schema=EDGES)

    found = docs.select("text").mapInArrow(run, "pattern string, instance string, kind int, fits int, open boolean")
    return found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.bit_or("fits").alias("fits"), F.max("open").alias("open"))


def bootstrap(docs: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pattern, for_kind, confidence`` (millionths) of every promoted pattern in which candidates of its kind's form stand."""
    if min_confidence <= 0.5:
        raise ValueError("from a confidence of one half on a pattern could be promoted for two kinds")
    least = int(min_confidence * WHOLE)
    pairs = checkpoint(pattern_instances(docs))
    known = checkpoint(pairs.where("kind >= 0").groupBy("instance").agg(F.min("kind").alias("for_kind")).withColumn("score", F.lit(WHOLE).cast("long")))
    # A pattern of fewer instances than the support can never be promoted: most of them.
    sizes = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_support)
    graph = checkpoint(pairs.join(sizes, "pattern"))
    fits = F.expr("(fits & shiftleft(1, for_kind)) != 0")
    while True:
        votes = graph.join(known, "instance").groupBy("pattern", "for_kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support"), F.first("size").alias("size"))
        good = votes.where(F.col("support") >= min_support).select("pattern", "for_kind", F.expr("mass div size").alias("confidence")).where(F.col("confidence") >= least)
        good = checkpoint(good)  # several uses
        unknown = graph.join(known, "instance", "left_anti").join(good, "pattern").where(fits)
        best = F.max(F.struct(F.col("confidence"), (-F.col("for_kind")).alias("first"))).alias("best")
        found = checkpoint(unknown.groupBy("instance").agg(best).select("instance", (-F.col("best.first")).cast("int").alias("for_kind"), F.col("best.confidence").alias("score")))
        if found.isEmpty():
            break
        known = checkpoint(known.unionByName(found))
    return checkpoint(graph.where("open").join(good, "pattern").where(fits).select("pattern", "for_kind", "confidence").distinct())


def _hit(fits: int, own: list[str], promoted: Promoted) -> int | None:
    """The kind that the most confident of a candidate's promoted patterns gives it; ties: the first kind."""
    hits = [(-c, k) for p in own if p in promoted for k, c in (promoted[p],) if fits >> k & 1]
    return min(hits)[1] if hits else None


def _added(docs: DataFrame, promoted: DataFrame) -> DataFrame:
    """``docs`` with ``__added``: the spans that a table of promoted patterns adds to each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows = []
            for key, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                for a, b, kind in occurrences(text, base_spans(text)):
                    if kind < 0 and (fits := forms(text[a:b])):
                        rows += [(key, a, b, fits, p) for p in patterns(text, a, b)]
            columns = [*zip(*rows)] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CANDIDATES)], schema=CANDIDATES)

    # Spans follow from the text, so its digest names them whatever the ids are.
    keyed = docs.withColumn("__key", F.sha2("text", 256))
    met = keyed.where(F.col("text").isNotNull()).select("__key", "text").mapInArrow(run, "key string, a long, b long, fits int, pattern string")
    hits = met.join(promoted, "pattern").where(F.expr("(fits & shiftleft(1, for_kind)) != 0"))
    best = F.max(F.struct("confidence", (-F.col("for_kind")).alias("first"))).alias("best")
    spans = hits.groupBy("key", "a", "b").agg(best).groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct((-F.col("best.first")).alias("kind"), "a", "b")).alias("__added"))
    return keyed.join(spans, "__key", "left").select(*(docs[c] for c in docs.columns), "__added")


def all_spans(text: str, promoted: Promoted) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans: these and what promoted patterns add outside them."""
    base = base_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    if promoted:
        for a, b, kind in occurrences(text, base):
            if kind < 0 and (fits := forms(text[a:b])) and (k := _hit(fits, patterns(text, a, b), promoted)) is not None:
                spans.append((KINDS[k], a, b))
    return base, spans


class _Applied:
    """Promoted patterns where their number is known to be small, else a table that is joined."""

    def __init__(self, docs: DataFrame, promoted: DataFrame, few: int):
        self.joined = promoted.count() > few
        rows = [] if self.joined else promoted.collect()  # at most ``few``
        self.shared = docs.sparkSession.sparkContext.broadcast({r["pattern"]: (r["for_kind"], r["confidence"]) for r in rows})
        self.docs = _added(docs, promoted) if self.joined else docs


def _more(batch: pa.RecordBatch, joined: bool) -> list[list[tuple[str, int, int]]]:
    """The spans that ``_added`` joined to each row."""
    if not joined:
        return [[]] * batch.num_rows
    return [[(KINDS[m["kind"]], m["a"], m["b"]) for m in row or []] for row in batch.column(batch.schema.get_field_index("__added")).to_pylist()]


def find(docs: DataFrame, promoted: DataFrame | None = None, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every whole text; the counts are of base spans."""
    rows = docs.select("doc_id", "text")
    use = _Applied(rows, bootstrap(docs) if promoted is None else promoted, broadcast_patterns)
    shared, joined = use.shared, use.joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            base, spans = [], []
            for text, more in zip(batch.column(1).to_pylist(), _more(batch, joined)):
                b, s = all_spans(text or "", shared.value)
                base.append(b)
                spans.append(s + more)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(_join([(k, *s) for k in KINDS for s in b[k]]).encode()).hexdigest() for b in base]),
                    pa.array([_join(s) for s in spans], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return use.docs.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def mask(docs: DataFrame, promoted: DataFrame | None = None, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """The same rows and columns, each span in ``text`` replaced by its kind in angle brackets; null texts stay null."""
    use = _Applied(docs, bootstrap(docs) if promoted is None else promoted, broadcast_patterns)
    shared, joined, names, at = use.shared, use.joined, docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out = [None if t is None else _masked(t, all_spans(t, shared.value)[1] + more) for t, more in zip(batch.column(at).to_pylist(), _more(batch, joined))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(names)

    return use.docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
