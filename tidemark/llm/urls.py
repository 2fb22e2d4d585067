"""URL filter: longest-match rules, and for what they leave naive Bayes over the words of host and path.

Hosts run words together. A unigram model splits them: words of letters in any script are counted over the visible
text of all pages, and Viterbi finds the likeliest split of every run of letters in a host. No word list is kept or
sent anywhere: the distinct runs of all hosts give the strings that could be words in them, these are joined with the
counts, and each run is split from what it met. A run of more than 63 letters is no host label and stays one word.

The rules label urls: each one that a rule fits is an example of the rule's verdict. On all of these a multinomial
naive Bayes is fitted over host words and path words, hashed into ``2 ** bits`` buckets, which bounds the model; it
judges the urls that no rule fits, and so carries the rules over to the words that keep their company.

A rule fits its host and all subdomains if the path starts with the rule's path; of those that fit the longest wins
(ties: the first in order). Null urls and urls without ``://`` have empty host and path and no words; such urls, and
all without a rule if no url is labelled, are allowed. A score of exactly 0 allows. Rows are independent: repeats and
null ids do not matter; null pages have no words; very long urls and pages cost time in proportion; further columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, text_slices

BITS, SMOOTH = 18, 0.5
LABEL_LENGTH = 63
#: Added to the number of all words, so that splitting into unknown letters never pays.
LEAST_TOTAL = 100
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LETTERS = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[^\W\d_]+|[0-9]+")
#: What opens markup, and what ends the elements whose content is not shown.
MARKUP = re.compile(r"<(?:!--|(script|style)(?![A-Za-z0-9-])|[A-Za-z/!?])", re.IGNORECASE)
CLOSES = {"script": re.compile(r"</script", re.IGNORECASE), "style": re.compile(r"</style", re.IGNORECASE)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


class Rules:
    """Verdicts by host suffix and path prefix. A rule is (verdict, "host/path")."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self.labels = max((host.count(".") + 1 for host in self.by_host), default=0)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best = None
        labels = host.rsplit(".", self.labels)
        if host.count(".") >= self.labels:
            labels = labels[1:]  # longer than any rule's host
        for i in range(len(labels)):
            for prefix, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(prefix) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = rule, verdict
        return best


def visible(page: str) -> str:
    """A page's text without markup, scripts and styles, in one scan; what is opened and never closed hides the rest."""
    out, at = [], 0
    while m := MARKUP.search(page, at):
        out.append(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        end = m.end()
        if m[1]:
            closing = CLOSES[m[1].lower()].search(page, end)
            end = closing.end() if closing else len(page)
        end = page.find(">", end)
        at = end + 1 if end >= 0 else len(page)
    out.append(page[at:])
    return html.unescape(" ".join(out))


def count_words(pages: DataFrame) -> DataFrame:
    """``word, n``: the words of all pages' visible text, lower-cased. Longer ones than a host label cannot occur in it and are summed under null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            held: Counter = Counter()
            for page in batch.column(0).to_pylist():
                held.update(w if len(w) <= LABEL_LENGTH else None for w in LETTERS.findall(visible(page or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split(piece: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run of letters. A known word has its share of all words; an unknown one of n letters ten in ``total`` by ten to the n. Ties: the longest last word."""
    least, last = [0.0], [0]
    for end in range(1, len(piece) + 1):
        options = []
        for start in range(end):
            n = known.get(piece[start:end])
            options.append((least[start] + (math.log(total / n) if n else math.log(total) + (end - start - 1) * math.log(10)), start))
        cost, start = min(options)
        least.append(cost)
        last.append(start)
    words, end = [], len(piece)
    while end:
        words.append(piece[last[end] : end])
        end = last[end]
    return words[::-1]


def words_of(text: str) -> list[str]:
    """Runs of letters in any script as they are, runs of digits as ``#``."""
    return ["#" if "0" <= w[0] <= "9" else w for w in PIECE.findall(text)]


def host_words(hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, words``: the split words of each distinct host, in order."""
    counts = checkpoint(count_words(pages))
    total = (counts.agg(F.sum("n")).first()[0] or 0) + LEAST_TOTAL

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words_of(host) for host in batch.column(0).to_pylist()]
            sizes = [len(f) for f in found]
            row = np.repeat(np.arange(len(found)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if found else row
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array([w for f in found for w in f], pa.string())], names=["host", "at", "piece"])

    placed = checkpoint(hosts.mapInArrow(cut, "host string, at long, piece string"))
    pieces = placed.select("piece").distinct().where((F.col("piece") != "#") & (F.length("piece") <= LABEL_LENGTH))
    # Every string inside a piece: at most 63 x 64 / 2.
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("start"))
    inside = starts.select("piece", F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - F.col("start") + 1), lambda n: F.substring("piece", F.col("start"), n))).alias("word")).distinct()
    met = inside.join(counts.where("word is not null"), "word").groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("met"))

    def likeliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [split(p, {m["word"]: m["n"] for m in known or ()}, total) for p, known in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], names=["piece", "own"])

    known = pieces.join(met, "piece", "left").mapInArrow(likeliest, "piece string, own array<string>")
    words = placed.join(known, "piece", "left").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("own", F.array("piece")).alias("own")))).alias("all"))
    return words.select("host", F.flatten(F.transform("all", lambda x: x["own"])).alias("words"))


def bucket(where: str, word: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(f"{where}:{word}".encode("utf-8", "surrogatepass")) >> (64 - bits)


def buckets(words: list[str] | None, path: str, bits: int) -> np.ndarray:
    """Buckets of a url's words, host first."""
    return np.array([bucket("h", w, bits) for w in words or ()] + [bucket("p", w, bits) for w in words_of(path.lower())], dtype=np.int64)


class Classifier:
    """Multinomial naive Bayes, block against allow: log-odds of every bucket, and prior log-odds."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int], smooth: float = SMOOTH):
        self.labelled = bool(sum(rows.values()))
        self.prior = math.log((rows.get("block", 0) + smooth) / (rows.get("allow", 0) + smooth))
        size = int(np.count_nonzero(counts["block"] + counts["allow"])) + 1
        share = {c: (counts[c] + smooth) / (counts[c].sum() + smooth * size) for c in ("block", "allow")}
        self.weights = np.log(share["block"]) - np.log(share["allow"])
        self.weights[(counts["block"] + counts["allow"]) == 0] = 0.0  # words no example has tell nothing

    def score(self, own: np.ndarray) -> float:
        """Log-odds of block."""
        return self.prior + math.fsum(self.weights[own].tolist()) if self.labelled else -math.inf


def train(urls: DataFrame, bits: int = BITS) -> Classifier:
    """Fit on every url that a rule fits; ``urls`` holds ``path, words, rule, verdict``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        rows: Counter = Counter()
        for batch in batches:
            for path, words, verdict in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows[verdict] += 1
                np.add.at(seen.setdefault(verdict, np.zeros(1 << bits, dtype=np.int64)), buckets(words, path, bits), 1)
        for verdict, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([verdict] * (len(at) + 1)), pa.array([-1, *at.tolist()], pa.int64()), pa.array([rows[verdict], *counts[at].tolist()], pa.int64())], names=["verdict", "bucket", "n"])

    counted = urls.where("rule is not null").select("path", "words", "verdict").mapInArrow(run, "verdict string, bucket long, n long").groupBy("verdict", "bucket").agg(F.sum("n").alias("n"))
    counts, rows = {c: np.zeros(1 << bits, dtype=np.int64) for c in ("block", "allow")}, {}
    for r in counted.collect():  # at most two rows a bucket
        if r["bucket"] < 0:
            rows[r["verdict"]] = r["n"]
        else:
            counts[r["verdict"]][r["bucket"]] = r["n"]
    return Classifier(counts, rows)


def with_words(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` (of the rule) and the host's ``words``."""
    shared = pages.sparkSession.sparkContext.broadcast(Rules(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                rows.append((host, path, *((shared.value.match(host, path) if host else None) or (None, None))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    urls = checkpoint(pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string"))
    hosts = urls.select("host").where("host != ''").distinct()
    return checkpoint(urls.join(host_words(hosts, pages), "host", "left"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], bits: int = BITS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every url; score is the classifier's log-odds of block."""
    urls = with_words(pages, rules)
    shared = pages.sparkSession.sparkContext.broadcast(train(urls, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = shared.value
        for batch in batches:
            verdicts, scores = [], []
            for host, path, words, verdict in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path", "words", "verdict"))):
                score = classifier.score(buckets(words, path, bits)) if host or path else -math.inf
                verdicts.append(verdict or ("block" if score > 0 else "allow"))
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
