"""URL filter: rules for hosts and paths, and a classifier of segmented names for the rest.

Concatenated names in host and path are cut into words by a unigram model with Viterbi's
algorithm; the model's words and their ranks are those of a public vocabulary. Multinomial
naive Bayes scores the words of host and path. It is trained on a lexicon of words that speak
for either class, in hosts and in paths, and on a bounded sample of the table's addresses,
labelled by that lexicon, which teaches it what all addresses have in common.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample

#: (host, path, verdict): the rules of the query.
RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)
#: More rules than this don't belong in a closure.
MOST_RULES = 1_000_000
#: Addresses that the classifier is trained on, at most: those with the smallest hashes.
SAMPLE = 5_000
#: Words of an address that speak for either class.
BLOCK_WORDS = (
    "casino poker bet bets betting gambling slots slot jackpot lottery roulette bingo win winner pills pill pharmacy viagra cialis drugs meds "
    "cheap xxx adult porn porno sex sexy escort escorts cams webcam nude erotic dating spam farm malware phishing hack hacks crack cracked "
    "warez keygen torrent torrents pirate ads ad adserver track tracker tracking clicks banner popunder loan loans payday replica fake free deal"
).split()
ALLOW_WORDS = (
    "news blog shop store library school university college docs wiki forum health travel weather science music film book books recipes kitchen "
    "city museum research photo garden sport history law journal press review home house car bike family art studio design tech code data maps "
    "mail cloud help support about community church local nature animal animals language learn education math"
).split()
_PIECE = re.compile(r"[a-z]+|[0-9]+")
LONGEST_WORD = 24


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Segmenter:
    """Unigram Viterbi over one run of letters."""

    def __init__(self, costs: dict[str, float], unknown: float):
        self.costs, self.unknown = costs, unknown
        self.known: dict[str, tuple[str, ...]] = {}

    @classmethod
    def from_vocabulary(cls, path: str, words: tuple[str, ...] = (*BLOCK_WORDS, *ALLOW_WORDS)) -> Segmenter:
        """Words that end in ``</w>`` by rank: the nth costs -log of a share of 1 / (n + 100). ``words`` cost as the 500th at most."""
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranked = sorted((i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha())
        ranked = [(i, t) for i, t in ranked if len(t) > 2 or t in ("a", "i", "of", "to", "in", "on", "at", "by", "my", "we", "us", "up", "go", "no", "it", "is", "ad")]
        norm = math.log(sum(1 / (n + 100) for n in range(len(ranked))))
        costs = {t: math.log(n + 100) + norm for n, (_, t) in enumerate(ranked)}
        for w in words:
            costs[w] = min(costs.get(w, math.inf), math.log(600) + norm)
        return cls(costs, math.log(len(ranked) + 100) + norm)

    def __call__(self, name: str) -> tuple[str, ...]:
        if name in self.known:
            return self.known[name]
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST_WORD), j):
                word = name[i:j]
                # a run of letters that is no word costs as a rare one and more for every letter
                cost = best[i] + self.costs.get(word, self.unknown + 2.5 * (j - i))
                if cost < best[j]:
                    best[j], back[j] = cost, i
        out, j = [], n
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[name] = tuple(reversed(out))
        return self.known[name]


def tokens(host: str, path: str, cut: Segmenter) -> list[str]:
    """Words of the host, ``h:``, but for its last label, and of the path, ``p:``; numbers are one token."""
    out = []
    for mark, text in (("h:", host.rpartition(".")[0] or host), ("p:", path.lower())):
        for piece in _PIECE.findall(text):
            out += [mark + "0"] if piece[0].isdigit() else [mark + w for w in cut(piece)]
    return out


@dataclass
class Bayes:
    """Log odds of each token for block, of an unseen one, and before any token."""

    odds: dict[str, float] = field(default_factory=dict)
    unseen: float = 0.0
    prior: float = 0.0

    @classmethod
    def train(cls, labelled: list[tuple[list[str], bool]], prior: float = 0.1, smooth: float = 0.5) -> Bayes:
        counts = {True: Counter(), False: Counter()}
        for words, block in labelled:
            counts[block].update(words)
        vocabulary = {*counts[True], *counts[False]}
        whole = {y: sum(c.values()) + smooth * (len(vocabulary) + 1) for y, c in counts.items()}
        p = lambda w, y: (counts[y][w] + smooth) / whole[y]
        odds = {w: math.log(p(w, True) / p(w, False)) for w in vocabulary}
        return cls(odds, 0.0, math.log(prior / (1 - prior)))

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, self.unseen) for w in words)


def fit(pages: DataFrame, vocabulary: str, sample: int = SAMPLE) -> Bayes:
    """Naive Bayes on the lexicon and on at most ``sample`` addresses, labelled by it."""
    cut = Segmenter.from_vocabulary(vocabulary)
    block = {f"{mark}:{w}" for w in BLOCK_WORDS for mark in "hp"}
    urls = pages.select("url").where(F.col("url").isNotNull())
    rows = bounded_sample(urls, ["url"], sample, urls.count())
    rows = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).collect()
    seen = [tokens(r["host"], r["path"], cut) for r in rows]
    labelled = [(words, any(w in block for w in words)) for words in seen]
    # words of the lexicon in addresses of their own, with the sample's other half in turn: what all have in common speaks for neither
    halves = {mark: [[w for w in words if w.startswith(mark)] for words in seen] or [[]] for mark in ("h:", "p:")}
    lexicon = [(w, y, mark) for words, y in ((BLOCK_WORDS, True), (ALLOW_WORDS, False)) for w in words for mark in ("h:", "p:") for _ in range(5)]
    for k, (w, y, mark) in enumerate(lexicon):
        other = halves["p:" if mark == "h:" else "h:"]
        labelled.append(([mark + w, *(x for x in other[k % len(other)] if x not in block)], y))
    return Bayes.train(labelled)


def matching(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule, as written, that fits the host or one above it, and the start of the path; and its verdict."""
    best = None
    at = host
    while at:
        for start, verdict in rules.get(at, ()):
            if path.startswith(start) and (best is None or len(at) + len(start) > len(best[0])):
                best = (at + start, verdict)
        at = at.partition(".")[2]
    return best


def judge(pages: DataFrame, vocabulary: str, rules: tuple[tuple[str, str, str], ...] = RULES, model: Bayes | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of each row of ``page_id, url``.

    A rule's verdict holds; else an address is blocked whose log odds are above 0. A null
    address, or one without ``://``, has neither host nor path and is allowed. Repeated rows
    each give a row; an empty table gives an empty table.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    bounded_batches(pages.sparkSession)
    model = fit(pages, vocabulary) if model is None else model
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, start, verdict in rules:
        by_host.setdefault(host, []).append((start, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter.from_vocabulary(vocabulary)
        for b in batches:
            hosts, paths, found = b.column(1).to_pylist(), b.column(2).to_pylist(), []
            for host, path in zip(hosts, paths, strict=True):
                rule = matching(host, path, by_host)
                score = model.score(tokens(host, path, cut)) if host or path else model.prior
                found.append((rule[0] if rule else None, rule[1] if rule else "block" if score > 0 else "allow", score))
            more = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *more], ["page_id", "host", "path", "rule", "verdict", "score"])

    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
