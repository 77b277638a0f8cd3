"""Quality rules: counts of words, signs and repeats, and what public vocabularies make of a text.

A vocabulary that was made on real text spends few tokens on text like it. Of a vocabulary
with byte fallback come the share of tokens that are bytes it has no piece for, and wide
bounds for characters per token and for the entropy of the tokens, relative to the most that
so many tokens could have. Of a vocabulary for many languages come close bounds for the
same two measures. Each has a band for the document's language, or else for the script that
most of its letters are of; a document outside a band is rejected. In a text of few words
one number or address moves the measures, so there only the wide bounds hold.

One pass over the texts, no shuffle: a document's verdict depends on that document alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing
from .common import bounded_batches
from .words import Words

#: The file of a sentencepiece model with byte fallback, a file of ranks, and the pattern that goes with that.
Vocabularies = tuple[str, str, str]


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most share of bytes and least relative entropy; and the leasts by the second vocabulary."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    close_chars: float = 0.0
    close_entropy: float = 0.0

    def fits(self, n_words: int, first: tuple[float, float, float], second: tuple[float, float]) -> bool:
        chars, share, entropy = first
        wide = self.least_chars <= chars <= self.most_chars and share <= self.most_bytes and entropy >= self.least_entropy
        return wide and (n_words < FEW_WORDS or second[0] >= self.close_chars and second[1] >= self.close_entropy)


#: Texts of fewer words have the wide bounds only.
FEW_WORDS = 30


#: By language, else by script. Languages that a vocabulary knows well have few bytes; a script
#: that it has few pieces for is written in bytes by rule, and only its extremes are rejected.
#: The close bounds of en, de, fr and es are the 0.5th percentile, rounded down, over the
#: documents of the sf0.1 table that are labelled good, pass the base rules and have FEW_WORDS
#: words or more. Its prose is invented and real prose has more characters a token, so no most
#: is drawn from it.
BANDS: dict[str, Band] = {
    "en": Band(1.3, 8.0, 0.10, 0.5, 2.10, 0.772),
    "de": Band(1.3, 8.0, 0.10, 0.5, 2.17, 0.762),
    "fr": Band(1.3, 8.0, 0.10, 0.5, 1.88, 0.759),
    "es": Band(1.3, 8.0, 0.10, 0.5, 1.93, 0.752),
    "latin": Band(1.2, 8.0, 0.25, 0.45, 1.60, 0.55),
    "greek": Band(0.7, 6.0, 0.60, 0.4),
    "cyrillic": Band(1.0, 7.0, 0.40, 0.4),
    "hebrew": Band(0.5, 5.0, 0.90, 0.35),
    "arabic": Band(0.5, 5.0, 0.90, 0.35),
    "indic": Band(0.3, 5.0, 1.00, 0.3),
    "kana": Band(0.3, 4.0, 0.90, 0.35),
    "han": Band(0.3, 4.0, 0.90, 0.35),
    "hangul": Band(0.3, 4.0, 0.95, 0.35),
    "other": Band(0.2, 10.0, 1.00, 0.3),
}
#: Scripts by the first byte of their letters in UTF-8: first and last byte, both included.
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC3, 0xC9), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4),
    ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED),
)
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
_SCRIPT = np.full(256, len(NAMES), np.int64)
for _s, _lo, _hi in SCRIPTS:
    _SCRIPT[_lo : _hi + 1] = NAMES.index(_s)
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
#: Tokens beyond this many add no more to the entropy that is expected.
ENTROPY_TOKENS = 256
_START = np.array([-1])

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, close_chars_per_token double, close_entropy double, band string"
)


def repeated_words(shingles: np.ndarray, n_words: int, size: int) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    if n_words < size:
        return 0
    order = np.sort(shingles)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(shingles, twice))
    cover = np.zeros(n_words + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + size, n_words), -1)
    return int((np.cumsum(cover)[:n_words] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def fertility(ids: np.ndarray, chars: int, first_byte: int = -1, last_byte: int = -1) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, entropy relative to the most possible."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    order = np.sort(ids)
    cuts = np.flatnonzero(order[1:] != order[:-1])
    counts = np.diff(np.concatenate([_START, cuts, [n - 1]]))
    entropy = 1.0
    if n > 1:
        entropy = (np.log2(n) - float((counts * np.log2(counts)).sum()) / n) / np.log2(min(n, ENTROPY_TOKENS))
    lo, hi = np.searchsorted(order, [first_byte, last_byte + 1]) if last_byte >= 0 else (0, 0)
    return chars / n, float(hi - lo) / n, float(entropy)


class Judge:
    """All measures and the verdict for a batch of texts and languages."""

    def __init__(self, vocabularies: Vocabularies, least_words: int, most_repeated: int, bands: dict[str, Band]):
        self.both = tokenizing.vocabularies(*vocabularies)
        model = self.both.model
        byte = [i for i in range(model.get_piece_size()) if model.is_byte(i)] or [-1]
        self.first_byte, self.last_byte = byte[0], byte[-1]
        self.least_words, self.most_repeated, self.bands = least_words, most_repeated, bands

    def __call__(self, texts: pa.Array, langs: list[str | None]) -> list[tuple]:
        words = Words(texts)
        data, at = words.data, words.offsets
        sums = [np.concatenate([[0], np.cumsum(m)])[at] for m in (((data & 0xC0) != 0x80) & words.solid, _SIGN[data])]
        chars, signs = np.diff(sums[0]).tolist(), np.diff(sums[1]).tolist()
        shingles, first = words.shingles(5, False)
        rows = []
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            text, n = text.as_py() or "", int(words.counts[i])
            again = repeated_words(shingles[first[i] : first[i + 1]], n, 5)
            failed = n < self.least_words or 100 * again > self.most_repeated * n
            ids, pairs = (np.frombuffer(x, "<u4") for x in self.both.ids(text))
            wide = fertility(ids, chars[i], self.first_byte, self.last_byte)
            close = fertility(pairs, chars[i])[::2]
            name = lang
            if name not in self.bands:
                seen = np.bincount(_SCRIPT[data[at[i] : at[i + 1]]], minlength=len(NAMES) + 1)[: len(NAMES)]
                name = NAMES[int(seen.argmax())] if seen.any() else "other"
            x = self.bands.get(name) or self.bands["other"]
            fits = x.fits(n, wide, close)
            rows.append((n, chars[i], signs[i], duplicate_lines(text), again, failed, fits and not failed, len(ids), *wide, *close, name))
        return rows


def measure(docs: DataFrame, vocabularies: Vocabularies, *, least_words: int = 10, most_repeated: int = 20, bands: dict[str, Band] | None = None) -> DataFrame:
    """``doc_id`` with all measures and the verdict of each row of ``doc_id, text, lang``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` percent of
    them in repeated windows. ``vocabularies``: see above. A null text has no words and fails. A language without a band,
    or null, goes by script. Every row gives a row, repeated ones too; whole texts count.
    An empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    bands = BANDS if bands is None else bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(vocabularies, least_words, most_repeated, bands)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 5 + [pa.string()]
        names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
        for b in batches:
            rows = judge(b.column(1), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names)

    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, " + SCHEMA)


def keep_good(docs: DataFrame, vocabularies: Vocabularies, *, least_words: int = 10, most_repeated: int = 20, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: one scan, nothing shuffled or joined.

    As in ``measure``: a null or empty text fails, a null language goes by script, rows that
    repeat pass or fail alike, an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    bands = BANDS if bands is None else bands
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(vocabularies, least_words, most_repeated, bands)
        for b in batches:
            yield b.filter(pa.array([r[6] for r in judge(b.column(text), b.column(lang).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
