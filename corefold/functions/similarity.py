"""String similarity: expressions where Spark has the functions, one Arrow kernel for the rest.

A name or address similarity is 0 where either side is empty and 1 where both are equal and not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

KERNELS = ("jw", "sort", "set", "partial")
KERNEL_TYPE = StructType([StructField(k, DoubleType()) for k in KERNELS])


def guarded(a: Column, b: Column, value: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def levenshtein(a: Column, b: Column) -> Column:
    return guarded(a, b, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro's similarity, raised for up to four equal first signs where it is over 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    reach = max(max(la, lb) // 2 - 1, 0)
    where, free, at, mine = _places(b).get, -1, [], []
    window, ahead = (1 << reach) - 1, 1 << reach
    for c in a:  # the window moves on by one; the first free place in it is its lowest bit
        window = window | ahead
        if hit := where(c, 0) & free & window:
            hit &= -hit
            free ^= hit
            at.append(hit.bit_length() - 1)
            mine.append(c)
        ahead <<= 1
        if ahead >> (2 * reach + 1):
            window &= ~(ahead >> (2 * reach + 1))
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(mine, sorted(at), strict=True)) // 2
    s = (m / la + m / lb + (m - swaps) / m) / 3
    if s > 0.7:
        p = 0
        while p < min(4, la, lb) and a[p] == b[p]:
            p += 1
        s += 0.1 * p * (1 - s)
    return s


@lru_cache(1 << 12)
def _places(s: str) -> dict[str, int]:
    """For each sign the places where it stands, as bits. A query meets hundreds of candidates, so these are kept."""
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, all places of ``a`` at a time in one integer; bits beyond them never come back down."""
    if not a or not b:
        return 0
    where = _places(a).get
    row = full = (1 << len(a)) - 1
    for c in b:
        if hit := where(c, 0) & row:
            row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(1 << 14)
def _in_order(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_text(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return ratio(_in_order(a), _in_order(b))


@lru_cache(1 << 14)
def _tokens(s: str) -> tuple[frozenset[str], tuple[str, ...], str]:
    """Distinct tokens, in order, and joined."""
    found = frozenset(s.split())
    order = tuple(sorted(found))
    return found, order, " ".join(order)


def token_set_text(a: str, b: str) -> float:
    (x, in_x, all_x), (y, in_y, all_y) = _tokens(a), _tokens(b)
    if not x or not y:
        return 0.0
    common = x & y
    if not common:
        return ratio(all_x, all_y)
    if len(common) == len(x) or len(common) == len(y):
        return 1.0
    n = sum(map(len, common)) + len(common) - 1
    rest_x, rest_y = (" ".join([t for t in ts if t not in common]) for ts in (in_x, in_y))
    # what both have in common is a prefix of either: it is part of the longest common subsequence, and all of that with the prefix alone
    long_x, long_y = n + 1 + len(rest_x), n + 1 + len(rest_y)
    return max(2 * (n + 1 + lcs_length(rest_x, rest_y)) / (long_x + long_y), 2 * n / (n + long_x), 2 * n / (n + long_y))


def _best_window(short: str, long: str) -> float:
    n, signs, best = len(short), set(short), 0.0
    for i in range(1 - n, len(long)):
        window = long[max(0, i) : i + n]
        if (window[-1] if i + n <= len(long) else window[0]) in signs:
            best = max(best, ratio(short, window))
    return best


def partial_text(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer, windows clipped at its ends; both ways if none is longer."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 1.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) else best


#: Pairs whose windows are met at a time, pairs of other kernels, and signs of a string that one machine word holds.
TOGETHER, PAIRS, WORD = 64, 2048, 64
#: Words whose first ``k`` bits are set.
_FIRST = np.array([(1 << k) - 1 for k in range(WORD + 1)], dtype=np.uint64)


def _many(one: Callable[[str, str], float], some: Callable[[list[str], list[str]], np.ndarray], pairs: list[tuple[str, str]]) -> np.ndarray:
    """``some`` of the pairs whose strings fit machine words, many at a time, and ``one`` of each of the others."""
    out = np.zeros(len(pairs))
    fit = [i for i, (a, b) in enumerate(pairs) if 0 < len(a) <= WORD and 0 < len(b) <= WORD]
    for low in range(0, len(fit), PAIRS):
        part = fit[low : low + PAIRS]
        out[part] = some([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    if len(fit) < len(pairs):
        known = set(fit)
        for i, (a, b) in enumerate(pairs):
            if i not in known:
                out[i] = one(a, b)
    return out


def _codes(*sides: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Signs of texts as small numbers, a row a text and 0 beyond its end; lengths; and how many numbers there are."""
    lengths = [np.array([len(x) for x in side], dtype=np.int64) for side in sides]
    codes = []
    for side, n in zip(sides, lengths, strict=True):
        most = max(int(n.max(initial=0)), 1)
        code = np.array(side, dtype=f"U{most}").view(np.uint32).reshape(len(side), most).astype(np.int64) + 1
        code[np.arange(most) >= n[:, None]] = 0
        codes.append(code)
    if (size := max(int(c.max(initial=0)) for c in codes) + 1) > 256:
        found = np.unique(np.concatenate([[0], *[c.ravel() for c in codes]]))
        codes, size = [np.searchsorted(found, c) for c in codes], len(found)
    return codes, lengths, size


def _table(codes: np.ndarray, size: int) -> np.ndarray:
    """For each text and sign the places where it stands, as bits."""
    table, rows = np.zeros((len(codes), size), dtype=np.uint64), np.arange(len(codes))
    for j in range(codes.shape[1]):
        table[rows, codes[:, j]] |= np.uint64(1 << j)
    table[:, 0] = 0
    return table


def _lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs_length`` of each pair; strings of ``a`` fit a word."""
    (ca, cb), (la, _), size = _codes(a, b)
    table, base = _table(ca, size).ravel(), np.arange(len(a)) * size
    full = _FIRST[la]
    row = full.copy()
    for j in range(cb.shape[1]):
        hit = table[base + cb[:, j]] & row
        row = (row + hit) | (row - hit)
    return la - np.bitwise_count(row & full).astype(np.int64)


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    return 2 * _lcs_lengths(a, b) / np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])


def _jaro_winklers(a: list[str], b: list[str]) -> np.ndarray:
    (ca, cb), (la, lb), size = _codes(a, b)
    table, base = _table(cb, size).ravel(), np.arange(len(a)) * size
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free, met = np.full(len(a), _FIRST[WORD]), np.zeros(ca.shape, dtype=bool)
    for i in range(ca.shape[1]):
        hit = table[base + ca[:, i]] & free & _FIRST[np.minimum(i + reach + 1, WORD)] & ~_FIRST[np.maximum(i - reach, 0)]
        hit &= ~hit + np.uint64(1)  # the first free place
        free ^= hit
        met[:, i] = hit != 0
    taken = (~free[:, None] >> np.arange(cb.shape[1], dtype=np.uint64)) & np.uint64(1) != 0
    m = met.sum(axis=1)
    swaps = np.bincount(np.repeat(np.arange(len(a)), m), ca[met] != cb[taken], len(a)).astype(np.int64) // 2
    some = np.maximum(m, 1)
    s = np.where(m > 0, (m / la + m / lb + (m - swaps) / some) / 3, 0.0)
    p = np.zeros(len(a), dtype=np.int64)
    same = np.ones(len(a), dtype=bool)
    for k in range(min(4, ca.shape[1], cb.shape[1])):
        same = same & (ca[:, k] == cb[:, k]) & (ca[:, k] > 0)
        p += same
    return np.where(s > 0.7, s + 0.1 * p * (1 - s), s)


def jaro_winkler_texts(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``jaro_winkler_text`` of many pairs."""
    return np.where([a == b != "" for a, b in pairs], 1.0, _many(jaro_winkler_text, _jaro_winklers, pairs)) if pairs else np.zeros(0)


def token_sort_texts(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``token_sort_text`` of many pairs."""
    ordered = [(_in_order(a), _in_order(b)) if a and b else None for a, b in pairs]
    out = np.zeros(len(pairs))
    met = [i for i, p in enumerate(ordered) if p is not None]
    out[met] = _many(ratio, _ratios, [ordered[i] for i in met])
    return out


def token_set_texts(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``token_set_text`` of many pairs: what is left beside the common tokens is met many pairs at a time."""
    out = np.zeros(len(pairs))
    met, rests, common_n = [], [], []
    for i, (a, b) in enumerate(pairs):
        (x, in_x, all_x), (y, in_y, all_y) = _tokens(a), _tokens(b)
        if not x or not y:
            continue
        common = x & y
        if not common:
            met.append(i)
            rests.append((all_x, all_y))
            common_n.append(-1)
        elif len(common) == len(x) or len(common) == len(y):
            out[i] = 1.0
        else:
            met.append(i)
            rests.append((" ".join([t for t in in_x if t not in common]), " ".join([t for t in in_y if t not in common])))
            common_n.append(sum(map(len, common)) + len(common) - 1)
    if met:
        common = _many(lcs_length, _lcs_lengths, rests)
        n = np.array(common_n)
        lx, ly = (np.array([len(r[k]) for r in rests]) for k in (0, 1))
        long_x, long_y = n + 1 + lx, n + 1 + ly  # with n of -1: nothing in common, the plain ratio
        best = 2 * (n + 1 + common) / (long_x + long_y)
        out[met] = np.where(n < 0, best, np.maximum(best, np.maximum(2 * n / np.maximum(n + long_x, 1), 2 * n / np.maximum(n + long_y, 1))))
    return out


class TokenSets:
    """``token_set_text`` of one text and many of ``texts`` at a time.

    Texts lie as their distinct tokens in order; tokens in common are left out by masks, and bits of the one text that
    are left out stay set, so that a carry runs through them.
    """

    #: Longer texts, or ones of more tokens, are met one by one.
    LENGTH, TOKENS = 192, 40

    def __init__(self, texts: list[str]):
        self.texts = texts
        made = [_tokens(t) for t in texts]
        self.odd = np.array([len(j) > self.LENGTH or len(o) > self.TOKENS for _, o, j in made], dtype=bool)
        plain = ["" if odd else j for odd, (_, _, j) in zip(self.odd, made, strict=True)]
        orders = [() if odd else o for odd, (_, o, _) in zip(self.odd, made, strict=True)]
        self.n = np.array([len(o) for o in orders], dtype=np.int64)
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(t, len(number)) for o in orders for t in o], dtype=np.int64)
        size = np.array([len(t) for o in orders for t in o], dtype=np.int64)
        self.number, width = number, max(int(self.n.max(initial=0)), 1)
        row, place = np.repeat(np.arange(len(texts)), self.n), np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.ids, self.sizes = np.full((len(texts), width), -1, dtype=np.int32), np.zeros((len(texts), width), dtype=np.int64)
        self.ids[row, place], self.sizes[row, place] = flat, size
        signs = sorted(set("".join(plain)))
        self.sign = {c: k + 1 for k, c in enumerate(signs)}
        most = max(map(len, plain), default=0) or 1
        code = np.array(plain, dtype=f"U{most}").view(np.uint32).reshape(len(plain), most) if plain else np.zeros((0, most), dtype=np.uint32)
        inside = np.arange(most) < np.array([len(x) for x in plain], dtype=np.int64)[:, None]
        known = np.array([ord(c) for c in signs], dtype=np.uint32)
        self.codes = np.where(inside, np.searchsorted(known, code) + 1, 0).astype(np.int32)
        space = (self.codes == self.sign.get(" ", -1)) & inside
        self.slot = np.cumsum(space, axis=1).astype(np.int32)  # a space goes with the token after it

    def of(self, a: str, at: np.ndarray) -> np.ndarray:
        """With the texts at places ``at``."""
        tokens, order, joined = _tokens(a)
        if not tokens:
            return np.zeros(len(at))
        if len(joined) > WORD:
            return token_set_texts([(a, self.texts[i]) for i in at.tolist()])
        ids, n_b = self.ids[at], self.n[at]
        mine = np.array([self.number.get(t, -2) for t in order])
        equal = ids[:, :, None] == mine
        common_b, common_a = equal.any(axis=2), equal.any(axis=1)
        many = common_a.sum(axis=1)
        left_b, left_a = (ids >= 0) & ~common_b, ~common_a
        rows = np.arange(len(at))
        slot = self.slot[at]
        keep = left_b[rows[:, None], np.minimum(slot, ids.shape[1] - 1)] & (self.codes[at] > 0)
        first = left_b.argmax(axis=1)
        begin = np.cumsum(self.sizes[at] + 1, axis=1)[rows, first] - self.sizes[at, first] - 1
        keep[rows[begin > 0], begin[begin > 0] - 1] = False  # no space before the first token that is left
        ends = np.cumsum([len(t) + 1 for t in order])
        bits = [(1 << int(e) - 1) - (1 << max(int(e) - len(t) - 2, 0)) for t, e in zip(order, ends, strict=True)]
        lead = np.array([0, *[1 << int(e) - 1 for e in ends[:-1]]], dtype=np.uint64)
        mask = np.bitwise_or.reduce(np.where(left_a, np.array(bits, dtype=np.uint64), np.uint64(0)), axis=1)
        mask &= ~lead[left_a.argmax(axis=1)]
        table = np.zeros(len(self.sign) + 1, dtype=np.uint64)
        for c, places in _places(joined).items():
            if k := self.sign.get(c):
                table[k] = places
        masks = table[np.where(keep, self.codes[at], 0).T]
        masks &= mask
        row = np.full(len(at), _FIRST[len(joined)])
        for step in masks:
            step &= row
            more = row + step
            row -= step
            row |= more
        lcs = np.bitwise_count(~row & mask).astype(np.int64)
        n = np.where(many > 0, (common_b * self.sizes[at]).sum(axis=1) + many - 1, -1)
        long_x, long_y = n + 1 + np.bitwise_count(mask).astype(np.int64), n + 1 + keep.sum(axis=1)
        best = 2 * (n + 1 + lcs) / (long_x + long_y)
        out = np.where(n < 0, best, np.maximum(best, np.maximum(2 * n / np.maximum(n + long_x, 1), 2 * n / np.maximum(n + long_y, 1))))
        out = np.where((many > 0) & ((many == len(order)) | (many == n_b)), 1.0, np.where(n_b == 0, 0.0, out))
        for i in np.nonzero(self.odd[at])[0].tolist():
            out[i] = token_set_text(a, self.texts[at[i]])
        return out


def partial_texts(pairs: list[tuple[str, str]]) -> list[float]:
    """``partial_text`` of many pairs: the windows of pairs with about equally long shorter strings run through one table of machine words."""
    out = np.zeros(len(pairs))
    items: list[tuple[int, str, str]] = []
    for i, (a, b) in enumerate(pairs):
        if not a or not b:
            continue
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if short in long:
            out[i] = 1.0
        elif len(short) > WORD:
            out[i] = partial_text(a, b)
        else:
            items.append((i, short, long))
            if len(a) == len(b):
                items.append((i, long, short))
    items.sort(key=lambda x: (-len(x[1]), len(x[2])))
    for low in range(0, len(items), TOGETHER):
        part = items[low : low + TOGETHER]
        best = _best_windows([x[1] for x in part], [x[2] for x in part])
        np.maximum.at(out, [x[0] for x in part], best)
    return out.tolist()


def _best_windows(shorts: list[str], longs: list[str]) -> np.ndarray:
    """``_best_window`` of each pair, the longest of ``shorts`` first. A window clipped at an end goes on into signs that no string has."""
    (short, long), (ns, nl), size = _codes(shorts, longs)
    n, most, count = int(ns[0]), long.shape[1], len(shorts)
    text = np.zeros((most + 2 * n, count), dtype=np.int64)
    text[n : n + most] = long.T
    masks = _table(short, size).ravel()[text + np.arange(count) * size]  # of every place, where its sign stands in the shorter string
    full = _FIRST[ns]
    row = np.broadcast_to(full, (n + most - 1, count)).copy()
    hit, more = np.empty_like(row), np.empty_like(row)
    live = np.searchsorted(-ns, -np.arange(n), "left")  # pairs whose shorter string is longer than t
    for t in range(n):
        k = int(live[t])
        r, h, m = row[:, :k], hit[:, :k], more[:, :k]
        np.bitwise_and(masks[t + 1 : t + n + most, :k], r, out=h)
        np.add(r, h, out=m)
        np.subtract(r, h, out=r)
        np.bitwise_or(r, m, out=r)
    common = ns - np.bitwise_count(row & full).astype(np.int64)
    begin = np.arange(1 - n, most)[:, None]
    window = np.minimum(begin + ns, nl) - np.maximum(begin, 0)
    return np.where(window > 0, 2 * common / (ns + np.maximum(window, 1)), 0.0).max(axis=0)


@lru_cache(1 << 14)
def _grams(s: str, n: int = 4) -> frozenset[str]:
    return frozenset([s[i : i + n] for i in range(len(s) - n + 1)])


def gram_jaccard_text(a: str | None, b: str | None) -> float:
    """Shared grams of four signs, of all that either has."""
    x, y = _grams(a or ""), _grams(b or "")
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x or y else 0.0


def kernels_text(a: str | None, b: str | None) -> tuple[float, float, float, float]:
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0, 0.0, 0.0, 0.0
    if a == b:
        return 1.0, 1.0, 1.0, 1.0
    return jaro_winkler_text(a, b), token_sort_text(a, b), token_set_text(a, b), partial_text(a, b)


@F.pandas_udf(KERNEL_TYPE)
def kernels(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """All four kernels of a pair in one crossing to Python; equal pairs of a batch are met once."""
    pairs = [(x or "", y or "") for x, y in zip(a, b, strict=True)]
    place = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
    distinct = list(place)
    rows = np.zeros((len(distinct), len(KERNELS)))
    open_ = [i for i, (x, y) in enumerate(distinct) if x and y and x != y]
    rows[[i for i, (x, y) in enumerate(distinct) if x and x == y]] = 1.0
    some = [distinct[i] for i in open_]
    rows[open_] = np.column_stack([f(some) for f in (jaro_winkler_texts, token_sort_texts, token_set_texts, partial_texts)])
    return pd.DataFrame(rows[[place[p] for p in pairs]].reshape(-1, len(KERNELS)), columns=list(KERNELS))


def _mapped(many: Callable[[list[tuple[str, str]]], np.ndarray | list[float]]) -> Callable:
    """An Arrow kernel of pairs; a null, a pair that is settled already, costs nothing."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b, strict=True))
        place = {p: i for i, p in enumerate(dict.fromkeys(p for p in pairs if p[0] is not None and p[1] is not None))}
        found = np.append(many(list(place)), 0.0)
        return pd.Series(found[[place.get(p, -1) for p in pairs]], dtype=float)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


_jaro_winkler, _token_sort, _token_set, _partial = (_mapped(f) for f in (jaro_winkler_texts, token_sort_texts, token_set_texts, partial_texts))
gram_jaccard = _mapped(lambda pairs: np.array([gram_jaccard_text(x, y) for x, y in pairs], dtype=float))


def _settled(a: Column | str, b: Column | str, kernel: Callable) -> Column:
    """``kernel`` of pairs that expressions don't settle: 0 where either is empty, 1 where both are equal.

    Containment of tokens is left to the kernels: array functions on every pair cost more than the crossing they spare.
    """
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (a, b))
    done = (a == "") | (b == "") | (a == b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(kernel(F.when(~done, a), F.when(~done, b)))


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    return _settled(a, b, _jaro_winkler)


def token_sort(a: Column | str, b: Column | str) -> Column:
    return _settled(a, b, _token_sort)


def token_set(a: Column | str, b: Column | str) -> Column:
    return _settled(a, b, _token_set)


def partial(a: Column | str, b: Column | str) -> Column:
    return _settled(a, b, _partial)
