"""Text of records: cleaning, tokens, numbers, signatures, grams, phonetic forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables

LIST = "array<string>"


def clean(text: Column) -> Column:
    """Lower case, ``&`` as a word, punctuation as spaces, single spaces. Equal to ``clean_unicode`` on ASCII text."""
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, "[./-]", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _simple_upper() -> dict[str, str]:
    """Signs whose simple upper case is not what ``F.upper`` makes of them: those with several upper-case letters, and letters of Unicode's newest versions."""
    newest = [*"\u019b\u0264\u1c8a\ua7cd\ua7db", *map(chr, range(0x10D70, 0x10D86))]
    out = {c: c for c in newest}
    for c in map(chr, range(0x80, 0xFB18)):
        if len(c.upper()) > 1:
            out[c] = c.title() if len(c.title()) == 1 else c
    return out | {"ß": "ẞ"}


SIMPLE_UPPER = _simple_upper()


def upper(text: Column | str) -> Column:
    """Upper case sign by sign, as other engines have it: a text keeps its length, and ``ß`` becomes ``ẞ`` and not ``SS``."""
    text = F.col(text) if isinstance(text, str) else text
    table = F.create_map(*[F.lit(x) for kv in SIMPLE_UPPER.items() for x in kv])
    signs = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.upper(c)))
    return F.when(text.rlike("[" + "".join(SIMPLE_UPPER) + "]"), F.array_join(signs, "")).otherwise(F.upper(text))


def normalise_g1(text: Column) -> Column:
    """The first generation's form: decomposed, without combining marks, lower case, ``&`` as a word, other signs as spaces.

    Neither transliterated nor with the step for ``. / -`` of its own. Texts beyond ASCII
    need the Unicode tables and so Python; ASCII texts stay in expressions.
    """
    text = F.coalesce(text, F.lit(""))
    beyond = text.rlike("[^ -~\\n\\t]")
    return F.when(beyond, normalise_g1_unicode(F.when(beyond, text))).otherwise(clean(text))


def normalise_g1_text(s: str | None) -> str:
    s = unicodedata.normalize("NFKD", s or "")
    s = "".join(c for c in s if not unicodedata.combining(c)).lower().replace("&", " and ")
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in s).split())


@F.pandas_udf(StringType())
def normalise_g1_unicode(s: pd.Series) -> pd.Series:
    return s.map(normalise_g1_text)


def transliteration_table() -> dict[int, str]:
    """From code point to latin letters: ligatures, joiners, Arabic-Indic digits and nine Brahmic blocks."""
    out = {0x152: "oe", 0x153: "oe", 0xC6: "ae", 0xE6: "ae", 0x200C: "", 0x200D: ""} | {0x660 + d: str(d) for d in range(10)}
    first, last = tables.BRAHMIC_BLOCKS
    for block in range(first, last + 1, 0x80):
        out |= {block + at: latin for at, latin in tables.BRAHMIC_OFFSETS.items()}
        out |= {block + tables.BRAHMIC_DIGITS + d: str(d) for d in range(10)}
    return out


_TABLE = transliteration_table()


def transliterate_text(s: str | None) -> str:
    return (s or "").translate(_TABLE)


def clean_text(s: str | None) -> str:
    """Transliterated, decomposed, without combining marks, recomposed, and then as ``clean``."""
    s = unicodedata.normalize("NFKD", transliterate_text(s))
    s = unicodedata.normalize("NFKC", "".join(c for c in s if not unicodedata.combining(c))).lower().replace("&", " and ")
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in s).split())


@F.pandas_udf(StringType())
def transliterate(s: pd.Series) -> pd.Series:
    return s.map(transliterate_text)


@F.pandas_udf(StringType())
def clean_unicode(s: pd.Series) -> pd.Series:
    return s.map(clean_text)


_VOWELS = "AEIOU"
#: How a word may begin, and what it then begins with instead.
METAPHONE_STARTS = (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W"))


def metaphone_text(word: str) -> str:
    """Metaphone of one word: the published rules, four to six symbols for most names."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    for start, put in METAPHONE_STARTS:
        if w.startswith(start):
            w = put + w[len(start) :]
            break
    out, n = [], len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    i = 0
    while i < n:
        c = w[i]
        if c == at(i - 1) and c != "C":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and at(i - 1) == "M"):
                out.append("B")
        elif c == "C":
            if at(i + 1) == "H":
                out.append("X")
                i += 1
            elif at(i + 1) == "I" and at(i + 2) == "A":
                out.append("X")
            elif at(i + 1) and at(i + 1) in "IEY":
                if at(i - 1) != "S":
                    out.append("S")
            else:
                out.append("K")
        elif c == "D":
            if at(i + 1) == "G" and at(i + 2) and at(i + 2) in "EIY":
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            if at(i + 1) == "H" and at(i + 2) not in _VOWELS:
                i += 1
            elif at(i + 1) == "N" and i + 2 >= n:
                pass
            elif at(i + 1) and at(i + 1) in "IEY" and at(i - 1) != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if at(i + 1) and at(i + 1) in _VOWELS and at(i - 1) not in ("C", "S", "P", "T", "G"):
                out.append("H")
        elif c == "K":
            if at(i - 1) != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if at(i + 1) == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if at(i + 1) == "H":
                out.append("X")
                i += 1
            elif at(i + 1) == "I" and at(i + 2) and at(i + 2) in "OA":
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if at(i + 1) == "H":
                out.append("0")
                i += 1
            elif at(i + 1) == "I" and at(i + 2) and at(i + 2) in "OA":
                out.append("X")
            else:
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if at(i + 1) and at(i + 1) in _VOWELS:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)




def _metaphone_sign(s: Column) -> Column:
    """The code of a sign: ``c`` is the sign, ``p`` and ``q`` those before, ``n`` and ``m`` those after, empty beyond the word, ``i`` its place."""
    c, p, q, n, m = (s[x] for x in "cpqnm")
    vowel, soft = lambda x: x.isin(*_VOWELS), lambda x: x.isin("I", "E", "Y")
    case = lambda *pairs, other: _cases(pairs, other)
    return case(
        ((c == p) & (c != "C"), ""),
        (vowel(c), F.when(s["i"] == 1, c).otherwise("")),
        (c == "B", case(((n == "") & (p == "M"), ""), other="B")),
        (c == "C", case(((n == "H") | ((n == "I") & (m == "A")), "X"), (soft(n) & (p == "S"), ""), (soft(n), "S"), other="K")),
        (c == "D", case(((n == "G") & soft(m), "J"), other="T")),
        (c == "G", case(((p == "D") & (q != "D") & soft(n), ""), ((n == "H") & (m != "") & ~vowel(m), ""), ((n == "N") & (m == ""), ""), (soft(n) & (p != "G"), "J"), other="K")),
        (c == "H", case((vowel(n) & ~p.isin("C", "S", "P", "T", "G"), "H"), other="")),
        (c == "K", case((p == "C", ""), other="K")),
        (c == "P", case((n == "H", "F"), other="P")),
        (c == "Q", "K"),
        (c == "S", case(((n == "H") | ((n == "I") & m.isin("O", "A")), "X"), other="S")),
        (c == "T", case((n == "H", "0"), ((n == "I") & m.isin("O", "A"), "X"), other="T")),
        (c == "V", "F"),
        (c.isin("W", "Y"), F.when(vowel(n), c).otherwise("")),
        (c == "X", "KS"),
        (c == "Z", "S"),
        other=c,
    )


def _cases(pairs: tuple, other: object) -> Column:
    out = other if isinstance(other, Column) else F.lit(other)
    for condition, value in reversed(pairs):
        out = F.when(condition, value).otherwise(out)
    return out


def metaphone(word: Column) -> Column:
    """Metaphone of a word, as ``metaphone_text``, in expressions: a sign's code depends on the two before and the two after."""
    w = F.regexp_replace(F.upper(F.coalesce(word, F.lit(""))), "[^A-Z]", "")
    start = w
    for old, new in reversed(METAPHONE_STARTS):
        start = F.when(F.startswith(w, F.lit(old)), F.concat(F.lit(new), F.substr(w, F.lit(len(old) + 1)))).otherwise(start)
    at = lambda x, i: F.when(i >= 1, F.substr(x, i, F.lit(1))).otherwise("")

    def signs(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.struct(
            i.alias("i"), at(x, i).alias("c"), at(x, i - 1).alias("p"), at(x, i - 2).alias("q"), at(x, i + 1).alias("n"), at(x, i + 2).alias("m")))

    coded = lambda x: F.when(x == "", F.lit("")).otherwise(F.array_join(F.transform(signs(x), _metaphone_sign), ""))
    return F.element_at(F.transform(F.array(start), coded), 1)


def tokens(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def without(toks: Column, words: list[str], least: int) -> Column:
    return F.filter(toks, lambda t: (F.length(t) >= least) & ~F.array_contains(_words(words), t))


def expand(toks: Column, table: dict[str, str] | None = None) -> Column:
    """Each token's long form, once: what an abbreviation becomes isn't looked up again."""
    table = tables.ADDR_ABBREV if table is None else table
    long = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(long, t), t))


def core_tokens(name_toks: Column) -> Column:
    """Tokens of a name that name it, in order, repeats kept."""
    return without(name_toks, tables.LEGAL_TOKENS, 3)


def core_tokens_g1(name_toks: Column) -> Column:
    return F.array_sort(F.array_distinct(without(name_toks, tables.LEGAL_TOKENS_G1, 2)))


def addr_tokens(addr_toks: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(without(addr_toks, tables.ADDR_STOP, 5), lambda t: ~t.rlike("^[0-9]+$"))))


def addr_tokens_g1(addr_toks: Column) -> Column:
    return F.array_sort(F.array_distinct(without(addr_toks, tables.ADDR_STOP_G1, 2)))


def numbers(addr_toks: Column) -> Column:
    """Runs of digits without leading zeros, distinct, in string order."""
    runs = F.flatten(F.transform(addr_toks, lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))))


def pins(nums: Column) -> Column:
    return F.filter(nums, lambda n: F.length(n).isin(5, 6))


def pins_g1(addr_toks: Column) -> Column:
    """All-digit tokens of five or six digits, zeros kept."""
    return F.array_sort(F.array_distinct(F.filter(addr_toks, lambda t: t.rlike("^[0-9]{5,6}$"))))


def numbers_g1(addr_toks: Column) -> Column:
    return F.filter(numbers(addr_toks), lambda n: F.length(n) >= 2)


def signature(core: Column, k: int = 3) -> Column:
    return F.array_join(F.slice(F.array_sort(core), 1, k), " ")


def joined_prefix(core: Column, in_order: bool, length: int = 8, least: int = 6) -> Column:
    """The first signs of all core tokens in a row; null if there are too few."""
    joined = F.array_join(core if in_order else F.array_sort(core), "")
    return F.when(F.length(joined) >= least, F.substring(joined, 1, length))


def grams(text: Column, n: int = 4) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))))).otherwise(F.array().cast(LIST))


def strided_grams(text: Column, step: int, n: int = 4) -> Column:
    """Every ``step``-th gram of the text without spaces, distinct, in order."""
    solid = F.replace(text, F.lit(" "), F.lit(""))
    starts = F.sequence(F.lit(1), F.length(solid) - (n - 1), F.lit(step))
    return F.when(F.length(solid) >= n, F.array_distinct(F.transform(starts, lambda i: F.substr(solid, i, F.lit(n))))).otherwise(F.array().cast(LIST))


def fingerprint(core: Column, nums: Column) -> Column:
    """Signature and the first two numbers; empty without core tokens."""
    return F.when(F.size(core) > 0, F.concat(signature(core), F.lit("|"), F.array_join(F.slice(nums, 1, 2), ","))).otherwise("")


def street_tokens(address: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(address, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(without(found, tables.STREET_STOP, 3), lambda t: ~t.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(kept))


def phonetic_collapse(text: Column) -> Column:
    """Each word's consonants in one spelling: what transliterations of a name have in common."""

    def collapse(w: Column) -> Column:
        w = F.regexp_replace(w, "[^a-z0-9]", "")
        x = w
        for old, new in (("ph", "f"), ("kh", "k"), ("[cq]", "k"), ("v", "w"), ("z", "j"), ("([b-df-hj-np-tv-z])h+", "$1"), (r"([a-z])\1+", "$1")):
            x = F.regexp_replace(x, old, new)
        x = F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substring(x, 2, 1_000_000_000), "[aeiou]", ""))
        x = F.regexp_replace(x, r"([a-z])\1+", "$1")
        return F.when(w.rlike("^[0-9]+$"), w).otherwise(x)

    words = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != ""), collapse)
    return F.array_join(F.filter(words, lambda t: t != ""), " ")


def md5_bucket(entity_id: Column) -> Column:
    return F.conv(F.substring(F.md5(entity_id.cast("binary")), 1, 8), 16, 10).cast("bigint") % tables.HOLDOUT[1]
