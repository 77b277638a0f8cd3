"""Personal data: base patterns, and more spans by weak supervision.

Everything here is DataFrame expressions; no row passes through Python.

Base spans are matches of four patterns and always stay. The method adds what the base
patterns miss: spelled-out addresses, national phone numbers, social security numbers, bank
accounts, IPv6 addresses, street addresses, names and secrets. A looser pattern proposes
candidates. Labelers vote on each and on every base span, for, against or not at all: the
form, gazetteers, and the words before and after. The votes of the whole corpus are counted
by kind and pattern, a table of bounded size. Expectation-maximisation over that table
estimates how reliable each labeler is for each kind and how likely each pattern is a true
span. With these as soft labels a logistic model is trained, which also sees the span's
shape: the final classifier, whose word alone decides on a candidate.

A text costs time in proportion to its length and its spans: texts are split at their
matches, places are running sums, and context is taken from the neighbouring part.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spread

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("address", "national", "ssn", "iban", "ipv6", "street", "name", "secret")
KINDS = BASE_KINDS + MORE_KINDS
#: The four base patterns, possessive and anchored where a run begins, so that no text costs
#: more than linear time; ``\\G`` lets a match begin where the last one ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers: given names and titles, street words, names of fields that hold secrets.
GIVEN_NAMES = (
    "Adam Alan Alice Amanda Amy Andrea Andrew Anna Anne Antonio Barbara Brian Carlos Carmen Charles Christine Claire Daniel David Deborah Diana Donald "
    "Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Frances Frank Friedrich Gary George Hans Heinrich Helen Henry Isabel Jack James Jane Jason Javier "
    "Jean Jeffrey Jennifer Jessica Joan John Jose Joseph Juan Julia Julie Karen Karl Katherine Kevin Klaus Laura Linda Lisa Louis Lucia Luis Manuel Marco "
    "Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Miguel Monika Nancy Nicole Nicolas Olivia Pablo Pamela Patricia Patrick Paul "
    "Pedro Peter Philippe Pierre Rachel Ralph Rebecca Richard Robert Ruth Samuel Sandra Sarah Scott Sharon Sofia Sophie Stefan Stephen Steven Susan Teresa "
    "Thomas Timothy Ursula Victor Walter William Wolfgang Yves"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Sr Sra Señor Señora".split()
STREETS = "Street St Avenue Ave Road Rd Boulevard Blvd Lane Ln Drive Dr Court Ct Square Sq Way Place Pl Terrace Crescent Close".split()
SECRET_FIELDS = "token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer|credential|client[_ -]?secret|session[_ -]?key"
_ANY = "|".join
_SECRET = "A-Za-z0-9_+/-"
#: Candidates. Each begins where a run begins, and its repeats are bounded or possessive.
MORE_PATTERNS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "national": (
        r"(?<![0-9A-Za-z+$#.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}"
        r"|\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{5,8}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,4})(?![0-9A-Za-z])"
    ),
    "ssn": r"(?<![0-9A-Za-z+$#.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?:[0-9A-Fa-f]{1,4}|:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "street": (
        rf"(?<![0-9A-Za-z])[0-9]{{1,5}}[a-z]?,? (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{_ANY(STREETS)})(?![A-Za-z])"
        r"|(?<!\p{L})\p{Lu}\p{Ll}{2,24}(?:straße|strasse|gasse|weg|platz|allee) [0-9]{1,4}[a-z]?(?![0-9A-Za-z])"
        r"|(?<![0-9A-Za-z])[0-9]{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|chemin|impasse|quai) (?:d[eu] |des |de la |de l'|d')?\p{Lu}[\p{L}'-]{1,30}"
        r"|(?<!\p{L})(?:Calle|Avenida|Plaza|Paseo) (?:de |del |de la )?\p{Lu}\p{Ll}{1,24},? [0-9]{1,4}(?![0-9A-Za-z])"
    ),
    "name": (
        rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{_ANY(TITLES)})\.? (?:\p{{Lu}}\p{{Ll}}{{1,20}} )?(?:\p{{Lu}}\. )?\p{{Lu}}\p{{Ll}}{{1,20}}(?:-\p{{Lu}}\p{{Ll}}{{1,20}})?"
        rf"|(?:{_ANY(GIVEN_NAMES)}) (?:\p{{Lu}}\. )?\p{{Lu}}\p{{Ll}}{{1,20}}(?:-\p{{Lu}}\p{{Ll}}{{1,20}})?)(?!\p{{L}})"
    ),
    "secret": rf"(?<![{_SECRET}])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[{_SECRET}]{{20,}}+=*+",
}
#: Noncharacters, which no text should hold: around matches, and in place of spans taken out. In a text they count as U+FFFD.
MARK, FILL = "\uFDD0", "\uFDD1"
TAKEN = {k: chr(0xFDD2 + i) for i, k in enumerate(KINDS)}
_OURS = "[\uFDD0-\uFDEF]"

_PHONE_WORDS = r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|contact|dial|ring|reach|telefon|rufen|tél|téléphone|appelez|teléfono|llamar)\b"
_MAIL_WORDS = r"\b(?:e-?mail|mail|contact|reach|write|address|adresse|schreib|correo)\b"
#: Words near a span that speak for it, by kind; lower case.
CONTEXT_WORDS = {
    "email": _MAIL_WORDS, "address": _MAIL_WORDS, "phone": _PHONE_WORDS, "national": _PHONE_WORDS,
    "ssn": r"\b(?:ssn|social security|taxpayer|tin|sozialversicherung)\b", "ip": r"\b(?:ip|address|host|server|client|login)\b", "ipv6": r"\b(?:ip|ipv6|address|host|server|client|ping|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan|karte|carte|tarjeta)\b", "iban": r"\b(?:iban|account|bank|transfer|pay|konto|compte|cuenta|bic|swift)\b",
    "street": r"\b(?:address|lives?|living|resides?|home|office|located|deliver|ship|visit|wohnt|adresse|habite|domicilio|vive)\b",
    "name": r"\b(?:name|named|called|dear|contact|signed|sincerely|regards|patient|customer|employee|client|mrs?|ms|born|by|from|with|tell|ask|heißt|appelle|llamo)\b",
    "secret": rf"(?:{SECRET_FIELDS})",
}
#: Words right before a span that speak against it, and what follows one that does.
AGAINST_WORDS = r"(?:\b(?:isbn|issn|version|order|invoice|item|part|serial|page|fig|figure|section|doi|model|sku|id|no|nr|total|price|commit|checksum|sha1|sha256|md5|build|uuid|chapter|the|at time)\b\.?|[#$€£@/])[^a-z0-9]{0,4}$"
AGAINST_AFTER = r"^ ?(?:university|college|hospital|museum|library|school|street|avenue|river|lake|airport|foundation|award|inc\b|ltd\b|pages|km\b|kg\b|usd\b|eur\b|[%€$£])"
#: Top-level domains and country codes of the gazetteers.
DOMAINS = r"(?i)(?:\.|dot ?[\])] ?)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|ca|au|us|ch|at|nl|be)$"
IBAN_COUNTRIES = "^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)"
#: Kinds whose form alone says little: no word for them nearby is a vote against.
NEED_CONTEXT = ("national", "ssn", "name", "street")
LABELERS = ("form", "gazetteer", "before", "after", "against", "joined")
SHAPES = ("mostly digits", "long", "begins a line", "ends a clause", "mixed case")
#: What each labeler is made to be: its chances to vote for, not at all and against, of a true span and of a false one.
#: A candidate has passed a pattern, so its form and its place in a gazetteer say less than the words around it.
MADE = {
    "form": ((0.75, 0.15, 0.10), (0.45, 0.15, 0.40)),
    "gazetteer": ((0.60, 0.30, 0.10), (0.35, 0.35, 0.30)),
    "before": ((0.65, 0.25, 0.10), (0.10, 0.25, 0.65)),
    "after": ((0.35, 0.60, 0.05), (0.05, 0.90, 0.05)),
    "against": ((0.05, 0.90, 0.05), (0.05, 0.45, 0.50)),
    "joined": ((0.05, 0.90, 0.05), (0.05, 0.55, 0.40)),
}
#: As how many votes what a labeler is made to be counts in the estimates of a kind.
PRIOR_VOTES = 50
#: Elements of an array worked through at a time, and how often sums of sums are taken: places of up to RUN**4 parts in linear time.
RUN, LEVELS = 256, 2
#: How much text around a span its context is.
CONTEXT = 40
_SPAN = "struct<start:int,end:int,marks:array<int>>"


@dataclass(frozen=True)
class Model:
    """What was learnt, by kind: the prior and each labeler's chance to vote for a true and a false span; and the classifier's weights."""

    priors: dict[str, float] = field(default_factory=dict)
    rates: dict[str, tuple[tuple[float, float], ...]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * (2 * len(LABELERS) + len(SHAPES))

    def score(self, kind: str, marks: tuple[int, ...]) -> float:
        return self.bias.get(kind, 0.0) + sum(self.weights[i] for i in _active(marks))


def _active(marks: tuple[int, ...]) -> list[int]:
    """The classifier's features that are 1: votes for, votes against, shapes."""
    m = len(LABELERS)
    return [k if v > 0 else m + k for k, v in enumerate(marks[:m]) if v] + [2 * m + k for k, v in enumerate(marks[m:]) if v]


def _text(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(_OURS), F.regexp_replace(text, _OURS, "\uFFFD")).otherwise(text)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(lengths: Column, levels: int = LEVELS) -> Column:
    """For each element the sum of those before it: run by run, the runs' own sums found the same way."""
    empty = F.array().cast("array<int>")

    def run(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("at"), empty.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    if not levels:
        return run(lengths, F.lit(0))

    def runs(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda k: F.slice(xs, k * RUN + 1, RUN))

        def with_bases(ps: Column) -> Column:
            sums = F.transform(ps, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
            return F.flatten(F.zip_with(ps, _before(sums, levels - 1), run))

        return _once(parts, with_bases)

    return _once(lengths, runs)


def _split(text: Column, pattern: str, use: Callable[[Column], Column], none: Column) -> Column:
    """``use`` of the text's parts, every second of which is a match; ``none`` without matches."""
    cut = lambda marked: F.when(F.instr(marked, MARK) > 0, _once(F.split(marked, MARK, -1), use)).otherwise(none)
    return _once(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), cut)


def _spans(text: Column, kind: str) -> Column:
    """Array of ``(start, end, marks)`` of all matches that hold, in code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")

    def found(parts: Column, at: Column) -> Column:
        def span(i: Column) -> Column:
            value, start = F.element_at(parts, i), F.element_at(at, i)
            before, after = F.right(F.element_at(parts, i - 1), F.lit(CONTEXT)), F.left(F.element_at(parts, i + 1), F.lit(CONTEXT))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), _marks(kind, value, before, after).alias("marks"))

        places = F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2))
        if kind in BASE_KINDS:
            places = F.filter(places, lambda i: _holds(kind, F.element_at(parts, i)))
        return F.transform(places, span)

    made = _split(text, _pattern(kind), lambda parts: _once(_before(F.transform(parts, F.length)), lambda at: found(parts, at)), none)
    return F.when(_may_hold(text, kind), made).otherwise(none)


def _pattern(kind: str) -> str:
    return BASE_PATTERNS[kind] if kind in BASE_KINDS else MORE_PATTERNS[kind]


def _may_hold(text: Column, kind: str) -> Column:
    """A sign without which a text has no match of the kind, so that most texts cost no regex."""
    has = lambda *signs: F.expr("false") if not signs else F.contains(text, F.lit(signs[0])) | has(*signs[1:])
    if kind == "address":
        return has("(at", "( at", "[at", "[ at")
    if kind in ("email", "phone", "ipv6"):
        return has({"email": "@", "phone": "+", "ipv6": ":"}[kind])
    return F.lit(True) if kind == "name" else F.col("__digit")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def iban_holds(value: Column) -> Column:
    """Whether an account number has the remainder 1 by 97."""
    solid = F.replace(value, F.lit(" "), F.lit(""))

    def add(acc: Column, c: Column) -> Column:
        d = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(d > 9, 100).otherwise(10) + d) % 97

    turned = F.concat(F.substr(solid, F.lit(5), F.length(solid)), F.substr(solid, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _part255(value: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _part255(value)
    if kind == "email":
        return F.lit(True)
    return _once(_digits(value), lambda d: F.length(d).between(9, 15) if kind == "phone" else F.length(d).between(13, 19) & luhn(d))


def _marks(kind: str, value: Column, before: Column, after: Column) -> Column:
    """A span's votes, 1 for, -1 against, 0 none, in the order of LABELERS, and its SHAPES, 1 or 0."""
    digits, low_before, low_after = _digits(value), F.lower(before), F.lower(after)
    yes = lambda c: F.when(c, 1).otherwise(-1)
    only = lambda c: F.when(c, 1).otherwise(0)
    form = {
        "email": lambda: yes(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")),
        "address": lambda: yes(value.rlike(r"(?i)[\[(] ?at ?[\])].*(?:[\[(] ?dot ?[\])]|\.)")),
        "phone": lambda: yes(F.length(digits) >= 10),
        "national": lambda: yes(value.rlike(r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|0[0-9]([ .-])[0-9]{2}(?:\2[0-9]{2}){3}|\(?0.*)$")),
        "ssn": lambda: yes(~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^.{3}00") & ~digits.rlike("0000$")),
        "ip": lambda: yes(~value.rlike(r"^0")),
        "card": lambda: yes(F.length(digits).isin(15, 16)),
        "iban": lambda: yes(iban_holds(value)),
        "ipv6": lambda: yes(value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (F.instr(value, "::") > 0)),
        "street": lambda: yes(value.rlike(r"^[0-9]{1,4}[a-z]? |[0-9]{1,4}[a-z]?$|^[0-9]{1,4}(?: bis| ter)?,? ")),
        "name": lambda: yes(value.rlike(rf"^(?:{_ANY(TITLES)})\.? |(?<=[ .])\p{{Lu}}\. ") | value.rlike(rf"^(?:{_ANY(GIVEN_NAMES)}) \p{{Lu}}\p{{Ll}}{{2,}}$")),
        "secret": lambda: yes(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|gho|xox[bp]|AKIA|eyJ)[A-Za-z0-9_+/=-]{16,}|[A-Za-z0-9+/_=]{24,})$") & ~value.rlike("(?i)[a-z]{12}|/.*/.*/")),
    }[kind]()
    gazetteer = {
        "email": lambda: only(value.rlike(DOMAINS)),
        "address": lambda: yes(value.rlike(DOMAINS)),
        "phone": lambda: only(digits.rlike("^(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")),
        "national": lambda: yes(digits.rlike("^(?:[2-9][0-8][0-9][2-9]|0)")),
        "ssn": lambda: F.lit(0),
        "ip": lambda: only(value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")),
        "card": lambda: only(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "iban": lambda: yes(value.rlike(IBAN_COUNTRIES)),
        "ipv6": lambda: only(value.rlike("(?i)^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}|::)")),
        "street": lambda: yes(value.rlike(rf"(?:{_ANY(STREETS[:12])}|straße|strasse|weg|platz|rue|avenue|boulevard|Calle|Avenida)")),
        "name": lambda: only(value.rlike(rf"(?:^|\. |{_ANY(TITLES)}\.? )(?:{_ANY(GIVEN_NAMES)}) ")),
        "secret": lambda: F.when(value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"), -1).when(value.rlike("^(?:sk|pk|ghp|gho|xox[bp]|AKIA|eyJ)") | low_before.rlike(rf"(?:{SECRET_FIELDS})[\"']? ?[=:]>? ?[\"']?$"), 1).otherwise(0),
    }[kind]()
    words = CONTEXT_WORDS[kind]
    near, later = low_before.rlike(words), low_after.rlike(rf"^.{{0,20}}?{words}")
    none = -1 if kind in NEED_CONTEXT else 0
    votes = [
        form, gazetteer, F.when(near, 1).otherwise(F.when(later, 0).otherwise(none)), only(later),
        F.when(low_before.rlike(AGAINST_WORDS) | low_after.rlike(AGAINST_AFTER), -1).otherwise(0),
        F.when(after.rlike(r"^ ?[0-9%/=*]") | before.rlike(r"[0-9/=*] ?$"), -1).otherwise(0) if kind != "secret" else F.when(before.rlike(r"[./:]$") | after.rlike(r"^[./:][A-Za-z0-9]"), -1).otherwise(0),
    ]
    n = F.length(value)
    shapes = [
        2 * F.length(digits) > n, n >= 16, (before == "") | before.rlike(r"\n[ \t]*$"), (after == "") | after.rlike(r"^[.,;:!?)\n]"),
        value.rlike(r"\p{Lu}") & value.rlike(r"\p{Ll}"),
    ]
    return F.array(*[v.cast("int") for v in votes], *[s.cast("int") for s in shapes])


def _taken_out(text: Column, kind: str, accepted: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with the kind's spans that are accepted replaced by signs, as many as they had."""

    def parts_of(parts: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            gone = F.concat(F.lit(TAKEN[kind]), F.repeat(F.lit(FILL), F.length(x) - 1))
            inside = (i % 2 == 1) & accepted(x, F.right(F.get(parts, i - 1), F.lit(CONTEXT)), F.left(F.get(parts, i + 1), F.lit(CONTEXT)))
            return F.when(inside, gone).otherwise(x)

        return F.array_join(F.transform(parts, part), "")

    return F.when(_may_hold(text, kind), _split(text, _pattern(kind), parts_of, text)).otherwise(text)


def _without_base(found: DataFrame) -> DataFrame:
    """Add ``__m``: the text without its base spans, kind after kind; each sign of them is replaced by one."""
    out = found.withColumn("__m", F.col("__t"))
    some = F.lit(False)
    for kind in BASE_KINDS:
        some = some | (F.size(f"__{kind}") > 0)
    for kind in BASE_KINDS:
        out = out.withColumn("__m", F.when(some, _taken_out(F.col("__m"), kind, lambda x, _b, _a, k=kind: _holds(k, x))).otherwise(F.col("__m")))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``__row``, a row of ``docs``, and ``__<kind>``, an array of ``(start, end, marks)``, for every kind: base spans and candidates.

    Candidates are looked for where base spans have been taken out, so they overlap none
    (but the rest of a base span that another one cut short).
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), _text(F.col("text")).alias("__t"))
    out = out.withColumn("__digit", F.col("__t").rlike("[0-9]"))
    for kind in BASE_KINDS:
        out = out.withColumn(f"__{kind}", _spans(F.col("__t"), kind))
    out = _without_base(out)
    return out.select("__row", *[f"__{k}" for k in BASE_KINDS], *[_spans(F.col("__m"), k).alias(f"__{k}") for k in MORE_KINDS])


def fit(scanned: DataFrame) -> Model:
    """EM over the votes of all spans that ``scan`` found, and a classifier on its posteriors.

    Only counts by kind and marks leave the executors: at most 12 kinds times 3**6 votes times 2**5 shapes.
    """
    marked = lambda k: F.transform(f"__{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["marks"].alias("marks")))
    rows = [marked(k) for k in KINDS]
    counted = scanned.select(F.explode(F.concat(*rows)).alias("x")).groupBy("x.kind", "x.marks").agg(F.count(F.lit(1)).alias("n"))
    return learn(sorted((r["kind"], tuple(r["marks"]), r["n"]) for r in counted.collect()))


def learn(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 30, passes: int = 300) -> Model:
    """``table``: kind, marks and how often. Plain arithmetic over a table of bounded size.

    Begun at what a labeler is made to be, which also weighs as ``PRIOR_VOTES`` votes, so that
    a few candidates can't turn it round. A labeler is taken to be better than chance: where
    an estimate says otherwise, both its rates become their mean. A kind without spans has
    no model, and nothing of it to accept.
    """
    m = len(LABELERS)
    start = [{y: dict(zip((1, 0, -1), MADE[x][not y], strict=True)) for y in (True, False)} for x in LABELERS]
    priors, rates, rows = {}, {}, []
    for kind in KINDS:
        votes: dict[tuple[int, ...], int] = {}
        for k, marks, n in table:
            if k == kind:
                votes[marks[:m]] = votes.get(marks[:m], 0) + n
        if not votes:
            continue
        chance = [{y: dict(c[y]) for y in (True, False)} for c in start]
        prior, post, total = 0.5, dict.fromkeys(votes, 0.5), sum(votes.values())
        for _ in range(rounds):
            for v in votes:
                a = math.log(prior) + sum(math.log(chance[k][True][x]) for k, x in enumerate(v))
                b = math.log(1 - prior) + sum(math.log(chance[k][False][x]) for k, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(max(-700, min(700, b - a))))
            prior = (sum(post[v] * n for v, n in votes.items()) + 5) / (total + 10)
            for k in range(m):
                for y in (True, False):
                    sums = {x: PRIOR_VOTES * start[k][y][x] for x in (1, 0, -1)}
                    for v, n in votes.items():
                        sums[v[k]] += (post[v] if y else 1 - post[v]) * n
                    chance[k][y] = {x: c / sum(sums.values()) for x, c in sums.items()}
                for x, better in ((1, True), (-1, False)):
                    if chance[k][better][x] < chance[k][not better][x]:
                        chance[k][True][x] = chance[k][False][x] = (chance[k][True][x] + chance[k][False][x]) / 2
        priors[kind], rates[kind] = prior, tuple((chance[k][True][1], chance[k][False][1]) for k in range(m))
        rows += [(kind, _active(marks), post[marks[:m]], n) for k, marks, n in table if k == kind]
    weights, bias = [0.0] * (2 * m + len(SHAPES)), dict.fromkeys(priors, 0.0)
    # every kind counts alike, however many spans it has; within a kind, a pattern counts by the root of its number
    mass = {k: sum(math.sqrt(n) for kind, *_, n in rows if kind == k) for k in priors}
    for _ in range(passes if rows else 0):
        gw, gb = [0.0] * len(weights), dict.fromkeys(priors, 0.0)
        for kind, on, p, n in rows:
            z = bias[kind] + sum(weights[i] for i in on)
            g = (1 / (1 + math.exp(-max(-30, min(30, z)))) - p) * math.sqrt(n) / mass[kind]
            gb[kind] += g
            for i in on:
                gw[i] += g
        weights = [a - 0.5 * (g / max(1, len(priors)) * 4 + 0.001 * a) for a, g in zip(weights, gw, strict=True)]
        bias = {k: b - 0.5 * (gb[k] + 0.01 * b) for k, b in bias.items()}
    return Model(priors, rates, bias, tuple(weights))


def _accepted(kind: str, marks: Column, model: Model, threshold: float) -> Column:
    """The classifier's word on a candidate."""
    if kind not in model.bias:
        return F.lit(False)
    m, z = len(LABELERS), F.lit(model.bias[kind])
    for k in range(m + len(SHAPES)):
        v = F.element_at(marks, k + 1)
        z = z + (F.when(v > 0, model.weights[k]).when(v < 0, model.weights[m + k]).otherwise(0.0) if k < m else F.when(v > 0, model.weights[m + k]).otherwise(0.0))
    return z >= math.log(threshold / (1 - threshold))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(scanned: DataFrame, model: Model, *, threshold: float = 0.8) -> DataFrame:
    """``__row`` with counts ``n_<kind>`` of base spans, ``base_spans`` and ``spans``: arrays of ``(kind, start, end)``, by kind, then start."""
    base = [_named(k, F.col(f"__{k}")) for k in BASE_KINDS]
    passed = lambda k: F.filter(f"__{k}", lambda s: _accepted(k, s["marks"], model, threshold))
    more = [_named(k, passed(k)) for k in MORE_KINDS]
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select("__row", *counts, F.concat(*base).alias("base_spans"), F.concat(*base, *more).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined; empty without spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Counts, the hash of the base spans and all spans of each row of ``doc_id, text``.

    A null text counts as empty; a text without spans gives 0 counts and an empty string.
    Repeated rows each give a row; an empty table gives an empty table. Texts are read once:
    what ``scan`` finds is written, fitted on and decided.
    """
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("__row", F.struct("__row.doc_id"))
    rows = materialise(spread(rows), "spans")
    found = find(rows, fit(rows), threshold=threshold)
    return found.select("__row.doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in capitals and brackets; other columns as they are.

    Where spans of two kinds overlap, the kind that comes first in KINDS names what it has,
    and the rest stays as far as it is no span by itself. A null text stays null, a text
    without spans stays as it is, repeated rows and ties are rows like others, an empty table
    gives an empty table. All texts are searched once; only those with spans or candidates
    are gone through again.
    """
    rows = materialise(spread(scan(docs)), "spans")
    model = fit(rows)
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.size(f"__{kind}") > 0)
    out = rows.select("__row", some.alias("__some"))
    out = out.withColumn("__m", F.when(F.col("__some"), _text(F.col("__row.text"))).otherwise("")).withColumn("__digit", F.col("__m").rlike("[0-9]"))
    for kind in KINDS:
        if kind in BASE_KINDS:
            accepted = lambda x, _b, _a, k=kind: _holds(k, x)
        else:
            accepted = lambda x, b, a, k=kind: _accepted(k, _marks(k, x, b, a), model, threshold)
        out = out.withColumn("__m", F.when(F.col("__some"), _taken_out(F.col("__m"), kind, accepted)).otherwise(""))
    for kind in KINDS:
        sign = TAKEN[kind]
        out = out.withColumn("__m", F.when(F.instr("__m", sign) > 0, F.regexp_replace("__m", f"{sign}{FILL}*+", f"[{kind.upper()}]")).otherwise(F.col("__m")))
    return out.select(*[F.when(F.col("__some"), F.col("__m")).otherwise(F.col("__row.text")).alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
