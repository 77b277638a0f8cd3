"""Blocking keys: each family a Column that makes an array of keys from a normalised record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T

#: Bands of the minhash family, and the fewest grams it needs.
MINHASHES, LEAST_GRAMS = 16, 6
PRIME = (1 << 31) - 1
#: Factor and shift of each band's function.
LINEAR = tuple(((b + 1) * 1_640_531_527 % PRIME, (b + 1) * 362_437_069 % PRIME) for b in range(MINHASHES))


def _none() -> Column:
    return F.array().cast(T.LIST)


def _one(condition: Column, key: Column) -> Column:
    return F.when(condition, F.array(key)).otherwise(_none())


def _longer(toks: Column, least: int) -> Column:
    return F.filter(toks, lambda t: F.length(t) >= least)


def _with_prefix(items: Column) -> Column:
    head = F.substring("name_norm", 1, 2)
    return F.when(F.col("name_norm") != "", F.transform(items, lambda n: F.concat(n, F.lit(" "), head))).otherwise(_none())


def minhash() -> Column:
    """The least hash of the record's grams under each of 16 functions; a record with few grams has none.

    A gram's hash is 28 bits of its md5, which other engines have too; the functions are
    linear in it modulo ``PRIME``.
    """
    shingles = T.grams(F.concat("name_norm", F.lit("|"), "addr_norm"))
    hashes = F.transform(shingles, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 7), 16, 10).cast("bigint"))

    def bands(hs: Column) -> Column:
        least = lambda a, c: F.array_min(F.transform(hs, lambda h: (a * h + c) % PRIME))
        return F.array(*[F.concat(F.lit(f"{b} "), least(F.lit(a), F.lit(c)).cast("string")) for b, (a, c) in enumerate(LINEAR)])

    return F.when(F.size(shingles) >= LEAST_GRAMS, F.element_at(F.transform(F.array(hashes), bands), 1)).otherwise(_none())


def families() -> dict[str, Column]:
    """The canonical families. Repeated keys of a record count once."""
    core, nums, found = F.col("core_toks"), F.col("numbers"), F.col("pins")
    prefix = lambda in_order: T.joined_prefix(core, in_order)
    return {
        "nn": _one(F.length("name_norm") >= 4, F.col("name_norm")),
        "n": _longer(core, 4),
        "s": _one(F.size(core) >= 2, T.signature(core)),
        "nf": _with_prefix(_longer(nums, 2)),
        "p": found,
        "pf": _with_prefix(found),
        "a": _longer(F.col("addr_toks"), 6),
        "c8": _one(prefix(True).isNotNull(), prefix(True)),
        "cs8": _one(prefix(False).isNotNull(), prefix(False)),
        "g4n": T.strided_grams(F.col("name_norm"), 4),
        "g4a": T.strided_grams(F.col("addr_norm"), 6),
        "mh": minhash(),
    }


def families_g1() -> dict[str, Column]:
    """First generation: tokens, numbers, pins, a four-token signature, a prefix, a phonetic form, address tokens."""
    core = T.core_tokens_g1(F.col("name_toks"))
    longest = F.element_at(F.array_sort(F.transform(core, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    return {
        "t": core,
        "n": T.numbers_g1(F.col("addr_all")),
        "pin": T.pins_g1(F.col("addr_all")),
        "s": _one(F.size(core) >= 2, T.signature(core, 4)),
        "p": _one(F.length("name_norm") >= 3, F.substring("name_norm", 1, 3)),
        "m": F.when(F.size(core) > 0, _one(T.metaphone(longest) != "", T.metaphone(longest))).otherwise(_none()),
        "a": _longer(T.addr_tokens_g1(F.col("addr_all")), 5),
    }


def families_g2() -> dict[str, Column]:
    """Second generation: six of the canonical families."""
    return {k: v for k, v in families().items() if k in ("p", "pf", "n", "s", "nf", "a")}


def families_oldest() -> dict[str, Column]:
    """The oldest set: name tokens, signature, address tokens, pins, and pins and numbers with the first two signs of the name."""
    made = families()
    return {"nt": _longer(F.col("core_toks"), 3), "sig": made["s"], "at": _longer(F.col("addr_toks"), 5), "pin": made["p"], "pin_f2": made["pf"], "num_f2": made["nf"]}


def families_wide() -> dict[str, Column]:
    """The widest set: also single words, numbers, prefixes, a phonetic form, and pairs of adjacent core tokens in sorted order."""
    core = F.array_sort(F.array_distinct("core_toks"))
    pairs = F.zip_with(F.slice(core, 1, F.greatest(F.size(core) - 1, F.lit(0))), F.slice(core, 2, F.greatest(F.size(core) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return {
        "tc": core,
        "num": F.col("numbers"),
        "pin": F.col("pins"),
        "sig": _one(F.size(core) >= 2, T.signature(F.col("core_toks"))),
        "pref": _one(F.length("name_norm") >= 3, F.substring("name_norm", 1, 3)),
        "mph": _one(T.metaphone(F.col("first_tok")) != "", T.metaphone(F.col("first_tok"))),
        "addr": F.col("addr_toks"),
        "first": _one(F.col("first_tok") != "", F.col("first_tok")),
        "bg": F.when(F.size(core) >= 2, pairs).otherwise(_none()),
    }


def make(records: DataFrame, made: dict[str, Column] | None = None) -> DataFrame:
    """(entity_id, country, is_s1, ktype, key) of normalised records; each key of a record once."""
    made = families() if made is None else made
    typed = [_typed(name, v) for name, v in made.items()]
    return records.select("entity_id", "country", "is_s1", F.explode(F.concat(*typed)).alias("k")).select("entity_id", "country", "is_s1", "k.ktype", "k.key")


def _typed(name: str, made: Column) -> Column:
    return F.transform(F.array_distinct(made), lambda k: F.struct(F.lit(name).alias("ktype"), k.alias("key")))


def weight(ktype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in tables.KEY_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ktype), F.lit(1.0))
