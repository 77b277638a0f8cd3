"""Parts of the DuckDB statements that say the same as the catalogue's plans."""

from __future__ import annotations

from ..functions import tables
from ..functions.text import METAPHONE_STARTS
from ..operators import keys


def clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[./-]', ' ', 'g'), "
        r"'[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def words(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


def without(toks: str, stop: list[str], least: int) -> str:
    return f"list_filter({toks}, lambda t: length(t) >= {least} AND NOT list_contains({words(stop)}, t))"


def table(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def case(x: str, pairs: dict[str, object], other: object) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + f" ELSE {other} END"


def grams(x: str, n: int = 4) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))) ELSE []::VARCHAR[] END"


def strided(x: str, step: int, n: int = 4) -> str:
    y = f"replace({x}, ' ', '')"
    return f"CASE WHEN length({y}) >= {n} THEN list_distinct(list_transform(range(1, length({y}) - {n - 2}, {step}), lambda i: substr({y}, i, {n}))) ELSE []::VARCHAR[] END"


def jaccard(a: str, b: str) -> str:
    both, whole = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE {both}::DOUBLE / {whole} END"


def guarded(a: str, b: str, value: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {value} END"


ABBREV, ABBREV_G1 = table(tables.ADDR_ABBREV), table(tables.ADDR_ABBREV_G1)
NUMBERS = (
    "list_sort(list_distinct(list_transform(flatten(list_transform(addr_all, lambda t: regexp_extract_all(t, '[0-9]+'))), "
    "lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END)))"
)
REC = """rec AS (
    SELECT 'S' || (page_id % 3 + 1) || '-' || lpad(page_id::VARCHAR, 9, '0') AS entity_id,
        replace(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1), '&amp;', '&') AS business_name,
        coalesce(url, '') AS business_address, regexp_extract(coalesce(html, ''), '<html lang="([a-z]*)"', 1) AS country
    FROM pages)"""
NORM = f"""{REC}, n0 AS (
    SELECT entity_id, lower(trim(country)) AS country, entity_id LIKE 'S1-%' AS is_s1, entity_id LIKE 'S2-%' AS is_s2,
        {clean("business_name")} AS name_norm, {clean("business_address")} AS addr_clean FROM rec
), n1 AS (
    SELECT *, list_filter(string_split(name_norm, ' '), lambda t: t <> '') AS name_toks,
        list_transform(list_filter(string_split(addr_clean, ' '), lambda t: t <> ''), lambda t: coalesce({ABBREV}[t], t)) AS addr_all FROM n0
), n2 AS (
    SELECT *, array_to_string(addr_all, ' ') AS addr_norm, {without("name_toks", tables.LEGAL_TOKENS, 3)} AS core_toks,
        list_sort(list_distinct(list_filter({without("addr_all", tables.ADDR_STOP, 5)}, lambda t: NOT regexp_matches(t, '^[0-9]+$')))) AS addr_toks,
        {NUMBERS} AS numbers, coalesce(name_toks[1], '') AS first_tok FROM n1
), norm AS (
    SELECT *, list_filter(numbers, lambda n: length(n) IN (5, 6)) AS pins, array_to_string(list_sort(core_toks)[1:3], ' ') AS sig,
        array_to_string(core_toks, '') AS joined, array_to_string(list_sort(core_toks), '') AS sjoined,
        CASE WHEN len(core_toks) > 0 THEN array_to_string(list_sort(core_toks)[1:3], ' ') || '|' || array_to_string(numbers[1:2], ',') ELSE '' END AS fp
    FROM n2)"""
FAMILY = {
    "nn": "SELECT name_norm AS key FROM norm WHERE length(name_norm) >= 4",
    "n": "SELECT unnest(list_filter(core_toks, lambda t: length(t) >= 4)) AS key FROM norm",
    "s": "SELECT sig AS key FROM norm WHERE len(core_toks) >= 2",
    "nf": "SELECT unnest(list_transform(list_filter(numbers, lambda n: length(n) >= 2), lambda n: n || ' ' || substr(name_norm, 1, 2))) AS key FROM norm WHERE name_norm <> ''",
    "p": "SELECT unnest(pins) AS key FROM norm",
    "pf": "SELECT unnest(list_transform(pins, lambda n: n || ' ' || substr(name_norm, 1, 2))) AS key FROM norm WHERE name_norm <> ''",
    "a": "SELECT unnest(list_filter(addr_toks, lambda t: length(t) >= 6)) AS key FROM norm",
    "c8": "SELECT substr(joined, 1, 8) AS key FROM norm WHERE length(joined) >= 6",
    "cs8": "SELECT substr(sjoined, 1, 8) AS key FROM norm WHERE length(sjoined) >= 6",
    "g4n": f"SELECT unnest({strided('name_norm', 4)}) AS key FROM norm",
    "g4a": f"SELECT unnest({strided('addr_norm', 6)}) AS key FROM norm",
    "mh": f"""SELECT unnest(list_transform(range(0, {keys.MINHASHES}), lambda b: b || ' ' || list_min(list_transform(hs,
        lambda h: ({[a for a, _ in keys.LINEAR]}[b + 1] * h + {[c for _, c in keys.LINEAR]}[b + 1]) % {keys.PRIME})))) AS key
        FROM (SELECT *, list_transform({grams("(name_norm || '|' || addr_norm)")}, lambda g: ('0x' || substr(md5(g), 1, 7))::BIGINT) AS hs FROM norm)
        WHERE len(hs) >= {keys.LEAST_GRAMS}""",
}


def keys_of(name: str, select: str) -> str:
    return select.replace("SELECT ", f"SELECT entity_id, country, is_s1, '{name}' AS ktype, ", 1)


KEYS = f"{NORM}, keys AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(keys_of(k, v) for k, v in FAMILY.items())}))"
CAP = case("ktype", dict(tables.KEY_CAPS), tables.MOST_POSTINGS)
WEIGHT = case("ktype", dict(tables.KEY_WEIGHTS), 1.0)
SHARED = f"""{KEYS}, df AS (SELECT country, ktype, key, count(*) AS df FROM keys WHERE NOT is_s1 GROUP BY ALL
), ok AS (SELECT * FROM df WHERE df <= {CAP}
), shared AS (
    SELECT country, q.entity_id AS s1_id, t.entity_id AS target_id, ktype, key, ok.df
    FROM keys q JOIN keys t USING (country, ktype, key) JOIN ok USING (country, ktype, key) WHERE q.is_s1 AND NOT t.is_s1
), idf AS (
    SELECT country, s1_id, target_id, round(sum({WEIGHT} / ln(1 + df)), 6) AS idf, count(*) AS hits FROM shared GROUP BY ALL)"""


def top(source: str, k: int, score: str = "idf", rank: str = "rn") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, s1_id ORDER BY {score} DESC, target_id) AS {rank} FROM {source}) WHERE {rank} <= {k}"


SIDES = ("name_norm", "addr_norm", "core_toks", "addr_toks", "numbers", "pins", "first_tok", "is_s2")
POOL = f"""{SHARED}, pool AS ({top("idf", 40)}
), pairs AS (
    SELECT pool.*, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in SIDES)}
    FROM pool JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = target_id)"""
PROB = f"0.35 * ({jaccard('a_core_toks', 'b_core_toks')}) + 0.55 * ({jaccard('a_addr_toks', 'b_addr_toks')}) + 0.10 * idf / max(idf) OVER (PARTITION BY country, s1_id)"
FLAGS = (
    f"round({jaccard('a_addr_toks', 'b_addr_toks')}, 6) AS a_jac, round({jaccard('a_numbers', 'b_numbers')}, 6) AS num_ov, "
    "CASE WHEN list_has_any(a_pins, b_pins) THEN 1.0 ELSE 0.0 END AS pin_match, "
    "CASE WHEN len(a_pins) > 0 AND len(b_pins) > 0 AND NOT list_has_any(a_pins, b_pins) THEN 1.0 ELSE 0.0 END AS pin_conflict"
)
SCORED = f"{POOL}, scored AS (SELECT country, s1_id, target_id, idf, hits, rn, round({PROB}, 6) AS prob, {FLAGS} FROM pairs)"
TRUTH = """truth AS (
    SELECT a.entity_id AS s1_id, b.entity_id AS target_id FROM rec a JOIN rec b
    ON a.country = b.country AND a.business_name = b.business_name AND a.business_name <> '' AND a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%')"""
GATED = f"""{SCORED}, gated AS (
    SELECT country, s1_id, target_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY country, s1_id) AS best FROM scored) WHERE best >= 0.5 AND prob >= 0.45)"""
ONE = "SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY country, target_id ORDER BY round(prob, 6) DESC, s1_id) AS place FROM {source}) WHERE place = 1"
MATCHED = f"{GATED}, matched AS ({ONE.format(source='gated')})"


def f05(tp: str, p: str, t: str) -> str:
    return f"CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {tp} = 0 THEN 0.0 ELSE 1.25 * ({tp} / {p}::DOUBLE) * ({tp} / {t}::DOUBLE) / (0.25 * ({tp} / {p}::DOUBLE) + {tp} / {t}::DOUBLE) END"


ENTITY = f"""spine AS (SELECT entity_id AS s1_id FROM rec WHERE entity_id LIKE 'S1-%'
), per AS (
    SELECT s1_id, (SELECT count(*) FROM matched m JOIN truth t USING (s1_id, target_id) WHERE m.s1_id = spine.s1_id) AS tp,
        (SELECT count(*) FROM matched m WHERE m.s1_id = spine.s1_id) AS n_pred, (SELECT count(*) FROM truth t WHERE t.s1_id = spine.s1_id) AS n_true FROM spine
), entity AS (SELECT *, round({f05("tp", "n_pred", "n_true")}, 6) AS f05 FROM per)"""


# similarity kernels

#: Small letters beyond ASCII, one to one to signs that no normal form holds: functions that go by bytes then go by letters.
BEYOND = "".join(chr(c) for c in range(0xDF, 0x100) if c not in (0xF7,)) + "œ"
INSTEAD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%()*+,-./:;<=>@"[: len(BEYOND)]


def by_letters(x: str) -> str:
    return f"translate({x}, '{BEYOND}', '{INSTEAD}')"


def levenshtein(a: str, b: str) -> str:
    return guarded(a, b, f"1 - levenshtein({by_letters(a)}, {by_letters(b)})::DOUBLE / greatest(length({a}), length({b}))")


def jaro_winkler(a: str, b: str) -> str:
    return guarded(a, b, f"jaro_winkler_similarity({by_letters(a)}, {by_letters(b)})")


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, the first of up to 126 letters: its places are bits of one integer."""
    bit = "1::HUGEINT << ({})::INT"
    full = f"(({bit.format(f'length({a}) - 1')}) - 1) * 2 + 1"
    mask = f"list_sum(list_transform(range(1, length({a}) + 1), lambda k: CASE WHEN substr({a}, k::INT, 1) = c THEN {bit.format('k - 1')} ELSE 0::HUGEINT END))"
    rows = f"list_prepend({full}, list_transform(string_split({b}, ''), lambda c: {mask}))"
    return f"""CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce({rows},
        lambda r, h: ((r + (h & r)) | (r - (h & r))) & ({full}))) END"""


def ratio(a: str, b: str) -> str:
    return f"2 * ({lcs(a, b)})::DOUBLE / (length({a}) + length({b}))"


def _best_window(short: str, long: str) -> str:
    window = f"substr({long}, (greatest(0, w) + 1)::INT, (w + length({short}) - greatest(0, w))::INT)"
    edge = f"CASE WHEN w + length({short}) <= length({long}) THEN right({window}, 1) ELSE left({window}, 1) END"
    places = f"list_filter(range(1 - length({short}), length({long})), lambda w: contains({short}, {edge}))"
    return f"coalesce(list_max(list_transform(list_transform({places}, lambda w: {window}), lambda v: {ratio(short, 'v')})), 0.0)"


def partial(a: str, b: str) -> str:
    """Of a shorter and a longer text, by columns ``a`` and ``b``."""
    return f"""CASE WHEN contains({b}, {a}) OR contains({a}, {b}) THEN 1.0 WHEN length({a}) < length({b}) THEN {_best_window(a, b)}
        WHEN length({a}) > length({b}) THEN {_best_window(b, a)} ELSE greatest({_best_window(a, b)}, {_best_window(b, a)}) END"""


def kernels(source: str, out: str, sides: dict[str, tuple[str, str]], which: tuple[str, ...] = ("jw", "sort", "set", "partial")) -> str:
    """Common table expressions: ``out`` is ``source`` with ``<prefix>_<kernel>`` for each pair of texts."""
    parts = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
    join = lambda x: f"array_to_string({x}, ' ')"
    one, two, three, four = [], [], [], []
    for p, (a, b) in sides.items():
        one += [f"{a} AS {p}_a, {b} AS {p}_b, list_sort({parts(a)}) AS {p}_x, list_sort({parts(b)}) AS {p}_y"]
        two += [f"list_distinct({p}_x) AS {p}_dx, list_distinct({p}_y) AS {p}_dy, list_sort(list_intersect({p}_x, {p}_y)) AS {p}_c"]
        rest = lambda d, c=f"{p}_c": join(f"list_sort(list_filter({d}, lambda t: NOT list_contains({c}, t)))")
        with_ = lambda d, p=p, rest=rest: f"CASE WHEN len({p}_c) = 0 THEN {rest(d)} ELSE {join(f'{p}_c')} || ' ' || {rest(d)} END"
        three += [f"{join(f'{p}_x')} AS {p}_sa, {join(f'{p}_y')} AS {p}_sb, {with_(f'{p}_dx')} AS {p}_wa, {with_(f'{p}_dy')} AS {p}_wb, length({join(f'{p}_c')}) AS {p}_n"]
        ends = f"2 * {p}_n::DOUBLE / ({p}_n + length({p}_wa)), 2 * {p}_n::DOUBLE / ({p}_n + length({p}_wb))"
        whole = f"len({p}_c) > 0 AND (len({p}_c) = len({p}_dx) OR len({p}_c) = len({p}_dy))"
        made = {
            "jw": jaro_winkler(f"{p}_a", f"{p}_b"), "sort": guarded(f"{p}_a", f"{p}_b", ratio(f"{p}_sa", f"{p}_sb")),
            "set": guarded(f"{p}_a", f"{p}_b", f"CASE WHEN {whole} THEN 1.0 WHEN len({p}_c) = 0 THEN {ratio(f'{p}_wa', f'{p}_wb')} ELSE greatest({ratio(f'{p}_wa', f'{p}_wb')}, {ends}) END"),
            "partial": guarded(f"{p}_a", f"{p}_b", partial(f"{p}_a", f"{p}_b")),
        }
        four += [f"{made[k]} AS {p}_{k}" for k in which]
    return f"""{out}_1 AS (SELECT *, {', '.join(one)} FROM {source}
), {out}_2 AS (SELECT *, {', '.join(two)} FROM {out}_1
), {out}_3 AS (SELECT *, {', '.join(three)} FROM {out}_2
), {out} AS (SELECT *, {', '.join(four)} FROM {out}_3)"""


# text in Unicode


def transliterated(x: str, table_: dict[int, str]) -> str:
    """By replacements, letters that become one sign in one go; what comes out is never looked up again."""
    single = {chr(c): v for c, v in table_.items() if len(v) == 1}
    gone = "".join(chr(c) for c, v in table_.items() if not v)
    out = f"translate({x}, '{''.join(single)}{gone}', '{''.join(single.values())}')"
    for c, v in table_.items():
        if len(v) > 1:
            out = f"replace({out}, '{chr(c)}', '{v}')"
    return out


def plain_unicode(x: str) -> str:
    """Without accents, lower case, ``&`` as a word, other signs as spaces."""
    return (
        f"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(strip_accents({x}))), '&', ' and '), "
        r"'[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def metaphone(word: str) -> str:
    """As published, sign by sign: each depends on the two before and the two after."""
    start = "CASE " + " ".join(f"WHEN starts_with(w, '{old}') THEN '{new}' || substr(w, {len(old) + 1})" for old, new in METAPHONE_STARTS) + " ELSE w END"
    at = lambda d: f"CASE WHEN i + {d} >= 1 THEN substr(x, (i + {d})::INT, 1) ELSE '' END"
    vowels, soft = "('A', 'E', 'I', 'O', 'U')", "('E', 'I', 'Y')"
    code = f"""CASE WHEN z.c = z.p AND z.c <> 'C' THEN '' WHEN z.c IN {vowels} THEN CASE WHEN z.i = 1 THEN z.c ELSE '' END
        WHEN z.c = 'B' AND z.n = '' AND z.p = 'M' THEN '' WHEN z.c = 'C' AND (z.n = 'H' OR z.n || z.m = 'IA') THEN 'X'
        WHEN z.c = 'C' AND z.n IN {soft} THEN CASE WHEN z.p = 'S' THEN '' ELSE 'S' END WHEN z.c = 'C' THEN 'K'
        WHEN z.c = 'D' THEN CASE WHEN z.n = 'G' AND z.m IN {soft} THEN 'J' ELSE 'T' END
        WHEN z.c = 'G' AND z.p = 'D' AND z.q <> 'D' AND z.n IN {soft} THEN '' WHEN z.c = 'G' AND z.n = 'H' AND z.m <> '' AND z.m NOT IN {vowels} THEN ''
        WHEN z.c = 'G' AND z.n = 'N' AND z.m = '' THEN '' WHEN z.c = 'G' THEN CASE WHEN z.n IN {soft} AND z.p <> 'G' THEN 'J' ELSE 'K' END
        WHEN z.c = 'H' THEN CASE WHEN z.n IN {vowels} AND z.p NOT IN ('C', 'S', 'P', 'T', 'G') THEN 'H' ELSE '' END
        WHEN z.c = 'K' THEN CASE WHEN z.p = 'C' THEN '' ELSE 'K' END WHEN z.c = 'P' THEN CASE WHEN z.n = 'H' THEN 'F' ELSE 'P' END
        WHEN z.c = 'Q' THEN 'K' WHEN z.c = 'S' THEN CASE WHEN z.n = 'H' OR z.n || z.m IN ('IO', 'IA') THEN 'X' ELSE 'S' END
        WHEN z.c = 'T' THEN CASE WHEN z.n = 'H' THEN '0' WHEN z.n || z.m IN ('IO', 'IA') THEN 'X' ELSE 'T' END WHEN z.c = 'V' THEN 'F'
        WHEN z.c IN ('W', 'Y') THEN CASE WHEN z.n IN {vowels} THEN z.c ELSE '' END WHEN z.c = 'X' THEN 'KS' WHEN z.c = 'Z' THEN 'S' ELSE z.c END"""
    signs = f"list_transform(range(1, length(x) + 1), lambda i: struct_pack(i := i, c := {at(0)}, p := {at(-1)}, q := {at(-2)}, n := {at(1)}, m := {at(2)}))"
    coded = f"list_transform([{start}], lambda x: array_to_string(list_transform({signs}, lambda z: {code}), ''))[1]"
    return f"list_transform([regexp_replace(upper(replace({word}, 'ß', 'ss')), '[^A-Z]', '', 'g')], lambda w: {coded})[1]"
