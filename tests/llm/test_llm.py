"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import io
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corefold.llm import ann, html_text, mixing, near_dup, packing, pii, quality, queries, token_files, url_filter, warc
from corefold.llm.common import connected, running_total, scratch_path
from corefold.llm.tokenizing import ChunkEncoder
from corefold.llm.words import Words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, `__key` int"
ODD = ["a b c d e f", None, "", "   \n\t", "x", "a b c d e f", "A B C D E F", "one two three four five six seven " * 3000, "é" * 5000, "w" * 70000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, exact repeats and columns that clash."""
    rows = [(i, t, ["en", None, "xx"][i % 3], ["s1", None, "s0"][i % 3], len(t or ""), "c", "c", 1) for i, t in enumerate(ODD)]
    rows += [rows[0], rows[0], (None, "no id here", "en", "s1", 10, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by 1").fetchall()


# what is shared


def test_connected_is_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    rows = [(k % 3 if k % 3 else None, k, k * 7 % 11) for k in range(200)]
    got = running_total(spark.createDataFrame(rows, "g int, k int, v int"), {"v": "before"}, [F.col("k").asc()], ("g",)).collect()
    for r in got:
        assert r["before"] == sum(v for g, k, v in rows if g == r["g"] and k < r["k"])
    assert len(got) == 200


def test_words_and_sets():
    texts = ["", None, "a", " A  b\n", "a b c d e", "a b c d e a b c d e é  x", "\x0b\x0c", "x\x1cy z"]
    w = Words(pa.array(texts))
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    for t, s in zip(texts, w.sets(5), strict=True):
        q = (t or "").encode().lower().split()
        assert len(s) == len({tuple(q[i : i + 5]) for i in range(max(1, len(q) - 4))}) * bool(q)


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_chunks_encode_as_whole_texts(name, kind):
    path = public_tokenizers.path(name)
    whole, chunked = Tokenizer.from_file(path), ChunkEncoder(path, kind, most=500)
    signs = [*"abZ1' \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　eéÉß中😀!<|Σς​İ=≠,.", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|END", "  ", "\n\n", "≠", "é", "the ", " and"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + [t for _, t, *_ in documents()[:60]] + ["x" * 5000, "= ̸", "a <|endoftext|> b"]
    for t in texts:
        assert np.frombuffer(chunked.ids(t), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


# 1: packing


def check_packing(rows, texts, capacity):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for doc, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[doc, k, at, len(ids[at : at + capacity]), zlib.crc32(np.asarray(ids[at : at + capacity], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_packing(spark, odd, none):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    n, total = check_packing(rows, [(d, t) for d, t, *_ in documents()], 4096)
    assert n <= -(-total // 4096) + 1
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd, path, capacity=50).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 50)
    assert packing.pack_documents(none, path).count() == 0


def test_genetic_algorithm_beats_its_start():
    rnd = random.Random(2)
    counts = collections.Counter(rnd.randint(1200, 1900) for _ in range(20000))
    p = packing.Packer(dict(counts), 4096, 7)
    first = p.first()
    best = [len(packing.Packer(dict(counts), 4096, 7).evolve([], 8, g)) for g in (0, 10, 100)]
    assert best[0] == len(first) > best[1] > best[2] >= p.least  # more generations, fewer sequences
    assert best[2] <= 0.98 * best[0]
    child = p.cross(first, p.varied())
    for bins in (first, child, p.evolve([], 8, 20)):
        assert collections.Counter(n for b in bins for n in b) == counts
        assert all(sum(b) <= 4096 for b in bins)
    easy = packing.Packer({10: 50, 90: 50}, 100, 1)
    assert len(easy.evolve([], 8, 10)) == easy.least == 50


def test_islands_and_migration_use_fewer_sequences(spark):
    rnd = random.Random(4)
    rows = [(i, 0, rnd.randint(1200, 1900)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    sequences = lambda **o: packing.pack(df, ("doc_id", "piece"), 4096, **o).select("sequence_id").distinct().count()
    start = sequences(islands=1, epochs=1, generations=0)
    one, many = sequences(islands=1, epochs=1, generations=20), sequences(islands=3, epochs=3, generations=60)
    assert many < one < start


def test_packing_in_shards(spark):
    rows = [(i, 0, 1 + (i * 37) % 99) for i in range(900)] + [(i, 1, 100) for i in range(20)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), ("doc_id", "piece"), 100, shard_items=200, islands=3).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted(rows)
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert len(by) <= 1.03 * sum(r[2] for r in rows) / 100 + 5


# 2: mixing


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        whole = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / whole >= most * sizes[s]]
        if not over or not total:
            return {s: most * sizes[s] if s in stopped else rest * weight[s] / whole if whole else 0 for s in names}
        stopped |= set(over)


def test_mixing(spark, odd, none):
    rows = queries.op2_source_mixing(spark, SF).collect()
    size = {d: len(WORD.findall(t or "")) for d, t, *_ in documents()}
    sizes = collections.Counter()
    for d, _, _, s in documents():
        sizes[s] += size[d]
    want, taken = brute_targets(sizes, (5, 2, 1), 3), collections.Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, queries.op2_source_mixing(spark, SF).collect()))
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0


def test_mixed_texts_hold_what_is_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = collections.Counter()
    whole = {d: t for d, t, *_ in documents()}
    for r in mixing.mixed_texts(docs).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert whole[r["doc_id"]].startswith(r["text"])
    assert words == collections.Counter({d: n for d, n in taken.items() if n})


@pytest.mark.parametrize("few", [0, 100])
def test_targets_stop(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(brute_targets(sizes, (5, 2, 1), 3))


def test_targets_of_any_sizes():
    rnd = random.Random(13)
    for _ in range(200):
        sizes = {rnd.choice([f"s{k}", f"é{k}", None]): rnd.choice([0, 1, 7, 100, 5000]) for k in range(rnd.randint(0, 9))}
        got = {s: t for s, _, t in mixing.targets_of(list(sizes.items()), (5, 2, 1), 3)}
        assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 3) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_quality_draws_better_documents_first(spark):
    rows = [(i, "clean words of prose " * 5 if i % 2 else "a# b$ c% d& e* f| g< " * 3, "s%d" % (i % 3)) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1, 9)).where("part > 0").groupBy((F.col("doc_id") % 2).alias("clean")).count().collect()
    n = {r["clean"]: r["count"] for r in got}
    assert n[1] > 1.3 * n[0]


# 3: token files


def test_token_files(spark, odd, none):
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: tuple(r) for r in queries.op3_token_files(spark, SF).collect()}
    for d, text, *_ in documents():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[d] == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for df in (odd, none):
        folder = scratch_path(spark, "tok")
        files = token_files.write_token_files(df, folder, public_tokenizers.path("byte_bpe_50k.json")).collect()
        read = lambda **split: sorted(map(tuple, token_files.read_token_files(spark, folder, [(r["file"], r["n_tokens"]) for r in files], **split).collect()), key=lambda r: r[1])
        rows = read()
        assert read(split_ids=1000) == rows
        assert len(rows) == df.count()
        assert [r[1] for r in rows] == np.cumsum([0, *[r[2] for r in rows]])[:-1].tolist()[: len(rows)]
        assert [r[0] for r in rows] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, 1000) == ids).all()
    out = io.BytesIO()
    w = token_files.Writer(out, bits, block=64)
    cuts = [0, 10, 10, 500, 1000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        w.add(k or None, ids[a:b])
    w.close()
    r = token_files.Reader(pa.BufferReader(out.getvalue()))
    assert (r.ids(123, 777) == ids[123:777]).all()
    want = [(k or None, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert list(r.documents(ids_at_once=100)) == want
    for split in (1, 7, 400):
        assert [x for lo in range(0, 1000, split) for x in r.documents(first=lo, stop=lo + split) if x[2]] == [x for x in want if x[2]]
    assert token_files.bits_for(50257) == 16


# 4: personal data


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15],
    }


def test_personal_data(spark, odd, none):
    rnd = random.Random(3)
    signs = ["1", "2", "4111 1111 1111 1111", "4242-4242-4242-4242", " ", "-", ".", "+", "(", ")", "a", "@", "é", "😀", "", "255", "256", "x.y", "_", "%", "\n",
             "10.0.0.1", "call me at 212-555-1234", "+49 30 1234567", "bob@ex.com", " ssn 123-45-6789 ", "joe (at) mail (dot) com"]
    texts = [t for _, t, *_ in documents()] + [None, ""] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(600)]
    texts += ["1" * 3000 + " " + "a" * 50000 + "@" + "b." * 2000 + "c", "4" * 40, "+1 (((((((((555", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "0001.2.3.000", "é 10.0.0.1 a@b.cd x " * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(df).collect():
        want = brute_spans(texts[r["doc_id"]] or "")
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in want[k])
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [len(want[k]) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)
    assert pii.digest(odd).count() == odd.count()
    assert pii.digest(none).count() == 0


def iban(rnd):
    body = "37040044" + "".join(rnd.choice("0123456789") for _ in range(10))
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def planted(rnd, n):
    """Texts with one span each of a further kind, true or false, and the span."""
    d = lambda k: "".join(rnd.choice("123456789") for _ in range(k))
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    pick = rnd.choice
    filler = lambda: " ".join(pick("river window table morning simple paper green under yellow little stone market".split()) for _ in range(rnd.randint(6, 12)))
    made = {
        "national": (lambda: pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(f"{rnd.randint(2, 9)}1{d(1)}", f"{rnd.randint(2, 9)}{d(2)}", d(4)),
                     ["call me at {}", "Tel. {}", "my mobile is {} after six", "fax: {}", "{} (phone)"], ["order no. {}", "invoice {}", "serial {}", "part {}", "the ratio was {}/7"]),
        "ssn": (lambda: f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}", ["SSN {}", "social security number: {}", "ssn is {}, he said"], ["isbn {}", "item {}", "model {} in blue", "version {}"]),
        "address": (lambda: f"{pick(['joe', 'ann.b', 'info'])} {pick(['(at)', '[at]'])} mail{d(1)} {pick(['(dot)', '[dot]'])} {pick(['com', 'org', 'de'])}", ["write {} now", "contact {}", "mail to {}"], []),
        "iban": (lambda: iban(rnd), ["pay to {}", "account {}", "IBAN: {}", "transfer it to {} today"], []),
        "ipv6": (lambda: f"2001:db8:{hexa(4)}::{hexa(2)}", ["the server {} answers", "ping {}", "host {}"], []),
        "street": (lambda: f"{rnd.randint(1, 300)} {pick(['Baker', 'Green', 'Old Mill'])} {pick(['Street', 'Road', 'Lane'])}", ["she lives at {} now", "my address: {}", "ship it to {}"], []),
        "name": (lambda: f"{pick(['Mary', 'Thomas', 'Julia', 'Peter'])} {pick(['Miller', 'Schmidt', 'Jones', 'Keller'])}", ["my name is {}", "Dear Mr. {}", "regards, signed {}", "the patient {} came"], ["the {} Museum", "the {} University is old"]),
        "secret": (lambda: hexa(40), ['token = "{}"', "api_key: {}", "password={}"], ["commit {} fixes it", "checksum {}", "sha1 {}"]),
    }
    false = {"iban": lambda: f"AB{d(2)} {d(4)} {d(4)} {d(4)}", "ipv6": lambda: f"{d(1)}2:{d(1)}4:{d(1)}5", "secret": lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"}
    texts, truth = [], []
    for _ in range(n):
        kind = pick(list(made))
        value, good, bad = made[kind]
        yes = rnd.random() < 0.5 or not (bad or kind in false)
        if yes or (bad and rnd.random() < 0.7) or kind not in false:
            v, frame = value(), pick(good if yes else bad)
        else:
            v, frame = false[kind](), pick(["model {}", "at time {}", "id {}", "uuid {}"])
        head = filler() + " "
        texts.append(head + frame.format(v) + " " + filler())
        truth.append((kind, yes, len(head) + frame.index("{}"), len(head) + frame.index("{}") + len(v)))
    return texts, truth


def test_classifier_on_held_out_spans(spark):
    texts, _ = planted(random.Random(1), 1500)
    schema = "doc_id long, text string"
    model = pii.fit(pii.scan(spark.createDataFrame(list(enumerate(texts)), schema)))
    texts, truth = planted(random.Random(2), 1500)
    scanned = pii.scan(spark.createDataFrame(list(enumerate(texts)), schema))
    right, hits, misses, wrong = 0, collections.Counter(), collections.Counter(), collections.Counter()
    for r in pii.find(scanned, model).select("__row.doc_id", "spans").collect():
        kind, yes, start, end = truth[r["doc_id"]]
        got = {(s["kind"], s["start"], s["end"]) for s in r["spans"]}
        found = any(k == kind and a < end and start < b for k, a, b in got)
        right += found == yes
        (hits if found and yes else misses if yes else wrong if found else collections.Counter())[kind] += 1
    assert right >= 0.93 * len(texts), (hits, misses, wrong)
    assert set(hits) == set(pii.MORE_KINDS)
    assert not any(misses[k] > hits[k] / 4 for k in hits), (hits, misses)
    # the weights decide: without what was learnt nothing is accepted, and a lower threshold accepts more
    count = lambda m, t: pii.find(scanned, m, threshold=t).selectExpr("sum(size(spans) - size(base_spans)) AS n").first()["n"]
    at_most, at_least = count(model, 0.99), count(model, 0.05)
    assert count(pii.Model(), 0.8) == 0
    assert at_most < sum(hits.values()) + sum(wrong.values()) < at_least


def test_further_spans(spark):
    noise, _ = planted(random.Random(3), 800)
    want = {
        "call me at 212-555-1234 today": "national:11:23", "Phone: (415) 555-2671": "national:7:21", "order no. 212-555-1234": "",
        "my ssn is 123-45-6789.": "ssn:10:21", "isbn 123-45-6789": "", "write joe (at) mail (dot) com now": "address:6:29", "mail bob@ex.com": "email:5:15",
        "pay DE89 3704 0044 0532 0130 00 now": "iban:4:31", "mail 212-555-1234@ex.com": "email:5:24", "at 12:30:45": "", 'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" x': "secret:9:49",
    }
    rows = [*enumerate(want), *((100 + i, t) for i, t in enumerate(noise))]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_base_spans_vote(spark):
    texts = [f"mail a{i}@ex.com from 10.0.0.{i} or +49 30 123456{i}" for i in range(20)]
    scanned = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = pii.fit(scanned)
    assert set(model.priors) == {"email", "ip", "phone"}
    assert all(model.priors[k] > 0.5 for k in ("email", "phone"))


def test_em_finds_reliable_labelers():
    rnd = random.Random(5)
    rates = [(0.9, 0.3), (0.8, 0.3), (0.85, 0.1)]
    table, truth = collections.Counter(), collections.Counter()
    for _ in range(20000):
        y = rnd.random() < 0.4
        marks = tuple([1 if rnd.random() < (t if y else f) else -1 for t, f in rates] + [0] * (len(pii.LABELERS) - 3) + [0] * len(pii.SHAPES))
        table["ssn", marks] += 1
        truth[marks] += y
    model = pii.learn(sorted((k, m, n) for (k, m), n in table.items()))
    for (t, f), (a, b) in zip(rates, model.rates["ssn"], strict=False):
        assert a == pytest.approx(t, abs=0.08)
        assert b == pytest.approx(f, abs=0.08)
    right = sum(truth[m] if model.score("ssn", m) > 0 else n - truth[m] for (_, m), n in table.items())
    assert right / 20000 > 0.85


def test_places_in_linear_time(spark):
    text = "a@b.cd +49 30 123456 " * 30000
    want = [(21 * k, 21 * k + 6) for k in range(30000)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    r = pii.digest(docs).first()
    assert (r["n_email"], r["n_phone"]) == (30000, 30000)
    assert r["base_sha256"] == hashlib.sha256(",".join([*(f"email:{a}:{b}" for a, b in want), *(f"phone:{a + 7}:{a + 20}" for a, _ in want)]).encode()).hexdigest()
    assert pii.redact(docs).first()["text"] == "[EMAIL] [PHONE] " * 30000
    assert time.time() - started < 60


def test_redaction(spark):
    rows = [(1, "x bob@ex.com y +1 (017) 555-7713, 10.0.0.1"), (2, None), (3, "clean\ntext"), (4, "4111 1111 1111 1111")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "x [EMAIL] y [PHONE], [IP]", 2: None, 3: "clean\ntext", 4: "[CARD]"}


def test_personal_data_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = pii.digest(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5: main text


def test_main_text_of_pages(spark):
    got = {r["page_id"]: r for r in queries.op5_main_text(spark, SF).collect()}
    import html

    for page, url, text in duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", text, re.S).group(1)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, want, len(want))


def test_main_text_without_marks():
    page = (
        '<html><head><title>T</title></head><body><div class="menu"><a href=x>Home</a> | <a href=y>News</a></div><div id="content"><h2>Title here</h2>'
        "<p>First &lt;para&gt; of text that is long enough to be an article, said  \n she.</p><p>Second paragraph that is also fairly long, with <b>bold</b> and <i>it</i>.</p>"
        '<div class="ad">Buy now! Great offers all over the place for you today.</div><p>Third paragraph after the advert with many more words in it.</p></div>'
        '<div class="comments"><p>I am a reader and comment at length on this article here.</p></div><form>Name <input> <p>long text in a form that goes on</p></form><footer>c 2020</footer>'
    )
    assert html_text.main_text(page) == (
        "Title here\nFirst <para> of text that is long enough to be an article, said she.\n"
        "Second paragraph that is also fairly long, with bold and it.\nThird paragraph after the advert with many more words in it."
    )
    assert html_text.main_text('<div class="page has-sidebar"><p>text of the page</p><div class="cookieNotice">we use cookies</div></div>') == "text of the page"
    for text, want in ((None, ""), ("", ""), ("<p>short", "short"), ("plain text", "plain text"), ("<", "<"), ("<script>x", ""), ("<!-- x", ""), ("<nav>a</nav>", "")):
        assert html_text.main_text(text) == want


LONG = "{} paragraph of an article, with more than enough words in it to count as text of the page and no link."


def test_ranges_decide_inside_marks():
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(4))
    page = (
        f"<main><div class=top><ul>{links}</ul><p>All our topics</p></div><div class=text><p><a href=x>Town</a></p><h1>A title</h1><p>{LONG.format('First')}</p><ul>{links}</ul>"
        f"<p>{LONG.format('Second')}</p><ul>{links}</ul><p>A short end.</p></div><div class=low><ul>{links}</ul><p>Made in 2020</p><ul>{links}</ul></div></main><p>{LONG.format('Outer')}</p>"
    )
    between = [f"Link number {k}" for k in range(4)]
    assert html_text.main_text(page).split("\n") == ["Town", "A title", LONG.format("First"), *between, LONG.format("Second"), *between, "A short end."]
    flat = f"<main><ul>{links}</ul><p>{LONG.format('First')}</p><p><a href=x>Source</a></p><ul>{links}</ul></main>"
    assert html_text.main_text(flat) == LONG.format("First")
    two = f"<article><p>{LONG.format('First')}</p></article><ul>{links}</ul><article><p>{LONG.format('Second')}</p><p><a href=x>Source</a></p></article>"
    assert html_text.main_text(two).split("\n") == [LONG.format("First"), LONG.format("Second"), "Source"]


def test_all_ranges_of_a_container():
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(4))
    advert = "<div class=ad><p>Buy this.</p><p>Buy that.</p><p>Buy it all.</p></div>"
    first, second, third = (f"<p>{LONG.format(x)}</p>" for x in ("First", "Second", "Third"))
    between = [f"Link number {k}" for k in range(4)]
    legal = f"<ul>{links}</ul><div class=legal><p>{LONG.format('Legal')}</p></div>"
    want = [LONG.format("First"), LONG.format("Second"), *between, LONG.format("Third"), "The end."]
    page = f"<div class=x><ul>{links}</ul></div><div class=text>{first}{advert}{second}<ul>{links}</ul>{third}{advert}<p>The end.</p></div>{legal}"
    assert html_text.main_text(page).split("\n") == want
    assert html_text.main_text(f"<body><ul>{links}</ul>{first}{advert}{second}<ul>{links}</ul>{third}{legal}</body>").split("\n") == want[:-1]
    parts = "".join(f"<div class=part>{x}</div><ul>{links}</ul>" for x in (first, second, third))
    got = html_text.main_text(f"<div class=page><div class=text>{parts}</div>{legal}</div>").split("\n")
    assert got == [LONG.format("First"), *between, LONG.format("Second"), *between, LONG.format("Third")]
    boxed = f"<article>{first}<div class=box><ul>{links}</ul></div>{second}</article>"
    assert html_text.main_text(boxed).split("\n") == [LONG.format("First"), *between, LONG.format("Second")]


def test_names_inside_the_article():
    body = "".join(f"<p>{LONG.format(x)}</p>" for x in ("First", "Second"))
    lines = [LONG.format("First"), LONG.format("Second")]
    kept = '<div class="entry-header"><h2>Sub</h2></div>' + body + '<p class="share-price">Shares fell to 12.50.</p><p class="ad-hoc">An ad-hoc note.</p><p id="comment-worthy">Said twice.</p>'
    away = "".join(f'<div class="{c}"><p>{LONG.format("Away")}</p></div>' for c in ("post-comments", "share-buttons", "related-posts", "site-footer", "newsletter-signup", "ad", "googleAds", "wp-comments", "page-header"))
    want = ["Sub", *lines, "Shares fell to 12.50.", "An ad-hoc note.", "Said twice."]
    assert html_text.main_text(f"<article>{kept}{away}</article>").split("\n") == want
    teaser = "<article><h3><a href=x>Other news</a></h3><p>This is what another page has to say, in a sentence or two, so that you read on there now.</p></article>"
    assert html_text.main_text(f"<main><article>{body * 4}</article>{teaser * 3}</main>").split("\n") == lines * 4
    equal = f"<article><p>{LONG.format('Third')}</p><p><a href=x>Source</a></p></article>"
    assert html_text.main_text(f"<article>{body}</article>{equal}").split("\n")[2] == LONG.format("Third")


def test_quoted_values_of_any_length():
    for n in (1000, 3000, 200_000):
        value = "a>" * n
        for q in ('"', "'"):
            assert html_text.main_text(f"<p data-x={q}{value}{q}>Hello world, this is the text.</p><p title=5' >and more</p>") == "Hello world, this is the text.\nand more"
    assert html_text.main_text('<p title="open>Hello world, this is all the text.</p><p>And more of it</p>') == "Hello world, this is all the text.\nAnd more of it"
    started = time.time()
    for page in ('<a x="' * 100_000, '<a x="\'>' * 100_000, "<p title=5\">x</p>" * 50_000, '<a x="' + "<b y='" * 50_000 + '">', "<a =" * 100_000 + ">"):
        html_text.main_text(page)
    assert time.time() - started < 20


def test_window_and_surge_decide_on_marked_pages():
    links = "".join(f"<li><a href=x>Link number {k}</a></li>" for k in range(4))
    page = f"<main><div class=a><p>{LONG.format('First')}</p><p>{LONG.format('Second')}</p></div><ul>{links}</ul><div class=b><p>{LONG.format('Third')}</p></div></main>"
    texts = {k: html_text.main_text(page, *k).split("\n") for k in ((3, 80), (3, 150), (1, 10**6))}
    assert [x for x in texts[3, 80] if not x.startswith("Link")] == [LONG.format(x) for x in ("First", "Second", "Third")]
    assert texts[3, 150] == [LONG.format(x) for x in ("First", "Second")]  # the third paragraph alone doesn't surge
    assert LONG.format("Third") not in texts[1, 10**6]


def test_main_text_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>a"), (2, "u", "<p>a"), (2, "u", "<p>a")]
    got = html_text.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    assert sorted(map(str, got.collect())) == sorted(f"Row(page_id={p}, url={u!r}, text={'a' if h else ''!r}, n_chars={1 if h else 0})" for p, u, h in rows)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 6: nearest neighbours


def brute_nearest(rows, k):
    x = {i: np.asarray(v, np.float64) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    return {q: sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in x.items() if i != q)[:k] for q in x if q % 100 == 0}


def test_nearest_vectors(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want = brute_nearest(rows, 10)
    got = collections.defaultdict(list)
    for r in queries.op6_nearest_vectors(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_vectors_of_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.2 * rng.normal(size=(6000, 16))).astype("f4")
    x[1000:3000] = x[1000]  # a third of all rows have one vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = brute_nearest(rows, 10)
    got = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [i for _, i in got[1100]] == list(range(1000, 1010))


def test_nearest_vectors_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (200, None), (None, [1.0, 2.0])]
    got = ann.search(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"))
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [
        (0, 1, 1, 0.0), (0, 2, 100, 1.0), (0, 3, 2, pytest.approx(2**0.5)), (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0),
    ]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_of_entries_and_searches(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nearest = lambda: [tuple(r) for r in ann.search(df, every=5, recall=1.0).orderBy("query_id", "rank").collect()]
    whole = nearest()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 48 * 20)
    monkeypatch.setattr(ann, "BLOCK_SEARCHES", 30)
    monkeypatch.setattr(ann, "BROADCAST_SEARCHES", 10)
    assert nearest() == whole
    assert len(whole) == 3000


def test_repeated_vector_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 2)]
    assert ann.search(spark.createDataFrame([*rows, rows[0], rows[2]], "vec_id long, embedding array<double>"), k=1).collect() == got


def test_walk_is_in_order():
    rng = np.random.default_rng(0)
    index = ann.Index(rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), np.ones(49, np.int64), 49)
    q = rng.normal(size=8)
    d = [((index.first[c // 7] - q[:4]) ** 2).sum() + ((index.second[c % 7] - q[4:]) ** 2).sum() for c in index.walk(q)]
    assert len(d) == 49
    assert d == sorted(d)


# 7: WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/é x", "<p>é"), (3, None, "<p>é"), (9, "u", None), (1, "u", ""), (None, "u", "<p>é"), (7, "u", "x" * 300000), (8, "u", "\x1f\x8b\x08 WARC/1.1")]
    folder = f"file://{tmp_path}/warc"
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, revisit int")
    files = warc.write_archives(df, folder).collect()
    for split in (64, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archives(spark, folder, [(r["file"], r["size"]) for r in files], split_bytes=split).collect()}
        assert len(got) == len(rows)
        for page, _, text in rows:
            data = (text or "").encode()
            assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert {p: r["refers_to"] for p, r in got.items()} == {5: 3, 3: None, 9: 1, 1: None, None: 3, 7: None, 8: None}
        assert got[7]["payload"] == b"x" * 300000
        assert got[5]["record_type"] == "revisit"
        assert got[5]["payload"] is None
    small = f"file://{tmp_path}/small"
    files = warc.write_archives(df, small, least_bytes=10).collect()
    got = warc.read_archives(spark, small, [(r["file"], r["size"]) for r in files]).collect()
    assert {r["record_type"] for r in got} == {"response"}
    empty = f"file://{tmp_path}/empty"
    files = warc.write_archives(df.limit(0), empty).collect()
    assert warc.read_archives(spark, empty, [(r["file"], r["size"]) for r in files]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))


# 8: near-duplicates


def brute_components(texts, num=85, den=100):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and min(len(a), len(sets[j])) * den >= max(len(a), len(sets[j])) * num and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_near_duplicates(spark, monkeypatch):
    rnd = random.Random(8)
    base = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 6) for _ in range(120)) for _ in range(4)]
    texts = [t for _, t, *_ in documents()]
    for _ in range(150):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rnd.randrange(len(w))] = "new" + str(rnd.randrange(9999))
        texts.append(" ".join(w))
    texts += [None, "", "  ", "a b", "A  B", "a b c d e", "a b c d e f"]
    want, sizes = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for nodes in (near_dup.BLOCK_NODES, 20, 7):
        monkeypatch.setattr(near_dup, "BLOCK_NODES", nodes)
        monkeypatch.setattr(near_dup, "BROADCAST_NODES", 0 if nodes == 20 else 250_000)
        got = {r["doc_id"]: r for r in near_dup.near_duplicates(df).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_odd_rows(spark, odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[0] == {(0, True)}
    assert by[5] == by[6] == {(0, False)}
    assert by[1] == {(1, True)}
    assert by[None] == {(None, True)}
    assert near_dup.near_duplicates(none).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, None), (4, "x y"), (1, "other text with the same id"), (5, "other text with the same id"), (None, "x y")]
    got = near_dup.drop(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a b c d e f g"), (3, None), (3, None), (4, "x y"), (1, "other text with the same id")]))


def test_bitmap_leaves_what_is_wanted(spark):
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    wanted = texts.where("doc_id % 10 = 0").select(F.col("text_hash").alias("hash"))
    left = {r["doc_id"] for r in near_dup._maybe(texts, wanted).collect()}
    assert left >= set(range(0, 3000, 10))
    assert len(left) < 310


def test_band_widths():
    for least in (0.5, 0.8, 0.85, 0.9):
        r = near_dup.band_rows(least)
        assert near_dup.REGISTERS % r == 0
        assert (1 - least**r) ** (near_dup.REGISTERS // r) <= near_dup.MOST_MISSED
    assert near_dup.band_rows(0.85) == 7


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.7, 0.9):
        n = 2000
        both = int(round(2 * n * j / (1 + j)))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - both : 2 * n - both]
        r = near_dup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert (r[0] == r[1]).mean() == pytest.approx(j, abs=0.1)
        merged = near_dup.registers(np.concatenate([a, b]), np.array([0, 2 * n]))
        assert (merged[0] == np.maximum(r[0], r[1])).all()
        counts = [np.array([x], float) for x in ((r[0] > r[1]).sum(), (r[0] < r[1]).sum(), (r[0] == r[1]).sum())]
        assert near_dup.ruled_out(*counts, np.array([0.5]), 0.85)[0] == (j < 0.8)


# 9: quality rules


def test_quality(spark, odd, none):
    path = queries.quality_vocabularies()
    texts = [t for _, t, *_ in documents()] + ["a b c d e a b c d e a b c d e x y z w v", "l one\nl one\n \n\nl one\nl two", "a b " * 3, "#*$%&|<>é é\x1c x"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.measure(df, path).collect():
        t = texts[r["doc_id"]]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen, cover = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for k in range(len(w) - 4):
            if seen[tuple(w[k : k + 5])] > 1:
                cover |= set(range(k, k + 5))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"])
    assert quality.measure(odd, path).count() == odd.count()
    assert quality.measure(none, path).count() == 0
    kept = {r["doc_id"] for r in quality.measure(df, path).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(df, path).collect()} == kept


def test_fertility_bands(spark):
    rnd = random.Random(1)
    good = "The committee met on Tuesday to discuss the plans for the new library, and most of those present agreed that the site near the river would serve the town well."
    odd = " ".join("".join(chr(rnd.randrange(0xA000, 0xA400)) for _ in range(5)) for _ in range(40))
    runs = " ".join("ab"[k % 2] * (k + 2) for k in range(30))
    rows = [(1, good, "en"), (2, odd, "en"), (3, "".join(rnd.choice("abcdefghij") for _ in range(9)) + " " + " ".join("=" * k for k in range(1, 90)), "en"), (4, good, None), (5, runs, "en")]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.quality_vocabularies()).collect()}
    assert got[1]["kept"]
    assert got[4]["kept"]
    assert got[4]["band"] == "latin"
    assert not got[2]["kept"]
    assert got[2]["byte_share"] > 0.9
    assert not got[3]["kept"]


PROSE = {
    "en": "The committee met on Tuesday to discuss the plans for the new library, and most of those present agreed that the site near the river would serve the town well. Work should begin next spring if the council finds the money.",
    "de": "Der Ausschuss traf sich am Dienstag, um über die Pläne für die neue Bibliothek zu sprechen, und die meisten Anwesenden waren sich einig, dass der Platz am Fluss der Stadt gut dienen würde. Die Arbeiten sollen im Frühjahr beginnen, wenn genug Geld da ist.",
    "fr": "Le comité s'est réuni mardi pour discuter des projets de la nouvelle bibliothèque, et la plupart des personnes présentes ont convenu que le terrain près de la rivière conviendrait bien à la ville. Les travaux commenceront au printemps si le conseil trouve l'argent.",
    "es": "El comité se reunió el martes para hablar de los planes de la nueva biblioteca, y la mayoría de los presentes estuvo de acuerdo en que el terreno cerca del río serviría bien al pueblo. Las obras empezarán en primavera si el ayuntamiento encuentra el dinero.",
}


def test_bands_reject_what_is_planted(spark):
    rnd = random.Random(9)
    word = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
    rows, n = [], 0
    for lang, text in PROSE.items():
        junk = {
            "clean": text,
            "gibberish": " ".join(word("abcdefghijklmnopqrstuvwxyz", rnd.randint(3, 9)) for _ in range(60)),
            "base64": " ".join(base64.b64encode(rnd.randbytes(45)).decode() for _ in range(40)),
            "other script": " ".join(word("абвгдежзийклмнопрстуфхцчшщъыьэюя", rnd.randint(3, 9)) for _ in range(60)),
            "hex": " ".join(rnd.randbytes(8).hex() for _ in range(50)),
            "one word": " ".join(["spam" + "!" * (k % 7) for k in range(80)]),
        }
        for what, x in junk.items():
            rows.append((n := n + 1, x, lang, what))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, what string")
    got = {r["doc_id"]: r["kept"] for r in quality.measure(df, queries.quality_vocabularies(), most_repeated=100).collect()}
    assert {(lang, what): got[k] for k, _, lang, what in rows} == {(lang, what): what == "clean" for _, _, lang, what in rows}
    loose = {k: quality.Band(0, 99, 1, 0) for k in quality.BANDS}  # the bands decide: without them all stay
    assert quality.measure(df, queries.quality_vocabularies(), most_repeated=100, bands=loose).where("kept").count() == len(rows)
    assert quality.measure(df.withColumn("lang", F.lit(None)), queries.quality_vocabularies()).where("band <> 'latin'").count() == len(PROSE)


def test_bands_reject_what_is_labelled_bad(spark):
    good = PROSE["en"]
    table = "Thndou | erhaha | eaernd | ertible | erheble | eronin | eredble | aninou | shingou | thinor | " + " | ".join(f"th{a}nd{b}" for a in "aeiou" for b in "rstln")
    rows = [(1, good + " " + good.replace("library", "school"), "en"), (2, table, "en"), (3, "Please call +1 (984) 555-5227 or 224.228.19.86 before noon, it is for the Friday meeting.", "en")]
    got = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.quality_vocabularies(), most_repeated=100).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3)] == [True, False, True]
    sf = "/root/testdata/sf0.1"  # the smaller tables have next to no bad documents in French and Spanish
    judged = queries.op9_quality_rules(spark, sf).where("NOT base_failed AND n_words >= 30").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        of = {label: [not r["kept"] for r in judged if r["quality"] == label and r["band"] == lang] for label in (0, 1)}
        assert sum(of[0]) > 0.9 * len(of[0]), lang
        assert sum(of[1]) < 0.03 * len(of[1]), lang


# 10: URL filter


def test_url_filter(spark):
    rows = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    rows += [(10**6 + k, u) for k, u in enumerate([None, "", "no scheme", "HTTP://WWW.Example.COM/en/7x?y", "x://example.com/en/8", "a://net/de/", "a://b.net/DE/", "a://example.net/de/8#x", "a://notexample.com/fr/", "a://"])]
    rows += [rows[0]]
    got = url_filter.judge(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, host int"), public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for page, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        want[page, host, path, best[0], best[1]] += 1
    have = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got.collect())
    assert have == want
    assert {r["verdict"] for r in got.where("rule is null and host = ''").collect()} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_url_rules_have_the_words_of_the_contract(spark):
    assert set(url_filter.RULES) == {("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")}
    want = {
        "a://x.com/en/1": ("com/en/", "block"), "a://www.example.com/en/70": ("example.com/en/7", "allow"), "a://net/de/": ("net/de/", "allow"), "a://b.net/de/casino-poker": ("net/de/", "allow"),
        "a://example.net/de/7": ("net/de/", "allow"), "a://www.example.net/de/8?x": ("example.net/de/8", "block"), "a://b.org/es/": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = url_filter.judge(pages, public_tokenizers.path("word_bpe_49k.json")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == list(want.values())
    found = queries.op10_url_filter(spark, SF).where("rule = 'net/de/'").select("verdict").collect()
    assert [r["verdict"] for r in found] == ["allow"] * 5


def test_segments_and_held_out_hosts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = url_filter.Segmenter.from_vocabulary(path)
    assert cut("freebetsonline") == ("free", "bets", "online")
    assert cut("universitylibrary") == ("university", "library")
    assert "".join(cut("q" * 300)) == "q" * 300
    model = url_filter.fit(spark.read.parquet(f"{SF}/pages.parquet"), path)
    block = "casinowin.com onlinebetting.net cheapviagrapills.org adultcams.tv luckyslotsjackpot.com xxxporn.net freewarezcracks.org adtracker.io".split()
    allow = "therecipesblog.com universitylibrary.org gardenbooks.net weatherforecast.com cityhistorymuseum.org musicschool.edu ththth.net bikerepairguide.com".split()
    right = sum(model.score(url_filter.tokens(h, "/en/12.html", cut)) > 0 for h in block) + sum(model.score(url_filter.tokens(h, "/en/12.html", cut)) <= 0 for h in allow)
    assert right >= 14
    score = lambda host, path: model.score(url_filter.tokens(host, path, cut))
    bad = "/online-casino/poker /freeporn/videos.html /cheapviagrapills /play/luckyslots-jackpot /keygen-crack-download /payday/loans /adtracker/clicks /xxxcams/7".split()
    good = "/recipes/kitchen /museum-history/garden /weatherforecast/12.html /universitylibrary/books /en/12.html /city/health-support /schoolmusic/lesson /article/2020/page3".split()
    for host in ("example.com", "www.site7.org", "blog.neutral.net"):
        assert sum(score(host, x) > 0 for x in bad) >= 7, [(x, score(host, x)) for x in bad]
        assert sum(score(host, x) <= 0 for x in good) >= 7, [(x, score(host, x)) for x in good]
    # the model decides: without its odds, or on a prior of its own, the same addresses are judged otherwise
    pages = spark.createDataFrame([(k, f"http://example.fr{x}") for k, x in enumerate(bad)], "page_id long, url string")
    verdicts = lambda m: [r["verdict"] for r in url_filter.judge(pages, path, model=m).orderBy("page_id").collect()]
    assert verdicts(model).count("block") >= 7
    assert verdicts(url_filter.Bayes({}, 0.0, model.prior)).count("block") == 0


# the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, SF)
    judged = {r["doc_id"]: r["kept"] for r in quality.measure(docs, queries.quality_vocabularies()).collect()}
    assert {r["doc_id"] for r in good.collect()} == {d for d, k in judged.items() if k}
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    roots, _ = brute_components([t for _, t in rows], 80)
    single = corpus_pipeline.drop_near_duplicates(spark, good, SF)
    assert sorted(r["doc_id"] for r in single.collect()) == [rows[i][0] for i, r in enumerate(roots) if r == i]
    safe = corpus_pipeline.redact_personal_data(spark, single, SF)
    assert safe.columns == list(corpus_pipeline.COLUMNS)
    assert safe.count() == single.count()
    assert all(not any(brute_spans(r["text"]).values()) for r in safe.collect())
    mixed = corpus_pipeline.mix_sources(spark, safe, SF)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mixed.collect()], 4096)


def test_pipeline_runs(spark):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), SF).count() == 0
    assert corpus_pipeline.keep_good(spark, odd.select(*corpus_pipeline.COLUMNS), SF).count() == 0  # all are short or repeat themselves
    en, de, fr, es = (PROSE[k] for k in ("en", "de", "fr", "es"))
    rows = [(1, en, "en", "s1", 9), (1, en, "en", "s1", 9), (1, en, "en", "s1", None), (2, de, None, None, None), (3, None, "en", "s1", None), (4, "", None, "s1", 0), (5, en.upper(), "en", None, 9),
            (None, fr + " Call +49 30 1234567.", "fr", None, None), (None, None, None, None, None), (6, es, "es", "s0", 1), (2, fr, "fr", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    by = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert by(good) == sorted((r for r in rows if r[1]), key=str)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    # of the three equal ids and texts the one with the least other columns; the French text without an id goes for the one with an id; rows without words stay
    want = [rows[2], rows[3], rows[4], rows[5], rows[8], rows[9], rows[10]]
    assert by(single) == sorted(want, key=str)
    safe = corpus_pipeline.redact_personal_data(spark, docs, SF)
    assert by(safe) == sorted(((d, x, lang, s, None if x is None else len(x)) for d, t, lang, s, _ in rows for x in [t and t.replace("+49 30 1234567", "[PHONE]")]), key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs, SF).collect()
    words = collections.Counter()
    for r in mixed:
        words[r["source"]] += len(WORD.findall(r["text"]))
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert dict(words) == pytest.approx(brute_targets(sizes, (5, 2, 1), 3), abs=3)  # rows that repeat share what is left evenly
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    check_packing(packed, [(r[0], r[1]) for r in rows], 4096)
