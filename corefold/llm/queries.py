"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, html_text, mixing, near_dup, packing, pii, quality, token_files, url_filter, warc
from .common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_vocabularies() -> quality.Vocabularies:
    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(5, 2, 1), most_epochs=3).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "part")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "token-files")
    written = token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, folder, [(r["file"], r["n_tokens"]) for r in written.collect()])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=0.8)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=10, every=100, recall=0.96)


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc")
    written = warc.write_archives(pages, folder, least_bytes=0).collect()
    records = warc.read_archives(spark, folder, [(r["file"], r["size"]) for r in written], split_bytes=4 << 20)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=5, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.measure(docs, quality_vocabularies(), least_words=10, most_repeated=20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, public_tokenizers.path("word_bpe_49k.json"), url_filter.RULES)


# what SQL can say of operators whose method it can't


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op4_personal_data`` what doesn't depend on the classifier."""
    return op4_personal_data(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op9_quality_rules`` the counts and the base verdict."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op10_url_filter`` hosts, paths, rules, and the verdicts of rules."""
    found = op10_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op2_source_mixing`` sizes and targets by source, and whether the words taken are the target, rounded."""
    rows = op2_source_mixing(spark, sf_dir).groupBy("source").agg(F.sum("size").alias("source_size"), F.round(F.first("target"), 3).alias("target"), F.sum("taken").alias("taken"))
    return rows.select("source", "source_size", "target", (F.abs(F.col("taken") - F.col("target")) <= 0.51).alias("met"))


def packed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``op1_best_fit_packing`` whether each sequence is gapless from 0 and within the capacity, and each document whole."""
    rows = op1_best_fit_packing(spark, sf_dir)
    documents = rows.groupBy("doc_id").agg((F.sum("length") != F.max(F.col("start") + F.col("length"))).alias("wrong")).select(F.lit("documents").alias("what"), "wrong")
    places = F.array_sort(F.collect_list(F.struct("offset", "length")))  # of one sequence: at most its capacity
    sequences = rows.groupBy("sequence_id").agg(F.sum("length").alias("total"), places.alias("places"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("wrong"))
    step = lambda a, x: F.struct((x["offset"] + x["length"]).alias("at"), (a["wrong"] | (x["offset"] != a["at"])).alias("wrong"))
    sequences = sequences.select(F.lit("sequences").alias("what"), (F.aggregate("places", start, step, lambda a: a["wrong"]) | (F.col("total") > 4096)).alias("wrong"))
    both = documents.unionByName(sequences).groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("wrong"), 1)).alias("n_wrong"))
    return both.select("what", F.when(F.col("what") == "documents", F.col("n")).alias("documents"), "n_wrong")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_files": op3_token_files,
    "op4_personal_data": op4_personal_data,
    "op5_main_text": op5_main_text,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filter": op10_url_filter,
    "pii_base": pii_base,
    "quality_base": quality_base,
    "url_rules": url_rules,
    "mix_targets": mix_targets,
    "packed_lengths": packed_lengths,
}

_WORD = r"[^\x20\x09-\x0D]+"


def _pii_sql() -> str:
    """Spans are found by splitting: a match begins after all parts and matches before it."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(0, length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN substr(reverse({digits}), (k + 1)::INT, 1)::INT
        ELSE list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], substr(reverse({digits}), (k + 1)::INT, 1)::INT + 1) END)) % 10 = 0"""
    holds = {
        "email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
    }
    found = []
    for place, (kind, pattern) in enumerate(patterns.items()):
        found.append(f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, list_sum(list_transform(parts[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0)::BIGINT AS start, found[i] AS v
            FROM (SELECT doc_id, parts, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS parts FROM d)) WHERE true""")
    spans = " UNION ALL ".join(f"SELECT * FROM ({x}) WHERE {holds[kind]}" for kind, x in zip(patterns, found, strict=True))
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in patterns)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({spans})
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY place, start), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""

#: Exact statements, where SQL can express an operator's whole result, and of the parts that it can.
ORACLE_SQL: dict[str, str] = {
    "pii_base": _pii_sql(),
    "quality_base": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
        ), windows AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
        ), twice AS (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, list(i) AS places FROM windows GROUP BY doc_id, words[i:i + 4] HAVING count(*) > 1)
        ), covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY doc_id
        ), lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w
        ), made AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM made""",
    "url_rules": """
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
        ), rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), fits AS (
            SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS place
            FROM u JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
        SELECT u.page_id, host, path, rule, v AS by_rule FROM u LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)""",
    "mix_targets": rf"""
        WITH RECURSIVE d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents
        ), s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
        ), order_ AS (SELECT *, row_number() OVER (ORDER BY 3 * n / weight::DOUBLE, source NULLS LAST) AS place FROM s
        ), shares AS (
            SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER before, 0)) / ((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS share
            FROM order_ WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), stops AS (SELECT *, 3 * n / weight::DOUBLE <= share AS stop FROM shares
        ), rest AS (SELECT ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) FILTER (stop), 0)) / (sum(weight) FILTER (NOT stop))::DOUBLE AS share FROM stops)
        SELECT source, n AS source_size, round(CASE WHEN stop THEN 3 * n ELSE weight * rest.share END, 3)::DOUBLE AS target, true AS met FROM stops, rest""",
    "packed_lengths": "SELECT 'documents' AS what, count(*) AS documents, 0::BIGINT AS n_wrong FROM documents UNION ALL SELECT 'sequences', NULL, 0",
    "op7_warc_round_trip": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex FROM pages
        ), bits AS (
            SELECT page_id, n, hex, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS b FROM p
        ), named AS (
            SELECT page_id, n, hex, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
                1 + 16 * (b[5 * i + 1])::INT + 8 * (b[5 * i + 2])::INT + 4 * (b[5 * i + 3])::INT + 2 * (b[5 * i + 4])::INT + (b[5 * i + 5])::INT]), '') AS digest
            FROM bits
        ), first AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
            CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
        FROM named JOIN first USING (hex)""",
    "op8_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(len(words) - 4, least(len(words), 1))),
                lambda i: array_to_string(words[i + 1:i + 5], ' '))) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
