"""Records with their text normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_records(pages: DataFrame) -> DataFrame:
    """Records of web pages: the title names, the address is the URL, the country the language; sources by turn."""
    attribute = lambda pattern: F.regexp_extract(F.coalesce("html", F.lit("")), pattern, 1)
    source = (F.col("page_id") % 3 + 1).cast("string")
    return pages.select(
        F.concat(F.lit("S"), source, F.lit("-"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("entity_id"),
        F.replace(attribute("<title>([^<]*)</title>"), F.lit("&amp;"), F.lit("&")).alias("business_name"),
        F.coalesce("url", F.lit("")).alias("business_address"),
        attribute('<html lang="([a-z]*)"').alias("country"),
    )


def normalise(records: DataFrame, unicode: bool = False) -> DataFrame:
    """``entity_id, country, is_s1, is_s2`` and the normal forms that keys and features are made of."""
    clean = T.clean_unicode if unicode else T.clean
    out = records.select(
        "entity_id", F.lower(F.trim("country")).alias("country"), F.startswith("entity_id", F.lit("S1-")).alias("is_s1"),
        F.startswith("entity_id", F.lit("S2-")).alias("is_s2"), clean(F.coalesce("business_name", F.lit(""))).alias("name_norm"),
        clean(F.coalesce("business_address", F.lit(""))).alias("addr_clean"),
    )
    out = out.withColumn("name_toks", T.tokens(F.col("name_norm"))).withColumn("addr_all", T.expand(T.tokens(F.col("addr_clean"))))
    return out.select(
        "entity_id", "country", "is_s1", "is_s2", "name_norm", F.array_join("addr_all", " ").alias("addr_norm"), "name_toks", "addr_all",
        T.core_tokens(F.col("name_toks")).alias("core_toks"), T.addr_tokens(F.col("addr_all")).alias("addr_toks"),
        T.numbers(F.col("addr_all")).alias("numbers"), T.pins(T.numbers(F.col("addr_all"))).alias("pins"),
        F.coalesce(F.try_element_at("name_toks", F.lit(1)), F.lit("")).alias("first_tok"),
    )
