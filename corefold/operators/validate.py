"""Rules for what is handed in: matches and candidates as ID lists, one row a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("s1_id", "ids")


def _items(lists: DataFrame) -> DataFrame:
    return lists.select("s1_id", F.explode(F.split("ids", ",")).alias("id")).select("s1_id", F.trim("id").alias("id")).where("id <> ''")


def check_header(header: str, wanted: tuple[str, ...]) -> str | None:
    """What is wrong with a file's first line, if anything."""
    if "\t" not in header:
        return "no tab in the header"
    have = [c.strip().lower() for c in header.rstrip("\r\n").split("\t")]
    return None if have == [c.lower() for c in wanted] else f"columns {have}"


def violations(matches: DataFrame, candidates: DataFrame, spine: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n) for every rule, 0 where it is kept. Each is one aggregation or anti-join; no list is collected.

    ``matches`` and ``candidates`` have ``s1_id, ids``; ``known`` the target ids that exist.
    """
    pairs, cands = _items(matches), _items(candidates)
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    again = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bad: Column = ~F.startswith("id", F.lit("S2-")) & ~F.startswith("id", F.lit("S3-"))
    ids = spine.select("s1_id").distinct()
    rows = [
        count(again(matches, ["s1_id"]), "repeated record"),
        count(again(pairs, ["s1_id", "id"]), "repeated target in a list"),
        count(pairs.where(F.startswith("id", F.lit("S1-"))), "target of the first source"),
        count(pairs.where(bad), "unknown prefix"),
        count(ids.join(matches, "s1_id", "left_anti"), "missing record"),
        count(matches.join(ids, "s1_id", "left_anti"), "unknown record"),
        count(pairs.distinct().join(cands, ["s1_id", "id"], "left_anti"), "match that is no candidate"),
        count(again(pairs.distinct(), ["id"]), "target claimed twice"),
    ]
    if known is not None:
        rows.append(count(pairs.select("id").distinct().join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "target that doesn't exist"))
    return reduce(DataFrame.unionByName, rows)


def summary(matches: DataFrame) -> DataFrame:
    """Rows, empty lists, targets, mean targets a row."""
    n = F.size(F.filter(F.split("ids", ","), lambda x: F.trim(x) != ""))
    rows = matches.select(n.alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.sum("n").cast("long").alias("targets"), F.round(F.avg("n"), 6).alias("mean_targets"))
