"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws ``u`` from a hash of itself and gets the key ``-ln(u) / quality``: in
ascending order of keys, better documents tend to come first. Within a source, sizes are
summed up in that order to the source's budget. Whole epochs come first: a target of 2.4
times the source takes every document twice and then the first 0.4 of the order. The
document in which the budget ends gives its first words only, so a source's take is its
target rounded to a word.

What the sampling decides is one row for each source: the epochs and the key where the
budget ends. The corpus is read with that; texts are never sorted or gathered by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, running_total

WORD = r"[^\x20\x09-\x0D]+"
#: Up to how many sources their decisions are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Up to how many sources their targets are worked out on the driver.
FEW_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_quality(text: Column) -> Column:
    """From 0.1 to 1: less for the share of signs that stand for markup, tables and noise."""
    n = F.greatest(F.length(text), F.lit(1))
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * signs / n), F.lit(0.1))


def targets_of(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], most_epochs: int) -> list[tuple[str | None, int, float]]:
    """The same of a list."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    rows = [(most_epochs * n / float(weights[k % len(weights)]), k, source, n, float(weights[k % len(weights)])) for k, (source, n) in enumerate(ranked)]
    left, weight, out = float(sum(n for _, n in sizes)), sum(w for *_, w in rows), {}
    for stop, k, _, n, w in sorted(rows):
        if not left or stop > left / weight:
            break
        out[k] = float(most_epochs * n)
        left, weight = left - out[k], weight - w
    return [(source, n, out.get(k, left / weight * w if weight else 0.0)) for _, k, source, n, w in rows]


def targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """``source, source_size`` with ``target``: weights by rank of the source, stopped at ``most_epochs`` sizes.

    The excess goes to the others by weight until none is above. Sorted by how early they
    stop, all sources up to some one stop, so the share of a weight follows from running
    totals; nothing is iterated. Up to ``FEW_SOURCES`` that is arithmetic on the driver, a
    row a source; beyond, the totals are distributed and no task sees all sources. Without
    words all targets are 0.
    """
    few = sizes.limit(FEW_SOURCES + 1).collect()
    if len(few) <= FEW_SOURCES:
        made = targets_of([(r["source"], r["source_size"]) for r in few], weights, most_epochs)
        return sizes.sparkSession.createDataFrame(made, "source string, source_size long, target double")
    ranked = running_total(sizes.withColumn("__one", F.lit(1)), {"__one": "__rank"}, [F.col("source").asc_nulls_last()])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked.select(
        "source", "source_size", F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int")).alias("__w"),
        (most_epochs * F.col("source_size")).alias("__stop"),
    )
    total, weight = table.agg(F.sum("source_size"), F.sum("__w")).first()
    if not total:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    order = [(F.col("__stop") / F.col("__w")).asc(), F.col("source").asc_nulls_last()]
    table = running_total(table, {"__stop": "__stop_before", "__w": "__w_before"}, order)
    share = (F.lit(float(total)) - F.col("__stop_before")) / (F.lit(weight) - F.col("__w_before"))
    stops = F.col("__stop") / F.col("__w") <= share
    taken, rest = table.agg(F.sum(F.when(stops, F.col("__stop")).otherwise(0)), F.sum(F.when(~stops, F.col("__w")).otherwise(0.0))).first()
    share = (total - taken) / rest if rest else 0.0
    target = F.when(stops, F.col("__stop").cast("double")).otherwise(F.lit(share) * F.col("__w"))
    return table.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most_epochs: int = 3, seed: int = 17, quality: Column | None = None,
) -> DataFrame:
    """Add ``size, source_size, target, epochs, part, taken`` to ``docs`` with ``doc_id, text, source``.

    ``taken = epochs * size + part``. Sources are ranked by code point, null last. A null
    text has no words. Rows that agree in id, source and text share a draw and share what is
    left of the budget evenly. Reruns agree. An empty table gives an empty table.
    """
    quality = default_quality(F.col("text")) if quality is None else quality
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(u) / quality
    narrow = docs.select("source", word_count(F.col("text")).alias("size"), key.alias("__key"), h.alias("__h"))
    narrow = materialise(narrow.groupBy("source", "__key", "__h", "size").agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.col("size") * F.col("__n")), "draws")
    sources = targets(narrow.groupBy("source").agg(F.sum("__all").alias("source_size")), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.round(F.col("target") - F.col("__epochs") * F.col("source_size")).cast("long")
    sources = materialise(sources.withColumn("__epochs", epochs).withColumn("__left", left), "targets")
    order = [F.col("__key").asc(), F.col("__h").asc()]
    run = running_total(narrow, {"__all": "__before"}, order, ("source",)).select(F.col("source").alias("__src"), "__key", "__h", "__all", "__n", "__before")
    ends = run.join(sources, F.col("__src").eqNullSafe(F.col("source")))
    ends = ends.where((F.col("__before") <= F.col("__left")) & (F.col("__left") < F.col("__before") + F.col("__all")))
    ends = ends.select("__src", F.col("__key").alias("__end_key"), F.col("__h").alias("__end_h"), F.floor((F.col("__left") - F.col("__before")) / F.col("__n")).cast("long").alias("__end_part"))
    decided = materialise(
        sources.join(ends, F.col("source").eqNullSafe(F.col("__src")), "left")
        .select(F.col("source").alias("__source"), "source_size", "target", "__epochs", "__left", "__end_key", "__end_h", "__end_part"), "decisions",
    )
    if decided.count() <= BROADCAST_SOURCES:
        decided = F.broadcast(decided)
    own = {"size", "source_size", "target", "epochs", "part", "taken"}
    keep = [F.col(f"__row.`{c}`") for c in docs.columns if c.lower() not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    out = docs.select(row, word_count(F.col("text")).alias("size"), key.alias("__key"), h.alias("__h"))
    out = out.join(decided, F.col("__row.source").eqNullSafe(F.col("__source")), "left")
    ahead = (F.col("__key") < F.col("__end_key")) | ((F.col("__key") == F.col("__end_key")) & (F.col("__h") < F.col("__end_h")))
    at = (F.col("__key") == F.col("__end_key")) & (F.col("__h") == F.col("__end_h"))
    none_ends = F.when(F.col("__left") >= F.col("source_size"), F.col("size")).otherwise(0)
    part = F.when(F.col("__end_key").isNull(), none_ends).when(ahead, F.col("size")).when(at, F.col("__end_part")).otherwise(0).cast("long")
    part = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(part)
    taken = F.col("__epochs") * F.col("size") + F.col("part")
    return out.withColumn("part", part).select(*keep, "size", "source_size", "target", F.col("__epochs").alias("epochs"), "part", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text with what stands between them, as it is."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def mixed_texts(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, the last time perhaps cut to its first words.

    Documents that the mix doesn't take are gone; so are those without words, null texts among
    them. A null source is one like others, rows that repeat are taken alike, other columns
    stay whatever their names, and an empty table gives an empty table.
    """
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "text", "source"), **options)
    times = F.concat(
        F.when(F.col("epochs") > 0, F.array_repeat(F.col("size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")),
    )
    out = out.where(F.col("taken") > 0).withColumn("__words", F.explode(times))
    text = F.when(F.col("__words") < F.col("size"), first_words(F.col("text"), F.col("__words"))).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"__doc.`{c}`") for c in docs.columns])
