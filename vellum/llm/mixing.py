"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size. Documents stand in a
fixed order within their source; the expected copies are prefix-summed along it, one offset in [0, 1) is
added per source, and a document is emitted once for each integer that its step crosses. As the order
goes by size, the words that a source gives miss its target by little more than one document.

The prefix sum is a rank times a constant. Ranks are found without bringing a source into one task:
documents fall into cells (source, size class, first hash digits: as many as keep a cell near a million rows), cells are counted before the shuffle and
written, a running sum over the few cells of a source gives each cell its first rank, and rows are numbered
within cells. Words are counted once for the cells and once for the rows; a ``size`` that is given is not counted
at all. There is a row a source in :func:`targets`: sources are named collections, thousands, not hosts.

Edge cases: null text has size 0 and is never taken; null source is a source, the last; a source of size
0 has target 0; repeated rows count each; an empty table gives no rows. Extra columns are kept by
:func:`mix`, but for those named like its own results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._shared import WORD_PATTERN, keep

MOST = 3  # times a source's or a document's own size
CELLED = 1 << 27  # documents that one hash digit is enough for; sixteen times as many take one more


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size): weights 1, 2, 3 repeating in code point order, null
    last; all sizes shared by weight, no source above three times its own size."""
    # one row a source
    order = Window.orderBy(F.col("source").isNull(), "source")
    first = sizes.select("*", (1 + F.pmod(F.row_number().over(order) - 1, F.lit(3))).cast("long").alias("weight"), (MOST * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = first.select("*", F.sum("source_size").over(everything).alias("all_size"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"), F.sum("weight").over(after).alias("weight_after"))
    # of the sources by cap / weight, those whose cap lies under their share of what is left are full
    filled = filled.withColumn("full", F.col("cap") * F.col("weight_after") < (F.col("all_size") - F.col("cap_before")) * F.col("weight"))
    some = lambda value, full: F.coalesce(F.sum(F.when(F.col("full") == full, F.col(value))).over(everything), F.lit(0))
    filled = filled.select("source", "source_size", "weight", "cap", "full", (F.col("all_size") - some("cap", True)).alias("rest"), some("weight", False).alias("rest_weight"))
    share = F.col("rest").cast("double") / F.col("rest_weight").cast("double") * F.col("weight").cast("double")
    return filled.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_plan(docs: DataFrame, seed: str = "mix", sized: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words). With ``sized`` they hold their size in place of a text."""
    docs = docs.drop("source_size", "target", "copies", "taken")
    docs = docs if sized else docs.withColumn("size", word_count(F.col("text")))
    digits, n = 1, docs.count()
    while n > CELLED * 16 ** (digits - 1) and digits < 8:
        digits += 1
    # named structs, as joins on plain null sources would lose them
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    bits = "length(bin(size))"
    placed = docs.select(
        "*",
        key.alias("_source"),
        F.expr(f"{bits} * 16 + shiftright(size, greatest({bits} - 4, 0))").alias("_class"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_digit", F.substring("_order", 1, digits))
    cell = ["_source", "_class", "_digit"]
    cells = keep(placed.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    along = Window.partitionBy("_source").orderBy("_class", "_digit").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before"), F.sum("words").over(Window.partitionBy("_source")).alias("source_size"))
    sources = cells.groupBy("_source").agg(F.max("source_size").alias("source_size"))
    sources = sources.select("_source", F.when(~F.col("_source.none"), F.col("_source.name")).alias("source"), "source_size")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    aimed = targets(sources.select("source", "source_size")).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"),
        "target",
        offset.alias("_offset"),
    )
    cells = keep(cells.join(aimed, "_source"), "mix-aimed")  # of known size: else rows would be dealt anew, by source
    ranked = placed.withColumn("_row", F.row_number().over(Window.partitionBy(*cell).orderBy("_order", "doc_id"))).join(cells, cell)
    step = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size").cast("double"))
    crossed = lambda rank: F.floor(rank.cast("double") * step + F.col("_offset"))
    rank = F.col("_before") + F.col("_row")
    copies = F.least(F.coalesce(crossed(rank) - crossed(rank - 1), F.lit(0)), F.lit(MOST)).cast("long")
    hidden = ["_source", "_class", "_order", "_digit", "_row", "_before", "_offset"]
    return ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(*hidden)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    planned = mix_plan(docs, seed).filter("copies > 0")
    return planned.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
