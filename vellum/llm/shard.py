"""Balanced label propagation: documents go to shards of equal counts, linked documents to the same ones.

Links join documents that share a hub (here: equal texts); as each document is joined to its hub and not
to the other members, a group of n needs n rows, never n * n. Documents start in shards given by a hash.
In each round, by joins:

1. members are counted by hub and shard; a hub aims at the shards that hold most of it, at as many as
   its size needs (one, unless it exceeds a shard's quota), passing over shards that are over quota;
2. documents outside their hub's shards propose to move there; what arrives at a shard is accepted up to
   its quota, larger gains first, by thresholds found in a table of bounded size.

Unlinked documents have no preference: they fill what the linked ones leave. At the end counts are made
exact: a shard keeps linked documents up to its share, members of larger hubs first; the rest and the
unlinked are numbered, and their number says which free slot is theirs. Numbering goes by cells (hash bins counted before the shuffle),
so neither a shard nor a hub has to fit into one task.

Four rounds are run by default; a document that would still move then stays, which costs cut edges, not balance.

Edge cases: null text links nothing and has size 8 and crc 0; repeated rows count each; doc_id may be
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._shared import keep

BINS, SUBS = 32, 16


def _bin(column: str, bins: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(bins)).cast("int")


def numbered(df: DataFrame, within: list[str], bins: list[str], order: list[str]) -> DataFrame:
    """Adds ``number``, from 0 within each value of ``within``, going by ``bins``, then ``order``. The table of cells is bounded by the bins."""
    cells = df.groupBy(*within, *bins).agg(F.count("*").alias("cell_rows"))
    along = Window.partitionBy(*within).orderBy(*bins).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*within, *bins, F.coalesce(F.sum("cell_rows").over(along), F.lit(0)).alias("cell_first"))
    rows = df.withColumn("cell_row", F.row_number().over(Window.partitionBy(*within, *bins).orderBy(*order)))
    return rows.join(F.broadcast(cells), [*within, *bins]).withColumn("number", F.col("cell_first") + F.col("cell_row") - 1).drop("cell_first", "cell_row")


def propagate(nodes: DataFrame, shards: int, quota: int) -> DataFrame:
    """One round over linked nodes (node, hub, shard and others): the same rows with ``shard`` after the accepted moves and ``moved``."""
    nodes = nodes.drop("moved")
    counts = nodes.groupBy("hub", "shard").agg(F.count("*").alias("n"), F.max("members").alias("members"))
    load = nodes.groupBy("shard").count().filter(F.col("count") > quota).collect()  # a row a shard
    full = F.col("shard").isin([r["shard"] for r in load]) & (F.col("members") <= quota)
    by_shard = F.sort_array(F.collect_list(F.struct(full.alias("full"), (-F.col("n")).alias("n"), F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("shard"))))
    hubs = counts.groupBy("hub").agg(F.max("members").alias("members"), by_shard.alias("held"))
    all_shards = F.sequence(F.lit(0), F.lit(shards - 1))
    wanted = F.least(F.lit(shards), F.ceil(F.col("members") / F.lit(max(quota, 1)))).cast("int")
    hubs = hubs.select(
        "hub",
        F.slice(F.concat(F.col("held")["shard"], F.array_except(all_shards, F.col("held")["shard"])), F.lit(1), wanted).alias("aims"),
        F.map_from_arrays(F.col("held")["shard"], F.transform("held", lambda x: -x["n"])).alias("here"),
    )
    seen = nodes.join(hubs, "hub")
    aim = F.when(F.array_contains("aims", F.col("shard")), F.col("shard")).otherwise(F.element_at("aims", (F.pmod(F.xxhash64("node", F.lit(3)), F.size("aims")) + 1).cast("int")))
    seen = seen.withColumn("aim", aim)
    gain = F.coalesce(F.element_at("here", F.col("aim")), F.lit(0)) - F.element_at("here", F.col("shard")) + 1
    seen = seen.withColumn("rank", F.when(F.col("aim") != F.col("shard"), F.length(F.bin(F.greatest(gain, F.lit(0)))))).withColumn("bin", _bin("hub", BINS, 5)).drop("aims", "here")
    # at most shards * 64 * BINS rows
    asked = seen.filter("rank IS NOT NULL").groupBy("aim", "rank", "bin").agg(F.count("*").alias("n"))
    staying = seen.groupBy(F.when(F.col("rank").isNull(), F.col("shard")).alias("aim")).agg(F.count("*").alias("staying"))
    along = Window.partitionBy("aim").orderBy(F.desc("rank"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.join(F.broadcast(staying), "aim", "left").withColumn("room", quota - F.coalesce("staying", F.lit(0)) - F.coalesce(F.sum("n").over(along), F.lit(0)))
    asked = asked.select("aim", "rank", "bin", F.when(F.col("room") >= F.col("n"), 1.0).when(F.col("room") > 0, F.col("room") / F.col("n")).otherwise(0.0).alias("part"))
    decided = seen.join(F.broadcast(asked), ["aim", "rank", "bin"], "left")
    moved = F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < F.col("part") * (1 << 20), F.lit(False))
    kept = [c for c in nodes.columns if c != "shard"]
    return decided.select(*kept, F.when(moved, F.col("aim")).otherwise(F.col("shard")).alias("shard"), moved.alias("moved"))


def balanced_shards(nodes: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """Adds ``shard`` and ``slot`` to nodes (node, hub and others; null hub: no link). Counts of shards differ by one at most."""
    hubs = nodes.filter("hub IS NOT NULL").groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    state = keep(nodes.join(hubs, "hub", "left").withColumn("shard", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(shards)).cast("int")), "shard-nodes")
    total = state.count()
    share = [total // shards + (s < total % shards) for s in range(shards)]
    linked, single = state.filter("members > 1"), state.filter("members IS NULL")
    for _ in range(rounds):
        linked = keep(propagate(linked, shards, total // shards), "shard-round")
        if not linked.filter("moved").limit(1).count():
            break
    linked = linked.drop("moved") if "moved" in linked.columns else linked
    load = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}  # a row a shard
    held = [min(load.get(s, 0), share[s]) for s in range(shards)]
    bins = ["grade", "bin", "sub"]
    in_order = lambda df: df.withColumn("grade", -F.length(F.bin(F.coalesce("members", F.lit(0))))).withColumn("bin", _bin("hub", BINS, 17)).withColumn("sub", _bin("node", SUBS, 13))
    placed = numbered(in_order(linked), ["shard"], bins, ["hub", "node"])
    limit = F.element_at(F.lit(share), F.col("shard") + 1)
    stays = placed.filter(F.col("number") < limit).withColumn("slot", F.col("number"))
    spill = placed.filter(F.col("number") >= limit).drop("number")
    pool = in_order(single).unionByName(spill).drop("shard").withColumn("all", F.lit(0))
    pool = numbered(pool, ["all"], bins, ["hub", "node"]).drop("all")
    ends, sums = [], 0
    for s in range(shards):
        sums += share[s] - held[s]
        ends.append(sums)
    starts = [0, *ends[:-1]]
    at = reduce(lambda out, s: F.when(F.col("number") < ends[s], F.lit(s)).otherwise(out), reversed(range(shards)), F.lit(None).cast("int"))
    fill = pool.withColumn("shard", at)
    fill = fill.withColumn("slot", F.col("number") - F.element_at(F.lit(starts), F.col("shard") + 1) + F.element_at(F.lit(held), F.col("shard") + 1))
    return stays.unionByName(fill).drop("number", "members", *bins)


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 4) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; equal texts are linked."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    hub = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    nodes = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), hub.alias("hub"))
    nodes = nodes.withColumn("node", F.xxhash64("doc_id", "hub"))
    return balanced_shards(nodes, shards, rounds).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
