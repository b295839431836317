"""Connected components by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._shared import keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())  # one row


#: Tasks over which the links of one node are dealt before Spark splits what is large.
SPREAD = 8


def spread_join(rows: DataFrame, told: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with the one row of ``told`` for their key: rows of a frequent key are dealt by another column, and its one row goes to each part."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    return dealt.join(told.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), [key, "_part"]).drop("_part")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root for every node of the undirected edges (u, v), roots being the least node of each component.

    It takes about as many rounds as the logarithm of the largest component; after ``rounds`` without a fixed point it raises.
    Each round is written to the scratch folder. Nodes with many links only meet aggregates, which are
    combined before the shuffle, and joins, whose large partitions Spark splits. Loops (u = v) and repeated
    edges may occur; a null end drops the edge; no edges give no rows."""
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = keep(edges, "components")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both, least, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
