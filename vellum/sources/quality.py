"""How well a document was parsed: scores over its blocks (doc_id, kind, text, page), each one aggregate a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X

# fixed values: what counts as a repeated line, a short fragment, a scanned page
REPEATED, SHORT, PAGE_CHARS, GARBAGE = 3, 3, 50, 0.40


def _most(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def repeated_lines(blocks: DataFrame, text: str = "text", least: int = 4, most: int = 79) -> DataFrame:
    """doc_id, key, n: lines of ``least`` to ``most`` characters that a document has at least three times, whatever their case."""
    keyed = blocks.select("doc_id", F.lower(X.strip(F.col(text))).alias("key"))
    return keyed.filter(F.length("key").between(least, most)).groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= REPEATED)


def block_scores(blocks: DataFrame) -> DataFrame:
    """doc_id, quality, likely_scanned, ocr_recommended and the shares that they come from. Equal lines meet before their document's sums,
    so a document of one line repeated is one row."""
    s, text = F.col("s"), F.col("text")
    garbage = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f]", ""))
    told = blocks.withColumn("text", X.blank(text)).withColumn("s", X.strip(text))
    per_line = told.groupBy("doc_id", F.lower(s).alias("k")).agg(
        F.count("*").alias("c"), F.sum(F.length(text)).alias("chars"), F.count_if(F.length(s).between(1, SHORT - 1)).alias("short"), F.count_if(X.is_noise(text)).alias("noise"), F.sum(garbage).alias("garbage"),
        F.count_if(F.col("kind").isin("heading", "title")).alias("headings"), F.count_if(F.col("kind") == "table").alias("tables"), F.min("page").alias("low"), F.max("page").alias("high"), F.collect_set("page").alias("pages"),
    )
    filled = F.col("k") != ""
    per = per_line.groupBy("doc_id").agg(
        *(F.sum(c).alias(c) for c in ("chars", "short", "noise", "garbage", "headings", "tables")), F.sum("c").alias("n"), F.sum(F.when(filled, F.col("c")).otherwise(0)).alias("filled"),
        F.count_if(filled & (F.col("c") >= REPEATED)).alias("again"), F.count_if(filled).alias("kinds"), F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    score = (
        0.15 * _most(F.col("chars") / 5000) + 0.15 * _most(F.col("filled") / 50) + 0.10 * _most(share("chars", "n") / 150) - 0.10 * share("short", "n") - 0.15 * share("again", "kinds") - 0.15 * share("noise", "n")
        + 0.10 * share("headings", "n") + F.when(F.col("tables") > 0, 0.05).otherwise(0.0) + F.when(F.col("pages") > 0, 0.05).otherwise(0.0)
    )
    thin = (F.col("chars") / F.greatest(F.col("pages"), F.lit(1)) < PAGE_CHARS) & (F.col("n") > 3) & (share("short", "n") > 0.6)
    scanned = thin | (F.col("garbage") / F.greatest(F.col("chars"), F.lit(1)) > GARBAGE)
    return per.select(
        "doc_id", F.round(F.greatest(F.lit(0.0), _most(score)), 6).alias("quality"), scanned.alias("likely_scanned"), (scanned & (F.col("tables") == 0)).alias("ocr_recommended"),
        F.round(share("short", "n"), 6).alias("short_share"), F.round(share("again", "kinds"), 6).alias("repeated_share"), F.round(share("noise", "n"), 6).alias("noise_share"),
    )


def _counts(blocks: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("kind") == k)
    return blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count_if(X.strip(F.col("text")) != "").alias("filled"), kind("heading").alias("headings"), kind("table").alias("tables"), kind("list_item").alias("items"))


def word_scores(blocks: DataFrame) -> DataFrame:
    """doc_id, quality of the blocks of a Word file: a fifth each for length, blocks, headings, tables and lists."""
    some = lambda c: F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    score = 0.2 * _most(F.col("chars") / 3000) + 0.2 * _most(F.col("filled") / 30) + 0.2 * _most(F.col("headings") / 5) + 0.2 * some("tables") + 0.2 * some("items")
    return _counts(blocks).select("doc_id", F.round(score, 6).alias("quality"))


def text_scores(blocks: DataFrame, content: DataFrame) -> DataFrame:
    """doc_id, quality, table_count, heading_count, list_count of a text's blocks and its content (doc_id, content)."""
    met = content.select("doc_id", F.length("content").alias("n")).join(_counts(blocks), "doc_id", "left").fillna(0)
    score = 0.30 * _most(F.col("n") / 2000) + 0.25 * _most(F.col("headings") / 5) + 0.20 * _most(F.col("items") / 10) + F.when(F.col("tables") > 0, 0.25).otherwise(0.0)
    return met.select("doc_id", F.round(score, 6).alias("quality"), F.col("tables").alias("table_count"), F.col("headings").alias("heading_count"), F.col("items").alias("list_count"))


def best_parse(candidates: DataFrame) -> DataFrame:
    """Of several parses (doc_id, parser, quality, blocks) of a document the one of most quality, the first parser by name where equal."""
    best = F.max_by(F.struct("parser", "quality", "blocks"), F.struct("quality", (-F.ascii("parser")).alias("_a"), F.col("parser").alias("_p")))
    return candidates.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")
