"""Scores of parsed documents, pages of blocks and stored contents; SQL where the blocks are plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.plans.catalog import STRIP, any_sql, query, table
from vellum.sources import blocks, chunking, quality

KINDS = ["paragraph", "heading", "table", "list_item", "paragraph"]
LINED = rf"""b AS (SELECT doc_id, u.i - 1 AS block_index, CASE WHEN doc_id % 6 = 0 THEN substr(u.line, 1, 2) WHEN doc_id % 6 = 1 THEN repeat(chr(2), length(u.line)) || u.line ELSE u.line END AS text,
        ['paragraph', 'heading', 'table', 'list_item', 'paragraph'][1 + (doc_id + u.i - 1) % 5] AS kind0, CASE WHEN u.i % 7 > 0 THEN (u.i - 1) // 3 + 1 END AS page FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)),
    k AS (SELECT * EXCLUDE (kind0), CASE WHEN doc_id % 4 = 0 AND kind0 = 'table' THEN 'paragraph' ELSE kind0 END AS kind, {STRIP.format('text')} AS s FROM b)"""


def lined(spark, sf_dir) -> DataFrame:
    """Lines as blocks of five kinds on pages of three lines; some documents are cut to fragments, some hold control characters."""
    i, at, line = F.col("doc_id"), F.col("block_index"), F.col("line")
    text = F.when(i % 6 == 0, F.substring(line, 1, 2)).when(i % 6 == 1, F.concat(F.expr("repeat(char(2), length(line))"), line)).otherwise(line)
    kind = F.element_at(F.lit(KINDS), ((i + at) % 5 + 1).cast("int"))
    kind = F.when((i % 4 == 0) & (kind == "table"), "paragraph").otherwise(kind)
    page = F.when((at + 1) % 7 > 0, F.floor(at / 3) + 1)
    return chunking.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", "block_index", text.alias("text"), kind.alias("kind"), page.alias("page"))


@query(rf"""WITH {LINED}, per AS (SELECT doc_id, sum(length(text)) AS chars, count(*) AS n, count_if(s <> '') AS filled, count_if(length(s) BETWEEN 1 AND 2) AS short, count_if(s = '' OR {any_sql('s', [*X.PAGE_NUMBERS, X.RULES])}) AS noise, count_if(kind = 'heading') AS headings,
        count_if(kind = 'table') AS tables, count(DISTINCT page) AS pages, sum(length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0d\x0e-\x1f]', '', 'g'))) AS garbage FROM k GROUP BY 1),
    rep AS (SELECT doc_id, count_if(c >= 3) AS again, count(*) AS kinds FROM (SELECT doc_id, lower(s) AS l, count(*) AS c FROM k WHERE s <> '' GROUP BY ALL) GROUP BY 1),
    f AS (SELECT *, short / n AS ss, coalesce(again / kinds, 0) AS rs, noise / n AS ns FROM per LEFT JOIN rep USING (doc_id)), g AS (SELECT *, (chars / greatest(pages, 1) < 50 AND n > 3 AND ss > 0.6) OR garbage / greatest(chars, 1) > 0.40 AS scanned FROM f)
    SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE * least(chars / 5000, 1.0) + 0.15::DOUBLE * least(filled / 50, 1.0) + 0.10::DOUBLE * least(chars / n / 150, 1.0) - 0.10::DOUBLE * ss - 0.15::DOUBLE * rs - 0.15::DOUBLE * ns + 0.10::DOUBLE * (headings / n)
        + CASE WHEN tables > 0 THEN 0.05 ELSE 0.0 END::DOUBLE + CASE WHEN pages > 0 THEN 0.05 ELSE 0.0 END::DOUBLE)), 6) AS quality, scanned AS likely_scanned, scanned AND tables = 0 AS ocr_recommended, round(ss, 6)::DOUBLE AS short_share, round(rs, 6)::DOUBLE AS repeated_share, round(ns, 6)::DOUBLE AS noise_share FROM g""")
def parse_flags(spark, sf_dir):
    return quality.block_scores(lined(spark, sf_dir))


COUNTS = f"{LINED}, c AS (SELECT doc_id, sum(length(text)) AS chars, count_if(s <> '') AS filled, count_if(kind = 'heading') AS h, count_if(kind = 'table') AS t, count_if(kind = 'list_item') AS l FROM k GROUP BY 1)"


@query(f"WITH {COUNTS} SELECT doc_id, round(0.2::DOUBLE * least(chars / 3000, 1.0) + 0.2::DOUBLE * least(filled / 30, 1.0) + 0.2::DOUBLE * least(h / 5, 1.0) + CASE WHEN t > 0 THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN l > 0 THEN 0.2 ELSE 0.0 END::DOUBLE, 6) AS quality FROM c")
def word_quality(spark, sf_dir):
    return quality.word_scores(lined(spark, sf_dir))


@query(f"""WITH {COUNTS} SELECT d.doc_id, round(0.30::DOUBLE * least(length(coalesce(d.text, '')) / 2000, 1.0) + 0.25::DOUBLE * least(coalesce(h, 0) / 5, 1.0) + 0.20::DOUBLE * least(coalesce(l, 0) / 10, 1.0) + CASE WHEN t > 0 THEN 0.25 ELSE 0.0 END::DOUBLE, 6) AS quality,
    coalesce(t, 0) AS table_count, coalesce(h, 0) AS heading_count, coalesce(l, 0) AS list_count FROM documents d LEFT JOIN c USING (doc_id)""")
def text_quality(spark, sf_dir):
    return quality.text_scores(lined(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", X.blank(F.col("text")).alias("content")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'two' ELSE 'one' END AS parser, greatest(doc_id % 3 / 2::DOUBLE, CASE WHEN doc_id % 3 = 1 THEN 0.75 ELSE 0.0 END)::DOUBLE AS quality FROM documents")
def best_parse(spark, sf_dir):
    """Two parses of every document: the first is as good as its number modulo 3, the second .75 where that is 1 and 0 elsewhere."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    one = docs.select("doc_id", F.lit("one").alias("parser"), (k / 2).alias("quality"), F.lit(1).alias("blocks"))
    two = docs.select("doc_id", F.lit("two").alias("parser"), F.when(k == 1, 0.75).otherwise(0.0).alias("quality"), F.lit(2).alias("blocks"))
    return quality.best_parse(one.unionByName(two)).select("doc_id", "parser", "quality")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 3 END::BIGINT AS page_start, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN 6 ELSE 5 END WHEN 1 THEN 7 WHEN 2 THEN 4 END::BIGINT AS page_end FROM documents""")
def block_pages(spark, sf_dir):
    """Pages of blocks from their own fields, from their page, from their metadata, from nowhere."""
    i = F.col("doc_id")
    number = lambda c, v: F.when(c, F.lit(v).cast("long"))
    told = table(spark, sf_dir, "documents").select(
        "doc_id", number(i % 4 == 0, 5).alias("page_start"), number(i % 8 == 0, 6).alias("page_end"), number(i % 4 == 1, 7).alias("page"),
        F.when(i % 4 == 2, F.create_map(F.lit("page"), F.lit("3"), F.lit("page_end"), F.lit(" 4.0"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return blocks.with_pages(told).select("doc_id", "page_start", "page_end")


@query()
def stored_content_blocks(spark, sf_dir):
    """Documents cut as stored contents are; tests hold it against written cases."""
    return blocks.exploded(blocks.from_stored(table(spark, sf_dir, "documents"), merged=True))


@query()
def content_by_section(spark, sf_dir):
    return blocks.grouped_content(blocks.clean(blocks.typed_blocks(table(spark, sf_dir, "documents"))))


@query(r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))::INTEGER AS n, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS digest FROM pages""")
def html_text_extract(spark, sf_dir):
    """The text of raw pages: scripts, styles and tags out, white space collapsed."""
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))
