"""Text and metadata functions over whole tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import tables
from vellum.functions import text as X
from vellum.operators import search
from vellum.plans.catalog import CHUNKS, STRIP, chunk_table, order_tables, query, quote, table, terms_sql, tidy_sql
from vellum.sources import chunking, files


def ingested_sql(c: str) -> str:
    c = rf"regexp_replace(coalesce({c}, ''), '\r\n|\r', chr(10), 'g')"
    c = rf"regexp_replace(translate({c}, chr(160) || chr(12288), '  '), '[ \t]+', ' ', 'g')"
    return STRIP.format(rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t\x0B\f]+\n', chr(10), 'g')")


#: Documents with line ends, tabs, hard blanks and hyphenation put in.
ROUGH = """rough AS (SELECT doc_id, regexp_replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(160) || chr(9)), '([a-z]{4})([a-z]{5})', '\\1-' || chr(10) || '\\2') AS t FROM documents)"""


def rough(spark, sf_dir):
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\u00a0\t"))
    hyphen = F.regexp_extract(text, "([a-z]{4})([a-z]{5})", 0)
    at = F.instr(text, hyphen)
    first = F.when(hyphen != "", F.concat(F.substr(text, F.lit(1), at + 3), F.lit("-\n"), F.substr(text, at + 4))).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", first.alias("t"))


@query(rf"WITH {ROUGH} SELECT doc_id, md5({ingested_sql('t')}) AS ingested, md5({STRIP.format(f'''regexp_replace({ingested_sql('t')}, '\n{{2,}}', chr(10), 'g')''')}) AS block, md5({STRIP.format('''regexp_replace(coalesce(t, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')''')}) AS collapsed, md5(regexp_replace(t, '([\p{{L}}\p{{N}}_]+)[-\x{{2011}}]\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')) AS repaired FROM rough")
def text_ingested(spark, sf_dir):
    """What is done to texts as they are read, on roughened ones."""
    t = F.col("t")
    return rough(spark, sf_dir).select("doc_id", F.md5(X.normalize_ingested(t)).alias("ingested"), F.md5(X.normalize_block(t)).alias("block"), F.md5(X.collapse(t)).alias("collapsed"), F.md5(X.repair_hyphenation(t)).alias("repaired"))


KINDS = ["Title", " narrativetext ", "header", "page_footer", "TableData", "image_caption", "sourcecode", "numbered", "BlockQuote", "embedded", "else", None]


@query(f"""WITH k AS (SELECT doc_id, [{', '.join('NULL' if k is None else quote(k) for k in KINDS)}][1 + doc_id % {len(KINDS)}] AS kind FROM documents), n AS (SELECT doc_id, lower({STRIP.format("coalesce(kind, '')")}) AS kind FROM k)
    SELECT doc_id, CASE {' '.join(f"WHEN kind IN ({', '.join(map(quote, names))}) THEN {quote(kind)}" for kind, names in X.BLOCK_TYPES.items())} ELSE 'paragraph' END AS block_type FROM n""")
def block_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.block_type(F.element_at(F.lit(KINDS), (F.col("doc_id") % len(KINDS) + 1).cast("int"))).alias("block_type"))


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || ' > ' || lang || '> ' WHEN 1 THEN source || '/' || lang WHEN 2 THEN '["' || source || '", " ", "' || lang || '"]' WHEN 3 THEN '  ' ELSE '[' || source END AS path, CASE doc_id % 5 WHEN 0 THEN [source, lang] WHEN 1 THEN [source, lang] WHEN 2 THEN [source, lang] WHEN 3 THEN [] ELSE ['[' || source] END AS parts FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND NOT regexp_matches(source || lang, '[>/"\\s]'))
    SELECT doc_id, array_to_string(parts, ' > ') AS path, coalesce(parts[-1], '') AS title FROM p""")
def section_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(r"source IS NOT NULL AND lang IS NOT NULL AND NOT rlike(concat(source, lang), '[>/\"\\s]')")
    k = F.col("doc_id") % 5
    path = F.when(k == 0, F.concat("source", F.lit(" > "), "lang", F.lit("> "))).when(k == 1, F.concat("source", F.lit("/"), "lang")).when(k == 2, F.concat(F.lit('["'), "source", F.lit('", " ", "'), "lang", F.lit('"]'))).when(k == 3, "  ").otherwise(F.concat(F.lit("["), "source"))
    return docs.select("doc_id", X.section_path(path).alias("p")).select("doc_id", F.array_join("p", " > ").alias("path"), X.section_title(F.col("p")).alias("title"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN '' WHEN 3 THEN event_type ELSE ' ' || event_id || ' ' END AS s FROM events WHERE event_id % 5 > 0)
    SELECT event_id, coalesce(TRY_CAST(trim(s) AS BIGINT), -1) AS whole, coalesce(TRY_CAST(trim(s) AS DOUBLE), 0.0)::DOUBLE AS number FROM v""")
def safe_numbers(spark, sf_dir):
    """Numbers written as texts, blanks around them, and what is no number."""
    k = F.col("event_id") % 5
    s = F.when(k == 1, F.col("event_id").cast("string")).when(k == 2, "").when(k == 3, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "events").filter(k > 0).select("event_id", X.to_int(s, -1).alias("whole"), X.to_float(s).alias("number"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_from_json(spark, sf_dir):
    """Vectors written as JSON and read back."""
    v = X.embedding_of(F.to_json("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x / list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings""")
def vector_unit(spark, sf_dir):
    u = search.l2_normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(search.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


LINE = r"lines AS (SELECT doc_id, u.i - 1 AS block_index, u.line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)), s AS (SELECT *, " + STRIP.format("line") + " AS s FROM lines)"


@query(rf"""WITH {LINE} SELECT doc_id, block_index, CASE WHEN s = '' OR length(s) > 120 THEN NULL WHEN regexp_matches(s, '(?i)^(item|section|part)\s+[A-Z0-9IVX.\-]+') THEN 2 WHEN regexp_matches(s, '^\d+(\.\d+){{0,3}}\s+\S+') THEN 3
    WHEN len(regexp_extract_all(s, '\p{{L}}')) > 0 AND len(regexp_extract_all(s, '\p{{Lu}}')) > len(regexp_extract_all(s, '\p{{L}}')) * 0.8 AND length(s) < 100 THEN 2 END::INTEGER AS level FROM s""")
def heading_guess(spark, sf_dir):
    return chunking.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", "block_index", X.guessed_heading(F.col("line")).alias("level"))


FINANCE_TITLES = ["Acme Corporation: Widgets, 10-K", "公司：星辰（北京）, 年报 财年 2021", "Form 8-K of Beta Inc Gamma FY 2019", "nothing", "Ltd Delta and Sons\n"]


@query(f"""WITH t AS (SELECT doc_id, [{', '.join(map(quote, FINANCE_TITLES))}][1 + doc_id % 5] AS title, CASE WHEN doc_id % 2 = 0 THEN 'Fiscal Year: 2022 ' || text ELSE text END AS content FROM documents),
    m AS (SELECT doc_id, regexp_extract(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 500), {quote(X.COMPANY.replace(chr(92) + 'n?', chr(92) + 'n?'))}, 1) AS c, regexp_extract(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 1000), {quote(X.FILING)}, 1) AS f, regexp_extract(substr(coalesce(content, ''), 1, 2000), {quote(X.FISCAL)}, 1) AS y FROM t)
    SELECT doc_id, nullif({tidy_sql('c')}, '') AS company, nullif({tidy_sql('f')}, '') AS filing_type, nullif({tidy_sql('y')}, '') AS fiscal_year FROM m""")
def finance_metadata(spark, sf_dir):
    title = F.element_at(F.lit(FINANCE_TITLES), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Fiscal Year: 2022 "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.finance_metadata(title, content).alias("m")).select("doc_id", "m.*")


@query(f"""WITH {CHUNKS} SELECT chunk_id, md5({STRIP.format(f'''concat_ws(chr(10), CASE WHEN {tidy_sql('title')} <> '' THEN '[Document] ' || {tidy_sql('title')} END, CASE WHEN chunk_index % 2 = 0 THEN '[Company] Acme' END, CASE WHEN chunk_index % 3 = 0 THEN '[Filing] 10-K' END, '[Section] ' || section,
    '[SectionPath] ' || CASE WHEN chunk_index % 2 = 0 THEN 'b / c / ' ELSE 'a / b / ' END || section, CASE WHEN chunk_index % 4 = 0 THEN '[Pages] ' || page_start || '-' || (page_start + 1) ELSE '[Page] ' || page_start END, '[ChunkType] ' || CASE WHEN chunk_index % 5 = 0 THEN 'table' ELSE 'text' END,
    CASE WHEN chunk_index % 5 = 0 THEN '[Units] million' END, CASE WHEN chunk_index % 5 = 0 THEN '[YearColumns] 2021, 2022' END, nullif({tidy_sql('chunk_text')}, ''))''')}) AS digest FROM chunks""")
def chunk_search_text(spark, sf_dir):
    """The search text of every chunk, with the parts that its number stands for."""
    i, s = F.col("chunk_index"), F.col("section")
    headings = F.when(i % 2 == 0, F.array(F.lit("a"), F.lit(" b"), F.lit("b"), F.lit("c"), s)).otherwise(F.array(F.lit("a"), F.lit(""), F.lit("b"), s, F.lit("a")))
    text = X.search_text(F.col("title"), F.when(i % 2 == 0, "Acme"), F.when(i % 3 == 0, "10-K"), F.array(F.lit("x"), s), headings, F.col("page_start"), F.when(i % 4 == 0, F.col("page_start") + 1), F.when(i % 5 == 0, "table").otherwise("text"), F.col("chunk_text"), F.lit(""), F.lit("million"), F.array(F.lit("2021"), F.lit("2022")))
    return chunk_table(spark, sf_dir).select("chunk_id", F.md5(text).alias("digest"))


@query(f"""WITH {CHUNKS}, h AS (SELECT *, concat_ws(' | ', nullif(title, ''), 'Page ' || page_start, 'Section: ' || concat_ws(' > ', CASE WHEN chunk_index % 2 = 0 THEN 'root' END, section), CASE WHEN chunk_index % 3 > 0 THEN 'Type: text' END) AS header FROM chunks)
    SELECT chunk_id, header, md5(header || chr(10) || chunk_text) AS digest FROM h""")
def contextual_header(spark, sf_dir):
    i = F.col("chunk_index")
    header = X.contextual_header(F.col("title"), F.col("page_start"), F.when(i % 2 == 0, "root").otherwise(""), F.col("section"), F.when(i % 3 > 0, "text"))
    return chunk_table(spark, sf_dir).withColumn("header", header).select("chunk_id", "header", F.md5(X.contextual_text(F.col("header"), F.lit(""), F.col("chunk_text"))).alias("digest"))


@query(f"""WITH q AS (SELECT item_id AS query_id, {tidy_sql('text')} AS t FROM benchmark), f AS (SELECT query_id, list_distinct(list_concat(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[A-Za-z][A-Za-z0-9_./:-]{{1,}}'), ['cash', 'zz'])) AS l FROM q)
    SELECT query_id, (SELECT string_agg(x, ' ' ORDER BY length(x) DESC, x) FROM unnest(l) AS u(x)) AS terms FROM f""")
def query_terms(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return asked.select("query_id", F.array_join(X.query_terms(F.col("text"), F.lit("cash zz"), F.array(F.lit("zz"))), " ").alias("terms"))


@query(rf"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {STRIP.format('p')}), lambda p: p <> '')[1:3], chr(1)) AS s, sha256(coalesce(text, ''))[1:16] AS cache_key FROM documents")
def key_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.key_sentences(F.col("text")), "\x01").alias("s"), X.cache_key(F.col("text")).alias("cache_key"))


@query("SELECT doc_id, CASE WHEN NOT (length(substr(text, 1, doc_id % 400)) < 50 AND regexp_matches(substr(text, 1, doc_id % 400), '[0-9]')) AND (length(source) > 150 OR length(substr(text, 1, doc_id % 400)) > 300) THEN 'medium' ELSE 'easy' END AS difficulty FROM documents WHERE doc_id % 400 > 0")
def difficulty(spark, sf_dir):
    answer = F.substr("text", F.lit(1), (F.col("doc_id") % 400).cast("int"))
    return table(spark, sf_dir, "documents").filter("doc_id % 400 > 0").select("doc_id", X.difficulty(F.col("source"), answer).alias("difficulty"))


@query(rf"""WITH a AS (SELECT doc_id, 'paid $' || n_chars || '.50 or 1.5 % and 12.25%, "' || source || ' quoted" "' || SOURCE || ' QUOTED" "again quoted" ' || text AS t FROM documents WHERE source IS NOT NULL),
    e AS (SELECT doc_id, list_concat(regexp_extract_all(t, '\$[\d,]+\.?\d*'), regexp_extract_all(t, '\d+\.?\d+\s*%'), regexp_extract_all(t, '"([^"]{{3,50}})"', 1)[1:3]) AS l FROM a)
    SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(list_transform(l, lambda y: lower(y)), lower(l[i])) = i), lambda i: l[i]), '|') AS must FROM e""")
def must_include(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    t = F.concat(F.lit("paid $"), F.col("n_chars").cast("string"), F.lit('.50 or 1.5 % and 12.25%, "'), "source", F.lit(' quoted" "'), "source", F.lit(' QUOTED" "again quoted" '), "text")
    return docs.select("doc_id", F.array_join(X.must_include(t), "|").alias("must"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(source, '') || ', ' || coalesce(lang, '') || ',,  x y ', ','), lambda t: {tidy_sql('t')}), lambda t: t <> ''), '|') AS tags,
    CASE WHEN length({tidy_sql('text')}) <= 220 THEN {tidy_sql('text')} ELSE substr({tidy_sql('text')}, 1, 217) || '...' END AS short,
    CASE doc_id % 4 WHEN 0 THEN '-' WHEN 1 THEN doc_id || '-' || (doc_id + 1) WHEN 2 THEN doc_id::VARCHAR ELSE (doc_id + 1)::VARCHAR END AS page FROM documents""")
def document_labels(spark, sf_dir):
    """Tags, short text and page label of every document."""
    i = F.col("doc_id")
    start, end = F.when((i % 4).isin(1, 2), i), F.when((i % 4).isin(1, 3), i + 1)
    tags = X.tags(F.concat(X.blank(F.col("source")), F.lit(", "), X.blank(F.col("lang")), F.lit(",,  x y ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"), X.truncate(F.col("text")).alias("short"), X.page_label(start, end).alias("page"))


@query(f"""WITH q AS (SELECT item_id AS query_id, '现金流量表' || item_id || ' x' AS t FROM benchmark), r AS (SELECT query_id, regexp_extract(t, '[一-鿿]+') AS c FROM q)
    SELECT query_id, array_to_string(list_concat(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)), list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)), list_transform(range(1, length(c) - 2), lambda i: substr(c, i, 4))), ' ') AS grams FROM r""")
def cjk_grams(spark, sf_dir):
    run = F.regexp_extract(F.concat(F.lit("现金流量表"), F.col("item_id").cast("string"), F.lit(" x")), f"({X.CJK}+)", 1)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(Q.cjk_ngrams(run), " ").alias("grams"))


@query(f"""WITH {CHUNKS}, first_ AS (SELECT * FROM chunks WHERE chunk_index = 0), t AS (SELECT chunk_id, lower(chunk_text) AS low, chunk_text, unnest({terms_sql("lower(title) || ' the of a.b'")}) AS term FROM first_)
    SELECT chunk_id, term, ((length(chunk_text) - length(replace(chunk_text, term, ''))) / length(term))::BIGINT AS exact, ((length(low) - length(replace(low, term, ''))) / length(term))::BIGINT AS inside,
    regexp_matches(low, '(^|[^a-z0-9_])' || replace(term, '.', '[.]') || '([^a-z0-9_]|$)') AS whole, regexp_matches(low, '(^|[\\s:/._-])' || replace(term, '.', '[.]')) AS prefix FROM t""")
def term_occurrences(spark, sf_dir):
    """How often and how terms stand in the first chunk of every document."""
    first = chunk_table(spark, sf_dir).filter("chunk_index = 0")
    return search.term_occurrences(first.select("chunk_id", "chunk_text", F.explode(Q.terms(F.concat(F.lower("title"), F.lit(" the of a.b")))).alias("term")))


@query("SELECT l_orderkey AS order_key, round(count(*) * 2 / (count(*) * 4 + 4), 6) AS density FROM lineitem GROUP BY 1")
def table_numeric_density(spark, sf_dir):
    """Numeric cells of each order's lines as a table: line and part numbers are, flags and names are not."""
    return order_tables(spark, sf_dir).select("order_key", F.round(tables.numeric_density(tables.rows(F.col("t"))), 6).alias("density"))


@query(f"SELECT doc_id, md5({STRIP.format('text')}) AS digest, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'text' ELSE 'pdf' END AS file_type, doc_id % 3 = 2 AS failed FROM documents WHERE text IS NOT NULL AND doc_id % 3 < 2 UNION ALL SELECT doc_id, NULL, 'pdf', true FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2")
def bytes_decoded(spark, sf_dir):
    """Documents as bytes, with and without a byte order mark, read back; those called PDF have no PDF in them."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    k = F.col("doc_id") % 3
    mark = F.when(k == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    raw = docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(k == 2, ".pdf").otherwise(".md")).alias("path"), F.concat(mark, F.encode("text", "UTF-8")).alias("content"))
    read = files.read_bytes(raw)
    return read.select(F.regexp_extract("path", r"f(-?\d+)", 1).cast("long").alias("doc_id"), F.md5("text").alias("digest"), "file_type", F.col("error").isNotNull().alias("failed"))
