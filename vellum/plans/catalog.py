"""Queries over the driver's tables, one or more an operator, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import signals as S
from vellum.functions import spans, tables
from vellum.functions import text as X
from vellum.operators import evaluation, indexing, ranking, search, store
from vellum.operators.index import Index
from vellum.operators.index import stored as build_index
from vellum.sources import blocks, chunking, quality, scratch
from vellum.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_windows(table(spark, sf_dir, "documents"))


_INDEXES: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents' chunks, written once a session for each version of the documents."""
    key = (spark.sparkContext.applicationId, *scratch.stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = build_index(chunk_table(spark, sf_dir), key[2])
    return _INDEXES[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- SQL parts

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
CHUNKS = r"""listed AS (SELECT doc_id, concat_ws(' ', source, lang) AS title, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
    chunks AS (SELECT doc_id, i AS chunk_index, doc_id * 16777216 + i AS chunk_id, array_to_string(w[i * 80 + 1:i * 80 + 80], ' ') AS chunk_text,
        title, 'part ' || (i // 5) AS section, i // 3 + 1 AS page_start FROM listed, unnest(range(0, (len(w) + 79) // 80)) AS u(i))"""
POSTINGS = CHUNKS + f""", tok AS (SELECT chunk_id, {TOKENS.format("chunk_text")} AS t FROM chunks),
    postings AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY term, chunk_id),
    freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    totals AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
    qterms AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark))"""
BM25 = POSTINGS + """, scored AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM postings JOIN qterms USING (term) JOIN freq USING (term), totals GROUP BY query_id, chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank FROM scored)"""
LINES = r"blocks AS (SELECT doc_id, u.line, u.i - 1 AS block_index FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i))"
STRIP = r"regexp_replace({}, '^\s+|\s+\z', '', 'g')"


def tidy_sql(c: str) -> str:
    c = rf"regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '\r\n|\r', chr(10), 'g')"
    c = rf"regexp_replace({c}, '[ \t\x0B\f]*\n[ \t\x0B\f]*', chr(10), 'g')"
    return STRIP.format(rf"regexp_replace(regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")


def lexical_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower({tidy_sql(c)}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(c: str, phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {quote(p)})::INT" for p in phrases) + ")"


def count_sql(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {quote(pattern)}))"


def any_sql(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quote(p)})" for p in patterns) + ")"


def mixed_sql(c: str) -> str:
    return rf"regexp_replace({tidy_sql(c)}, '({X.CJK})\s+({X.CJK})', '\1\2', 'g')"


def terms_sql(c: str) -> str:
    return f"list_distinct(list_concat(list_transform(list_filter(regexp_extract_all({mixed_sql(c)}, {quote(Q.ASCII_TERM)}), lambda t: length(t) >= 2), lambda t: lower(t)), regexp_extract_all({mixed_sql(c)}, '{X.CJK}+')))"


# --- texts


@query(f"SELECT doc_id, md5({tidy_sql('text')}) AS digest, length({tidy_sql('text')})::INTEGER AS n FROM documents")
def text_normalize(spark, sf_dir):
    s = X.normalize_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(s).alias("digest"), F.length(s).alias("n"))


@query(f"SELECT doc_id, md5({lexical_sql('text')}) AS digest FROM documents")
def lexical_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_lexical(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, trunc({count_sql('text', X.CJK)} + {count_sql('text', '[A-Za-z0-9_./:-]+')} * 1.3::DOUBLE)::INTEGER AS tokens, md5(coalesce(text, '')) AS content_hash FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"), X.content_hash(F.col("text")).alias("content_hash"))


@query(r"""SELECT page_id, CASE WHEN e IN ('.txt', '.md', '.markdown') THEN 'text' WHEN e = '.docx' THEN 'docx' WHEN e = '.pdf' THEN 'pdf' ELSE 'unknown' END AS file_type
    FROM (SELECT page_id, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS e FROM pages)""")
def file_type_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.file_type(F.col("url")).alias("file_type"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, {STRIP.format('line')} AS s FROM blocks)
    SELECT doc_id, count(*) AS n_lines, count_if(s = '' OR {any_sql('s', [*X.PAGE_NUMBERS, X.RULES])})::BIGINT AS noise, count_if(s = '' OR {any_sql('s', [*X.SEVERE, X.CONTROL])})::BIGINT AS severe,
    count_if(s = '' OR {any_sql('s', X.TEMPLATES)})::BIGINT AS template FROM s GROUP BY doc_id""")
def noise_flags(spark, sf_dir):
    flags = chunking.line_blocks(table(spark, sf_dir, "documents"))
    line = F.col("line")
    return flags.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_noise(line)).alias("noise"), F.count_if(X.is_severe_noise(line)).alias("severe"), F.count_if(X.is_template_noise(line)).alias("template"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, lower({STRIP.format('line')}) AS key FROM blocks) SELECT doc_id, key, count(*) AS n FROM s WHERE length(key) BETWEEN 4 AND 79 GROUP BY ALL HAVING count(*) >= 3")
def repeated_lines(spark, sf_dir):
    return quality.repeated_lines(chunking.line_blocks(table(spark, sf_dir, "documents")), "line")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line, {STRIP.format('line')} AS s FROM blocks),
    per AS (SELECT doc_id, sum(length(line)) AS chars, count_if(s <> '') AS filled, count(*) AS n, count_if(length(s) BETWEEN 1 AND 2) AS short, count_if(s = '' OR {any_sql('s', [*X.PAGE_NUMBERS, X.RULES])}) AS noise FROM s GROUP BY doc_id),
    rep AS (SELECT doc_id, count_if(c >= 3) AS again, count(*) AS kinds FROM (SELECT doc_id, lower(s) AS k, count(*) AS c FROM s WHERE s <> '' GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE * least(chars / 5000, 1.0) + 0.15::DOUBLE * least(filled / 50, 1.0) + 0.10::DOUBLE * least(chars / n / 150, 1.0)
        - 0.10::DOUBLE * (short / n) - 0.15::DOUBLE * coalesce(again / kinds, 0) - 0.15::DOUBLE * (noise / n) + 0.05::DOUBLE)), 6) AS quality FROM per LEFT JOIN rep USING (doc_id)""")
def doc_quality_score(spark, sf_dir):
    """Every line of a document as a block of its one page."""
    lines = chunking.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", F.col("line").alias("text"), F.lit("paragraph").alias("kind"), F.lit(1).alias("page"))
    return quality.block_scores(lines).select("doc_id", "quality")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, {STRIP.format('line')} AS s FROM blocks), l AS (SELECT doc_id, CASE WHEN s = '' THEN 1 WHEN regexp_matches(s, '^#{{1,6}}\\s+') THEN least(6, length(string_split(s, ' ')[1]))
    WHEN regexp_matches(s, '^第[一二三四五六七八九十百千万0-9]+章') THEN 1 WHEN regexp_matches(s, '^第[一二三四五六七八九十百千万0-9]+节') THEN 2 WHEN regexp_matches(s, '^[一二三四五六七八九十]+[、.．]') THEN 2
    WHEN regexp_matches(s, '^[0-9]+[.、]') THEN least(4, greatest(2, length(string_split(s, ' ')[1]) - length(replace(string_split(s, ' ')[1], '.', '')) + 2)) ELSE 1 END::INTEGER AS level FROM s)
    SELECT doc_id, level, count(*) AS n FROM l GROUP BY ALL""")
def heading_levels(spark, sf_dir):
    blocks = chunking.line_blocks(table(spark, sf_dir, "documents"))
    return blocks.groupBy("doc_id", X.heading_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT chunk_id, doc_id, chunk_index, page_start, section, title, md5(chunk_text) AS digest FROM chunks")
def chunk_fixed(spark, sf_dir):
    return chunk_table(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "page_start", "section", "title", F.md5("chunk_text").alias("digest"))


@query(r"SELECT doc_id, u.i - 1 AS block_index, md5(u.line) AS digest FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)")
def chunk_paragraphs(spark, sf_dir):
    return chunking.line_blocks(table(spark, sf_dir, "documents")).select("doc_id", "block_index", F.md5("line").alias("digest"))


@query()
def chunk_hard_split(spark, sf_dir):
    return chunking.sized_chunks(table(spark, sf_dir, "documents"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS parsed FROM orders""")
def datetime_parse(spark, sf_dir):
    """Dates written in four formats, read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    kind = F.col("o_orderkey") % 4
    midnight = F.col("d") == F.date_trunc("day", "d")
    spelled = F.when((kind == 0) & midnight, F.date_format("d", "yyyy-MM-dd")).when((kind == 1) & midnight, F.date_format("d", "yyyy/MM/dd")).when(kind == 2, F.date_format("d", "yyyy/MM/dd HH:mm:ss")).otherwise(F.date_format("d", "yyyy-MM-dd HH:mm:ss"))
    return orders.select("o_orderkey", F.date_format(X.parse_timestamp(spelled), "yyyy/MM/dd HH:mm:ss").alias("parsed"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\$[\d,]+\.?\d*'))::INTEGER + len(regexp_extract_all(text, '\d+\.?\d+\s*%'))::INTEGER AS amounts FROM documents""")
def amounts_in_text(spark, sf_dir):
    count = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, sf_dir, "documents").select("doc_id", (count(r"\$[\d,]+\.?\d*") + count(r"\d+\.?\d+\s*%")).alias("amounts"))


# --- queries


@query(f"SELECT item_id AS query_id, array_to_string(list_sort({terms_sql('text')}), ' ') AS terms FROM benchmark")
def query_normalize(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.array_join(F.array_sort(Q.terms(F.col("query"))), " ").alias("terms"))


LITERALS = ["What is the quick ratio of the company in FY2022?", "What products and services does it offer?", "Why did operating margin decline? explain the trend", "cash", "", "现金 流量表 of ACME 2021", "please describe business overview versus prior year", "effective tax rate", "how much debt and working capital"]
INTENT_SQL = f"""WITH q AS (SELECT i AS query_id, query FROM unnest([{', '.join(map(quote, LITERALS))}]) WITH ORDINALITY AS u(query, i) UNION ALL SELECT item_id + 1000, text FROM benchmark),
    c AS (SELECT *, {count_sql('lower(query)', Q.NUMERIC)} AS n, {count_sql('lower(query)', Q.LISTS)} AS s, {count_sql('lower(query)', Q.DESCRIPTIVE)} AS d FROM q),
    k AS (SELECT *, CASE WHEN n > s AND n > d THEN 'numeric_fact' WHEN s > n AND s > d THEN 'list_fact' WHEN d > n AND d > s THEN 'descriptive' ELSE 'hybrid' END AS intent FROM c)"""


def mixed_questions(spark, sf_dir):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(LITERALS, 1)], "query_id long, query string")
    return rows.unionByName(questions(spark, sf_dir).withColumn("query_id", F.col("query_id") + 1000))


@query(f"{INTENT_SQL} SELECT query_id, intent FROM k")
def query_intent(spark, sf_dir):
    return mixed_questions(spark, sf_dir).select("query_id", Q.intent(F.col("query")).alias("intent"))


def expand_sql() -> str:
    low = f"lower({mixed_sql('query')})"
    wanted = [f"CASE WHEN NOT contains({low}, {quote(t.lower())}) THEN {quote(t)} END" for t in Q.CONTEXT]
    wanted += [f"CASE WHEN contains({low}, {quote(i)}) AND NOT contains({low}, {quote(t)}) THEN {quote(t)} END" for i, parts in Q.EXPANSIONS.items() for t in parts]
    financial = f"({hits_sql(low, Q.FINANCIAL)} > 0 OR (regexp_matches({mixed_sql('query')}, '{X.CJK}') AND {hits_sql(mixed_sql('query'), Q.FINANCIAL[:15])} > 0))"
    return f"{INTENT_SQL} SELECT query_id, CASE WHEN {financial} THEN concat_ws(' ', {mixed_sql('query')}, {', '.join(wanted)}) ELSE {mixed_sql('query')} END AS expanded FROM k"


@query(expand_sql())
def query_expand(spark, sf_dir):
    return mixed_questions(spark, sf_dir).select("query_id", Q.expand(F.col("query")).alias("expanded"))


@query()
def query_rewrite(spark, sf_dir):
    return mixed_questions(spark, sf_dir).select("query_id", Q.rewrite(F.col("query")).alias("rewritten"))


# --- search


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 10")
def fulltext_topk(spark, sf_dir):
    return search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"""WITH {POSTINGS}, scored AS (SELECT query_id, chunk_id, round(sum(tf * pow(log10(n / df), 2)), 6) AS score FROM postings JOIN qterms USING (term) JOIN freq USING (term), totals GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank FROM scored QUALIFY rank <= 10""")
def fulltext_tfidf2(spark, sf_dir):
    return search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 10, "tfidf2")


def boolean_sql(require_all: bool) -> str:
    wanted = "HAVING count(DISTINCT q.term) = any_value(w.n)" if require_all else ""
    return f"""WITH {POSTINGS}, voc AS (SELECT DISTINCT term FROM postings), w AS (SELECT query_id, count(*) AS n FROM qterms GROUP BY 1),
        hits AS (SELECT q.query_id, q.term, v.term AS word FROM qterms q JOIN voc v ON starts_with(v.term, q.term)),
        m AS (SELECT q.query_id, p.chunk_id, count(DISTINCT q.term) AS score FROM hits q JOIN postings p ON p.term = q.word JOIN w ON w.query_id = q.query_id GROUP BY ALL {wanted})
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank FROM m QUALIFY rank <= 10"""


@query(boolean_sql(False))
def boolean_prefix_any(spark, sf_dir):
    return search.boolean_prefix(index(spark, sf_dir), questions(spark, sf_dir), 10)


@query(boolean_sql(True))
def boolean_prefix_all(spark, sf_dir):
    return search.boolean_prefix(index(spark, sf_dir), questions(spark, sf_dir), 10, True)


def stored_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def question_vectors(spark, sf_dir):
    """A question's vector: that of its number."""
    return table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))


VECTORS = """SELECT b.item_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings e"""
TOP_VECTORS = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC)::INTEGER AS rank FROM v WHERE score > 0 QUALIFY rank <= 10"


@query(f"WITH v AS ({VECTORS}) {TOP_VECTORS}")
def vector_topk_cosine(spark, sf_dir):
    return search.vector_top_k(stored_vectors(spark, sf_dir), question_vectors(spark, sf_dir), 10)


@query(f"WITH v AS ({VECTORS} WHERE e.label = 3) {TOP_VECTORS}")
def vector_filtered_topk(spark, sf_dir):
    return search.vector_top_k(stored_vectors(spark, sf_dir), question_vectors(spark, sf_dir), 10, {"label": 3, "source": None})


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::INTEGER AS dim FROM embeddings")
def vector_norm_check(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(search.dot(e, e)), 5).alias("norm"), F.size(e).alias("dim"))


def word_sql(field: str) -> str:
    return f"regexp_matches({field}, '(^|[^a-z0-9_])' || replace(term, '.', '[.]') || '([^a-z0-9_]|$)')"


RECALL = f"""{BM25}, lex AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS bm25 FROM ranked WHERE rank <= 20),
    vec AS (SELECT query_id, chunk_id * 16777216 AS chunk_id, score AS embedding FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS r FROM ({VECTORS}) WHERE score > 0) WHERE r <= 20),
    merged AS (SELECT query_id, chunk_id, coalesce(max(bm25), 0) AS bm25, coalesce(max(embedding), 0) AS embedding FROM (SELECT query_id, chunk_id, bm25, NULL AS embedding FROM lex UNION ALL SELECT query_id, chunk_id, NULL, embedding FROM vec) GROUP BY ALL)"""
CAND = """cand AS (SELECT m.query_id, m.chunk_id, m.bm25, m.embedding, b.text AS query, c.doc_id, c.chunk_index, c.chunk_text, c.title, c.section, c.page_start
        FROM merged m JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = m.query_id)"""
#: Keyword scores (kw) of candidates (cand).
KW = f"""kt AS (SELECT query_id, chunk_id, unnest({terms_sql('query')}) AS term, lower(chunk_text) AS ct, lower(title) AS ti, lower(section) AS se FROM cand),
    kh AS (SELECT *, ({word_sql('ti')})::INT + ({word_sql('se')})::INT AS found FROM kt),
    kc AS (SELECT query_id, chunk_id, count(*) AS n, count_if({word_sql('ct')}) AS matched, sum(CASE WHEN contains(ti, term) THEN found ELSE 0 END) AS th,
        sum(CASE WHEN contains(se, term) THEN found ELSE 0 END) AS sh, max(contains(ti, term)::INT) AS it, max(contains(se, term)::INT) AS ins FROM kh GROUP BY ALL),
    kw AS (SELECT query_id, chunk_id, matched / n / 2 AS keyword, CASE WHEN n >= 2 THEN (th >= 2)::INT ELSE it END::DOUBLE AS title_score,
        CASE WHEN n >= 2 THEN (sh >= 2)::INT ELSE ins END::DOUBLE AS section_score, matched / n AS coverage FROM kc)"""
KEYWORDS = f"{RECALL}, {CAND}, {KW}"


def vector_hits(spark, sf_dir):
    """The 20 nearest vectors of a question; a document's vector stands for its first chunk."""
    vectors = search.vector_top_k(stored_vectors(spark, sf_dir), question_vectors(spark, sf_dir), 20)
    return vectors.select("query_id", chunking.chunk_id(F.col("chunk_id")).alias("chunk_id"), F.col("score").alias("embedding"))


def hydrated(spark, sf_dir, merged):
    """Candidates with their chunks and questions. They are few next to the chunks: written, they are what Spark broadcasts."""
    few = scratch.keep(merged, "candidates")
    return index(spark, sf_dir).chunks.drop("dl").join(few, "chunk_id").join(questions(spark, sf_dir), "query_id")


def recalled(spark, sf_dir):
    """Candidates of full text and vectors, with scores and chunks."""
    found = search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 20).select("query_id", "chunk_id", "score")
    lexical = search.max_normalized(found, "score").withColumnRenamed("score", "bm25")
    return hydrated(spark, sf_dir, search.merge([lexical, vector_hits(spark, sf_dir)], ["bm25", "embedding"]))


def recalled_whole(spark, sf_dir):
    """Candidates as ``recalled`` gives them, but all that the reference fetches: 400 by words and prefixes, and the expansion of financial questions."""
    lexical = search.lexical_recall(index(spark, sf_dir), questions(spark, sf_dir))
    return hydrated(spark, sf_dir, search.merge([lexical, vector_hits(spark, sf_dir)], ["bm25", "embedding"]))


@query(f"WITH {RECALL} SELECT query_id, chunk_id, round(bm25, 6) AS bm25, embedding FROM merged JOIN chunks USING (chunk_id)")
def hybrid_merge(spark, sf_dir, recall=recalled):
    return recall(spark, sf_dir).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "embedding")


@query(f"WITH {KEYWORDS} SELECT query_id, chunk_id, round(keyword, 6) AS keyword_score, title_score, section_score, round(coverage, 6) AS coverage_score FROM kw")
def keyword_components(spark, sf_dir, recall=recalled):
    made = search.keyword_components(recall(spark, sf_dir))
    return made.select("query_id", "chunk_id", F.round("keyword_score", 6).alias("keyword_score"), "title_score", "section_score", F.round("coverage_score", 6).alias("coverage_score"))


def candidates(spark, sf_dir, recall=recalled):
    scored = search.keyword_components(recall(spark, sf_dir)).withColumnsRenamed({"keyword_score": "keyword", "coverage_score": "coverage"})
    return ranking.fused_score(scored.withColumns({"block_count": F.lit(1), "depth": F.lit(1)}))


# --- signals, over chunks, for a fixed query where one is needed

RATIO_QUERY = "what is the quick ratio and why did liquidity change"


def signal_sql(name: str) -> str:
    t, two, s = "chunk_text", "chunk_text || ' ' || chunk_text", "lower(section)"
    if name == "length":
        return f"CASE WHEN length({t}) < 30 THEN 0.05 WHEN length({t}) < 60 THEN 0.02 WHEN length({t}) > 1800 THEN 0.10 WHEN length({t}) > 1200 THEN 0.06 ELSE 0.0 END::DOUBLE"
    if name == "numeric":
        finance = " + ".join(count_sql(two, p) for p in S.FINANCE_PATTERNS)
        n = f"(contains({t}, '$')::INT + contains({t}, '%')::INT + (({finance}) >= 2)::INT + ({count_sql(two, S.NUMBER)} >= 5)::INT)"
        return f"CASE WHEN {n} >= 3 THEN 0.08::DOUBLE WHEN {n} = 2 THEN 0.08::DOUBLE * 0.6::DOUBLE WHEN {n} = 1 THEN 0.08::DOUBLE * 0.25::DOUBLE ELSE 0.0 END"
    if name == "table":
        numeric = f"len(list_filter(string_split({t}, chr(10)), lambda r: regexp_matches(r, '{S.NUMBER}')))"
        rows = f"len(string_split({t}, chr(10)))"
        title = f"CASE WHEN {hits_sql(s, S.TABLE_WORDS)} >= 2 THEN 0.03 WHEN {hits_sql(s, S.TABLE_WORDS)} = 1 THEN 0.015 ELSE 0.0 END::DOUBLE"
        return f"least(0.06::DOUBLE, {title} + CASE WHEN {rows} >= 3 AND {numeric} / {rows} >= 0.4 THEN 0.06::DOUBLE * 0.7::DOUBLE WHEN {numeric} >= 2 THEN 0.06::DOUBLE * 0.35::DOUBLE ELSE 0.0 END)"
    if name == "noise":
        return f"CASE WHEN {any_sql(s, S.NOISE_SECTIONS)} THEN -0.04::DOUBLE WHEN length({t}) < 80 AND NOT regexp_matches({t}, '[0-9]') THEN -0.02::DOUBLE ELSE 0.0 END"
    if name == "narrative":
        n = hits_sql(f"lower({two})", S.FINANCE_WORDS)
        return f"CASE WHEN {hits_sql(s, S.NARRATIVE_NOISE)} > 0 THEN -0.05::DOUBLE ELSE CASE WHEN {hits_sql(s, S.NARRATIVE)} > 0 THEN 0.06::DOUBLE ELSE 0.0 END + CASE WHEN {n} >= 3 THEN 0.05::DOUBLE WHEN {n} >= 1 THEN 0.025::DOUBLE ELSE 0.0 END END"
    if name == "causal":
        n = hits_sql(f"lower({two})", S.CAUSAL)
        return f"CASE WHEN {n} >= 1 THEN least(0.06::DOUBLE, {n} * 0.025::DOUBLE) * 1.5::DOUBLE + CASE WHEN contains({t}, '$') OR contains({t}, '%') THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END ELSE 0.0 END"
    if name.startswith("intent"):
        n, k, d = hits_sql(f"lower({two} || ' ' || section)", S.NUMERIC_INTENT), hits_sql(f"lower({two} || ' ' || section)", S.LIST_INTENT), hits_sql(s, S.DESCRIPTIVE_INTENT)
        numeric = f"CASE WHEN {n} >= 3 THEN 0.07::DOUBLE WHEN {n} = 2 THEN 0.07::DOUBLE * 0.65::DOUBLE WHEN {n} = 1 THEN 0.07::DOUBLE * 0.3::DOUBLE ELSE 0.0 END"
        listed = f"CASE WHEN {k} >= 2 THEN 0.07::DOUBLE WHEN {k} = 1 THEN 0.07::DOUBLE * 0.5::DOUBLE ELSE 0.0 END"
        told = f"CASE WHEN {d} >= 1 THEN 0.07::DOUBLE * 0.5::DOUBLE ELSE 0.0 END"
        return numeric if name == "intent" else f"CASE intent WHEN 'numeric_fact' THEN {numeric} WHEN 'list_fact' THEN {listed} WHEN 'descriptive' THEN {told} ELSE 0.0 END"
    whole, digits = f"lower({t} || ' ' || section)", f"len(list_filter(string_split({t}, chr(10)), lambda r: regexp_matches(r, '[0-9]')))"
    single = f"CASE WHEN contains({whole}, 'total current liabilities') AND {digits} >= 3 THEN 2.5 ELSE 0.35 END"
    boost = {r: f"CASE WHEN {hits_sql(whole, p)} >= 4 THEN 1.2 WHEN {hits_sql(whole, p)} = 3 THEN 1.0 WHEN {hits_sql(whole, p)} = 2 THEN 0.7 WHEN {hits_sql(whole, p)} = 1 THEN {single} ELSE 0.0 END::DOUBLE" for r, p in S.RATIOS.items()}
    if name == "ratio":
        return boost["quick ratio"]
    return "CASE " + " ".join(f"WHEN contains(lq, {quote(r)}) THEN {x}" for r, x in boost.items()) + " ELSE 0.0 END"


def _signal(name: str, column) -> None:
    def run(spark, sf_dir):
        return chunk_table(spark, sf_dir).select("chunk_id", F.round(column(F.col("chunk_text"), F.col("section")).cast("double"), 6).alias("value"))

    run.__name__ = f"signal_{name}"
    query(f"WITH {CHUNKS} SELECT chunk_id, round({signal_sql(name)}, 6) AS value FROM chunks")(run)


_signal("length", lambda t, s: S.length_penalty(t))
_signal("numeric", lambda t, s: S.numeric_density(t, t))
_signal("table", S.table_like)
_signal("noise", S.noise_penalty)
_signal("narrative", lambda t, s: S.narrative_bonus(t, t, s))
_signal("causal", lambda t, s: S.causal_bonus(t, t, F.lit(RATIO_QUERY)))
_signal("intent", lambda t, s: S.intent_match(t, t, s, F.lit("numeric_fact")))
_signal("ratio", lambda t, s: S.ratio_boost(t, s, F.lit(RATIO_QUERY)))


# --- ranking

#: Final scores (fused, top) of candidates (cand) with their keyword scores (kw).
SCORED = f"""pd AS (SELECT *, count(page_start) OVER (PARTITION BY query_id, page_start) AS on_page FROM cand),
    pages AS (SELECT query_id, count(DISTINCT page_start) AS pages FROM cand GROUP BY 1),
    asked AS (SELECT DISTINCT query_id, query, lower({mixed_sql('query')}) AS lq, lower(query) AS plain FROM cand),
    counts AS (SELECT *, {count_sql('plain', Q.NUMERIC)} AS n, {count_sql('plain', Q.LISTS)} AS s, {count_sql('plain', Q.DESCRIPTIVE)} AS d FROM asked),
    intents AS (SELECT *, CASE WHEN n > s AND n > d THEN 'numeric_fact' WHEN s > n AND s > d THEN 'list_fact' WHEN d > n AND d > s THEN 'descriptive' ELSE 'hybrid' END AS intent FROM counts),
    ki AS (SELECT query_id, lq, intent, len({terms_sql('query')}) <= 2 AS few, {hits_sql('lq', S.DRIVERS)} > 0 AS drv,
        intent = 'numeric_fact' AND {hits_sql('lq', ['quick ratio', 'current ratio', 'liquidity', 'working capital'])} > 0 AS rq FROM intents),
    fused AS (SELECT pd.query_id, pd.chunk_id, pd.doc_id, pd.chunk_index, pd.section, pd.page_start, pd.chunk_text, round(
        CASE WHEN rq THEN 0.10 WHEN few THEN 0.40 ELSE 0.45 END::DOUBLE * embedding
        + CASE WHEN embedding = 0 AND bm25 > 0 THEN 0.35 WHEN rq THEN 0.35 WHEN few THEN 0.23 ELSE 0.20 END::DOUBLE * keyword
        + CASE WHEN embedding = 0 AND bm25 > 0 THEN 0.25 WHEN rq THEN 0.35 WHEN few THEN 0.12 ELSE 0.10 END::DOUBLE * bm25
        + CASE WHEN rq THEN 0.10 ELSE 0.15 END::DOUBLE * title_score + 0.10::DOUBLE * section_score + 0.08::DOUBLE * coverage
        + CASE WHEN embedding = 0 AND bm25 > 0 THEN 0.06 ELSE 0.0 END::DOUBLE + 0.035::DOUBLE
        + {signal_sql('narrative')}
        + CASE WHEN page_start IS NULL OR pages.pages <= 1 THEN 0.0 WHEN on_page < 20 / least(pages.pages, 5) THEN 0.03::DOUBLE * (1 - on_page / (20 / least(pages.pages, 5)))
            WHEN on_page > 20 / least(pages.pages, 5) * 1.5 THEN -0.02::DOUBLE * (on_page / (20 / least(pages.pages, 5)) - 1) ELSE 0.0 END
        + {signal_sql('causal').replace('* 1.5::DOUBLE', '* CASE WHEN ki.drv THEN 1.5::DOUBLE ELSE 1.0 END')}
        + {signal_sql('numeric')} + {signal_sql('table')} + {signal_sql('intents')} + {signal_sql('ratios')} + {signal_sql('noise')} - {signal_sql('length')}, 6) AS final_score
        FROM pd JOIN kw USING (query_id, chunk_id) JOIN pages USING (query_id) JOIN ki USING (query_id)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id DESC)::INTEGER AS rank FROM fused)"""
FUSED = f"{KEYWORDS}, {SCORED}"


@query(f"WITH {FUSED} SELECT query_id, chunk_id, doc_id, final_score, rank FROM top WHERE rank <= 10")
def rerank_fused(spark, sf_dir, recall=recalled):
    """The flagship: full text and vector recall, keyword scores, all signals, top 10 of every question."""
    return search.top_k(candidates(spark, sf_dir, recall), 10, "final_score").select("query_id", "chunk_id", "doc_id", "final_score", "rank")


SMOOTH = f"""{FUSED}, best AS (SELECT query_id, page_start, max(final_score) AS best FROM fused GROUP BY ALL),
    smooth AS (SELECT b.query_id, b.page_start, round(b.best + 0.15::DOUBLE * greatest(coalesce(l.best, 0), coalesce(r.best, 0), 0), 6) AS smoothed FROM best b
        LEFT JOIN best l ON l.query_id = b.query_id AND l.page_start = b.page_start - 1 LEFT JOIN best r ON r.query_id = b.query_id AND r.page_start = b.page_start + 1)"""


@query(f"WITH {SMOOTH} SELECT * FROM smooth")
def page_smooth(spark, sf_dir, recall=recalled):
    return ranking.smoothed_pages(candidates(spark, sf_dir, recall))


@query(f"""WITH {FUSED}, o AS (SELECT *, (row_number() OVER (PARTITION BY query_id, page_start ORDER BY final_score DESC, chunk_id) > 5)::INT AS over_ FROM fused),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over_, final_score DESC, chunk_id) AS pos FROM o)
    SELECT query_id, chunk_id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id)::INTEGER AS rank FROM k WHERE pos <= 12""")
def page_cap(spark, sf_dir, recall=recalled):
    return ranking.page_capped(candidates(spark, sf_dir, recall), 12).select("query_id", "chunk_id", "final_score", "rank")


@query()
def greedy_dedup(spark, sf_dir, recall=recalled):
    return ranking.greedy_distinct(candidates(spark, sf_dir, recall), 20)


@query(f"""WITH {FUSED}, cen AS (SELECT * FROM top WHERE rank <= 10),
    nb AS (SELECT c.query_id, n.chunk_id, c.rank AS a, CASE WHEN n.chunk_index < c.chunk_index THEN 0 ELSE 1 END AS b, c.final_score FROM cen c JOIN chunks n ON n.doc_id = c.doc_id AND abs(n.chunk_index - c.chunk_index) = 1 AND n.section = c.section
        WHERE NOT EXISTS (SELECT 1 FROM cen x WHERE x.query_id = c.query_id AND x.chunk_id = n.chunk_id)),
    one AS (SELECT query_id, chunk_id, a, b, final_score FROM nb QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY a, b) = 1),
    u AS (SELECT query_id, chunk_id, final_score, false AS is_neighbor, 0 AS late, rank AS a, 0 AS b FROM cen UNION ALL SELECT query_id, chunk_id, round(least(final_score * 0.45::DOUBLE, final_score - 0.7::DOUBLE), 6), true, 1, a, b FROM one)
    SELECT query_id, chunk_id, final_score, is_neighbor FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late, a, b, chunk_id) <= 15 OR NOT is_neighbor""")
def neighbor_expand(spark, sf_dir, recall=recalled):
    centers = scratch.keep(search.top_k(candidates(spark, sf_dir, recall), 10, "final_score").drop("dl"), "centers")
    return ranking.with_neighbors(centers, index(spark, sf_dir).chunks, 15)


@query()
def section_group(spark, sf_dir, recall=recalled):
    return ranking.sections(candidates(spark, sf_dir, recall)).drop("combined_text")


@query()
def section_scores(spark, sf_dir, recall=recalled):
    return ranking.section_lexical(ranking.sections(candidates(spark, sf_dir, recall)).join(questions(spark, sf_dir), "query_id"))


# --- the same over the whole recall, under names of their own

def bm25_sql(index: str, frequency: str, terms: str, k: int) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, chunk_id DESC) AS rank FROM
        (SELECT query_id, part, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
        FROM {index} JOIN {terms} USING (term) JOIN {frequency} USING (term), totals GROUP BY query_id, part, chunk_id) QUALIFY rank <= {k})"""


WHOLE_RECALL = f"""{POSTINGS}, expansions AS (SELECT query_id - 1000 AS query_id, expanded FROM ({expand_sql()}) WHERE query_id >= 1000), fin AS (SELECT query_id, {mixed_sql('query')} AS plain, expanded FROM expansions JOIN (SELECT item_id AS query_id, text AS query FROM benchmark) USING (query_id)
        WHERE {hits_sql(f"lower({mixed_sql('query')})", Q.FINANCIAL)} > 0 OR (regexp_matches({mixed_sql('query')}, '{X.CJK}') AND {hits_sql(mixed_sql('query'), Q.FINANCIAL[:15])} > 0)),
    parts AS (SELECT item_id AS query_id, 'asked' AS part, text AS q FROM benchmark UNION ALL SELECT query_id, 'expanded', expanded FROM fin
        UNION ALL SELECT query_id, 'ratio', {quote(search.LIABILITIES)} FROM fin WHERE {hits_sql('lower(plain)', search.RATIO_WORDS)} > 0),
    wterms AS (SELECT DISTINCT query_id, part, term FROM (SELECT query_id, part, unnest({TOKENS.format("q")}) AS term FROM parts)),
    pterms AS (SELECT * FROM wterms WHERE part <> 'ratio'),
    begun AS (SELECT t.term, v.word FROM (SELECT DISTINCT term FROM pterms) t JOIN (SELECT DISTINCT term AS word FROM postings) v ON starts_with(v.word, t.term)),
    ppost AS (SELECT b.term, p.chunk_id, sum(p.tf) AS tf, any_value(p.dl) AS dl FROM begun b JOIN postings p ON p.term = b.word GROUP BY ALL),
    pfreq AS (SELECT term, count(*) AS df FROM ppost GROUP BY term),
    hits AS (SELECT *, CASE WHEN part = 'ratio' THEN 2 ELSE 0 END AS o FROM {bm25_sql('postings', 'freq', 'wterms', 400)} UNION ALL SELECT *, 1 FROM {bm25_sql('ppost', 'pfreq', 'pterms', 400)}),
    first_ AS (SELECT * FROM (SELECT query_id, chunk_id, max(score) AS score FROM hits WHERE part = 'asked' GROUP BY query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) <= 400),
    more AS (SELECT query_id, chunk_id, arg_min(score, o) AS score, max((part = 'ratio')::INT) AS ratio FROM hits WHERE part <> 'asked' AND rank <= CASE WHEN part = 'ratio' THEN 20 ELSE 60 END GROUP BY ALL),
    second_ AS (SELECT query_id, chunk_id, score FROM (SELECT *, max(ratio) OVER (PARTITION BY query_id) AS any_ratio FROM more) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) <= 60 * (1 + any_ratio)),
    lex AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END AS bm25 FROM first_
        UNION ALL SELECT query_id, chunk_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE score END FROM second_),
    vec {RECALL.split(" vec ", 1)[1]}"""


def _whole(f: Callable) -> None:
    def run(spark, sf_dir):
        return f(spark, sf_dir, recalled_whole)

    run.__name__ = f"{f.__name__}_whole"
    sql = ORACLES.get(f.__name__)
    query(sql and sql.replace(RECALL, WHOLE_RECALL))(run)


for _f in (hybrid_merge, keyword_components, rerank_fused, page_smooth, page_cap, greedy_dedup, neighbor_expand, section_group, section_scores):
    _whole(_f)


# --- store


@query("SELECT doc_id, lang, source FROM documents WHERE source ILIKE '%c1%' OR lang ILIKE '%c1%' OR text ILIKE '%c1%'")
def doc_like_search(spark, sf_dir):
    return store.like_search(table(spark, sf_dir, "documents"), "c1", ["source", "lang", "text"]).select("doc_id", "lang", "source")


@query("SELECT d.doc_id, d.lang, first_pos AS pos FROM documents d JOIN (SELECT item_id * 7 AS id, min(item_id) AS first_pos FROM benchmark GROUP BY 1) b ON b.id = d.doc_id")
def chunks_by_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).alias("id"), F.col("item_id").alias("pos"))
    return store.by_ids(table(spark, sf_dir, "documents"), ids, "doc_id").select("doc_id", "lang", "pos")


HASHES = f"{CHUNKS}, old AS (SELECT doc_id, md5(chunk_text) AS chunk_hash FROM chunks), new AS (SELECT doc_id, md5(CASE WHEN (doc_id + chunk_index) % 3 = 0 THEN chunk_text || '!' ELSE chunk_text END) AS chunk_hash FROM chunks)"


@query(f"""WITH {HASHES}, m AS (SELECT doc_id, chunk_hash, max(was) AS was, max(is_) AS is_ FROM (SELECT doc_id, chunk_hash, 1 AS was, 0 AS is_ FROM old UNION ALL SELECT doc_id, chunk_hash, 0, 1 FROM new) GROUP BY ALL)
    SELECT doc_id, chunk_hash, CASE WHEN was + is_ = 2 THEN 'unchanged' WHEN is_ = 1 THEN 'insert' ELSE 'delete' END AS change FROM m""")
def hash_diff_incremental(spark, sf_dir):
    """Chunks against a version in which a third of them has changed."""
    chunks = chunk_table(spark, sf_dir)
    edited = F.when((F.col("doc_id") + F.col("chunk_index")) % 3 == 0, F.concat("chunk_text", F.lit("!"))).otherwise(F.col("chunk_text"))
    return store.hash_diff(chunks.select("doc_id", F.md5("chunk_text").alias("chunk_hash")), chunks.select("doc_id", F.md5(edited).alias("chunk_hash")))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'label' || l.quality END AS lang FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT l.doc_id, 'label' || l.quality FROM labels l ANTI JOIN documents d USING (doc_id)")
def upsert_chunks(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("lang"))
    return store.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang"), changes, ["doc_id"])


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(spark, sf_dir):
    """Chunks left when toxic documents are deleted."""
    return store.delete(chunk_table(spark, sf_dir), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("chunk_id")


# --- chats


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS back FROM conversations QUALIFY back <= 3")
def chat_history_topn(spark, sf_dir):
    return store.last_messages(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "back")


@query("SELECT conv_id, max(turn) AS last_turn, max_by(role, turn) AS last_role, count(*) AS messages, count(*) >= 12 AS wants_summary FROM conversations GROUP BY conv_id")
def session_last_message(spark, sf_dir):
    return store.sessions(table(spark, sf_dir, "conversations"))


@query("WITH l AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS prompt FROM l GROUP BY conv_id")
def history_prompt(spark, sf_dir):
    return store.history_prompt(table(spark, sf_dir, "conversations"), 4)


@query("SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || chr(10) || text, chr(10) ORDER BY turn)) AS digest, count(*)::INTEGER AS n FROM conversations GROUP BY conv_id")
def sharegpt_convert(spark, sf_dir):
    made = store.sharegpt(table(spark, sf_dir, "conversations"))
    flat = F.array_join(F.transform("conversations", lambda x: F.concat_ws("\n", x["from"], x["value"])), "\n")
    return made.select("conv_id", F.md5(flat).alias("digest"), F.size("conversations").alias("n"))


# --- evaluation

GOLD = f"""{BM25}, dw AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), bw AS (SELECT item_id AS query_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    dg AS (SELECT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM dw, unnest(range(1, len(w) - 6)) AS u(i)), bg AS (SELECT query_id, array_to_string(w[i:i + 7], ' ') AS gram FROM bw, unnest(range(1, len(w) - 6)) AS u(i)),
    gold AS (SELECT DISTINCT query_id, doc_id FROM bg JOIN dg USING (gram)), got AS (SELECT query_id, chunk_id, chunk_id >> 24 AS doc_id, (chunk_id & 16777215) // 3 + 1 AS page_start, rank FROM ranked WHERE rank <= 10)"""


def gold_documents(spark, sf_dir):
    """Documents that share eight words in a row with a question. Only the questions' grams are kept of the documents', by hash before any string is made."""

    def grams(df, key):
        listed = df.select(key, X.words(F.col("text")).alias("w")).filter(F.size("w") >= 8)
        at = F.explode(F.sequence(F.lit(1), F.size("w") - 7)).alias("i")
        return listed.select(key, "w", at).select(key, F.slice("w", F.col("i"), F.lit(8)).alias("gram")).withColumn("h", F.xxhash64("gram"))

    asked = scratch.keep(grams(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id").distinct(), "grams")
    held = grams(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("gram", "theirs")
    return held.join(asked, "h").filter("gram = theirs").select("query_id", "doc_id").distinct()


def retrieved(spark, sf_dir):
    found = search.fulltext(index(spark, sf_dir), questions(spark, sf_dir), 10)
    page = F.floor(chunking.index_of(F.col("chunk_id")) / 3) + 1
    return found.select("query_id", "chunk_id", chunking.document_of(F.col("chunk_id")).alias("doc_id"), page.alias("page_start"), "rank")


MRR = f"""{GOLD}, fst AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS pos FROM got GROUP BY query_id, doc_id),
    hit AS (SELECT f.query_id, min(pos) AS pos FROM fst f JOIN gold g ON g.query_id = f.query_id AND g.doc_id = f.doc_id WHERE pos <= 5 GROUP BY 1),
    mrr AS (SELECT g.query_id, coalesce((pos = 1)::INT, 0) AS doc_hit_at_1, (pos IS NOT NULL)::INT AS doc_hit_at_5, coalesce(round(1 / pos, 4), 0.0)::DOUBLE AS doc_mrr FROM (SELECT DISTINCT query_id FROM gold) g LEFT JOIN hit USING (query_id))"""


@query(f"WITH {MRR} SELECT * FROM mrr")
def doc_hit_mrr(spark, sf_dir):
    return evaluation.document_metrics(retrieved(spark, sf_dir), gold_documents(spark, sf_dir))


@query(f"WITH {MRR} SELECT count(*) AS n, printf('%d/%d (%.1f%%)', sum(doc_hit_at_1)::BIGINT, count(*), 100 * sum(doc_hit_at_1) / count(*)) AS doc_hit_at_1, printf('%d/%d (%.1f%%)', sum(doc_hit_at_5)::BIGINT, count(*), 100 * sum(doc_hit_at_5) / count(*)) AS doc_hit_at_5, round(avg(doc_mrr), 4) AS doc_mrr FROM mrr")
def run_summary(spark, sf_dir):
    return evaluation.summary(doc_hit_mrr(spark, sf_dir))


@query(f"""WITH {GOLD}, pg AS (SELECT DISTINCT query_id, doc_id % 5 + 1 AS page FROM gold),
    h AS (SELECT r.query_id, min(r.rank) AS pos FROM got r JOIN pg ON pg.query_id = r.query_id AND r.page_start BETWEEN pg.page - 1 AND pg.page + 1 WHERE r.rank <= 5 GROUP BY 1)
    SELECT g.query_id, coalesce((pos = 1)::INT, 0) AS page_hit_at_1, (pos IS NOT NULL)::INT AS page_hit_at_5, coalesce(round(1 / pos, 4), 0.0)::DOUBLE AS page_mrr FROM (SELECT DISTINCT query_id FROM pg) g LEFT JOIN h USING (query_id)""")
def page_hit(spark, sf_dir):
    gold = gold_documents(spark, sf_dir).select("query_id", (F.col("doc_id") % 5 + 1).alias("page"))
    return evaluation.page_metrics(retrieved(spark, sf_dir).withColumn("page_end", F.lit(None).cast("long")), gold, 1)


@query(f"""WITH {GOLD}, gc AS (SELECT query_id, doc_id * 16777216 AS chunk_id FROM gold), h AS (SELECT r.query_id, min(r.rank) AS pos, count(*) AS found FROM got r JOIN gc USING (query_id, chunk_id) WHERE r.rank <= 5 GROUP BY 1), w AS (SELECT query_id, count(*) AS wanted FROM gc GROUP BY 1)
    SELECT query_id, coalesce(pos <= 1, false) AS hit_at_1, coalesce(pos <= 3, false) AS hit_at_3, coalesce(pos <= 5, false) AS hit_at_5, round(coalesce(found, 0) / wanted, 4) AS recall_at_5, coalesce(round(1 / pos, 4), 0.0)::DOUBLE AS mrr FROM w LEFT JOIN h USING (query_id)""")
def recall_at_k(spark, sf_dir):
    """Gold chunks: the first of each gold document."""
    gold = gold_documents(spark, sf_dir).select("query_id", chunking.chunk_id(F.col("doc_id")).alias("chunk_id"))
    return evaluation.chunk_metrics(retrieved(spark, sf_dir), gold)


@query()
def evidence_similarity(spark, sf_dir):
    found = retrieved(spark, sf_dir).join(index(spark, sf_dir).chunks.select("chunk_id", "chunk_text"), "chunk_id").join(questions(spark, sf_dir), "query_id")
    return found.select("query_id", "chunk_id", F.round(evaluation.lexical_similarity(F.col("chunk_text"), F.col("query")), 6).alias("similarity"))


def answers(spark, sf_dir):
    """Assistant turns as answers to the turns before them."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("query", before).filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("query", F.lit("")).alias("query"), F.col("text").alias("answer"))


@query()
def verify_heuristic(spark, sf_dir):
    """Answers against the whole text of the document whose id is their conversation's, cited where the turn is odd."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence"))
    made = evaluation.verify(answers(spark, sf_dir).join(docs, "conv_id", "left").withColumn("cited", F.col("turn") % 2 == 1))
    return made.select("conv_id", "turn", "is_supported", "support_level", "numeric_consistency", "citation_adequate", F.array_join("reasons", ",").alias("reasons"))


@query()
def answer_labels(spark, sf_dir):
    made = answers(spark, sf_dir).withColumns({"gold_answer": F.col("query"), "must_include": F.slice(X.words(F.col("query")), 1, 2), "expected": F.when(F.col("turn") % 3 == 0, "refuse").otherwise("answer")})
    return evaluation.answer_metrics(made).select("conv_id", "turn", "numeric_match", "strict_numeric_match", "exact_match", "answer_label", "must_include_ratio")


FLAGS = ["has_gold", "doc_hit", "page_hit", "section_hit", "semantic_hit", "lexical_hit", "numeric_match", "violations", "supported", "numeric_consistent", "citation_missing", "refined", "reranked"]


@query(f"""WITH f AS (SELECT doc_id, {', '.join(f'(doc_id >> {i}) & 1 = 1 AS {name}' for i, name in enumerate(FLAGS))}, CASE WHEN doc_id % 3 = 0 THEN 'wrong' ELSE 'exact' END AS answer_label FROM documents)
    SELECT doc_id, CASE WHEN NOT has_gold THEN 'no_gold_label' WHEN NOT doc_hit THEN 'doc_miss'
        WHEN page_hit AND NOT semantic_hit THEN 'semantic_drift' WHEN page_hit AND NOT supported AND NOT numeric_consistent THEN 'numeric_inconsistency' WHEN page_hit AND NOT supported AND citation_missing THEN 'citation_missing'
        WHEN page_hit AND NOT supported THEN 'unsupported_answer' WHEN page_hit AND answer_label = 'wrong' AND (violations OR numeric_match) THEN 'answer_error' WHEN page_hit THEN 'unknown'
        WHEN section_hit AND NOT semantic_hit THEN 'semantic_drift' WHEN section_hit AND NOT supported THEN 'unsupported_answer' WHEN section_hit THEN 'chunk_miss'
        WHEN (numeric_match OR semantic_hit OR lexical_hit) AND refined AND NOT supported THEN 'refine_failed' WHEN numeric_match OR semantic_hit OR lexical_hit THEN 'section_miss'
        WHEN reranked THEN 'rerank_error' ELSE 'page_near_miss' END AS reason FROM f""")
def failure_reason(spark, sf_dir):
    """Every combination of flags that the bits of ids give."""
    bits = table(spark, sf_dir, "documents").select("doc_id", *(F.expr(f"(shiftright(doc_id, {i}) & 1) = 1").alias(name) for i, name in enumerate(FLAGS)), F.when(F.col("doc_id") % 3 == 0, "wrong").otherwise("exact").alias("answer_label"))
    return evaluation.failure_reason(bits).select("doc_id", "reason")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_histogram(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 3) SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id)::INTEGER AS pos FROM documents d JOIN t USING (source) QUALIFY pos <= 7")
def subset_topn_docs(spark, sf_dir):
    """The first seven documents of the three largest sources (a top-k report)."""
    docs = table(spark, sf_dir, "documents")
    most = docs.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3)
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.join(F.broadcast(most), "source").select("doc_id", "source", at.alias("pos")).filter("pos <= 7")


# --- blocks, tables, spans, indexing


def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.typed_blocks(table(spark, sf_dir, "documents"))


@query()
def text_parser_blocks(spark, sf_dir):
    return blocks.exploded(parsed_blocks(spark, sf_dir))


@query()
def block_clean(spark, sf_dir):
    return blocks.exploded(blocks.clean(parsed_blocks(spark, sf_dir)))


@query()
def block_content(spark, sf_dir):
    return blocks.content(blocks.clean(parsed_blocks(spark, sf_dir)))


@query()
def block_chunks(spark, sf_dir):
    return blocks.block_chunks(blocks.clean(parsed_blocks(spark, sf_dir)))


@query()
def numeric_evidence(spark, sf_dir):
    return spans.numeric_evidence(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def highlight_spans(spark, sf_dir):
    """Every word of a document's language name and source in its text."""
    docs = table(spark, sf_dir, "documents").withColumn("terms", F.array_compact(F.array("lang", "source")))
    return spans.highlight(docs, "doc_id", "text", "terms")


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_key, t: the lines of each order as a table with pipes."""
    cells = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", cells.alias("row")))).alias("l"))
    return lines.select(F.col("l_orderkey").alias("order_key"), F.concat(F.lit("line | part | flag | state\n"), F.array_join(F.col("l.row"), "\n")).alias("t"))


@query("""SELECT l_orderkey AS order_key, string_agg('line=' || l_linenumber || ' | part=' || l_partkey || ' | flag=' || l_returnflag || ' | state=' || l_linestatus, chr(10)
    ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS rows, count(*) + 1 AS n_rows FROM lineitem GROUP BY 1""")
def table_linearize(spark, sf_dir):
    parsed = order_tables(spark, sf_dir).select("order_key", tables.rows(F.col("t")).alias("p"))
    names = F.get("p", 0)
    body = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda r: tables.linear(r, names))
    return parsed.select("order_key", F.array_join(body, "\n").alias("rows"), F.size("p").cast("long").alias("n_rows"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, octet_length(encode(html))::BIGINT AS n_bytes FROM pages")
def url_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT doc_id, coalesce(source, 'unknown') AS title, coalesce(lang, '') AS lang, length(coalesce(text, ''))::BIGINT AS n FROM documents ORDER BY doc_id DESC")
def doc_list(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).orderBy(F.desc("doc_id"))


@query("SELECT conv_id, count(*) AS messages, count(*) >= 12 AS wants_summary FROM conversations GROUP BY 1")
def session_summary_trigger(spark, sf_dir):
    return store.sessions(table(spark, sf_dir, "conversations")).select("conv_id", "messages", "wants_summary")


@query("""WITH c AS (SELECT doc_id, md5(text) AS chunk_hash, doc_id % 3 AS part FROM documents WHERE text IS NOT NULL), kept AS (SELECT * FROM c WHERE part <> 0)
    SELECT doc_id, chunk_hash, chunk_hash IN (SELECT chunk_hash FROM c WHERE part <> 2) AS had_vector FROM kept""")
def index_incremental(spark, sf_dir):
    """An index over parts 0 and 1 of the documents takes part 2 and loses part 0; each chunk is a whole text here."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    chunks = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), F.md5("text").alias("chunk_hash"))
    held, gone = chunks.filter("doc_id % 3 <> 2"), F.lit(None).cast("string")
    vectors = indexing.embed(held)
    fresh = chunks.filter("doc_id % 3 = 2").unionByName(held.filter("doc_id % 3 = 0").withColumns({"chunk_text": gone, "chunk_hash": gone}))
    after, embedded = indexing.index(held, vectors, fresh)
    had = held.select("chunk_hash").distinct().withColumn("had_vector", F.lit(True))
    used = after.join(embedded.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
    return used.join(had, "chunk_hash", "left").select("doc_id", "chunk_hash", F.coalesce("had_vector", F.lit(False)).alias("had_vector"))


# --- streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return sessions.tumbling(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def stream_sessions(spark, sf_dir):
    return sessions.sessions(table(spark, sf_dir, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rerank_fused_whole"](spark, sf_dir)
