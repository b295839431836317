"""Composed retrieval, and steps of it over written examples that reach every branch: queries with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import signals as S
from vellum.operators import ranking, retrieve, search
from vellum.plans.catalog import (
    FUSED, INTENT_SQL, KEYWORDS, KW, ORACLES, RECALL, SCORED, STRIP, WHOLE_RECALL, candidates, hits_sql, index, mixed_sql, query, questions, quote, recalled, signal_sql, terms_sql, tidy_sql,
)
from vellum.sources.scratch import keep

# --- SQL of single steps


def is_table_sql(text: str, section: str) -> str:
    titles = ["balance sheet", "income statement", "cash flow", "current assets", "current liabilities", "total assets", "statement of", "financial statement", "item 7a", "quantitative and qualitative", "market risk", "assets and liabilities"]
    return f"(contains({text}, 'col_0=') OR ({hits_sql(f'lower({section})', titles)} > 0 AND contains({text}, '$') AND len(regexp_extract_all({text}, {quote(S.NUMBER)})) >= 5))"


def dedup_sql(source: str, name: str, k: int = 20) -> str:
    """``name`` (query_id, i, chosen): of the ranked rows of ``source`` the places that the greedy choice takes."""
    return f"""{name}_o AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS i,
            list_distinct(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS t, concat_ws('::', doc_id, section) AS sec, {is_table_sql('chunk_text', 'section')} AS free FROM {source}),
        {name}_r AS (SELECT a.query_id, a.i, any_value(a.free) AS free, coalesce(list(b.i) FILTER (b.sec = a.sec), []) AS beside,
            coalesce(list(b.i) FILTER (len(a.t) > 0 AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.82), []) AS alike
            FROM {name}_o a LEFT JOIN {name}_o b ON b.query_id = a.query_id AND b.i < a.i GROUP BY a.query_id, a.i),
        {name}_g AS (SELECT query_id, 0::BIGINT AS i, []::BIGINT[] AS chosen FROM (SELECT DISTINCT query_id FROM {name}_o)
            UNION ALL SELECT g.query_id, r.i, CASE WHEN len(g.chosen) >= {k} THEN g.chosen
                WHEN r.free OR (len(list_intersect(g.chosen, r.beside)) < 3 AND NOT list_has_any(g.chosen, r.alike)) THEN list_append(g.chosen, r.i) ELSE g.chosen END
            FROM {name}_g g JOIN {name}_r r ON r.query_id = g.query_id AND r.i = g.i + 1),
        {name} AS (SELECT o.query_id, o.chunk_id, list_position(e.chosen, o.i)::INTEGER AS rank
            FROM (SELECT query_id, arg_max(chosen, i) AS chosen FROM {name}_g GROUP BY 1) e JOIN {name}_o o ON o.query_id = e.query_id AND list_contains(e.chosen, o.i))"""


def sections_sql(source: str, name: str, window: int = 3) -> str:
    """``name``: sections of the rows of ``source``, pages within ``window`` of the section's first."""
    return f"""{name}_o AS (SELECT query_id, doc_id, page_start, final_score, chunk_id, section, chunk_text,
            row_number() OVER (PARTITION BY query_id, doc_id ORDER BY page_start, final_score DESC, chunk_id) AS i FROM {source} WHERE page_start IS NOT NULL),
        {name}_w AS (SELECT query_id, doc_id, i, page_start AS start, page_start, final_score, chunk_id, section, chunk_text FROM {name}_o WHERE i = 1
            UNION ALL SELECT o.query_id, o.doc_id, o.i, CASE WHEN o.page_start - w.start <= {window} THEN w.start ELSE o.page_start END, o.page_start, o.final_score, o.chunk_id, o.section, o.chunk_text
            FROM {name}_w w JOIN {name}_o o ON o.query_id = w.query_id AND o.doc_id = w.doc_id AND o.i = w.i + 1),
        {name}_m AS (SELECT query_id, doc_id, start, section FROM (SELECT query_id, doc_id, start, section, count(*) AS c FROM {name}_w GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, start ORDER BY c DESC, section) = 1),
        {name} AS (SELECT w.query_id, w.doc_id, w.start, min(page_start) AS page_start, max(page_start) AS page_end, any_value(m.section) AS section, count(*) AS chunk_count,
            round(avg(final_score), 10) AS avg_score, round(max(final_score), 6) AS max_score, max(CASE WHEN page_start = w.start THEN final_score END) AS first_page_score,
            string_agg(chunk_text, chr(10) ORDER BY page_start, final_score DESC, chunk_id) AS combined_text
            FROM {name}_w w JOIN {name}_m m USING (query_id, doc_id, start) GROUP BY ALL)"""


def section_lexical_sql(source: str, asked: str, name: str) -> str:
    """``name``: lexical scores of sections ``source`` for the queries of ``asked`` (query_id, query)."""
    return f"""{name}_t AS (SELECT s.query_id, s.doc_id, s.start, lower(concat_ws(' ', s.section, s.combined_text)) AS low, unnest({terms_sql('a.query')}) AS term FROM {source} s JOIN {asked} a USING (query_id)),
        {name} AS (SELECT query_id, doc_id, start, round(least(1.0, sum((length(low) - length(replace(low, term, ''))) / length(term)) / count(*)
            + sum((length(low) - length(replace(low, term, ''))) / length(term)) * 0.02::DOUBLE), 6) AS lexical_score FROM {name}_t GROUP BY ALL)"""


def clustered_sql(source: str, name: str, every: bool) -> str:
    """``name``: ``source`` (query_id, chunk_id, page_start, final_score, ...) with the best chunk of a page, or every one, lifted to its page's smoothed score."""
    lifted = "true" if every else f"row_number() OVER (PARTITION BY c.query_id, c.page_start ORDER BY c.final_score DESC, c.chunk_id) = 1"
    return f"""{name}_b AS (SELECT query_id, page_start, max(final_score) AS best FROM {source} WHERE page_start IS NOT NULL GROUP BY ALL),
        {name}_s AS (SELECT b.query_id, b.page_start, round(b.best + 0.15::DOUBLE * greatest(coalesce(l.best, 0), coalesce(r.best, 0), 0), 6) AS smoothed FROM {name}_b b
            LEFT JOIN {name}_b l ON l.query_id = b.query_id AND l.page_start = b.page_start - 1 LEFT JOIN {name}_b r ON r.query_id = b.query_id AND r.page_start = b.page_start + 1),
        {name} AS (SELECT c.* REPLACE (CASE WHEN s.smoothed - c.final_score > 0.01 AND {lifted} THEN s.smoothed ELSE c.final_score END AS final_score)
            FROM {source} c LEFT JOIN {name}_s s ON s.query_id = c.query_id AND s.page_start = c.page_start)"""


def finished_sql(source: str, name: str, k: int = 20) -> str:
    """``name``: what is left of ``source`` (with chunk_index, doc_id, section, chunk_text) after near copies, with neighbours, capped by page."""
    return f"""{dedup_sql(source, name + "_d", k)},
        {name}_c AS (SELECT s.*, d.rank FROM {source} s JOIN {name}_d d USING (query_id, chunk_id)),
        {name}_n AS (SELECT c.query_id, n.chunk_id, n.page_start, c.rank AS a, CASE WHEN n.chunk_index < c.chunk_index THEN 0 ELSE 1 END AS b, c.final_score FROM {name}_c c
            JOIN chunks n ON n.doc_id = c.doc_id AND abs(n.chunk_index - c.chunk_index) = 1 AND n.section = c.section
            WHERE NOT EXISTS (SELECT 1 FROM {name}_c x WHERE x.query_id = c.query_id AND x.chunk_id = n.chunk_id)),
        {name}_1 AS (SELECT * FROM {name}_n QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY a, b) = 1),
        {name}_u AS (SELECT query_id, chunk_id, page_start, final_score, false AS is_neighbor, 0 AS late, rank AS a, 0 AS b FROM {name}_c
            UNION ALL SELECT query_id, chunk_id, page_start, round(least(final_score * 0.45::DOUBLE, final_score - 0.7::DOUBLE), 6), true, 1, a, b FROM {name}_1),
        {name}_l AS (SELECT * FROM {name}_u QUALIFY NOT is_neighbor OR row_number() OVER (PARTITION BY query_id ORDER BY late, a, b, chunk_id)
            <= greatest({k}, count_if(NOT is_neighbor) OVER (PARTITION BY query_id) + 2)),
        {name}_p AS (SELECT *, (row_number() OVER (PARTITION BY query_id, coalesce(page_start::VARCHAR, '-' || chunk_id) ORDER BY final_score DESC, chunk_id) > 5)::INT AS over_ FROM {name}_l),
        {name} AS (SELECT query_id, chunk_id, page_start, final_score, is_neighbor FROM {name}_p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY over_, final_score DESC, chunk_id) <= {k})"""


#: Keyword scores as fusion sees them: the 20 best by keywords and those of the lexical recall keep theirs.
KEPT = """kw_all AS (SELECT kw.*, cand.bm25 AS b FROM kw JOIN cand USING (query_id, chunk_id)),
    kw_at AS (SELECT *, (keyword > 0 OR coverage > 0 OR b > 0) AS any_, row_number() OVER (PARTITION BY query_id
        ORDER BY CASE WHEN keyword > 0 OR coverage > 0 OR b > 0 THEN round(0.60::DOUBLE * keyword + 0.23::DOUBLE * title_score + 0.17::DOUBLE * section_score, 9) END DESC NULLS LAST, chunk_id) AS at_ FROM kw_all),
    kw_kept AS (SELECT query_id, chunk_id, CASE WHEN k THEN keyword ELSE 0 END AS keyword, CASE WHEN k THEN title_score ELSE 0 END AS title_score, CASE WHEN k THEN section_score ELSE 0 END AS section_score,
        CASE WHEN k THEN coverage ELSE 0 END AS coverage FROM (SELECT *, (any_ AND at_ <= 20) OR b > 0 AS k FROM kw_at))"""
RANKED = f"{KEYWORDS}, {KEPT}, {SCORED.replace('JOIN kw USING', 'JOIN kw_kept USING')}"
TOP = "SELECT query_id, chunk_id, final_score, is_neighbor, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id DESC)::INTEGER AS rank FROM {} QUALIFY rank <= 3"
SECTION_SCORES = f"""best20 AS (SELECT * FROM top WHERE rank <= 20), {sections_sql('best20', 'sec')}, asks AS (SELECT DISTINCT query_id, query FROM cand), {section_lexical_sql('sec', 'asks', 'lexi')},
    sec_d AS (SELECT sec.*, lexical_score, first_page_score AS dense FROM sec JOIN lexi USING (query_id, doc_id, start)),
    sec_s AS (SELECT *, round(0.60::DOUBLE * dense / CASE WHEN max(dense) OVER w > 0 THEN max(dense) OVER w ELSE 1 END + 0.40::DOUBLE * lexical_score / CASE WHEN max(lexical_score) OVER w > 0 THEN max(lexical_score) OVER w ELSE 1 END
        + least(0.1::DOUBLE, {hits_sql('lower(section)', ranking.TITLES)} * 0.03::DOUBLE), 6) AS section_score FROM sec_d WINDOW w AS (PARTITION BY query_id)),
    sec_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section_score DESC, doc_id, start)::INTEGER AS rank FROM sec_s QUALIFY rank <= 5)"""
NEAR = """near AS (SELECT t.query_id, t.chunk_id, t.doc_id, t.chunk_index, t.section, t.page_start, t.chunk_text, round(t.final_score + 0.06::DOUBLE * greatest(coalesce(s.section_score, 0), 0), 8) AS final_score
    FROM top t LEFT JOIN sec_k s ON s.query_id = t.query_id AND s.doc_id = t.doc_id AND s.start = t.page_start WHERE t.rank <= 5 OR s.section_score IS NOT NULL)"""


def scored(spark, sf_dir) -> DataFrame:
    return retrieve.fused(recalled(spark, sf_dir))


@query(f"WITH RECURSIVE {RANKED}, {clustered_sql('fused', 'lifted', False)}, {finished_sql('lifted', 'done')} {TOP.format('done')}")
def retrieve_single(spark, sf_dir):
    """The whole default retrieval of every question: recall, fusion, page clustering, near copies, neighbours, page caps, the best three."""
    return retrieve.single(recalled(spark, sf_dir), index(spark, sf_dir).chunks)


@query(f"""WITH RECURSIVE {RANKED}, {clustered_sql('fused', 'lifted', False)}, one_doc AS (SELECT * FROM lifted WHERE doc_id = 7), {finished_sql('one_doc', 'done')} {TOP.format('done')}""")
def retrieve_filtered(spark, sf_dir):
    """The same, restricted to document 7 after ranking."""
    return retrieve.single(recalled(spark, sf_dir), index(spark, sf_dir).chunks, doc_filter=7)


@query(f"WITH RECURSIVE {RANKED}, {SECTION_SCORES}, {NEAR}, {finished_sql('near', 'done')}, {clustered_sql('done', 'up', True)} {TOP.format('up')}")
def retrieve_multistage(spark, sf_dir):
    """Retrieval by sections first, without a model for their dense scores."""
    return retrieve.multistage(recalled(spark, sf_dir), index(spark, sf_dir).chunks)


@query(f"WITH RECURSIVE {RANKED}, {SECTION_SCORES} SELECT query_id, doc_id, start, section_score, rank FROM sec_k")
def section_retrieval(spark, sf_dir):
    return retrieve.best_sections(scored(spark, sf_dir)).select("query_id", "doc_id", "start", "section_score", "rank")


@query(f"WITH RECURSIVE {RANKED}, {SECTION_SCORES}, {NEAR} SELECT query_id, chunk_id, final_score FROM near")
def section_relevance(spark, sf_dir):
    ranked = scored(spark, sf_dir)
    return retrieve.section_relevance(ranked, retrieve.best_sections(ranked)).select("query_id", "chunk_id", "final_score")


@query(f"""WITH RECURSIVE {RANKED}, {SECTION_SCORES}, mem AS (SELECT b.query_id, b.chunk_id, b.final_score, s.section_score, s.rank AS sr FROM best20 b JOIN sec_k s ON s.query_id = b.query_id AND s.doc_id = b.doc_id AND b.page_start BETWEEN s.page_start AND s.page_end),
    at_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, sr ORDER BY final_score DESC, chunk_id) AS pos FROM mem)
    SELECT query_id, chunk_id, section_score, row_number() OVER (PARTITION BY query_id ORDER BY sr, pos)::INTEGER AS rank FROM at_ WHERE pos <= 5""")
def section_capped(spark, sf_dir):
    ranked = scored(spark, sf_dir)
    return ranking.section_capped(search.top_k(ranked, 20, "final_score").drop("rank"), retrieve.best_sections(ranked))


@query(f"WITH {RANKED} SELECT query_id, chunk_id, round(keyword, 6) AS keyword, title_score, section_score, round(coverage, 6) AS coverage FROM kw_kept")
def keyword_recall(spark, sf_dir):
    made = search.keyword_components(recalled(spark, sf_dir)).withColumnsRenamed({"keyword_score": "keyword", "coverage_score": "coverage"})
    return ranking.keyword_recalled(made).select("query_id", "chunk_id", F.round("keyword", 6).alias("keyword"), "title_score", "section_score", F.round("coverage", 6).alias("coverage"))


@query(f"WITH {FUSED}, {clustered_sql('fused', 'lifted', False)} SELECT query_id, chunk_id, final_score FROM lifted")
def page_cluster_best(spark, sf_dir):
    return ranking.clustered(keep(candidates(spark, sf_dir), "fused")).select("query_id", "chunk_id", "final_score")


@query(f"WITH {FUSED}, {clustered_sql('fused', 'lifted', True)} SELECT query_id, chunk_id, final_score FROM lifted")
def page_cluster_all(spark, sf_dir):
    return ranking.clustered(keep(candidates(spark, sf_dir), "fused"), every=True).select("query_id", "chunk_id", "final_score")


@query(f"""WITH {FUSED} SELECT query_id, chunk_id, round(CASE WHEN page_start IS NULL OR p.pages <= 1 THEN 0.0 WHEN on_page < 20 / least(p.pages, 5) THEN 0.03::DOUBLE * (1 - on_page / (20 / least(p.pages, 5)))
    WHEN on_page > 20 / least(p.pages, 5) * 1.5 THEN -0.02::DOUBLE * (on_page / (20 / least(p.pages, 5)) - 1) ELSE 0.0 END, 6) AS bonus FROM pd JOIN pages p USING (query_id)""")
def page_diversity(spark, sf_dir):
    found = recalled(spark, sf_dir)
    return found.select("query_id", "chunk_id", F.round(ranking.page_diversity(found), 6).alias("bonus"))


@query(f"""WITH {FUSED}, best AS (SELECT query_id, chunk_id, final_score, rank FROM top WHERE rank <= 12),
    told AS (SELECT *, CASE WHEN query_id % 4 <> 0 AND chunk_id % 3 <> 0 THEN (chunk_id % 10) / 10::DOUBLE END AS r FROM best),
    mixed AS (SELECT *, max(CASE WHEN rank <= 8 THEN r END) OVER (PARTITION BY query_id) IS NOT NULL AS applied FROM told)
    SELECT query_id, chunk_id, applied, round(CASE WHEN applied AND rank <= 8 THEN 0.6::DOUBLE * final_score + 0.4::DOUBLE * coalesce(r, 0.1::DOUBLE) ELSE final_score END, 6) AS combined_score FROM mixed""")
def rerank_by_model(spark, sf_dir):
    """A stand-in for a model's scores: none for every fourth question and every third chunk."""
    best = keep(search.top_k(candidates(spark, sf_dir), 12, "final_score").select("query_id", "chunk_id", "final_score"), "best")
    said = best.filter("query_id % 4 <> 0 AND chunk_id % 3 <> 0").select("query_id", "chunk_id", ((F.col("chunk_id") % 10) / 10).alias("relevance"))
    return retrieve.rerank(best, said, weight=0.4).select("query_id", "chunk_id", "applied", "combined_score")


# --- examples that reach every branch

EXAMPLES = [
    # query, text, section, title, page, embedding, bm25
    ("What is the quick ratio of Acme in 2022?", "Cash and cash equivalents $1,200\nAccounts receivable 300\nTotal current liabilities 900\nshort-term investments 40", "Balance Sheet", "Acme 10-K", 1, 0.9, 0.4),
    ("What is the quick ratio of Acme in 2022?", "Total current liabilities 900\n100\n200\n300", "Notes", "Acme", 2, 0.4, 0.0),
    ("What is the quick ratio of Acme in 2022?", "receivables rose", "Overview", "Acme", 2, 0.0, 1.0),
    ("What is the quick ratio of Acme in 2022?", "table of contents 3", "Table of Contents", "Acme", None, 0.1, 0.0),
    ("current ratio, working capital and total debt", "current assets and current liabilities were 12% and $5 million, driven by cash", "Liquidity", "Beta", 1, 0.8, 0.8),
    ("current ratio, working capital and total debt", "Working capital declined primarily due to inventories", "Results of Operations", "current ratio", 9, 0.2, 0.1),
    ("What products and services does it offer?", "Our business has products, services and brands in one segment. We offer more.", "Business Overview", "products and services", 3, 0.5, 0.5),
    ("What products and services does it offer?", "a category", "Exhibit index", "Beta", 4, 0.5, 0.0),
    ("Why did it fall? explain the trend", "It fell due to weather. Sales declined and margin improved by 3%.", "Management discussion and analysis", "trend", 1, 0.3, 0.2),
    ("Why did it fall? explain the trend", "short", "Schedule of exhibits", "", 1, 0.6, 0.0),
    ("cash", "Cash of $10.5 billion, $3 million, 7% and 12 million against 5,000 and 6,000", "Cash flow", "cash", 5, 0.1, 0.9),
    ("cash", "nothing here but words that go on and on " * 40, "Forward-looking statements", "x", 6, 0.7, 0.0),
    ("cash", "words " * 350, "Attachment one", "cash cash", 6, 0.0, 0.3),
    ("U.S. co-op e-mail: 3.14 a/b", "The U.S. co-op sent e-mail about 3.14 and a/b.", "e-mail", "U.S. plan", 2, 0.2, 0.2),
    ("现金 流量 in 2021", "现金流量 2021", "现金", "年报 2021", 7, 0.4, 0.6),
]


def example_rows(spark) -> DataFrame:
    names = sorted({q for q, *_ in EXAMPLES})
    rows = [(names.index(q), i, q, 1, i, text, title, section, page, embedding, bm25) for i, (q, text, section, title, page, embedding, bm25) in enumerate(EXAMPLES)]
    return spark.createDataFrame(rows, "query_id long, chunk_id long, query string, doc_id long, chunk_index long, chunk_text string, title string, section string, page_start long, embedding double, bm25 double")


def _examples_sql() -> str:
    names = sorted({q for q, *_ in EXAMPLES})
    rows = ", ".join(f"({names.index(q)}, {i}, {bm25}::DOUBLE, {embedding}::DOUBLE, {quote(q)}, 1, {i}, {quote(text)}, {quote(title)}, {quote(section)}, {'NULL' if page is None else page})" for i, (q, text, section, title, page, embedding, bm25) in enumerate(EXAMPLES))
    return f"cand AS (SELECT * FROM (VALUES {rows}) AS v(query_id, chunk_id, bm25, embedding, query, doc_id, chunk_index, chunk_text, title, section, page_start))"


@query(f"WITH {_examples_sql()}, {KW}, {SCORED} SELECT query_id, chunk_id, final_score, rank FROM top")
def fused_examples(spark, sf_dir):
    """The fused score where every regime, intent and boost occurs."""
    scored_ = search.keyword_components(example_rows(spark)).withColumnsRenamed({"keyword_score": "keyword", "coverage_score": "coverage"})
    made = ranking.fused_score(scored_.withColumns({"block_count": F.lit(1), "depth": F.lit(1)}))
    return search.top_k(made, 100, "final_score").select("query_id", "chunk_id", "final_score", "rank")


_SIGNALS = ["length", "numeric", "table", "noise", "narrative", "causal"]


@query(f"""WITH {_examples_sql()}, {KW}, {SCORED}, e AS (SELECT * FROM cand JOIN ki USING (query_id))
    SELECT chunk_id, {', '.join(f'round({signal_sql(n)}, 6) AS "{n}"' for n in _SIGNALS)}, round({signal_sql('intents')}, 6) AS intent_match, round({signal_sql('ratios')}, 6) AS ratio,
    {is_table_sql('chunk_text', 'section')} AS is_table FROM e""")
def signal_examples(spark, sf_dir):
    t, s, q = F.col("chunk_text"), F.col("section"), Q.normalize_mixed(F.col("query"))
    fixed = F.lit("why did it change")
    columns = {"length": S.length_penalty(t), "numeric": S.numeric_density(t, t), "table": S.table_like(t, s), "noise": S.noise_penalty(t, s), "narrative": S.narrative_bonus(t, t, s), "causal": S.causal_bonus(t, t, fixed), "intent_match": S.intent_match(t, t, s, Q.intent(F.col("query"))), "ratio": S.ratio_boost(t, s, q)}
    return example_rows(spark).select("chunk_id", *(F.round(c.cast("double"), 6).alias(n) for n, c in columns.items()), S.is_table(t, s).alias("is_table"))


@query("SELECT blocks AS n_blocks, depth, listed, tabled, round(CASE WHEN blocks BETWEEN 1 AND 6 THEN 0.02 ELSE 0 END + CASE WHEN depth BETWEEN 1 AND 4 THEN 0.015 ELSE 0 END + CASE WHEN listed THEN 0.01 ELSE 0 END + CASE WHEN tabled THEN 0.008 ELSE 0 END, 6)::DOUBLE AS bonus FROM (SELECT doc_id % 9 AS blocks, doc_id % 7 AS depth, doc_id % 2 = 0 AS listed, doc_id % 3 = 0 AS tabled FROM documents)")
def signal_metadata(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flags = docs.select((F.col("doc_id") % 9).alias("n_blocks"), (F.col("doc_id") % 7).alias("depth"), (F.col("doc_id") % 2 == 0).alias("listed"), (F.col("doc_id") % 3 == 0).alias("tabled"))
    return flags.withColumn("bonus", F.round(S.metadata_bonus(F.col("n_blocks"), F.col("depth"), F.col("listed"), F.col("tabled")), 6))


# --- SQL for queries of the catalogue that had none


def rewrite_sql() -> str:
    low = "low"
    bare = "CASE " + " ".join(f"WHEN starts_with(low, {quote(p)}) THEN {STRIP.format(f'substr(low, {len(p) + 1})')}" for p in Q.PREFIXES) + " ELSE low END"
    unless = lambda gate, phrases: [f"CASE WHEN {gate} AND NOT contains({low}, {quote(t)}) THEN {quote(t)} END" for t in phrases]
    added = [f"CASE WHEN intent = 'numeric_fact' AND short THEN {quote(t)} END" for t in Q.SECTIONS[:5]]
    added += unless("intent = 'numeric_fact'", Q.METRICS) + unless("intent = 'list_fact' AND short", Q.LIST_TERMS) + unless("intent = 'descriptive' AND short", Q.DESCRIPTIVE_TERMS)
    some = lambda parts: f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"""{INTENT_SQL}, o AS (SELECT query_id, intent, {STRIP.format("coalesce(query, '')")} AS orig FROM k), l AS (SELECT *, lower(orig) AS low FROM o), b AS (SELECT *, {bare} AS bare FROM l),
        n AS (SELECT *, len(regexp_extract_all({tidy_sql('bare')}, {quote(Q.ASCII_TERM)})) AS left_ FROM b), s AS (SELECT *, left_ <= 3 AS short FROM n),
        a AS (SELECT *, {some(added)} AS added, {some(unless('left_ <= 2', Q.SECTIONS))} AS more FROM s)
        SELECT query_id, array_to_string(list_concat([orig], added, more[1:greatest(0, 4 - len(added))]), ' ') AS rewritten FROM a"""


ORACLES["query_rewrite"] = rewrite_sql()
ORACLES["greedy_dedup"] = f"WITH RECURSIVE {FUSED}, {dedup_sql('fused', 'd')} SELECT * FROM d"
ORACLES["section_group"] = f"WITH RECURSIVE {FUSED}, {sections_sql('fused', 'sec')} SELECT * EXCLUDE (combined_text) FROM sec"
ORACLES["section_scores"] = f"WITH RECURSIVE {FUSED}, {sections_sql('fused', 'sec')}, asks AS (SELECT DISTINCT query_id, query FROM cand), {section_lexical_sql('sec', 'asks', 'lexi')} SELECT * FROM lexi"
for _name in ("section_group", "section_scores"):
    ORACLES[f"{_name}_whole"] = ORACLES[_name].replace(RECALL, WHOLE_RECALL)
