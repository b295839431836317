"""Evaluation of runs: levels of retrieval, answers, verification, summaries and diffs, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import evaluation
from vellum.plans.catalog import GOLD, INTENT_SQL, ORACLES, STRIP, answers, gold_documents, hits_sql, index, query, questions, quote, retrieved, table
from vellum.sources import chunking, scratch

__all__ = ["INTENT_SQL"]


def normalized_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\t\n\x0B\f\r \x{{a0}}\x{{3000}}]+', ' ', 'g'), '[\x{{200b}}-\x{{200f}}\x{{feff}}]', '', 'g'))"


def friendly_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({normalized_sql(c)}, '[$€£¥]', '', 'g'), '(\d),(\d{{3}})', '\1\2', 'g')"


def set_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def fuzzy_sql(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {jaccard_sql(set_sql(a), set_sql(b))} >= 0.85))"


def grams_sql(c: str) -> str:
    return f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) ELSE []::VARCHAR[] END"


def likeness_sql(source: str, name: str, keep: str) -> str:
    """``name``: the columns ``keep`` of ``source`` and ``alike``, the lexical similarity of its columns chunk and gold."""
    return f"""{name}_n AS (SELECT {keep}, coalesce(chunk, '') AS c0, coalesce(gold, '') AS g0, {normalized_sql('chunk')} AS a, {normalized_sql('gold')} AS b FROM {source}),
        {name}_t AS (SELECT *, {set_sql('a')} AS sa, {set_sql('b')} AS sb, replace(a, ' ', '') AS ba, replace(b, ' ', '') AS bb FROM {name}_n),
        {name}_g AS (SELECT *, CASE WHEN length(b) > 200 THEN {grams_sql('ba')} ELSE []::VARCHAR[] END AS ga, CASE WHEN length(b) > 200 THEN {grams_sql('bb')} ELSE []::VARCHAR[] END AS gb, {jaccard_sql('sa', 'sb')} AS tokens FROM {name}_t),
        {name} AS (SELECT {keep}, a, b, c0, g0, CASE WHEN c0 = '' OR g0 = '' THEN 0.0 WHEN contains(a, b) THEN 1.0
            WHEN length(b) > 200 THEN greatest(tokens, len(list_intersect(ga, gb)) / greatest(1, len(gb)) * 0.9::DOUBLE) ELSE tokens END::DOUBLE AS alike FROM {name}_g)"""


def level_sql(hits: str, asked: str, name: str) -> str:
    return f"""SELECT a.query_id, coalesce((h.at_ = 1)::INT, 0) AS {name}_hit_at_1, (h.at_ IS NOT NULL)::INT AS {name}_hit_at_5, coalesce(round(1 / h.at_, 4), 0.0)::DOUBLE AS {name}_mrr
        FROM (SELECT DISTINCT query_id FROM {asked}) a LEFT JOIN (SELECT query_id, min(rank) AS at_ FROM {hits} WHERE rank <= 5 GROUP BY 1) h USING (query_id)"""


ORACLES["evidence_similarity"] = f"""WITH {GOLD}, p AS (SELECT g.query_id, g.chunk_id, c.chunk_text AS chunk, b.text AS gold FROM got g JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = g.query_id),
    {likeness_sql('p', 'l', 'query_id, chunk_id')} SELECT query_id, chunk_id, round(alike, 6) AS similarity FROM l"""


# --- levels of retrieval


def gold_pages(spark, sf_dir) -> DataFrame:
    return gold_documents(spark, sf_dir).select("query_id", (F.col("doc_id") % 5 + 1).alias("page"))


def paged(spark, sf_dir) -> DataFrame:
    return retrieved(spark, sf_dir).withColumn("page_end", F.lit(None).cast("long"))


def page_level_sql(name: str, window: int) -> str:
    return f"""WITH {GOLD}, pg AS (SELECT DISTINCT query_id, doc_id % 5 + 1 AS page FROM gold),
        h AS (SELECT r.query_id, r.rank FROM got r JOIN pg ON pg.query_id = r.query_id AND r.page_start BETWEEN pg.page - {window} AND pg.page + {window}) {level_sql('h', 'pg', name)}"""


@query(page_level_sql("page", 0))
def page_hit_strict(spark, sf_dir):
    return evaluation.page_metrics(paged(spark, sf_dir), gold_pages(spark, sf_dir), 0)


@query(page_level_sql("section", 3))
def section_hit(spark, sf_dir):
    return evaluation.section_metrics(paged(spark, sf_dir), gold_pages(spark, sf_dir))


def evidence(spark, sf_dir) -> DataFrame:
    """Gold evidence of a question: its text, the first ten words of it, and an empty one."""
    parts = F.array("query", F.array_join(F.slice(X.words(F.col("query")), 1, 10), " "), F.lit(""))
    return questions(spark, sf_dir).select("query_id", F.explode(parts).alias("evidence"))


@query(f"""WITH {GOLD}, ev AS (SELECT query_id, unnest([text, array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:10], ' ')]) AS gold FROM (SELECT item_id AS query_id, text FROM benchmark)),
    p AS (SELECT g.query_id, g.rank, g.chunk_id, c.chunk_text AS chunk, e.gold FROM got g JOIN chunks c USING (chunk_id) JOIN ev e ON e.query_id = g.query_id AND e.gold <> '' WHERE g.rank <= 5), {likeness_sql('p', 'l', 'query_id, rank, chunk_id')},
    s AS (SELECT query_id, rank, max(CASE WHEN c0 <> '' AND contains(a, b) THEN 1 ELSE 0 END) AS held, max(greatest(CASE WHEN alike >= 0.42 THEN alike ELSE 0.0 END,
        CASE WHEN chunk_id % 10 >= 8 THEN (chunk_id % 10) / 10::DOUBLE ELSE 0.0 END)) AS score FROM l GROUP BY ALL),
    th AS (SELECT * FROM s WHERE held = 1), sh AS (SELECT * FROM s WHERE score >= 0.42), t AS ({level_sql('th', 'ev', 'evidence_text')}), m AS ({level_sql('sh', 'ev', 'evidence_semantic')})
    SELECT t.*, m.* EXCLUDE (query_id), coalesce(b.best, 0.0)::DOUBLE AS evidence_semantic_best_score, m.evidence_semantic_hit_at_5 AS evidence_lexical_hit_at_5
    FROM t JOIN m USING (query_id) LEFT JOIN (SELECT query_id, round(max(score), 4) AS best FROM s GROUP BY 1) b USING (query_id)""")
def evidence_hit(spark, sf_dir):
    """Evidence in the texts of what full text finds, with a stand-in for a model's cosine."""
    found = retrieved(spark, sf_dir).join(index(spark, sf_dir).chunks.select("chunk_id", "chunk_text"), "chunk_id").withColumn("cosine", F.col("chunk_id") % 10 / 10)
    return evaluation.evidence_metrics(found, evidence(spark, sf_dir))


@query(f"""WITH {GOLD}, r AS (SELECT query_id, rank, CASE WHEN rank % 2 = 0 THEN chunk_id END AS chunk_id, doc_id FROM got WHERE rank <= 5), gc AS (SELECT query_id, min(doc_id) * 16777216 AS chunk_id FROM gold WHERE query_id % 2 = 0 GROUP BY 1),
    w AS (SELECT coalesce(c.query_id, d.query_id) AS query_id, coalesce(c.n, d.n) AS n FROM (SELECT query_id, count(*) AS n FROM gc GROUP BY 1) c FULL JOIN (SELECT query_id, count(*) AS n FROM gold GROUP BY 1) d USING (query_id)),
    h AS (SELECT r.query_id, min(rank) AS at_, count(*) AS found FROM r WHERE EXISTS (SELECT 1 FROM gc WHERE gc.query_id = r.query_id AND gc.chunk_id = r.chunk_id) OR (r.chunk_id IS NULL AND EXISTS (SELECT 1 FROM gold g WHERE g.query_id = r.query_id AND g.doc_id = r.doc_id)) GROUP BY 1)
    SELECT query_id, coalesce(at_ <= 1, false) AS hit_at_1, coalesce(at_ <= 3, false) AS hit_at_3, coalesce(at_ <= 5, false) AS hit_at_5, round(coalesce(found, 0) / n, 4) AS recall_at_5, coalesce(round(1 / at_, 4), 0.0)::DOUBLE AS mrr FROM w LEFT JOIN h USING (query_id)""")
def gold_hit_fallback(spark, sf_dir):
    """Rows of odd rank have lost their chunk id and hit by document; questions of odd number have gold documents only."""
    gold = scratch.keep(gold_documents(spark, sf_dir), "gold")
    rows = retrieved(spark, sf_dir).withColumn("chunk_id", F.when(F.col("rank") % 2 == 0, F.col("chunk_id")))
    chunks = gold.filter("query_id % 2 = 0").groupBy("query_id").agg(F.min("doc_id").alias("doc_id")).select("query_id", chunking.chunk_id(F.col("doc_id")).alias("chunk_id"))
    return evaluation.gold_metrics(rows, chunks, gold)


# --- answers

TURNS = """turns AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), said AS (SELECT conv_id, turn, coalesce(before, '') AS query, text AS answer FROM turns WHERE role = 'assistant')"""


def any_phrase(c: str, phrases: list[str]) -> str:
    return f"({hits_sql(c, phrases)} > 0)"


ORACLES["answer_labels"] = rf"""WITH {TURNS}, m AS (SELECT *, query AS gold, regexp_extract_all(query, '[^\x20\x09-\x0D]+')[1:2] AS must, CASE WHEN turn % 3 = 0 THEN 'refuse' ELSE 'answer' END AS expected FROM said),
    n AS (SELECT *, {normalized_sql('answer')} AS a, {normalized_sql('gold')} AS g, {friendly_sql('answer')} AS an, {friendly_sql('gold')} AS gn FROM m),
    h AS (SELECT *, len(list_filter(list_transform(regexp_extract_all(gold, '[\d,]+\.?\d*'), lambda x: {friendly_sql('x')}), lambda x: contains(a, x) OR contains(an, x))) > 0 AS nm,
        len(list_filter(list_transform(regexp_extract_all(gold, '\d[\d,]*\.?\d*'), lambda x: {friendly_sql('x')}), lambda x: contains(a, x) OR contains(an, x))) > 0 AS sm,
        {fuzzy_sql('a', 'g')} AS eq, {fuzzy_sql('an', 'gn')} AS eqn, CASE WHEN len(must) > 0 THEN len(list_filter(must, lambda p: contains(a, {normalized_sql('p')}))) / len(must) ELSE 1.0 END AS ratio FROM n)
    SELECT conv_id, turn, nm::INT AS numeric_match, sm::INT AS strict_numeric_match, eq::INT AS exact_match, round(ratio, 4)::DOUBLE AS must_include_ratio,
        CASE WHEN expected = 'refuse' THEN CASE WHEN {any_phrase('a', evaluation.REFUSALS)} THEN 'refuse_correct' ELSE 'refuse_wrong' END WHEN eq OR eqn THEN 'exact' WHEN ratio >= 0.5 THEN 'partial' ELSE 'wrong' END AS answer_label FROM h"""


def verify_sql(source: str) -> str:
    """SQL of the heuristic verification of ``source`` (conv_id, turn, query, answer, evidence, cited)."""
    nums = lambda c: f"regexp_extract_all({c}, {quote(evaluation.NUMBER)})"
    bare = lambda c: f"list_transform({nums(c)}, lambda x: regexp_replace(x, '[$€£¥%,]', '', 'g'))"
    words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"
    return f"""v0 AS (SELECT conv_id, turn, coalesce(query, '') AS q, coalesce(answer, '') AS a, coalesce(evidence, '') AS e, coalesce(cited, false) AS cited FROM {source}),
        v1 AS (SELECT *, {bare('a')} AS an, {bare('e')} AS en, {words('q')} AS qw, {words('e')} AS ew, regexp_matches(a, {quote(evaluation.NUMBER)}) AS has FROM v0),
        v2 AS (SELECT *, CASE WHEN len(an) = 0 THEN 1.0 ELSE len(list_filter(an, lambda n: n <> '' AND len(list_filter(en, lambda x: contains(x, n) OR contains(n, x))) > 0)) / len(an) END AS overlap,
            len(list_intersect(qw, ew)) / greatest(1, len(qw)) AS coverage, length({STRIP.format('a')}) < 3 AS empty_, {any_phrase('lower(a)', evaluation.VERIFIER_REFUSALS)} AND length(e) > 100 AS refused FROM v1),
        v3 AS (SELECT *, empty_ OR refused AS stop_, has AND overlap < 0.8 AS off, NOT (empty_ OR refused) AND (overlap * 0.4::DOUBLE + coverage * 0.4::DOUBLE + CASE WHEN cited THEN 0.2 ELSE 0.0 END::DOUBLE >= 0.5) AND (overlap >= 0.5 OR NOT has) AS ok FROM v2),
        v4 AS (SELECT *, list_filter([CASE WHEN NOT cited THEN 'citation_missing' END, CASE WHEN off THEN 'numeric_inconsistency' END, CASE WHEN coverage < 0.4 THEN 'insufficient_evidence' END,
            CASE WHEN coverage >= 0.4 AND coverage < 0.7 AND (NOT cited OR off) THEN 'evidence_too_generic' END], lambda x: x IS NOT NULL) AS why FROM v3),
        verified AS (SELECT conv_id, turn, ok AS is_supported, CASE WHEN ok AND overlap >= 0.8 AND coverage >= 0.7 THEN 'high' WHEN ok AND overlap >= 0.5 THEN 'medium' ELSE 'low' END AS support_level,
            CASE WHEN NOT stop_ AND has THEN overlap >= 0.8 END AS numeric_consistency, NOT stop_ AND cited AS citation_adequate,
            CASE WHEN empty_ THEN ['answer_empty'] WHEN refused THEN ['refusal_despite_evidence'] WHEN len(why) = 0 AND NOT ok THEN ['insufficient_evidence'] ELSE why END AS reasons FROM v4)"""


JUDGED = f"""{TURNS}, judged AS (SELECT s.conv_id, s.turn, s.query, s.answer, d.text AS evidence, s.turn % 2 = 1 AS cited FROM said s LEFT JOIN documents d ON d.doc_id = s.conv_id), {verify_sql('judged')}"""
ORACLES["verify_heuristic"] = f"WITH {JUDGED} SELECT conv_id, turn, is_supported, support_level, numeric_consistency, citation_adequate, array_to_string(reasons, ',') AS reasons FROM verified"


@query(f"""WITH {TURNS}, m AS (SELECT *, ['answer', 'refuse', 'clarify', 'other'][1 + turn % 4] AS expected, regexp_extract_all(query, '[^\\x20\\x09-\\x0D]+')[1:2] AS must, regexp_extract_all(query, '[^\\x20\\x09-\\x0D]+')[3:3] AS must_not,
        CASE WHEN conv_id % 3 = 0 THEN answer ELSE query END AS gold FROM said),
    n AS (SELECT *, lower({STRIP.format("regexp_replace(answer, '\\s+', ' ', 'g')")}) AS a, lower({STRIP.format("regexp_replace(gold, '\\s+', ' ', 'g')")}) AS g FROM m),
    h AS (SELECT *, CASE WHEN len(must) > 0 THEN len(list_filter(must, lambda p: contains(a, lower(p)))) / len(must) ELSE 1.0 END AS ratio, list_filter(must_not, lambda p: contains(a, lower(p))) AS bad FROM n)
    SELECT conv_id, turn, CASE expected WHEN 'answer' THEN CASE WHEN g <> '' AND {fuzzy_sql('a', 'g')} THEN 'exact' WHEN ratio >= 0.5 AND len(bad) = 0 THEN 'partial' ELSE 'wrong' END
        WHEN 'refuse' THEN CASE WHEN {any_phrase('a', evaluation.REFUSALS)} THEN 'refuse_correct' ELSE 'refuse_wrong' END
        WHEN 'clarify' THEN CASE WHEN {any_phrase('a', evaluation.CLARIFICATIONS)} THEN 'clarify_correct' ELSE 'clarify_wrong' END ELSE 'wrong' END AS answer_label,
        CASE WHEN expected = 'other' THEN 0.0 ELSE round(ratio, 4) END::DOUBLE AS must_include_hit_ratio, CASE WHEN expected = 'other' THEN 0 ELSE len(bad) END::INTEGER AS n_violations FROM h""")
def answer_scorer(spark, sf_dir):
    """Assistant turns scored in all three modes and an unknown one."""
    words = X.words(F.col("query"))
    made = answers(spark, sf_dir).withColumns({
        "expected": F.element_at(F.lit(["answer", "refuse", "clarify", "other"]), (F.col("turn") % 4 + 1).cast("int")), "must_include": F.slice(words, 1, 2), "must_not_include": F.slice(words, 3, 1),
        "gold_answer": F.when(F.col("conv_id") % 3 == 0, F.col("answer")).otherwise(F.col("query")),
    })
    return evaluation.answer_scores(made).select("conv_id", "turn", "answer_label", "must_include_hit_ratio", F.size("violations").alias("n_violations"))


# --- runs

LABELS = ", ".join(map(quote, evaluation.LABELS))
RECORDS = f"""records AS (SELECT doc_id AS query_id, doc_id, [{LABELS}][1 + doc_id % 7] AS answer_label, (doc_id % 4 = 0)::INT AS hit_at_1, (doc_id % 4 <= 1)::INT AS hit_at_3, (doc_id % 4 <= 2)::INT AS hit_at_5, (doc_id % 5) / 4 AS recall_at_5,
    CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 4) / 4 END AS mrr, (doc_id % 3 = 0)::INT AS section_hit_at_5, doc_id % 5 = 1 AS skipped, CASE WHEN doc_id % 9 > 0 THEN doc_id % 2 = 0 END AS supported, doc_id % 11 = 0 AS refined,
    CASE WHEN doc_id % 8 > 0 THEN doc_id % 3 > 0 END AS numeric_consistent, doc_id % 4 > 0 AS cited FROM documents WHERE doc_id IS NOT NULL)"""


def records(spark, sf_dir) -> DataFrame:
    """Records of a run, made of document ids."""
    i = F.col("doc_id")
    flag = lambda c: c.cast("int")
    return table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(
        i.alias("query_id"), "doc_id", F.element_at(F.lit(evaluation.LABELS), (i % 7 + 1).cast("int")).alias("answer_label"), flag(i % 4 == 0).alias("hit_at_1"), flag(i % 4 <= 1).alias("hit_at_3"), flag(i % 4 <= 2).alias("hit_at_5"),
        (i % 5 / 4).alias("recall_at_5"), F.when(i % 6 != 0, i % 4 / 4).alias("mrr"), flag(i % 3 == 0).alias("section_hit_at_5"), (i % 5 == 1).alias("skipped"), F.when(i % 9 > 0, i % 2 == 0).alias("supported"), (i % 11 == 0).alias("refined"),
        F.when(i % 8 > 0, i % 3 > 0).alias("numeric_consistent"), (i % 4 > 0).alias("cited"),
    )


@query(f"WITH {RECORDS} SELECT count(*) AS labeled_cases, {', '.join(f'coalesce(round(avg(coalesce({c}, 0)), 4), 0.0)::DOUBLE AS {c}' for c in ('hit_at_1', 'hit_at_3', 'hit_at_5', 'recall_at_5', 'mrr', 'section_hit_at_5'))} FROM records WHERE NOT skipped")
def retrieval_averages(spark, sf_dir):
    return evaluation.retrieval_averages(records(spark, sf_dir))


@query(f"""WITH {RECORDS} SELECT {', '.join(f"count_if(answer_label = '{x}') AS {x}" for x in evaluation.LABELS)}, round(count_if(supported) / count(*), 4) AS answer_supported_rate, round(count_if(refined) / count(*), 4) AS answer_refined_rate,
    round(count_if(numeric_consistent) / count(*), 4) AS numeric_verifier_pass_rate, round(count_if(cited) / count(*), 4) AS citation_adequate_rate FROM records""")
def answer_averages(spark, sf_dir):
    return evaluation.answer_averages(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, c AS (SELECT answer_label, count(*) AS n FROM records GROUP BY 1) SELECT (SELECT count(*) FROM records) AS n, (SELECT printf('%d/%d', sum(hit_at_1)::BIGINT, count(*)) FROM records) AS hit_at_1,
    (SELECT printf('%d/%d', sum(section_hit_at_5)::BIGINT, count(*)) FROM records) AS section_hit_at_5, (SELECT round(avg(mrr), 4) FROM records) AS mrr, string_agg(answer_label || '=' || n, ',' ORDER BY answer_label) AS labels FROM c""")
def full_summary(spark, sf_dir):
    made = evaluation.full_summary(records(spark, sf_dir), ["hit_at_1", "section_hit_at_5"], ["mrr"])
    return made.withColumn("labels", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("""WITH r AS (SELECT doc_id AS id, source AS reason, text AS question FROM documents), c AS (SELECT reason, count(*) AS n FROM r GROUP BY 1)
    SELECT r.reason, id, substr(question, 1, 80) AS question, row_number() OVER (PARTITION BY r.reason ORDER BY id)::INTEGER AS at, n, round(n / (SELECT count(*) FROM r), 6) AS share FROM r JOIN c USING (reason)""")
def failure_breakdown(spark, sf_dir):
    """Sources stand for failure reasons."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("reason"), F.col("text").alias("question"))
    return evaluation.failure_breakdown(rows)


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def timing_summary(spark, sf_dir):
    return evaluation.timing_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


@query("SELECT count(*) AS n, count(DISTINCT coalesce(source, '')) AS companies, count(DISTINCT coalesce(lang, '')) AS documents, count_if(doc_id % 3 = 0) AS with_pages, count_if(doc_id % 4 > 0) AS with_evidence FROM documents")
def dataset_counts(spark, sf_dir):
    i = F.col("doc_id")
    some = lambda c: F.when(c, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return evaluation.dataset_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("company"), F.col("lang").alias("doc_name"), some(i % 3 == 0).alias("pages"), some(i % 4 > 0).alias("evidence")))


RANKED = ", ".join(map(quote, evaluation.RANKED_LABELS))


@query(f"""WITH {RECORDS}, n AS (SELECT query_id, [{LABELS}][1 + doc_id * 3 % 7] AS l, (doc_id % 3) / 4 AS m FROM records WHERE doc_id % 10 > 0), j AS (SELECT r.query_id, answer_label AS b, l, mrr AS bm, m, list_position([{RANKED}], answer_label) AS pb, list_position([{RANKED}], l) AS pn FROM records r JOIN n USING (query_id))
    SELECT query_id, CASE WHEN b <> l THEN b || ' -> ' || l END AS label_change, CASE WHEN b <> l THEN CASE WHEN pn < pb THEN 'degraded' ELSE 'improved' END END AS direction, round(m - bm, 4) AS mrr_delta, m < bm - 0.01 AS mrr_degraded FROM j""")
def run_diff(spark, sf_dir):
    base = records(spark, sf_dir)
    new = base.filter("doc_id % 10 > 0").select("query_id", F.element_at(F.lit(evaluation.LABELS), (F.col("doc_id") * 3 % 7 + 1).cast("int")).alias("answer_label"), (F.col("doc_id") % 3 / 4).alias("mrr"))
    return evaluation.run_diff(base, new)


@query("""WITH s AS (SELECT doc_id AS id, quality AS q FROM labels), r AS (SELECT doc_id AS id, 9 AS q, CASE WHEN doc_id % 4 = 0 THEN 'labeled_doc' WHEN doc_id % 4 = 1 THEN 'unanswerable' END AS st, doc_id % 3 AS k FROM documents)
    SELECT r.id, CASE WHEN s.id IS NOT NULL THEN s.q ELSE r.q END AS quality, coalesce(st, 'unlabeled') IN ('labeled_doc', 'labeled_chunk') AS retrieval_scored,
    CASE WHEN coalesce(st, 'unlabeled') IN ('labeled_doc', 'labeled_chunk') THEN '' WHEN k = 0 THEN 'no_gold_doc_ids' ELSE 'unlabeled_or_unanswerable' END AS skip_reason FROM r LEFT JOIN s USING (id)""")
def score_run_gold(spark, sf_dir):
    """Results joined with their samples (labels); a result without one keeps what it holds."""
    i = F.col("doc_id")
    results = table(spark, sf_dir, "documents").select(i.alias("id"), F.lit(9).alias("quality"), F.when(i % 4 == 0, "labeled_doc").when(i % 4 == 1, "unanswerable").alias("label_status"), F.slice(F.lit([1, 2]), F.lit(1), (i % 3).cast("int")).alias("gold_doc_ids"))
    samples = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return evaluation.label_gate(evaluation.with_gold(results, samples, ["quality"])).select("id", "quality", "retrieval_scored", "skip_reason")


@query(f"""WITH {GOLD}, r AS (SELECT query_id, rank, 1.0 / rank AS score FROM got), c AS (SELECT query_id, greatest(max(score), 0) AS top, avg(CASE WHEN rank <= 3 THEN score END) AS three FROM r GROUP BY 1)
    SELECT query_id, round(greatest(0.0, least(1.0, (0.55::DOUBLE * top + 0.45::DOUBLE * three) * CASE WHEN query_id % 2 = 0 THEN 0.65 ELSE 1.0 END::DOUBLE)), 4)::DOUBLE AS confidence FROM c""")
def confidence(spark, sf_dir):
    """Of what full text finds, scored by its reciprocal rank; answers to even questions refuse."""
    return evaluation.confidence(retrieved(spark, sf_dir).withColumn("score", 1.0 / F.col("rank").cast("double")), F.col("query_id") % 2 == 0)
