"""The way from retrieved chunks to answers, each step with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import answers as A
from vellum.operators import evaluation
from vellum.plans.catalog import CHUNKS, GOLD, STRIP, answers, index, query, questions, quote, retrieved, table, tidy_sql
from vellum.plans.evaluations import JUDGED, any_phrase

RANKED = f"{GOLD}, rk AS (SELECT g.query_id, g.rank, c.chunk_id, c.doc_id, c.title, c.section, c.page_start, CASE WHEN g.rank % 2 = 0 THEN c.page_start + 1 END AS page_end, c.chunk_text, 1.0 / g.rank AS score FROM got g JOIN chunks c USING (chunk_id))"
PAGE = "CASE WHEN page_end IS NULL OR page_end = page_start THEN page_start::VARCHAR ELSE page_start || '-' || page_end END"
CONTEXT = f"""ctx AS (SELECT query_id, string_agg('[Source ' || rank || ']' || chr(10) || 'Document: ' || coalesce(nullif(title, ''), '-') || chr(10) || 'Section: ' || coalesce(nullif(section, ''), '-') || chr(10) || 'Page: ' || {PAGE} || chr(10) || 'Content:' || chr(10) || {tidy_sql('chunk_text')},
    chr(10) || chr(10) ORDER BY rank) AS context FROM rk WHERE rank <= 5 GROUP BY 1)"""


def ranked(spark, sf_dir, asked: DataFrame | None = None) -> DataFrame:
    """What full text finds, with chunks, page ends for even ranks, and reciprocal ranks as scores."""
    found = retrieved(spark, sf_dir).select("query_id", "chunk_id", "rank").join(index(spark, sf_dir).chunks.drop("dl"), "chunk_id")
    return found.withColumns({"page_end": F.when(F.col("rank") % 2 == 0, F.col("page_start") + 1), "score": 1.0 / F.col("rank").cast("double")})


@query(f"WITH {RANKED}, {CONTEXT} SELECT query_id, md5(context) AS digest, length(context)::INTEGER AS n FROM ctx")
def answer_context(spark, sf_dir):
    return A.context(ranked(spark, sf_dir)).select("query_id", F.md5("context").alias("digest"), F.length("context").alias("n"))


@query(f"WITH {RANKED} SELECT query_id, rank, chunk_id, doc_id, title, section, {PAGE} AS page, CASE WHEN length({tidy_sql('chunk_text')}) <= 260 THEN {tidy_sql('chunk_text')} ELSE substr({tidy_sql('chunk_text')}, 1, 257) || '...' END AS quote, score::DOUBLE AS score FROM rk WHERE rank <= 5")
def answer_sources(spark, sf_dir):
    return A.sources(ranked(spark, sf_dir))


CITED = """cs AS (SELECT conv_id, turn, answer || CASE turn % 4 WHEN 0 THEN ' see e2 and Source 3' WHEN 1 THEN ' as in c' || conv_id || 'a' WHEN 2 THEN ' [E1]' ELSE '' END AS answer, ['c' || conv_id || 'a', 'x2', 'x3', 'x3', 'x5', 'e1'] AS ids FROM said),
    cm AS (SELECT *, list_distinct(list_transform(list_filter(range(1, 6), lambda i: contains(lower(answer), lower(ids[i])) OR contains(lower(answer), 'e' || i) OR contains(lower(answer), 'source ' || i)), lambda i: ids[i])) AS got FROM cs),
    co AS (SELECT *, list_filter(['c' || conv_id || 'a', 'x2', 'x3', 'x5'], lambda i: list_contains(got, i)) AS cited FROM cm)"""


@query(f"""WITH {JUDGED.split(', judged AS')[0]}, {CITED} SELECT conv_id, turn, array_to_string(cited, ',') AS cited, md5(CASE WHEN answer = '' OR len(cited) = 0 OR regexp_matches(answer, '\\[E\\d+\\]|\\[Source \\d+\\]|\\[\\d+\\]') THEN answer
    ELSE answer || ' [Evidence: ' || array_to_string(list_transform(cited[1:3], lambda i: '[' || i || ']'), ', ') || ']' END) AS digest FROM co""")
def answer_citations(spark, sf_dir):
    """Answers that name their sources in four ways or not at all."""
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("a"))
    tail = F.when(F.col("turn") % 4 == 0, " see e2 and Source 3").when(F.col("turn") % 4 == 1, F.concat(F.lit(" as in "), own)).when(F.col("turn") % 4 == 2, " [E1]").otherwise("")
    made = answers(spark, sf_dir).withColumn("answer", F.concat("answer", tail)).withColumn("ids", F.array(own, *map(F.lit, ("x2", "x3", "x3", "x5", "e1"))))
    found = made.withColumn("found", A.cited(F.col("answer"), F.col("ids")))
    return found.select("conv_id", "turn", F.array_join("found", ",").alias("cited"), F.md5(A.with_citations(F.col("answer"), F.col("found"))).alias("digest"))


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN '' WHEN 3 THEN '{{"answer": "cut' WHEN 4 THEN {tidy_sql('text')} ELSE 'A  of' || doc_id END AS answer_key, CASE WHEN doc_id % 6 < 2 THEN 'p1|p2' ELSE '' END AS positive, CASE WHEN doc_id % 6 < 2 THEN 'k' ELSE '' END AS points,
    CASE WHEN doc_id % 6 < 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM documents WHERE text NOT LIKE '%{{%' AND text NOT LIKE '%`%'""".replace("'A  of'", "'A of'"))
def answer_structured(spark, sf_dir):
    """Replies of a model: an object, a fenced one, one without lists, a broken one, prose, nothing."""
    i = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"answer": "A  of'), i, F.lit('", "positive_drivers": ["p1", "p2"], "key_points": ["k"], "confidence": 0.5}'))
    bare = F.concat(F.lit('{"answer": "A  of'), i, F.lit('", "confidence": 0.5}'))
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\n"))).when(k == 2, bare).when(k == 3, '{"answer": "cut').when(k == 4, F.col("text")).otherwise("")
    docs = table(spark, sf_dir, "documents").filter("text NOT LIKE '%{%' AND text NOT LIKE '%`%'")
    read = docs.select("doc_id", A.structured(raw).alias("r"))
    return read.select("doc_id", F.col("r.answer").alias("answer_key"), F.array_join("r.positive_drivers", "|").alias("positive"), F.array_join("r.key_points", "|").alias("points"), "r.confidence")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN 2 END::INTEGER AS n, CASE WHEN doc_id % 5 < 3 THEN 'a' || doc_id END AS first, CASE WHEN doc_id % 5 < 3 THEN CASE WHEN doc_id % 7 > 5 THEN 1.0 ELSE (doc_id % 7) / 5::DOUBLE END END::DOUBLE AS relevance,
    CASE WHEN doc_id % 5 < 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'directly_answerable' ELSE 'topically_related' END END AS answerability, CASE WHEN doc_id % 5 < 3 THEN 'noise' END AS second FROM documents""")
def rerank_reply(spark, sf_dir):
    """Replies of a reranking model: an object, a fenced one, one within prose, one without scores, a broken one."""
    i = F.col("doc_id")
    label = F.when(i % 2 == 0, "Directly-Answerable").otherwise("who knows")
    scores = F.format_string('{"scores": [{"chunk_id": "a%d", "relevance": %s, "answerability": "%s"}, {"chunk_id": "b", "relevance": -3, "answerability": "irrelevant", "rationale": "none"}, {"relevance": 1}]}', i, (i % 7 / 5).cast("string"), label)
    raw = F.when(i % 5 == 0, scores).when(i % 5 == 1, F.concat(F.lit("```json\n"), scores, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("I think "), scores, F.lit(" is right"))).when(i % 5 == 3, '{"scores": []}').otherwise('{"scores": [')
    read = table(spark, sf_dir, "documents").select("doc_id", A.relevance(raw).alias("r"))
    return read.select("doc_id", F.when(F.col("r").isNotNull(), F.size("r")).alias("n"), F.col("r")[0]["chunk_id"].alias("first"), F.col("r")[0]["relevance"].alias("relevance"), F.col("r")[0]["answerability"].alias("answerability"), F.col("r")[1]["answerability"].alias("second"))


REFINE = f"""rf AS (SELECT v.*, j.answer, CASE WHEN v.turn % 5 = 0 THEN 0 ELSE 2 END AS n_evidence, CASE WHEN v.conv_id % 7 > 0 THEN 'heuristic' END AS method FROM verified v JOIN judged j USING (conv_id, turn)),
    rw AS (SELECT *, CASE WHEN n_evidence = 0 THEN 'no_evidence_chunks' WHEN length({STRIP.format('answer')}) < 3 THEN 'empty_draft_answer' WHEN method IS NULL THEN 'verifier_method=unknown' WHEN list_has_any(reasons, [{', '.join(map(quote, A.NOT_FIXABLE))}]) THEN 'non_fixable_failure'
        WHEN NOT is_supported THEN 'verifier_unsupported' WHEN NOT coalesce(numeric_consistency, true) THEN 'numeric_inconsistency' WHEN NOT citation_adequate THEN 'citation_missing' ELSE 'no_trigger_condition' END AS refine_reason FROM rf)"""


def judged(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence"))
    return answers(spark, sf_dir).join(docs, "conv_id", "left").withColumn("cited", F.col("turn") % 2 == 1)


@query(f"WITH {JUDGED}, {REFINE} SELECT conv_id, turn, refine_reason, refine_reason IN ('verifier_unsupported', 'numeric_inconsistency', 'citation_missing') AS refine FROM rw")
def refine_gate(spark, sf_dir):
    made = evaluation.verify(judged(spark, sf_dir)).withColumns({"n_evidence": F.when(F.col("turn") % 5 == 0, 0).otherwise(2), "method": F.when(F.col("conv_id") % 7 > 0, "heuristic")})
    return A.refine_reason(made).select("conv_id", "turn", "refine", "refine_reason")


@query(f"WITH {JUDGED} SELECT conv_id, turn, CASE WHEN support_level = 'medium' AND conv_id % 2 = 0 THEN false ELSE is_supported END AS is_supported, CASE WHEN support_level = 'medium' AND conv_id % 2 = 0 THEN 'low' ELSE support_level END AS support_level, CASE WHEN support_level = 'medium' AND conv_id % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS method FROM verified")
def verify_by_model(spark, sf_dir):
    """A stand-in for a model that rejects all it is asked about, and leaves out odd conversations."""
    model = lambda df: df.filter("conv_id % 2 = 0").select("conv_id", "turn", F.lit(False).alias("is_supported"), F.lit("low").alias("support_level"))
    return A.verified(judged(spark, sf_dir), model, ("conv_id", "turn")).select("conv_id", "turn", "is_supported", "support_level", "method")


@query(f"WITH {JUDGED}, {REFINE} SELECT conv_id, turn, refine_reason IN ('verifier_unsupported', 'numeric_inconsistency', 'citation_missing') AND conv_id % 2 = 0 AS refined, md5(CASE WHEN refine_reason IN ('verifier_unsupported', 'numeric_inconsistency', 'citation_missing') AND conv_id % 2 = 0 THEN answer || ' again' ELSE answer END) AS digest FROM rw")
def refine_answers(spark, sf_dir):
    """A stand-in for a model that says its answer again, and says too little for odd conversations."""
    made = evaluation.verify(judged(spark, sf_dir)).withColumns({"n_evidence": F.when(F.col("turn") % 5 == 0, 0).otherwise(2), "method": F.when(F.col("conv_id") % 7 > 0, "heuristic")})
    model = lambda df: df.select("conv_id", "turn", F.when(F.col("conv_id") % 2 == 0, F.concat("answer", F.lit(" again"))).otherwise(" x").alias("answer"))
    return A.refined(made, model, True, ("conv_id", "turn")).select("conv_id", "turn", "refined", F.md5("answer").alias("digest"))


@query(rf"SELECT doc_id AS id, CASE WHEN {tidy_sql('text')} = '' THEN '' ELSE md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(substr({tidy_sql('text')}, 1, 6000), '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: {STRIP.format('p')}), lambda p: p <> '')[1:3], ' ')) END AS digest FROM documents")
def document_summaries(spark, sf_dir):
    """Every document summarised by a stand-in for a model: its first three sentences."""
    made = A.summaries(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return made.select("id", F.when(F.col("summary") == "", "").otherwise(F.md5("summary")).alias("digest"))


FIRST = f"""best AS (SELECT query_id, {tidy_sql('chunk_text')} AS t FROM rk WHERE rank = 1), sent AS (SELECT query_id, coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_extract(t, '^((?s).*)$', 1), '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: {STRIP.format('p')}), lambda p: p <> '')[1], '') AS answer FROM best)"""


@query(f"""WITH {RANKED}, {FIRST}, sure AS (SELECT query_id, 0.55 * max(score) + 0.45 * avg(CASE WHEN rank <= 3 THEN score END) AS c, count(*) AS n_sources FROM rk GROUP BY 1)
    SELECT s.query_id, md5(s.answer) AS said, round(greatest(0, least(1, c * CASE WHEN {any_phrase('lower(s.answer)', evaluation.VERIFIER_REFUSALS)} THEN 0.65 ELSE 1 END)), 4)::DOUBLE AS confidence, n_sources FROM sent s JOIN sure USING (query_id)""")
def answer_questions(spark, sf_dir):
    """Every question answered from what full text finds by its best source's first sentence; citations are cut off here."""
    made = A.answer(questions(spark, sf_dir), lambda asked: ranked(spark, sf_dir, asked))
    return made.select("query_id", F.md5(F.regexp_replace("answer", r" \[Evidence: [^\n]*\]\z", "")).alias("said"), "confidence", "n_sources")


@query("""WITH l AS (SELECT conv_id AS query_id, max_by(text, turn) AS last FROM conversations GROUP BY 1), q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'cash flow' ELSE text END AS query FROM benchmark)
    SELECT query_id, CASE WHEN query_id % 2 = 0 AND last IS NOT NULL THEN query || ' ' || last ELSE query END AS query FROM q LEFT JOIN l USING (query_id)""")
def rewrite_with_history(spark, sf_dir):
    """Short questions take up the last turn of the conversation of their number; with the default nothing changes."""
    asked = questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 2 == 0, "cash flow").otherwise(F.col("query")))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    last = table(spark, sf_dir, "conversations").withColumn("at", at).filter("at = 1").select(F.col("conv_id").alias("query_id"), "text")
    return A.same_query(A.expanded_history(asked, last), last)


@query(f"""WITH {CHUNKS}, t AS (SELECT chunk_id, CASE chunk_index % 3 WHEN 0 THEN 'Revenue' || chr(10) || '$1,200' || chr(10) || '900' || chr(10) || '3.5' || chr(10) || '7' || chr(10) || 'col_0=' || chunk_text WHEN 1 THEN 'col_0=' || chunk_text ELSE chunk_text END AS t FROM chunks)
    SELECT chunk_id, md5(CASE WHEN chunk_id & 16777215 >= 0 AND (chunk_id & 16777215) % 3 = 0 THEN {quote(X.TWO_YEARS)} ELSE '' END || regexp_replace({tidy_sql('t')}, '(?m)^col_0=', '', 'g')) AS digest FROM t""")
def table_text_clean(spark, sf_dir):
    """Chunks as tables: with four numeric lines, with a named column only, as they are."""
    k, t = F.col("chunk_index") % 3, F.col("chunk_text")
    made = F.when(k == 0, F.concat(F.lit("Revenue\n$1,200\n900\n3.5\n7\ncol_0="), t)).when(k == 1, F.concat(F.lit("col_0="), t)).otherwise(t)
    return index(spark, sf_dir).chunks.select("chunk_id", F.md5(X.clean_table(made)).alias("digest"))
