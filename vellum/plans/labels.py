"""Gold labels and training messages, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import evaluation, gold
from vellum.plans.catalog import BM25, CHUNKS, hits_sql, index, query, questions, quote, table
from vellum.plans.evaluations import set_sql
from vellum.plans.stores import written
from vellum.sources import records

QA = """qa AS (SELECT item_id AS i, 'fb' || item_id AS id, 'd' || item_id % 7 AS doc_name, text AS question, CASE WHEN item_id % 4 = 0 THEN 'We cannot confirm it' WHEN item_id % 4 = 1 THEN '$5.20 and 12.5%' ELSE text || text || text END AS answer FROM benchmark)"""


def qa(spark, sf_dir) -> DataFrame:
    """The questions with documents, answers of three kinds and two pieces of evidence, written as JSON lines and read back."""
    i, text = F.col("item_id"), F.col("text")
    piece = lambda page, t: F.struct(F.concat(F.lit("d"), (i % 7).cast("string")).alias("doc_name"), page.cast("int").alias("evidence_page_num"), t.alias("evidence_text"))
    made = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("fb"), i.cast("string")).alias("financebench_id"), F.concat(F.lit("d"), (i % 7).cast("string")).alias("doc_name"), text.alias("question"),
        F.when(i % 4 == 0, "We cannot confirm it").when(i % 4 == 1, "$5.20 and 12.5%").otherwise(F.concat(text, text, text)).alias("answer"), F.lit("own").alias("company"),
        F.array(piece(i % 5, text), piece(F.when(i % 2 == 0, i % 3), F.when(i % 3 == 0, "").otherwise("second")), piece(i % 5, F.lit("third"))).alias("evidence"),
    )
    return records.load_questions(spark, written(made, "qa"))


def info(spark) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_name"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("company"), F.lit("10k").alias("doc_type"), F.lit("2022").alias("doc_period"))


@query(f"""WITH {QA} SELECT id, CASE WHEN i % 7 < 5 THEN 'c' || i % 7 ELSE 'own' END AS company, CASE WHEN i % 7 < 5 THEN '10k' ELSE '' END AS doc_type, CASE WHEN {hits_sql('lower(trim(answer))', evaluation.REFUSALS)} > 0 THEN 'refuse' ELSE 'answer' END AS expected,
    CASE WHEN NOT (length(answer) < 50 AND regexp_matches(answer, '[0-9]')) AND (length(question) > 150 OR length(answer) > 300) THEN 'medium' ELSE 'easy' END AS difficulty,
    array_to_string(list_sort(list_distinct(list_filter([i % 5, CASE WHEN i % 2 = 0 THEN i % 3 ELSE 0 END], lambda p: p > 0))), ',') AS pages, CASE WHEN i % 3 = 0 THEN 2 ELSE 3 END::INTEGER AS n_texts, CASE WHEN i % 4 = 1 THEN '$5.20|12.5%' WHEN i % 4 = 0 THEN '' END AS must FROM qa""")
def build_samples(spark, sf_dir):
    made = gold.samples(qa(spark, sf_dir), info(spark))
    must = F.when(F.col("id").rlike("^fb") & (F.substring("id", 3, 20).cast("long") % 4).isin(0, 1), F.array_join("must_include", "|"))
    return made.select("id", "company", F.col("gold_doc_type").alias("doc_type"), F.col("expected_behavior").alias("expected"), "difficulty", F.array_join(F.col("gold_pages").cast("array<string>"), ",").alias("pages"), F.size("gold_evidence_texts").alias("n_texts"), must.alias("must"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\\s+|\\s+\\z', '', 'g') AS s FROM documents), e AS (SELECT doc_id, list_filter([s, 'second', s, 'x', s], lambda x: x <> '') AS l FROM t),
    c AS (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 50))) AS ends FROM e)
    SELECT doc_id, CASE WHEN len(l) > 0 AND ends[1] > 3000 THEN 1 ELSE len(list_filter(ends, lambda x: x <= 3000)) END::INTEGER AS n, CASE WHEN len(l) > 0 THEN length(l[1][1:3000]) END::INTEGER AS first FROM c""")
def evidence_fitting(spark, sf_dir):
    """Texts that fit into a prompt: a document, a word, the document again."""
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", gold.fitting(F.array("text", F.lit(" second "), "text", F.lit("x"), "text")).alias("k"))
    return kept.select("doc_id", F.size("k").alias("n"), F.length(F.get("k", F.lit(0))).alias("first"))


@query(f"""WITH q AS (SELECT item_id AS id, text, regexp_replace(text, '^\\s+|\\s+\\z', '', 'g') AS s FROM benchmark WHERE item_id % 3 > 0)
    SELECT id, md5({quote(gold.SYSTEM)} || '|' || 'Question: ' || s || chr(10) || chr(10) || 'Evidence:' || chr(10) || '[Evidence 1]' || chr(10) || s[1:2950] || CASE WHEN length(s) + 50 + 61 <= 3000 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '[Evidence 2]' || chr(10) || 'more of it.' ELSE '' END
        || chr(10) || chr(10) || 'Please answer the question based on the evidence above.' || '|' || 'said ' || id) AS digest FROM q WHERE length(s) < 2000""")
def sft_messages(spark, sf_dir):
    """Chat messages of questions with their text and a second piece as evidence; every third has none."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").filter("length(text) < 2000").select(i.alias("id"), F.col("text").alias("question"), F.concat(F.lit("said "), i.cast("string")).alias("gold_answer"), F.when(i % 3 > 0, F.array("text", F.lit(" more of it.\n"))).alias("evidence"))
    return gold.messages(rows).select("id", F.md5(F.array_join(F.col("messages")["content"], "|")).alias("digest"))


@query("SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'with' ELSE 'without' END AS kind FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0 OR conv_id % 3 = 0")
def sft_supervised(spark, sf_dir):
    """Annotated messages: with context where there are any."""
    i = F.col("conv_id")
    one = lambda c: F.array(F.struct(F.lit("user").alias("role"), F.lit(c).alias("content")))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(i.alias("id"), F.when(i % 2 == 0, one("with")).alias("with_context"), F.when(i % 3 == 0, one("without")).alias("no_context"))
    return gold.supervised(rows).select("id", F.col("messages")[0]["content"].alias("kind"))


@query(f"""WITH {BM25}, h AS (SELECT query_id, chunk_id FROM ranked WHERE rank <= 20), c AS (SELECT h.query_id, h.chunk_id, {set_sql("regexp_replace(lower(b.text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")} AS e, {set_sql("regexp_replace(lower(k.chunk_text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')")} AS t FROM h JOIN chunks k USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
    v AS (SELECT query_id, chunk_id, len(list_intersect(e, t)) / len(e) AS cov FROM c WHERE len(e) > 0) SELECT query_id, chunk_id, round(cov, 4) AS coverage, row_number() OVER (PARTITION BY query_id ORDER BY round(cov, 4) DESC, chunk_id)::INTEGER AS rank FROM v WHERE cov >= 0.3 QUALIFY rank <= 10""")
def gold_candidates(spark, sf_dir):
    """Chunks that hold most of a question's text, as candidates for its gold label."""
    return gold.chunks_for_evidence(index(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH {CHUNKS}, g AS (SELECT item_id AS id, CASE WHEN item_id % 4 = 0 THEN [] WHEN item_id % 4 = 1 THEN [-5] ELSE [item_id * 16777216 + 1, item_id * 16777216, -5] END AS l FROM benchmark), u AS (SELECT id, x, i FROM g, unnest(l) WITH ORDINALITY AS u(x, i))
    SELECT g.id, (SELECT coalesce(string_agg(md5(c.chunk_text), ',' ORDER BY u.i), '') FROM u JOIN chunks c ON c.chunk_id = u.x WHERE u.id = g.id) AS texts FROM g WHERE len(l) > 0""")
def gold_chunk_texts(spark, sf_dir):
    i = F.col("item_id")
    none = F.array().cast("array<bigint>")
    rows = table(spark, sf_dir, "benchmark").select(i.alias("id"), F.when(i % 4 == 0, none).when(i % 4 == 1, F.array(F.lit(-5).cast("long"))).otherwise(F.array(i * (1 << 24) + 1, i * (1 << 24), F.lit(-5).cast("long"))).alias("gold_chunk_ids"))
    return gold.gold_texts(rows, index(spark, sf_dir).chunks).select("id", F.array_join(F.transform("texts", F.md5), ",").alias("texts"))


@query("""SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'labeled_doc' WHEN item_id % 3 = 1 THEN 'labeled_chunk' ELSE 'unlabeled' END AS label_status, CASE item_id % 3 WHEN 0 THEN '7' WHEN 1 THEN '' ELSE '1' END AS docs, CASE item_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '' ELSE '2' END AS chunks FROM benchmark""")
def gold_apply(spark, sf_dir):
    """Labels set: a third of the questions get a document, a third are cleared."""
    i = F.col("item_id")
    one = lambda n: F.array(F.lit(n).cast("long"))
    held = table(spark, sf_dir, "benchmark").select(i.alias("id"), F.lit("unlabeled").alias("label_status"), one(2).alias("gold_chunk_ids"), one(1).alias("gold_doc_ids"))
    changes = table(spark, sf_dir, "benchmark").filter("item_id % 3 < 2").select(i.alias("id"), F.when(i % 3 == 0, "labeled_doc").otherwise("labeled_chunk").alias("label_status"), F.lit(None).cast("array<bigint>").alias("gold_chunk_ids"), F.when(i % 3 == 0, one(7)).alias("gold_doc_ids"), (i % 3 == 1).alias("clear"))
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return gold.set_gold(held, changes).select("id", "label_status", flat("gold_doc_ids").alias("docs"), flat("gold_chunk_ids").alias("chunks"))


NAMES = [("ACME", "t1"), ("BETA", "t2"), ("ACM", "t3")]


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN (SELECT max(doc_id) FROM documents WHERE doc_id % 4 = 1) ELSE (SELECT max(doc_id) FROM documents WHERE doc_id % 4 = 2) END AS doc_id FROM benchmark WHERE item_id % 3 < 2")
def company_documents(spark, sf_dir):
    """Questions that name a company, or two, and its latest document."""
    i = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.when(i % 3 == 0, "acme and beta").when(i % 3 == 1, "Beta").otherwise("gamma").alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("title"))
    return gold.company_documents(asked, NAMES, docs)
