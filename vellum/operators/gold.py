"""Gold labels and training messages: samples from questions with evidence, gold chunks for evidence, labels set by hand, chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import evaluation, search
from vellum.operators.index import Index

SYSTEM = (  # a fixed value
    "You are a professional financial analyst assistant. Answer the question based ONLY on the evidence provided below. "
    "Cite specific numbers and facts from the evidence when available. Do not make up information not present in the evidence."
)
MARGIN, MOST_CHARS, MOST_TEXTS = 50, 3000, 5


def is_refusal(answer: Column) -> Column:
    return F.exists(F.lit(evaluation.REFUSALS), lambda r: F.contains(F.lower(X.strip(X.blank(answer))), r))


def evidence_of(questions: DataFrame) -> Column:
    """The evidence of questions (doc_name, evidence) as an array of (doc_name, page_num, text, full_page); pages that are missing are 0."""
    return F.transform(F.coalesce("evidence", F.array()), lambda e: F.struct(
        F.coalesce(e["doc_name"], F.col("doc_name")).alias("doc_name"), F.coalesce(e["evidence_page_num"], F.lit(0)).alias("page_num"), X.blank(e["evidence_text"]).alias("text"), X.blank(e["evidence_text_full_page"]).alias("full_page"),
    ))


def samples(questions: DataFrame, doc_info: DataFrame) -> DataFrame:
    """Samples of questions (financebench_id, company, doc_name, question, answer, question_type, evidence) with what is known of their documents."""
    info = doc_info.select("doc_name", F.col("company").alias("_company"), "doc_type", "doc_period")
    met = questions.join(info, "doc_name", "left").withColumn("gold_evidence", evidence_of(questions))
    pages = F.array_sort(F.array_distinct(F.filter(F.col("gold_evidence")["page_num"], lambda p: p > 0)))
    return met.select(
        F.col("financebench_id").alias("id"), "question", F.coalesce("_company", "company", F.lit("")).alias("company"), F.col("doc_name").alias("gold_doc_name"), X.blank(F.col("doc_type")).alias("gold_doc_type"),
        X.blank(F.col("doc_period")).alias("gold_doc_period"), F.col("answer").alias("gold_answer"), "gold_evidence", pages.alias("gold_pages"), F.filter(F.col("gold_evidence")["text"], lambda t: t != "").alias("gold_evidence_texts"),
        X.must_include(F.col("answer")).alias("must_include"), F.when(is_refusal(F.col("answer")), "refuse").otherwise("answer").alias("expected_behavior"), F.lit("factoid").alias("task_type"),
        X.difficulty(F.col("question"), F.col("answer")).alias("difficulty"),
    )


def fitting(texts: Column, most: int = MOST_CHARS, count: int = MOST_TEXTS) -> Column:
    """The first texts that fit into ``most`` characters, with a margin each; a first one that does not fit is cut."""
    own = F.filter(F.transform(F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, count), X.strip), lambda t: t != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        over = acc["full"] | (acc["n"] + F.length(t) + MARGIN > most)
        cut = F.when(F.size(acc["kept"]) == 0, F.array(F.substring(t, 1, most))).otherwise(acc["kept"])
        return F.struct(F.when(over, acc["n"]).otherwise(acc["n"] + F.length(t) + MARGIN).alias("n"), over.alias("full"), F.when(acc["full"], acc["kept"]).when(over, cut).otherwise(F.array_append(acc["kept"], t)).alias("kept"))

    return F.aggregate(own, start, step, lambda acc: acc["kept"])


def messages(df: DataFrame, system: str = SYSTEM, most: int = MOST_CHARS) -> DataFrame:
    """id, messages (role, content) from samples (id, question, gold_answer, evidence: array of texts); samples without evidence are left out."""
    # fixed values: the forms of the evidence and of the prompt
    texts = fitting(F.col("evidence"), most)
    blocks = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[Evidence "), (i + 1).cast("string"), F.lit("]\n"), X.strip(t))), "\n\n---\n\n")
    asked = F.concat(F.lit("Question: "), X.strip(X.blank(F.col("question"))), F.lit("\n\nEvidence:\n"), blocks, F.lit("\n\nPlease answer the question based on the evidence above."))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = F.array(turn("system", F.lit(system)), turn("user", asked), turn("assistant", X.strip(X.blank(F.col("gold_answer")))))
    return df.filter(F.coalesce(F.size("evidence"), F.lit(0)) > 0).select("id", turns.alias("messages"))


def supervised(df: DataFrame, with_context: bool = True) -> DataFrame:
    """id, messages of samples (id, with_context, no_context: arrays of messages): those with context where there are any, else the others."""
    filled = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c))
    picked = F.coalesce(filled("with_context"), filled("no_context")) if with_context else filled("no_context")
    return df.select("id", picked.alias("messages")).filter("messages IS NOT NULL")


def chunks_for_evidence(index: Index, evidence: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """query_id, chunk_id, coverage, rank: of the 2 k best full-text hits of each evidence text (query_id, query) the k that hold most of its words."""
    hits = search.fulltext(index, evidence.filter("trim(query) <> ''"), 2 * k).select("query_id", "chunk_id")
    met = index.chunks.select("chunk_id", "chunk_text").join(hits, "chunk_id").join(evidence, "query_id")
    covered = met.select("query_id", "chunk_id", F.round(X.coverage(F.col("query"), F.col("chunk_text")), 4).alias("coverage"), X.coverage(F.col("query"), F.col("chunk_text")).alias("_c")).filter(F.col("_c") >= least)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("coverage"), "chunk_id"))
    return covered.withColumn("rank", at).filter(F.col("rank") <= k).drop("_c")


def gold_texts(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, texts: the texts of a sample's gold_chunk_ids, in their order, without missing and blank ones; samples without gold chunks are left out."""
    listed = df.select("id", F.posexplode("gold_chunk_ids").alias("pos", "chunk_id")).join(chunks.select("chunk_id", "chunk_text"), "chunk_id")
    told = listed.filter("chunk_text <> ''").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_text"))).alias("l"))
    named = df.filter(F.coalesce(F.size("gold_chunk_ids"), F.lit(0)) > 0).select("id")
    return named.join(told, "id", "left").select("id", F.coalesce(F.col("l")["chunk_text"], F.array().cast("array<string>")).alias("texts"))


def set_gold(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Samples (id, label_status, gold_chunk_ids, gold_doc_ids) after changes (id, label_status, gold_chunk_ids, gold_doc_ids, clear): what a change
    names replaces what was there, ``clear`` empties both lists. A labelled sample that would have no gold ends the job unless it is cleared."""
    new = changes.select("id", *(F.col(c).alias(f"_{c}") for c in ("label_status", "gold_chunk_ids", "gold_doc_ids", "clear")))
    met = df.join(new, "id", "left")
    none = F.array().cast("array<bigint>")
    clear = F.coalesce("_clear", F.lit(False))
    status = F.coalesce("_label_status", "label_status", F.lit("unlabeled"))
    pick = lambda c: F.when(clear, none).otherwise(F.coalesce(F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")), F.col(c), none))
    changed = F.col("_clear").isNotNull()
    met = met.withColumns({"gold_chunk_ids": pick("gold_chunk_ids"), "gold_doc_ids": pick("gold_doc_ids"), "label_status": status})
    wrong = changed & status.isin("labeled_chunk", "labeled_doc") & (F.size("gold_chunk_ids") <= 0) & (F.size("gold_doc_ids") <= 0) & ~clear
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("labelled without gold: "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("label_status"))
    return met.withColumn("label_status", checked).select(*df.columns)


def company_documents(questions: DataFrame, names: list[tuple[str, str]], docs: DataFrame) -> DataFrame:
    """query_id, doc_id: the document (the latest of its title) of the first company in ``names`` (keyword, title) that a question names."""
    title = F.coalesce(*(F.when(F.contains(F.upper("query"), F.lit(keyword)), F.lit(t)) for keyword, t in names))
    latest = docs.groupBy("title").agg(F.max("doc_id").alias("doc_id"))
    return questions.select("query_id", title.alias("title")).join(latest, "title").select("query_id", "doc_id")
