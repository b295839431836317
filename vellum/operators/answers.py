"""From retrieved chunks to an answer: context, sources, citations, structured replies, gates before a model is asked again.

Models are functions over DataFrames. What they reply is parsed here; a reply that can't be parsed counts as none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import spans
from vellum.functions import text as X
from vellum.operators import evaluation

CONTEXT_CHUNKS, SOURCES, QUOTE = 5, 5, 260
Model = Callable[[DataFrame], DataFrame]

# fixed values: reasons that no second try mends, labels of a reranking model
NOT_FIXABLE = ["verifier_llm_failure", "verifier_parse_fallback", "answer_empty", "refusal_despite_evidence", "no_gold_label"]
ANSWERABILITY = {"directly_answerable": ["directly_answerable", "directly-answerable"], "partially_useful": ["partially_useful", "partially-useful"], "topically_related": ["topically_related", "topically-related"], "noise": ["noise", "irrelevant"]}


def context(ranked: DataFrame, most: int = CONTEXT_CHUNKS) -> DataFrame:
    """query_id, context: the first ``most`` chunks (query_id, rank, title, section, page_start, page_end, chunk_text) of a query as numbered sources."""
    or_dash = lambda c: F.coalesce(F.when(c != "", c), F.lit("-"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]")), F.concat(F.lit("Document: "), or_dash(F.col("title"))), F.concat(F.lit("Section: "), or_dash(F.col("section"))),
        F.concat(F.lit("Page: "), X.page_label(F.col("page_start"), F.col("page_end"))), F.lit("Content:"), X.clean_table(F.col("chunk_text")),
    )
    listed = ranked.filter(F.col("rank") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("l"))
    return listed.select("query_id", F.array_join(F.col("l")["block"], "\n\n").alias("context"))


def sources(ranked: DataFrame, most: int = SOURCES) -> DataFrame:
    """query_id, rank, chunk_id, doc_id, title, section, page, quote, score of the first ``most`` chunks of a query."""
    return ranked.filter(F.col("rank") <= most).select("query_id", "rank", "chunk_id", "doc_id", X.blank(F.col("title")).alias("title"), X.blank(F.col("section")).alias("section"), X.page_label(F.col("page_start"), F.col("page_end")).alias("page"), X.truncate(F.col("chunk_text"), QUOTE).alias("quote"), "score")


def highlights(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """chunk_id, start, end, text: where a question's terms stand in its sources' whole texts, normalised."""
    none = F.array().cast("array<string>")
    met = ranked.join(questions.select("query_id", X.query_terms(F.col("query"), F.lit(""), none).alias("terms")), "query_id")
    return spans.highlight(met.withColumn("quote", X.normalize_whitespace(F.col("chunk_text"))), "chunk_id", "quote", "terms")


def cited(answer: Column, chunk_ids: Column) -> Column:
    """Those of the first five chunk ids (strings) that an answer names, by id, as e1 or as source 1."""
    low = F.lower(X.blank(answer))
    first = F.transform(F.slice(chunk_ids, 1, 5), lambda c, i: F.struct(c.alias("id"), (i + 1).cast("string").alias("n")))
    named = F.filter(first, lambda x: F.contains(low, F.lower(x["id"])) | F.contains(low, F.concat(F.lit("e"), x["n"])) | F.contains(low, F.concat(F.lit("source "), x["n"])))
    return F.array_distinct(F.transform(named, lambda x: x["id"]))


def with_citations(answer: Column, ids: Column) -> Column:
    """The answer with its first three ids behind it, unless it has marks of its own or there are none."""
    marks = F.array_join(F.transform(F.slice(ids, 1, 3), lambda i: F.concat(F.lit("["), i, F.lit("]"))), ", ")
    plain = (X.blank(answer) == "") | (F.size(ids) == 0) | answer.rlike(r"\[E\d+\]|\[Source \d+\]|\[\d+\]")
    return F.when(plain, answer).otherwise(F.concat(answer, F.lit(" [Evidence: "), marks, F.lit("]")))


def _object(raw: Column) -> Column:
    """The text of a JSON object in a reply: the reply itself, or what is fenced in it."""
    text = X.strip(X.blank(raw))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(text)


def structured(raw: Column) -> Column:
    """Struct of answer, positive_drivers, negative_drivers, key_points and confidence; a reply that is no such object is the answer itself."""
    names = ["positive_drivers", "negative_drivers", "key_points"]
    text = _object(raw)
    read = F.from_json(text, "answer string, positive_drivers array<string>, negative_drivers array<string>, key_points array<string>, confidence double, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = F.startswith(text, F.lit("{")) & read["_bad"].isNull()
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.when(good, read[n]), none).alias(n) for n in names]
    answer = F.when(good, X.normalize_whitespace(read["answer"])).otherwise(X.normalize_whitespace(text))
    return F.struct(answer.alias("answer"), *lists, F.coalesce(F.when(good, read["confidence"]), F.lit(0.0)).alias("confidence"))


def relevance(raw: Column) -> Column:
    """Array of (chunk_id, relevance, answerability, rationale) of a reranking model's reply, null if there are no scores to be read."""
    one = "scores array<struct<chunk_id:string,relevance:string,answerability:string,rationale:string>>"
    text = _object(raw)
    inner = F.regexp_extract(X.blank(raw), r"(?s)(\{\s*\"scores\".*\})", 1)
    scores = F.filter(F.coalesce(F.from_json(text, one)["scores"], F.from_json(inner, one)["scores"]), lambda s: s["chunk_id"].isNotNull())

    def label(c: Column) -> Column:
        low, out = F.lower(X.blank(c)), F.lit("topically_related")
        for name, spellings in ANSWERABILITY.items():
            out = F.when(low.isin(*spellings), name).otherwise(out)
        return out

    made = F.transform(scores, lambda s: F.struct(
        s["chunk_id"].alias("chunk_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), X.to_float(s["relevance"]))).alias("relevance"),
        label(s["answerability"]).alias("answerability"), F.substring(X.blank(s["rationale"]), 1, 50).alias("rationale"),
    ))
    return F.when(F.size(made) > 0, made)


def refine_reason(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds refine and refine_reason to answers (answer, n_evidence, is_supported, numeric_consistency, citation_adequate, method, reasons):
    whether an answer is to be written again, and why or why not."""
    no = lambda reason: F.struct(F.lit(False).alias("refine"), reason.alias("refine_reason"))
    yes = lambda reason: F.struct(F.lit(True).alias("refine"), F.lit(reason).alias("refine_reason"))
    method = F.coalesce("method", F.lit("unknown"))
    decided = (
        F.when(F.lit(not enabled), no(F.lit("disabled"))).when(F.col("n_evidence") == 0, no(F.lit("no_evidence_chunks"))).when(F.length(X.strip(X.blank(F.col("answer")))) < 3, no(F.lit("empty_draft_answer")))
        .when(method.isin("disabled", "unknown"), no(F.concat(F.lit("verifier_method="), method))).when(F.arrays_overlap("reasons", F.lit(NOT_FIXABLE)), no(F.lit("non_fixable_failure")))
        .when(~F.coalesce("is_supported", F.lit(True)), yes("verifier_unsupported")).when(~F.coalesce("numeric_consistency", F.lit(True)), yes("numeric_inconsistency"))
        .when(~F.coalesce("citation_adequate", F.lit(True)), yes("citation_missing")).otherwise(no(F.lit("no_trigger_condition")))
    )
    return df.withColumn("_d", decided).withColumns({"refine": F.col("_d.refine"), "refine_reason": F.col("_d.refine_reason")}).drop("_d")


def verified(df: DataFrame, model: Model | None = None, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Answers with the heuristic verdict; only those of medium support go to ``model``, which gives key columns, is_supported and
    support_level. What it leaves out keeps the heuristic verdict."""
    judged = evaluation.verify(df).withColumn("method", F.lit("heuristic"))
    if model is None:
        return judged
    told = model(judged.filter("support_level = 'medium'")).select(*key, F.col("is_supported").alias("_s"), F.col("support_level").alias("_l"))
    met = judged.join(told, list(key), "left")
    mine = (F.col("support_level") == "medium") & F.col("_l").isNotNull()
    return met.withColumns({"method": F.when(mine, "llm").otherwise(F.col("method")), "is_supported": F.when(mine, F.col("_s")).otherwise(F.col("is_supported")), "support_level": F.when(mine, F.col("_l")).otherwise(F.col("support_level"))}).drop("_s", "_l")


def first_sentence(prompts: DataFrame) -> DataFrame:
    """A stand-in for a model: the first sentence of the best source."""
    body = F.regexp_extract("context", r"(?s)Content:\n(.*?)(?:\n\n\[Source 2\]|\z)", 1)
    return prompts.select("query_id", F.coalesce(F.get(X.key_sentences(body, 1), 0), F.lit("")).alias("answer"))


def same_query(questions: DataFrame, history: DataFrame) -> DataFrame:
    """The default way to rewrite a query with its history: none."""
    return questions


def answer(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: Model = first_sentence, verify: Model | None = None, history: DataFrame | None = None, rewrite=same_query) -> DataFrame:
    """query_id, query, answer, confidence, n_sources and the verdict on every question (query_id, query).

    ``retrieve`` gives a question's ranked chunks (query_id, rank, chunk_id, doc_id, title, section, page_start, page_end, chunk_text, score);
    ``generate`` an answer (query_id, answer) to prompts (query_id, query, context)."""
    asked = rewrite(questions, history) if history is not None else questions
    ranked = retrieve(asked)
    told = asked.join(context(ranked), "query_id", "left").withColumn("context", X.blank(F.col("context")))
    said = told.join(generate(told), "query_id", "left")
    listed = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("l"), F.count("*").alias("n_sources"))
    refused = F.exists(F.lit(evaluation.VERIFIER_REFUSALS), lambda r: F.contains(F.lower(X.blank(F.col("answer"))), r))
    sure = evaluation.confidence(ranked.join(said.select("query_id", "answer"), "query_id"), refused)
    met = said.join(listed, "query_id", "left").join(sure, "query_id", "left")
    ids = F.coalesce(F.col("l")["id"], F.array().cast("array<string>"))
    met = met.withColumns({"_cited": cited(F.col("answer"), ids), "evidence": F.col("context"), "confidence": F.coalesce("confidence", F.lit(0.05)), "n_sources": F.coalesce("n_sources", F.lit(0))})
    judged = verified(met.withColumn("cited", F.size("_cited") > 0), verify)
    return judged.select("query_id", "query", with_citations(F.col("answer"), F.col("_cited")).alias("answer"), "confidence", "n_sources", "is_supported", "support_level", "method")


def refined(df: DataFrame, model: Model, enabled: bool = False, key: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Verified answers after at most one more try, which is off unless ``enabled``: ``model`` gets those that :func:`refine_reason` lets through and
    gives key columns and answer; an answer of less than three characters, or none, leaves the draft. Adds refined, refine and refine_reason."""
    gated = refine_reason(df, enabled)
    told = model(gated.filter("refine")).select(*key, F.col("answer").alias("_new"))
    met = gated.join(told, list(key), "left")
    taken = F.col("refine") & (F.length(X.strip(X.blank(F.col("_new")))) >= 3)
    return met.withColumns({"refined": taken, "answer": F.when(taken, F.col("_new")).otherwise(F.col("answer"))}).drop("_new")


def first_sentences(texts: DataFrame) -> DataFrame:
    """A stand-in for a summarising model: the first three sentences."""
    return texts.select("id", F.array_join(X.key_sentences(F.col("text")), " ").alias("summary"))


def summaries(texts: DataFrame, model: Model = first_sentences, most: int = 6000) -> DataFrame:
    """id, summary of texts (id, text) by a model, which gets ``most`` characters of each; blank texts have none and are not asked about."""
    tidy = X.normalize_whitespace(F.col("text"))
    asked = texts.select("id", F.substring(tidy, 1, most).alias("text")).filter("text <> ''")
    return texts.select("id").join(model(asked), "id", "left").select("id", X.blank(F.col("summary")).alias("summary"))


def expanded_history(questions: DataFrame, history: DataFrame) -> DataFrame:
    """Questions of two terms or less, with the terms of the last turn (query_id, text) of their history."""
    last = history.select("query_id", F.col("text").alias("_last"))
    met = questions.join(last, "query_id", "left")
    short = (F.size(Q.terms(F.col("query"))) <= 2) & F.col("_last").isNotNull()
    return met.withColumn("query", F.when(short, F.concat_ws(" ", "query", "_last")).otherwise(F.col("query"))).drop("_last")
