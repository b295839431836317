"""Retrieval and answer metrics, verification, failure reasons, summaries and diffs over evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X

# fixed values: phrases of refusals
REFUSALS = ["没有足够信息", "无法确认", "当前未看到", "不能确认", "没有证据", "信息不足", "无法从", "知识库中未找到", "暂未找到", "没有找到相关", "not enough information", "cannot confirm", "insufficient information", "no relevant", "知识库里没有", "未提供"]
VERIFIER_REFUSALS = ["insufficient information", "not enough information", "cannot confirm", "no relevant", "insufficient context", "知识库中未找到"]
# fixed values: phrases that ask back, answer labels in the order of reports, and labels from best to worst as run diffs rank them
CLARIFICATIONS = ["你想具体看", "你指的是哪个", "能具体说明", "能否补充", "请提供更多", "请说明", "具体是哪部分", "具体指"]
LABELS = ["exact", "partial", "wrong", "refuse_correct", "refuse_wrong", "clarify_correct", "clarify_wrong"]
RANKED_LABELS = ["exact", "partial", "wrong", "refuse_wrong", "refuse_correct", "clarify_correct", "clarify_wrong"]
NUMBER = r"[\d,]+\.?\d*%?|[$€£¥]?\d+\.?\d*%"


def normalized(c: Column) -> Column:
    """Lower case, single blanks, no zero-width characters."""
    s = F.regexp_replace(F.lower(X.blank(c)), r"[\s\x{a0}\x{3000}]+", " ")
    return F.trim(F.regexp_replace(s, r"[\x{200b}-\x{200f}\x{feff}]", ""))


def number_friendly(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalized(c), "[$€£¥]", ""), r"(\d),(\d{3})", "$1$2")


def fuzzy_equal(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """Equal, or token sets of that Jaccard similarity; empty texts equal nothing."""
    split = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")
    return (a != "") & (b != "") & ((a == b) | (X.jaccard(split(a), split(b)) >= threshold))


def document_metrics(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, doc_hit_at_1, doc_hit_at_5, doc_mrr from (query_id, doc_id, rank) and gold (query_id, doc_id). Documents rank by first appearance."""
    first = retrieved.filter("doc_id IS NOT NULL").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    hits = first.filter("at <= 5").join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("at").alias("at"))
    scored = gold.select("query_id").distinct().join(hits, "query_id", "left")
    return scored.select("query_id", F.coalesce((F.col("at") == 1).cast("int"), F.lit(0)).alias("doc_hit_at_1"), F.col("at").isNotNull().cast("int").alias("doc_hit_at_5"), F.coalesce(F.round(1 / F.col("at"), 4), F.lit(0.0)).alias("doc_mrr"))


def page_metrics(retrieved: DataFrame, gold: DataFrame, window: int = 0) -> DataFrame:
    """page_hit_at_1, page_hit_at_5, page_mrr of (query_id, page_start, page_end, rank) for gold pages (query_id, page) within ``window`` pages."""
    listed = gold.groupBy("query_id").agg(F.collect_set("page").alias("pages"))
    end = F.coalesce("page_end", "page_start")
    hit = F.exists("pages", lambda p: (F.col("page_start") <= p + window) & (end >= p - window))
    best = retrieved.filter("rank <= 5").join(listed, "query_id").groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("at"))
    scored = listed.select("query_id").join(best, "query_id", "left")
    return scored.select("query_id", F.coalesce((F.col("at") == 1).cast("int"), F.lit(0)).alias("page_hit_at_1"), F.col("at").isNotNull().cast("int").alias("page_hit_at_5"), F.coalesce(F.round(1 / F.col("at"), 4), F.lit(0.0)).alias("page_mrr"))


def chunk_metrics(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """hit_at_1, hit_at_3, hit_at_5, recall_at_5 and mrr of (query_id, chunk_id, rank) for gold chunks."""
    gold = gold.select("query_id", "chunk_id").distinct()
    hits = retrieved.filter("rank <= 5").join(gold, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("at"), F.count("*").alias("found"))
    scored = gold.groupBy("query_id").agg(F.count("*").alias("wanted")).join(hits, "query_id", "left")
    within = lambda k: F.coalesce(F.col("at") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return scored.select("query_id", within(1), within(3), within(5), F.round(F.coalesce("found", F.lit(0)) / F.col("wanted"), 4).alias("recall_at_5"), F.coalesce(F.round(1 / F.col("at"), 4), F.lit(0.0)).alias("mrr"))


def lexical_similarity(chunk: Column, gold: Column) -> Column:
    """1 where the gold text occurs; else Jaccard of tokens, or .9 of the character 3-gram overlap for golds over 200 characters."""
    a, b = normalized(chunk), normalized(gold)
    split = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")
    grams = lambda c: F.array_distinct(F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))).otherwise(F.array().cast("array<string>")))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    overlap = F.size(F.array_intersect(grams(bare(a)), grams(bare(b)))) / F.greatest(F.lit(1), F.size(grams(bare(b))))
    tokens = X.jaccard(split(a), split(b))
    return F.when((X.blank(chunk) == "") | (X.blank(gold) == ""), 0.0).when(F.contains(a, b), 1.0).when(F.length(b) > 200, F.greatest(tokens, overlap * 0.9)).otherwise(tokens)


def answer_metrics(df: DataFrame) -> DataFrame:
    """Adds numeric_match, exact_match, answer_label and must_include_ratio to (answer, gold_answer, must_include, expected). A lone comma
    counts as a number, as published scores have it; ``strict_numeric_match`` needs a digit."""
    a, g = normalized(F.col("answer")), normalized(F.col("gold_answer"))
    an, gn = number_friendly(F.col("answer")), number_friendly(F.col("gold_answer"))
    numbers = lambda p: F.regexp_extract_all(X.blank(F.col("gold_answer")), F.lit(p), F.lit(0))
    held = lambda p: F.exists(F.transform(numbers(p), number_friendly), lambda x: F.contains(a, x) | F.contains(an, x)).cast("int")
    wanted = F.size("must_include")
    ratio = F.when(wanted > 0, F.size(F.filter("must_include", lambda p: F.contains(a, normalized(p)))) / wanted).otherwise(1.0)
    refuses = F.exists(F.lit(REFUSALS), lambda r: F.contains(a, r))
    exact = fuzzy_equal(a, g) | fuzzy_equal(an, gn)
    label = F.when(F.col("expected") == "refuse", F.when(refuses, "refuse_correct").otherwise("refuse_wrong")).when(F.col("expected") == "answer", F.when(exact, "exact").when(ratio >= 0.5, "partial").otherwise("wrong")).otherwise("wrong")
    return df.withColumns({"numeric_match": held(r"[\d,]+\.?\d*"), "strict_numeric_match": held(r"\d[\d,]*\.?\d*"), "exact_match": fuzzy_equal(a, g).cast("int"), "answer_label": label, "must_include_ratio": F.round(ratio, 4)})


def numbers_overlap(answer: Column, evidence: Column) -> Column:
    """The share of the answer's numbers that the evidence has, or has as part of a number or the other way; 1 without numbers."""
    found = lambda c: F.regexp_extract_all(X.blank(c), F.lit(NUMBER), F.lit(0))
    bare = lambda c: F.transform(found(c), lambda x: F.regexp_replace(x, "[$€£¥%,]", ""))
    have = F.array_distinct(bare(evidence))
    hits = F.size(F.filter(bare(answer), lambda n: (n != "") & F.exists(have, lambda e: F.contains(e, n) | F.contains(n, e))))
    return F.when(F.size(found(answer)) == 0, 1.0).otherwise(hits / F.size(found(answer)))


def verify(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds is_supported, support_level, numeric_consistency, citation_adequate and reasons to (query, answer, evidence, cited)."""
    answer, evidence = X.blank(F.col("answer")), X.blank(F.col("evidence"))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)))
    asked = words(X.blank(F.col("query")))
    overlap, has = numbers_overlap(answer, evidence), answer.rlike(NUMBER)
    coverage = F.size(F.array_intersect(asked, words(evidence))) / F.greatest(F.lit(1), F.size(asked))
    empty = F.length(X.strip(answer)) < 3
    refused = F.exists(F.lit(VERIFIER_REFUSALS), lambda r: F.contains(F.lower(answer), r)) & (F.length(evidence) > 100)
    stop, cited = empty | refused, F.coalesce(F.col("cited"), F.lit(False))
    supported = ~stop & (overlap * 0.4 + coverage * 0.4 + F.when(cited, 0.2).otherwise(0.0) >= threshold) & ((overlap >= 0.5) | ~has)
    level = F.when(supported & (overlap >= 0.8) & (coverage >= 0.7), "high").when(supported & (overlap >= 0.5), "medium").otherwise("low")
    inconsistent = has & (overlap < 0.8)
    reasons = F.array_compact(F.array(
        F.when(~cited, F.lit("citation_missing")), F.when(inconsistent, F.lit("numeric_inconsistency")), F.when(coverage < 0.4, F.lit("insufficient_evidence")),
        F.when((coverage >= 0.4) & (coverage < 0.7) & (~cited | inconsistent), F.lit("evidence_too_generic")),
    ))
    reasons = F.when(empty, F.array(F.lit("answer_empty"))).when(refused, F.array(F.lit("refusal_despite_evidence"))).when((F.size(reasons) == 0) & ~supported, F.array(F.lit("insufficient_evidence"))).otherwise(reasons)
    return df.withColumns({"is_supported": supported, "support_level": level, "numeric_consistency": F.when(~stop & has, overlap >= 0.8), "citation_adequate": ~stop & cited, "reasons": reasons})


def failure_reason(df: DataFrame) -> DataFrame:
    """Adds reason to records with has_gold, doc_hit, page_hit, section_hit, semantic_hit, lexical_hit, numeric_match, answer_label, violations,
    supported, numeric_consistent, citation_missing, refined and reranked."""
    c = F.col
    unsupported = F.coalesce(~c("supported"), F.lit(False))
    on_page = F.when(~c("semantic_hit"), "semantic_drift").when(unsupported, F.when(F.coalesce(~c("numeric_consistent"), F.lit(False)), "numeric_inconsistency").when(c("citation_missing"), "citation_missing").otherwise("unsupported_answer"))
    on_page = on_page.when((c("answer_label") == "wrong") & (c("violations") | c("numeric_match")), "answer_error").otherwise("unknown")
    in_section = F.when(~c("semantic_hit"), "semantic_drift").when(unsupported, "unsupported_answer").otherwise("chunk_miss")
    somewhere = F.when(c("refined") & ~F.coalesce(c("supported"), F.lit(False)), "refine_failed").otherwise("section_miss")
    reason = (
        F.when(~c("has_gold"), "no_gold_label").when(~c("doc_hit"), "doc_miss").when(c("page_hit"), on_page).when(c("section_hit"), in_section)
        .when(c("numeric_match") | c("semantic_hit") | c("lexical_hit"), somewhere).when(c("reranked"), "rerank_error").otherwise("page_near_miss")
    )
    return df.withColumn("reason", reason)


def confidence(ranked: DataFrame, refused: Column) -> DataFrame:
    """query_id, confidence: .55 of the best score and .45 of the mean of the top three, less for refusals."""
    scored = ranked.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("top"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("three"), F.max(refused).alias("refused"))
    raw = (0.55 * F.col("top") + 0.45 * F.col("three")) * F.when(F.col("refused"), 0.65).otherwise(1.0)
    return scored.select("query_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("confidence"))


def summary(records: DataFrame) -> DataFrame:
    """One row: counts, hits as "x/n (p%)" and mean reciprocal rank."""
    rate = lambda c: F.format_string("%d/%d (%.1f%%)", F.sum(c), F.count("*"), F.try_divide(100 * F.sum(c), F.count("*"))).alias(c)
    return records.agg(F.count("*").alias("n"), rate("doc_hit_at_1"), rate("doc_hit_at_5"), F.round(F.avg("doc_mrr"), 4).alias("doc_mrr"))


def level_metrics(hits: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """query_id, {name}_hit_at_1, {name}_hit_at_5, {name}_mrr for every query of ``asked``, from the (query_id, rank) that hit."""
    best = hits.filter("rank <= 5").groupBy("query_id").agg(F.min("rank").alias("at"))
    scored = asked.select("query_id").distinct().join(best, "query_id", "left")
    return scored.select(
        "query_id", F.coalesce((F.col("at") == 1).cast("int"), F.lit(0)).alias(f"{name}_hit_at_1"), F.col("at").isNotNull().cast("int").alias(f"{name}_hit_at_5"),
        F.coalesce(F.round(1 / F.col("at"), 4), F.lit(0.0)).alias(f"{name}_mrr"),
    )


def section_metrics(retrieved: DataFrame, gold: DataFrame, window: int = 3) -> DataFrame:
    """Page metrics under the names of sections: a section is the pages within ``window`` of a gold page."""
    return page_metrics(retrieved, gold, window).withColumnsRenamed({"page_hit_at_1": "section_hit_at_1", "page_hit_at_5": "section_hit_at_5", "page_mrr": "section_mrr"})


def evidence_metrics(retrieved: DataFrame, gold: DataFrame, lexical: float = 0.42, semantic: float = 0.78) -> DataFrame:
    """Text and semantic evidence metrics of (query_id, rank, chunk_text and, from a model, cosine) for gold (query_id, evidence): a chunk
    holds a gold text, or resembles one by words (``lexical``) or by vectors (``semantic``). Chunks without cosine go by words alone."""
    if "cosine" not in retrieved.columns:
        retrieved = retrieved.withColumn("cosine", F.lit(None).cast("double"))
    told = gold.filter("evidence <> ''")
    pairs = retrieved.filter("rank <= 5").join(told, "query_id")
    text, evidence = F.col("chunk_text"), F.col("evidence")
    alike, filled = lexical_similarity(text, evidence), X.blank(text) != ""
    reached = F.greatest(F.when(alike >= lexical, alike).otherwise(0.0), F.when(filled & (F.col("cosine") >= semantic), F.col("cosine")).otherwise(0.0))
    each = pairs.select("query_id", "rank", (filled & F.contains(normalized(text), normalized(evidence))).alias("held"), reached.alias("score"))
    each = each.groupBy("query_id", "rank").agg(F.max("held").alias("held"), F.max("score").alias("score"))
    best = each.groupBy("query_id").agg(F.round(F.max("score"), 4).alias("best"))
    texts = level_metrics(each.filter("held"), told, "evidence_text")
    likeness = level_metrics(each.filter(F.col("score") >= min(lexical, semantic)), told, "evidence_semantic")
    met = texts.join(likeness, "query_id").join(best, "query_id", "left")
    return met.withColumn("evidence_semantic_best_score", F.coalesce("best", F.lit(0.0))).drop("best").withColumn("evidence_lexical_hit_at_5", F.col("evidence_semantic_hit_at_5"))


def gold_metrics(retrieved: DataFrame, gold_chunks: DataFrame, gold_docs: DataFrame) -> DataFrame:
    """query_id, hit_at_1, hit_at_3, hit_at_5, recall_at_5, mrr: a retrieved row (query_id, rank, chunk_id, doc_id) hits by its chunk_id, or, where it
    has none, by its doc_id. Recall is over the query's gold chunks, or its gold documents if it has no chunks."""
    chunks, docs = gold_chunks.select("query_id", "chunk_id").distinct(), gold_docs.select("query_id", "doc_id").distinct()
    wanted = chunks.groupBy("query_id").agg(F.count("*").alias("c")).join(docs.groupBy("query_id").agg(F.count("*").alias("d")), "query_id", "full")
    top = retrieved.filter("rank <= 5").withColumn("by_doc", F.when(F.col("chunk_id").isNull(), F.col("doc_id")))
    met = top.join(chunks.withColumn("_c", F.lit(True)), ["query_id", "chunk_id"], "left")
    met = met.join(docs.select("query_id", F.col("doc_id").alias("by_doc"), F.lit(True).alias("_d")), ["query_id", "by_doc"], "left")
    hits = met.filter("_c OR _d").groupBy("query_id").agg(F.min("rank").alias("at"), F.count("*").alias("found"))
    scored = wanted.join(hits, "query_id", "left")
    within = lambda k: F.coalesce(F.col("at") <= k, F.lit(False)).alias(f"hit_at_{k}")
    recall = F.round(F.coalesce("found", F.lit(0)) / F.coalesce("c", "d"), 4)
    return scored.select("query_id", within(1), within(3), within(5), recall.alias("recall_at_5"), F.coalesce(F.round(1 / F.col("at"), 4), F.lit(0.0)).alias("mrr"))


def _plain(c: Column) -> Column:
    return F.lower(X.strip(F.regexp_replace(X.blank(c), r"\s+", " ")))


def answer_scores(df: DataFrame) -> DataFrame:
    """Adds answer_label, must_include_hit_ratio and violations to (answer, gold_answer, must_include, must_not_include, expected)."""
    answer, gold = _plain(F.col("answer")), _plain(F.col("gold_answer"))
    said = lambda phrases: F.exists(F.lit(phrases), lambda p: F.contains(answer, p))
    held = lambda name: F.filter(name, lambda p: F.contains(answer, _plain(p)))
    wanted = F.size("must_include")
    ratio = F.when(wanted > 0, F.size(held("must_include")) / F.when(wanted > 0, wanted)).otherwise(1.0)
    violations = held("must_not_include")
    answered = F.when((gold != "") & fuzzy_equal(answer, gold), "exact").when((ratio >= 0.5) & (F.size(violations) == 0), "partial").otherwise("wrong")
    label = (
        F.when(F.col("expected") == "answer", answered).when(F.col("expected") == "refuse", F.when(said(REFUSALS), "refuse_correct").otherwise("refuse_wrong"))
        .when(F.col("expected") == "clarify", F.when(said(CLARIFICATIONS), "clarify_correct").otherwise("clarify_wrong")).otherwise("wrong")
    )
    known = F.col("expected").isin("answer", "refuse", "clarify")
    none = F.array().cast("array<string>")
    return df.withColumns({"answer_label": label, "must_include_hit_ratio": F.when(known, F.round(ratio, 4)).otherwise(0.0), "violations": F.when(known, violations).otherwise(none)})


def with_gold(results: DataFrame, samples: DataFrame, fields: list[str]) -> DataFrame:
    """Results with the gold fields of the sample of their id; what a result itself holds counts only where there is no sample."""
    named = samples.select("id", F.lit(True).alias("_sample"), *(F.col(f).alias(f"_{f}") for f in fields))
    met = results.join(named, "id", "left")
    return met.withColumns({f: F.when(F.col("_sample"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_sample", *(f"_{f}" for f in fields))


def label_gate(df: DataFrame) -> DataFrame:
    """Adds retrieval_scored and skip_reason by label_status and gold_doc_ids."""
    scored = F.coalesce(F.col("label_status"), F.lit("unlabeled")).isin("labeled_doc", "labeled_chunk")
    reason = F.when(scored, "").when(F.coalesce(F.size("gold_doc_ids"), F.lit(0)) <= 0, "no_gold_doc_ids").otherwise("unlabeled_or_unanswerable")
    return df.withColumns({"retrieval_scored": scored, "skip_reason": reason})


def retrieval_averages(records: DataFrame) -> DataFrame:
    """One row: shares of hits, recall, reciprocal rank and evidence hits over records that were not skipped."""
    kept = records.filter("NOT skipped")
    share = lambda c: F.coalesce(F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4), F.lit(0.0)).alias(c)
    fields = ["hit_at_1", "hit_at_3", "hit_at_5", "recall_at_5", "mrr", "page_strict_hit_at_5", "page_relaxed_hit_at_5", "section_hit_at_5", "evidence_semantic_hit_at_5", "evidence_lexical_hit_at_5"]
    return kept.agg(F.count("*").alias("labeled_cases"), *(share(c) for c in fields if c in records.columns))


def answer_averages(records: DataFrame) -> DataFrame:
    """One row: the count of each of the seven labels, zeros included, and the rates of supported, refined, consistent and cited answers."""
    rate = lambda c, name: F.coalesce(F.round(F.try_divide(F.count_if(F.coalesce(F.col(c), F.lit(False))), F.count("*")), 4), F.lit(0.0)).alias(name)
    return records.agg(
        *(F.count_if(F.col("answer_label") == label).alias(label) for label in LABELS),
        rate("supported", "answer_supported_rate"), rate("refined", "answer_refined_rate"), rate("numeric_consistent", "numeric_verifier_pass_rate"), rate("cited", "citation_adequate_rate"),
    )


def full_summary(records: DataFrame, hits: list[str], means: list[str], label: str = "answer_label") -> DataFrame:
    """One row: n, "x/n" of each hit, the mean of each rank over records that have one, and a map of labels to counts. The labels are
    counted first, so one row a label meets the rest."""
    rate = lambda c: F.format_string("%d/%d", F.count_if(F.col(c) == 1), F.count("*")).alias(c)
    counted = records.groupBy(F.coalesce(F.col(label), F.lit("wrong")).alias("label")).agg(F.count("*").alias("c"))
    labels = counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "c")))).alias("labels"))
    totals = records.agg(F.count("*").alias("n"), *(rate(c) for c in hits), *(F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in means))
    return totals.join(F.broadcast(labels))  # one row each


def failure_breakdown(records: DataFrame, most: int = 80) -> DataFrame:
    """reason, n and share of the records of each failure reason, and their ids and the first ``most`` characters of their questions as rows
    of (reason, at): a reason with many records is many rows, not one long list."""
    total = records.agg(F.count("*").alias("total"))
    counted = records.groupBy("reason").agg(F.count("*").alias("n")).join(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")
    at = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    return records.select("reason", "id", F.substring("question", 1, most).alias("question"), at.alias("at")).join(F.broadcast(counted), "reason")  # as many rows as reasons


def timing_summary(timings: DataFrame) -> DataFrame:
    """stage, n, avg, min, max of (stage, ms)."""
    return timings.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("avg"), F.min("ms").alias("min"), F.max("ms").alias("max"))


def dataset_counts(samples: DataFrame) -> DataFrame:
    """One row: samples, distinct companies and documents, samples with pages and with evidence."""
    filled = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return samples.agg(F.count("*").alias("n"), F.countDistinct(X.blank(F.col("company"))).alias("companies"), F.countDistinct(X.blank(F.col("doc_name"))).alias("documents"), filled("pages").alias("with_pages"), filled("evidence").alias("with_evidence"))


def run_diff(base: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """query_id, label_change, direction, mrr_delta and mrr_degraded of records (query_id, answer_label, mrr) that are in both runs. A label that
    stands earlier among RANKED_LABELS than before counts as degraded, any other change as improved: so published diffs have it."""
    met = base.select("query_id", F.col("answer_label").alias("b"), F.col("mrr").alias("bm")).join(new.select("query_id", F.col("answer_label").alias("n"), F.col("mrr").alias("nm")), "query_id")
    place = lambda c: F.array_position(F.lit(RANKED_LABELS), F.col(c))
    changed = ~F.col("b").eqNullSafe(F.col("n"))
    known = (place("b") > 0) & (place("n") > 0)
    return met.select(
        "query_id", F.when(changed, F.concat_ws(" -> ", X.blank(F.col("b")), X.blank(F.col("n")))).alias("label_change"),
        F.when(changed & known, F.when(place("n") < place("b"), "degraded").otherwise("improved")).alias("direction"),
        F.round(F.col("nm") - F.col("bm"), 4).alias("mrr_delta"), (F.col("nm") < F.col("bm") - tolerance).alias("mrr_degraded"),
    )


def diff(base: DataFrame, new: DataFrame) -> DataFrame:
    """query_id, delta and change of doc_mrr between two runs."""
    met = base.select("query_id", F.col("doc_mrr").alias("b")).join(new.select("query_id", F.col("doc_mrr").alias("n")), "query_id")
    return met.select("query_id", F.round(F.col("n") - F.col("b"), 4).alias("delta"), F.when(F.col("n") > F.col("b"), "improved").when(F.col("n") < F.col("b"), "degraded").otherwise("same").alias("change"))
