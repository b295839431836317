"""A run from questions to scores in one plan, and its report as JSON records and Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import answers, evaluation
from vellum.sources.scratch import keep


def run(samples: DataFrame, retrieve: Callable[[DataFrame], DataFrame], generate: answers.Model = answers.first_sentence, gold_docs: DataFrame | None = None) -> DataFrame:
    """A record a sample (query_id, query, gold_answer, must_include, must_not_include, expected): its answer, label, confidence, verdict and
    document metrics. A question that nothing is retrieved for keeps an empty answer; all questions are one plan."""
    ranked = keep(retrieve(samples.select("query_id", "query")), "run")
    said = answers.answer(samples.select("query_id", "query"), lambda _: ranked, generate).drop("query")
    scored = evaluation.answer_scores(samples.join(said, "query_id"))
    gold = gold_docs if gold_docs is not None else ranked.select("query_id", "doc_id").limit(0)
    metrics = evaluation.document_metrics(ranked, gold)
    return scored.join(metrics, "query_id", "left")


def markdown(records: DataFrame, title: str, most: int = 20) -> str:
    """The report of a run: its sums, its labels, and the first ``most`` records that are wrong (a report for readers)."""
    total = evaluation.full_summary(records, ["doc_hit_at_1", "doc_hit_at_5"], ["doc_mrr"]).first()
    lines = [f"# {title}", "", "| measure | value |", "| --- | --- |", f"| samples | {total['n']} |", *(f"| {c} | {total[c]} |" for c in ("doc_hit_at_1", "doc_hit_at_5", "doc_mrr"))]
    lines += ["", "| label | n |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in sorted((total["labels"] or {}).items()))]
    wrong = records.filter(F.col("answer_label").isin("wrong", "refuse_wrong", "clarify_wrong")).orderBy("query_id").limit(most).collect()
    lines += ["", "## Wrong", "", *(f"- {r['query_id']} ({r['answer_label']}): {r['query'][:80]}" for r in wrong)]
    return "\n".join(lines) + "\n"


def diff_markdown(diff: DataFrame, base: str, new: str, most: int = 20) -> str:
    """What changed between two runs, from :func:`vellum.operators.evaluation.run_diff`."""
    total = diff.agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "improved").alias("improved"), F.count_if((F.col("direction") == "degraded") | F.col("mrr_degraded")).alias("degraded"), F.count("label_change").alias("changed")).first()
    rows = diff.filter("label_change IS NOT NULL OR mrr_degraded").orderBy("query_id").limit(most).collect()
    lines = [f"# {base} to {new}", "", f"{total['n']} samples: {total['improved']} improved, {total['degraded']} degraded, {total['changed']} with another label.", ""]
    return "\n".join([*lines, *(f"- {r['query_id']}: {r['label_change'] or 'same label'}, rank {r['mrr_delta'] or 0:+.4f}" for r in rows)]) + "\n"
