"""Evaluation records as JSON lines: datasets, runs, document information, questions with evidence; and writers of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: keys that a sample must have, and the values of two of them
REQUIRED = ["id", "question", "retrieval", "answer", "evaluation"]
STATUSES, BEHAVIOURS = ["unlabeled", "labeled_doc", "labeled_chunk", "unanswerable"], ["answer", "refuse", "clarify"]
SAMPLE = (
    "id string, dataset string, task_type string, difficulty string, tags array<string>, question struct<user_query: string, conversation_history: array<string>>, "
    "retrieval struct<label_status: string, gold_doc_ids: array<bigint>, gold_chunk_ids: array<bigint>>, answer struct<gold_answer: string, must_include: array<string>, must_not_include: array<string>>, "
    "evaluation struct<expected_behavior: string, scoring_type: string>, metadata struct<created_by: string, source: string, version: string>"
)
RUN = "id string, query string, final_answer string, latency_ms double, error string, retrieved_chunks array<struct<chunk_id: bigint, document_id: bigint, score: double, title: string, chunk_text: string, page_start: int, page_end: int>>"
DOC_INFO = "doc_name string, company string, doc_type string, doc_period string, doc_link string"
QUESTIONS = "financebench_id string, company string, doc_name string, question string, answer string, justification string, question_type string, question_reasoning string, evidence array<struct<doc_name: string, evidence_page_num: int, evidence_text: string, evidence_text_full_page: string>>"


def load_dataset(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Samples of a dataset; a line that is no JSON ends the job (``strict``) or is dropped. Samples without an id get one from their line."""
    rows = spark.read.schema(SAMPLE).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    made = F.concat(F.lit("sample_"), F.substring(F.md5(F.to_json(F.struct("question", "answer"))), 1, 12))
    return rows.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), made))


def load_run(spark: SparkSession, path: str) -> DataFrame:
    """Results of a run: JSON lines, or a report (.json) with the results in case_results."""
    if path.endswith(".json"):
        report = spark.read.schema(T.StructType([T.StructField("case_results", T.ArrayType(T.StructType.fromDDL(RUN)))])).json(path, multiLine=True)
        return report.select(F.explode("case_results").alias("r")).select("r.*")
    if path.endswith(".jsonl"):
        return spark.read.schema(RUN).json(path)
    raise ValueError(f"unsupported file format: {path}")


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad IS NULL").drop("_bad")


def load_doc_info(spark: SparkSession, path: str) -> DataFrame:
    """One row a document name: that of the last line that has it; broken lines and nameless ones are skipped."""
    text = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    read = text.select("_file", "_at", F.from_json("value", DOC_INFO).alias("r")).select("_file", "_at", "r.*").filter("doc_name <> ''")
    last = F.row_number().over(Window.partitionBy("doc_name").orderBy(F.desc("_file"), F.desc("_at")))
    return read.withColumn("_last", last).filter("_last = 1").drop("_last", "_at", "_file")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with answers and evidence; broken lines are skipped."""
    return _lines(spark, path, QUESTIONS)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines, empty fields included."""
    df.write.option("ignoreNullFields", "false").json(path)


def validate(samples: DataFrame) -> DataFrame:
    """id, errors: what is wrong with each sample of a dataset; an id that occurs again is wrong from its second sample on by content."""
    status, behaviour = F.coalesce("retrieval.label_status", F.lit("unlabeled")), F.coalesce("evaluation.expected_behavior", F.lit(""))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.to_json(F.struct("question", "answer"))))) > 1
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing: {c}")) for c in REQUIRED]
    return samples.withColumn("_again", again).select("id", F.array_compact(F.array(
        *missing,
        F.when(F.trim(F.coalesce("question.user_query", F.lit(""))) == "", F.lit("empty question")),
        F.when(status.isin("labeled_doc", "labeled_chunk") & empty("retrieval.gold_chunk_ids") & empty("retrieval.gold_doc_ids"), F.lit("labelled without gold")),
        F.when(~status.isin(*STATUSES), F.concat(F.lit("label_status: "), status)), F.when(~behaviour.isin(*BEHAVIOURS), F.concat(F.lit("expected_behavior: "), behaviour)), F.when(F.col("_again"), F.lit("duplicate id")),
    )).alias("errors"))
