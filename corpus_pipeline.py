"""A corpus pipeline of five operators: quality, language, near duplicates, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's ``docs``. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import jaccard, langid, mixing, pieces, quality
from vellum.llm._shared import keep
from vellum.llm.catalog import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not of the top grade (neither poor nor toxic)."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("tail >= 0.5").select(*docs.columns)


#: Least lead of a text's language over the next (a quarter of another language halves it), most misfit, and the probability from which a text contradicts its lang.
LEAST_LEAD, MOST_MISFIT, CONTRADICTS = 0.5, 0.5, 0.99


def judge_language(docs: DataFrame, model: langid.Model) -> DataFrame:
    """``docs`` with lang_pred, score, lead, misfit and why: what speaks against a document's language, null where nothing does.

    und: no words of letters, or no language of probability one half. other: surely another language than its lang.
    mixed: the language leads by less than half of what a text of it does. unknown: it fits none."""
    known = langid.predict(docs.withColumn("_raw", F.col("text")).withColumn("text", langid.words_only(F.col("text"))), model, evidence=True)
    why = (
        F.when((F.col("lang_pred") == "und") | (F.col("score") < 0.5), "und")
        .when(F.col("misfit") > MOST_MISFIT, "unknown")
        .when(F.col("lead") < LEAST_LEAD, "mixed")
        .when((F.col("lang_pred") != F.col("lang")) & (F.col("score") >= CONTRADICTS), "other")
    )
    return known.withColumn("why", why).withColumn("text", F.col("_raw")).drop("_raw")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with nothing against their language, by a model of all documents' lang."""
    return judge_language(docs, langid.train(docs)).filter("why IS NULL").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by a 5-word Jaccard similarity of 0.8."""
    return jaccard.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources want them."""
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the sampled piece ids."""
    return pieces.encode(docs, pieces.Pieces.load(VOCABULARY)).select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("source mix", mix_sources),
    ("SentencePiece pieces", encode_pieces),
]

#: Hashed features and sampling have no counterpart in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, f"stage-{number}")
    return docs
