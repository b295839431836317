"""The pipeline and its stages on small tables with the awkward cases, each stage against what its operator says by itself."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.helpers import SCHEMA, crowded, documents, frame
from vellum.llm import catalog, jaccard, mixing, pieces, quality
from vellum.llm._shared import WORD_PATTERN

STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: texts of two languages, junk, nulls, repeated rows, near copies, columns with clashing names."""
    root = str(tmp_path_factory.mktemp("tables"))
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    body = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in real.filter("doc_id < 400").collect()]
    odd = [(10_000 + i if i is not None else None, t, lang, s, n) for i, t, lang, s, n in documents(20)]
    again = [(20_000, body[0][1] + " more", *body[0][2:]), body[1], body[1]]
    crowded(frame(spark, body + odd + again)).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def test_stages_keep_the_columns(spark, folder):
    docs = docs_of(spark, folder)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert not bag(kept.collect(), "doc_id", "text") - bag(docs.collect(), "doc_id", "text") or name == "source mix"


def test_quality_stage(spark, folder):
    docs = docs_of(spark, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = quality.score(docs.select("doc_id", "text"), model).filter("tail >= 0.5").collect()
    assert bag(STAGES["quality classifier"](spark, docs, folder).collect(), "doc_id", "text") == bag(want, "doc_id", "text")


def test_duplicate_stage(spark, folder):
    docs = docs_of(spark, folder)
    members = jaccard.Join(docs.select("doc_id", "text")).members().collect()
    groups = {r["root"] for r in members if r["root"] is not None}
    kept = STAGES["n-gram Jaccard join"](spark, docs, folder).collect()
    worded = [r for r in kept if r["text"] and r["text"].strip(" \t\n\r\x0b\x0c")]
    assert len(worded) == len(groups) and 20_000 not in {r["doc_id"] for r in kept}


def test_mix_stage(spark, folder):
    docs = docs_of(spark, folder)
    want = collections.Counter()
    for r in mixing.mix_plan(docs.select("doc_id", "text", "source")).collect():
        want[r["doc_id"], r["text"]] += r["copies"]
    assert bag(STAGES["source mix"](spark, docs, folder).collect(), "doc_id", "text") == +want


def test_sizes_may_be_given(spark, folder):
    docs = docs_of(spark, folder).select("doc_id", "text", "source")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert bag(mixing.mix_plan(docs).collect(), *columns) == bag(mixing.mix_plan(sized, sized=True).collect(), *columns)


def test_pieces_stage(spark, folder):
    docs = docs_of(spark, folder)
    known = pieces.Pieces.load(catalog.VOCABULARY)
    made = STAGES["SentencePiece pieces"](spark, docs, folder).collect()
    texts = bag(docs.collect(), "doc_id", "text")
    back = collections.Counter((r["doc_id"], None if r["pieces"] is None else pieces.join(known, r["pieces"])) for r in made)
    assert back == texts and all(r["n_pieces"] in (len(r["pieces"] or ()), -1, None) for r in made)


def test_the_whole_run(spark, folder):
    """Each stage works on what its predecessor kept, and nothing comes back."""
    docs = docs_of(spark, folder)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    once, again = ([(r["doc_id"], tuple(r["pieces"] or ())) for r in df.collect()] for df in (docs, pipeline.run(spark, folder)))
    assert collections.Counter(once) == collections.Counter(again) and 100 < len(once)


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
