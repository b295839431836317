"""The pipeline's language stage against planted foreign and mixed texts, and texts of one language."""

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import keep_language

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """Cases by doc_id, and those that stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    body = {r["lang"]: r["text"] for r in docs.filter(F.length("text") > 1600).orderBy("doc_id").collect()}
    cases = {}
    for i, (lang, other) in enumerate([("en", "fr"), ("de", "en"), ("es", "de"), ("fr", "es")]):
        at = -100 * (i + 1)
        cases |= {
            at: (lang, body[lang][:1500]),
            at - 1: (lang, body[lang][:60]),
            at - 2: (None, body[lang][:1500]),
            at - 3: (lang, body[lang][:1000] + " key = 0a1b2c3d4e5f67890a1b2c3d4e5f6789 name@mail.example.com 5755695738806562"),
            at - 10: (lang, body[other][:1500]),
            at - 11: (lang, body[lang][:900] + " " + body[other][:600]),
            at - 12: (lang, "Ahojky všichni, dneska budeme povídat o tom, jak se vaří dobrý guláš a proč je důležité mít čerstvé maso i cibuli z trhu."),
            at - 13: (lang, "Привет, как дела, сегодня хорошая погода, и мы идём гулять в парк вместе с друзьями."),
            at - 14: (lang, "12345 !!! 67890"),
        }
    planted = spark.createDataFrame([(k, *v) for k, v in cases.items()], docs.schema)
    return cases, {r["doc_id"] for r in keep_language(spark, docs.unionByName(planted), DATA).select("doc_id").collect()}, docs.count()


def test_foreign_mixed_and_unknown_texts_go(kept):
    cases, stay, _ = kept
    assert [k for k in cases if -k % 100 >= 10 and k in stay] == []


def test_texts_of_one_language_stay(kept):
    cases, stay, n = kept
    assert [k for k in cases if -k % 100 < 10 and k not in stay] == []
    assert sum(k >= 0 for k in stay) >= 0.99 * n
