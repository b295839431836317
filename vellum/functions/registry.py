"""The scalar functions under SQL names: Catalyst expressions where they are columns, Arrow functions where texts are scanned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import spans
from vellum.functions import text as X
from vellum.sources import chunking

#: Name, result type and column function of one text each.
COLUMNS = {
    "normalize_whitespace": ("STRING", X.normalize_whitespace), "normalize_lexical": ("STRING", X.normalize_lexical), "collapse_whitespace": ("STRING", X.collapse), "content_hash": ("STRING", X.content_hash),
    "token_count": ("INT", X.token_count), "heading_level": ("INT", X.heading_level), "file_type": ("STRING", X.file_type), "is_noise": ("BOOLEAN", X.is_noise), "is_severe_noise": ("BOOLEAN", X.is_severe_noise),
    "is_template_noise": ("BOOLEAN", X.is_template_noise), "block_type": ("STRING", X.block_type), "cache_key": ("STRING", X.cache_key), "query_intent": ("STRING", Q.intent), "is_financial": ("BOOLEAN", Q.is_financial),
    "html_text": ("STRING", X.html_text),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and gives their names. Those of COLUMNS are SQL functions, which Catalyst inlines."""
    frame = spark.createDataFrame([], "x string")
    for name, (kind, f) in COLUMNS.items():
        expression = frame.select(f(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {expression}")

    @F.pandas_udf("array<string>")
    def split_text(texts: pd.Series) -> pd.Series:
        return texts.map(chunking.split_text)

    @F.pandas_udf("array<struct<unit:string,raw:string,value:double,around:string>>")
    def numbers(texts: pd.Series) -> pd.Series:
        return texts.map(spans.numbers)

    @F.pandas_udf("array<struct<start:bigint,end:bigint,text:string>>")
    def highlight_spans(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([spans.spans(t, None if x is None else list(x)) for t, x in zip(texts, terms, strict=True)])

    made = {"split_text": split_text, "numeric_evidence": numbers, "highlight_spans": highlight_spans}
    for name, f in made.items():
        spark.udf.register(name, f)
    return [*COLUMNS, *made]
