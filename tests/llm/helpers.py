"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "Über", "naïve", "x1", "-", "Zeta,"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 40])))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, ""]), len(text)))
    rows += [rows[3], rows[3], (n, rows[3][1], "en", "a", 1), (n + 1, "", "en", "a", 0), (n + 2, None, "en", "b", None), (None, "alpha beta", "de", None, 3), (n + 3, " \t\n ", None, "a", 4)]
    rows.append((n + 4, "long▁ text 日本語 " * 3000, "en", "b", 5))
    rows.append((n + 5, "🙂<0x41>  tail  ", "de", "b", 5))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def crowded(df):
    """``df`` with columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("size", "score", "rank", "shard", "target", "hub", "cls", "pieces", "tail", "bin"):
        df = df.withColumn(name, F.lit("mine"))
    return df
