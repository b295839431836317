"""Recall over an index of chunks (or chunks: chunk_id, doc_id, chunk_text, ...) for a DataFrame of queries (query_id, query)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import text as X
from vellum.operators import scan
from vellum.operators.index import Index, of
from vellum.operators.scan import B, K1
from vellum.sources.scratch import keep


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best chunks of each query, ties to larger ids; Spark prunes groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.desc("chunk_id")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _bm25_weight() -> Column:
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))


def ranked(postings: DataFrame, terms: DataFrame, size: DataFrame, ranking: str = "bm25") -> DataFrame:
    """query_id, chunk_id, score of terms (query_id, term, df) over postings, given the one row (n, mean) of their chunks.

    Postings lie by chunk, and few terms are asked for, so the sums stay where the postings are. All of them are rows here; searches take :func:`scan.best`."""
    weight = _bm25_weight() if ranking == "bm25" else F.col("tf") * F.pow(F.log10(F.col("n") / F.col("df")), 2)
    met = postings.join(terms, "term").join(F.broadcast(size))  # one row
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score"))


def counted(index: Index, terms: DataFrame) -> DataFrame:
    """Terms (query_id, term) that the index holds, with their number of chunks, written so that the planner knows how few they are."""
    return keep(index.vocabulary.join(terms, "term").select("query_id", "term", "df"), "asked")


def fulltext(source: Index | DataFrame, queries: DataFrame, k: int = 10, ranking: str = "bm25") -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 or by tf * idf ** 2 (``tfidf2``), written: what follows may read them several times."""
    return keep(top_k(scan.best(of(source), query_tokens(queries), k, ranking), k), "hits")


#: Hits fetched by whole words and by prefixes for a question, for its financial expansion, and by words for LIABILITIES where a ratio is asked for.
FETCHED, EXPANDED, FOR_RATIO = 400, 60, 20
RATIO_WORDS, LIABILITIES = ["quick ratio", "current ratio", "liquidity"], "total current liabilities"


def lexical_recall(source: Index | DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, bm25: the best FETCHED of hits by words and by prefixes, and those of financial queries' expansion.

    Each recall is normalised by its own maximum; a chunk in both keeps the larger."""
    index, query = of(source), F.col("query")
    ratio = Q.contains_any(F.lower(Q.normalize_mixed(query)), RATIO_WORDS)
    financial = Q.is_financial(query)
    parts = F.array_compact(F.array(
        F.struct(F.lit("asked").alias("part"), query.alias("query")),
        F.when(financial, F.struct(F.lit("expanded").alias("part"), Q.expand(query).alias("query"))),
        F.when(financial & ratio, F.struct(F.lit("ratio").alias("part"), F.lit(LIABILITIES).alias("query"))),
    ))
    asked = queries.select("query_id", F.explode(parts).alias("p")).select(F.struct("query_id", "p.part").alias("query_id"), "p.query")
    # of words and of prefixes, each part's hits have ranks of their own
    found = scan.best_of_both(index, query_tokens(asked), FETCHED).filter("NOT prefix OR query_id.part <> 'ratio'")
    ranked_ = top_k(found.withColumn("query_id", F.struct("query_id.query_id", "query_id.part", "prefix")).drop("prefix"), FETCHED)
    order = F.when(F.col("query_id.part") == "ratio", 2).otherwise(F.col("query_id.prefix").cast("int"))
    hits = ranked_.select("query_id.query_id", "query_id.part", "chunk_id", "score", "rank", order.alias("order"))
    asked_for, ratio_part = F.col("part") == "asked", F.col("part") == "ratio"
    more = ~asked_for & (F.col("rank") <= F.when(ratio_part, FOR_RATIO).otherwise(EXPANDED))
    # one pass over the hits, so that no part of the plan is there twice
    each = hits.groupBy("query_id", "chunk_id").agg(F.max(F.when(asked_for, F.col("score"))).alias("first"), F.min_by("score", F.when(more, F.col("order"))).alias("second"), F.max(F.when(more, ratio_part.cast("int"))).alias("ratio"))
    whole = Window.partitionBy("query_id")
    place = lambda f: F.row_number().over(whole.orderBy(F.desc_nulls_last(f), F.desc("chunk_id")))
    each = each.withColumns({"at_first": place("first"), "at_second": place("second"), "ratio": F.coalesce(F.max("ratio").over(whole), F.lit(0))})
    share = lambda f: F.when(F.max(f).over(whole) > 0, F.col(f) / F.max(f).over(whole)).otherwise(F.col(f))
    best = F.greatest(F.when(F.col("at_first") <= FETCHED, share("first")), F.when(F.col("at_second") <= EXPANDED * (1 + F.col("ratio")), share("second")))
    return each.withColumn("bm25", best).filter("bm25 IS NOT NULL").select("query_id", "chunk_id", "bm25")


def boolean_prefix(source: Index | DataFrame, queries: DataFrame, k: int = 10, require_all: bool = False) -> DataFrame:
    """Chunks with words that begin with the query's terms; score: the number of matched terms."""
    return keep(top_k(scan.best(of(source), query_tokens(queries), k, "matched", prefix=True, require_all=require_all), k), "hits")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty, of norm 0 or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm)).otherwise(0.0)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


#: Bytes of query vectors that one task may hold, and rows that meet at once.
QUERY_BYTES, ROWS_AT_ONCE = 32 << 20, 4096


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` numbers and norm above 0: their places and unit vectors."""
    length = np.diff(np.asarray(column.offsets, np.int64))
    some = np.flatnonzero(np.asarray(column.is_valid()) & (length == dim))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[np.asarray(column.offsets, np.int64)[some][:, None] + np.arange(dim)]
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return some[good], x[good] / norm[good][:, None]


def _best_cosines(asked: dict[int, tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Of vectors (chunk_id, embedding) the k best above 0 for each query of ``asked`` (by length: ids, unit vectors)."""
    for dim, (names, q) in asked.items():
        place, x = _unit(batch.column(1), dim)
        ids = batch.column(0).to_numpy()[place]
        for a in range(0, len(ids), ROWS_AT_ONCE):
            own, score = ids[a : a + ROWS_AT_ONCE], np.round(q @ x[a : a + ROWS_AT_ONCE].T, 6)
            order = np.argsort(-own, kind="stable")  # ties go to larger ids
            own, score = own[order], score[:, order]
            n = len(own)
            floor = np.maximum(np.partition(score, n - k, axis=1)[:, n - k] if n > k else 0.0, 1e-9)
            row, col = np.nonzero(score >= (floor[:, None] if n > k else floor))
            order = np.lexsort((col, -score[row, col], row))
            row, col = row[order], col[order]
            first = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            row, col = row[first], col[first]
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(own[col]), pa.array(score[row, col])], ["query_id", "chunk_id", "score"])


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, filters: dict | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: best cosines above 0 of vectors (chunk_id, embedding, payload) for queries
    (query_id, vector), after equality filters. Ids are longs.

    Vectors are scanned once, in place, against all queries while these take less than QUERY_BYTES, which is counted first;
    more queries are dealt into blocks of that size, which the vectors then meet block by block."""
    for name, value in (filters or {}).items():
        if value is not None:
            vectors = vectors.filter(F.col(name) == value)
    schema = "query_id long, chunk_id long, score double"
    rows = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding").filter("chunk_id IS NOT NULL")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").filter("query_id IS NOT NULL AND size(vector) > 0")
    n_bytes = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()[0]
    if n_bytes <= QUERY_BYTES:
        told = _by_length(asked.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best_cosines(told, batch, k)

        found = rows.mapInArrow(run, schema)
    else:
        blocks = -(-n_bytes // QUERY_BYTES)

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            told = _by_length(right.select(["query_id", "vector"]))
            made = [b for batch in left.select(["chunk_id", "embedding"]).combine_chunks().to_batches() for b in _best_cosines(told, batch, k)]
            return pa.Table.from_batches(made, pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())]))

        # a block of vectors is what one task holds, as a block of queries is
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(max(8, 4 * blocks)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        theirs = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(8, 4 * blocks) - 1).cast("long"))))
        found = dealt.groupBy("block", "part").cogroup(theirs.groupBy("block", "part")).applyInArrow(meet, schema)
    return top_k(found, k)


def _by_length(asked: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> ids and unit vectors of queries (query_id, vector)."""
    column = asked["vector"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    ids = asked["query_id"].to_numpy()
    out = {}
    for dim in np.unique(np.diff(np.asarray(column.offsets, np.int64))) if len(column) else ():
        place, x = _unit(column, int(dim))
        if len(place):
            out[int(dim)] = ids[place], x
    return out


def max_normalized(df: DataFrame, *fields: str) -> DataFrame:
    """Each field over the query's maximum of it, where that is above 0."""
    best = lambda f: F.max(f).over(Window.partitionBy("query_id"))
    return df.withColumns({f: F.when(best(f) > 0, F.col(f) / best(f)).otherwise(F.col(f)) for f in fields})


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks, the best score of repeated ones."""
    return hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(chunks, "chunk_id")


def merge(parts: list[DataFrame], fields: list[str]) -> DataFrame:
    """Full outer merge of recalls by (query_id, chunk_id): the maximum of each score, 0 where none has it."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy("query_id", "chunk_id").agg(*(F.max(F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in fields))


def merge_hits(parts: list[DataFrame], fields: list[str], first: list[str]) -> DataFrame:
    """Recalls (query_id, chunk_id, term_hits: map of counts, the score ``fields``, the columns ``first``) as one: the maximum of each score,
    counts of terms added up, and other columns of the earliest recall that has the chunk."""
    whole = None
    for number, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(number))
        whole = tagged if whole is None else whole.unionByName(tagged, allowMissingColumns=True)
    key = ["query_id", "chunk_id"]
    counted = whole.select(*key, F.explode("term_hits").alias("term", "n")).groupBy(*key, "term").agg(F.sum("n").alias("n"))
    counted = counted.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "n")))).alias("term_hits"))
    merged = whole.groupBy(*key).agg(*(F.max(F.coalesce(F.col(f), F.lit(0.0))).alias(f) for f in fields), F.min_by(F.struct(*first), "_part").alias("_first"))
    return merged.join(counted, key, "left").select(*key, *fields, "_first.*", F.coalesce("term_hits", F.create_map().cast("map<string,bigint>")).alias("term_hits"))


def whole_word(term: Column, low: Column) -> Column:
    bare = F.replace(term, F.lit("."), F.lit("[.]"))
    pattern = F.concat(F.lit("(^|[^a-z0-9_])"), bare, F.lit("([^a-z0-9_]|$)"))
    return F.when(term.rlike(X.CJK), F.contains(low, term)).otherwise(F.regexp_like(low, pattern))


def prefix_hit(term: Column, low: Column) -> Column:
    return F.regexp_like(low, F.concat(F.lit(r"(^|[\s:/._-])"), F.replace(term, F.lit("."), F.lit("[.]"))))


def whole_words(terms: Column, low: Column) -> Column:
    """Those of the (distinct) terms that are whole words of a lower case text. Terms of letters, digits and underscores are looked up
    among the text's words at once; only the others that the text holds need a pattern each."""
    plain = F.array_intersect(terms, F.split(low, "[^a-z0-9_]+"))
    return F.concat(plain, F.filter(terms, lambda t: F.contains(low, t) & ~t.rlike("^[a-z0-9_]+$") & whole_word(t, low)))


def term_occurrences(pairs: DataFrame) -> DataFrame:
    """chunk_id, term, exact, inside, whole, prefix of (chunk_id, chunk_text, term): occurrences as written and in any case, and whether the
    term stands as a whole word and at the beginning of one."""
    low, term = F.lower("chunk_text"), F.col("term")
    held = lambda text: ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")
    return pairs.select("chunk_id", "term", held(F.col("chunk_text")).alias("exact"), held(low).alias("inside"), whole_word(term, low).alias("whole"), prefix_hit(term, low).alias("prefix"))


def keyword_components(pairs: DataFrame) -> DataFrame:
    """Adds keyword_score, title_score, section_score and coverage_score, of the query's terms, to pairs (query, chunk_text, title, section);
    queries without terms go. A projection: nothing is shuffled.

    A term counts in a field once for each of title and section where it is a whole word, provided the field holds it."""
    terms, low = F.col("_terms"), {c: F.col(f"_low_{c}") for c in ("chunk_text", "title", "section")}
    each = pairs.withColumn("_terms", Q.terms(F.col("query"))).filter(F.size("_terms") > 0)
    each = each.withColumns({f"_low_{c}": F.lower(c) for c in low})  # columns, so that no term lowers its text again
    each = each.withColumns({"_title": whole_words(terms, low["title"]), "_section": whole_words(terms, low["section"]), "_n": F.size(terms)})
    within = lambda words, field: F.size(F.filter(words, lambda t: F.contains(low[field], t)))

    def hit(field: str) -> Column:
        hits = within("_title", field) + within("_section", field)
        return F.when(F.col("_n") >= 2, (hits >= 2).cast("double")).otherwise(F.exists(terms, lambda t: F.contains(low[field], t)).cast("double"))

    coverage = F.size(whole_words(terms, low["chunk_text"])) / F.col("_n")
    scored = each.withColumns({"coverage_score": coverage, "title_score": hit("title"), "section_score": hit("section")})
    return scored.withColumn("keyword_score", F.col("coverage_score") / 2).drop("_terms", "_title", "_section", "_n", *(f"_low_{c}" for c in low))
