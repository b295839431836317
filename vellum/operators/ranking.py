"""Score fusion, de-duplication, neighbours, pages and sections over candidates keyed by (query_id, chunk_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import query as Q
from vellum.functions import signals as S
from vellum.functions import text as X

# fixed values: weights of embedding, keyword, full text, title and section
WEIGHTS, RATIO_WEIGHTS = (0.45, 0.20, 0.10, 0.15, 0.10), (0.10, 0.35, 0.35, 0.10, 0.10)
ALPHA, SIMILAR, SAME_SECTION, PER_PAGE, PAGE_WINDOW = 0.15, 0.82, 3, 5, 3


def page_diversity(df: DataFrame, top: int = 20) -> Column:
    """Bonus of pages with few candidates, malus of crowded ones. Pages go by number, whatever the document."""
    page, query = Window.partitionBy("query_id", "page_start"), Window.partitionBy("query_id")
    on_page = F.count("page_start").over(page)
    pages = F.size(F.collect_set("page_start").over(query))
    ideal = top / F.least(pages, F.lit(5))
    bonus = F.when(on_page < ideal, 0.03 * (1 - on_page / ideal)).when(on_page > ideal * 1.5, -0.02 * (on_page / ideal - 1)).otherwise(0.0)
    return F.when(F.col("page_start").isNull() | (pages <= 1), 0.0).otherwise(bonus)


def fused_score(df: DataFrame) -> DataFrame:
    """Adds final_score to candidates (query_id, query, chunk_id, chunk_text, title, section, page_start, block_count,
    depth and the scores embedding, keyword, bm25, title_score, section_score, coverage). Signals need no join."""
    text, section, query, intent = F.col("chunk_text"), F.col("section"), F.col("_query"), F.col("_intent")
    # columns first: as parts of the score each of its branches would lower the text and count again
    own = df.columns
    df = df.withColumns({"_query": Q.normalize_mixed(F.col("query")), "_intent": Q.intent(F.col("query")), "_few": F.size(Q.terms(F.col("query"))) <= 2, "_low": F.lower(F.concat(text, F.lit(" "), text)), "_low_section": F.lower(section)})
    df = df.withColumns({
        "_numeric": S.numeric_hits(text, text), "_narrative": S.hits(F.col("_low"), S.FINANCE_WORDS), "_causal": S.hits(F.col("_low"), S.CAUSAL), "_intents": S.intent_hits(F.col("_low"), F.col("_low_section")),
        "_diversity": page_diversity(df),
    })
    few = F.col("_few")
    ratio = (intent == "numeric_fact") & Q.contains_any(F.lower(query), ["quick ratio", "current ratio", "liquidity", "working capital"])
    short = (WEIGHTS[0] - 0.05, WEIGHTS[1] + 0.03, WEIGHTS[2] + 0.02, WEIGHTS[3], WEIGHTS[4])
    weight = lambda i: F.when(ratio, RATIO_WEIGHTS[i]).when(few, short[i]).otherwise(WEIGHTS[i])
    lexical = (F.col("embedding") == 0) & (F.col("bm25") > 0)
    parts = [
        weight(0) * F.col("embedding"),
        F.when(lexical, 0.35).otherwise(weight(1)) * F.col("keyword"),
        F.when(lexical, 0.25).otherwise(weight(2)) * F.col("bm25"),
        weight(3) * F.col("title_score"),
        weight(4) * F.col("section_score"),
        0.08 * F.col("coverage"),
        F.when(lexical, 0.06).otherwise(0.0),
        S.metadata_bonus(F.col("block_count"), F.col("depth"), F.lit(False), F.lit(False)),
        S.narrative_bonus(text, text, section, F.col("_narrative")),
        F.col("_diversity"),
        S.causal_bonus(text, text, query, F.col("_causal")),
        S.numeric_density(text, text, F.col("_numeric")),
        S.table_like(text, section),
        S.intent_match(text, text, section, intent, F.col("_intents")),
        S.ratio_boost(text, section, query),
        S.noise_penalty(text, section),
        -S.length_penalty(text),
    ]
    return df.withColumn("final_score", F.round(reduce(lambda a, b: a + b, parts), 6)).drop(*(c for c in df.columns if c not in own))


def smoothed_pages(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """query_id, page_start, smoothed: a page's best score plus alpha times the better of its two neighbours' (0 at least)."""
    pages = df.filter("page_start IS NOT NULL").groupBy("query_id", "page_start").agg(F.max("final_score").alias("best"))
    # a page offers its score to both neighbours; that is one aggregate instead of two joins
    offered = pages.select("query_id", F.explode(F.array(F.col("page_start") - 1, F.col("page_start"), F.col("page_start") + 1)).alias("page_start"), F.col("page_start").alias("of"), "best")
    near = offered.groupBy("query_id", "page_start").agg(F.max(F.when(F.col("of") == F.col("page_start"), F.col("best"))).alias("own"), F.max(F.when(F.col("of") != F.col("page_start"), F.col("best"))).alias("side"))
    return near.filter("own IS NOT NULL").select("query_id", "page_start", F.round(F.col("own") + alpha * F.greatest(F.coalesce("side", F.lit(0.0)), F.lit(0.0)), 6).alias("smoothed"))


def clustered(df: DataFrame, every: bool = False) -> DataFrame:
    """Lifts the best candidate of each page (or every one) to the smoothed score of its page, where that gains more than .01."""
    rank = F.row_number().over(Window.partitionBy("query_id", "page_start").orderBy(F.desc("final_score"), "chunk_id"))
    lifted = df.withColumn("_rank", rank).join(smoothed_pages(df), ["query_id", "page_start"], "left")
    gain = (F.col("smoothed") - F.col("final_score") > 0.01) & (F.lit(every) | (F.col("_rank") == 1))
    return lifted.withColumn("final_score", F.when(gain, F.col("smoothed")).otherwise(F.col("final_score"))).drop("_rank", "smoothed")


def page_capped(df: DataFrame, k: int, per_page: int = PER_PAGE) -> DataFrame:
    """At most ``per_page`` of a page, the surplus filling up to k. A missing page is a page of its own."""
    page = F.coalesce(F.col("page_start").cast("string"), F.concat(F.lit("-"), F.col("chunk_id").cast("string")))
    rank = F.row_number().over(Window.partitionBy("query_id", page).orderBy(F.desc("final_score"), "chunk_id"))
    order = Window.partitionBy("query_id")
    kept = df.withColumn("_over", (rank > per_page).cast("int"))
    kept = kept.withColumn("_at", F.row_number().over(order.orderBy("_over", F.desc("final_score"), "chunk_id"))).filter(F.col("_at") <= k)
    return kept.withColumn("rank", F.row_number().over(order.orderBy(F.desc("final_score"), "chunk_id"))).drop("_over", "_at")


def greedy_distinct(df: DataFrame, k: int, similar: float = SIMILAR, same_section: int = SAME_SECTION) -> DataFrame:
    """query_id, chunk_id, rank: candidates by score, leaving out what resembles one chosen before (token Jaccard) or
    crowds a section; table slices escape both. Candidates are few a query (recall bounds them)."""
    one = F.struct(
        (-F.col("final_score")).alias("order"), "chunk_id", F.array_distinct(X.tokens(F.col("chunk_text"))).alias("t"),
        F.concat_ws("::", F.col("doc_id").cast("string"), "section").alias("section"), S.is_table(F.col("chunk_text"), F.col("section")).alias("free"),
    )
    listed = df.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    chosen = f"""aggregate(c, cast(array() as array<struct<order:double,chunk_id:bigint,t:array<string>,section:string,free:boolean>>), (acc, x) ->
        CASE WHEN size(acc) >= {k} THEN acc
             WHEN x.free OR (size(filter(acc, y -> y.section = x.section)) < {same_section}
                AND NOT exists(acc, y -> size(x.t) > 0 AND size(array_intersect(x.t, y.t)) / size(array_union(x.t, y.t)) >= {similar}))
             THEN array_append(acc, x) ELSE acc END)"""
    return listed.select("query_id", F.posexplode(F.expr(chosen)).alias("at", "x")).select("query_id", F.col("x.chunk_id").alias("chunk_id"), (F.col("at") + 1).alias("rank"))


def with_neighbors(centers: DataFrame, chunks: DataFrame, limit: int, window: int = 1, spare: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Centres (query_id, chunk_id, doc_id, chunk_index, section, final_score, rank) and, while there is room, their neighbours
    of the same section, at min(.45 s, s - .7). Offsets are exploded, so the join is on equality. With ``spare`` there is room for
    that many beyond the centres at least. ``carry`` names columns of chunks to keep."""
    around = F.array(*[F.lit(sign * o) for o in range(1, window + 1) for sign in (-1, 1)])
    wanted = centers.select("query_id", "doc_id", F.col("section").alias("_section"), F.col("rank").alias("_rank"), "final_score", "chunk_index", F.posexplode(around).alias("_at", "_by"))
    wanted = wanted.withColumn("chunk_index", F.col("chunk_index") + F.col("_by"))
    found = wanted.join(chunks.select("chunk_id", "doc_id", "chunk_index", "section", "chunk_text", *carry), ["doc_id", "chunk_index"])
    same = (F.col("section") == F.col("_section")) | (F.col("section") == "") | (F.col("_section") == "")
    found = found.filter(same & (F.trim("chunk_text") != "")).join(centers.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    first = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("_rank", "_at", "final_score")).alias("m"), *(F.first(c).alias(c) for c in carry))
    score = F.round(F.least(F.col("m.final_score") * 0.45, F.col("m.final_score") - 0.7), 6)
    own = centers.select("query_id", "chunk_id", *carry, "final_score", F.lit(False).alias("is_neighbor"), F.struct(F.lit(0).alias("late"), F.col("rank").alias("a"), F.lit(0).alias("b")).alias("_key"))
    more = first.select("query_id", "chunk_id", *carry, score.alias("final_score"), F.lit(True).alias("is_neighbor"), F.struct(F.lit(1).alias("late"), F.col("m._rank").alias("a"), F.col("m._at").alias("b")).alias("_key"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("_key", "chunk_id"))
    room = F.lit(limit) if spare is None else F.greatest(F.lit(limit), F.count_if(~F.col("is_neighbor")).over(Window.partitionBy("query_id")) + spare)
    return own.unionByName(more).withColumns({"_at": at, "_room": room}).filter((F.col("_at") <= F.col("_room")) | ~F.col("is_neighbor")).drop("_key", "_at", "_room")


def sections(df: DataFrame, window: int = PAGE_WINDOW) -> DataFrame:
    """Groups the candidates of a query's document by pages within ``window`` of the group's first (anchored, not chained)."""
    one = F.struct("page_start", (-F.col("final_score")).alias("o"), "chunk_id", "section", "chunk_text")
    listed = df.filter("page_start IS NOT NULL").groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(one)).alias("c"))
    starts = f"aggregate(c.page_start, cast(array() as array<bigint>), (acc, p) -> array_append(acc, CASE WHEN size(acc) > 0 AND p - acc[size(acc) - 1] <= {window} THEN acc[size(acc) - 1] ELSE cast(p as bigint) END))"
    each = listed.select("query_id", "doc_id", F.explode(F.arrays_zip(F.expr(starts).alias("start"), F.col("c").alias("c"))).alias("z")).select("query_id", "doc_id", F.col("z.start").alias("start"), "z.c.*")
    return each.groupBy("query_id", "doc_id", "start").agg(
        F.min("page_start").alias("page_start"), F.max("page_start").alias("page_end"), F.mode("section", True).alias("section"), F.count("*").alias("chunk_count"),
        F.round(F.avg(-F.col("o")), 10).alias("avg_score"), F.round(F.max(-F.col("o")), 6).alias("max_score"),
        F.max(F.when(F.col("page_start") == F.col("start"), -F.col("o"))).alias("first_page_score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_start", "o", "chunk_id", "chunk_text"))), lambda x: x["chunk_text"]), "\n").alias("combined_text"),
    )


# fixed values: words of section titles, weights of section scores
TITLES = ["balance sheet", "income statement", "cash flow", "management discussion", "overview", "business", "risk factor", "notes to", "financial summary"]
DENSE, LEXICAL, RELEVANCE, BEST_SECTIONS = 0.60, 0.40, 0.06, 5


def keyword_recalled(df: DataFrame, k: int = 20) -> DataFrame:
    """Candidates with keyword scores as fusion sees them: the k best by keywords, title and section keep theirs, as do those of the
    lexical recall, which fusion scores itself; others' are 0."""
    lexical = 0.60 * F.col("keyword") + 0.23 * F.col("title_score") + 0.17 * F.col("section_score")
    any_ = (F.col("keyword") > 0) | (F.col("coverage") > 0) | (F.col("bm25") > 0)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.when(any_, F.round(lexical, 9))), "chunk_id"))
    kept = df.withColumn("_kept", (any_ & (at <= k)) | (F.col("bm25") > 0))
    return kept.withColumns({c: F.when(F.col("_kept"), F.col(c)).otherwise(0.0) for c in ("keyword", "title_score", "section_score", "coverage")}).drop("_kept")


def section_scored(sections: DataFrame, lexical: DataFrame, dense: DataFrame, k: int = BEST_SECTIONS) -> DataFrame:
    """The k best of a query's sections (from :func:`sections`) by section_score: dense and lexical scores over their maxima, and a
    boost for titles. ``dense``: query_id, doc_id, start, dense. Where a query's dense scores are all 0, its best chunks' scores stand in."""
    key = ["query_id", "doc_id", "start"]
    own = Window.partitionBy("query_id")
    met = sections.join(lexical, key).join(dense, key)
    met = met.withColumn("dense", F.when(F.max(F.abs("dense")).over(own) > 0, F.col("dense")).otherwise(F.col("first_page_score")))
    over = lambda c: F.col(c) / F.when(F.max(c).over(own) > 0, F.max(c).over(own)).otherwise(1.0)
    boost = F.least(F.lit(0.1), S.hits(F.lower(F.col("section")), TITLES) * 0.03)
    scored = met.withColumn("section_score", F.round(DENSE * over("dense") + LEXICAL * over("lexical_score") + boost, 6))
    at = F.row_number().over(own.orderBy(F.desc("section_score"), "doc_id", "start"))
    return scored.withColumn("rank", at).filter(F.col("rank") <= k)


def section_capped(df: DataFrame, sections: DataFrame, per_section: int = 5) -> DataFrame:
    """query_id, chunk_id, section_score, rank: the best ``per_section`` candidates of each section, sections by rank. A chunk is in one section only."""
    members = df.join(sections.select("query_id", "doc_id", "page_start", "page_end", F.col("section_score").alias("_relevance"), F.col("rank").alias("_section")).withColumnsRenamed({"page_start": "_from", "page_end": "_to"}), ["query_id", "doc_id"])
    members = members.filter(F.col("page_start").between(F.col("_from"), F.col("_to")))
    at = F.row_number().over(Window.partitionBy("query_id", "_section").orderBy(F.desc("final_score"), "chunk_id"))
    taken = members.withColumn("_at", at).filter(F.col("_at") <= per_section)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_section", "_at"))
    return taken.withColumn("rank", place).select("query_id", "chunk_id", F.col("_relevance").alias("section_score"), "rank")


def section_lexical(df: DataFrame) -> DataFrame:
    """(query_id, doc_id, start, query, section, combined_text) -> lexical_score: occurrences of the query's terms, capped at 1."""
    low = F.lower(F.concat_ws(" ", "section", "combined_text"))
    each = df.select("query_id", "doc_id", "start", low.alias("low"), F.explode(Q.terms(F.col("query"))).alias("term"))
    held = (F.length("low") - F.length(F.replace(F.col("low"), F.col("term"), F.lit("")))) / F.length("term")
    scored = each.groupBy("query_id", "doc_id", "start").agg(F.sum(held).alias("hits"), F.count("*").alias("n"))
    return scored.select("query_id", "doc_id", "start", F.round(F.least(F.lit(1.0), F.col("hits") / F.col("n") + F.col("hits") * 0.02), 6).alias("lexical_score"))
