"""Scoring signals of a chunk, each one column. ``text`` is the chunk, ``search`` its search text, ``section`` title and path joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.query import contains_any

# fixed values: weights
NUMERIC_WEIGHT, TABLE_WEIGHT, INTENT_WEIGHT, NOISE_WEIGHT = 0.08, 0.06, 0.07, 0.04
NUMBER = r"[\d,]+\.?\d*"
# fixed values: patterns and words of the signals
FINANCE_PATTERNS = [r"\$[\d,]+", r"\$\d+\.\d+", r"[\d,]+\.?\d*%", r"\d+%", r"\$\d+ billion", r"\$\d+ million", r"\d+ million", r"\d+ billion", r"(margin|gross|operating|net|EBITDA|EPS)[^\.]{0,100}\$[\d,]+"]
TABLE_WORDS = [
    "total", "assets", "liabilities", "equity", "inventory", "revenue", "tax", "rate", "cash", "current", "net income", "operating", "diluted", "shares", "eps", "dividend",
    "debt", "gross", "margin", "cost of sales", "operating income", "pretax", "provision", "balance sheet", "income statement", "cash flow", "current assets",
    "current liabilities", "long-term", "accounts receivable", "accounts payable", "property",
]
NOISE_SECTIONS = ["table of contents", "toc", "sec filing", "form 10-k", "forward-looking", "risk factor", "item [0-9]", "signature page", "exhibit index", "index of exhibits", "schedule .{0,30}", "attachment .{0,30}"]
CAUSAL = ["driven by", "primarily due to", "attributable to", "resulted in", "increased by", "decreased by", "improved", "declined"]
DRIVERS = ["driven", "driver", "cause", "why", "due to", "reason", "change", "increase", "decrease", "growth", "decline"]
NARRATIVE = ["management", "discussion", "analysis", "liquidity", "capital resources", "financial condition", "results of operations", "overview", "risk factor", "business", "notes to consolidated", "note "]
NARRATIVE_NOISE = ["schedule", "form 10-k", "table of contents", "sec filing", "accession"]
FINANCE_WORDS = [
    "ratio", "revenue", "cash", "debt", "eps", "ebitda", "inventory", "capex", "depreciation", "amortization", "segment", "gross margin", "operating income", "net income",
    "assets", "liabilities", "equity", "dividend", "growth", "decline", "increase", "decrease", "driven", "liquidity", "solvency", "working capital",
]
NUMERIC_INTENT = [
    "balance sheet", "current assets", "current liabilities", "cash equivalents", "short-term investment", "accounts receivable", "inventori", "total current",
    "financial summary", "ratio", "quick ratio", "current ratio", "effective tax", "provision for income", "income tax", "tax rate", "operating income", "net income", "gross margin", "revenue",
]
LIST_INTENT = ["overview", "products", "services", "segment", "subsidiary", "brands", "business", "offering", "we offer", "our products", "our business", "principal products", "line of business", "geographic", "category"]
DESCRIPTIVE_INTENT = ["management", "discussion", "analysis", "overview", "liquidity", "capital resources", "results of operations"]
RATIOS = {
    "quick ratio": ["cash equivalents", "cash and cash equivalents", "short-term investments", "accounts receivable", "receivables", "current liabilities"],
    "current ratio": ["current assets", "current liabilities"],
    "liquidity": ["current assets", "cash", "cash equivalents", "short-term investments", "accounts receivable", "receivables", "current liabilities"],
    "working capital": ["current assets", "current liabilities"],
}


def hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in phrases])


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def length_penalty(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 30, 0.05).when(n < 60, 0.02).when(n > 1800, 0.10).when(n > 1200, 0.06).otherwise(0.0)


# Counts that branches of a signal share are functions of their own (``*_hits``). Given as columns (``counts``), no branch counts again.


def numeric_hits(text: Column, search: Column) -> Column:
    both = F.concat(text, F.lit(" "), search)
    finance = reduce(lambda a, b: a + b, [count(both, p) for p in FINANCE_PATTERNS])
    return F.contains(both, F.lit("$")).cast("int") + F.contains(both, F.lit("%")).cast("int") + (finance >= 2).cast("int") + (count(both, NUMBER) >= 5).cast("int")


def numeric_density(text: Column, search: Column, counts: Column | None = None) -> Column:
    n = numeric_hits(text, search) if counts is None else counts
    return F.when(n >= 3, NUMERIC_WEIGHT).when(n == 2, NUMERIC_WEIGHT * 0.6).when(n == 1, NUMERIC_WEIGHT * 0.25).otherwise(0.0)


def table_like(text: Column, section: Column) -> Column:
    titled = hits(F.lower(section), TABLE_WORDS)
    title = F.when(titled >= 2, 0.03).when(titled == 1, 0.015).otherwise(0.0)
    rows = F.split(F.lower(text), "\n", -1)
    numeric = F.size(F.filter(rows, lambda r: r.rlike(NUMBER)))
    shape = F.when((F.size(rows) >= 3) & (numeric / F.size(rows) >= 0.4), TABLE_WEIGHT * 0.7).when(numeric >= 2, TABLE_WEIGHT * 0.35).otherwise(0.0)
    return F.least(F.lit(TABLE_WEIGHT), title + shape)


def intent_hits(low: Column, section: Column) -> Column:
    """Numeric, list and descriptive words of a lower case text and section."""
    whole = F.concat(low, F.lit(" "), section)
    return F.struct(hits(whole, NUMERIC_INTENT).alias("n"), hits(whole, LIST_INTENT).alias("k"), hits(section, DESCRIPTIVE_INTENT).alias("d"))


def intent_match(text: Column, search: Column, section: Column, intent: Column, counts: Column | None = None) -> Column:
    counts = intent_hits(F.lower(F.concat(text, F.lit(" "), search)), F.lower(section)) if counts is None else counts
    n, k, d = (counts[c] for c in "nkd")
    numeric = F.when(n >= 3, INTENT_WEIGHT).when(n == 2, INTENT_WEIGHT * 0.65).when(n == 1, INTENT_WEIGHT * 0.3).otherwise(0.0)
    listed = F.when(k >= 2, INTENT_WEIGHT).when(k == 1, INTENT_WEIGHT * 0.5).otherwise(0.0)
    return F.when(intent == "numeric_fact", numeric).when(intent == "list_fact", listed).when((intent == "descriptive") & (d >= 1), INTENT_WEIGHT * 0.5).otherwise(0.0)


def noise_penalty(text: Column, section: Column) -> Column:
    noisy = F.lower(section).rlike("|".join(NOISE_SECTIONS))
    return F.when(noisy, -NOISE_WEIGHT).when((F.length(text) < 80) & ~text.rlike("[0-9]"), -NOISE_WEIGHT * 0.5).otherwise(0.0)


def narrative_bonus(text: Column, search: Column, section: Column, counts: Column | None = None) -> Column:
    section = F.lower(section)
    n = hits(F.lower(F.concat(text, F.lit(" "), search)), FINANCE_WORDS) if counts is None else counts
    told = F.when(contains_any(section, NARRATIVE), 0.06).otherwise(0.0)
    return F.when(contains_any(section, NARRATIVE_NOISE), -0.05).otherwise(told + F.when(n >= 3, 0.05).when(n >= 1, 0.025).otherwise(0.0))


def causal_bonus(text: Column, search: Column, query: Column, counts: Column | None = None) -> Column:
    n = hits(F.lower(F.concat(text, F.lit(" "), search)), CAUSAL) if counts is None else counts
    causal = F.least(F.lit(0.06), n * 0.025) * F.when(contains_any(F.lower(query), DRIVERS), 1.5).otherwise(1.0)
    numeric = F.when(F.contains(text, F.lit("$")) | F.contains(text, F.lit("%")), 0.04).otherwise(0.02)
    return F.when(n >= 1, causal + numeric).otherwise(0.0)


def ratio_boost(text: Column, section: Column, query: Column) -> Column:
    whole, low = F.lower(F.concat(text, F.lit(" "), section)), F.lower(query)
    numeric_rows = F.size(F.filter(F.split(text, "\n", -1), lambda r: r.rlike("[0-9]")))
    single = F.when(F.contains(whole, F.lit("total current liabilities")) & (numeric_rows >= 3), 2.5).otherwise(0.35)

    def boost(parts: list[str]) -> Column:
        n = hits(whole, parts)
        return F.when(n >= 4, 1.2).when(n == 3, 1.0).when(n == 2, 0.7).when(n == 1, single).otherwise(0.0)

    return reduce(lambda out, ratio: F.when(F.contains(low, F.lit(ratio)), boost(RATIOS[ratio])).otherwise(out), reversed(RATIOS), F.lit(0.0))


def metadata_bonus(blocks: Column, depth: Column, has_list: Column, has_table: Column) -> Column:
    when = lambda c, value: F.when(F.coalesce(c, F.lit(False)), value).otherwise(0.0)
    return when(blocks.between(1, 6), 0.02) + when(depth.between(1, 4), 0.015) + when(has_list, 0.01) + when(has_table, 0.008)


def is_table(text: Column, section: Column) -> Column:
    """Chunks that look like a slice of a financial table."""
    # fixed values: sections of tables
    titled = contains_any(F.lower(section), ["balance sheet", "income statement", "cash flow", "current assets", "current liabilities", "total assets", "statement of", "financial statement", "item 7a", "quantitative and qualitative", "market risk", "assets and liabilities"])
    return F.contains(text, F.lit("col_0=")) | (titled & F.contains(text, F.lit("$")) & (count(text, NUMBER) >= 5))
