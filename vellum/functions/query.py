"""Query understanding: terms, intent, expansion and rewriting, as columns over a query text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import CJK, blank, normalize_whitespace, strip

ASCII_TERM = r"[A-Za-z][A-Za-z0-9_./:-]*|[0-9]+(?:\.[0-9]+)?"

# fixed values: intent patterns, over lower case
NUMERIC = r"\b(ratio|tax rate|effective tax|inventory|cash|revenue|profit|margin|earnings|eps|ebitda|debt|liabilities|assets|current|liquidity|dividend|percentage|%|percent|million|billion|amount|how much|how many|total|cost|price|value|worth|balance|decline|increase|growth|driven)\b"
LISTS = r"\b(products|services|segments|subsidiaries|brands|offerings|what does .* offer|what are .* products|what .* provide|types of|categories|classifications|lines of business|business.* overview|operating.* segment|revenue.* segment)\b"
DESCRIPTIVE = r"\b(explain|discuss|describe|why|how did|how does|what is the reason|what caused|management.* discussion|overview.* business|trend|comparison|year over year|vs |versus)\b"

# fixed values: words of financial queries
FINANCIAL = [
    "10-K", "10k", "年报", "季报", "财务报表", "资产负债表", "利润表", "现金流量表", "营收", "净利润", "毛利率", "每股收益", "股息", "债务", "资产",
    "10-k", "annual report", "financial statement", "balance sheet", "income statement", "cash flow", "revenue", "net income", "eps",
    "shares outstanding", "liabilities", "assets", "quick ratio", "current ratio", "liquidity", "solvency", "margin", "gross margin",
    "operating margin", "net margin", "profit margin", "ebitda", "ebit", "interest coverage", "working capital", "free cash flow",
    "operating cash flow", "debt-to-equity", "debt ratio", "leverage", "return on equity", "roe", "return on assets", "roa",
    "earnings per share", "dividend yield", "ratio", "ratios", "metric", "metrics",
]
# fixed values: indicators and what they are made of, in this order
EXPANSIONS = {
    "quick ratio": ["current assets", "cash equivalents", "short-term investments", "accounts receivable", "receivables", "current liabilities", "balance sheet", "liquidity"],
    "current ratio": ["current assets", "current liabilities", "balance sheet"],
    "liquidity": ["current assets", "cash", "cash equivalents", "short-term investments", "accounts receivable", "current liabilities", "balance sheet"],
    "balance sheet": ["current assets", "non-current assets", "current liabilities", "total assets", "total liabilities", "shareholders equity"],
    "income statement": ["revenue", "net income", "gross margin", "operating income", "earnings", "eps", "expenses", "cost of sales"],
    "cash flow": ["operating activities", "investing activities", "financing activities", "cash", "capital expenditures", "free cash flow"],
    "operating margin": ["operating income", "revenue", "gross margin", "operating expenses"],
    "net margin": ["net income", "revenue", "net profit", "earnings"],
    "gross margin": ["gross profit", "revenue", "cost of sales", "gross"],
    "tax rate": ["income tax", "provision for income taxes", "effective tax rate", "pretax income", "tax"],
    "debt": ["long-term debt", "short-term debt", "notes payable", "bonds", "liabilities", "interest expense"],
    "working capital": ["current assets", "current liabilities", "cash", "receivables", "inventories"],
}
CONTEXT = ["financial statements", "annual report", "10-K", "fiscal"]
# fixed values: rewriting
PREFIXES = ["what is", "what are", "what was", "what were", "how much", "how many", "how did", "how does", "why did", "why does", "why was", "why are", "can you", "could you", "please", "tell me"]
SECTIONS = ["10-K", "annual report", "financial statement", "item 7", "item 8", "management discussion", "balance sheet", "income statement", "cash flow", "consolidated financial statements"]
METRICS = ["ratio", "percentage", "million", "billion", "assets", "liabilities", "revenue", "income", "cash flow", "tax rate", "margin"]
LIST_TERMS = ["products", "services", "segments", "business", "overview", "item 1", "our business"]
DESCRIPTIVE_TERMS = ["management discussion", "analysis", "item 7", "overview", "results of operations"]


def normalize_mixed(query: Column) -> Column:
    """White space normalised and none left between two CJK characters (pairs do not overlap)."""
    return F.regexp_replace(normalize_whitespace(query), rf"({CJK})\s+({CJK})", "$1$2")


def terms(query: Column) -> Column:
    """Distinct lower case terms in order: Latin and numbers of two characters at least, then CJK runs."""
    text = normalize_mixed(query)
    latin = F.filter(F.regexp_extract_all(text, F.lit(ASCII_TERM), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(F.transform(latin, F.lower), F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0))))


def cjk_ngrams(text: Column) -> Column:
    """2-, 3- and 4-grams of a CJK run."""

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, (2, 3, 4)))


def intent(query: Column) -> Column:
    """The pattern with most matches; none or a tie: hybrid."""
    low = F.lower(blank(query))
    n, s, d = (F.regexp_count(low, F.lit(p)) for p in (NUMERIC, LISTS, DESCRIPTIVE))
    return F.when((n > s) & (n > d), "numeric_fact").when((s > n) & (s > d), "list_fact").when((d > n) & (d > s), "descriptive").otherwise("hybrid")


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def is_financial(query: Column) -> Column:
    text = normalize_mixed(query)
    return contains_any(F.lower(text), FINANCIAL) | (text.rlike(CJK) & contains_any(text, FINANCIAL[:15]))


def expand(query: Column) -> Column:
    """A financial query with its context terms and the components of its indicators appended, but for those that it holds."""
    text = normalize_mixed(query)
    low = F.lower(text)
    wanted = [F.when(~F.contains(low, F.lit(t.lower())), F.lit(t)) for t in CONTEXT]
    wanted += [F.when(F.contains(low, F.lit(i)) & ~F.contains(low, F.lit(t)), F.lit(t)) for i, parts in EXPANSIONS.items() for t in parts]
    return F.when(is_financial(query), F.concat_ws(" ", text, *wanted)).otherwise(text)


def rewrite(query: Column) -> Column:
    """The query with the terms that its intent and shortness call for appended."""
    original = strip(blank(query))
    low, kind = F.lower(original), intent(original)
    bare = reduce(lambda out, p: F.when(F.startswith(low, F.lit(p)), strip(F.substring(low, len(p) + 1, 1 << 30))).otherwise(out), reversed(PREFIXES), low)
    left = F.size(F.regexp_extract_all(normalize_whitespace(bare), F.lit(ASCII_TERM), F.lit(0)))
    short = left <= 3
    unless = lambda gate, phrases: [F.when(gate & ~F.contains(low, F.lit(t)), F.lit(t)) for t in phrases]
    added = F.array_compact(F.array(
        *[F.when((kind == "numeric_fact") & short, F.lit(t)) for t in SECTIONS[:5]],
        *unless(kind == "numeric_fact", METRICS),
        *unless((kind == "list_fact") & short, LIST_TERMS),
        *unless((kind == "descriptive") & short, DESCRIPTIVE_TERMS),
    ))
    more = F.array_compact(F.array(*unless(left <= 2, SECTIONS)))
    return F.concat_ws(" ", original, added, F.slice(more, F.lit(1), F.greatest(F.lit(0), 4 - F.size(added))))
