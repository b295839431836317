"""Tables written with pipes: rows of cells, headers, units, years and ``header=cell`` lines. Spark expressions throughout.

A leading pipe makes an empty first cell. Years are given whole ("2021"), once each, in order, ten at most."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import strip

# fixed values
BAR = r"\s*\|\s*"
YEAR = r"(?<![.\d])(?:19|20)\d{2}(?![.\d])"
UNIT = r"(?i)(?:单位|币种|货币)[:：]?\s*([^\n|]+)"
TITLE = r"(?i)(?:表格|表[题名]?|数据来源|source)\s*[:：]?\s*([^\n|]{2,50})"


def rows(table: Column) -> Column:
    """Array of rows, each an array of cells; empty lines and trailing empty cells are left out."""
    lines = F.transform(F.split(table, "\n"), lambda x: F.regexp_replace(strip(x), r"(\s*\|\s*)+\z", ""))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.split(x, BAR))


def headers(parsed: Column) -> Column:
    """Cells of the first row where it reads like a header, else none."""
    first, second = F.get(parsed, 0), F.get(parsed, 1)
    rest = lambda row: F.filter(F.slice(row, F.lit(2), F.size(row)), lambda c: c != "")
    titled = (F.size(rest(first)) > 0) & F.forall(rest(first), lambda c: (F.length(c) <= 5) | c.rlike("^" + YEAR))
    valued = F.exists(rest(second), lambda c: c.rlike(r"[.%]|^[-+]?\d"))
    return F.when((F.size(parsed) == 1) | (F.size(first) < F.size(second)) | (titled & valued), first).otherwise(F.array().cast("array<string>"))


def metadata(table: Column, parsed: Column) -> Column:
    """Struct of title, headers, units, numeric, percent, years, n_columns, n_rows."""
    flat = F.array_join(F.flatten(parsed), " ")
    top = lambda n: F.slice(F.split(table, "\n"), 1, n)
    found = lambda cells, p: F.filter(F.transform(cells, lambda x: strip(F.regexp_extract(x, p, 1))), lambda x: x != "")
    return F.struct(
        F.coalesce(F.get(found(top(5), TITLE), 0), F.lit("")).alias("title"),
        headers(parsed).alias("headers"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(found(headers(parsed), UNIT), found(top(3), UNIT)))), " | ").alias("units"),
        flat.rlike(r"\d").alias("numeric"),
        flat.rlike(r"\d%").alias("percent"),
        F.slice(F.array_distinct(F.regexp_extract_all(flat, F.lit(YEAR), F.lit(0))), 1, 10).alias("years"),
        F.coalesce(F.array_max(F.transform(parsed, lambda r: F.size(r))), F.lit(0)).alias("n_columns"),
        F.size(parsed).alias("n_rows"),
    )


def linear(row: Column, names: Column) -> Column:
    """One row as ``header=cell`` pairs; columns without a header are col_0, col_1, ... and empty cells are left out."""
    pairs = F.transform(row, lambda c, i: F.when(strip(c) != "", F.concat(F.coalesce(strip(F.get(names, i)), F.concat(F.lit("col_"), i.cast("string"))), F.lit("="), strip(c))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")


def linear_rows(parsed: Column) -> Column:
    """Array of the rows below the header, each as :func:`linear`."""
    names = headers(parsed)
    body = F.slice(parsed, F.when(F.size(names) > 0, 2).otherwise(1), F.size(parsed))
    return F.transform(body, lambda r: linear(r, names))


def numeric_density(parsed: Column) -> Column:
    """The share of cells that hold a digit; 0 without cells."""
    cells = F.flatten(parsed)
    return F.when(F.size(cells) > 0, F.size(F.filter(cells, lambda c: c.rlike(r"\d"))) / F.when(F.size(cells) > 0, F.size(cells))).otherwise(0.0)
