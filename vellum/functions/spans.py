"""Places in texts: merged highlight spans and numeric evidence. Offsets need a scan of each text, so these are Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: forms of numbers, and characters shown on either side
FORMS = [("percent", r"[\d,]+\.?\d*%"), ("dollar", r"\$[\d,]+\.?\d*\s*(?:million|billion|thousand)?"), ("ratio", r"[\d,]+\.?\d*\s*(?:x|times|percent|%)?"), ("plain", r"(?:^|\s)[\d,]+\.?\d+(?:\s|$)")]
AROUND = 40
_FORMS = [(unit, re.compile(form, re.IGNORECASE)) for unit, form in FORMS]


def spans(text: str | None, terms: list[str] | None) -> list[dict]:
    """Where any term occurs, whatever the case; spans that meet or overlap are one. Empty terms and null texts give none."""
    found = sorted(m.span() for t in set(terms or []) if t for m in re.finditer(re.escape(t), text or "", re.IGNORECASE))
    merged: list[dict] = []
    for start, end in found:
        if merged and start <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], end)
        else:
            merged.append({"start": start, "end": end})
    return [{**s, "text": text[s["start"] : s["end"]]} for s in merged]


def numbers(text: str | None) -> list[dict]:
    """Every match of each form: unit, value as written, as a number (null if it is none), and the text around it."""
    out = []
    for unit, form in _FORMS:
        for m in form.finditer(text or ""):
            try:
                value = float(re.sub("[$%,]", "", m[0]))
            except ValueError:
                value = None
            out.append({"unit": unit, "raw": m[0], "value": value, "around": text[max(0, m.start() - AROUND) : m.end() + AROUND]})
    return out


def _listed(df: DataFrame, key: str, inputs: list[str], f, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.struct(fields)))], [key, "found"])

    return df.select(F.col(key).cast("long").alias(key), *inputs).mapInArrow(run, f"{key} long, found array<struct<{schema}>>").select(key, F.inline("found"))


def highlight(df: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """key, start, end, text of each highlighted span; ``terms`` is an array column."""
    return _listed(df, key, [text, terms], spans, [("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())], "start: bigint, end: bigint, text: string")


def numeric_evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit, raw, value, around of each number in each text."""
    return _listed(df, key, [text], numbers, [("unit", pa.string()), ("raw", pa.string()), ("value", pa.float64()), ("around", pa.string())], "unit: string, raw: string, value: double, around: string")
