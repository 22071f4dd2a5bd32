"""Table sources: Parquet and CSV scans with pandas-like CSV typing."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import NUMBER_PATTERN
from ..functions.text import na_tokens_to_null
from . import csv_scan

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_INT_PATTERN = "^[+-]?[0-9]+$"
_BOOL_TRUE = ("True", "TRUE", "true")
_BOOL_FALSE = ("False", "FALSE", "false")


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               infer: bool = True, ranges: bool = True) -> DataFrame:
    """Read a Parquet table or a headed CSV file/directory.

    CSV columns are read as strings (no ``inferSchema``: it makes ints and
    dates where pandas makes int64 and text), then typed by ``infer_types``.
    Files are read in ranges, also where a quoted cell holds line breaks
    (``csv_scan``).  ``ranges=False`` reads each file in one task, for files
    whose records end in a lone carriage return.
    """
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    header = _raw_header(spark, path)
    if header is None:
        return spark.createDataFrame([], "value string")
    names = pandas_column_names(header)
    if ranges:
        fields = ", ".join(f"c{i} STRING" for i in range(len(names)))
        cells = csv_scan.records(spark, path).select(F.from_csv("record", fields, {**_CSV, "mode": "PERMISSIVE"}).alias("r"))
        raw = cells.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # all-string schema under the pandas-style names; the header line is skipped
        raw = _csv(spark).schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return infer_types(raw) if infer else raw


#: Quotes are doubled inside quoted cells, and a quoted cell may hold line breaks.
_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\u0000never\u0000"}


def _csv(spark: SparkSession):
    return spark.read.options(**_CSV)


def _raw_header(spark: SparkSession, path: str) -> list[str] | None:
    """Header cells exactly as written (Spark renames duplicates/blanks)."""
    first = _csv(spark).option("header", False).csv(path).limit(1).collect()
    if not first:
        return None
    return [v if v is not None else "" for v in first[0]]


def pandas_column_names(header: list[str]) -> list[str]:
    """Blank header -> ``Unnamed: i``; duplicates -> ``a, a.1, a.2``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, h in enumerate(header):
        name = h if h.strip() != "" else f"Unnamed: {i}"
        if name in seen:
            k = seen[name]
            cand = f"{name}.{k}"
            while cand in seen:
                k += 1
                cand = f"{name}.{k}"
            seen[name] = k + 1
            seen[cand] = 1
            name = cand
        else:
            seen[name] = 1
        out.append(name)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Type all-string columns the way pandas' CSV reader would.

    One aggregate counts, per column, the non-missing cells and those that
    parse as integer / number / boolean; a projection then casts.  Dates
    stay text (pandas does not parse them on read).
    """
    cols = df.columns
    cleaned = df.select(*[na_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(_INT_PATTERN)).alias(f"i{i}"),
            F.count_if(v.rlike(NUMBER_PATTERN) | v.rlike("^[+-]?(?i)(inf|infinity)$")).alias(f"d{i}"),
            F.count_if(v.isin(*(_BOOL_TRUE + _BOOL_FALSE))).alias(f"b{i}"),
            F.max(F.length(v)).alias(f"l{i}"),
        ]
    if not aggs:
        return cleaned
    stats = cleaned.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        n, ni, nd, nb = stats[f"n{i}"], stats[f"i{i}"], stats[f"d{i}"], stats[f"b{i}"]
        if n == 0:
            out.append(v.cast("double").alias(c))          # all missing -> float64
        elif ni == n and (stats[f"l{i}"] or 0) <= 18:
            out.append(v.cast("long").alias(c))
        elif nd == n:
            out.append(v.try_cast("double").alias(c))
        elif nb == n:
            out.append(v.isin(*_BOOL_TRUE).alias(c))
        else:
            out.append(v.alias(c))
    return cleaned.select(*out)


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def safe_name(text: str) -> str:
    return re.sub(r"\s+", "_", text.strip())
