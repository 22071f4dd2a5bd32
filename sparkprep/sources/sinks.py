"""Sinks: partitioned CSV / Parquet directories (never one file, never the driver)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from .tables import safe_name


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Headed UTF-8 CSV, one part file per task; no index column; quotes in a cell are doubled, spaces and
    line breaks at its ends stay."""
    (df.write.mode(mode).option("header", True).option("encoding", "UTF-8")
       .option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "\"\"")
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path


def predictions_path(base_dir: str, model_name: str) -> str:
    """Directory named ``predictions_<model name with underscores>``."""
    return os.path.join(base_dir, f"predictions_{safe_name(model_name)}")


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First ``n`` rows, deterministic when ``order_by`` is given (top-k)."""
    if order_by:
        cols = [order_by] if isinstance(order_by, str) else list(order_by)
        return df.orderBy(*cols).limit(n)
    return df.limit(n)
