"""An opt-in cache of a source, held by a handle that knows its size and lets it go."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

_UNITS = {"B": 1, "KiB": 2 ** 10, "MiB": 2 ** 20, "GiB": 2 ** 30, "TiB": 2 ** 40, "PiB": 2 ** 50, "EiB": 2 ** 60}


class CachedSource:
    """``df`` kept by the executors from its first use until ``release``; usable in a ``with`` block.

    A part that is lost with an executor, or that the storage level has no room for, is read from
    the source again, so a cache never decides a result.
    """

    def __init__(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level = level
        self._view = f"cached_{uuid.uuid4().hex}"
        self.df = df.persist(level)
        self.df.createOrReplaceTempView(self._view)

    @property
    def held(self) -> bool:
        return self.df.is_cached

    def fill(self) -> int:
        """Read the source now; the number of its rows."""
        return self.df.count()

    def size_bytes(self) -> int | None:
        """Bytes that the filled cache takes, as the optimizer reports them; None once it is released."""
        if not self.held:
            return None
        plan = self.df.sparkSession.sql(f"EXPLAIN COST SELECT * FROM {self._view}").first()[0]
        number, unit = re.search(r"InMemoryRelation.*?sizeInBytes=([0-9.E+]+) ([KMGTPE]?i?B)", plan, re.S).groups()
        return int(float(number) * _UNITS[unit])

    def release(self) -> None:
        self.df.unpersist(blocking=True)
        self.df.sparkSession.catalog.dropTempView(self._view)

    def __enter__(self) -> DataFrame:
        return self.df

    def __exit__(self, *_) -> None:
        self.release()


def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> CachedSource:
    return CachedSource(df, level)
