"""Named dataset stages (raw, cleaned, engineered) as temp views or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stage preference per task (first present wins).
PREFERENCES = {
    "eda": ("cleaned", "engineered", "raw"),
    "outliers": ("cleaned", "raw"),
    "features": ("cleaned", "raw"),
    "modelling": ("engineered", "cleaned", "raw"),
}


class StageCatalog:
    """Register stages as temp views (or durable Parquet tables) and resolve them."""

    def __init__(self, spark: SparkSession, prefix: str = "stage_", path: str | None = None):
        self.spark = spark
        self.prefix = prefix
        self.path = path
        self._stages: list[str] = []

    def save(self, name: str, df: DataFrame) -> DataFrame:
        view = self.prefix + name
        if self.path:
            target = f"{self.path.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(target)
            df = self.spark.read.parquet(target)
        df.createOrReplaceTempView(view)
        if name not in self._stages:
            self._stages.append(name)
        return df

    def has(self, name: str) -> bool:
        return name in self._stages

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def resolve(self, preference) -> tuple[str, DataFrame]:
        """First present stage of a preference list (or a task name)."""
        order = PREFERENCES.get(preference, preference) if isinstance(preference, str) else preference
        for name in order:
            if self.has(name):
                return name, self.get(name)
        raise KeyError(f"no stage among {list(order)}")

    def names(self) -> list[str]:
        return list(self._stages)
