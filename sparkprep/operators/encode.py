"""Label and one-hot encoding (fit on one frame, apply to any).

A column's mapping is small (a literal in the plan) or wide: then it is a
table in the shared scratch folder, ranked in a distributed way and joined
back, so the number of categories has no limit.  One-hot columns are 0/1
columns, or one sparse vector a column where that is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .order import running_sum

# Up to this many categories a mapping is a literal of the plan; above, a table.
SMALL_MAPPING = 1000
# A mapping table of at most this many rows is broadcast when it is joined.
BROADCAST_CATEGORIES = 100_000


@dataclass
class LabelEncoding:
    """Codes in sorted order per column; null and unseen get the next code."""
    mapping: dict = field(default_factory=dict)      # small columns: categories in code order
    tables: dict = field(default_factory=dict)       # wide columns: (value, code) frame
    sizes: dict = field(default_factory=dict)        # column -> number of categories
    null_as_text: bool = False

    def _value(self, c: str):
        v = F.col(f"`{c}`").cast("string")
        return F.coalesce(v, F.lit("nan")) if self.null_as_text else v

    def apply(self, df: DataFrame) -> DataFrame:
        joined, codes = df, {}
        for i, (c, table) in enumerate(self.tables.items()):
            if c not in df.columns:
                continue
            pair = table.select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__k{i}"))
            if self.sizes[c] <= BROADCAST_CATEGORIES:
                pair = F.broadcast(pair)
            joined = joined.join(pair, self._value(c) == F.col(f"__v{i}"), "left")
            codes[c] = F.coalesce(F.col(f"__k{i}"), F.lit(self.sizes[c]))
        out = []
        for c in df.columns:
            cats = self.mapping.get(c)
            if cats is not None:
                # one map lookup instead of a CASE chain; unseen / null -> extra last code
                m = F.create_map(*[x for i, cat in enumerate(cats) for x in (F.lit(cat), F.lit(i))])
                codes[c] = F.coalesce(F.element_at(m, self._value(c)) if cats else F.lit(None), F.lit(len(cats)))
            out.append(codes[c].cast("int").alias(c) if c in codes else F.col(f"`{c}`"))
        return joined.select(*out)

    def table(self, spark) -> DataFrame:
        rows = [(c, cat, i) for c, cats in self.mapping.items() for i, cat in enumerate(cats)]
        out = spark.createDataFrame(rows, "column string, category string, code int")
        for c, t in self.tables.items():
            out = out.unionByName(t.select(F.lit(c).alias("column"), F.col("value").alias("category"),
                                           F.col("code").cast("int").alias("code")))
        return out


def fit_label_encoding(df: DataFrame, cols, null_as_text: bool = False) -> LabelEncoding:
    """Sorted distinct values per column: one unpivoted distinct, small columns to the driver,
    wide ones ranked by bucketed running counts."""
    cols = [c for c in cols if c in df.columns]
    enc = LabelEncoding(null_as_text=null_as_text)
    if not cols:
        return enc
    vals = df.select(*[enc._value(c).alias(c) for c in cols])
    longv = materialize(vals.unpivot([], [F.col(f"`{c}`") for c in cols], "column", "value")
                        .where(F.col("value").isNotNull()).distinct())
    found = {r["column"]: r["n"] for r in longv.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    enc.sizes = {c: found.get(c, 0) for c in cols}
    small = [c for c in cols if enc.sizes[c] <= SMALL_MAPPING]
    enc.mapping = {c: [] for c in small}
    if small:
        for r in longv.where(F.col("column").isin(small)).orderBy("column", "value").collect():
            enc.mapping[r["column"]].append(r["value"])       # SMALL_MAPPING rows a column at most
    for c in cols:
        if c not in enc.mapping:
            one = longv.where(F.col("column") == c).select("value", F.lit(1).alias("one"))
            enc.tables[c] = materialize(running_sum(one, "one", "value", out="code").select("value", "code"))
    return enc


@dataclass
class OneHotEncoding:
    """0/1 integer columns ``<col>_<value>`` in sorted value order; null -> all zeros.

    With ``sparse`` a column becomes one sparse vector ``<col>_onehot`` instead, whatever the
    number of its values.  The form is asked for, never chosen by the data.
    """
    categories: dict = field(default_factory=dict)
    sparse: LabelEncoding | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        asked = self.categories if self.sparse is None else self.sparse.sizes
        done = [c for c in asked if c in df.columns]
        out, new = df, []
        if self.sparse is not None:
            for c in done:
                out = self._vector(out, c)
            new = [F.col(f"`{c}_onehot`") for c in done]
        else:
            for c in done:
                v = F.col(f"`{c}`").cast("string")
                new += [F.when(v == F.lit(cat), F.lit(1)).otherwise(F.lit(0)).cast("int").alias(f"{c}_{cat}")
                        for cat in self.categories[c]]
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in done], *new)

    def _vector(self, df: DataFrame, c: str) -> DataFrame:
        held = self.sparse
        one = LabelEncoding({c: held.mapping[c]} if c in held.mapping else {},
                            {c: held.tables[c]} if c in held.tables else {}, {c: held.sizes[c]})
        coded = one.apply(df.withColumn("__kept", F.col(f"`{c}`"))).withColumn("__code", F.col(f"`{c}`").cast("double"))
        n = held.sizes[c]
        if not n:                            # no value seen: a vector without a place for any
            return df.withColumn(f"{c}_onehot", array_to_vector(F.array().cast("array<double>")))
        top = df.sparkSession.createDataFrame([(float(n - 1),)], "__code double")
        # the last, invalid, index (null or unseen) is dropped: a vector of zeros
        model = OneHotEncoder(inputCols=["__code"], outputCols=[f"{c}_onehot"], handleInvalid="keep").fit(top)
        return model.transform(coded).withColumn(c, F.col("__kept")).drop("__code", "__kept")

    @property
    def new_columns(self) -> list[str]:
        if self.sparse is not None:
            return [f"{c}_onehot" for c in self.sparse.sizes]
        return [f"{c}_{cat}" for c, cats in self.categories.items() for cat in cats]


def place_of_one(vector: str) -> Column:
    """The place of the one in a sparse one-hot vector, -1 in a vector of zeros; read from the entries it
    holds, so the cost of a row does not grow with the number of places."""
    held = F.unwrap_udt(F.col(f"`{vector}`"))
    return F.when(held.isNotNull(), F.coalesce(F.try_element_at(held["indices"], F.lit(1)), F.lit(-1))).cast("int")


def fit_onehot(df: DataFrame, cols, sparse: bool = False) -> OneHotEncoding:
    """Learn the values of ``cols``.  Without ``sparse`` there is a column for each, so their names come to the driver."""
    enc = fit_label_encoding(df, cols)
    if sparse:
        return OneHotEncoding(sparse=enc)
    names = dict(enc.mapping)
    for c, t in enc.tables.items():
        names[c] = [r["value"] for r in t.orderBy("code").select("value").collect()]
    return OneHotEncoding(categories={c: names[c] for c in enc.sizes})
