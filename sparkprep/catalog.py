"""Query catalogue: one Spark query per operator, each with a DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` (DuckDB
SQL over the driver's tables, dirt injected by the same key rules).  Every
query reads whole tables; column names are aliased identically on both
sides.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.constants import CURRENCY_PATTERN, DEFAULT_SENTINELS, NUMBER_PATTERN
from .functions.text import coerce_currency_number, title_case
from .operators import clean, impute, outliers, profile
from .session import ensure_checkpoint_dir
from .sources import dirt
from .sources.tables import read_table, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------- SQL helpers
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[[:space:]]+|[[:space:]]+$', '', 'g')"


def sql_number(x: str) -> str:
    """DuckDB twin of ``to_number`` (same guard regex)."""
    s = sql_strip(x)
    return (f"CASE WHEN regexp_matches({s}, '{NUMBER_PATTERN}') THEN TRY_CAST({s} AS DOUBLE) "
            f"WHEN regexp_matches({s}, '^[+-]?(?i)(inf|infinity)$') THEN "
            f"CASE WHEN starts_with({s}, '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END END")


def sql_coerce(x: str) -> str:
    return sql_number(f"regexp_replace({x}, '{CURRENCY_PATTERN}', '', 'g')")


def sql_title(x: str) -> str:
    """DuckDB twin of ``title_case``: upper after a non-letter, lower otherwise."""
    body = (f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: "
            f"CASE WHEN i = 1 OR NOT regexp_matches(substr({x}, i - 1, 1), '\\p{{L}}') "
            f"THEN upper(substr({x}, i, 1)) ELSE lower(substr({x}, i, 1)) END), '')")
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {sql_strip(body)} END"


SENTINEL_LIST = ", ".join(f"CAST({v} AS DOUBLE)" for v in DEFAULT_SENTINELS)


def V(sql: str, *views: str) -> str:
    return dirt.with_views(sql, *views)


# ============================================================ step 0 / flagship
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coerce currency text, mask sentinels, mode-fill text, cap at IQR, describe."""
    d = dirt.dirty_orders(spark, sf_dir)
    d = clean.convert_columns(d, ["price_txt"])
    d = clean.mask_sentinels(d, ["price_txt", "amt"])
    d, _ = impute.mode_fill(d, ["prio"])
    d, _ = outliers.cap_all(d, ["price_txt", "amt"])
    return profile.describe(d, ["price_txt", "amt"])


def _describe_sql(source: str, cols: list[str], digits: int = 4) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS feature, CAST(count({v}) AS DOUBLE) AS count,
  round(avg({v}), {digits}) AS mean, round(stddev_samp({v}), {digits}) AS std,
  round(min({v}), {digits}) AS min, round(quantile_cont({v}, 0.25), {digits}) AS p25,
  round(quantile_cont({v}, 0.5), {digits}) AS p50, round(quantile_cont({v}, 0.75), {digits}) AS p75,
  round(max({v}), {digits}) AS max,
  round(CASE WHEN stddev_pop({v}) = 0 THEN 0 ELSE skewness({v}) END, {digits}) AS skewness,
  round(CASE WHEN stddev_pop({v}) = 0 THEN 0 ELSE kurtosis({v}) END, {digits}) AS kurtosis
FROM {source}""")
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, CASE WHEN abs(skewness) < 0.5 THEN 'Symmetric'
  WHEN abs(skewness) < 1.0 THEN 'Moderate Skew' WHEN skewness IS NOT NULL THEN 'High Skew' END AS skew_label
FROM ({body}) AS d"""


_FLAGSHIP_SQL = V(f"""
, coerced AS (
  SELECT o_orderkey,
    CASE WHEN c IN ({SENTINEL_LIST}) THEN NULL ELSE c END AS price_txt,
    CASE WHEN amt IN ({SENTINEL_LIST}) THEN NULL ELSE amt END AS amt
  FROM (SELECT o_orderkey, {sql_coerce('price_txt')} AS c, amt FROM dirty_orders) AS x),
q AS (SELECT quantile_cont(price_txt, 0.25) AS p1, quantile_cont(price_txt, 0.75) AS p3,
             quantile_cont(amt, 0.25) AS a1, quantile_cont(amt, 0.75) AS a3 FROM coerced),
capped AS (
  SELECT CASE WHEN price_txt < p1 - 1.5 * (p3 - p1) THEN p1 - 1.5 * (p3 - p1)
              WHEN price_txt > p3 + 1.5 * (p3 - p1) THEN p3 + 1.5 * (p3 - p1) ELSE price_txt END AS price_txt,
         CASE WHEN amt < a1 - 1.5 * (a3 - a1) THEN a1 - 1.5 * (a3 - a1)
              WHEN amt > a3 + 1.5 * (a3 - a1) THEN a3 + 1.5 * (a3 - a1) ELSE amt END AS amt
  FROM coerced, q)
{_describe_sql('capped', ['price_txt', 'amt'])}""", "dirty_orders")
register("flagship_clean_describe", _FLAGSHIP_SQL)(flagship)


# ============================================================ N1-N3, A4
@register("coerce_price", V(f"SELECT o_orderkey, {sql_coerce('price_txt')} AS price FROM dirty_orders",
                            "dirty_orders"))
def q_coerce_price(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return d.select("o_orderkey", coerce_currency_number("price_txt").alias("price"))


def _classify_sql(source: str, cols: list[str]) -> str:
    parts = [f"""SELECT '{c}' AS column_name, count({sql_coerce(c)}) AS parsed, count({c}) AS non_null,
  count(*) AS row_count, greatest(CAST(1 AS DOUBLE), count(*) * CAST(0.10 AS DOUBLE)) AS threshold,
  count({sql_coerce(c)}) >= greatest(CAST(1 AS DOUBLE), count(*) * CAST(0.10 AS DOUBLE)) AS is_dirty FROM {source}""" for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("classify_dirty_numeric", V(_classify_sql("dirty_orders", ["price_txt", "prio"]), "dirty_orders"))
def q_classify(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    fit = clean.classify_dirty_numerics(d)
    rows = [(c, fit.parsed[c], fit.non_null[c], fit.rows, float(fit.threshold), fit.parsed[c] >= fit.threshold)
            for c in fit.parsed]
    return spark.createDataFrame(rows, "column_name string, parsed long, non_null long, row_count long, "
                                       "threshold double, is_dirty boolean")


# ============================================================ N4
@register("title_case_priority", V(f"""
SELECT o_orderkey AS k, 'prio' AS src, {sql_title('prio')} AS titled FROM dirty_orders
UNION ALL SELECT p_partkey, 'p_name', {sql_title('p_name')} FROM part
UNION ALL SELECT p_partkey, 'p_type', {sql_title('p_type')} FROM part""", "dirty_orders"))
def q_title(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    return (d.select(F.col("o_orderkey").alias("k"), F.lit("prio").alias("src"), title_case("prio").alias("titled"))
            .unionByName(p.select(F.col("p_partkey").alias("k"), F.lit("p_name").alias("src"),
                                  title_case("p_name").alias("titled")))
            .unionByName(p.select(F.col("p_partkey").alias("k"), F.lit("p_type").alias("src"),
                                  title_case("p_type").alias("titled"))))


# ============================================================ P9, P10
@register("sentinel_mask", V(f"""
SELECT CASE WHEN CAST(o_orderkey AS DOUBLE) IN ({SENTINEL_LIST}) THEN NULL ELSE o_orderkey END AS o_orderkey,
       CASE WHEN amt IN ({SENTINEL_LIST}) THEN NULL ELSE amt END AS amt
FROM dirty_orders""", "dirty_orders"))
def q_sentinel(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return clean.mask_sentinels(d).select("o_orderkey", "amt")


@register("sentinel_custom", V("""
SELECT o_orderkey, CASE WHEN amt IN (CAST(-5.5 AS DOUBLE)) THEN NULL ELSE amt END AS amt
FROM dirty_orders""", "dirty_orders"))
def q_sentinel_custom(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return clean.mask_sentinels(d, ["amt"], sentinels=[-5.5]).select("o_orderkey", "amt")


@register("sentinel_count", V(f"""
SELECT CAST(count(*) FILTER (WHERE amt IN ({SENTINEL_LIST})) AS BIGINT) AS masked FROM dirty_orders""",
                              "dirty_orders"))
def q_sentinel_count(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return clean.sentinel_count(d, ["o_orderkey", "amt"])


# ============================================================ D1, D2
@register("dedupe_docs", "SELECT DISTINCT text, lang FROM documents")
def q_dedupe_docs(spark, sf_dir):
    return clean.drop_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@register("duplicate_count", V("""
SELECT CAST((SELECT count(*) FROM dup_orders) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders) AS d)
  AS BIGINT) AS duplicates""", "dup_orders"))
def q_duplicate_count(spark, sf_dir):
    return clean.duplicate_count(dirt.dup_orders(spark, sf_dir))


@register("dedupe_orders", V("SELECT DISTINCT * FROM dup_orders", "dup_orders"))
def q_dedupe_orders(spark, sf_dir):
    return clean.drop_duplicates(dirt.dup_orders(spark, sf_dir))


# ============================================================ P5, P6, P12, I6
@register("drop_critical", V("SELECT o_orderkey, price_txt, amt FROM dirty_orders WHERE price_txt IS NOT NULL",
                             "dirty_orders"))
def q_drop_critical(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return clean.drop_on_critical(d, ["price_txt"]).select("o_orderkey", "price_txt", "amt")


@register("complete_rows", V("""
SELECT o_orderkey, price_txt, prio, amt FROM dirty_orders
WHERE o_orderkey IS NOT NULL AND price_txt IS NOT NULL AND prio IS NOT NULL AND amt IS NOT NULL
  AND NOT isnan(amt) AND o_orderdate IS NOT NULL""", "dirty_orders"))
def q_complete_rows(spark, sf_dir):
    return clean.complete_rows(dirt.dirty_orders(spark, sf_dir)).select("o_orderkey", "price_txt", "prio", "amt")


@register("missing_cells", V("""
SELECT CAST(count(*) FILTER (WHERE price_txt IS NULL) + count(*) FILTER (WHERE prio IS NULL)
  + count(*) FILTER (WHERE amt IS NULL OR isnan(amt)) + count(*) FILTER (WHERE o_orderkey IS NULL)
  + count(*) FILTER (WHERE o_orderdate IS NULL) AS BIGINT) AS missing FROM dirty_orders""", "dirty_orders"))
def q_missing(spark, sf_dir):
    return clean.missing_cells(dirt.dirty_orders(spark, sf_dir))


# ============================================================ I4, I5, N11
def _mode_sql(source: str, col: str) -> str:
    return (f"(SELECT v FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS c FROM {source} "
            f"WHERE {col} IS NOT NULL GROUP BY 1) AS m ORDER BY c DESC, v ASC LIMIT 1)")


@register("mode_fill", V(f"""
SELECT o_orderkey, coalesce(price_txt, {_mode_sql('dirty_orders', 'price_txt')}) AS price_txt,
       coalesce(prio, {_mode_sql('dirty_orders', 'prio')}) AS prio
FROM dirty_orders""", "dirty_orders"))
def q_mode_fill(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    filled, _ = impute.mode_fill(d, ["price_txt", "prio"])
    return filled.select("o_orderkey", "price_txt", "prio")


@register("mode_values", V(f"""
SELECT 'price_txt' AS column_name, {_mode_sql('dirty_orders', 'price_txt')} AS mode
UNION ALL SELECT 'prio', {_mode_sql('dirty_orders', 'prio')}""", "dirty_orders"))
def q_mode_values(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir)
    return impute.modes(d, ["price_txt", "prio"]).withColumnRenamed("column", "column_name")


@register("median_fill", V("""
SELECT p_partkey,
  coalesce(CAST(p_size AS DOUBLE), (SELECT quantile_cont(p_size, 0.5) FROM gappy_part)) AS p_size,
  coalesce(p_retailprice, (SELECT quantile_cont(p_retailprice, 0.5) FROM gappy_part)) AS p_retailprice
FROM gappy_part""", "gappy_part"))
def q_median_fill(spark, sf_dir):
    p = dirt.gappy_part(spark, sf_dir)
    filled, _ = impute.median_fill(p, ["p_size", "p_retailprice"])
    return filled.select("p_partkey", "p_size", "p_retailprice")


# ============================================================ I2, I3 (T14)
def _fill_sql(direction: str, by_user: bool) -> str:
    part = "PARTITION BY user_id " if by_user else ""
    if direction == "forward":
        fn, frame = "last_value", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    else:
        fn, frame = "first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return V(f"""SELECT event_id, user_id, event_type,
  {fn}(value IGNORE NULLS) OVER ({part}ORDER BY event_id {frame}) AS value FROM gappy_events""",
             "gappy_events")


def _fill_query(direction: str, by_user: bool):
    def run(spark, sf_dir):
        e = dirt.gappy_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
        groups = ["user_id"] if by_user else []
        fn = impute.ffill if direction == "forward" else impute.bfill
        return fn(e, "event_id", groups)
    return run


for _d, _n in (("forward", "ffill"), ("backward", "bfill")):
    register(f"{_n}_events", _fill_sql(_d, False))(_fill_query(_d, False))
    register(f"{_n}_events_by_user", _fill_sql(_d, True))(_fill_query(_d, True))


# ============================================================ N6
def _temporal_input(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.when(k % 10 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d_iso"),
        F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
         .otherwise(F.lit("pending")).alias("d_mixed"),
        F.col("o_orderpriority").alias("prio"),
        F.col("o_custkey").cast("string").alias("num"))


_TEMPORAL_INPUT_SQL = """temporal_in AS (SELECT
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_iso,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'pending' END AS d_mixed,
  o_orderpriority AS prio, CAST(o_custkey AS VARCHAR) AS num FROM orders)"""


def _temporal_sql() -> str:
    fmts = [f[1] for f in impute.DATE_FORMATS]
    sparks = [f[0] for f in impute.DATE_FORMATS]
    cols = ["d_iso", "d_mixed", "prio", "num"]
    longv = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM temporal_in WHERE {c} IS NOT NULL"
                               for c in cols)
    sums = ", ".join(f"sum(CASE WHEN try_strptime(value, '{f}') IS NOT NULL THEN 1 ELSE 0 END) AS f{i}"
                     for i, f in enumerate(fmts))
    best = "greatest(" + ", ".join(f"f{i}" for i in range(len(fmts))) + ")"
    quoted = [s.replace("'", "''") for s in sparks]
    pick = "CASE " + " ".join(f"WHEN f{i} = {best} THEN '{s}'" for i, s in enumerate(quoted)) + " END"
    return f"""WITH {_TEMPORAL_INPUT_SQL}, longv AS ({longv}),
agg AS (SELECT column_name, count(*) AS sampled, {sums} FROM longv GROUP BY column_name)
SELECT column_name, CAST(sampled AS BIGINT) AS sampled, CAST({best} AS DOUBLE) / sampled AS best_ratio,
  CASE WHEN {best} > 0 THEN {pick} END AS best_format,
  CAST({best} AS DOUBLE) / sampled >= 0.8 AS is_temporal FROM agg"""


@register("temporal_detect", _temporal_sql())
def q_temporal(spark, sf_dir):
    s = impute.temporal_scores(_temporal_input(spark, sf_dir))
    return s.select(F.col("column").alias("column_name"), "sampled", "best_ratio", "best_format",
                    (F.col("best_ratio") >= 0.8).alias("is_temporal"))


register("temporal_scores_full", _temporal_sql())(q_temporal)


# ============================================================ O1-O7
_Q_AMT = "(SELECT quantile_cont(amt, 0.25) AS q1, quantile_cont(amt, 0.75) AS q3 FROM dirty_orders) AS q"
_IQR_FLAG = "coalesce(amt < q1 - 1.5 * (q3 - q1) OR amt > q3 + 1.5 * (q3 - q1), false)"


@register("iqr_flags", V(f"SELECT o_orderkey, amt, {_IQR_FLAG} AS is_outlier FROM dirty_orders, {_Q_AMT}",
                         "dirty_orders"))
def q_iqr_flags(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return outliers.iqr_flags(d, "amt")


@register("zscore_flags", V("""
SELECT o_orderkey, amt, coalesce(abs((amt - m) / s) > 3.0, false) AS is_outlier
FROM dirty_orders, (SELECT avg(amt) AS m, stddev_pop(amt) AS s FROM dirty_orders) AS z""", "dirty_orders"))
def q_zscore_flags(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return outliers.zscore_flags(d, "amt", 3.0)


@register("zscore_flags_lineitem", """
SELECT l_orderkey, l_linenumber, coalesce(abs((l_extendedprice - m) / s) > 2.0, false) AS is_outlier
FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) AS z""")
def q_zscore_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return outliers.zscore_flags(li, "l_extendedprice", 2.0).drop("l_extendedprice")


@register("cap_iqr", V(f"""
SELECT o_orderkey, CASE WHEN amt < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
  WHEN amt > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE amt END AS amt
FROM dirty_orders, {_Q_AMT}""", "dirty_orders"))
def q_cap_iqr(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return outliers.cap_iqr(d, "amt")


@register("drop_outliers", V(f"SELECT o_orderkey, amt FROM dirty_orders, {_Q_AMT} WHERE NOT {_IQR_FLAG}",
                             "dirty_orders"))
def q_drop_outliers(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return outliers.drop_outliers(outliers.iqr_flags(d, "amt"), "is_outlier").drop("is_outlier")


@register("outlier_summary", V(f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {_IQR_FLAG}) AS BIGINT) AS outliers,
  round(count(*) FILTER (WHERE {_IQR_FLAG}) * 100.0 / count(*), 2) AS pct
FROM dirty_orders, {_Q_AMT}""", "dirty_orders"))
def q_outlier_summary(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return outliers.outlier_summary(outliers.iqr_flags(d, "amt"), "is_outlier")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax"]


def _cap_sql(cols, source, keep=()):
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in cols)
    exprs = []
    for c in cols:
        lo, hi = f"({c}_q1 - 1.5 * ({c}_q3 - {c}_q1))", f"({c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"
        exprs.append(f"CAST(CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE {c} END AS DOUBLE) AS {c}")
    return f"SELECT {', '.join(list(keep) + exprs)} FROM {source}, (SELECT {qs} FROM {source}) AS q"


@register("cap_all", _cap_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem",
                              ["l_orderkey AS k", "l_linenumber AS n"]))
def q_cap_all(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    capped, _ = outliers.cap_all(li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *cols),
                                 cols)
    return capped.select("k", "n", *[F.col(c).cast("double").alias(c) for c in cols])


# ============================================================ E1, E2
def _profile_sql(source: str, cols: list[tuple[str, str, bool]]) -> str:
    parts = []
    for c, dtype, flt in cols:
        v = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if flt else c
        parts.append(f"""SELECT '{c}' AS feature, '{dtype}' AS dtype,
  CAST(count(*) - count({v}) AS BIGINT) AS null_count,
  round((count(*) - count({v})) * 100.0 / count(*), 2) AS null_pct,
  CAST(count(DISTINCT {v}) AS BIGINT) AS unique_count,
  coalesce(CAST(min({v}) AS VARCHAR), 'N/A') AS sample_value FROM {source}""")
    return "\nUNION ALL\n".join(parts)


@register("profile_orders", V(_profile_sql("dirty_orders", [
    ("o_orderkey", "int64", False), ("price_txt", "object", False), ("prio", "object", False),
    ("amt", "float64", True), ("o_orderdate", "datetime64[ns]", False)]), "dirty_orders"))
def q_profile_orders(spark, sf_dir):
    return profile.profile(dirt.dirty_orders(spark, sf_dir))


@register("overview_orders", V("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns,
  CAST(count(*) FILTER (WHERE price_txt IS NULL) + count(*) FILTER (WHERE prio IS NULL)
   + count(*) FILTER (WHERE amt IS NULL OR isnan(amt)) + count(*) FILTER (WHERE o_orderkey IS NULL)
   + count(*) FILTER (WHERE o_orderdate IS NULL) AS BIGINT) AS missing,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders) AS x) AS BIGINT) AS duplicates
FROM dirty_orders""", "dirty_orders"))
def q_overview(spark, sf_dir):
    return profile.overview(dirt.dirty_orders(spark, sf_dir))


# ============================================================ E3-E5, N10
@register("describe_lineitem", _describe_sql("lineitem", _LI_NUM))
def q_describe_lineitem(spark, sf_dir):
    return profile.describe(table(spark, sf_dir, "lineitem"), _LI_NUM)


@register("describe_dirty_amt", V(_describe_sql("dirty_orders", ["amt"]), "dirty_orders"))
def q_describe_amt(spark, sf_dir):
    return profile.describe(dirt.dirty_orders(spark, sf_dir), ["amt"])


# ============================================================ E10, E11, O7
def _hist_sql(source: str, col: str, stage: str) -> str:
    return f"""SELECT CAST(bin AS INTEGER) AS bin, mn + bin * ((mx - mn) / 40) AS lo,
  mn + (bin + 1) * ((mx - mn) / 40) AS hi, CAST(count(*) AS BIGINT) AS count, '{stage}' AS stage
FROM (SELECT CASE WHEN mx = mn THEN 0 ELSE CAST(least(floor(({col} - mn) / (mx - mn) * 40), 39) AS INTEGER) END
        AS bin, mn, mx
      FROM {source}, (SELECT min({col}) AS mn, max({col}) AS mx FROM {source}) AS b
      WHERE {col} IS NOT NULL) AS h
GROUP BY bin, mn, mx"""


@register("hist_before_after", V(f"""
, capped AS (SELECT CASE WHEN amt < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
  WHEN amt > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE amt END AS amt FROM dirty_orders, {_Q_AMT})
{_hist_sql('dirty_orders', 'amt', 'before')}
UNION ALL
{_hist_sql('capped', 'amt', 'after')}""", "dirty_orders"))
def q_hist(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("amt")
    before = profile.histogram(d, "amt", stage="before")
    after = profile.histogram(outliers.cap_iqr(d, "amt"), "amt", stage="after")
    return before.unionByName(after)


def _extreme_hist_sql() -> str:
    return V(f"""
, e AS (SELECT amt FROM extreme_orders),
capped AS (SELECT CASE WHEN amt < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
  WHEN amt > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE amt END AS amt FROM e,
  (SELECT quantile_cont(amt, 0.25) AS q1, quantile_cont(amt, 0.75) AS q3 FROM e) AS q)
{_hist_sql('e', 'amt', 'before')}
UNION ALL
{_hist_sql('capped', 'amt', 'after')}""", "extreme_orders")


@register("hist_before_after_extreme", _extreme_hist_sql())
def q_hist_extreme(spark, sf_dir):
    d = dirt.extreme_orders(spark, sf_dir).select("amt")
    after = profile.histogram(outliers.cap_iqr(d, "amt"), "amt", stage="after")
    return profile.histogram(d, "amt", stage="before").unionByName(after)


@register("histogram_totalprice", _hist_sql("orders", "o_totalprice", "raw"))
def q_hist_price(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice", stage="raw")


def _box_sql(source, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, q1, med AS median, q3, q3 - q1 AS iqr,
  q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
  max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source}) AS t,
     (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3
      FROM {source}) AS q
GROUP BY q1, med, q3""")
    return "\nUNION ALL\n".join(parts)


@register("box_stats", V(_box_sql("dirty_orders", ["amt"]) + "\nUNION ALL\n" + _box_sql("orders", ["o_totalprice"]),
                         "dirty_orders"))
def q_box(spark, sf_dir):
    return (profile.box_stats(dirt.dirty_orders(spark, sf_dir), ["amt"])
            .unionByName(profile.box_stats(table(spark, sf_dir, "orders"), ["o_totalprice"])))


@register("box_outliers", V(f"SELECT o_orderkey, amt FROM dirty_orders, {_Q_AMT} WHERE {_IQR_FLAG}",
                            "dirty_orders"))
def q_box_outliers(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "amt")
    return profile.box_outliers(d, "amt")


# ============================================================ E19, E20
@register("class_distribution", V("""
SELECT prio AS class, CAST(count(*) AS BIGINT) AS count,
  round(count(*) * 100.0 / (SELECT count(*) FROM dirty_orders), 2) AS pct
FROM dirty_orders WHERE prio IS NOT NULL GROUP BY prio""", "dirty_orders"))
def q_class_distribution(spark, sf_dir):
    return profile.class_distribution(dirt.dirty_orders(spark, sf_dir), "prio")


@register("train_stats", V("""
SELECT CAST(count(*) AS BIGINT) AS total_rows,
  CAST(count(*) FILTER (WHERE o_orderkey IS NOT NULL AND price_txt IS NOT NULL AND prio IS NOT NULL
    AND amt IS NOT NULL AND NOT isnan(amt) AND o_orderdate IS NOT NULL) AS BIGINT) AS complete_rows,
  CAST(4 AS BIGINT) AS features, CAST(count(DISTINCT prio) AS BIGINT) AS target_distinct
FROM dirty_orders""", "dirty_orders"))
def q_train_stats(spark, sf_dir):
    return profile.train_stats(dirt.dirty_orders(spark, sf_dir), "prio")


# ============================================================ E6-E9, E12
from .operators import correlate  # noqa: E402


def _corr_sql(source: str, cols: list[str], ranked: bool = False) -> str:
    if ranked:
        rcols = ", ".join(
            f"(rank() OVER (ORDER BY {c}) + rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
            f" AS {c}" for c in cols)
        source = f"(SELECT {rcols} FROM {source}) AS rk"
    parts = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS idx_a, {j} AS idx_b,
  CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n,
  round(CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL
        ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 4) AS r FROM {source}""")
    return "\nUNION ALL\n".join(parts)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("corr_pearson", _corr_sql("lineitem", _CORR_COLS))
def q_corr_pearson(spark, sf_dir):
    c = correlate.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS, "pearson")
    return c.select("col_a", "col_b", "idx_a", "idx_b", "n", "r")


@register("corr_spearman", _corr_sql("lineitem", _CORR_COLS, ranked=True))
def q_corr_spearman(spark, sf_dir):
    c = correlate.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS, "spearman")
    return c.select("col_a", "col_b", "idx_a", "idx_b", "n", "r")


def _gappy_lineitem_sql() -> str:
    return """g AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_orderkey % 7 < 2 THEN NULL ELSE l_extendedprice END AS b, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS c,
  l_tax AS d, CAST(l_suppkey AS DOUBLE) AS e FROM lineitem)"""


def _gappy_lineitem(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    return li.select(F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("a"),
                     F.when(F.col("l_orderkey") % 7 < 2, nan).otherwise(F.col("l_extendedprice")).alias("b"),
                     F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount")).alias("c"), F.col("l_tax").alias("d"),
                     F.col("l_suppkey").cast("double").alias("e"))


def _corr_gaps_sql() -> str:
    """Each pair ranked by itself on its complete rows."""
    names, parts = "abcde", []
    for i, x in enumerate(names):
        for j in range(i + 1, len(names)):
            y = names[j]
            parts.append(f"""SELECT '{x}' AS col_a, '{y}' AS col_b, count(*) AS n, round(corr(rx, ry), 4) AS r FROM (
  SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry FROM g WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS x""")
    return f"WITH {_gappy_lineitem_sql()}\n" + "\nUNION ALL\n".join(parts)


@register("corr_spearman_gaps", _corr_gaps_sql())
def q_corr_spearman_gaps(spark, sf_dir):
    return correlate.correlations(_gappy_lineitem(spark, sf_dir), method="spearman").select("col_a", "col_b", "n", "r")


def _pvalue_sql(panels: int = 200_000) -> str:
    """Two-sided p of t by midpoints: with t = sqrt(df) tan(x) the density goes with cos(x) ** (df - 1)."""
    return f"""
WITH c AS ({_corr_sql('lineitem', _CORR_COLS).replace(', 4) AS r FROM', ', 15) AS r FROM')}),
t AS (SELECT *, n - 2 AS df, CASE WHEN abs(r) < 1 THEN abs(r) * sqrt((n - 2) / (1 - r * r)) END AS t FROM c),
x AS (SELECT *, atan(t / sqrt(df)) AS low, least(pi() / 2, 40 / sqrt(df)) AS reach FROM t),
m AS (SELECT col_a, col_b, sum(CASE WHEN low + reach * (i + 0.5) / {panels} < pi() / 2
        THEN exp((df - 1) * ln(cos(low + reach * (i + 0.5) / {panels}))) ELSE 0 END) AS tail,
      sum(CASE WHEN reach * (i + 0.5) / {panels} < pi() / 2 THEN exp((df - 1) * ln(cos(reach * (i + 0.5) / {panels}))) ELSE 0 END) AS whole
      FROM x, (SELECT unnest(range({panels})) AS i) AS p GROUP BY col_a, col_b)
SELECT t.col_a, t.col_b, t.idx_a, t.idx_b, t.n, round(t.r, 4) AS r, round(tail / whole, 4) AS p FROM t JOIN m USING (col_a, col_b)"""


@register("corr_pvalues", _pvalue_sql())
def q_corr_pvalues(spark, sf_dir):
    return correlate.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS, "pearson").drop("t")


@register("significant_pairs", f"SELECT * FROM ({_pvalue_sql()}) AS s WHERE idx_a < idx_b AND p < 0.05")
def q_significant(spark, sf_dir):
    corr = correlate.correlations(table(spark, sf_dir, "lineitem"), _CORR_COLS, "pearson")
    return correlate.significant_pairs(corr).drop("t")


@register("ols_by_group", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag""")
def q_ols(spark, sf_dir):
    o = correlate.ols_by_group(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return o.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], "n")


# ============================================================ I1, J1, M8, M14, M3
from .operators import neighbors, split  # noqa: E402


def _sql_hash(key: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 6)) AS BIGINT)"


@register("scatter_bins", """
WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
SELECT l_returnflag, CAST(least(floor((l_quantity - x0) / (x1 - x0) * 50), 49) AS INTEGER) AS x_bin,
  CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 50), 49) AS INTEGER) AS y_bin, count(*) AS n
FROM lineitem, e GROUP BY ALL""")
def q_scatter_bins(spark, sf_dir):
    return correlate.scatter_bins(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@register("scatter_sample", """
SELECT o_orderstatus, o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS rn
  FROM orders) AS x WHERE rn <= 200""")
def q_scatter_sample(spark, sf_dir):
    return correlate.scatter_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


_KNN_IMPUTE_SQL = V("""
, base AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS f1, CAST(p_size AS DOUBLE) AS f2,
                  CAST(p_retailprice AS DOUBLE) AS f3 FROM gappy_part),
r AS (SELECT * FROM base WHERE f2 IS NULL OR f3 IS NULL),
pairs AS (
  SELECT r.p_partkey AS rk, d.p_partkey AS dk, r.f2 IS NULL AS need2, r.f3 IS NULL AS need3,
    d.f2 AS v2, d.f3 AS v3,
    sqrt(3.0 / (1 + CAST(r.f2 IS NOT NULL AND d.f2 IS NOT NULL AS INT) + CAST(r.f3 IS NOT NULL AND d.f3 IS NOT NULL AS INT))
      * ((r.f1 - d.f1) * (r.f1 - d.f1)
         + CASE WHEN r.f2 IS NOT NULL AND d.f2 IS NOT NULL THEN (r.f2 - d.f2) * (r.f2 - d.f2) ELSE 0 END
         + CASE WHEN r.f3 IS NOT NULL AND d.f3 IS NOT NULL THEN (r.f3 - d.f3) * (r.f3 - d.f3) ELSE 0 END)) AS dist
  FROM r, base AS d),
t2 AS (SELECT rk, dist, v2 AS v FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY dist, dk) AS rn
       FROM pairs WHERE need2 AND v2 IS NOT NULL) AS x WHERE rn <= 5),
t3 AS (SELECT rk, dist, v3 AS v FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY dist, dk) AS rn
       FROM pairs WHERE need3 AND v3 IS NOT NULL) AS x WHERE rn <= 5),
f2 AS (SELECT rk, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(v) FILTER (WHERE dist = 0)
                  ELSE sum(v / dist) / sum(1.0 / dist) END AS fill FROM t2 GROUP BY rk),
f3 AS (SELECT rk, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(v) FILTER (WHERE dist = 0)
                  ELSE sum(v / dist) / sum(1.0 / dist) END AS fill FROM t3 GROUP BY rk)
SELECT b.p_partkey, round(coalesce(b.f2, f2.fill), 6) AS p_size, round(coalesce(b.f3, f3.fill), 6) AS p_retailprice
FROM base AS b LEFT JOIN f2 ON f2.rk = b.p_partkey LEFT JOIN f3 ON f3.rk = b.p_partkey""", "gappy_part")


@register("knn_impute_part", _KNN_IMPUTE_SQL)
def q_knn_impute(spark, sf_dir):
    p = dirt.gappy_part(spark, sf_dir).select("p_partkey", "p_size", "p_retailprice")
    out = neighbors.knn_impute(p, "p_partkey", ["p_partkey", "p_size", "p_retailprice"], k=5)
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"),
                      F.round("p_retailprice", 6).alias("p_retailprice"))


def _knn_model_sql(mode: str) -> str:
    test = f"{_sql_hash('vec_id')} < {int(16777216 * 0.2)}"
    top = f"""WITH tr AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings WHERE NOT ({test})),
te AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {test}),
top AS (SELECT * FROM (SELECT te.vec_id, tr.vec_id AS rk, tr.label,
          row_number() OVER (PARTITION BY te.vec_id ORDER BY list_distance(te.x, tr.x), tr.vec_id) AS rn
        FROM te, tr) AS p WHERE rn <= 5)"""
    if mode == "regress":
        return top + "\nSELECT vec_id, round(avg(label), 6) AS prediction FROM top GROUP BY vec_id"
    return top + """,
votes AS (SELECT vec_id, label, count(*) AS v FROM top GROUP BY vec_id, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, label) AS r,
                  sum(v) OVER (PARTITION BY vec_id) AS tot FROM votes)
SELECT vec_id, label AS prediction, round(v * 1.0 / tot, 6) AS confidence FROM ranked WHERE r = 1"""


@register("knn_classify", _knn_model_sql("classify"))
def q_knn_classify(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    train, test = split.hash_split(e, "vec_id", 0.2, 42)
    out = neighbors.knn_predict(train, test, "vec_id", "embedding", "label", 5, "classify")
    return out.select("vec_id", "prediction", F.round("confidence", 6).alias("confidence"))


@register("knn_regress", _knn_model_sql("regress"))
def q_knn_regress(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    train, test = split.hash_split(e, "vec_id", 0.2, 42)
    out = neighbors.knn_predict(train, test, "vec_id", "embedding", "label", 5, "regress")
    return out.select("vec_id", F.round("prediction", 6).alias("prediction"))


@register("split_hash", f"""
SELECT o_orderkey, {_sql_hash('o_orderkey')} < {int(16777216 * 0.2)} AS is_test FROM orders""")
def q_split_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.select("o_orderkey", (split.hash_unit("o_orderkey", 42) < int(16777216 * 0.2)).alias("is_test"))


@register("split_stratified", f"""
SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_sql_hash('o_orderkey')}, o_orderkey)
    <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS is_test FROM orders""")
def q_split_stratified(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    train, test = split.stratified_split(o, "o_orderkey", "o_orderpriority", 0.2, 42)
    return (train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))))


# ============================================================ F1-F6
from .operators import encode, pca, scale  # noqa: E402
from .plans.features import FeatureEncoder, FeaturePlan  # noqa: E402


_WIDE_SQL = "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY concat(p_name, ' ', p_partkey)) - 1 AS INTEGER) AS {0} FROM part"


def _wide_names(spark, sf_dir) -> DataFrame:
    """A text column with more categories than a plan can hold as literals."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"))


@register("label_encode_wide", _WIDE_SQL.format("name"))
def q_label_encode_wide(spark, sf_dir):
    d = _wide_names(spark, sf_dir)
    return encode.fit_label_encoding(d, ["name"]).apply(d)


@register("onehot_wide", _WIDE_SQL.format("place"))
def q_onehot_wide(spark, sf_dir):
    """The place of the one in each sparse vector."""
    d = _wide_names(spark, sf_dir)
    hot = encode.fit_onehot(d, ["name"], sparse=True).apply(d)
    return hot.select("p_partkey", encode.place_of_one("name_onehot").alias("place"))


@register("label_encode", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""")
def q_label_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.fit_label_encoding(o, ["o_orderstatus", "o_orderpriority"]).apply(o)


@register("label_encode_nulls", V("""
SELECT o_orderkey, CASE WHEN prio IS NULL THEN (SELECT count(DISTINCT prio) FROM dirty_orders)
  ELSE dense_rank() OVER (PARTITION BY prio IS NULL ORDER BY prio) - 1 END AS prio FROM dirty_orders""",
                                  "dirty_orders"))
def q_label_encode_nulls(spark, sf_dir):
    d = dirt.dirty_orders(spark, sf_dir).select("o_orderkey", "prio")
    return encode.fit_label_encoding(d, ["prio"]).apply(d).withColumn("prio", F.col("prio").cast("long"))


@register("label_mapping", """
SELECT 'o_orderstatus' AS column_name, v AS category, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) AS a
UNION ALL
SELECT 'o_orderpriority', v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER)
FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) AS b""")
def q_label_mapping(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    enc = encode.fit_label_encoding(o, ["o_orderstatus", "o_orderpriority"])
    return enc.table(spark).withColumnRenamed("column", "column_name")


@register("onehot", """
SELECT o_orderkey, o_totalprice,
  CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O,
  CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def q_onehot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return encode.fit_onehot(o, ["o_orderstatus"]).apply(o)


_SC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(kind: str) -> str:
    if kind == "minmax":
        stats = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in _SC_COLS)
        exprs = ", ".join(f"round(CASE WHEN b_{c} = a_{c} THEN 0.0 ELSE ({c} - a_{c}) / (b_{c} - a_{c}) END, 6) AS {c}"
                          for c in _SC_COLS)
    else:
        stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS b_{c}" for c in _SC_COLS)
        exprs = ", ".join(f"round(CASE WHEN b_{c} = 0 THEN 0.0 ELSE ({c} - a_{c}) / b_{c} END, 6) AS {c}"
                          for c in _SC_COLS)
    return f"SELECT l_orderkey AS k, l_linenumber AS n, {exprs} FROM lineitem, (SELECT {stats} FROM lineitem) AS s"


def _scale_query(kind: str):
    def run(spark, sf_dir):
        li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"),
                                                     F.col("l_linenumber").alias("n"), *_SC_COLS)
        out = scale.fit_scaler(li, kind, _SC_COLS).apply(li)
        return out.select("k", "n", *[F.round(c, 6).alias(c) for c in _SC_COLS])
    return run


register("minmax_scale", _scale_sql("minmax"))(_scale_query("minmax"))
register("standard_scale", _scale_sql("standard"))(_scale_query("standard"))


@register("feature_plan", """
WITH enc AS (
  SELECT o_orderkey, o_totalprice,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority,
    CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS DOUBLE) AS o_orderstatus_F,
    CAST(CAST(o_orderstatus = 'O' AS INTEGER) AS DOUBLE) AS o_orderstatus_O,
    CAST(CAST(o_orderstatus = 'P' AS INTEGER) AS DOUBLE) AS o_orderstatus_P FROM orders),
s AS (SELECT min(o_totalprice) AS a1, max(o_totalprice) AS b1, min(o_orderpriority) AS a2, max(o_orderpriority) AS b2,
  min(o_orderstatus_F) AS a3, max(o_orderstatus_F) AS b3, min(o_orderstatus_O) AS a4, max(o_orderstatus_O) AS b4,
  min(o_orderstatus_P) AS a5, max(o_orderstatus_P) AS b5 FROM enc)
SELECT o_orderkey,
  round(CASE WHEN b1 = a1 THEN 0.0 ELSE (o_totalprice - a1) / (b1 - a1) END, 6) AS o_totalprice,
  round(CASE WHEN b2 = a2 THEN 0.0 ELSE (o_orderpriority - a2) / (b2 - a2) END, 6) AS o_orderpriority,
  round(CASE WHEN b3 = a3 THEN 0.0 ELSE (o_orderstatus_F - a3) / (b3 - a3) END, 6) AS o_orderstatus_F,
  round(CASE WHEN b4 = a4 THEN 0.0 ELSE (o_orderstatus_O - a4) / (b4 - a4) END, 6) AS o_orderstatus_O,
  round(CASE WHEN b5 = a5 THEN 0.0 ELSE (o_orderstatus_P - a5) / (b5 - a5) END, 6) AS o_orderstatus_P
FROM enc, s""")
def q_feature_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    plan = FeaturePlan(label_cols=["o_orderpriority"], onehot_cols=["o_orderstatus"], scaler="minmax",
                       exclude=["o_orderkey"]).fit(o)
    out = plan.apply(o)
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in out.columns if c != "o_orderkey"])


@register("feature_encoder", f"""
WITH d AS (SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus,
    {_sql_hash('o_orderkey')} < {int(16777216 * 0.2)} AS is_test FROM orders),
p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
      FROM (SELECT DISTINCT o_orderpriority FROM d WHERE NOT is_test) AS x),
s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS place
      FROM (SELECT DISTINCT o_orderstatus FROM d WHERE NOT is_test) AS x),
e AS (SELECT d.*, CAST(coalesce(code, (SELECT count(*) FROM p)) AS DOUBLE) AS c FROM d LEFT JOIN p USING (o_orderpriority)),
m AS (SELECT avg(o_totalprice) AS a1, stddev_pop(o_totalprice) AS b1, avg(c) AS a2, stddev_pop(c) AS b2 FROM e WHERE NOT is_test)
SELECT o_orderkey, round(CASE WHEN b1 = 0 THEN 0.0 ELSE (o_totalprice - a1) / b1 END, 6) AS o_totalprice,
  round(CASE WHEN b2 = 0 THEN 0.0 ELSE (c - a2) / b2 END, 6) AS o_orderpriority, CAST(place AS INTEGER) AS status_place,
  CAST(2 + (SELECT count(*) FROM s) AS INTEGER) AS width
FROM e LEFT JOIN s USING (o_orderstatus), m WHERE is_test""")
def q_feature_encoder(spark, sf_dir):
    """Codes, a sparse one-hot vector and scaling, fitted in a pipeline on the training rows, saved, loaded, applied
    to the test rows."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.functions import vector_to_array

    from .operators.split import hash_split
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    train, test = hash_split(o, "o_orderkey", 0.2)
    encoder = FeatureEncoder(labelCols=["o_orderpriority"], oneHotCols=["o_orderstatus"], sparse=True, scaler="standard",
                             excludeCols=["o_orderkey"], outputCol="features")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/feature_encoder_{uuid.uuid4().hex}"
    Pipeline(stages=[encoder]).fit(train).write().save(path)
    out = PipelineModel.load(path).transform(test)
    x = vector_to_array("features")
    return out.select("o_orderkey", F.round(x[0], 6).alias("o_totalprice"), F.round(x[1], 6).alias("o_orderpriority"),
                      (F.array_position(F.slice(x, 3, F.size(x)), F.lit(1.0)) - 1).cast("int").alias("status_place"),
                      F.size(x).alias("width"))


# ============================================================ E13-E18
_PCA_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("pca_evr")
def q_pca_evr(spark, sf_dir):
    return pca.run_pca(table(spark, sf_dir, "lineitem"), 3, _PCA_COLS).evr_frame(spark)


@register("pca_loadings")
def q_pca_loadings(spark, sf_dir):
    return pca.run_pca(table(spark, sf_dir, "lineitem"), 3, _PCA_COLS).loadings_frame(spark)


@register("pca_summary")
def q_pca_summary(spark, sf_dir):
    return pca.run_pca(table(spark, sf_dir, "lineitem"), 3, _PCA_COLS).summary_frame(spark)


@register("pca_scores")
def q_pca_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    res = pca.run_pca(li, 3, _PCA_COLS)
    return res.scores(li, keep=["l_orderkey", "l_linenumber", "l_returnflag"])


# ============================================================ M1, M19-M23, M28
from .operators import metrics  # noqa: E402


@register("detect_problem", """
SELECT 'o_orderstatus' AS target, 'classification' AS problem
UNION ALL SELECT 'o_custkey', CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders) <= 20 THEN 'classification' ELSE 'regression' END
UNION ALL SELECT 'l_linenumber', CASE WHEN (SELECT count(DISTINCT l_linenumber) FROM lineitem) <= 20 THEN 'classification' ELSE 'regression' END
UNION ALL SELECT 'l_quantity', CASE WHEN (SELECT count(DISTINCT l_quantity) FROM lineitem) <= 20 THEN 'classification' ELSE 'regression' END
UNION ALL SELECT 'l_discount', CASE WHEN (SELECT count(DISTINCT l_discount) FROM lineitem) <= 20 THEN 'classification' ELSE 'regression' END""")
def q_detect_problem(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = [(t, split.detect_problem_type(df, t)) for df, t in
            ((o, "o_orderstatus"), (o, "o_custkey"), (li, "l_linenumber"), (li, "l_quantity"), (li, "l_discount"))]
    return spark.createDataFrame(rows, "target string, problem string")


def _rule_binary(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderstatus") == "F").cast("int").alias("actual"),
                    (F.col("o_totalprice") > 250000).cast("int").alias("predicted"),
                    F.col("o_totalprice").alias("score"))


_RULE_BINARY_SQL = """rule AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS actual,
  CAST(o_totalprice > 250000 AS INTEGER) AS predicted, o_totalprice AS score FROM orders)"""

_RULE_MULTI_SQL = """rule AS (SELECT o_orderpriority AS actual,
  CASE WHEN o_totalprice < 100000 THEN '1-URGENT' WHEN o_totalprice < 200000 THEN '2-HIGH'
       WHEN o_totalprice < 300000 THEN '3-MEDIUM' WHEN o_totalprice < 400000 THEN '4-NOT SPECIFIED'
       ELSE '5-LOW' END AS predicted FROM orders)"""


def _rule_multi(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")
    pred = (F.when(p < 100000, "1-URGENT").when(p < 200000, "2-HIGH").when(p < 300000, "3-MEDIUM")
            .when(p < 400000, "4-NOT SPECIFIED").otherwise("5-LOW"))
    return o.select(F.col("o_orderpriority").alias("actual"), pred.alias("predicted"))


@register("clf_metrics", f"""WITH {_RULE_BINARY_SQL},
c AS (SELECT count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp,
             count(*) FILTER (WHERE actual = 0 AND predicted = 1) AS fp,
             count(*) FILTER (WHERE actual = 1 AND predicted = 0) AS fn,
             count(*) FILTER (WHERE actual = predicted) AS ok, count(*) AS n FROM rule),
m AS (SELECT ok * 1.0 / n AS accuracy,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS p,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS r FROM c)
SELECT round(accuracy, 4) AS accuracy, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM m""")
def q_clf_metrics(spark, sf_dir):
    return metrics.classification_metrics(_rule_binary(spark, sf_dir), "actual", "predicted", positive=1)


@register("clf_metrics_macro", f"""WITH {_RULE_MULTI_SQL},
labels AS (SELECT actual AS l FROM rule UNION SELECT predicted FROM rule),
per AS (SELECT l,
    count(*) FILTER (WHERE actual = l AND predicted = l) AS tp,
    count(*) FILTER (WHERE predicted = l) AS pred, count(*) FILTER (WHERE actual = l) AS sup
  FROM labels, rule GROUP BY l),
pr AS (SELECT l, tp, CASE WHEN pred = 0 THEN 0.0 ELSE tp * 1.0 / pred END AS p,
       CASE WHEN sup = 0 THEN 0.0 ELSE tp * 1.0 / sup END AS r FROM per)
SELECT round(sum(tp) * 1.0 / (SELECT count(*) FROM rule), 4) AS accuracy, round(avg(p), 4) AS precision,
  round(avg(r), 4) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 4) AS f1
FROM pr""")
def q_clf_metrics_macro(spark, sf_dir):
    return metrics.classification_metrics(_rule_multi(spark, sf_dir), "actual", "predicted")


@register("auc", f"""WITH {_RULE_BINARY_SQL},
rk AS (SELECT actual, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score)
         + count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM rule)
SELECT round((sum(r) FILTER (WHERE actual = 1) - count(*) FILTER (WHERE actual = 1) * (count(*) FILTER (WHERE actual = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE actual = 1) * 1.0 * count(*) FILTER (WHERE actual = 0)), 6) AS auc FROM rk""")
def q_auc(spark, sf_dir):
    return metrics.roc_auc(_rule_binary(spark, sf_dir), "actual", "score", 1).select(F.round("auc", 6).alias("auc"))


@register("reg_metrics", """
SELECT round(avg(abs(a - p)), 4) AS mae, round(avg((a - p) * (a - p)), 4) AS mse,
  round(sqrt(avg((a - p) * (a - p))), 4) AS rmse,
  round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(a)), 4) AS r2
FROM (SELECT l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem) AS t""")
def q_reg_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"),
                                                 (F.col("l_quantity") * 2000).alias("p"))
    return metrics.regression_metrics(li, "a", "p")


@register("confusion", f"""WITH {_RULE_MULTI_SQL},
labels AS (SELECT actual AS l FROM rule UNION SELECT predicted FROM rule),
counts AS (SELECT actual, predicted, count(*) AS n FROM rule GROUP BY 1, 2)
SELECT a.l AS actual, b.l AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM labels AS a, labels AS b LEFT JOIN counts ON counts.actual = a.l AND counts.predicted = b.l""")
def q_confusion(spark, sf_dir):
    return metrics.confusion(_rule_multi(spark, sf_dir), "actual", "predicted")


# ============================================================ O1-O7, E11, I2-I3 on outliers, NaN and integers
_Q_BOTH = """(SELECT quantile_cont(amt, 0.25) AS q1, quantile_cont(amt, 0.75) AS q3,
  quantile_cont(qty, 0.25) AS p1, quantile_cont(qty, 0.75) AS p3,
  avg(amt) AS m, stddev_pop(amt) AS s FROM extreme_orders) AS q"""
_OUT_AMT = "coalesce(amt < q1 - 1.5 * (q3 - q1) OR amt > q3 + 1.5 * (q3 - q1), false)"


def _known(amt="amt"):
    return F.when(F.isnan(amt), F.lit(None)).otherwise(F.col(amt)).alias("amt")


@register("iqr_flags_extreme", V(f"SELECT o_orderkey, {_OUT_AMT} AS is_outlier FROM extreme_orders, {_Q_BOTH}", "extreme_orders"))
def q_iqr_extreme(spark, sf_dir):
    return outliers.iqr_flags(dirt.extreme_orders(spark, sf_dir), "amt").select("o_orderkey", "is_outlier")


@register("zscore_flags_extreme", V(f"""SELECT o_orderkey, coalesce(abs((amt - m) / s) > 3.0, false) AS is_outlier
FROM extreme_orders, {_Q_BOTH}""", "extreme_orders"))
def q_zscore_extreme(spark, sf_dir):
    return outliers.zscore_flags(dirt.extreme_orders(spark, sf_dir), "amt", 3.0).select("o_orderkey", "is_outlier")


@register("cap_extreme", V(f"""SELECT o_orderkey,
  CASE WHEN amt < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN amt > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE amt END AS amt,
  CASE WHEN qty < p1 - 1.5 * (p3 - p1) THEN p1 - 1.5 * (p3 - p1) WHEN qty > p3 + 1.5 * (p3 - p1) THEN p3 + 1.5 * (p3 - p1)
       ELSE CAST(qty AS DOUBLE) END AS qty FROM extreme_orders, {_Q_BOTH}""", "extreme_orders"))
def q_cap_extreme(spark, sf_dir):
    capped, _ = outliers.cap_all(dirt.extreme_orders(spark, sf_dir), ["amt", "qty"])
    return capped.select("o_orderkey", _known(), "qty")


@register("drop_outliers_extreme", V(f"SELECT o_orderkey FROM extreme_orders, {_Q_BOTH} WHERE NOT {_OUT_AMT}", "extreme_orders"))
def q_drop_extreme(spark, sf_dir):
    flagged = outliers.iqr_flags(dirt.extreme_orders(spark, sf_dir), "amt")
    return outliers.drop_outliers(flagged, "is_outlier").select("o_orderkey")


@register("outlier_summary_extreme", V(f"""SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE {_OUT_AMT}) AS BIGINT) AS outliers,
  round(count(*) FILTER (WHERE {_OUT_AMT}) * 100.0 / count(*), 2) AS pct FROM extreme_orders, {_Q_BOTH}""", "extreme_orders"))
def q_summary_extreme(spark, sf_dir):
    return outliers.outlier_summary(outliers.iqr_flags(dirt.extreme_orders(spark, sf_dir), "amt"), "is_outlier")


@register("box_outliers_extreme", V(f"SELECT o_orderkey, amt FROM extreme_orders, {_Q_BOTH} WHERE {_OUT_AMT}", "extreme_orders"))
def q_box_extreme(spark, sf_dir):
    return profile.box_outliers(dirt.extreme_orders(spark, sf_dir), "amt").select("o_orderkey", "amt")


@register("ffill_nan", V("""SELECT o_orderkey, last_value(amt IGNORE NULLS) OVER (PARTITION BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END
  ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS amt FROM extreme_orders""", "extreme_orders"))
def q_ffill_nan(spark, sf_dir):
    """NaN is a gap, and rows whose group is null are a group of their own."""
    d = dirt.extreme_orders(spark, sf_dir).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return impute.ffill(d, "o_orderkey", "o_orderstatus", ["amt"]).select("o_orderkey", "amt")


@register("ffill_text_order", V("""SELECT o_orderkey, last_value(prio IGNORE NULLS) OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey
  ROWS UNBOUNDED PRECEDING) AS prio FROM dirty_orders""", "dirty_orders"))
def q_ffill_text(spark, sf_dir):
    """Rows in the order of a text date, as a CSV file has it."""
    d = dirt.dirty_orders(spark, sf_dir).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return impute.ffill(d, ["day", "o_orderkey"], cols=["prio"]).select("o_orderkey", "prio")


@register("significant_pairs_linked", """
WITH c AS (SELECT l_quantity AS a, l_quantity * 2 AS b, l_quantity + 100 * l_discount AS m FROM lineitem),
r AS (SELECT CAST(count(*) AS BIGINT) AS n, round(corr(a, b), 4) AS ab, round(corr(a, m), 4) AS am, round(corr(b, m), 4) AS bm FROM c)
SELECT 'l_quantity' AS col_a, 'doubled' AS col_b, n, ab AS r FROM r
UNION ALL SELECT 'l_quantity', 'mixed', n, am FROM r UNION ALL SELECT 'doubled', 'mixed', n, bm FROM r""")
def q_significant_linked(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") * 2).alias("doubled"),
                                                (F.col("l_quantity") + 100 * F.col("l_discount")).alias("mixed"))
    corr = correlate.correlations(li, ["l_quantity", "doubled", "mixed"])
    return correlate.significant_pairs(corr).select("col_a", "col_b", "n", "r")


def _z_sql(c: str) -> str:
    return f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"


@register("pca_correlation", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in _PCA_COLS for b in _PCA_COLS))
def q_pca_correlation(spark, sf_dir):
    """All components together give back the correlations: the sum over components of variance and two loadings."""
    found = pca.run_pca(table(spark, sf_dir, "lineitem"), len(_PCA_COLS), _PCA_COLS)
    p = len(found.features)
    rows = [(a, b, round(sum(found.explained[c] * p * found.loadings[c][i] * found.loadings[c][j] for c in range(p)), 6) + 0.0)
            for i, a in enumerate(found.features) for j, b in enumerate(found.features)]
    return spark.createDataFrame(rows, "col_a string, col_b string, r double")


@register("pca_score_norms", f"""
SELECT l_returnflag, k, round(z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4, 5) AS norm FROM (
  SELECT l_returnflag, l_orderkey AS k, {', '.join(f'{_z_sql(c)} AS z{i + 1}' for i, c in enumerate(_PCA_COLS))} FROM lineitem) AS x""")
def q_pca_score_norms(spark, sf_dir):
    """A rotation keeps lengths: squared scores of all components sum to the squared standardised values; a category
    travels with its row."""
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey"))
    scores = pca.run_pca(li, len(_PCA_COLS), _PCA_COLS).scores(li, ["l_returnflag", "k"])
    total = sum((F.col(f"PC{i + 1}") * F.col(f"PC{i + 1}") for i in range(len(_PCA_COLS))), F.lit(0.0))
    return scores.select("l_returnflag", "k", F.round(total, 5).alias("norm"))


# ============================================================ M2-M18, M22, M24-M29
from .plans.training import ModelTrainer, importance_frame  # noqa: E402


def _clf_frame(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey",
                                                 "o_orderpriority", "o_orderstatus")


def _reg_frame(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _row_key().alias("row_key"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")


def _row_key():
    """Unique: (order, line) repeats in the given table, so the repeats are numbered."""
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"))
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1024 + again


def _trained(spark, sf_dir, problem: str, models=None):
    if problem == "classification":
        tr = ModelTrainer(target="o_orderstatus", key="o_orderkey", models=models)
        prep = tr.prepare(_clf_frame(spark, sf_dir))
    else:
        tr = ModelTrainer(target="l_extendedprice", key="row_key", models=models)
        prep = tr.prepare(_reg_frame(spark, sf_dir))
    trained = tr.train(prep)
    _whole(tr)
    return tr, prep, trained


def _whole(tr: ModelTrainer) -> None:
    """A query's rows speak for every model: one that the trainer skipped, or gave no AUC, is the query's error."""
    if tr.log:
        raise RuntimeError("; ".join(f"{name}: {what}" for name, what in tr.log))


_COMPARED: dict = {}


def _compared(spark, sf_dir: str, problem: str) -> DataFrame:
    """Metrics of every model of a problem; models are trained once a session and folder, as two queries report on them."""
    key = spark.sparkContext.applicationId, sf_dir, problem
    if key not in _COMPARED:
        tr, prep, trained = _trained(spark, sf_dir, problem)
        found = tr.evaluate(prep, trained)
        _whole(tr)
        rows = found.collect()                                                      # a row a model
        judged = "f1" if problem == "classification" else "r2"
        for r in rows:
            if r[judged] is None or math.isnan(r[judged]):                          # it would be sorted among the results
                raise RuntimeError(f"{r['model']}: no {judged} on {prep.n_test} test rows")
        _COMPARED[key] = [tuple(r) for r in rows], found.schema
        prep.release()
    rows, schema = _COMPARED[key]
    return spark.createDataFrame(rows, schema)


@register("model_compare_clf")
def q_model_compare_clf(spark, sf_dir):
    return metrics.compare(_compared(spark, sf_dir, "classification"), "f1")


@register("model_compare_reg")
def q_model_compare_reg(spark, sf_dir):
    return metrics.compare(_compared(spark, sf_dir, "regression"), "rmse")


@register("best_model")
def q_best_model(spark, sf_dir):
    return metrics.best_model(_compared(spark, sf_dir, "classification"), "f1")


@register("importance_top20")
def q_importance(spark, sf_dir):
    tr, prep, trained = _trained(spark, sf_dir, "regression", ["Random Forest"])
    return importance_frame(spark, trained["Random Forest"], 20)


@register("predictions")
def q_predictions(spark, sf_dir):
    tr, prep, trained = _trained(spark, sf_dir, "classification", ["Random Forest"])
    return tr.results(prep, trained["Random Forest"])


_ROW_KEY_SQL = """(l_orderkey * 8 + l_linenumber) * 1024 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate)"""


@register("predictions_csv", f"""
WITH d AS (SELECT {_ROW_KEY_SQL} AS row_key, l_quantity, l_extendedprice FROM lineitem),
h AS (SELECT *, {_sql_hash('row_key')} < {int(16777216 * 0.2)} AS is_test FROM d),
m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM h WHERE NOT is_test)
SELECT row_key, l_extendedprice AS actual, l_quantity, round(a + b * l_quantity, 2) AS prediction FROM h, m WHERE is_test""")
def q_predictions_csv(spark, sf_dir):
    """Linear regression on the training rows; its predictions file, written and read back."""
    frame = _reg_frame(spark, sf_dir).select("row_key", "l_quantity", "l_extendedprice")
    tr = ModelTrainer(target="l_extendedprice", key="row_key", problem="regression", models=["Linear Regression"], test_ratio="80/20")
    prep = tr.prepare(frame)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions_{uuid.uuid4().hex}"
    paths = tr.write_predictions(prep, tr.train(prep), folder)
    back = read_table(spark, paths["Linear Regression"], "csv")
    return back.select("row_key", "actual", F.col("l_quantity").cast("double").alias("l_quantity"), F.round("prediction", 2).alias("prediction"))


@register("training_summary", f"""
WITH h AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_sql_hash('o_orderkey')}, o_orderkey)
    <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders)
SELECT CAST(count(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train_rows, CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test_rows,
  '80/20' AS split, 3 AS n_features, 'o_totalprice, o_custkey, o_orderpriority' AS features, 'classification' AS problem FROM h""")
def q_training_summary(spark, sf_dir):
    tr = ModelTrainer(target="o_orderstatus", key="o_orderkey")
    return tr.summary(tr.prepare(_clf_frame(spark, sf_dir)))


# ============================================================ A1-A3, A5
from .plans.cleaning import AutoClean, ManualClean, quality_report  # noqa: E402


def _auto_stage_sql() -> str:
    """Distinct rows, coerced, title-cased and masked."""
    return f"""
, masked AS (
  SELECT o_orderkey, CASE WHEN p IN ({SENTINEL_LIST}) THEN NULL ELSE p END AS price_txt, {sql_title('prio')} AS prio,
    CASE WHEN amt IN ({SENTINEL_LIST}) THEN NULL ELSE amt END AS amt, o_orderdate, price_txt AS raw_price, p, amt AS raw_amt
  FROM (SELECT *, {sql_coerce('price_txt')} AS p FROM (SELECT DISTINCT * FROM dirty_orders) AS x) AS y)"""


def _auto_sql() -> str:
    """The five nearest rows by brute force for every row with a gap, then the mode and the caps."""
    def fill(n):
        return f"""f{n} AS (SELECT rk, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(v) FILTER (WHERE dist = 0)
    ELSE sum(v / dist) / sum(1.0 / dist) END AS fill FROM (
      SELECT rk, dist, v{n} AS v, row_number() OVER (PARTITION BY rk ORDER BY dist, dk) AS rn FROM pairs WHERE need{n} AND v{n} IS NOT NULL) AS x
    WHERE rn <= 5 GROUP BY rk)"""

    def capped(c, q):
        return (f"CASE WHEN {c} < {q}1 - 1.5 * ({q}3 - {q}1) THEN {q}1 - 1.5 * ({q}3 - {q}1) "
                f"WHEN {c} > {q}3 + 1.5 * ({q}3 - {q}1) THEN {q}3 + 1.5 * ({q}3 - {q}1) ELSE {c} END")

    gap = " + ".join(f"CASE WHEN r.f{i} IS NOT NULL AND d.f{i} IS NOT NULL THEN (r.f{i} - d.f{i}) * (r.f{i} - d.f{i}) ELSE 0 END" for i in (1, 2, 3))
    both = " + ".join(f"CAST(r.f{i} IS NOT NULL AND d.f{i} IS NOT NULL AS INT)" for i in (1, 2, 3))
    return V(_auto_stage_sql() + f""",
base AS (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS f1, price_txt AS f2, amt AS f3, prio, o_orderdate FROM masked),
r AS (SELECT * FROM base WHERE f2 IS NULL OR f3 IS NULL),
pairs AS (SELECT r.o_orderkey AS rk, d.o_orderkey AS dk, r.f2 IS NULL AS need2, r.f3 IS NULL AS need3, d.f2 AS v2, d.f3 AS v3,
  sqrt(3.0 / ({both}) * ({gap})) AS dist FROM r, base AS d WHERE d.f2 IS NOT NULL OR d.f3 IS NOT NULL),
{fill(2)}, {fill(3)},
filled AS (SELECT b.o_orderkey, coalesce(b.f2, f2.fill) AS price_txt, coalesce(prio, {_mode_sql('masked', 'prio')}) AS prio,
  coalesce(b.f3, f3.fill) AS amt, o_orderdate
  FROM base AS b LEFT JOIN f2 ON f2.rk = b.o_orderkey LEFT JOIN f3 ON f3.rk = b.o_orderkey),
q AS (SELECT quantile_cont(price_txt, 0.25) AS p1, quantile_cont(price_txt, 0.75) AS p3,
             quantile_cont(amt, 0.25) AS a1, quantile_cont(amt, 0.75) AS a3 FROM filled)
SELECT o_orderkey, round({capped('price_txt', 'p')}, 4) AS price_txt, prio, round({capped('amt', 'a')}, 4) AS amt, o_orderdate
FROM filled, q""", "dirty_orders")


@register("auto_clean_orders", _auto_sql())
def q_auto_clean(spark, sf_dir):
    out, _ = AutoClean(key="o_orderkey", k_neighbors=5).run(dirt.dirty_orders(spark, sf_dir))
    return out.select("o_orderkey", F.round("price_txt", 4).alias("price_txt"), "prio", F.round("amt", 4).alias("amt"), "o_orderdate")


@register("auto_clean_log", V(_auto_stage_sql() + f""",
n AS (SELECT (SELECT count(*) FROM dirty_orders) - count(*) AS removed, count(raw_price) - count(p) AS lost,
  count(*) FILTER (p IN ({SENTINEL_LIST})) + count(*) FILTER (raw_amt IN ({SENTINEL_LIST}))
    + count(*) FILTER (CAST(o_orderkey AS DOUBLE) IN ({SENTINEL_LIST})) AS masked,
  3 * count(*) - count(price_txt) - count(prio) - count(amt) AS missing FROM masked)
SELECT 0 AS position, 'dedupe' AS step, '*' AS target, 'removed' AS metric, CAST(removed AS VARCHAR) AS value FROM n
UNION ALL SELECT 1, 'title_case', 'prio', 'columns', '1'
UNION ALL SELECT 2, 'coerce_numeric', 'price_txt', 'lost_cells', CAST(lost AS VARCHAR) FROM n
UNION ALL SELECT 3, 'sentinel_mask', 'o_orderkey,price_txt,amt', 'masked', CAST(masked AS VARCHAR) FROM n
UNION ALL SELECT 4, 'impute', '*', 'missing_before', CAST(missing AS VARCHAR) FROM n
UNION ALL SELECT 5, 'iqr_cap', 'price_txt,amt', 'columns', '2'""", "dirty_orders"))
def q_auto_clean_log(spark, sf_dir):
    _, log = AutoClean(key="o_orderkey", k_neighbors=5).run(dirt.dirty_orders(spark, sf_dir))
    return log.frame(spark)


@register("manual_clean_orders", V(f"""
, conv AS (SELECT o_orderkey, {sql_coerce('price_txt')} AS price_txt, prio, amt, o_orderdate FROM dirty_orders),
dd AS (SELECT DISTINCT * FROM conv),
crit AS (SELECT * FROM dd WHERE price_txt IS NOT NULL)
SELECT o_orderkey, price_txt,
  coalesce(prio, {_mode_sql('crit', 'prio')}) AS prio,
  coalesce(amt, (SELECT quantile_cont(amt, 0.5) FROM crit)) AS amt
FROM crit""", "dirty_orders"))
def q_manual_clean(spark, sf_dir):
    out, _ = ManualClean(key="o_orderkey", critical=["price_txt"], method="median").run(
        dirt.dirty_orders(spark, sf_dir))
    return out.select("o_orderkey", "price_txt", "prio", "amt")


@register("quality_report", V(f"""
, conv AS (SELECT o_orderkey, {sql_coerce('price_txt')} AS price_txt, prio, amt, o_orderdate FROM dirty_orders),
dd AS (SELECT DISTINCT * FROM conv),
crit AS (SELECT * FROM dd WHERE price_txt IS NOT NULL),
filled AS (SELECT o_orderkey, price_txt, coalesce(prio, {_mode_sql('crit', 'prio')}) AS prio,
  coalesce(amt, (SELECT quantile_cont(amt, 0.5) FROM crit)) AS amt, o_orderdate FROM crit)
SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(count(*) FILTER (WHERE price_txt IS NULL) + count(*) FILTER (WHERE prio IS NULL)
   + count(*) FILTER (WHERE amt IS NULL) AS BIGINT) AS missing,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM filled) AS x) AS BIGINT) AS duplicates
FROM filled""", "dirty_orders"))
def q_quality_report(spark, sf_dir):
    out, _ = ManualClean(key="o_orderkey", critical=["price_txt"], method="median").run(
        dirt.dirty_orders(spark, sf_dir))
    return quality_report(out)


def _manual_order_sql(last: str, frame: str) -> str:
    """Coerce, dedupe, critical drop, fill along the key, then the mode for what is left."""
    fill = f"{last}({{0}} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS {frame})"
    return V(f"""
, conv AS (SELECT o_orderkey, {sql_coerce('price_txt')} AS price_txt, prio, amt, o_orderdate FROM dirty_orders),
dd AS (SELECT DISTINCT * FROM conv),
crit AS (SELECT * FROM dd WHERE price_txt IS NOT NULL),
filled AS (SELECT o_orderkey, price_txt, {fill.format('prio')} AS prio, {fill.format('amt')} AS amt FROM crit)
SELECT o_orderkey, price_txt, coalesce(prio, {_mode_sql('filled', 'prio')}) AS prio, amt FROM filled""", "dirty_orders")


def _manual(spark, sf_dir, method: str) -> DataFrame:
    out, _ = ManualClean(key="o_orderkey", critical=["price_txt"], method=method).run(dirt.dirty_orders(spark, sf_dir))
    return out.select("o_orderkey", "price_txt", "prio", "amt")


@register("manual_clean_knn", V(f"""
, conv AS (SELECT o_orderkey, {sql_coerce('price_txt')} AS price_txt, prio, amt, o_orderdate FROM dirty_orders),
crit AS (SELECT * FROM (SELECT DISTINCT * FROM conv) AS x WHERE price_txt IS NOT NULL)
SELECT o_orderkey, price_txt, coalesce(prio, {_mode_sql('crit', 'prio')}) AS prio, amt FROM crit""", "dirty_orders"))
def q_manual_knn(spark, sf_dir):
    """After the drop no numeric gap is left, so the neighbours change nothing; the gaps are manual_clean_knn_fill's."""
    return _manual(spark, sf_dir, "knn")


@register("manual_clean_knn_fill", V(f"""
, base AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS f1, CAST(p_size AS DOUBLE) AS f2, CAST(p_retailprice AS DOUBLE) AS f3
           FROM (SELECT DISTINCT * FROM gappy_part) AS x WHERE p_size IS NOT NULL),
r AS (SELECT * FROM base WHERE f3 IS NULL),
pairs AS (SELECT r.p_partkey AS rk, d.p_partkey AS dk, d.f3 AS v,
  sqrt(3.0 / 2 * ((r.f1 - d.f1) * (r.f1 - d.f1) + (r.f2 - d.f2) * (r.f2 - d.f2))) AS dist FROM r, base AS d WHERE d.f3 IS NOT NULL),
f AS (SELECT rk, CASE WHEN count(*) FILTER (WHERE dist = 0) > 0 THEN avg(v) FILTER (WHERE dist = 0) ELSE sum(v / dist) / sum(1.0 / dist) END AS fill
      FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY dist, dk) AS rn FROM pairs) AS x WHERE rn <= 5 GROUP BY rk)
SELECT p_partkey, f2 AS p_size, round(coalesce(f3, fill), 6) AS p_retailprice FROM base LEFT JOIN f ON rk = p_partkey""", "gappy_part"))
def q_manual_knn_fill(spark, sf_dir):
    part = dirt.gappy_part(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out, _ = ManualClean(key="p_partkey", critical=["p_size"], method="knn").run(part)
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"))


@register("manual_clean_ffill", _manual_order_sql("last_value", "UNBOUNDED PRECEDING"))
def q_manual_ffill(spark, sf_dir):
    return _manual(spark, sf_dir, "ffill")


@register("manual_clean_bfill", _manual_order_sql("first_value", "BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"))
def q_manual_bfill(spark, sf_dir):
    return _manual(spark, sf_dir, "bfill")


# ============================================================ S1-S10
from .sources import sinks  # noqa: E402
from .sources.stages import StageCatalog  # noqa: E402


@register("csv_roundtrip", """
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def q_csv_roundtrip(spark, sf_dir):
    # written under the shared checkpoint folder, never a machine-local one
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_roundtrip_{uuid.uuid4().hex}"
    sinks.write_csv(table(spark, sf_dir, "nation"), path)
    return read_table(spark, path, "csv")


@register("csv_roundtrip_documents", "SELECT doc_id, text, lang FROM documents")
def q_csv_documents(spark, sf_dir):
    """Whole texts with commas, quotes and line breaks through a CSV file, every row as it is: the
    cells are read as text, so none is taken for a missing value, and an empty text is not null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_documents_{uuid.uuid4().hex}"
    sinks.write_csv(docs, path)
    back = read_table(spark, path, "csv", infer=False)
    return back.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields])


@register("stage_resolve", "SELECT * FROM nation")
def q_stage_resolve(spark, sf_dir):
    cat = StageCatalog(spark, prefix=f"stage_{uuid.uuid4().hex[:8]}_")
    cat.save("raw", table(spark, sf_dir, "region"))
    cat.save("cleaned", table(spark, sf_dir, "nation"))
    return cat.resolve("eda")[1]


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, sf_dir):
    return sinks.preview(table(spark, sf_dir, "orders"), 10, "o_orderkey")


# ============================================================ 2.13 fitted plan on a stream
from .streaming.apply import ScoringPlan, fit_row_plan, run_to_table, stream_table  # noqa: E402


@register("stream_clean_events", V("""
SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM gappy_events)) AS value
FROM gappy_events""", "gappy_events"))
def q_stream_clean_events(spark, sf_dir):
    static = dirt.gappy_events(spark, sf_dir).select("event_id", "value")
    plan = fit_row_plan(static, key="event_id", sentinels=[], cap=False)
    gap = (F.col("event_id") % 5).isin(0, 1)
    stream = (stream_table(spark, sf_dir, "events")
              .select("event_id", F.when(gap, F.lit(None)).otherwise(F.col("value")).alias("value")))
    return run_to_table(plan.apply(stream))




@register("stream_predictions", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS c, o_orderpriority,
    {_sql_hash('o_orderkey')} < {int(16777216 * 0.2)} AS is_test FROM orders),
p AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code
      FROM (SELECT DISTINCT o_orderpriority FROM o WHERE NOT is_test) AS x),
e AS (SELECT o.*, coalesce(code, (SELECT count(*) FROM p)) AS q FROM o LEFT JOIN p USING (o_orderpriority)),
s AS (SELECT avg(c) AS mc, stddev_pop(c) AS sc, avg(q) AS mq, stddev_pop(q) AS sq FROM e WHERE NOT is_test),
z AS (SELECT e.*, (c - mc) / sc AS z1, (q - mq) / sq AS z2 FROM e, s),
m AS (SELECT var_pop(z1) AS v1, var_pop(z2) AS v2, covar_pop(z1, z2) AS v12, covar_pop(z1, y) AS y1, covar_pop(z2, y) AS y2,
             avg(z1) AS a1, avg(z2) AS a2, avg(y) AS ay FROM z WHERE NOT is_test),
b AS (SELECT *, (v2 * y1 - v12 * y2) / (v1 * v2 - v12 * v12) AS b1, (v1 * y2 - v12 * y1) / (v1 * v2 - v12 * v12) AS b2 FROM m)
SELECT o_orderkey, round(z1, 6) AS o_custkey, round(z2, 6) AS o_orderpriority,
  round(ay + b1 * (z1 - a1) + b2 * (z2 - a2), 2) AS prediction FROM z, b""")
def q_stream_predictions(spark, sf_dir):
    """A model trained on a table scores a stream: codes and scaling learned on the training rows, then regression."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority")
    tr = ModelTrainer(target="o_totalprice", key="o_orderkey", problem="regression", scaler="standard", models=["Linear Regression"])
    prep = tr.prepare(o)
    plan = ScoringPlan(encoder=prep.encoder, model=tr.train(prep)["Linear Regression"])
    stream = stream_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    scored = plan.apply(stream).select("o_orderkey", "o_custkey", "o_orderpriority", "prediction")
    return run_to_table(scored).select("o_orderkey", F.round("o_custkey", 6).alias("o_custkey"),
                                       F.round("o_orderpriority", 6).alias("o_orderpriority"), F.round("prediction", 2).alias("prediction"))


@register("cached_source", V("""
SELECT (SELECT count(*) FROM dirty_orders) AS row_count, (SELECT count(DISTINCT prio) FROM dirty_orders) AS priorities,
  true AS held, false AS held_after""", "dirty_orders"))
def q_cached_source(spark, sf_dir):
    """Two reports from one read of a source that is then let go."""
    from .sources.cache import cached
    source = cached(dirt.dirty_orders(spark, sf_dir))
    with source as d:
        rows = source.fill()
        found = d.agg(F.count_distinct("prio").alias("n")).first()["n"]
        held = source.held and source.size_bytes() > 0
    return spark.createDataFrame([(rows, found, held, source.held)], "row_count long, priorities long, held boolean, held_after boolean")


from .plans import search  # noqa: E402


def _tree_search() -> search.Search:
    from pyspark.ml.classification import DecisionTreeClassifier

    return search.Search("o_orderstatus", "o_orderkey", "classification", lambda params: DecisionTreeClassifier(seed=42, **params))


@register("tuned")
def q_tuned(spark, sf_dir):
    """Grid: every combination, cross-validated, the encoder fitted in each fold."""
    found = _tree_search().run(_clf_frame(spark, sf_dir), search.grid({"maxDepth": [3, 6], "minInstancesPerNode": [1, 20]}))[1]
    return found.select("params", F.col("score").alias("f1"), "kept")


@register("tuned_halving")
def q_tuned_halving(spark, sf_dir):
    """Nine draws from distributions, three rungs of a ninth, a third and all rows."""
    space = {"maxDepth": search.Integers(2, 10), "minInstancesPerNode": search.Integers(1, 200),
             "minInfoGain": search.LogUniform(1e-6, 1e-2)}
    return _tree_search().run(_clf_frame(spark, sf_dir), search.draws(space, 9), rungs=3)[1]


def _budget_sql(folds: int = 3, rungs: int = 3, factor: int = 3) -> str:
    of = f"{_sql_hash('o_orderkey', 43)} % {folds}"
    parts = []
    for r, share in enumerate(search.shares(rungs, factor)):
        limit = -int(-search.SCALE * share // 1)
        parts.append(f"""SELECT {r} AS rung, f AS fold, CAST(count(*) FILTER (fold <> f AND h < {limit}) AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (fold = f) AS BIGINT) AS held_out_rows FROM d, (SELECT unnest(range({folds})) AS f) AS x GROUP BY f""")
    return (f"WITH d AS (SELECT {of} AS fold, {_sql_hash('o_orderkey', 44)} AS h FROM orders)\n" + "\nUNION ALL\n".join(parts))


@register("search_budgets", _budget_sql())
def q_search_budgets(spark, sf_dir):
    return search.budget_rows(table(spark, sf_dir, "orders"), "o_orderkey")
