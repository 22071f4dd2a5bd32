"""Secret scans over an incremental blob ledger, DataFrame functions only.

Every historical version of a text is content-addressed (SHA-256 of its UTF-8 bytes).  The
ledger is a table of (blob, rule, version) with the findings of that scan; a run scans only
pairs of blob and rule version that the ledger has not seen, appends them, and joins findings
back to every path and version that holds the blob.  Each unseen blob is read once, from the
first row that holds it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, scratch_path, text_of

_KEYWORDS = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
             "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match counts if group ``group`` has at
    least ``least`` characters.  A changed rule gets a new version and is scanned anew."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]+", least=24),
)
#: Rules that the scan adds to the base.
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", version=2),
    # of a scheme's name at most the last 40 characters belong to the span, whatever its length
    Rule("login", "[a-z0-9+.-]{1,40}://[^\\x20\\x09-\\x0D/:@]+:[^\\x20\\x09-\\x0D/:@]+@", version=2),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<before, match, value>>: the text before each match (from the last match's
    end), the match, and the group whose length counts; empty array if there is none."""
    pattern = F.lit(rule.pattern)
    # a run of at least `least` such characters is one match, so the short ones need not be cut out
    if rule.kind == "hex":
        pattern = F.lit(f"[0-9a-f]{{{rule.least},}}")
    if rule.kind == "access":
        pattern = F.lit(f"AKIA[A-Z0-9]{{{rule.least - 4},}}")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    found = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("match"), value.alias("value"))
    none = F.array().cast("array<struct<before:string,match:string,value:string>>")
    return F.when(F.rlike(text, pattern), found).otherwise(none)


def _scan(blobs: DataFrame, rules) -> DataFrame:
    """LEDGER rows of ``(blob, text, unseen array<string>)``: one row per blob and unseen rule."""
    per_rule = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                 F.when(F.array_contains("unseen", f"{r.kind}@{r.version}"), _matches(F.col("text"), r)).alias("found"))
        for i, r in enumerate(rules)])
    hits = (blobs.select("blob", F.explode(per_rule).alias("r")).where("r.found IS NOT NULL")
            .select("blob", "r.i", "r.rule", "r.version",
                    F.posexplode_outer(F.expr("filter(r.found, f -> f.match IS NOT NULL)")).alias("at", "f")))
    # positions: running sum of what stands before each match, over the matches of one blob and rule
    run = Window.partitionBy("blob", "rule", "version").orderBy("at")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("i") + 1)
    placed = (hits.select("blob", "rule", "version", "at", F.length("f.before").alias("before"),
                          F.length("f.match").alias("size"), (F.length("f.value") >= least).alias("counts"))
              .withColumn("end", F.sum(F.col("before") + F.col("size")).over(run)))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("size")).cast("int").alias("start"),
                                            F.col("end").cast("int").alias("end")))
    return placed.groupBy("blob", "rule", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_history(versions: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text",
                 rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """``versions`` with ``blob`` and one column of spans per rule kind, after scanning what is new.

    ``versions`` holds every version of every path, one row each; ``ledger`` is the folder of
    the ledger, made if it is missing.  A null text is the empty blob; null and repeated ids
    and repeated rows keep one result row each.  Spans are code points, end exclusive.  Columns
    named like the added ones are not kept.
    """
    spark = versions.sparkSession
    text = text_of(text_col)
    addressed = versions.select(F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    wanted = spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
        known.limit(0).count()
    except AnalysisException:               # no ledger yet
        known = spark.createDataFrame([], LEDGER)
    first = (addressed.groupBy("blob", "id").agg(F.count("*").alias("n")).groupBy("blob")
             .agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("row"), F.max("n").alias("n")))
    seen = (known.join(F.broadcast(wanted), ["rule", "version"])
            .groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen")))
    every = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    unseen = save(first.join(seen, "blob", "left").select(
        F.col("blob").alias("new_blob"), F.col("row.id").alias("new_id"), "n",
        F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("unseen"))
        .where(F.size("unseen") > 0), "secret_unseen")
    new = addressed.join(unseen, (F.col("blob") == F.col("new_blob")) & F.col("id").eqNullSafe(F.col("new_id")))
    if not unseen.where("n > 1").isEmpty():  # a version stands there twice under one id: read one of them
        new = new.groupBy("blob").agg(F.first("text").alias("text"), F.first("unseen").alias("unseen"))
    _scan(new, rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    return findings(addressed.select("id", "blob"), spark.read.schema(LEDGER).parquet(ledger), rules, id_col)


def findings(paths: DataFrame, ledger: DataFrame, rules, id_col: str) -> DataFrame:
    """``(<id_col>, blob, <kind> array<struct<start, end>> ...)`` for every path of a blob."""
    wanted = paths.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    current = ledger.join(F.broadcast(wanted), ["rule", "version"]).where(F.size("spans") > 0)
    by_blob = save(current.groupBy("blob").agg(*[
        F.first(F.when(F.col("rule") == r.kind, F.col("spans")), ignorenulls=True).alias(r.kind) for r in rules]),
        "secret_findings")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return paths.join(by_blob, "blob", "left").select(
        F.col("id").alias(id_col), "blob", *[F.coalesce(r.kind, none).alias(r.kind) for r in rules])


def joined_spans(rules) -> Column:
    """kind:start:end of all spans, by start, then rule order, joined by commas."""
    def named(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"),
                                                    s["end"].alias("end"), F.lit(kind).alias("kind")))

    each = F.concat(*[named(i, r.kind) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(each), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Contract form over a ledger of its own: doc_id, counts, base_sha256, spans."""
    ledger = scratch_path(docs.sparkSession, "secret_ledger")
    found = scan_history(docs, ledger)
    return found.select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined_spans(BASE_RULES), 256).alias("base_sha256"),
        joined_spans(BASE_RULES + MORE_RULES).alias("spans"))
