"""One query opN_<name> per training-data operator, over its whole table, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, crossentropy, decontaminate, language, lines, packing, prefix_trie, quality, secrets, simhash, substrings,
    token_files, topk,
)
from .common import text_rows
from .tokens import id_type, tokenizer_file

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER, VOCABULARY, END_ID = "word_bpe_49k.json", 49_408, 2


@register("op1_token_files")
def op1(spark, sf_dir):
    found = token_files.round_trip(read(spark, sf_dir, "documents"), tokenizer_file(TOKENIZER), VOCABULARY, END_ID)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@register("op2_cross_entropy_difference")
def op2(spark, sf_dir):
    """Target: the documents labelled good; background: all documents."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return crossentropy.score(read(spark, sf_dir, "documents"), good)


@register("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents")).select("doc_id", "pattern", "weak_good", "p_good", "keep")


@register("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return simhash.digest(read(spark, sf_dir, "documents"))


@register("op8_exact_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op8(spark, sf_dir):
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, kind, start, end) of the counting matches, by what stands between matches."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, start + size AS stop, start FROM (
    SELECT doc_id, CAST(list_sum(list_transform(b[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start,
           length(m[i]) AS size, length(v[i]) AS worth
    FROM (SELECT doc_id, b, m, v, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, $r${pattern}$r$) AS m, regexp_extract_all(t, $r${pattern}$r$, {group}) AS v,
             string_split_regex(t, $r${pattern}$r$) AS b FROM d WHERE regexp_matches(t, $r${pattern}$r$)))
  ) WHERE worth >= {least}"""


def _sql_secrets() -> str:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    order = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(rules)) + " END"
    spans = " UNION ALL ".join(_sql_spans(r.kind, r.pattern, r.group, r.least) for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    one = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({spans})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY start, {order}) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY start, {order}) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""


@register("op5_secret_ledger", _sql_secrets())
def op5(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir, "documents"))


@register("op6_fuzzy_lines")
def op6(spark, sf_dir):
    return lines.report(read(spark, sf_dir, "documents"))


@register("op7_vector_packing")
def op7(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Whole texts as examples whose tokens all bear loss, cut and packed into 4,096 tokens."""
    pieces = packing.pack_texts(text_rows(docs, "doc_id", "text"), tokenizer_file(TOKENIZER), END_ID,
                                packing.Limits(tokens=4096, segments=256, loss=4096), id_type(VOCABULARY))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32",
                         F.col("tokens").alias("doc_tokens"), "sequence_id", "offset", "loss_tokens")


@register("op9_qgram_decontamination")
def op9(spark, sf_dir):
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_segments", "edits")


@register("op10_suffix_dedup")
def op10(spark, sf_dir):
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def _sql_crc(text: str) -> str:
    """crc32 of the digits of a number, bit by bit."""
    step = ("list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
            "lambda x, z: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))")
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return (f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {step}), "
            "CAST(4294967295 AS BIGINT))")


_TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS t,
         len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
l AS (SELECT c, {_sql_crc('CAST(c AS VARCHAR)')} % 4 AS h, list({{'t': t, 'w': w}} ORDER BY turn NULLS FIRST, t) AS s FROM t GROUP BY c),
b AS (SELECT l.c, list_concat(CASE WHEN o.c IS NULL THEN l.s[1:0] ELSE o.s[1:l.h] END, l.s[l.h + 1:]) AS s
      FROM l LEFT JOIN l AS o ON o.c = l.c - l.c % 20),
p AS (SELECT c, len(s) AS size, d, array_to_string(list_transform(s[1:d], lambda x: x['t']), ',') AS k,
             array_to_string(list_transform(s[1:d - 1], lambda x: x['t']), ',') AS up, CASE WHEN d > 0 THEN s[d]['w'] ELSE 0 END AS w
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS (SELECT d, k, min(CASE WHEN d > 0 THEN up END) AS up, min(c) AS c, min(w) AS w, count(*) AS n,
             sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (size = d), '')) AS e FROM p GROUP BY d, k),
k AS (SELECT d - 1 AS d, up AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (d, k)),
s AS (SELECT p.d, p.k, count(*) FILTER (m.kids = 0) AS leaves, sum((m.n - 1) * m.w) AS saved
      FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.d, p.k)
SELECT m.c AS conv_id, m.d AS depth, u.c AS parent_conv_id, m.n AS n_convs, m.kids AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.e AS ends_sha256
FROM m JOIN s USING (d, k) LEFT JOIN n AS u ON u.d = m.d - 1 AND u.k = m.up"""


@register("op11_prefix_trie", _TRIE_SQL)
def op11(spark, sf_dir):
    return prefix_trie.digest(read(spark, sf_dir, "conversations"))


_LANGUAGE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce({_sql_crc('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) AS held_out,
         regexp_extract_all(lower(text), '[\\p{{L}}]+') AS words FROM documents),
w AS (SELECT row, ' ' || word || ' ' AS p, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY ALL),
g AS (
  SELECT row, gram, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT row, n, unnest(list_concat(
      list_transform(range(2, length(p)), lambda i: substr(p, i, 1)),
      list_transform(range(1, length(p)), lambda i: substr(p, i, 2)),
      list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) AS gram FROM w)
  GROUP BY row, gram),
a AS (
  SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank
  FROM g JOIN d USING (row) WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND NOT held_out GROUP BY lang, gram),
l AS (SELECT lang, gram, rank FROM a WHERE rank < {language.PROFILE}),
r AS (SELECT * FROM (SELECT row, gram, row_number() OVER (PARTITION BY row ORDER BY n DESC, gram) - 1 AS rank FROM g)
      WHERE rank < {language.PROFILE}),
m AS (SELECT row, count(*) AS grams FROM r GROUP BY row),
x AS (
  SELECT m.row, names.lang, m.grams, {language.PROFILE} * m.grams + coalesce(near, 0) AS distance
  FROM m CROSS JOIN (SELECT DISTINCT lang FROM l) AS names
  LEFT JOIN (SELECT r.row, l.lang, sum(abs(r.rank - l.rank) - {language.PROFILE}) AS near
             FROM r JOIN l USING (gram) GROUP BY r.row, l.lang) AS c ON c.row = m.row AND c.lang = names.lang),
best AS (SELECT row, min(struct_pack(distance, lang)) AS b, min(grams) AS grams FROM x GROUP BY row)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred,
       coalesce(1 - CAST(b.distance AS DOUBLE) / CAST({language.PROFILE} * grams AS DOUBLE), 0) AS score
FROM d LEFT JOIN best USING (row)"""


@register("op12_language_id", _LANGUAGE_SQL)
def op12(spark, sf_dir):
    return language.identify(read(spark, sf_dir, "documents"))


def _sql_clusters(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Every round in full: distances to all centroids, then floors of the means."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS cluster, e AS c
  FROM v ORDER BY cluster LIMIT {k})"""]
    nearest = ("SELECT row, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(e, c), "
               "lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), cluster := cluster)) AS b FROM v CROSS JOIN c{r} GROUP BY row")
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS m FROM (
      SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
      FROM (SELECT b.cluster AS cluster, unnest(e) AS x, unnest(range(1, {size} + 1)) AS i FROM v JOIN a{r} USING (row))
      GROUP BY cluster, i) GROUP BY cluster) USING (cluster))""")
    return ",\n".join(parts) + f"""
SELECT vec_id, b.cluster AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (row) JOIN c{rounds} AS f ON f.cluster = b.cluster"""


@register("op13_centroid_clustering", _sql_clusters())
def op13(spark, sf_dir):
    return centroids.digest(read(spark, sf_dir, "embeddings"))
