"""Quality classifier from weak labels.

Seven heuristic labellers vote good, bad or nothing on every document.  Documents with equal
votes are one pattern, so the corpus comes down to at most 3**7 counted patterns; from those,
expectation-maximisation estimates how often each labeller votes each way on good and on bad
documents, and the posterior of every pattern.  The posteriors are the labels of a linear
scorer over hashed byte trigrams and word features, fitted on a bounded sample of the labelled
documents and applied to the whole text of every document.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, keyed, save, text_of

LABELLERS = ("symbols", "capitals", "echo", "vocabulary", "lines", "sentence_ends", "word_length")
ABSTAIN, GOOD, BAD = 0, 1, 2
TRAINING_ROWS = 8_192      # documents that the scorer is fitted on, about
DIMENSIONS = 1 << 14
REGULARISATION = 3e-3
FALSE_ALARMS = 0.002       # share of good documents that a labeller may call bad, at most
BUCKETS = 8                # of each word feature

#: Bytes that rarely stand in prose (fixed values).
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|@{}<>=+_\\~^", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def measures(raw: bytes) -> tuple[float, ...]:
    """Numbers the labellers look at: characters, words, and six shares."""
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    letters = int(codes[LETTER].sum())
    return (len(raw), len(words), _share(int(codes[SYMBOLS].sum()), len(raw)),
            _share(int(codes[UPPER].sum()), letters) if letters >= 40 else 0.0,
            _share(sum(map(eq, words, words[1:])), len(words)),
            _share(len(set(words)), len(words)),
            _share(len(lines) - len(set(lines)), len(lines)) if len(lines) >= 3 else 0.0,
            _share(sum(x[-1:] in (b".", b"?", b"!", b'"') and x[-2:] != b"!!" for x in lines), len(lines)))


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """Votes of the labellers; short texts get no vote on what they are too short for."""
    size, words, symbols, capitals, echo, vocabulary, repeated, ended = m

    def side(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else ABSTAIN

    enough = words >= 20
    return (side(symbols > 0.02, symbols < 0.005),
            side(capitals > 0.3, capitals < 0.12),
            side(enough and echo > 0.1, echo < 0.02),
            side(enough and vocabulary < 0.3, vocabulary > 0.55),
            side(repeated > 0.4, repeated < 0.15),
            side(enough and ended < 0.2, ended > 0.8),
            side(enough and size > 9 * words, enough and 3 * words < size < 8 * words))


def code(v: tuple[int, ...]) -> int:
    return sum(x * 3 ** i for i, x in enumerate(v))


def decode(pattern: int) -> tuple[int, ...]:
    return tuple(pattern // 3 ** i % 3 for i in range(len(LABELLERS)))


def expectation_maximisation(patterns: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good documents, P(vote | class, it votes) as [class, labeller, vote], P(good | pattern)).

    Starts from the belief that whatever any labeller calls bad is bad; every estimate is
    smoothed by half a count, so no probability is zero.  That a labeller calls good documents bad
    at most at the rate FALSE_ALARMS is given: it keeps kinds of junk that only one labeller
    sees from being explained as its errors.  Class 0 is bad, 1 good.
    """
    keys = sorted(patterns)
    table = np.array([decode(k) for k in keys], np.int64).reshape(len(keys), len(LABELLERS))
    n = np.array([patterns[k] for k in keys], float)
    good = np.where((table == BAD).any(axis=1), 0.02, 0.98)
    prior, rates = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        for v in (GOOD, BAD):
            rates[:, :, v] = weight @ (table == v) + 0.5
        rates[:, :, ABSTAIN] = 0.0
        rates /= rates.sum(axis=2, keepdims=True)
        rates[1, :, BAD] = np.minimum(rates[1, :, BAD], FALSE_ALARMS)
        rates[1, :, GOOD] = 1 - rates[1, :, BAD]
        logs = np.log(np.where(np.arange(3) == ABSTAIN, 1.0, rates))      # no vote, no evidence
        each = np.stack([logs[c, np.arange(len(LABELLERS)), table].sum(axis=1) for c in (0, 1)])
        odds = each[0] - each[1] + math.log((1 - prior) / prior)
        new = 1 / (1 + np.exp(np.clip(odds, -700, 700)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            good = new
            break
        good = new
    return prior, rates, dict(zip(keys, good.tolist()))


def accuracies(rates: np.ndarray) -> dict[str, tuple[float, float]]:
    """For each labeller, how often it is right when it votes: on good and on bad documents."""
    return {name: (float(rates[1, i, GOOD] / rates[1, i, 1:].sum()), float(rates[0, i, BAD] / rates[0, i, 1:].sum()))
            for i, name in enumerate(LABELLERS)}


def _word_features(m: tuple[float, ...]) -> list[int]:
    """Slots of the word features: one bucket of each share (not hashed: the first slots)."""
    shares = (min(1.0, 4 * m[2]), m[3], min(1.0, 2 * m[4]), m[5], m[6], m[7])
    slots = [i * BUCKETS + min(BUCKETS - 1, int(s * BUCKETS)) for i, s in enumerate(shares)]
    return [*slots, len(shares) * BUCKETS + min(BUCKETS - 1, int(math.log10(m[1] + 1) * 2))]


WORD_SLOTS = 7 * BUCKETS


def _trigrams(raw: bytes) -> np.ndarray:
    """Hashed slot of each byte trigram."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    t = a[:-2] | a[1:-1] << 8 | a[2:] << 16
    t *= np.uint32(0x9E3779B1)
    return WORD_SLOTS + ((t >> np.uint32(16)) % np.uint32(DIMENSIONS - WORD_SLOTS)).astype(np.int64)


def _votes(rows: DataFrame) -> DataFrame:
    """``(key, pattern)`` of every document."""
    def run(batches):
        for batch in batches:
            found = [code(votes(measures(t.as_buffer().to_pybytes()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["key", "pattern"])

    return rows.mapInArrow(run, "key long, pattern int")


def _features(rows: DataFrame) -> DataFrame:
    """``(key, slots, shares)``: sparse features, trigrams as shares of the text's trigrams."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                slots, shares = [], []
                for t in part.column(1):
                    raw = t.as_buffer().to_pybytes()
                    which, n = np.unique(_trigrams(raw), return_counts=True)
                    words = sorted(_word_features(measures(raw)))
                    slots.append([*words, *which.tolist()])
                    shares.append([*[1.0] * len(words), *(n / max(1, n.sum())).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(slots, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))],
                    ["key", "slots", "shares"])

    return rows.mapInArrow(run, "key long, slots array<int>, shares array<double>")


@F.udf(VectorUDT())
def _vector(slots, shares):
    return Vectors.sparse(DIMENSIONS, slots, shares)


def fit_scorer(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept of the scorer, from about TRAINING_ROWS documents picked by key hash.

    Each picked document counts as good with its posterior and as bad with the rest.
    """
    total = labels.count()
    if not total:
        return np.zeros(DIMENSIONS), 0.0
    share = min(1.0, TRAINING_ROWS / total)
    picked = rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000))))
    sample = _features(picked).join(labels, "key").limit(2 * TRAINING_ROWS)
    sample = save(sample.select("p_good", _vector("slots", "shares").alias("x")), "quality_sample")
    if sample.isEmpty():
        return np.zeros(DIMENSIONS), 0.0
    both = sample.select("x", F.lit(1.0).alias("y"), F.col("p_good").alias("w")).union(
        sample.select("x", F.lit(0.0).alias("y"), (1 - F.col("p_good")).alias("w"))).where("w > 0.0001")
    if both.select("y").distinct().count() < 2:
        return np.zeros(DIMENSIONS), 1.0 if both.first()["y"] else -1.0
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=REGULARISATION, maxIter=60).fit(both)
    return model.coefficients.toArray(), float(model.intercept)


def score(rows: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """``(key, p_good)`` of every document by the linear scorer over its whole text."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, intercept))

    def run(batches):
        w, b = shared.value
        for batch in batches:
            out = []
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                tri = _trigrams(raw)
                z = b + w[_word_features(measures(raw))].sum() + (w[tri].mean() if len(tri) else 0.0)
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["key", "p_good"])

    return rows.mapInArrow(run, "key long, p_good double")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(key, <id_col>, pattern, weak_good, p_good, keep)``: one row per document.

    pattern codes the votes (base 3 in the order of LABELLERS), weak_good is its posterior,
    p_good the scorer's probability; keep is p_good >= threshold.  Null texts count as empty;
    an empty text has only the word features of no words.  Rows with null or equal ids keep one
    result each.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, key = keyed(docs, id_col, text_col)
    named = rows.select(F.col(key).alias("key"), text_of(text_col).cast("binary").alias("text"))
    voted = save(_votes(named), "quality_votes")
    patterns = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    _, _, posterior = expectation_maximisation(patterns)
    table = spark.createDataFrame(sorted(posterior.items()), "pattern int, weak_good double")   # 3**7 rows at most
    labels = voted.join(F.broadcast(table), "pattern")
    weights, intercept = fit_scorer(named, labels.withColumnRenamed("weak_good", "p_good").select("key", "p_good"))
    scored = score(named, weights, intercept)
    result = scored.join(labels, "key").withColumn("keep", F.col("p_good") >= threshold)
    if "row_number" in key:
        result = result.join(rows.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("id")), "key")
    else:
        result = result.withColumn("id", F.col("key").cast(docs.schema[id_col].dataType))
    return result.select("key", F.col("id").alias(id_col), "pattern", "weak_good", "p_good", "keep")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that the classifier keeps."""
    rows, key = keyed(docs, id_col, text_col)
    gone = free_name(rows, "__gone")
    bad = classify(rows, key, text_col, threshold).where("NOT keep").select(F.col("key").alias(gone))
    return rows.join(bad, F.col(key) == F.col(gone), "left_anti").select(*[f"`{c}`" for c in docs.columns])
