"""Language identification by rank-order profiles.

Method: a profile is the list of the ``PROFILE`` most frequent character n-grams (1 to 3, words
padded with a blank), most frequent first, equal counts in order of the n-gram.  One is learned
for each language from labelled documents; a document's own profile is compared with each by the
out-of-place distance: for every n-gram of the document the difference of its two ranks, or
``PROFILE`` if the language's profile lacks it.  The smallest distance wins.

Words are maximal runs of letters, in lower case.  An n-gram is one long, 21 bits a character, so
that counting is sorting and longs stand in the order of the n-grams.  Learning shuffles
(language, n-gram, count) rows that each task has summed; prediction is one pass over the texts
without a shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save, small_batches

PROFILE = 300
LANGUAGES = 2_000          # languages whose profiles (300 n-grams each) the tasks hold at a time
HELD_GRAMS = 1_000_000     # counted n-grams a learning task holds before it passes them on
UNKNOWN = "und"
BLANK = 32


@functools.cache
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> np.ndarray:
    """Code points of the words, lower case, one blank before, between and after them; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate([[BLANK], np.where(_letter_table()[codes], codes, BLANK), [BLANK]])
    blank = codes == BLANK
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    return codes if len(codes) > 1 else codes[:0]


def grams(codes: np.ndarray) -> np.ndarray:
    """Every n-gram inside a padded word, of one letter, two or three characters."""
    first, second = codes << 42, codes << 21
    inner = codes[1:-1] != BLANK
    return np.concatenate([first[codes != BLANK], first[:-1] | second[1:],
                           (first[:-2] | second[1:-1] | codes[2:])[inner]])


def gram_text(gram: int) -> str:
    return "".join(chr(c) for c in (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF) if c)


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text."""
    found, counts = np.unique(grams(codes), return_counts=True)
    if len(found) > most:                # sort only what can be among them
        among = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
        found, counts = found[among], counts[among]
    return found[np.argsort(-counts, kind="stable")][:most]


def _count(batches):
    """(lang, gram, n) summed over as many texts as ``HELD_GRAMS`` allows."""
    held: dict[str, list] = {}

    def merged(parts):
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows():
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                             ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(letters(text))
        for lang, some in texts.items():
            parts = [np.unique(grams(codes), return_counts=True) for codes in some if len(codes)]
            if parts:
                held[lang] = [merged(held.get(lang, []) + parts)]
        if sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
            yield from rows()
    yield from rows()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, rank, gram)``: a profile for each non-null value of ``lang_col`` that has a letter in its texts.

    Rank counts from 0; ``gram_text`` spells a gram.  Null texts and texts without a letter add nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = (rows.mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return (counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE)
            .select("lang", "rank", "gram"))


class Profiles:
    """Profiles of some languages as one table of ranks, ``PROFILE`` where a language lacks the n-gram."""

    def __init__(self, rows):
        self.langs = sorted({lang for lang, _, _ in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([gram for _, _, gram in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), PROFILE, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank

    def nearest(self, profile: np.ndarray) -> tuple[str, int]:
        """The language with the smallest distance (of equal ones the first by name), and that distance."""
        at = np.searchsorted(self.grams, profile)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == profile[known]
        table = self.ranks[np.where(known, at, len(self.grams))]
        apart = np.where(table == PROFILE, PROFILE, np.abs(table - np.arange(len(profile))[:, None]))
        total = apart.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], int(total[best])


def _nearest(profiles: Profiles, text_at: int):
    """Replaces the last two columns, the best language so far and its share of the largest distance, if beaten."""
    def run(batches):
        for batch in batches:
            langs, apart = [], []
            known = zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)))
            for text, (lang, share) in zip(batch.column(text_at).to_pylist(), known):
                codes = letters(text)
                if len(codes):
                    profile = ranked(codes)
                    found, distance = profiles.nearest(profile)
                    new = distance / (PROFILE * len(profile))
                    if lang is None or (new, found) < (share, lang):
                        lang, share = found, new
                langs.append(lang)
                apart.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs, pa.string()), pa.array(apart, pa.float64())],
                                             names=batch.schema.names)
    return run


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", languages: int = LANGUAGES) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the nearest language, and 1 less its share of the largest distance.

    A null text, one without a letter, and any text if nothing was learned give ``und`` and 0.  Repeated
    rows each count.  Columns of ``docs`` named ``lang_pred`` or ``score`` are replaced.  Profiles are
    sent to the tasks for ``languages`` languages at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    text_at = next(i for i, c in enumerate(kept) if c.lower() == text_col.lower())
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias("lang_pred"),
                       F.lit(None).cast("double").alias("score"))
    profiles = save(profiles, "language_profiles")
    names = profiles.select("lang").distinct()
    blocks = -(-names.count() // languages)
    for block in range(blocks):
        one = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).select("lang", "rank", "gram")
        sent = [tuple(r) for r in one.collect()]
        if sent:
            rows = rows.mapInArrow(_nearest(Profiles(sent), text_at), rows.schema)
            if blocks > 1:
                rows = save(rows, "language_rows")
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                       F.coalesce(1 - F.col("score"), F.lit(0.0)).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal id is divisible by 5; a null id is not held out, and teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(<id_col>, held_out, lang_pred, score)``: learned from the documents that are not held out, asked of all."""
    ident = F.col(f"`{id_col}`")
    taught = learn(docs.where(ident.isNotNull() & ~held_out(ident)), text_col, lang_col)
    asked = docs.select(ident.alias("id"), held_out(ident).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return predict(asked, taught).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
