"""Quality classifier and cross-entropy difference."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import frame, words

from sparkprep.llm import crossentropy, quality


def prose(i):
    rng = random.Random(i)
    return ". ".join(words(rng.randint(6, 14), 1000 * i + k).capitalize() for k in range(rng.randint(4, 9))) + "."


def junk(i):
    text = prose(i)
    kind = i % 4
    if kind == 0:
        return " ".join(w + "***" for w in text.split())
    if kind == 1:
        return text.upper().replace(" ", "!! ") + "!!"
    if kind == 2:
        return " ".join(w for x in text.split()[:6] for w in [x] * 12)
    return "\n".join([" | ".join(text.split()[:5]) + " |"] * 12)


@pytest.fixture(scope="module")
def labelled():
    return [(i, junk(i) if i % 6 == 0 else prose(i)) for i in range(480)]


def test_held_out_accuracy(spark, labelled, monkeypatch):
    monkeypatch.setattr(quality, "TRAINING_ROWS", 300)           # the rest is held out
    rows = {r.doc_id: r for r in quality.classify(frame(spark, labelled)).collect()}
    assert len(rows) == len(labelled)
    right = sum(rows[i].keep == (i % 6 != 0) for i, _ in labelled)
    clean = sum(rows[i].keep for i, _ in labelled if i % 6)
    assert right >= 0.97 * len(labelled) and clean >= 0.99 * len([i for i, _ in labelled if i % 6])
    kept = quality.keep_good(frame(spark, labelled))
    assert {r.doc_id for r in kept.collect()} == {i for i in rows if rows[i].keep}


def test_posteriors_follow_from_the_counts(labelled):
    patterns = Counter(quality.code(quality.votes(quality.measures(t.encode()))) for _, t in labelled)
    prior, rates, posterior = quality.expectation_maximisation(patterns)
    assert abs(prior - 5 / 6) < 0.05
    assert all(g > 0.5 for g, _ in quality.accuracies(rates).values())
    for p, got in posterior.items():                              # Bayes' rule over the votes cast
        odds = prior / (1 - prior)
        for i, v in enumerate(quality.decode(p)):
            if v:
                odds *= rates[1, i, v] / rates[0, i, v]
        assert abs(got - odds / (1 + odds)) < 1e-4
    assert quality.expectation_maximisation({})[2] == {}


def test_votes_code_round_trip():
    for p in (0, 1, 5, 2186):
        assert quality.code(quality.decode(p)) == p


def test_quality_odd_rows(odd_documents, odd_docs, documents, no_documents):
    assert quality.classify(odd_documents).count() == len(odd_docs)
    kept = quality.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns
    assert quality.classify(documents).where("p_good IS NULL OR keep IS NULL").count() == 0
    assert quality.classify(no_documents).collect() == [] and quality.keep_good(no_documents).collect() == []


def losses(spark, df, ids):
    targets = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return crossentropy.score(df, targets).collect()


def test_cross_entropy_equals_brute_force(spark, documents, docs, monkeypatch):
    chosen = [1, 4, 5, 11, 19, 1, 999, None]
    want = brute.cross_entropy(docs, set(chosen))
    for block in (crossentropy.BLOCK_GRAMS, 3_000):               # one block of the table, and several
        monkeypatch.setattr(crossentropy, "BLOCK_GRAMS", block)
        got = {r.doc_id: r for r in losses(spark, documents, chosen)}
        assert set(got) == set(want)
        for i, (n, target, background) in want.items():
            assert got[i].n_tokens == n
            if n:
                assert got[i].loss_target == pytest.approx(target, abs=1e-9)
                assert got[i].loss_background == pytest.approx(background, abs=1e-9)
                assert got[i].xent_diff == pytest.approx(target - background, abs=1e-9)
            else:
                assert got[i].loss_target is None and got[i].xent_diff is None


def test_cross_entropy_odd_rows(spark, odd_documents, odd_docs, no_documents):
    rows = losses(spark, odd_documents, [3, None])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in odd_docs)
    assert losses(spark, no_documents, [1]) == []
    uniform = losses(spark, odd_documents, [])
    assert len({round(r.loss_target, 9) for r in uniform if r.n_tokens}) == 1


def test_lookup_finds_what_is_there():
    keys = np.unique(np.random.RandomState(1).randint(0, 1 << 62, 5000).astype(np.uint64))
    table = crossentropy.Lookup(keys)
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert crossentropy.Lookup(keys[:0]).find(keys[:3]).tolist() == [-1, -1, -1]
