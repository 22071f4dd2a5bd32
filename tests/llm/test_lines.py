import random

import brute
import pytest
from conftest import frame, words

from sparkprep.llm import lines


def expected(docs):
    return brute.duplicate_lines(docs, lines.normal, lines.shingles, lines.SIMILARITY)


def dropped(df):
    return {(r.doc_id, d.line): (d.keep_id, d.keep_line) for r in lines.report(df).collect() for d in r.dropped or []}


def near(line, edits, seed):
    rng = random.Random(seed)
    chars = list(line)
    for _ in range(edits):
        chars[rng.randrange(len(chars))] = rng.choice("qrstuv")
    return "".join(chars)


@pytest.fixture(scope="module")
def more_docs(docs):
    base = [words(30, 50 + i) for i in range(12)]
    extra = [(100 + i, "\n".join([near(base[i % 12], i % 4, i), "", base[(i + 5) % 12], words(12, 900 + i), "  " + base[i % 12].upper()]))
             for i in range(40)]
    return docs + extra


def test_equals_brute_force_and_texts_follow(spark, more_docs):
    df = frame(spark, more_docs)
    want = expected(more_docs)
    assert dropped(df) == want
    kept = lines.drop_duplicate_lines(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    assert got == {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in more_docs}


def test_large_group_is_compared_in_cells(spark, monkeypatch):
    """Every two lines of a group meet, also when it is spread over chunks and over targets."""
    monkeypatch.setattr(lines, "GROUP", 8)
    monkeypatch.setattr(lines, "HOT", 4)
    base = words(40, 77)
    docs = [(i, near(base, i % 9, i) + f"{i:03d}") for i in range(90)]
    assert dropped(frame(spark, docs)) == expected(docs)


def test_null_and_repeated_ids(odd_documents, odd_docs):
    rows = lines.report(odd_documents).collect()
    assert len(rows) == len(odd_docs)
    kept = lines.drop_duplicate_lines(odd_documents).collect()
    seen = [lines.normal(x) for r in kept for x in (r.text or "").split("\n") if lines.normal(x)]
    assert len(kept) == len(odd_docs) and len(seen) == len(set(seen))
    assert {lines.normal(x) for _, t in odd_docs for x in (t or "").split("\n")} - {""} >= set(seen)


def test_empty_table(no_documents):
    assert lines.report(no_documents).collect() == [] and lines.drop_duplicate_lines(no_documents).collect() == []


def test_signature_is_that_of_the_line_alone():
    some = [words(n, n) for n in (1, 2, 5, 30, 400, 3, 60)] + ["x", "exactly8", "🙂 漢字 text that is long enough"]
    together = lines.signatures(some)
    for i, x in enumerate(some):
        assert (lines.signatures([x])[0] == together[i]).all()


def test_similar_lines_share_a_band():
    missed = 0
    for i in range(400):
        a = words(35, i)
        b = near(a, 2, i)
        one, two = lines.shingles(lines.normal(a)), lines.shingles(lines.normal(b))
        if len(one & two) < 0.8 * len(one | two):
            continue
        keys = lines.band_keys(lines.signatures([lines.normal(a), lines.normal(b)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 2


@pytest.mark.parametrize("letters", ["abé", "ab漢é🙂"])
def test_similarity_is_exact(letters):
    rng = random.Random(9)
    for n in (1, 7, 8, 9, 15, 16, 17, 60, 200):
        for edits in (0, 1, 2, 5):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = near(a, edits, n) if edits else a
            one, two = lines.shingles(a), lines.shingles(b)
            assert lines.similar(lines._Compared(a), lines._Compared(b)) == (len(one & two) >= 0.8 * len(one | two))
