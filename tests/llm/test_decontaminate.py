import random

import brute
import pytest
from conftest import frame, words

from sparkprep.llm import decontaminate as dec


def edit(text, n, seed):
    rng = random.Random(seed)
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out))
        what = rng.randrange(3)
        out[p:p + 1] = [] if what == 0 else [rng.choice("xyz")] if what == 1 else [out[p], rng.choice("xyz")]
    return "".join(out)


ITEMS = [(i, words(n, 700 + i).capitalize() + ".") for i, n in enumerate((3, 6, 8, 14, 20, 40))] + [(6, None), (7, ""), (8, "tiny")]


def expected(docs, items, match=dec.Match()):
    """(doc, item) -> (segments found, fewest edits) by whole dynamic programming."""
    out = {}
    for d, text in docs:
        for i, item in items:
            t, x = dec.normal(text or ""), dec.normal(item or "")
            if len(x) < max(match.least, dec.Q):
                continue
            starts = sorted({*range(0, max(1, len(x) - match.segment + 1), match.stride), max(0, len(x) - match.segment)})
            edits = []
            for s in starts:
                segment = x[s:s + match.segment]
                e = brute.best_substring_edits(segment, t)
                if e <= match.budget(len(segment)):
                    edits.append(e)
            if edits:
                out[d, i] = (len(edits), min(edits))
    return out


@pytest.fixture(scope="module")
def doc_list():
    docs = [(i, words(25, 40 + i)) for i in range(4)]
    n = 10
    for i, item in ITEMS[1:6]:
        for k, e in enumerate((0, 2, 5, 7, 9, 14)):
            docs.append((n, words(12, n) + " " + edit(item, e, n) + " " + words(9, 2 * n)))
            n += 1
    docs += [(90, ITEMS[5][1].upper().replace(" ", "  \n")), (91, ITEMS[5][1][60:160]), (92, ITEMS[3][1][:40] + ITEMS[4][1][40:]),
             (93, None), (94, ""), (95, ITEMS[2][1] + ITEMS[2][1])]
    return docs


def result(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_segments, r.edits) for r in dec.contaminated(frame(spark, docs), bench).collect()}


def test_equals_whole_alignment(spark, doc_list):
    assert result(spark, doc_list, ITEMS) == expected(doc_list, ITEMS)


def test_blocks_of_the_benchmark_and_of_text(spark, doc_list, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_CHARS", 200)
    monkeypatch.setattr(dec, "TEXT_CHARS", 300)
    assert result(spark, doc_list, ITEMS) == expected(doc_list, ITEMS)


def test_drop_keeps_the_clean(spark, doc_list, odd_documents, no_documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = frame(spark, doc_list)
    kept = dec.drop_contaminated(df, bench)
    bad = {d for d, _ in expected(doc_list, ITEMS)}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in doc_list} - bad
    assert dec.drop_contaminated(odd_documents, bench).count() == odd_documents.count()
    assert dec.drop_contaminated(no_documents, bench).collect() == []
    assert dec.drop_contaminated(df, bench.limit(0)).count() == len(doc_list)


def test_null_and_repeated_ids(spark):
    item = ITEMS[4][1]
    docs = [(None, item), (None, words(9, 1)), (1, item), (1, words(9, 2)), (1, item)]
    bench = spark.createDataFrame(ITEMS + [(4, item)], "item_id long, text string")
    found = dec.contaminated(frame(spark, docs), bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 1), (False, 1), (True, 0)]
    assert sorted((r.doc_id or 0, r.text) for r in dec.drop_contaminated(frame(spark, docs), bench).collect()) == sorted(
        [(0, docs[1][1]), (1, docs[3][1])])


def test_a_passage_is_found_wherever_it_starts(spark):
    item = dec.normal(words(70, 31))[:300]
    docs = [(a, words(6, 900 + a) + " " + item[a:a + 80] + " " + words(6, 1300 + a)) for a in range(len(item) - 79)]
    docs.append((1000, words(6, 5) + " " + item[50:140] + " " + words(6, 6)))
    got = result(spark, docs, [(1, item)])
    assert {d for d, _ in got} == {d for d, _ in docs} and {e for _, e in got.values()} == {0}


def test_edited_passages_equal_brute_force_at_every_start(spark):
    item = dec.normal(words(50, 32))[:200]
    docs = [(a, words(6, a) + " " + edit(item[a:a + 82], e, a) + " " + words(6, 50 + a)) for a, e in ((7, 4), (25, 6), (58, 8), (99, 9))]
    assert result(spark, docs, [(1, item)]) == expected(docs, [(1, item)], dec.Match(stride=1))


def test_short_items_are_found_whole_between_word_borders(spark):
    items = [(1, "What is 6 x 7?"), (2, "abcdefgh"), (3, "tiny"), (4, "(parens) here")]
    docs = [(1, "Q: WHAT is\n6 x 7? 42"), (2, "what is 6 x 8?"), (3, "xabcdefgh abcdefghx"), (4, "an abcdefgh, abcdefghx"), (5, "tiny"),
            (6, "see(parens) here."), (7, "abcdefgh"), (8, "no abcdefg")]
    assert result(spark, docs, items) == {(1, 1): (1, 0), (4, 2): (1, 0), (6, 4): (1, 0), (7, 2): (1, 0)}
    long = dec.normal(words(50, 32))[:200]
    assert result(spark, [*docs, (9, "x " + long[33:120])], [*items, (5, long)])[9, 5][1] == 0
