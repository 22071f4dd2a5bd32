import brute
import numpy as np
import pytest
from conftest import frame, words

from sparkprep.llm import substrings


def result(df):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, substrings.remove_repeats(df).select(*cols).collect()), key=repr)


def order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))


def test_equals_brute_force(documents, docs):
    assert result(documents) == sorted(brute.repeats(docs), key=repr)


def test_null_and_repeated_ids(odd_documents, odd_docs):
    assert result(odd_documents) == sorted(brute.repeats(order(odd_docs)), key=repr)


def test_empty_table(no_documents):
    assert result(no_documents) == []


def test_longer_lead_for_large_groups(spark, monkeypatch):
    """Groups above the size of a cell are split by longer shared bytes until single strings are left."""
    monkeypatch.setattr(substrings, "CELL", 3)
    line, base = words(12, 31)[:60], words(60, 32)
    docs = [(i, words(8, 100 + i) + line + words(8, 200 + i)) for i in range(25)]
    docs += [(50 + i, base[:7 * i] + "#" + base[7 * i + 1:]) for i in range(25)]
    docs += [(90 + i, base) for i in range(5)]
    assert result(frame(spark, docs)) == sorted(brute.repeats(docs), key=repr)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.RandomState(3)
    raw = rng.randint(97, 100, 5000).astype(np.uint8)
    whole = set(substrings.anchors(raw).tolist())
    for start in (0, 13, 700):
        part = substrings.anchors(raw[start:start + 100])
        assert len(part) == 1 and int(part[0]) + start in whole


def test_anchors_across_pieces(monkeypatch):
    raw = np.random.RandomState(4).randint(97, 122, 4000).astype(np.uint8)
    want = substrings.anchors(raw).tolist()
    monkeypatch.setattr(substrings, "PIECE", 333)
    assert substrings.anchors(raw).tolist() == want


def test_multikey_sort_orders_strings():
    rng = np.random.RandomState(5)
    rows = rng.randint(0, 3, (300, 24)).astype(np.uint8)
    rows[:, :12] = rows[0, :12]
    group = rng.randint(0, 4, 300)
    got = substrings.multikey_sort(rows.view(">u8").astype(np.uint64), group)
    keys = [(group[i], rows[i].tobytes()) for i in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_targets_follow_the_order(cuts):
    rng = np.random.RandomState(6)
    lead, around = rng.randint(0, 4, 200).astype(np.uint64), rng.randint(0, 4, 200).astype(np.uint64)
    key, at = rng.randint(0, 9, 200), rng.randint(0, 9, 200)
    tuples = list(zip(lead.tolist(), around.tolist(), key.tolist(), at.tolist()))
    some = sorted(tuples[:cuts])
    got = substrings._target(some, lead, around, key, at)
    assert got.tolist() == [sum(c <= t for c in some) for t in tuples]
