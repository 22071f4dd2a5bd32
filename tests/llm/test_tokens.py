import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkprep.llm import packing, queries, token_files, tokens

NAME, VOCABULARY, END = queries.TOKENIZER, queries.VOCABULARY, queries.END_ID
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
ENCODER = tokens.TextEncoder(tokens.tokenizer_file(NAME))


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aZé'ßÜ.,!|<>s d\n\t0"), st.characters(codec="utf-8")), max_size=40))
def test_word_by_word_equals_the_library(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), ENCODER.dtype).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a<|startoftext|>b <|endoftext|", "it's l'eau IT'S", "é É.", "ΣΑΣ ς İ", "a b c\x1cd"])
def test_special_words(text):
    assert np.frombuffer(ENCODER.encode(text.encode()), ENCODER.dtype).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_gets_the_whole_text():
    other = tokens.TextEncoder(tokens.tokenizer_file("byte_bpe_50k.json"))
    assert not other.by_word
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" Hello  world", add_special_tokens=False).ids
    assert np.frombuffer(other.encode(b" Hello  world"), other.dtype).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, (1 << 32) - 1)), max_size=60))
def test_coding_round_trip(values):
    control, data = token_files.encode(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert token_files.decode(control, data, len(values)).tolist() == values


def order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))


@pytest.mark.parametrize("kind", ["documents", "odd_documents"])
def test_files_round_trip(kind, docs, odd_docs, request):
    given_docs = order(docs if kind == "documents" else odd_docs)
    want, at = [], 0
    for i, t in given_docs:
        x = ids(t)
        want.append((i, at, len(x), crc(x), x))
        at += len(x)
    found = token_files.round_trip(request.getfixturevalue(kind), tokens.tokenizer_file(NAME), VOCABULARY, END)
    got = sorted(((r.id, r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) for r in found.collect()),
                 key=lambda r: r[1])
    assert got == want


def test_files_of_nothing(no_documents):
    assert token_files.round_trip(no_documents, tokens.tokenizer_file(NAME), VOCABULARY, END).collect() == []


def test_most_frequent_id_has_rank_zero(spark, documents, docs):
    path = token_files.scratch_path(spark, "files")
    token_files.write(documents, path, tokens.tokenizer_file(NAME), VOCABULARY, END)
    counts = np.bincount([x for _, t in docs for x in ids(t)], minlength=VOCABULARY)
    ranks = {r.rank: r.token for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert [ranks[i] for i in range(50)] == np.lexsort((np.arange(VOCABULARY), -counts))[:50].tolist()


def check_pieces(pieces, texts, limit=4096):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for i, t in texts:
        at, want = 0, ids(t)
        for p in sorted(by_doc.pop(i), key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == crc(want[at:at + p["length"]])
            at += p["length"]
        assert at == len(want)
    assert not by_doc
    padding = 0
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
        padding += limit - at if at & (at - 1) else 0
    return padding


def test_documents_are_packed_whole(documents, docs):
    padding = check_pieces([r.asDict() for r in queries.pack_documents(documents).collect()], docs)
    assert padding < 0.05 * sum(len(ids(t)) for _, t in docs)


def test_packing_null_and_repeated_ids(odd_documents, odd_docs, no_documents):
    rows = queries.pack_documents(odd_documents).collect()
    assert sum(r.length for r in rows) == sum(len(ids(t)) for _, t in odd_docs)
    assert {r.doc_id for r in rows} == {i for i, _ in odd_docs}
    assert queries.pack_documents(no_documents).collect() == []


def test_limits_hold_in_all_dimensions(spark):
    rng = np.random.RandomState(8)
    rows = []
    for i in range(1500):
        n = int(rng.choice([3, 40, 200, 900]) + rng.randint(0, 30))
        cut = int(rng.randint(0, n))
        loss = [[cut, n]] if i % 5 else None if i % 2 else []
        rows.append((i, rng.randint(0, 60_000, n).astype("<u2").tobytes(), loss))
    rows += [(9_000, b"", None), (9_001, None, [[0, 5]])]
    df = spark.createDataFrame(rows, "id long, ids binary, loss array<array<int>>").select(
        "id", "ids", F.transform("loss", lambda x: F.struct(x[0].alias("s"), x[1].alias("e"))).alias("loss"))
    limits = packing.Limits(tokens=512, segments=6, loss=300)
    pieces = packing.pack(df.repartition(2), limits).collect()
    used, held = {}, {}
    for p in pieces:
        t, s, b = used.get(p.sequence_id, (0, 0, 0))
        used[p.sequence_id] = (t + p.length, s + 1, b + p.loss_tokens)
        held[p.id] = held.get(p.id, 0) + p.length
    assert all(t <= 512 and s <= 6 and b <= 300 for t, s, b in used.values())
    assert held == {i: len(x) // 2 for i, x, _ in rows if x}
    loss = sum(p.loss_tokens for p in pieces)
    assert loss == sum(len(x) // 2 if y is None else sum(e - s for s, e in y) for _, x, y in rows if x)
    # a sequence is full in one of the three, or nearly
    lower = max(sum(t for t, _, _ in used.values()) / 512, sum(s for _, s, _ in used.values()) / 6, loss / 300)
    assert len(used) < 1.25 * lower + 10
    with pytest.raises(ValueError):
        packing.Limits(tokens=0)


def test_long_example_is_cut(spark):
    df = spark.createDataFrame([(1, np.arange(10_000, dtype="<u2").tobytes()), (2, words(3, 1).encode()[:10])], "id long, ids binary")
    pieces = packing.pack(df.coalesce(1), packing.Limits(tokens=1024, segments=4, loss=1024)).collect()
    assert sum(p.length for p in pieces) == 10_005 and max(p.length for p in pieces) <= 1024
