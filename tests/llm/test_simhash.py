import random

import brute
import pytest
from conftest import frame
from pyspark.sql import functions as F

from sparkprep.llm import simhash
from sparkprep.llm.common import connected_components, hex64


def result(df):
    out = simhash.near_duplicates(df).select("doc_id", hex64(F.col("fp")), "component_id").collect()
    return sorted(map(tuple, out), key=repr)


def test_equals_brute_force(documents, docs):
    assert result(documents) == sorted(brute.simhash(docs), key=repr)


def test_null_and_repeated_ids(odd_documents, odd_docs):
    assert result(odd_documents) == sorted(brute.simhash(odd_docs), key=repr)
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ordered = sorted(odd_docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))
    firsts = [ordered[i] for i, r in enumerate(brute.groups(ordered)) if i == r]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(firsts, key=repr)


def test_empty_table(no_documents):
    assert result(no_documents) == [] and simhash.keep_one(no_documents).collect() == []


def test_links_connect_every_pair_within_two_bits(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(120):                 # one dense cloud: chains and hubs
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    ids = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in ids]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bits in (0, 1, 2):
        sets = brute.Union(len(ids))
        for i in range(len(ids)):
            for j in range(i):
                if (ids[i] ^ ids[j]).bit_count() <= bits:
                    sets.join(i, j)
        got = brute.Union(len(ids))
        at = {x: i for i, x in enumerate(signed)}
        for r in simhash.links(df, bits).collect():
            assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= bits
            got.join(at[r.a], at[r.b])
        assert [sets.find(i) for i in range(len(ids))] == [got.find(i) for i in range(len(ids))]
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_components_of_path_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(9)] + [(100, 100 + i) for i in range(30)] + [(300, 300), (501, 500), (500, 501)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {**{i: 0 for i in range(10)}, **{100 + i: 100 for i in range(30)}, 500: 500, 501: 500, 300: 300}
    assert connected_components(df.limit(0)).collect() == []


def test_one_large_group_of_near_copies(spark):
    from conftest import words
    base = words(400, 21).split()
    docs = []
    for i in range(150):
        copy = list(base)
        copy[i * 2] = f"w{i}"
        docs.append((i, " ".join(copy)))
    got = simhash.near_duplicates(frame(spark, docs)).select("doc_id", hex64(F.col("fp")), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.simhash(docs))
