import random

import brute
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import prefix_trie as trie

KIND = "conv_id long, turn long, role string, text string, conv string, x long, depth string, t string"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "c", 1, "d", "t") for r in rows], KIND).repartition(parts)
    out = trie.digest(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def expected(rows):
    return sorted(brute.prefix_trie(brute.rebuilt(rows)), key=repr)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL_CONVERSATIONS", 3), ("WINDOW", 4), ("BLOCK", 5), ("BUCKETS", 2)):
        monkeypatch.setattr(trie, name, value)


def conversations(n=60, seed=1):
    rng = random.Random(seed)
    lines = ["hello there", "hi", "how are you", "", "two\twords", "bye  now"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(lines)))
    return rows


def test_equals_brute_force(spark, small):
    rows = conversations()
    rows += [(200 + i, t, "user", f"the same {t}") for i in range(25) for t in range(6)]       # copies, longer than a window
    rows += [(300, t, "user", f"long {t // 3}") for t in range(40)] + [(301, t, "user", f"long {t // 3}") for t in range(33)]
    assert run(spark, rows) == expected(rows)


def test_production_sizes(spark):
    rows = conversations(120, 2)
    assert run(spark, rows) == expected(rows)


def test_odd_rows(spark, small):
    rows = [(20, None, "user", "null turn first"), (20, -1, "user", None), (20, 3, None, "no role"), (20, 3, "", "no role"),
            (20, 3, "user", "tie"), (20, 3, "user", "tie"), (20, 3, "user", "another"), (None, 1, "user", "no conversation"),
            (25, 1, "a", "b"), (25, 2, "ab", ""), (26, 1, "", "ab"), (27, 1, None, None), (28, 1, "a", "b"),
            (41, 1, "user", "its source is absent"), (43, 1, "x", "y"), (44, 1, "x", "y"), (45, 1, "x", "y"),
            (60, 5, "🙂", "x" * 5000 + " y"), (60, 6, "é", " not blank\x0bblank")]
    assert run(spark, rows) == expected(rows)
    assert any(not t for t in brute.rebuilt(rows).values())            # one is left without a turn


def test_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b")]) == []


def test_walk_intersects_postings():
    a, b, c = (1, 10), (2, 20), (4, 40)
    found = {node: bin(members) for *_, node, members in trie.walk([[a, b], [a, c], [a, b], [b]], [(0, 0)] * 4)}
    assert found == {a: "0b111", (1 ^ 2, 10 ^ 20): "0b101", (1 ^ 4, 10 ^ 40): "0b10", b: "0b1000"}


def test_a_long_conversation_spreads_over_tasks(spark, small):
    rows = spark.range(400).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                                   F.col("id").cast("string").alias("text"))
    placed, places = trie._numbered(trie.turns_of(rows))
    sizes = sorted(r["n"] for r in places.collect())
    assert sum(sizes) == 400 and sizes[-1] < 250
    assert sorted(r["depth"] for r in trie.sequences(trie.turns_of(rows)).collect()) == list(range(401))
