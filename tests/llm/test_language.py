import brute
import numpy as np
import pytest
from conftest import words

from sparkprep.llm import language

KIND = "doc_id long, text string, lang string, score string, lang_pred string, id string, held_out string"


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(*d, "s", "l", "i", "h") for d in docs], KIND).repartition(parts)
    out = language.identify(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return sorted(((r[0], r[1], r[2], round(r[3], 12)) for r in out.collect()), key=repr)


def expected(docs):
    return sorted(((i, o, p, round(s, 12)) for i, o, p, s in brute.languages(docs)), key=repr)


def corpus():
    docs = [(i, words(40, i) if i % 3 else words(30, i).replace("a", "é").replace("b", "ß").upper(), "xy"[i % 3 == 0]) for i in range(80)]
    docs += [(100, None, "x"), (101, "", "y"), (102, "123 -- 456", "x"), (103, "ǅ İI ﬁ ² Ⅷ", None), (104, "x" * 700, "y"),
             (105, "漢字かな交じり文" * 40, "z"), (106, "漢字 かな", None), (None, words(30, 5), "x"), (None, "only here", "w"),
             (7, words(9, 7), "x"), (7, words(9, 7), "x"), (108, "a", None), (109, words(30, 9), ""), (110, " \t\n🙂", "x"),
             (111, "tie tie", None)]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    assert run(spark, docs) == expected(docs)


def test_languages_in_blocks(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    taught = language.learn(df)
    once = language.predict(df, taught)
    blocks = language.predict(df, taught, languages=1)
    assert sorted(once.collect(), key=repr) == sorted(blocks.collect(), key=repr)
    assert once.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_nothing_learned_and_nothing_asked(spark):
    docs = [(1, "some words", None), (2, None, None), (3, "1 2 3", None)]
    assert run(spark, docs) == [(i, o, "und", 0.0) for i, o, _, _ in expected(docs)]
    assert run(spark, []) == []


def test_partial_counts_add_up(spark, monkeypatch):
    docs = corpus()
    whole = sorted(language.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect())
    monkeypatch.setattr(language, "HELD_GRAMS", 10)
    assert sorted(language.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()) == whole


@pytest.mark.parametrize("text", ["ab a", "one", "", "a  b", "Ünï-cöde"])
def test_grams_are_inside_padded_words(text):
    got = sorted(language.gram_text(g) for g in language.grams(language.letters(text)).tolist()) if len(language.letters(text)) else []
    want = []
    for w in brute.re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        want += [*w, *(p[i:i + 2] for i in range(len(p) - 1)), *(p[i:i + 3] for i in range(len(p) - 2))]
    assert got == sorted(want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98 and all(0 <= r.score <= 1 for r in found)
