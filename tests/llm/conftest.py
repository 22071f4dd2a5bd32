import os
import random
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


#: documents plus columns named like the operators' own.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("id", T.StringType()), T.StructField("row_key", T.LongType()),
    T.StructField("line", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("component", T.LongType()),
])


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus():
    """[(id, text)]: copies, near copies, shared passages, empty, null, very short and long texts."""
    base, passage = words(120, 1), words(60, 2)
    line = "A line that many documents have, word for word."
    docs = [base, base, base.replace(" ", "  ", 3), base[:300] + " changed " + base[310:], None, "", "   \n\t", "One", "Two words",
            passage, words(30, 3) + " " + passage + " " + words(30, 4), words(10, 5) + passage[7:] + words(10, 6),
            line + "\n" + words(40, 7), line + "\n" + words(40, 8) + "\n" + line, line.replace("many", "some"),
            "\n\n" + words(300, 9) + "\n" + words(25, 10), words(25, 10) + "!", "a" * 350, "ab" * 150 + "ba" * 60,
            "Größe ümläut 漢字 " + "🙂" * 120, "x" * 99, "x" * 100, words(5000, 11)]
    return list(enumerate(docs))


def frame(spark, docs):
    rows = [(i, t, "en", "k", "i", 1, "l", "f", 7) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, docs):
    """Unique ids."""
    return frame(spark, docs).cache()


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Null and repeated ids and whole repeated rows."""
    return docs[:12] + [(3, docs[3][1]), (3, "another text under the same id"), (None, docs[0][1]), (None, None), (None, None)]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_docs):
    return frame(spark, odd_docs).cache()


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
