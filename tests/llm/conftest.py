from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from tests.conftest import DATA


@pytest.fixture(scope="session")
def folder():
    return str(DATA)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp string, ROW int,"
    " `key` map<string,int>, Words array<int>, salt string, `a.b` string, label double"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, equal ids, columns whose names clash."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    prose = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rest = ("en", "src0", 3, "x", 1, {"a": 1}, [1], "s", "dot", 0.5)
    rows = [
        (1, prose[0], *rest), (1, prose[0], *rest), (2, prose[0], *rest), (2, prose[1], *rest),
        (None, prose[2], *rest), (None, prose[2], *rest), (None, None, *rest), (3, None, *rest), (4, "", *rest),
        (5, " \n\t ", *rest), (6, long, *rest), (7, "x" * 300_000, *rest), (8, "one", *rest),
        (9, prose[3] + "\n" + prose[4], *rest), (10, prose[4].upper() + "\n" + prose[5], *rest),
        (11, "mail a.b@c.de or 10.0.0.1 é", None, None, None, *rest[3:]),
        (12, prose[5], *([None] * 10)),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([Row(doc_id=1, quality=1, toxic=0), Row(doc_id=7, quality=0, toxic=0)])


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (None, "lonely item words"),
         (3, None), (4, "..."), (5, "short item"), (5, "short item")],
        "item_id long, text string",
    )
