import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, DOCUMENTS + extra)
    return make


@pytest.fixture
def dice():
    return random.Random(5)


@pytest.fixture(scope="session")
def edge(documents):
    """Null in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_line = "word " * 30_000
    many_lines = "\n".join(f"line number {i} of a long text" for i in range(3_000))
    rows = [(1, "same text of two rows, long enough to have a set", "en", "s", 1), (1, "same text of two rows, long enough to have a set", "en", "s", 1),
            (2, None, None, None, None), (None, "a row without an id", "en", "s", 3), (None, None, None, None, None),
            (3, "", "en", "s", 0), (4, " \n\t ", "en", "s", 4), (5, long_line, "en", "s", 1), (6, many_lines, "en", "s", 1),
            (7, "café 日本 🎉 ▁ <|endoftext|> \x1c\x1f", "fr", "s", 1), (7, "one id, another text", "en", "s", 1)]
    names = "node key n ids bits doc tag at first sim hash item tokens length around low _id _text word host path rule score shard start component_id".split()
    rows = [(*r, *([k] * len(names))) for k, r in enumerate(rows)]
    return documents(rows, "".join(f", `{n}` int" for n in names))


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
