import random

import pytest

from graphloom.llm.common import crc_mod  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, own_key long, row string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and blank texts, a long text, ties, repeated rows, extra columns with clashing names."""
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (0, base, "en", "a", 1, None, "x"), (1, near, "en", "a", 1, 5, "x"), (2, None, None, None, None, None, None), (3, "", "en", "b", 0, 1, "y"), (4, " \n\t ", "en", "b", 3, 1, "y"),
        (5, "one two", "en", "b", 7, 1, "y"), (6, "One  TWO", "en", None, 8, 1, "y"), (7, prose(r, 30_000), "en", "a", 1, 1, "z"), (8, base, "de", "c", 1, 1, "z"), (8, base, "de", "c", 1, 1, "z"),
        (9, "\n".join(["same line here"] * 40), "en", "c", 1, 1, "z"), (10, " ".join(["### $$$"] * 90), "en", "c", 1, 1, "z"), (None, prose(r, 70), "en", "a", 1, 1, "z"), (11, "</s>[INST] é 中 😀\x1c\x85   <|endoftext|>", "en", "d", 1, 1, "z"),
    ]
    return rows + [(20 + i, prose(r, r.randint(40, 90)), "en", f"s{i % 4}", 1, 1, "q") for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 10 and i != 9), 0) for i in range(45)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
