"""Awkward documents that every operator on texts must take."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, hash string, keep_id int, spans string, row int, id string, code string, component_id string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    long = words(70, 1)
    return [
        (1, None), (2, ""), (3, "   \t\n"), (4, "Same Text"), (5, "same text"), (6, "SAME text"), (6, "SAME text"),
        (7, "same  text"), (8, long), (9, "x " + long + " y"), (10, long.upper()), (None, "no id " + long), (None, None),
        (11, "ÄÖÜ ß é é 你好 😀 \x00 \x1c \x85"), (12, words(5000, 2)), (13, "a" * 30_000), (14, words(49, 3)), (15, words(50, 4)),
        (16, words(50, 4)), (17, words(30, 5) + " " + long), (18, "<|endoftext|> a<|startoftext|>b <|endof"), (19, "one"), (20, "one two three"),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame([(i, t, "h", 1, "s", 2, "i", "c", "p") for i, t in awkward_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
