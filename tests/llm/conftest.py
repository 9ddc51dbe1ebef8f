import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, n string, label long, key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, columns with clashing names."""
    rng = random.Random(4)
    words = ["the", "of", "and", "lorem", "Ipsum", "dolor,", "sit.", "é̂té", "naïve", "日本", "x", "a1b2", "don't", "</w>", "▁a"]
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 25, 90]))) + rng.choice(["", " ", "\n", "\t\n x"])
        rows.append((i, text, rng.choice(["en", "de", None]), f"s{i % 3}", len(text), 0.5, 7, "n", i, "k"))
    rows += [(40, None, None, None, None, None, None, None, None, None), (41, "", "en", "s1", 0, 0.0, 1, "", 0, ""),
             (42, " \n\t ", "en", "s1", 4, 0.0, 1, "", 0, ""), (43, "word " * 60_000, "en", "s2", 300_000, 0.1, 2, "q", 3, "z"),
             (44, "y" * 150_000, "en", "s2", 150_000, 0.1, 2, "q", 3, "z")]
    rows += [rows[3], rows[3], (45, rows[3][1], *rows[3][2:]), (46, rows[5][1], *rows[5][2:])]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SF = "/root/testdata/sf0.001"
