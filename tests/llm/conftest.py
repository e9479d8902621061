import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, id string, row string, kept string, n string"


def prose(seed, n_words, vocabulary=400):
    generator = random.Random(seed)
    return " ".join(f"w{generator.randrange(vocabulary)}" for _ in range(n_words))


def edited(text, seed, changes):
    generator = random.Random(seed)
    words = text.split(" ")
    for place in generator.sample(range(len(words)), changes):
        words[place] = f"new{generator.randrange(10_000)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = prose(1, 120)
    texts = [
        None, "", " \t\n", "one", "two words", base, base, edited(base, 2, 2), edited(base, 3, 60), prose(4, 30_000, 3_000),
        "x" * 50_000, "ÀÉÎ çedilla 漢字 😀 " * 20, "line one here\nline one here\n" * 30, prose(5, 80), prose(6, 80),
    ]
    rows = [(i, text, "en", f"s{i % 3}" if i % 5 else None, None, "a", "b", "c", "d", "e", None) for i, text in enumerate(texts)]
    rows += [rows[5], rows[5], rows[13], (None, base, None, None, None, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None, None, None, None), (20, prose(5, 80) + " end", "en", "s1", 1, "", "", "", "", "", "")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
