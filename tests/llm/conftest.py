import random

import pytest

LONG = "docs of one long text " * 4000

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, c1 int, score string, row int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, short and very long texts, copies, repeated rows, clashing names."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.split()
    near[60] = "changed"
    shared = words(rng, 60)
    texts = [None, "", " \n\t ", "one", base, base, " ".join(near), base + " tail", LONG, LONG + "x", "é" * 150,
             shared + " " + words(rng, 80), words(rng, 90) + " " + shared, words(rng, 30) + " " + shared + " " + words(rng, 40),
             "\x00 nul \x1c sep", "a b c a b c\na b c a b c\na b c a b c", words(rng, 300)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t),
             "clash", i, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, None, None, None, None, None, None, None, None), (None, base, "en", "s1", 1, "x", 1, "y", 2),
             (11, "same id, other text " + words(rng, 60), "de", "s2", 1, "x", 1, "y", 2)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
