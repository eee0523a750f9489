import random

import pytest

from scorewell.llm.ship import ship

COMMON = "the of and to in a is that it for on was".split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def prose(rng, n):
    syllables = "ta ri mo ken sul va der pin lo gar est uni".split()
    words = [rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty, blank and long texts, repeats, near copies and a hot source."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randint(5, 120)), "en", f"s{i % 4}" if i % 3 else "hot", 0) for i in range(120)]
    out += [(200 + i, out[7][1], "en", "hot", 0) for i in range(15)]
    long = prose(rng, 900)
    out += [(300, long, "en", "s1", 1), (301, long + " tail", "fr", "s1", 1), (302, long.replace("the", "the", 1) + " end", "en", "s2", 1)]
    out += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n\t ", "en", None, 0), (403, prose(rng, 30_000), "en", "s3", 0)]
    out += [(3, out[3][1], "en", "s3", 0), (None, prose(rng, 20), None, "s2", None), (404, "Ünïcode 😀 text here  \x0b twice\n\nlines\n", "de", "s0", 9)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
