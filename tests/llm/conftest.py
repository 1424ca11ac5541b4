import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, long and repeated texts, ties, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "über", "naïve", "x", "12", "b.c@d.org", "10.0.0.1", "+1 (555) 123-4567"]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(25)]
    long = " ".join(rng.choices(words, k=20_000))
    shared = " ".join(rng.choices(words, k=70))
    texts = [*prose, None, "", " ", "\n\n", "\t a\x0b b\x0c\r\n", prose[0], prose[0], prose[0] + " ", prose[3].replace(" ", "\n"), long, long + "\nend of it all",
             "The same long line\nfirst", "second\n  THE SAME long line \nthe same long line", "x " + shared + " y", shared, "z\n" + shared.replace(" ", "\n"), "漢字 かな 🙂 ▁  ", "1" * 5000, "a" * 5000, "@" * 300, None]
    rows = [(k, text, rng.choice(["en", "de", None]), None if k % 3 else "s", None) for k, text in enumerate(texts)]
    return [*rows, rows[0], (None, prose[1], "en", "s", 1), (None, None, None, None, None), (7, "same id, other text", "en", None, 2)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def plain_rows(odd_rows):
    """The odd rows whose id is there and alone."""
    seen = [row[0] for row in odd_rows]
    return [row for row in odd_rows if row[0] is not None and seen.count(row[0]) == 1]


@pytest.fixture(scope="session")
def plain(spark, plain_rows):
    return spark.createDataFrame(plain_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clashing(df):
    """``df`` with columns of the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "size head slot map key body tag line lines pos h1 h2 owner range sent at tie fingerprint rep prefix spans found score host removed rest".split()
    return df.withColumns({name: F.lit("clash") for name in names})
