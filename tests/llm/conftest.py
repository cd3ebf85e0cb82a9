import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, equal texts, and texts of white space only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    long = " ".join(word() for _ in range(9000))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(rng.randint(1, 160))) for _ in range(30)]
    near = [" ".join("X" if i == 20 else w for i, w in enumerate(b.split(" "))) for b in base[:12]]
    texts = [None, "", " \t\n", "One", "one", "two words", "Two Words", long, long.upper(), long + " more", *base, *base[:5], *near, f"{base[0]} {passage} tail", f"head {passage}", passage, f"{passage} {passage}", "a " * 300, "a " * 301, "  lead and  double  ", "日本語 テキスト 'quoted' don't 12,5"]
    rows = [(i * 3 % 101, t, "en" if i % 2 else None, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], rows[13], (None, "no id at all", None, None, None), (None, base[3], None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    out = odd_docs
    for c in ("n", "node", "score", "kept", "keep_id", "group_size", "part", "length", "predicted", "held_out", "piece", "key", "fps", "word"):
        out = out.withColumn(c, F.lit("clash"))
    return out
