import random

import pytest

CLASHING = "size long, shard int, measured string, failed_rules long, fp long, key string, quality_score double, t int, n long, rank long, cell string, word string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls in every column, empty, blank and very long texts, and a row that stands twice."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(12, 90)) for _ in range(60)]
    texts = base + [base[3]] * 7 + [base[5] + " tail"] + [base[8].upper()] + [prose(rng, 9000), "", " \t\n", None, None, "one", "two words", "Ünï çödé 漢字 😀 ok"]
    out = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[2], (None, base[9], None, None, None), (None, None, None, None, None)]
    return [r + (7,) * 2 + ("x", 7, 7, "x", 7.0, 7, 7, 7, "x", "x") for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
