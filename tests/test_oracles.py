"""Registered queries over files, forms and draws against their SQL, on the smallest tables."""

import duckdb
import pytest

from quillmark import queries as Q
from quillmark.plans import files, forms

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted([*files.QUERIES, *forms.QUERIES, "leakage_scrub", "sectionize", "sentence_windows", "snippet_cap", "word_chunks", "classify_codes", "ptp_check", "aoc_check", "constrained_decode", "history_crosswalk", "cohort_selection"])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_every_query_but_the_fitted_one_has_sql():
    assert set(Q.QUERIES) - set(Q.ORACLE_SQL) == {"verifier_scores"}
