"""Registered queries against their SQL where part numbers have six digits, so that several parts share a code of five."""

import duckdb
import pytest

from quillmark import queries as Q

from .test_oracles import D, TABLES, plain

#: Columns of keys by table, and how far the second copy of the smallest tables is shifted.
SHIFTS = {
    "part": {"p_partkey": 100_000}, "orders": {"o_orderkey": 1_500, "o_custkey": 150}, "lineitem": {"l_orderkey": 1_500, "l_partkey": 100_000},
    "events": {"event_id": 1_000, "user_id": 15},
}


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    d, con = str(tmp_path_factory.mktemp("long")), duckdb.connect()
    for t in TABLES:
        shifted = ", ".join(f"({c} + i * {by})::BIGINT AS {c}" for c, by in SHIFTS.get(t, {}).items())
        con.execute(f"COPY (SELECT * {f'REPLACE ({shifted})' if shifted else ''} FROM '{D}/{t}.parquet' {f', range(2) r(i)' if shifted else ''}) TO '{d}/{t}.parquet' (FORMAT parquet)".replace("SELECT * REPLACE", "SELECT * EXCLUDE (i) REPLACE"))
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return d, con


def same(spark, long_keys, name):
    d, con = long_keys
    df = Q.QUERIES[name](spark, d)
    cols = sorted(df.columns)
    found = con.execute(Q.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    return want and sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


NAMES: list[str] = ["ptp_check", "aoc_check", "unified_check", "constraint_metrics", "constrained_decode", "mue_check", "addon_axis", "active_restriction", "drift_annotation", "recall_buckets", "kb_membership", "kb_csv", "kb_merged", "ptp_txt", "aoc_txt", "bins_and_tiers_csv"]


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql_where_parts_share_a_code(spark, long_keys, name):
    assert same(spark, long_keys, name)
