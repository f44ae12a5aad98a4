"""Every registered query of the library against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0


def test_near_duplicate_groups_match_union_find(spark, duck):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, *_ in duck.execute(plans.SQL["shingle_dedup"]).fetchall():
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    sizes: dict = {}
    for x in parent:
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    assert {(r["root"], r["size"]) for r in plans.QUERIES["components"](spark, SF).collect()} == set(sizes.items())


def test_first_evidence_weighs_ids_as_its_sql_does(spark, tmp_path):
    """Ids beyond a million outweigh a hundredth of strength; rows without a type or value are no evidence."""
    rows = "(0, 1, 'a', 1.0), (2000000, 1, 'b', 1.01), (0, 2, 'a', 1.0), (900000, 2, 'b', 1.01), (7, 3, 'c', 2.0), (8, 3, 'd', 2.0), (9, 3, NULL, 5.0), (1, 4, 'a', NULL), (2, 5, NULL, 1.0), (3, 6, 'e', NULL), (4, 6, 'f', -1.0)"
    c = duckdb.connect()
    c.execute(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value FROM (VALUES {rows}) t(event_id, user_id, event_type, value)")
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {(r["subject"], r["evidence"], r["strength"]) for r in plans.QUERIES["first_evidence"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(plans.SQL["first_evidence"]).fetchall())
    assert (1, "a", 1.01) in got and (2, "b", 1.01) in got
