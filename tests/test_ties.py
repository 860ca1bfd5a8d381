"""Queries against their SQL on tables made for it, where boxes touch and values lie on a limit."""

import duckdb
import pytest

from kestrine import plans

from .helpers import assert_same


@pytest.fixture
def held(spark, tmp_path):
    """held(query, name=rows, ...): the query on tables given as DuckDB SQL equals its SQL; how many rows it has."""
    def run(query, **tables):
        con = duckdb.connect()
        for name, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
            con.execute(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet'")
        df = plans.queries()[query](spark, str(tmp_path))
        assert_same(df, con, plans.oracle_sql()[query])
        return df.count()

    return run


def test_moved_boxes_that_nearly_touch(held):
    assert held("collision_classes", supplier="select range as s_suppkey, 1::int as s_nationkey from range(0, 300)") > 10_000


def test_values_at_a_share_of_a_context_between_two_values(held):
    """A quarter of 60.72, which lies between 60.70 and 60.78; and events without value or day's company."""
    days = [[59.56, 59.74, 60.05, 60.08, 60.45, 60.7, 60.78, 60.93, 15.18], [59.07, 59.17, 59.35, 59.64, 59.68, 60.02, 60.1, 60.69, 15.01], [60.0, 60.53, 60.95, 60.99], [90.0, 90.0, 91.0, None, 1.0], [59.0, None, None, None], [None] * 5, [99.0, 1.0, 99.0]]
    # a value of the sixties is given to a day of its own first, so that the context is what stands above
    days += [[60.0, 60.53, 60.95, 60.99, *([v] * n)] for v, n in ((15.24, 1), (15.23, 2), (15.21, 3))] + [[a, b, c, e] for a, b, c, e in ((14.99, 59.7, 59.99, 60.03), (15.0, 60.0, 60.0, 60.01), (15.17, 60.29, 60.64, 60.8), (15.16, 60.63, 60.68, 60.68))]
    days += [[i / 100, *(round(4 * i / 100 + j, 2) for j in (-0.3, -0.01, 0.03))] for i in range(1500, 1600)]
    rows = ", ".join(f"({10 * k + i}, {k}, {'null' if v is None else v})" for k, vs in enumerate(days) for i, v in enumerate(vs))
    assert held("context_screen", events=f"select c0::bigint as event_id, timestamp '2024-01-01' as ts, c1::bigint as user_id, 'view' as event_type, c2::double as value from (values {rows}) t(c0, c1, c2)") > 400


def test_overlaps_of_boxes_that_touch(held):
    """Equal boxes many times over, and overlaps that are next to nothing."""
    assert held("convex_overlaps", supplier="select range as s_suppkey, 1::int as s_nationkey from range(0, 300) union all select range * 840, 2 from range(0, 30)") > 10_000
