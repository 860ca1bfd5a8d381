"""Every query that SQL can express against DuckDB on the smallest tables; the others run and keep their invariants."""

import pytest

from kestrine import plans

from .conftest import SF
from .helpers import assert_same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert_same(plans.queries()[name](spark, SF), duck, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry_works_without_the_optional_package():
    """Only the entry point knows of it; the rest imports without."""
    import ast
    from pathlib import Path

    root = Path(plans.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            names = [a.name for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names] + [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in x.split(".") for x in names), p


def test_projection_and_filter_reach_the_scan(spark):
    text = plans.queries()["class_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in text
