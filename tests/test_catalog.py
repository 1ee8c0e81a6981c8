"""Every registered query against its SQL, or for a schema and rows where SQL can't express it."""

import pytest

from inkwell.plans import catalog

from .conftest import SMALL, same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(catalog.queries()[name](spark, SMALL), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_over_all_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_report_splits_tables_once(spark, monkeypatch):
    """blocks were parsed for the papers and once more for the report."""
    from inkwell.plans import paper

    calls, load = [], paper.segment.load_blocks
    monkeypatch.setattr(paper.segment, "load_blocks", lambda raw: calls.append(1) or load(raw))
    assert catalog.queries()["segment_report"](spark, SMALL).count() > 0 and calls == [1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
