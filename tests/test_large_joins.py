"""Joins whose sides grow with the code are merged: a side taken for small by its estimate is not collected by the driver."""

import pytest

from tracewell.operators import code_scan, imports, routes
from tracewell.sources import catalog, corpora

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plans(monkeypatch):
    """Executed plans of all that is checkpointed or written on the way."""
    seen = []

    def recorded(keep):
        def run(df, *args):
            seen.append(plan(df))
            return keep(df, *args)
        return run

    for module, name in [(routes, "checkpointed"), (code_scan, "checkpointed"), (imports, "written")]:
        monkeypatch.setattr(module, name, recorded(getattr(module, name)))
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_collect_no_side(spark, plans):
    python, ui = (catalog.code_files_read(c.read(spark, FOLDER)) for c in (corpora.PY_FILE, corpora.TS_FILE))
    report = routes.mapping_report(ui, python, corpora.ROUTE_RULES, corpora.APP_RULES)
    plans.append(plan(report))
    assert report.count() > 0
    assert sum("Join" in p for p in plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
