"""Tables whose files are small because they are compressed are joined by shuffles, never broadcast."""

from __future__ import annotations

import pytest

from tilework.operators import components, lettering, regions, trace
from tilework.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_lines_broadcast_nothing(spark, monkeypatch):
    seen = []
    for module in (components, lettering, regions):

        def kept(df, name, *more, put=module.materialize):
            seen.append(plan(df))
            return put(df, name, *more)

        monkeypatch.setattr(module, "materialize", kept)
    seen.append(plan(queries.queries()["text_lines"](spark, DATA)))
    assert sum("Join" in p for p in seen) >= 5 and not any("Broadcast" in p for p in seen)


@pytest.mark.parametrize("name", ["region_fill", "gradient_fit", "gradient_choice"])
def test_pixels_are_not_broadcast(spark, name):
    found = plan(queries.queries()[name](spark, DATA))
    assert "SortMergeJoin" in found and "Broadcast" not in found


def test_handles_need_one_join(spark):
    found = plan(trace.with_handles(trace.chains(queries._labelled(spark, DATA), 0.8)))
    assert found.count("SortMergeJoin") in (1, 2) and "Window" not in found and "Broadcast" not in found  # an adaptive plan may be printed twice
