"""Queries make their bars once, whatever number of jobs reads them."""

import pytest

import __spark_entry__ as entry
from panelspark.plans import registry
from panelspark.sources import panel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["weights_by_date", "panel_bars"])
def test_lines_are_aggregated_once(spark, monkeypatch, name):
    made, whole = [], panel._bars
    monkeypatch.setattr(panel, "_bars", lambda *a: made.append(a) or whole(*a))
    got = registry.queries()[name](spark, SF)
    assert [a[1:] for a in made] == [(SF, "p_brand")]
    assert not [f for f in got.inputFiles() if "lineitem" in f]  # what is left to run starts from the stored bars


def test_nothing_is_kept_for_the_next_call(spark, monkeypatch):
    made, whole = [], panel._bars
    monkeypatch.setattr(panel, "_bars", lambda *a: made.append(a) or whole(*a))
    for _ in range(2):
        entry.queries()["date_range"](spark, SF)
    assert len(made) == 2


def test_stored_bars_are_the_bars(spark):
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    for ticker in ("p_brand", "l_suppkey"):
        own = panel.one_pass(lambda s, d: panel.bars(s, d, ticker))(spark, SF)
        assert rows(own) == rows(panel.bars(spark, SF, ticker)) and len(rows(own)) > 1000
