"""The tables behind the recommendation come from one pass over the line items and are the same as those made alone."""

import os

import pytest

from squadframe.operators import ranker, recommend, stats
from squadframe.sources import adapter

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def test_line_items_are_read_once(spark, monkeypatch):
    reads, real = [], adapter.table
    monkeypatch.setattr(adapter, "table", lambda s, d, name: reads.append(name) or real(s, d, name))
    base = recommend.Base(spark, D)
    recommend.evaluated(base)
    assert (reads.count("lineitem"), reads.count("orders"), reads.count("events")) == (1, 1, 1)
    alone = {
        "stats": stats.official_candidate_stats(spark, D), "combat": stats.official_combat_stats(spark, D), "pairs": stats.official_pair_stats(spark, D),
        "ranked": ranker.ranker_candidate_stats(spark, D), "compositions": ranker.ranker_composition_stats(spark, D), "references": ranker.tournament_references(spark, D)}
    for name, made in alone.items():
        got = getattr(base, name)
        assert got.columns == made.columns
        rows = sorted(map(tuple, made.collect()), key=repr)
        assert rows and sorted(map(tuple, got.collect()), key=repr) == rows, name
