"""Published versions of several tables."""

import json

import pytest
from pyspark.sql import functions as F

from squadframe.operators import stats
from squadframe.sources import snapshot

SF = "/root/testdata/sf0.001"


def test_versions_are_seen_whole(spark, tmp_path):
    at = str(tmp_path / "shared")
    with pytest.raises(ValueError, match="nothing is published"):
        snapshot.Reader(spark, at).table("a")
    tables = lambda n: {"a": spark.range(n).withColumn("v", F.lit(n)), "b": spark.range(2 * n).withColumn("v", F.lit(n))}
    assert snapshot.publish(spark, at, tables(3), {"a": {"most": F.max("id"), "sum": F.sum("v")}}, {"source": "x"}) == 1
    reader = snapshot.Reader(spark, at)
    assert reader.manifest["tables"]["a"] == {"schema": "struct<id:bigint,v:int>", "rows": 3, "most": 2, "sum": 9} and reader.manifest["source"] == "x"
    made = []
    both = lambda: reader.derived("both", lambda r: made.append(1) or r.table("a").unionByName(r.table("b")), keep=True)
    assert both().count() == 9 and both().count() == 9 and len(made) == 1
    old = reader.table("a")

    # a version whose second table fails is never seen
    bad = {"a": spark.range(50).withColumn("v", F.lit(50)), "b": spark.range(5).withColumn("v", F.raise_error(F.lit("broken")).cast("int"))}
    with pytest.raises(Exception, match="broken"):
        snapshot.publish(spark, at, bad)
    assert not reader.refresh() and snapshot.versions(spark, at) == [1]

    assert snapshot.publish(spark, at, tables(4)) == 2
    assert {r.v for r in reader.table("a").collect()} == {3}  # until it looks again
    assert reader.refresh() and not reader.refresh()
    assert [{r.v for r in reader.table(t).collect()} for t in "ab"] == [{4}, {4}] and old.count() == 3
    assert both().count() == 12 and len(made) == 2
    # of two writers of one number the second fails
    with pytest.raises(FileExistsError):
        snapshot._put(spark, f"{at}/published/{2:012d}.json", "{}")
    snapshot.publish(spark, at, tables(5))
    snapshot.withdraw(spark, at, 1)
    assert snapshot.versions(spark, at) == [3] and len(list((tmp_path / "shared" / "versions").iterdir())) == 2  # the failed one stays


def test_six_tables_of_statistics(spark, tmp_path):
    tables = {f.__name__: f(spark, SF) for f in (stats.official_candidate_stats, stats.official_trait_build, stats.official_composition_stats, stats.official_pair_stats, stats.official_combat_stats, stats.drop_reason_audit)}
    snapshot.publish(spark, str(tmp_path), tables, {"official_candidate_stats": {"games": F.sum("games")}})
    reader = snapshot.Reader(spark, str(tmp_path))
    for name, df in tables.items():
        assert reader.table(name).count() == reader.manifest["tables"][name]["rows"] == df.count()
    assert reader.manifest["tables"]["official_candidate_stats"]["games"] == reader.table("official_candidate_stats").agg(F.sum("games")).first()[0]
    json.dumps(reader.manifest)
