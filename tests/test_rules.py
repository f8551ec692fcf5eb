"""Scalar rules at their borders, and properties of the tables."""

import pytest
from pyspark.sql import functions as F

from squadframe.functions import exprs as X
from squadframe.operators import stats, votes
from squadframe.streaming.votes import UpsertSink

D = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(("mmr", "tier"), [(14000.0, "eternity"), (13999.9, "demigod"), (9000.0, "mithril"), (7500.0, "meteor"), (1500.0, "silver"), (1499.0, "bronze"), (None, None)])
def test_tier(spark, mmr, tier):
    assert one(spark, X.tier_from_mmr(F.lit(mmr).cast("double"))) == tier


def test_scalars(spark):
    assert one(spark, X.round_half_up(F.lit(2.5))) == 3.0 and one(spark, X.round_half_up(F.lit(-2.5))) == -2.0
    assert one(spark, X.placement_score(F.lit(None).cast("double"), F.lit(0.5), F.lit(0.1))) == 0.0
    assert one(spark, X.vote_score(F.lit(0), F.lit(0))) == 0.0
    assert [one(spark, X.rank_tier(F.lit(v))) for v in (76, 75.9, 55, 44, 43)] == ["S", "A", "B", "C", "D"]
    assert one(spark, X.initials(F.lit("가넷 x"))) == "ㄱㄴ x"
    assert one(spark, X.csv_escape(F.lit('a"b'))) == '"a""b"'
    assert one(spark, X.html_escape(F.lit("<&'>"))) == "&lt;&amp;&#39;&gt;"
    assert one(spark, X.ranked_tier(F.lit(None).cast("string"), F.lit(5999.0), F.lit(10))) == "platinum"
    assert one(spark, X.ranked_tier(F.lit("Gold"), F.lit(None).cast("double"), F.lit(300))) == "eternity"


def test_buckets_add_up(spark):
    s = stats.official_candidate_stats(spark, D, 1)
    sums = {r["b"]: r["g"] for r in s.groupBy((F.col("bucket") == "all").alias("b")).agg(F.sum("games").alias("g")).collect()}
    assert sums[True] == sums[False]


def test_stream_equals_batch(spark, tmp_path):
    rows = votes.votes(spark, D)
    for k in range(3):
        rows.where(F.col("vote_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    sink = UpsertSink(spark, str(tmp_path / "out"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start().processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    cols = ["user_id", "tier", "team_key", "candidate_id", "bucket", "value", "ts"]
    again = UpsertSink(spark, str(tmp_path / "out"))  # as after a restart; a batch comes twice
    again(rows.where(F.col("vote_id") % 3 == 1), 1)
    assert sorted(map(tuple, sink.latest().select(*cols).collect())) == sorted(map(tuple, votes.upserted(rows).select(*cols).collect()))


def test_fixed_rounds_by_the_exact_value(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import functions as F

    from squadframe.functions import exprs as X

    r = random.Random(1)
    values = [0.0, 1.005, 8.345, 2.5, 0.125, 0.375, 1.45, 10.235, 1e-9, 123456789.125, 0.615, 4.35, 1.0000000000000002, 5e-324, 4503599627370495.5, 1e300]
    values += [k / 1000 for k in range(5, 4000, 10)] + [k / 8 for k in range(1, 200, 2)] + [r.uniform(0, 1e6) for _ in range(500)] + [round(r.uniform(0, 1e5), 3) for _ in range(500)]
    values += [-v for v in values]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 6):
        got = {x["v"]: x["f"] for x in table.select("v", X.fixed(F.col("v"), digits).alias("f")).collect()}
        for v in values:
            assert got[v] == float(Decimal(v).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(v) < 1e12 else True, (v, digits)
    assert got[1e300] == 1e300
