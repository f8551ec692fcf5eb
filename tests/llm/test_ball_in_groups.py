"""The ball over 64-bit fingerprints finds near copies for similar_groups too, not only the short fingerprints."""

import random

from pyspark.sql import functions as F

from squadframe.llm import simhash


def test_ball_links_near_copies_alone(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(30):
        t = [f"w{r.getrandbits(30)}" for _ in range(400)]
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join([*t[:-1], "end"]))]  # one shingle of 396 differs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = simhash._sketches

    # short fingerprints that no two texts share leave all to the ball
    monkeypatch.setattr(simhash, "_sketches", lambda *a: plain(*a).withColumn("bands", F.array("doc_id").cast("array<long>")))
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    bits = [(simhash.fingerprint(rows[2 * i][1], 5) ^ simhash.fingerprint(rows[2 * i + 1][1], 5)).bit_count() for i in range(30)]
    assert sum(b <= 3 for b in bits) > 10
    assert all(got[2 * i + 1] == (2 * i if b <= 3 else 2 * i + 1) for i, b in enumerate(bits))
