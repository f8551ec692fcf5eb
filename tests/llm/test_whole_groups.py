"""Every pair of a group that shares a short fingerprint is tried, and small tables leave buckets of the ball empty."""

import random

import pytest
from pyspark.sql import functions as F

from squadframe.llm import simhash


@pytest.mark.parametrize("in_block", [1 << 19, 1 << 9])
def test_twins_in_one_mixed_group_are_found(spark, monkeypatch, in_block):
    r = random.Random(8)
    texts = []
    for size in [60] * 25 + [300] * 25:
        t = [f"w{r.getrandbits(30)}" for _ in range(size)]
        other = list(t)
        other[size // 2] = "changed"  # five shingles of each differ
        texts += [" ".join(t), " ".join(other), " ".join(t[: size * 2 // 3])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = simhash._sketches
    # all texts share two short fingerprints, so hubs and neighbours are strangers as a rule; the third is each one's own
    monkeypatch.setattr(simhash, "_sketches", lambda *a: plain(*a).withColumn("bands", F.array(F.lit(-5), F.col("doc_id"), F.lit(-3)).cast("array<long>")))
    monkeypatch.setattr(simhash, "SHINGLES_IN_BLOCK", in_block)
    monkeypatch.setattr(simhash, "MEMBERS_IN_BLOCK", 16)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()}
    sets = [simhash.shingles(x) for x in texts]
    alike = lambda a, b: len(sets[a] & sets[b]) >= simhash.SIMILAR * len(sets[a] | sets[b])
    assert all(alike(3 * i, 3 * i + 1) and not alike(3 * i, 3 * i + 2) for i in range(50))
    assert got == {i: i - (i % 3 == 1) for i in range(len(texts))}


def test_few_texts_leave_buckets_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
