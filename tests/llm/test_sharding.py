"""Sharding: equal texts stay together, sums are near equal, and the shards are the leaves of a k-d tree."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from squadframe.llm import sharding

SCHEMA = "doc_id long, text string, shard int, size int"


def some_docs(r, n=1500):
    word = lambda: "".join(r.choice("abcdefgh é語") for _ in range(r.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(r.randrange(0, 70))) for _ in range(n)]
    return texts


def placed(spark, texts, shards):
    rows = [(i, t, 9, 9) for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(6), shards).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(len(texts)))
    for k in {x["shard"] for x in got}:
        assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(sum(x["shard"] == k for x in got)))
    return {x["doc_id"]: x for x in got}


def test_equal_texts_stay_whole(spark):
    r = random.Random(4)
    texts = some_docs(r)
    share = sum(len(t.encode()) + 8 for t in texts) // 8
    # groups of a tenth, a half and nearly all of a shard, a third of all rows empty, and one that outweighs a shard
    for part, size in ((0.1, 400), (0.1, 90), (0.5, 900), (0.9, 2000)):
        t = "".join(r.choice("xyz ") for _ in range(size))
        texts += [t] * int(part * share // (size + 8))
    texts += [""] * 700 + [None] * 40
    texts += [small := "w v " * 100] * int(1.8 * share // 408)
    got = placed(spark, texts, 8)
    shards_of, weight = defaultdict(set), Counter()
    for i, t in enumerate(texts):
        shards_of[t or ""].add(got[i]["shard"])
        weight[t or ""] += got[i]["size"]
    total = sum(weight.values())
    assert [t for t, s in shards_of.items() if len(s) > 1] == [small] and weight[small] > total / 8
    sums = Counter()
    for x in got.values():
        sums[x["shard"]] += x["size"]
    assert len(sums) == 8 and max(sums.values()) < 1.05 * total / 8 and min(sums.values()) > 0.95 * total / 8


def test_very_long_texts(spark):
    r = random.Random(6)
    texts = some_docs(r, 600) + ["long " * 6000, "longer " * 5000, "語" * 9000]
    got = placed(spark, texts, 4)
    sums = Counter()
    for x in got.values():
        sums[x["shard"]] += x["size"]
    assert max(sums.values()) < 1.03 * sum(sums.values()) / 4
    assert all(got[i]["size"] == len(t.encode()) + 8 for i, t in enumerate(texts))


def test_shards_are_leaves_of_a_tree_of_medians(spark):
    """Every split divides the points, by brute force over the described rows, at a cut of the widest dimension."""
    r = random.Random(5)
    texts = [t for t in dict.fromkeys(some_docs(r, 3000)) if t]  # all different and light: one class
    rows = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], SCHEMA)
    about = {x["doc_id"]: x for x in sharding.describe(rows).collect()}
    shard = {x["doc_id"]: x["shard"] for x in sharding.shard(rows, 8).collect()}
    every = list(about.values())
    dims = ("d0", "d1", "d2")
    spread = lambda points, d: max(p[d] for p in points) - min(p[d] for p in points)
    scale = {d: spread(every, d) or 1.0 for d in dims}
    share = sum(p["size"] for p in every) / 8

    def check(points, low, n):
        if n == 1:
            return
        widest = max(dims, key=lambda d: (spread(points, d) / scale[d], -dims.index(d)))
        left = [p for p in points if shard[p["doc_id"]] < low + n // 2]
        right = [p for p in points if shard[p["doc_id"]] >= low + n // 2]
        least, span = min(p[widest] for p in points), spread(points, widest) or 1.0
        key = lambda p: (int((p[widest] - least) / span * ((1 << 24) - 1)), p["text_crc32"])
        assert max(map(key, left)) < min(map(key, right))
        assert abs(sum(p["size"] for p in left) - sum(p["size"] for p in points) * (n // 2) / n) < 0.01 * share
        check(left, low, n // 2)
        check(right, low + n // 2, n - n // 2)

    check(every, 0, 8)


def test_odd_tables(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 24).count() == 0
    one = sharding.shard(spark.createDataFrame([(None, None, 1, 1), (None, None, 1, 1), (3, "", 1, 1)], SCHEMA), 24)
    assert one.agg(F.count("*"), F.sum("size")).first()[:] == (3, 24)
