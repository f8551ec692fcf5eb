"""Vectors near the ends of double among ordinary ones, against brute force."""

import numpy as np

from squadframe.llm import embed_dedup


def test_tiny_and_huge_vectors_link_as_others_do(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 12))
    rows = []
    for k, v in enumerate(base):
        for scale in (1.0, 1e-170, 1e200, 5e-320):
            near = (v + r.normal(size=12) * 0.02) * scale
            if np.abs(near).max() > 0:
                rows.append((len(rows), near.tolist(), f"l{k % 2}"))
    got = {x["vec_id"]: x for x in embed_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    x = np.array([v for _, v, _ in rows], np.longdouble)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = (x @ x.T >= 0.93) & np.equal.outer([c for *_, c in rows], [c for *_, c in rows])
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    for i in range(len(rows)):
        assert got[i]["n_links"] == near[i].sum()


def test_one_tiny_vector_spoils_no_index():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 8))
    x[17] *= 1e-170
    index = embed_dedup.Index(x, cells=16)
    assert np.isfinite(index.coarse).all() and len(np.unique(index.nearest(embed_dedup._unit(x)))) > 8
