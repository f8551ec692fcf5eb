"""Whitening, token files and manifest against brute force, on small tables with nulls, long texts, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from squadframe.llm import merkle, queries, token_files, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")


def exact_model(xs):
    """Fit list, sums and exact covariance of integer vectors."""
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n for j in range(d)] for i in range(d)]
    return fit, s, np.array([[float(c) for c in row] for row in cov])


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e14])
def test_whitening(spark, scale):
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 9)) * np.array([9, 7, 5, 3, 2, 1, 1, 0.5, 0.2]) * scale
    rows = [(i, [float(c) for c in v], "clash", 7) for i, v in enumerate(base)]
    rows += [(200, rows[0][1], "x", 1), (201, rows[0][1], None, 1), (0, rows[3][1], None, None), (None, rows[4][1], None, None)]
    bad = [(300, None, None, 0), (301, [1.0, None] + [0.0] * 7, None, 0), (302, [math.nan] * 9, None, 0), (303, [math.inf] + [0.0] * 8, None, 0), (304, [], None, 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string, n int").repartition(5)
    got = whitening.whiten(table, 4).collect()
    assert len(got) == 4 * len(rows)
    xs = [[math.floor(256 * c) for c in v] for _, v, *_ in rows]
    fit, s, cov = exact_model(xs)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    deviation = sorted(v for x in xs if (v := sum((len(fit) * c - t) ** 2 for c, t in zip(x, s, strict=True))) < 10**38)
    assert sorted(int(g["deviation"]) for g in got if g["component"] == 1 and g["deviation"] is not None) == deviation
    by_id = {(g["vec_id"], g["component"]): g for g in got if g["vec_id"] not in (0, None)}
    for k in range(4):
        mine = np.array([by_id[i, k + 1]["whitened"] for i in range(1, 150)])
        x = np.array([[float(Fraction(c) - Fraction(t, len(fit))) for c, t in zip(xs[i], s, strict=True)] for i in range(1, 150)])
        other = x @ vectors[:, k] / math.sqrt(values[k])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-9
        g = by_id[1, k + 1]
        assert g["n"] == len(fit) and abs(g["explained"] - values[k] / np.trace(cov)) < 1e-12 and g["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [None])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], schema)).collect()
    assert [(x["vec_id"], x["component"], x["n"], int(x["deviation"]), x["whitened"], x["explained"]) for x in sorted(one)] == [(i, k, 1, 0, None, None) for i in (1, 2) for k in (1, 2)]
    # a flat direction, two lengths, numbers near the ends of double
    rows = [(i, [float(i % 5), float(i % 3), 0.0]) for i in range(30)] + [(50, [1.0]), (51, [3.0]), (60, [3.0e38, -3.0e38, 1e-45, 0.0]), (61, [0.0, 0.0, 0.0, 0.0])]
    got = {(x["vec_id"], x["component"]): x for x in whitening.whiten(spark.createDataFrame(rows, schema)).collect()}
    assert got[3, 3]["whitened"] is None and got[3, 2]["whitened"] is not None and got[3, 1]["n"] == 15 and got[50, 1]["n"] == 2
    assert abs(abs(got[50, 1]["whitened"]) - 1) < 1e-12 and got[50, 1]["explained"] == 1.0
    top = (1 << 63) - 1
    assert got[60, 1]["deviation"] is None and got[61, 1]["n"] == 2 and 4 * top * top > 10**38


def test_sums_are_exact_at_any_size():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-(1 << 63), (1 << 63) - 1, (5000, 3)), r.integers(-300, 300, (5000, 3)), np.full((2, 3), -(1 << 63))])
    digits = np.zeros((whitening.DIGITS, 3, 3), np.int64)
    got = whitening.whole(whitening.gram(x, digits))
    rows = x.astype(object)
    assert (got == rows.T @ rows).all()


def some_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdehé語ß") for _ in range(r.randrange(1, 9)))
    out = [None, "", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb", "a\nb\n", " x y\u0085z \x1cq r\x1f s", "it's we'll 'S it's\nthey've", "<|endoftext|> a <|endoftext|>", "x" * 5000, "語" * 700, "\U0001f600 " * 50, "# # #"]
    out += [r.choice([" ", "\n", "  ", ", "]).join(word() for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return [*out, "the same words again " * 4000, *[out[30]] * 25]


def reference_ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files(spark, tmp_path):
    texts = some_texts()
    rows = [(i * 37 % 1009, t, "clash", i) for i, t in enumerate(texts)] + [(None, "null id", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, n_tokens int").repartition(6)
    to = f"{tmp_path}/files"
    token_files.write_files(docs, PATH, to, shard_ids=300, least=4)
    files = token_files.read_files(spark, to).cache()
    got = {r["doc_id"]: r for r in token_files.documents(files, with_ids=True).collect()}
    at, whole = 0, []
    for i, t, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = reference_ids(t)
        data = np.array(ids, "<u4").tobytes()
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (at, len(ids), zlib.crc32(data), data), t
        at += len(ids)
        whole += ids
    assert len(got) == len(rows)
    for low, high in ((0, 5), (17, 900), (at - 3, at), (0, at), (400, 400)):
        parts = sorted((r["start"], bytes(r["ids"])) for r in token_files.ids_between(files, low, high).collect())
        assert np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist() == whole[low:high]
    # repeated ids are documents of their own; an empty table has no files
    both = f"{tmp_path}/both"
    token_files.write_files(docs.limit(3).unionByName(docs.limit(3)), PATH, both)
    assert token_files.documents(token_files.read_files(spark, both)).count() == 6
    none = f"{tmp_path}/none"
    token_files.write_files(docs.limit(0), PATH, none)
    assert token_files.documents(token_files.read_files(spark, none)).count() == 0


def test_grammar_expands_to_its_ids():
    r = np.random.default_rng(3)
    for ids in (np.zeros(0), np.array([2]), np.full(1000, 7), np.tile([5, 6], 700), r.integers(0, 6, 20_000), np.tile(r.integers(0, 50_000, 40), 300)):
        ids = np.append(ids, 2).astype("<u4")
        data = token_files.pack([ids.tobytes()], 50_257, 2, 4)
        file = token_files.ShardFile(data)
        assert (file.expand(file.symbols) == ids).all() and (file.document(0) == ids).all()
        rules, lengths, seq = token_files.grammar(ids, 50_257, 2, 4)
        assert not (rules[:, 0] == 2).any() and lengths.sum() == sum(len(file.expand(np.array([50_257 + k]))) for k in range(len(rules)))
        if len(ids) > 900:
            assert len(data) < 2 * len(ids)
            # what is left holds no pair that could be replaced often
            pairs = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])[seq[:-1] != 2]
            assert np.unique(pairs, return_counts=True)[1].max(initial=0) < 8
    with pytest.raises(ValueError):
        token_files.ShardFile(b"\0" * 64)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(nodes, fan):
    """Root, and for each node what stands to its left and right on every level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            start = place[k] - place[k] % fan
            run = nodes[start : start + fan]
            path.append(("".join(run[: place[k] - start]), "".join(run[place[k] - start + 1 :])))
        nodes = [digest("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        place = [p // fan for p in place]
    return nodes[0], paths


@pytest.mark.parametrize("fan, levels, counts", [(2, 2, [1, 2, 3, 4, 5, 9, 17, 33, 100]), (3, 1, [1, 3, 4, 10, 28]), (2, 9, [600, 3]), (2, 9, [1])])
def test_manifest(spark, fan, levels, counts):
    rows = []
    for g, c in enumerate(counts):
        for _ in range(c):
            i = len(rows)
            rows.append((i * 7 % 1009, None if i % 5 == 0 else "t" * i + "é", None if g == 0 else f"{'éz'[g % 2]}{g}", None if i % 11 == 0 else i, i, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, pos int, node string").repartition(7)
    other = {"n_chars": F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.verified(merkle.manifest(docs, ["doc_id", "text", "lang", "n_chars"], "lang", "doc_id", other, fan, levels))
    got = {x["doc_id"]: x for x in found.collect()}
    groups = {}
    for x in sorted(rows):
        groups.setdefault(x[2], []).append(x)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([digest("".join(map(field, x[:4]))) for x in groups[g]], fan) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names], fan)
    assert len(got) == len(rows)
    for g, top in zip(names, tops, strict=True):
        for x, path in zip(groups[g], trees[g][1], strict=True):
            y, leaf, way = got[x[0]], digest("".join(map(field, x[:4]))), path + top
            seen = digest("".join(map(field, [*x[:3], x[3] + 1]))) if x[0] % 5 == 0 and x[3] is not None else leaf
            folded = seen
            for left, right in way:
                folded = digest(left + folded + right)
            assert (y["leaf"], y["subroot"], y["root"], y["proof_sha256"]) == (leaf, trees[g][0], root, digest("".join(a + b for a, b in way)))
            assert (y["folded_root"], y["verified"]) == (folded, seen == leaf)


def test_manifest_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    columns = ["doc_id", "text", "lang"]
    assert merkle.manifest(spark.createDataFrame([], schema), columns, "lang", "doc_id").count() == 0
    rows = [(1, "a", "en"), (1, "a", "en"), (1, "b", "en"), (None, "c", "en"), (None, "x" * 300_000, ""), (2, "", None)]
    got = merkle.verified(merkle.manifest(spark.createDataFrame(rows, schema), columns, "lang", "doc_id")).collect()
    leaf = lambda x: digest("".join(map(field, x)))
    groups = [[rows[5]], [rows[4]], [rows[3], *sorted([rows[0], rows[1], rows[2]], key=leaf)]]
    root = brute_tree([brute_tree([leaf(x) for x in g], 2)[0] for g in groups], 2)[0]
    assert sorted(x["leaf"] for x in got) == sorted(map(leaf, rows)) and all(x["verified"] and x["root"] == root for x in got)


def test_manifest_query_leaves_null_ids_alone(spark, tmp_path):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(40)] + [(None, "s", "en", 5, "n"), (1000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in queries.op13_merkle(spark, str(tmp_path)).collect():
        touched = x["doc_id"] is not None and x["doc_id"] != 1000 and zlib.crc32(str(x["doc_id"]).encode()) % 7 == 0
        assert x["verified"] == (not touched) and (x["folded_root"] == x["root"]) == x["verified"]
