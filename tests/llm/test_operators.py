"""The operators against brute force, on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from squadframe.llm import bpe, common, embed_dedup, exact_dedup, html_text, lm_score, mixing, sharding, simhash, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, size int, node int"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = [words(r, r.randrange(1, 90)) for _ in range(60)]
    out += [out[0]] * 20 + [out[1].replace(" ", "\t\n")] + [None, "", " ", "\n\n", "x", "x  y", "x y", "é" * 3000, words(r, 9000)]
    long = words(r, 400).split()
    out += [" ".join(long[:k] + ["zz"] + long[k + 1 :]) for k in range(5, 395, 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "clash", i, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "x y", None, None, None, None, None, None, None)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_url_filter(spark):
    urls = ["http://A.Example.net/en/x", "http://example.net/de/", "http://net", "http://net/", "https://x.example.com/de/?q", "http://example.org/fr/a#b", "ftp:/x", "", None, "http://xnet/", "http://h.net/en://y", "http://" + "a." * 500 + "net/q", "http://net/"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("", "/", "block"), (None, "/", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(h + p), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, fit[1], fit[2])
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "host string, path string, action string")).count() == 0


@pytest.mark.parametrize("bits", [128, 6])
def test_exact_dedup(spark, docs, bits):
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = Counter(norm(r["text"]) for r in rows)
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[norm(r["text"])] = min(first.get(norm(r["text"]), 1 << 60), r["doc_id"])
    by_id = {r["doc_id"]: norm(r["text"]) for r in rows}
    got = exact_dedup.duplicate_groups(docs, bits=bits).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        t = by_id[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (first[t], groups[t], hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.keep_one(docs).count() == len(groups)
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


def test_simhash(spark, docs):
    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.collect()
    fps = [fp(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            root[i] = min(root[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), r["doc_id"])
    expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], f"{f:016x}", least[root[i]]) for i, (r, f) in enumerate(zip(rows, fps, strict=True)))
    got = simhash.near_groups(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(set(root))
    assert simhash.near_groups(empty(spark)).count() == 0


def test_simhash_links_of_planted_fingerprints(spark):
    r = random.Random(5)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 3, 4))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    roots = {x["node"]: x["root"] for x in common.components(found, "a", "b").collect()}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                assert roots[signed(a)] == roots[signed(b)]
    for x in found.collect():
        assert ((x["a"] ^ x["b"]) & (1 << 64) - 1).bit_count() <= 3


def test_simhash_links_of_one_large_family(spark):
    r = np.random.default_rng(9)
    base = np.uint64(r.integers(0, 1 << 63))
    flips = np.uint64(1) << r.integers(0, 64, (10_000, 4)).astype(np.uint64)
    fps = np.unique(base ^ np.bitwise_xor.reduce(flips, axis=1))
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"))
    got = np.array([(x["a"], x["b"]) for x in found.collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(got[:, 0] ^ got[:, 1]) <= 3).all()
    at = np.searchsorted(fps, got)
    root, expected = np.arange(len(fps)), np.arange(len(fps))
    pairs = np.concatenate([np.argwhere(np.bitwise_count(fps[i : i + 500, None] ^ fps[None, :]) <= 3) + [i, 0] for i in range(0, len(fps), 500)])
    for labels, edges in ((root, at), (expected, pairs)):
        before = None
        while before is None or (before != labels).any():
            before = labels.copy()
            low = np.minimum(labels[edges[:, 0]], labels[edges[:, 1]])
            np.minimum.at(labels, edges[:, 0], low)
            np.minimum.at(labels, edges[:, 1], low)
    assert (root == expected).all()


def test_url_filter_keeps_host_and_path_apart(spark):
    rules = spark.createDataFrame([("exam", "ple.com/", "block"), ("x.org", "/", "allow"), ("b/c", "d", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://example.com/a"), (2, "http://x.org/"), (3, "http://b/c/d")], "page_id int, url string")
    assert {r["page_id"]: r["rule"] for r in url_filter.judge(pages, rules).collect()} == {1: None, 2: "x.org/", 3: None}


def test_keep_one_against_brute_force(spark, texts):
    r = random.Random(11)
    made = list(texts)
    for _ in range(40):
        t = words(r, 300).split()
        made.append(" ".join(t))
        for changed in (1, 3, 6, 9, 30):
            u = list(t)
            for k in r.sample(range(300), changed):
                u[k] = "zzz"
            made.append(" ".join(u))

    def split(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [split(t) for t in made]
    near = [(i, j) for i in range(len(made)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(made)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in simhash.similar_groups(docs).collect()}
    assert {i: got[i]["component_id"] for i in got} == {i: top(i) for i in range(len(made))}
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == sorted({top(i) for i in range(len(made))})
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_similar_groups_in_a_mixed_family(spark):
    r = random.Random(7)

    def changed(t, n):
        u = list(t)
        for k in r.sample(range(len(u)), n):
            u[k] = f"q{r.getrandbits(40)}"
        return u

    base, made, twins = [f"b{i}" for i in range(300)], [], []
    for i in range(800):  # at a similarity of about 0.6 with each other, one in eight with a twin at 0.84 or more
        made.append(changed(base, 8))
        if i % 8 == 0:
            twins.append((len(made) - 1, len(made)))
            made.append(changed(made[-1], 5))
    place = list(range(len(made)))
    r.shuffle(place)
    rows = [(place[i], " ".join(t)) for i, t in enumerate(made)]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[place[a]] == got[place[b]] for a, b in twins) >= 0.95 * len(twins)
    assert len(set(got.values())) >= len(made) - len(twins)


def test_components_of_a_chain(spark):
    got = common.components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long"), "a", "b")
    assert {r["node"]: r["root"] for r in got.collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_mixing(spark, docs):
    got = mixing.taken_words(docs, block=16).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own) and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16
    key = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.taken_words(docs.repartition(3), block=16).collect())
    assert mixing.shares([10, 10, 100], [5, 2, 1], 1.5, 2) == [20, 20, 140] and mixing.shares([], [], 1.5, 2) == []
    n = np.full(1000, 1000)
    assert sorted(mixing.permuted(np.arange(1000), n, n * 0 + 9)) == list(range(1000))
    mixed = mixing.mixed_documents(docs, block=16).collect()
    assert sum(len((r["text"]).split()) for r in mixed) == sum(r["taken"] for r in got)
    assert mixing.taken_words(empty(spark)).count() == 0


def test_bpe(spark, docs, texts):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    r = random.Random(1)
    more = ["".join(r.choice("ab  \n\t1é,'s你\xa0x" + "a" * 30 * (i % 2)) for _ in range(r.randrange(400))) for i in range(80)]
    table = spark.createDataFrame(list(enumerate([*texts, *more])), "doc_id long, text string")
    for options in ({}, {"chunk": 40, "overlap": 10}):
        got = bpe.decode(bpe.encode(table, PATH, public_tokenizers.PATTERN, **options), PATH).collect()
        assert len(got) == len(texts) + len(more)
        for x in got:
            t = [*texts, *more][x["doc_id"]] or ""
            assert np.frombuffer(x["ids"], "<u4").tolist() == own.encode_ordinary(t) and bytes(x["decoded"]) == t.encode()
    assert bpe.encode(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_sharding(spark):
    r = random.Random(2)
    rows = [(i, words(r, r.randrange(0, 60)) if i % 9 else "same text") for i in range(900)] + [(None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, 6).collect()
    sums = Counter()
    for x in got:
        sums[x["shard"]] += x["size"]
    assert len(got) == len(rows) and len(sums) == 6 and max(sums.values()) < 1.03 * min(sums.values())
    for k in sums:
        assert sorted(x["slot"] for x in got if x["shard"] == k) == list(range(sum(x["shard"] == k for x in got)))
    assert sharding.shard(empty(spark), 24).count() == 0


def test_lattice_is_the_sum_over_segmentations():
    w = {"▁": 2.0, "▁a": 1.0, "▁ab": 0.7, "a": 3.0, "b": 2.0, "ab": 1.0, "aba": 0.4} | {f"<0x{i:02X}>": 0.01 for i in range(256)}
    first, rest = sum(x for p, x in w.items() if p[0] == "▁"), sum(x for p, x in w.items() if p[0] != "▁") + 3

    def ways(word, i):
        if i == len(word):
            return 1.0
        bytes_ = math.prod(w[f"<0x{x:02X}>"] / rest for x in word[i].encode()) * ways(word, i + 1) if word[i] not in w else 0
        return bytes_ + sum(w[word[i:j]] / rest * ways(word, j) for j in range(i + 1, len(word) + 1) if word[i:j] in w)

    lattice = lm_score.Lattice(w, 3.0)
    for word in ("a", "abab", "bé", "aabba"):
        total = w["▁"] / first * ways(word, 0) + sum(w["▁" + word[:j]] / first * ways(word, j) for j in range(1, len(word) + 1) if "▁" + word[:j] in w)
        assert lattice.log_probability(word) == pytest.approx(math.log(total * 3 / rest))


def test_lm_score(spark, docs):
    import zlib

    got = lm_score.score(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    rows = docs.collect()
    toks = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = Counter(x for r in rows if not held(r["doc_id"]) for x in toks(r["text"]))
    n, v = sum(c.values()), len(c)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    for r, g in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        t = toks(r["text"])
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r["doc_id"]), len(t), sum(c[x] > 0 for x in t), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) and g["score"] < 0
    assert lm_score.score(empty(spark), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_lm_score_of_long_unseen_words(spark):
    import zlib

    assert lm_score.mixed(np.array([0.0]), np.array([0.0]), np.array([-20000.0]), 0.5)[0] == pytest.approx((-20000 + math.log(0.4)) / math.log(10))
    assert lm_score.mixed(np.array([0.1]), np.array([0.2]), np.array([-3.0]), 0.5)[0] == pytest.approx(math.log10(0.05 + 0.5 * (0.04 + 0.8 * math.exp(-3))))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    learnt = [i for i in range(200) if i not in held]
    r = random.Random(2)
    blob = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6000))
    long = [blob[:3000], blob, "漢" * 1000, "漢" * 2000]
    rows = [(i, words(r, 40)) for i in learnt] + list(zip(held, long))  # noqa: B905
    got = {x["doc_id"]: x["score"] for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model"), class_col=None).collect()}
    a, b, c, d = (got[i] for i in held[:4])
    assert a < -5000 and c < -3000 and b == pytest.approx(2 * a, rel=0.05) and d == pytest.approx(2 * c, rel=0.05)


def test_html_text(spark):
    shell = "<html><head><title>t</title><style>a</style></head><body><nav><a>home</a></nav><div class='ad'>buy</div>{}<div>Shared line</div><footer>f</footer>"
    body = shell.format("<article><h1>T &amp; t</h1><p>one\n two<br>three<p>four<script>var x='</p>'</script><div class=comments><p>hi</div></article>")
    plain = [shell.format(f"<p>only {k}</p><p>more {k}") for k in range(3)]
    pages = spark.createDataFrame([(0, "http://h/a", body)] + [(k + 1, f"http://g/{k}", p) for k, p in enumerate(plain)] + [(8, None, None), (9, "http://g/1", "")], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got == {0: "T & t\n\none two three\n\nfour"} | {k + 1: f"only {k}\n\nmore {k}" for k in range(3)} | {8: "", 9: ""}
    a, b = [random.Random(4).randrange(5) for _ in range(60)], [random.Random(6).randrange(5) for _ in range(50)]
    best = np.zeros((61, 51), int)
    for i in range(60):
        for j in range(50):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    assert len(html_text.common_lines(a, b)) == best[-1, -1]
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_html_text_between_copies_and_many_shared_lines(spark):
    line = lambda *x: "".join(f"<p>{y}</p>" for y in x)
    menu = [f"menu {k}" for k in range(9)]
    pages = [(k, f"http://m/{k}", line(*menu, f"own {k}")) for k in range(4)]  # nine lines of ten are shared
    pages += [(10 + k, f"http://c/{k}", line("top", f"text {k // 4}", f"more {k // 4}")) for k in range(12)]  # copies follow each other
    pages += [(30, "http://d/0", line("top", "a", "b")), (31, "http://d/1", line("top", "x", "y", "z")), (32, "http://d/2", line("top", "x", "y", "zz")), (33, "http://d/3", line("top", "c"))]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    assert got == (
        {k: f"own {k}" for k in range(4)} | {10 + k: f"text {k // 4}\n\nmore {k // 4}" for k in range(12)}
        | {30: "a\n\nb", 31: "x\n\ny\n\nz", 32: "x\n\ny\n\nzz", 33: "c"})


def test_embed_dedup(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(150, 16))
    x = np.vstack([base, base[:40] + r.normal(size=(40, 16)) * 0.12, base[:5], base[:1].repeat(30, 0)])
    rows = [(i, v.tolist(), int(i % 150 % 2)) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 1), (903, base[0].tolist(), None), (904, [1.0, None] * 8, 0)]
    got = {r["vec_id"]: r for r in embed_dedup.near_groups(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k[2] for k in rows])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.98 * near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _, _ in odd)


def test_embed_dedup_of_vectors_of_several_widths(spark):
    rows = [(i, [float(k + 1), *[0.0] * (w - 1)], 1) for i, (w, k) in enumerate([(16, 0), (16, 1), (8, 0), (8, 1), (3, 0)])] + [(9, [1.0, 0.1, *[0.0] * 6], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (2, 2), 3: (2, 2), 9: (2, 2), 4: (0, 4)}
    assert embed_dedup.near_groups(spark.createDataFrame([], "vec_id long, embedding array<double>, label int, node int, cell int")).count() == 0


def test_embed_dedup_of_single_precision(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(80, 12)).astype(np.float32)
    x = np.vstack([base, base[:30] + r.normal(size=(30, 12)).astype(np.float32) * np.float32(0.15), base[:2]])
    rows = [(i, [float(c) for c in v], i % 80 % 3) for i, v in enumerate(x)] + [(500, [float("inf")] * 12, 0), (501, [None] * 12, 0), (502, [], 1), (503, [0.0] * 12, 1), (504, None, 2)]
    one, two = ({k["vec_id"]: tuple(k) for k in embed_dedup.near_groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()} for kind in ("float", "double"))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([k[2] for k in rows[: len(x)]])
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    assert one == two and [one[i][1] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert all(one[i][1:] == (0, i, True) for i in range(500, 505))


def test_toxicity_learns(spark):
    r = random.Random(8)
    bad = ["scoundrel", "blackguard", "nincompoop"]
    rows, labels = [], []
    for i in range(900):
        w = words(r, 80).split()
        if i % 5 == 0:
            for k in range(5, 80, 12):
                w[k] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (950, "")], "doc_id long, text string")
    got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(x["predicted"], int(x["doc_id"] % 5 == 0)) for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 900]
    assert len(got) == 902 and sum(a == b for a, b in held) / len(held) > 0.95
    none = toxicity.classify(docs.limit(3), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [x["score"] for x in none] == [0.0] * 3


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    assert out.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, sum long, _id int"
    r = random.Random(12)
    long = words(r, 6000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, "x y z", "de", None, 5), (4, long + " end", "en", "b", 2), (5, words(r, 50), "en", "b", 3), (6, words(r, 50), "en", "b", 3)]
    docs = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], schema)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted((x["doc_id"] is None, x["doc_id"]) for x in df.collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "bpe":
            assert got.columns == corpus_pipeline.COLUMNS
        kept[name] = ids(got)
    every = ids(docs)
    assert kept["toxicity"] == every == kept["bpe"]
    assert kept["exact_dedup"] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (True, None)]
    assert kept["near_dedup"] == [(False, 1), (False, 3), (False, 5), (False, 6), (True, None)]
    assert {x for x in kept["mixing"]} <= {x for x in every if x[1] not in (1, 2)}


def test_lm_score_against_brute_force(spark):
    import zlib

    r = random.Random(21)
    pools = [words(r, 25).split() for _ in range(9)]
    rows = [(i, " ".join(r.choice(pools[c]) if r.random() < 0.9 else words(r, 1) for _ in range(r.randrange(0, 30))), f"l{c}") for i in range(260) for c in [min(int(r.expovariate(0.4)), 8)]]
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {x["doc_id"]: x["score"] for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path).collect()}

    learnt = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 7 != 2]
    sizes = Counter(x[2] for x in learnt)
    top = [c for c, _ in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[: lm_score.CLASSES]]
    assert len(sizes) > lm_score.CLASSES  # the rest is one class
    of = lambda c: c if c in top else "rest"
    by_class = {c: Counter() for c in [*top, "rest"]}
    for _, t, c in learnt:
        by_class[of(c)].update([*t.split(), ""])
    every = sum(by_class.values(), Counter())
    total = every.total()
    weights = lm_score.read_pieces(path)
    first, found = lm_score.Lattice(weights, sum(w for p, w in weights.items() if not p.startswith("▁")) / 3), Counter()
    for w, n in every.items():
        if w:
            first.expected(w, n, found)
    lattice = lm_score.Lattice({p: round(found.get(p, 0.0), 3) + lm_score.PSEUDO for p in weights}, total + lm_score.PSEUDO)
    docs_in = Counter(of(x[2]) for x in learnt)
    for i, t, _ in rows:
        logs = []
        for c, n in by_class.items():
            new = min(0.5, (sum(x == 1 for x in n.values()) + 1) / (n.total() + 1))
            at = math.log((docs_in[c] + 1) / (len(learnt) + len(by_class)))
            for w in [*t.split(), ""]:
                spelled = math.exp(lattice.log_probability(w)) if w else 0.0
                at += math.log((1 - new) * n[w] / n.total() + new * (0.2 * every[w] / total + 0.8 * spelled))
            logs.append(at)
        most = max(logs)
        assert got[i] == pytest.approx((most + math.log(sum(math.exp(x - most) for x in logs))) / math.log(10), rel=1e-6)


def test_mixing_against_brute_force(spark, docs):
    segments, chosen, sources = mixing.mix(docs, block=16)
    times = Counter((x["k"], x["block"]) for x in chosen.collect())
    assert {k for k, _ in times} <= set(range(len(sources))) and all(b < sources[k]["blocks"] for k, b in times)
    assert [sum(n for (k, _), n in times.items() if k == i) for i in range(len(sources))] == [s["quota"] for s in sources]
    rows = sorted({(x["k"], x["offset"], x["size"], x["doc_id"] or -1) for x in segments.collect() if x["size"]})
    expected, at = Counter(), {}
    for k, offset, size, doc in rows:  # the documents of a source lie one after the other
        assert offset == at.get(k, 0)
        at[k] = offset + size
        expected[doc, size, sum(times[k, p // 16] for p in range(offset, offset + size))] += 1
    assert [at.get(i, 0) for i in range(len(sources))] == [s["size"] for s in sources]
    got = Counter((x["doc_id"] or -1, x["size"], x["taken"]) for x in mixing.taken_words(docs, block=16).collect() if x["size"])
    assert got == expected
    # what no order of rows changes: shares by the rule, one source after the other, until none is above its limit
    size, weight = [s["size"] for s in sources], [s["weight"] for s in sources]
    free, share = set(range(len(size))), [0.0] * len(size)
    while free:
        left = 1.5 * sum(size) - sum(share[i] for i in range(len(size)) if i not in free)
        share = [left * weight[i] / sum(weight[j] for j in free) if i in free else share[i] for i in range(len(size))]
        over = {i for i in free if share[i] > 2 * size[i]}
        share = [2.0 * size[i] if i in over else share[i] for i in range(len(size))]
        if not over:
            break
        free -= over
    assert [s["target"] for s in sources] == pytest.approx(share)


def test_mixed_texts_keep_their_white_space(spark):
    r = random.Random(41)
    texts = {1: "  " + "".join(f"w{i}{r.choice([' ', chr(10), chr(9) * 2])}" for i in range(50_000))}
    texts |= {i: " ".join(f"d{i}x{j}" for j in range(r.randrange(1, 300))) for i in range(2, 60)}
    rows = [(i, t, "en", "a" if i == 1 else "b", 0) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, rows[0], rows[7]], "doc_id long, text string, lang string, source string, n_chars long")
    taken, got = Counter(), Counter()
    for x in mixing.taken_words(docs).collect():
        taken[x["doc_id"]] += x["taken"]
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t) for i, t in texts.items()}
    place = {w.strip(): (i, k) for i, ws in cut.items() for k, w in enumerate(ws)}
    for x in mixing.mixed_documents(docs).collect():
        at = [place[w] for w in x["text"].split()]
        assert at == sorted(set(at)) and {i for i, _ in at} == {x["doc_id"]}
        whole = len(at) == len(cut[x["doc_id"]])
        assert x["text"] == (texts[x["doc_id"]] if whole else "".join(cut[i][k] for i, k in at).rstrip()) and x["n_chars"] == len(x["text"])
        got[x["doc_id"]] += len(at)
    assert got == +taken


def test_html_text_against_brute_force_differencing(spark):
    r = random.Random(31)
    pages = []
    for host in range(5):
        menu = [f"menu {host} {k}" for k in range(8)]
        for k in range(r.randrange(1, 9)):
            lines = sorted(r.sample(range(8), r.randrange(0, 9)))
            own = [menu[i] for i in lines]
            for j in range(r.randrange(1, 4)):
                own.insert(r.randrange(len(own) + 1), f"own {host} {k} {j}")
            pages.append((f"http://h{host}/{k}", own))
    html = lambda own: "".join(f"<div>{x}</div>" for x in own)
    table = spark.createDataFrame([(i, u, html(own)) for i, (u, own) in enumerate(pages)], "page_id int, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_text.main_text(table).collect()}
    for i, (u, own) in enumerate(pages):
        near = [pages[j][1] for j in range(i - 2, i + 3) if j != i and 0 <= j < len(pages) and pages[j][0].rsplit("/", 1)[0] == u.rsplit("/", 1)[0]]
        # shared lines stand in the same order on all pages of a host, so all of them are a common subsequence
        gone = {x for x in own if near and sum(x in n for n in near) >= min(2, len(near))}
        assert got[i] == "\n\n".join(x for x in own if x not in gone), (i, own, near)
