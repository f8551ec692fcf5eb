"""The encoder of op12: cuts as the library does, looks each distinct piece of many texts up once, and Re-Pair's shorter rounds give the same files."""

import itertools
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from squadframe.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_the_librarys():
    cut = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    r = random.Random(5)
    low = [chr(i) for i in range(0x250)]
    odd = list("ab 's1\xb2\n\t\r\xa0\x85\x1c\x1d.é$\xaa\xba\xb5ŉǅɏɐ’　  ​ﬀ語\U0001f600")
    texts = [a + x + b for x in low for a in ("", " ", "a", "1", "'") for b in ("", "a", "1", " ", "\n", "'s")]
    texts += ["".join(x) for x in itertools.product("a 1'\n.sé", repeat=4)]
    texts += ["".join(r.choices(s, k=r.randrange(15))) for s in (low, odd) for _ in range(5000)]
    # each character that the pattern takes, between letters, numbers and signs
    more = [c for c in map(chr, [*range(0x250, 0xD800), *range(0xE000, 0x10000)]) if not token_files._WIDE.search(c)]
    texts += [f"{x}a{x}1 {x}.{x}\n{x}{x} 's{x}" for x in more]
    assert len(more) > 30_000 and not token_files._WIDE.search("".join(low))
    encode = token_files.Encoder(PATH)
    for t in texts:
        assert encode.pieces(t) == [t[i:j] for _, (i, j) in cut(t)], repr(t)


def test_each_distinct_piece_is_looked_up_once(monkeypatch):
    encode, asked = token_files.Encoder(PATH), []

    class Counting(dict):
        def __getitem__(self, piece):
            asked.append(piece)
            return held[piece]

    held, encode.ids = encode.ids, Counting()
    texts = ["the same words again and the same " * 50, "", "again\nthe same words 語 語", "don't, don't"] * 20
    whole = encode(texts)
    assert len(asked) == len(set(asked)) == len({p for t in texts for p in encode.pieces(t)})
    tokenizer = Tokenizer.from_file(PATH)
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in whole] == expected
    # also where a text's pieces are in several blocks
    monkeypatch.setattr(token_files, "BLOCK", 7)
    assert encode(texts) == whole and encode([]) == [] and encode(["", ""]) == [b"", b""]


def test_memory_forgets_and_stays_bounded():
    made = []
    memory = token_files.Memory(lambda x: made.append(x) or x.encode(), 10)
    for k in range(100):
        assert memory[str(k)] == str(k).encode() and memory["often"] == b"often"
        assert len(memory) <= 10 and len(memory.older) <= 10
    assert made.count("often") == 1 and len(made) == 101
    assert memory["x" * 40] == b"x" * 40 and "x" * 40 not in memory


def all_pairs_grammar(ids, first, end, least):
    """Re-Pair's rounds with every pair counted in every round."""
    seq, rules = ids.tolist(), []
    slot = lambda p: ((p[0] * 0x9E3779B1 ^ p[1] * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - token_files._SLOTS)
    while True:
        counts = {}
        for p in zip(seq, seq[1:], strict=False):
            if p[0] != end:
                counts[p] = counts.get(p, 0) + 1
        found = sorted((p for p in counts if counts[p] >= least), key=lambda p: (-counts[p], p))
        chosen, ranks, taken = [p for p in found if counts[p] >= counts[found[0]] // token_files.TOGETHER], {}, set()
        for k, p in enumerate(chosen):
            if slot(p) not in taken:
                taken.add(slot(p))
                ranks[p] = k
        rank = [ranks.get(p, len(chosen)) for p in zip(seq, seq[1:], strict=False)] + [len(chosen)]
        at = [i for i, k in enumerate(rank[:-1]) if k < len(chosen) and k <= rank[i + 1] and (i == 0 or k <= rank[i - 1])]
        places = []
        for i in at:
            if not (places and places[-1] == i - 1):
                places.append(i)
        uses = {k: sum(rank[i] == k for i in places) for k in {rank[i] for i in places}}
        good = {k: first + len(rules) + n for n, k in enumerate(sorted(k for k in uses if uses[k] >= max(2, least // 2)))}
        if not good:
            return rules, seq
        rules += [chosen[k] for k in good]
        places = {i: good[rank[i]] for i in places if rank[i] in good}
        seq = [places.get(i, x) for i, x in enumerate(seq) if i - 1 not in places]


def test_rounds_over_open_pairs_are_whole_rounds():
    r = np.random.default_rng(7)
    words = [r.integers(3, 60, r.integers(1, 6)) for _ in range(300)]
    zipf = np.concatenate([np.append(np.concatenate([words[min(299, k)] for k in r.zipf(1.3, 40)]), 2) for _ in range(250)])
    for ids, least in ((zipf, 4), (zipf, 16), (np.tile([5, 5, 5, 6], 900), 4), (r.integers(3, 9, 5000), 4), (np.full(777, 7), 2)):
        ids = ids.astype("<u4")
        rules, seq = all_pairs_grammar(ids, 100, 2, least)
        got = token_files.grammar(ids, 100, 2, least)
        assert got[0].tolist() == [list(p) for p in rules] and got[2].tolist() == seq
