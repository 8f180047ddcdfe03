from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sheaf.llm import packing, repair_grammar, token_counts
from sheaf.llm.tokens import Encoder

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
FIXED = [
    "", " ", "a  b   c\n\n\nd \n e", "I've they're we'll x'r 'll 've're '", "<|endoftext|>", "a!<|endoftext|>b<|endoftext|><|endoft", "日本語 テスト é é 🙂🙂  🙂", "    x  y\x1c z\x1d", "１２ ²³ x²",
    "!!'re !!'s  's 's\n're\t'll", "İstanbul ΣΑΣ. ΑΣ, x İ́", "word. Word, WORD.. word!?", "Straße ǅ é́", "a" * 500, "--" * 200,
]


def some(n, alphabet=" \n\tab'rels!<|endoftx>é1.,İ", seed=1, size=40):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_encoder_equals_the_library():
    e, t = Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = FIXED + some(800, size=80)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert e.encode(texts) == want and e.encode(texts) == want


def test_counts_of_every_prefix_equal_the_library():
    c, t = token_counts.PrefixCounter(BYTES), Tokenizer.from_file(BYTES)
    for x in FIXED + some(300):
        want = [len(t.encode(x[: i + 1], add_special_tokens=False).ids) for i in range(len(x))]
        assert list(c.counts(x)) == want
        n, table = c.table(x)
        assert n == (want[-1] if want else 0) and list(token_counts.prefix_counts(table)) == [0, *want]
        if want:
            k = len(x) // 2
            assert token_counts.tokens_in_prefix(table, k) == ([0, *want])[k]
            best = token_counts.longest_prefix(table, 5)
            assert best == max(i for i, n in enumerate([0, *want]) if n <= 5)


def test_token_tables_of_odd_rows(odd_docs, none_docs):
    rows = token_counts.token_tables(odd_docs, BYTES).collect()
    t = Tokenizer.from_file(BYTES)
    assert len(rows) == odd_docs.count()
    assert all(r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids) and r["n_bytes"] == len((r["text"] or "").encode()) for r in rows)
    assert token_counts.token_tables(none_docs, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_the_naive_one(seed):
    r = random.Random(seed)
    size = r.choice((16, 64, 2048))
    lengths = [r.randint(1, size) for _ in range(r.randint(0, 400))]
    steps, windows = packing.best_fit(dict(Counter(lengths)), size)
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(room) if x >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(size - n)
    assert windows == len(room)
    rank: Counter = Counter()
    ranks = []
    for n in lengths:
        ranks.append(rank[n])
        rank[n] += 1
    window, offset = packing.Placement(steps).find(np.array(lengths, "int64"), np.array(ranks, "int64"))
    for w in set(window.tolist()):
        at = 0
        for o, n in sorted((o, n) for x, o, n in zip(window, offset, lengths) if x == w):
            assert o == at
            at += n
        assert at <= size


def test_packed_ids_are_all_ids(spark, odd_docs, none_docs):
    rows = packing.pack(odd_docs, WORDS, size=64).collect()
    t = Tokenizer.from_file(WORDS)
    texts = [r["text"] or "" for r in odd_docs.collect()]
    want = Counter(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts)
    by_doc: dict = {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] <= 64
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert sum(r["length"] for r in rows) == sum(len(x) // 4 * n for x, n in want.items())
    long = max(by_doc, key=lambda k: k[1])
    assert b"".join(p for _, p in sorted(by_doc[long])) in want
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for o, n in sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(none_docs, WORDS).count() == 0


@pytest.mark.parametrize("base", (10, 60_000, 70_000))
def test_grammar_round_trip(base):
    r = np.random.default_rng(base)
    for _ in range(40):
        ids = r.integers(0, 4, r.integers(0, 3000)).astype("<u4")
        g = repair_grammar.Grammar.from_bytes(repair_grammar.compress(ids, base).to_bytes())
        assert (g.ids() == ids).all()
        i, n = (int(x) for x in r.integers(0, 3000, 2))
        assert (g.ids(i, n) == ids[i : i + n]).all()
    long = np.tile(np.arange(9, dtype="<u4"), 4000)
    g = repair_grammar.compress(long, base)
    assert len(g.symbols) < len(long) / 8 and (g.ids() == long).all()


@pytest.mark.parametrize("base", (49_408, 61_400, 70_000))
def test_no_frequent_pair_is_left(base):
    r = np.random.default_rng(base)
    passage = r.integers(0, 40_000, 300)
    parts = [passage] * 40 + [r.integers(0, 100, 400_000)] + [r.integers(0, 40_000, 20_000)] + [np.full(5_000, 7)]
    ids = np.concatenate(parts).astype("<u4")
    g = repair_grammar.Grammar.from_bytes(repair_grammar.compress(ids, base).to_bytes())
    assert (g.ids() == ids).all() and (g.ids(5_000, 9_000) == ids[5_000:14_000]).all()
    left = Counter(zip(g.symbols[:-1].tolist(), g.symbols[1:].tolist()))
    assert max(left.values()) < repair_grammar.FREQUENT
    assert g.lengths.max() > 100


def test_token_files_in_order(spark, odd_docs, none_docs):
    folder = repair_grammar.new_folder(spark)
    repair_grammar.write_ids(odd_docs, WORDS, folder)
    rows = sorted(repair_grammar.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(WORDS)
    given = sorted(((-1 if r["doc_id"] is None else r["doc_id"], "" if r["text"] is None else r["text"], r["text"] is not None) for r in odd_docs.collect()), key=lambda x: (x[0], x[2], x[1]))
    at = 0
    for r, (k, text, _) in zip(rows, given, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        assert r["doc_id"] == (None if k == -1 else k)
        at += len(ids)
    empty = repair_grammar.new_folder(spark)
    repair_grammar.write_ids(none_docs, WORDS, empty)
    assert repair_grammar.read_ids(spark, empty).count() == 0
