from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from sheaf.llm.decontamination import contamination, similarity, simhashes, Items
from sheaf.llm.graph import components
from sheaf.llm.minhash import near_duplicates

import numpy as np

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets(texts, k):
    out = []
    for t in texts:
        w = _WORD.findall((t or "").encode().lower())
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(texts, k, percent):
    s = sets(texts, k)
    top = list(range(len(s)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(s))], [len(x) for x in s]


def family(r, n, words, edits):
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = f"x{r.randint(0, 99999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k,percent,seed", [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_classes_equal_brute_force(docs, k, percent, seed):
    r = random.Random(seed)
    texts = family(r, 40, 120, 12) + family(r, 10, 8, 2) + family(r, 25, 60, 4) + ["same text twice"] * 5 + ["", None, "two words", "TWO  words", "one"]
    texts += [" ".join(f"u{r.randint(0, 99999)}" for _ in range(50)) for _ in range(30)]
    r.shuffle(texts)
    want, sizes = brute(texts, k, percent)
    got = {row["id"]: row for row in near_duplicates(docs(texts), k=k, percent=percent).collect()}
    assert [got[i]["component"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_a_large_family_is_dealt_to_blocks(docs, monkeypatch):
    from sheaf.llm import minhash

    monkeypatch.setattr(minhash, "CHUNK", 8)
    texts = family(random.Random(9), 60, 100, 8)
    want, _ = brute(texts, 3, 85)
    got = {row["id"]: row["component"] for row in near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(60)] == want


def test_copies_whose_buckets_begin_with_other_documents(docs, monkeypatch):
    from sheaf.llm import minhash

    # bands of one row: every band of the two copies has smaller members that hold their line by chance
    for name, value in (("BANDS", 160), ("ROWS", 1), ("PART", 64)):
        monkeypatch.setattr(minhash, name, value)
    r = random.Random(5)
    line = " ".join(f"l{i}" for i in range(32))
    texts = [f"{line} " + " ".join(f"h{r.randint(0, 10**9)}" for _ in range(20)) for _ in range(400)] + [line, f"{line} and three more"]
    got = {row["id"]: row["component"] for row in near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(402)] == [*range(401), 400]


def test_ties_connect_what_is_near():
    from sheaf.llm.minhash import _unequal, ties_of

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (6, 5)).astype("uint64")
    bits = np.repeat(base, 30, axis=0)
    for row in bits:
        for _ in range(8):
            row[r.integers(5)] ^= np.uint64(1) << np.uint64(r.integers(63))
    found = ties_of(np.arange(180), bits, 16)
    top = list(range(180))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in found:
        assert _unequal(bits[a], bits[b : b + 1])[0] <= 16
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    assert all(root(a) == root(b) for a in range(180) for b in np.flatnonzero(_unequal(bits[a], bits) <= 16).tolist())
    assert len(found) == 180 - len({root(i) for i in range(180)})


def test_boilerplate_makes_no_candidates(docs, monkeypatch):
    """Texts that share half their words fill the same buckets, but none is compared on its full set."""
    from sheaf.llm import minhash

    asked = []
    blocks = minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda members, *rest: asked.append(members.count()) or blocks(members, *rest))
    monkeypatch.setattr(minhash, "PART", 16)
    r = random.Random(6)
    notice = " ".join(f"n{i}" for i in range(60))
    texts = [f"{notice} " + " ".join(f"h{r.randint(0, 10**9)}" for _ in range(60)) for _ in range(300)]
    texts += [texts[7] + " more", texts[8].replace("n30", "other")]
    want, _ = brute(texts, 3, 85)
    got = {row["id"]: row["component"] for row in near_duplicates(docs(texts)).collect()}
    assert [got[i] for i in range(302)] == want and want[300:] == [7, 8]
    assert asked == [4]


def test_near_odd_rows(odd_docs, none_docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component"] for r in rows if r["id"] is None} == {None}
    assert {r["component"] for r in rows if r["id"] == 1} == {1}
    assert near_duplicates(none_docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(20, 61)} == {20} and {got[i] for i in range(100, 140)} == {100} and 7 not in got


def contaminated(texts, items, k=5, least=0.8):
    out = set()
    for i, item in enumerate(items):
        w = (item or "").encode().lower().split()
        own = min(k, len(w))
        bag = Counter(tuple(w[j : j + own]) for j in range(len(w) - own + 1)) if w else Counter()
        for d, t in enumerate(texts):
            v = (t or "").encode().lower().split()
            s = [tuple(v[j : j + own]) for j in range(len(v) - own + 1)] if own else []
            m = min(len(w) - own + 1, len(s))
            for j in range(len(s) - m + 1 if m > 0 else 0):
                a = Counter(s[j : j + m])
                both = sum((a & bag).values())
                if both >= least * (sum(a.values()) + sum(bag.values()) - both):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("part_bytes", [8 << 20, 600])
def test_contamination_equals_brute_force(spark, docs, monkeypatch, part_bytes):
    from sheaf.llm import decontamination

    monkeypatch.setattr(decontamination, "PART_BYTES", part_bytes)
    r = random.Random(4)
    items = [" ".join(f"b{r.randint(0, 300)}" for _ in range(r.randint(1, 60))) for _ in range(25)] + ["", None, "the only words here now"]
    texts = []
    for _ in range(80):
        words = [f"c{r.randint(0, 300)}" for _ in range(r.randint(0, 200))]
        item = (r.choice(items) or "").split()
        if r.random() < 0.6:
            for _ in range(r.choice((0, 0, 1, 2))):
                if item:
                    item[r.randrange(len(item))] = "edited"
            at = r.randint(0, len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contamination(docs(texts), bench).collect()}
    assert got == contaminated(texts, items)


def test_contamination_odd_rows(spark, odd_docs, none_docs, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, None), (2, "")], "item_id long, text string")
    assert {r["doc_id"] for r in contamination(odd_docs, bench).collect()} == {1}
    assert contamination(none_docs, bench).count() == 0 and contamination(odd_docs, bench.limit(0)).count() == 0


def test_all_within_the_radius_are_found():
    r = np.random.default_rng(2)
    group = Items(5, 30)
    for i in range(50):
        group.add(i, r.integers(0, 1 << 63, 26).astype("uint64"))
    group.settle()
    probes = np.concatenate([group.print ^ np.uint64(int(sum(1 << int(b) for b in r.choice(64, k, replace=False)))) for k in (0, 5, 19)])
    w, i = group.candidates(probes)
    found = set(zip(w.tolist(), i.tolist()))
    assert all((j * 50 + k, k) in found for j in range(3) for k in range(50))
    assert similarity(Counter("aab"), Counter("ab")) == 2 / 3
    assert len(simhashes(r.integers(0, 1 << 63, 500).astype("uint64"), 26, np.array([0, 1, 400]))) == 3
