import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lecturelake.llm import ranked

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERMS.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    tfs = [(key, Counter(terms_of(text))) for key, text in docs]
    tfs = [(key, tf) for key, tf in tfs if tf]
    n_docs, n_terms = len(tfs), sum(sum(tf.values()) for _, tf in tfs)
    df = Counter(t for _, tf in tfs for t in tf)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for key, tf in tfs:
            m = 50 + 50 * sum(tf.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if score > 0:
                scored.append((-score, key is None, key if key is not None else 0))
        out += [(item, i + 1, None if null else key, -score) for i, (score, null, key) in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(ranked, "SHARD_DOCS", 40)
    monkeypatch.setattr(ranked, "GROUP_SHARDS", 2)


def test_search_equals_brute_force(spark, small_shards):
    rng = random.Random(2)
    words = ["Alpha", "beta", "GAMMA", "über", "x1", "日本", "d", "e", "f", "the", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["", "the.of;", "\n", "é-É"]) for _ in range(300)]
    docs = [*enumerate(texts), *[(1000 + i, "alpha beta beta") for i in range(150)], (None, "beta"), (None, "beta"), (7, "alpha beta"), (7, "alpha beta"), (2000, None), (2001, ""), (2002, "-- ..")]
    docs.append((3000, "Alpha " * 700_000 + "needle"))
    items = [(1, "alpha BETA the"), (2, "日本 x1 X1"), (3, None), (4, ""), (5, "needle"), (6, "absent"), (None, "gamma"), (8, "beta"), (8, "über"), (9, "alpha beta")]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    asked = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int")
    for k in (1, 50, 1000):
        got = Counter(tuple(r) for r in ranked.rank(df, asked, k).select("item_id", "rank", "doc_id", "score").collect())
        assert got == plain(docs, items, k)
    assert ranked.rank(df.limit(0), asked).count() == 0 and ranked.rank(df, asked.limit(0)).count() == 0


def test_keys_of_other_types(spark):
    docs = [("b", "one two"), ("a", "two"), ("é", "two"), ("aa", "two three")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = Counter(tuple(r) for r in ranked.rank(df, spark.createDataFrame([("q", "two three")], "item_id string, text string")).select("item_id", "rank", "doc_id", "score").collect())
    want = sorted(plain([(i, t) for i, (_, t) in enumerate(sorted(docs))], [("q", "two three")], 50))
    names = sorted(k for k, _ in docs)
    assert got == Counter((q, r, names[d], s) for q, r, d, s in want)


def test_treap_equals_a_scan():
    rng = np.random.default_rng(5)
    for n_rows, n_columns, n in ((1, 1, 1), (1, 40, 30), (50, 1, 30), (60, 50, 700), (5, 3000, 6000)):
        cells = rng.choice(n_rows * n_columns, min(n, n_rows * n_columns), replace=False)
        values = rng.integers(1, 6, len(cells))  # many ties
        tree = ranked.Treap(ranked.squeezed(*ranked.treap(cells // n_columns, cells % n_columns, values)))
        dense = np.zeros((n_rows, n_columns), np.int64)
        dense[cells // n_columns, cells % n_columns] = values
        for k in (1, 7, 5000):
            rows = rng.choice(n_rows, min(n_rows, 4), replace=False)
            weights = rng.integers(1, 9, len(rows))
            scores = weights @ dense[rows]
            for floor in (1, int(np.median(scores)) + 1):
                want = sorted(((int(s), int(c)) for c, s in enumerate(scores) if s >= floor), key=lambda x: (-x[0], x[1]))[:k]
                assert tree.best(rows, weights, k, floor) == want


def test_good_ranges_are_found_without_the_rest():
    # a hundred thousand columns, of which few hold the rare row: the others are never reached
    columns = np.arange(100_000)
    rare = columns[::1000]
    tree = ranked.Treap(ranked.squeezed(*ranked.treap(np.r_[np.zeros(len(columns), int), np.ones(len(rare), int)], np.r_[columns, rare], np.r_[np.ones(len(columns), int), np.full(len(rare), 50)])))
    seen = []
    masks = tree.masks
    tree.masks = [type("Counted", (), {"__getitem__": lambda self, i, m=m: seen.append(len(i)) or m[i]})() for m in masks]
    assert tree.best(np.array([0, 1]), np.array([1, 10]), 20) == [(501, int(c)) for c in rare[:20]]
    assert sum(seen) < 5000


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(ranked, "HASHED", 64)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é.Z9 ") for _ in range(rng.choice([0, 3, 50, 64, 65, 700]))) for _ in range(60)] + ["x" * 500, "", "a" * 64 + " " + "b" * 64]
    raw = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(r) for r in raw])]
    hashes, offsets = ranked.term_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
    names = {}
    for i, t in enumerate(texts):
        own = hashes[offsets[i] : offsets[i + 1]].tolist()
        assert len(own) == len(terms_of(t))
        for h, term in zip(own, terms_of(t), strict=True):
            assert names.setdefault(h, term) == term
    assert len(set(names.values())) == len(names)
