"""Ranked search and hard negatives against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from stakeline.llm import negatives, search

DOCS = "doc_id long, text string, item_id string, rank int, score string"
ITEMS = "item_id long, text string, doc_id long, term string"


def split(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, k):
    texts = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    found = set()
    for item, terms in wanted.items():
        scored = []
        for doc, w in texts:
            tf, score = Counter(w), 0
            for t in terms & tf.keys():
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * (10**9 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * len(w) * n // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            found.add((item, rank, doc, -score))
    return found


def corpus():
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)] + ["Élan", "élan", "naïve", "日本", "A1b"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[3][1].upper()) for i in range(30)] + [docs[7], docs[7], (None, docs[3][1]), (None, None)]
    docs += [(300, None), (301, ""), (302, ".,;"), (303, "w1 " * 5000), (304, "İ K ſ w2")]
    items = [(i, " ".join(["w1", "w2", "w3", *rng.choices(pool, k=8)])) for i in range(25)]
    return docs, [*items, (0, "w9 w50"), (None, "w5 w6"), (50, None), (51, "?"), (52, "nowhere"), (53, docs[3][1])]


@pytest.mark.parametrize("sizes", [{}, {"plan_pairs": 20, "pass_pairs": 100, "floor_docs": 20}])
def test_search_equals_brute_force(spark, sizes):
    docs, items = corpus()
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*r, 1, "z") for r in items], ITEMS)
    rows = [tuple(r) for r in search.rank(frame, asked, k=4, **sizes).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected(docs, items, 4)


def test_search_in_slices(spark, monkeypatch):
    monkeypatch.setattr(search, "BYTES", 64)
    text = "w1 w2, " * 100 + "日本" * 50
    parts = list(search.terms(text.encode()))
    assert len(parts) > 5 and [w.decode() for p in parts for w in p] == split(text)


def test_search_of_empty_tables(spark):
    docs, items = corpus()
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(*r, "x", 1, "y") for r in docs[:3]], DOCS)
    asked = spark.createDataFrame([(*r, 1, "z") for r in items], ITEMS)
    assert search.rank(none, asked).count() == search.rank(some, nothing).count() == 0
    assert search.rank(some, nothing).columns == search.rank(some, asked).columns


def test_plan_sums_shared_sets_once():
    rng = np.random.default_rng(2)
    item = np.repeat(np.arange(40), 30)
    shared = np.arange(12)
    term = np.concatenate([np.concatenate([shared, rng.choice(np.arange(12, 300), 18, replace=False)]) for _ in range(40)])
    plan = search.make_plan(item, term, 300)
    assert plan.leaf[shared].max() == plan.leaf[shared].min()  # in all items: one leaf
    docs = rng.integers(0, 5, 400)
    codes = np.unique(docs * 300 + rng.integers(0, 300, 400))
    doc, at, worth = codes // 300, codes % 300, rng.integers(1, 10**12, len(codes))
    want = np.zeros((40, 5), dtype=np.int64)
    for i, t in zip(item, term):
        np.add.at(want[i], doc[at == t], worth[at == t])
    assert (plan.scores(at, doc, worth, 5) == want).all()
    assert plan.additions < len(item) - 40  # fewer than summing every item by itself


def test_plan_of_one_item():
    plan = search.make_plan(np.zeros(3, dtype=int), np.array([2, 0, 1]), 4)
    assert plan.size == 1 and plan.leaf.tolist() == [0, 0, 0, -1]


VECTORS = "vec_id long, embedding array<float>, label string, v int, anchor string"


def vectors():
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((5, 8))
    rows = []
    for i in range(240):
        x = centres[i % 5] * rng.choice([0.3, 1.0]) + rng.standard_normal(8) * 0.4
        rows.append((i, x.astype(np.float32).tolist(), "abc"[i % 3 if i % 4 else 0]))
    hot = rows[0][1]
    rows += [(300 + i, hot, "abc"[i % 2]) for i in range(12)]  # ties
    rows += [(400 + i, (-np.array(hot)).tolist(), "d") for i in range(4)]  # all scores of a pair below 0
    rows += [(500, [0.0] * 8, "a"), (510, [0.0] * 8, "b"), (520, [0.5, 0.25], "a"), (521, [0.5, 0.5], "a"), (522, [0.5, 0.125], "b")]
    rows += [(530, hot, None), (540, None, "a"), (550, [], "a"), (560, [*hot[:7], None], "a"), (570, [*hot[:7], float("nan")], "a")]
    rows += [(580, [*hot[:7], float("inf")], "a"), (None, hot, "a"), (590, hot, "alone"), rows[0], rows[0], (20, hot, "z")]
    return rows


def hard_negatives(rows, every, k, n, floor):
    known = {}
    for i, x, label in rows:
        if i is None or label is None or not x or None in x or not np.isfinite(x).all():
            continue
        row = (label, np.floor(256 * np.array(x, dtype=np.float64)).astype(int).tolist())
        known[i] = min(known.get(i, row), row)
    found = set()
    for a, (label, x) in known.items():
        if a % every:
            continue
        scores = {b: sum(p * q for p, q in zip(x, y)) for b, (_, y) in known.items() if b != a and len(y) == len(x)}
        best = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in best if known[b][0] == label][:k]:
            s = scores[p]
            fit = [b for b in best if known[b][0] != label and floor * s <= 100 * scores[b] <= 100 * s][:n]
            found |= {(a, p, r, b, s, scores[b]) for r, b in enumerate(fit, 1)}
    return found


@pytest.mark.parametrize("sizes", [{}, {"shard_cells": 100, "block_cells": 60}, {"shard_cells": 300, "ahead": 2}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    frame = spark.createDataFrame([(*r, 1, "x") for r in vectors()], VECTORS).repartition(4)
    rows = [tuple(r) for r in negatives.mine(frame, every=10, positives=3, negatives=4, floor=50, **sizes).collect()]
    want = hard_negatives(vectors(), 10, 3, 4, 50)
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in vectors()], VECTORS)
    assert negatives.mine(frame.limit(0)).count() == 0
    assert negatives.mine(frame.where("vec_id % 100 <> 0")).count() == 0
    with pytest.raises(Exception, match="too long"):
        negatives.mine(spark.createDataFrame([(0, [1e8], "a", 1, "x"), (1, [1e8], "a", 1, "x")], VECTORS)).count()


def test_index_omits_what_the_threshold_covers():
    rng = np.random.default_rng(1)
    rows, x = rng.integers(-200, 200, (500, 16)), rng.integers(-200, 200, 16)
    exact = rows @ x
    index = negatives.Index(rows)
    search = negatives.Search(index, x)
    for threshold in np.sort(exact)[[-2, -20, -100]].tolist():
        known = search.lower(threshold)
        assert set(np.flatnonzero(exact >= threshold)) <= set(known)
        assert (search.score[known] == exact[known]).all()
        assert search.used.sum() < rows.size and len(known) < len(rows)
