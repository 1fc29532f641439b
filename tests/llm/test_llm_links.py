"""Near-duplicate operators against brute force: embeddings, SimHash, components."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stakeline.llm import embeddings, simhash
from stakeline.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int, node long, unit string"
DOCS = "doc_id long, text string, fp string, rep long, component_id string"


def classes(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)]
    rows = [*chain, *star, (61, 99), (7, 7), (None, 3), (200, 199), (199, 200), (200, 199)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "x long, y long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {99: 61, 200: 199}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_components_random(spark):
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 400, (300, 2)).tolist()
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert [found.get(i, i) for i in range(400)] == classes(400, pairs)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(150):
        x = centres[i % 6] + rng.standard_normal(16) * rng.choice([0.05, 0.3])
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 3))
    hot = [float(v) for v in centres[0].astype(np.float32)]
    rows += [(200 + i, hot, 0) for i in range(30)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [*hot[:15], float("nan")], 0)]
    rows += [(304, [*hot[:15], None], 0), (305, hot, None), (306, hot[:8], 0), (307, [v * 3e30 for v in hot], 0)]
    return [*rows, (None, hot, 0), (200, hot, 0)]


@pytest.mark.parametrize("bucket", [4096, 8])
def test_embeddings_equal_all_pairs(spark, bucket):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, threshold=0.93, bucket=bucket).collect()}
    known = {r[0]: r for r in rows if r[0] is not None}
    assert found.keys() == known.keys() | {None}
    ids = sorted(known)
    usable = [
        i for i in ids
        if known[i][2] is not None and known[i][1] and None not in known[i][1]
        and np.isfinite(known[i][1]).all() and any(known[i][1])
    ]
    pairs = []
    for a in usable:
        for b in usable:
            x, y = (np.array(known[i][1], dtype=np.float32).astype(float) for i in (a, b))
            if a < b and known[a][2] == known[b][2] and len(x) == len(y):
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.93:
                    pairs.append((ids.index(a), ids.index(b)))
    links = np.bincount(np.array(pairs).ravel(), minlength=len(ids))
    for i, root, n in zip(ids, classes(len(ids), pairs), links):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (n, ids[root], root == ids.index(i))
    assert (found[None]["n_links"], found[None]["component_id"]) == (0, None)
    assert max(links) >= 30


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB É\t\n\x0b\x1c\xa0 İ"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(f"w{i * i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.lists(st.integers(0, 63), max_size=40), st.integers(0, 6))
def test_bk_tree_finds_all(values, flips, radius):
    values = values + [v ^ (1 << f) for v, f in zip(values, flips)]
    values = np.array(sorted(set(values)), dtype=np.uint64)
    order, edge = simhash.bk_tree(values)
    if not len(values):
        return
    q, n = simhash.bk_search(values, order, edge, values, radius)
    want = np.bitwise_count(values[:, None] ^ values[None]) <= radius
    assert sorted(zip(q.tolist(), n.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(want))))


def documents():
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{k}" for k in rng.integers(0, 300, 120)) for _ in range(12)]
    rows = [(i, base[i % 12] + (f" end{i}" if i % 5 == 0 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one"), (105, "one two"), (None, "one two")]
    return [*rows, (3, base[3]), (106, base[0].upper())]


@pytest.mark.parametrize("shard", [2048, 2])
def test_simhash_equals_all_pairs(spark, shard):
    rows = documents()
    frame = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)
    found = sorted((tuple(r) for r in simhash.near_duplicates(frame, shard=shard).collect()), key=repr)
    known = sorted({r for r in rows if r[0] is not None})
    prints = np.array([slow_fingerprint(t) for _, t in known], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    root = classes(len(known), list(zip(*np.nonzero(near))))
    place = {i: (f"{int(p):016x}", known[r][0]) for (i, _), p, r in zip(known, prints, root)}
    want = [(i, *place[i]) if i is not None else (None, f"{slow_fingerprint(t):016x}", None) for i, t in rows]
    assert found == sorted(want, key=repr)
    kept = simhash.drop_near_duplicates(frame, shard=shard)
    assert kept.columns == frame.columns
    stay = {i for i, (_, c) in place.items() if i == c} | {None}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(stay, key=repr)


def test_simhash_empty_and_alike(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == simhash.drop_near_duplicates(empty).count() == 0
    alike = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("the same text again").alias("text"))
    found = simhash.near_duplicates(alike, shard=2).select("component_id").distinct().collect()
    assert [r[0] for r in found] == [0]


def test_simhash_rows_without_an_id(spark):
    """Of copies without an id one stays, near rows with an id or not."""
    rows = [(None, "one two three four")] * 5 + [(None, "another text"), (None, None), (None, ""), (7, "one two three four")]
    frame = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.schema == frame.schema
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    assert got == sorted([(None, "one two three four"), (None, "another text"), (None, ""), (7, "one two three four")], key=repr)


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_with_two_texts_joins_their_groups(spark, turn):
    """Rows 3 and 5 share text A, rows 5 and 7 text B: one group, of which row 3 stays."""
    a, b, c = "alpha beta gamma delta", "one two three four five six", "quite another text it is"
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, b + " x y z"), (10, c)][::turn]
    frame = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
    assert found == {(3, 3), (5, 3), (7, 3), (9, 9), (10, 9)}
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(frame).collect()]
    assert sorted(i for i, _ in kept) == [3, 9]
    again = simhash.drop_near_duplicates(frame.repartition(3)).collect()
    assert sorted(kept) == sorted((r["doc_id"], r["text"]) for r in again)


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_with_two_vectors_joins_their_groups(spark, turn):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, x, 0), (5, x, 0), (5, y, 0), (7, y, 0), (8, z, 0), (9, z, 1)][::turn]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    found = {tuple(r) for r in embeddings.near_duplicates(frame, threshold=0.93).collect()}
    assert found == {(3, 1, 3, True), (5, 2, 3, False), (7, 1, 3, False), (8, 0, 8, True), (9, 0, 9, True)}
