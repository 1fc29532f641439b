"""SimHash near-duplicates: fingerprints, shards searched through BK-trees, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.llm.common import fresh, roots, store, trim, without
from stakeline.llm.components import components

SEED = 42
BITS = 64
# A shard's tree holds about this many fingerprints, and never more than SPLIT times as many.
SHARD = 2048
SPLIT = 4
QUERIES = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 for a text without words or NULL.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer words than a
    shingle is one shingle. A bit is set if more than half of the shingles' XXH64 hashes set it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = ends[shingle - 1 :] or ends[-1:]
    hashed = xxhash.xxh64_intdigest
    votes, total = np.zeros(BITS, dtype=np.int64), len(last)
    for at in range(0, total, 1 << 16):
        hashes = np.fromiter(
            (hashed(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])),
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            prints = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["id", "fp"])
        trim()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (the fingerprint as a signed long) per row of ``docs``, in the map tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id bigint, fp bigint")


def bk_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-tree over distinct fingerprints, in the order of insertion: ``order, edge``.

    ``order`` lists nodes by (parent, distance to the parent), the root first; ``edge`` holds
    ``parent * 65 + distance`` of each, which is sorted, so the children of a node within a span of
    distances are one slice. Built level by level: of the values below one parent at one distance
    the first becomes the child, the others go below it, as insertion one by one would do.
    """
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    parent = np.zeros(len(values), dtype=np.int64)
    edge = np.full(len(values), -1, dtype=np.int64)
    left = np.arange(1, len(values))
    while len(left):
        key = parent[left] * (BITS + 1) + np.bitwise_count(values[left] ^ values[parent[left]])
        found, first, place = np.unique(key, return_index=True, return_inverse=True)
        edge[left[first]] = found
        rest = np.ones(len(left), dtype=bool)
        rest[first] = False
        parent[left[rest]] = left[first][place[rest]]
        left = left[rest]
    order = np.argsort(edge, kind="stable")
    return order, edge[order]


def bk_search(
    values: np.ndarray, order: np.ndarray, edge: np.ndarray, queries: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, value) at most ``radius`` bits apart.

    All queries go down the tree together. From a node at distance d only the edges d - radius to
    d + radius are followed.
    """
    query, node, hits = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64), []
    while len(node):
        far = np.bitwise_count(queries[query] ^ values[node]).astype(np.int64)
        near = far <= radius
        hits.append((query[near], node[near]))
        base = node * (BITS + 1)
        low = np.searchsorted(edge, base + np.maximum(far - radius, 1), "left")
        high = np.searchsorted(edge, base + np.minimum(far + radius, BITS), "right")
        many = high - low
        query = np.repeat(query, many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        node = order[np.repeat(low, many) + step]
    return np.concatenate([q for q, _ in hits]), np.concatenate([n for _, n in hits])


def _build(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("fp")
    values = rows["fp"].to_numpy().view(np.uint64)
    order, edge = bk_tree(values)
    packed = [x.astype("<i8").tobytes() for x in (rows["fp"].to_numpy(), rows["rep"].to_numpy(), order, edge)]
    names = ("fps", "reps", "node_order", "edges")
    keys = {k: [int(rows[k].iloc[0])] for k in ("shard", "piece")}
    return pd.DataFrame(keys | {n: [x] for n, x in zip(names, packed)})


TREE = "shard bigint, piece bigint, fps binary, reps binary, node_order binary, edges binary"


def _search(radius: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = lambda x, kind="<i8": np.frombuffer(x, dtype=kind)
        for part in parts:
            for row in part.itertuples(index=False):
                values, reps = load(row.fps, "<u8"), load(row.reps)
                queries, asked = load(row.q_fps, "<u8"), load(row.q_reps)
                for at in range(0, len(queries), QUERIES):
                    q, n = bk_search(
                        values, load(row.node_order), load(row.edges), queries[at : at + QUERIES], radius
                    )
                    a, b = asked[at : at + QUERIES][q], reps[n]
                    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                    root = roots(len(nodes), place[: len(a)], place[len(a) :])
                    linked = root != np.arange(len(nodes))
                    if linked.any():
                        yield pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return run


def links(reps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links ``a, b`` that join all fingerprints at most ``radius`` bits apart, as a spanning set.

    ``reps`` holds distinct fingerprints ``fp`` and their name ``rep``. The 64 bits are cut into
    ``radius + 1`` blocks; close fingerprints agree in one block at least, so they meet in the shard
    of that block's leading bits. How many leading bits make a shard follows from the number of
    fingerprints: about ``shard`` to a tree. A shard that is larger, because many fingerprints are
    alike, is cut into pieces, and each piece is searched in every piece's tree. A tree goes, as one
    row of bounded size, to the tasks that search it.
    """
    blocks = radius + 1
    width = BITS // blocks
    wanted = math.ceil(math.log2(max(reps.count() / shard, 1)))
    lead = min(wanted, width)
    tops = [
        F.shiftrightunsigned("fp", BITS - i * width - lead).bitwiseAND((1 << lead) - 1).cast("long")
        if lead
        else F.lit(0).cast("long")
        for i in range(blocks)
    ]
    spread = reps.select(
        "fp", "rep", F.posexplode(F.array(*tops)).alias("block", "top")
    ).select("fp", "rep", (F.col("block").cast("long") * (1 << 32) + F.col("top")).alias("shard"))
    large = spread.groupBy("shard").count().where(F.col("count") > SPLIT * shard)
    large = store(large.select("shard", F.ceil(F.col("count") / shard).alias("pieces")), "large-shards")
    split = not large.isEmpty()
    if split:
        spread = spread.join(large, "shard", "left").withColumn(
            "piece", F.pmod(F.xxhash64("fp"), F.coalesce("pieces", F.lit(1)))
        )
    else:
        spread = spread.withColumn("piece", F.lit(0).cast("long"))
    trees = spread.select("shard", "piece", "fp", "rep").groupBy("shard", "piece").applyInPandas(_build, TREE)
    if split:
        trees = store(trees, "trees")
        asked = trees.select("shard", F.col("piece").alias("q"), F.col("fps").alias("q_fps"), F.col("reps").alias("q_reps"))
        pairs = trees.join(asked, "shard").where("q >= piece").drop("q")
    else:
        pairs = trees.withColumns({"q_fps": F.col("fps"), "q_reps": F.col("reps")})
    return pairs.mapInPandas(_search(radius), "a bigint, b bigint")


def _one_document(prints: DataFrame, reps: DataFrame) -> DataFrame:
    """Links ``a, b`` between the representatives of fingerprints that rows of one id have."""
    named = prints.where("id is not null")
    several = named.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    theirs = named.join(several.select("id"), "id", "left_semi").distinct().join(reps, "fp")
    least = theirs.groupBy("id").agg(F.min("rep").alias("b"))
    return theirs.join(least, "id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    shard: int = SHARD,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and ``component_id``
    is the smallest id reachable. A NULL or empty text has fingerprint zero and links like any
    other. Equal fingerprints collapse before any pair is looked at, so copies cost nothing. Rows that
    share an id are one document, which has the links of all its texts. A row without an id keeps a
    NULL component and links nothing. Repeated rows come back repeated, with equal values. A very
    long text is read whole, in its task. Other columns of ``docs`` are ignored; an empty table gives
    an empty result.
    """
    prints = store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    reps = store(reps, "representatives")
    found = components(links(reps, radius, shard).unionByName(_one_document(prints, reps)))
    place = reps.join(found, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(place, "fp", "left").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, **options
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each near-duplicate group.

    Of rows without an id one of each fingerprint stays, and of rows that share an id one: the one
    whose text hashes lowest.
    """
    found = store(near_duplicates(docs, id_col, text_col, shingle, **options), "near-duplicates")
    kept = without(docs, id_col, store(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies"))
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    alike = found.where("doc_id is null").groupBy("fingerprint").count().where("count > 1")
    named, nameless = kept.where(F.col(id_col).isNotNull()), kept.where(F.col(id_col).isNull())
    if not alike.isEmpty():
        nameless = _one_per_fingerprint(nameless, text_col, shingle)
    elif repeated.isEmpty():
        return kept
    if not repeated.isEmpty():
        twice = store(repeated, "repeated-ids").toDF(name := fresh(docs, "_twice"))
        same = F.col(id_col) == F.col(name)
        some = named.join(twice, same, "left_semi")
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.xxhash64(text_col), F.col(text_col)))
        some = some.groupBy(F.col(id_col).alias(name)).agg(first.alias("row")).select("row.*")
        named = named.join(twice, same, "left_anti").unionByName(some)
    return nameless.unionByName(named)


def _one_per_fingerprint(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    text = F.col(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), prints(text).alias("fp"), F.xxhash64(text).alias("order"), text.alias("text"))
    first = rows.groupBy("fp").agg(F.min_by("row", F.struct("order", "text")).alias("row"))
    return first.select("row.*")
