"""Hard negatives: threshold joins over an inverted index whose lists are cut by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeline.llm.common import store

EVERY, POSITIVES, NEGATIVES, FLOOR = 100, 5, 5, 80
SCALE, LABELS = 256, 10
# Components of the rows and of the anchors that meet in one task; every so many shards one is searched ahead.
SHARD_CELLS, BLOCK_CELLS, AHEAD = 1 << 19, 1 << 18, 16
# A threshold is lowered to this part of itself while a window isn't full.
LOWER = 0.85

NO_BOUND = -(1 << 62)
FOUND = "anchor long, window int, id long, score long"


class Index:
    """An inverted index over integer vectors of one length.

    Dimensions are in the order of falling energy. Row y's entry in dimension k stands in that
    dimension's list with the norm of y from k on, and the lists fall by this norm. Against an anchor
    x, entries whose norm times the norm of x stays below the threshold can't reach it by themselves,
    so what a threshold omits is the tail of each list, and lowering it only adds entries.
    """

    def __init__(self, vectors: np.ndarray):
        self.rows, self.dims = vectors.shape
        self.order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.vectors = vectors[:, self.order]
        squares = self.vectors.astype(np.float64) ** 2
        # A little more than the norm, so that rounding never hides a row.
        self.suffix = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
        self.lists = np.argsort(-self.suffix, axis=0, kind="stable").T.copy()
        self.norms = np.take_along_axis(self.suffix.T, self.lists, axis=1)
        self.values = np.take_along_axis(self.vectors.T, self.lists, axis=1)


class Search:
    """One anchor against an index: scores get known as its threshold falls."""

    def __init__(self, index: Index, anchor: np.ndarray):
        self.index, self.anchor = index, anchor[index.order]
        squares = self.anchor.astype(np.float64) ** 2
        self.left = np.append(np.sqrt(np.cumsum(squares[::-1])[::-1]) * (1 + 1e-9), 0.0)
        self.most = self.left[0] * index.norms[0, 0]  # no score is higher
        self.used = np.zeros(index.dims, dtype=np.int64)  # entries taken from each list
        self.depth = np.zeros(index.rows, dtype=np.int64)  # dimensions taken of each row
        self.partial = np.zeros(index.rows, dtype=np.int64)
        self.score = np.zeros(index.rows, dtype=np.int64)
        self.known = np.zeros(index.rows, dtype=bool)

    def lower(self, threshold: int) -> np.ndarray:
        """Rows whose scores are known now; all that score ``threshold`` or more are among them."""
        index = self.index
        if threshold <= 0 or not self.left[0]:
            need = np.flatnonzero(~self.known)
        else:
            least = threshold / self.left[0]
            for k in range(index.dims):
                stop = int(np.searchsorted(-index.norms[k], -least, side="right"))
                if not stop:
                    break  # later lists hold lower norms still
                taken = slice(self.used[k], stop)
                rows = index.lists[k, taken]
                self.partial[rows] += self.anchor[k] * index.values[k, taken]
                self.depth[rows] += 1
                self.used[k] = stop
            seen = np.flatnonzero((self.depth > 0) & ~self.known)
            depth = self.depth[seen]
            rest = np.where(depth < index.dims, index.suffix[seen, np.minimum(depth, index.dims - 1)], 0.0)
            need = seen[self.partial[seen] + self.left[depth] * rest >= threshold * (1 - 1e-9) - 1]
        self.score[need] = index.vectors[need] @ self.anchor
        self.known[need] = True
        return np.flatnonzero(self.known)


def fill(search: Search, wanted: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], size: int) -> list[np.ndarray]:
    """For each window ``(low, high)`` of scores its first ``size`` of the ``wanted`` rows (a mask), best first.

    The threshold starts at the highest score that can be, and falls until each window holds ``size``
    rows above it or reaches its low end.
    """
    best: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(windows)
    open_ = list(range(len(windows)))
    top = min(search.most, max((high for _, high in windows), default=0))
    threshold = int(top * LOWER)
    while open_:
        threshold = max(threshold, min(windows[w][0] for w in open_))
        if threshold < search.most * 0.05:
            threshold = min(0, threshold)  # bounds this low prune nothing
        rows = search.lower(threshold)
        rows = rows[wanted[rows]]
        rows = rows[np.lexsort((ids[rows], -search.score[rows]))]
        score = search.score[rows]
        for w in list(open_):
            low, high = windows[w]
            inside = rows[(score >= max(low, threshold) if threshold > 0 else score >= low) & (score <= high)][:size]
            if len(inside) == size or threshold <= max(low, 0):
                best[w] = inside
                open_.remove(w)
        threshold = int(threshold * LOWER)
    return best


def _matrices(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of each width: their places in the column, and a matrix."""
    column = pa.chunked_array([c for c in column.chunks if len(c)], column.type).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        places = np.flatnonzero(widths == width)
        matrix = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        if ((matrix.astype(np.float64) ** 2).sum(axis=1) >= 2.0**62).any():
            raise ValueError("a vector is too long for scores of 64 bits")
        yield places, matrix


def _mine(same_label: bool, size: int):
    """Best rows of a shard for each window of the anchors of a block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            ids, labels = rows.column("id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
            shard = {matrix.shape[1]: (places, matrix) for places, matrix in _matrices(rows.column("v"))}
            anchor, label = anchors.column("anchor").to_pylist(), anchors.column("own").to_pylist()
            windows = anchors.column("windows").to_pylist()
            indexes: dict = {}
            for at, matrix in _matrices(anchors.column("x")):
                places, vectors = shard.get(matrix.shape[1], (None, None))
                if places is None:
                    continue
                for i, x in zip(at.tolist(), matrix):
                    key = (len(x), label[i] if same_label else None)
                    if key not in indexes:
                        mine = np.flatnonzero(labels[places] == label[i]) if same_label else np.arange(len(places))
                        indexes[key] = (places[mine], Index(vectors[mine]) if len(mine) else None)
                    part, index = indexes[key]
                    if index is None:
                        continue
                    wanted = ids[part] != anchor[i] if same_label else labels[part] != label[i]
                    bounds = [(w["low"], w["high"]) for w in windows[i]]
                    search = Search(index, x)
                    for w, best in zip(windows[i], fill(search, wanted, ids[part], bounds, size)):
                        out[0] += [anchor[i]] * len(best)
                        out[1] += [w["window"]] * len(best)
                        out[2] += ids[part][best].tolist()
                        out[3] += search.score[best].tolist()
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(out, types)], names=["anchor", "window", "id", "score"])

    return run


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, shards: int, ahead: int, same_label: bool, size: int) -> DataFrame:
    """Best ``size`` rows of every anchor's windows: ``anchor, window, id, score, rank``.

    Each shard of rows meets each block of anchors, as one group. If there are many shards, every
    ``ahead``-th goes first: where it fills a window, the last score it found is a low end below
    which the other shards need not look.
    """
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")

    def meet(asked: DataFrame, pick: Column) -> DataFrame:
        left = rows.where(pick).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(pick)
        pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
        return pairs.applyInArrow(_mine(same_label, size), FOUND)

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)

    if shards < 2 * ahead:
        return first(meet(anchors, F.lit(True)))
    found = store(first(meet(anchors, F.col("shard") % ahead == 0)), "ahead")
    ends = found.where(F.col("rank") == size).select("anchor", "window", F.col("score").alias("end"))
    asked = anchors.select("anchor", "own", "x", "block", F.inline("windows")).join(ends, ["anchor", "window"], "left")
    window = F.struct("window", F.greatest("low", "end").alias("low"), "high")
    asked = asked.groupBy("anchor").agg(
        F.first("own").alias("own"), F.first("x").alias("x"), F.first("block").alias("block"),
        F.collect_list(window).alias("windows"),
    )
    return first(found.drop("rank").unionByName(meet(asked, F.col("shard") % ahead != 0)))


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    floor: int = FLOOR,
    scale: int = SCALE,
    shard_cells: int = SHARD_CELLS,
    block_cells: int = BLOCK_CELLS,
    ahead: int = AHEAD,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of hard negatives.

    Components count as ``floor(scale * x)``; the score of two rows is the inner product of these
    integers. Rows whose id ``every`` divides are anchors. An anchor's positives are the
    ``positives`` other rows of its label that score highest; for each of them, the ``negatives``
    rows of other labels that score highest, at most as high as the positive and at least ``floor``
    hundredths of it, are returned. Equal scores go by ascending id, so results are exact and repeatable.

    Shards of rows (``shard_cells`` components or so, dealt by a hash of the id) meet blocks of anchors
    in tasks of bounded size; a task sends the best of each window only. Labels don't partition the
    work, so a hot one does no harm. A negative score never reaches a window that ends above it; a
    positive below 0 has none.

    Rows without an id, label or vector, with an empty vector, or with a component that is NULL or
    not finite take no part. Ids are unique: of rows that share one, that with the least label and
    vector counts, which collapses repeated rows. Vectors of different length never meet. An anchor
    without a positive, and a positive without a negative, have no rows; no rows give no rows. Other
    columns are not read, so their names don't matter. Vectors of length 2^31 or more (as integers)
    are refused, since scores have 64 bits.
    """
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
            F.col(vector_col).cast("array<double>").alias("v"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
        .groupBy("id")
        .agg(F.min(F.struct("label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))).alias("row"))
        .select("id", "row.*")
    )
    rows = store(rows, "vectors")
    anchor = F.col("id") % every == 0
    cells, asked = rows.agg(F.sum(F.size("v")), F.sum(F.when(anchor, F.size("v")))).first()
    shards, blocks = -(-(cells or 0) // shard_cells) or 1, -(-(asked or 0) // block_cells) or 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    whole = F.struct(F.lit(0).alias("window"), F.lit(NO_BOUND).alias("low"), F.lit(-NO_BOUND).alias("high"))
    anchors = rows.where(anchor).select(
        F.col("id").alias("anchor"), F.col("label").alias("own"), F.col("v").alias("x"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.array(whole).alias("windows"),
    )
    near = _search(dealt, anchors, blocks, shards, ahead, True, positives)
    near = store(near.select("anchor", F.col("rank").alias("window"), F.col("id").alias("positive"), "score"), "positives")
    # The smallest whole number of which 100 are ``floor`` scores or more; scores are under 2^62.
    low = F.ceil(F.col("score").cast("decimal(20,0)") * floor / F.lit(100).cast("decimal(3,0)"))
    ranges = near.groupBy("anchor").agg(
        F.collect_list(F.struct("window", low.cast("long").alias("low"), F.col("score").alias("high"))).alias("windows")
    )
    far = _search(dealt, anchors.drop("windows").join(ranges, "anchor"), blocks, shards, ahead, False, negatives)
    return (
        far.withColumnRenamed("score", "negative_score")
        .join(near.withColumnRenamed("score", "positive_score"), ["anchor", "window"])
        .select(
            F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
            F.col("id").alias("negative_id"), "positive_score", "negative_score",
        )
    )
