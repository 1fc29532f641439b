"""Ranked lexical search of many queries at once: what queries have in common is summed once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeline.llm.common import store, text_slices

# Weights: a term's weight counts in thousandths, of the length norm 90 parts in 100 are the text's share.
UNIT, SHARE, GAIN, DAMP = 1000, 90, 10**9, 8
# (item, term) pairs that are planned together, and in one pass over the documents.
PLAN_PAIRS, PASS_PAIRS = 1 << 16, 1 << 20
# Cells of a task's table of partial scores: nodes by documents.
CELLS = 4 << 20
BYTES = 4 << 20
# Documents whose scores give the floors below which no candidate leaves a task.
FLOOR_DOCS = 20_000

# Delimiters to blanks, A-Z to a-z; bytes beyond ASCII stay, so UTF-8 sequences do.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, some megabytes at a time."""
    start = 0
    while start < len(text):
        stop = start + BYTES
        while stop < len(text) and _TABLE[text[stop]] != 32:
            stop += 1
        yield text[start:stop].translate(_TABLE).split()
        start = stop


@dataclass
class Plan:
    """Sums that give the scores of some items.

    Leaf ``leaf[t]`` gathers what term ``t`` of the vocabulary is worth; terms of equal items share a
    leaf. Each level adds pairs of earlier nodes to new ones. Row i of ``nodes``/``starts`` lists the
    nodes whose sum is the score of item i.
    """

    items: np.ndarray
    leaf: np.ndarray
    leaves: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return self.leaves + sum(len(a) for a, _ in self.levels)

    @property
    def additions(self) -> int:
        """Additions a document takes, beside those into the leaves."""
        return self.size - self.leaves + len(self.nodes) - len(self.starts)

    def scores(self, term: np.ndarray, doc: np.ndarray, worth: np.ndarray, docs: int) -> np.ndarray:
        """Scores of items (rows) for documents (columns) from what each term of a document is worth."""
        leaf = self.leaf[term]
        mine = leaf >= 0
        total = np.zeros((self.size, docs), dtype=np.int64)
        np.add.at(total, (leaf[mine], doc[mine]), worth[mine])
        at = self.leaves
        for a, b in self.levels:
            total[at : at + len(a)] = total[a] + total[b]
            at += len(a)
        return np.add.reduceat(total[self.nodes], self.starts, axis=0)


def make_plan(item: np.ndarray, term: np.ndarray, vocabulary: int) -> Plan:
    """Mine the term sets that items share.

    Terms that stand in the same items become one leaf. Then, level by level, the nodes of each item
    are put in the order of how many items have them; of the pairs that stand side by side in two or
    more items, those in most items become new nodes (no node is in two new ones of a level), and
    replace their two parts wherever these stand side by side.
    """
    items, owner = np.unique(item, return_inverse=True)
    order = np.lexsort((owner, term))
    owner, term = owner[order], term[order]
    known, first, counts = np.unique(term, return_index=True, return_counts=True)
    classes: dict[bytes, int] = {}
    leaf = np.full(vocabulary, -1, dtype=np.int64)
    rows, nodes = [], []
    for t, at, n in zip(known.tolist(), first.tolist(), counts.tolist()):
        having = owner[at : at + n]
        k = classes.setdefault(having.tobytes(), len(classes))
        if k == len(classes) - 1 and len(rows) <= k:
            rows.append(having)
            nodes.append(np.full(n, k))
        leaf[t] = k
    row, node = np.concatenate(rows), np.concatenate(nodes)
    size, levels = len(classes), []
    while True:
        often = np.bincount(node, minlength=size)
        order = np.lexsort((node, -often[node], row))
        row, node = row[order], node[order]
        side = np.flatnonzero(row[1:] == row[:-1])
        pairs, of, count = np.unique(
            np.stack([node[side], node[side + 1]]), axis=1, return_inverse=True, return_counts=True
        )
        taken, new = np.zeros(size, dtype=bool), np.full(len(count), -1)
        made: list[int] = []
        for p in np.lexsort((np.arange(len(count)), -count)).tolist():
            a, b = pairs[:, p]
            if count[p] < 2:
                break
            if not taken[a] and not taken[b]:
                taken[a] = taken[b] = True
                new[p] = size + len(made)
                made.append(p)
        if not made:
            break
        levels.append((pairs[0, made], pairs[1, made]))
        size += len(made)
        into = new[of.ravel()]
        joined = into >= 0
        node[side[joined]] = into[joined]
        keep = np.ones(len(node), dtype=bool)
        keep[side[joined] + 1] = False
        row, node = row[keep], node[keep]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return Plan(items, leaf, len(classes), levels, node, starts)


def _counts(batch: pa.RecordBatch, get: Callable[[bytes], int | None]) -> tuple[np.ndarray, ...]:
    """``term, doc, tf`` of the known terms of a batch's texts, and the texts' lengths in terms."""
    found, owner, lengths = [], [], []
    for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
        data, n = text.as_py() or b"", 0
        for part in terms(data):
            n += len(part)
            ids = [t for t in map(get, part) if t is not None]
            ids, times = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
            found.append(np.stack([ids, times]))
            owner.append(np.full(len(ids), i))
        lengths.append(n)
    if not found:
        return *(np.zeros(0, dtype=np.int64),) * 3, np.array(lengths, dtype=np.int64)
    both, doc = np.concatenate(found, axis=1), np.concatenate(owner)
    span = int(both[0].max(initial=0)) + 1
    codes, at = np.unique(doc * span + both[0], return_inverse=True)  # parts of a long text meet here
    tf = np.zeros(len(codes), dtype=np.int64)
    np.add.at(tf, at, both[1])
    return codes % span, codes // span, tf, np.array(lengths, dtype=np.int64)


def _statistics(words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: documents with each term, and under -1 and -2 the documents with a term and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df = words.value.get, np.zeros(len(words.value), dtype=np.int64)
        docs = total = 0
        for batch in batches:
            for part in text_slices(batch, "text", BYTES):
                term, _, _, lengths = _counts(part, get)
                df += np.bincount(term, minlength=len(df))
                docs, total = docs + int((lengths > 0).sum()), total + int(lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([seen, [-1, -2]])), pa.array(np.concatenate([df[seen], [docs, total]]))],
            names=["term", "n"],
        )

    return run


class _Best:
    """The best ``k`` documents of each item so far (scores fall, ids rise, a NULL id comes last)."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors, self.held, self.waiting = k, floors.copy(), [], 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.floors[first : first + len(scores), None])
        if len(item):
            self.held.append((item + first, scores[item, doc], ids[doc], nulls[doc]))
            self.waiting += len(item)
            if self.waiting > 1 << 18:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Drop all but the best, and raise the floors of items that have ``k``."""
        if not self.held:
            return *(np.zeros(0, dtype=np.int64),) * 3, np.zeros(0, dtype=bool)
        item, score, ids, nulls = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((ids, nulls, -score, item))
        item, score, ids, nulls = item[order], score[order], ids[order], nulls[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.floors[item[last]] = np.maximum(self.floors[item[last]], score[last])
        best = place < self.k
        rest = item[best], score[best], ids[best], nulls[best]
        self.held, self.waiting = [rest], 0
        return rest


def _ranker(model, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: the best ``k`` documents of each item, as far as they reach the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, plans, docs, total, floors = model.value
        get, best = words.get, _Best(floors, k)
        for batch in batches:
            for part in text_slices(batch, "text", BYTES):
                term, doc, tf, lengths = _counts(part, get)
                norm = np.array([100 - SHARE + SHARE * n * docs // max(total, 1) for n in lengths.tolist()], dtype=np.int64)
                worth = weights[term] * (GAIN * tf // (UNIT * tf + DAMP * norm[doc]))
                ids = part.column("doc")
                nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                for first, plan in plans:
                    step = max(1, CELLS // (plan.size + len(plan.nodes)))
                    for low in range(0, len(ids), step):
                        a, b = np.searchsorted(doc, [low, low + step])
                        if a < b:
                            width = min(step, len(ids) - low)
                            scores = plan.scores(term[a:b], doc[a:b] - low, worth[a:b], width)
                            best.add(first, scores, ids[low : low + width], nulls[low : low + width])
        item, score, ids, nulls = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=nulls)],
            names=["item", "score", "doc"],
        )

    return run


def words(text: Column) -> Column:
    """Terms of a text: runs of 0-9, a-z and characters beyond ASCII once A-Z are in lower case."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _passes(items: DataFrame, pass_pairs: int) -> Iterator[list[tuple[Any, bytes]]]:
    """The (item, term) pairs, as many at a time as a pass takes; all pairs of an item come together."""
    pairs = items.select("item", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct()
    pairs = store(pairs, "item-terms")
    count = -(-pairs.count() // pass_pairs)
    for k in range(count):
        part = pairs.where(F.pmod(F.xxhash64(F.coalesce("item", F.lit(0)), F.col("item").isNull()), F.lit(count)) == k)
        yield [(r["item"], r["term"].encode()) for r in part.orderBy("item", "term").collect()]


def _plans(item: np.ndarray, term: np.ndarray, vocabulary: int, plan_pairs: int) -> list[tuple[int, Plan]]:
    """Plans over runs of items (numbered from 0, sorted) of about ``plan_pairs`` pairs, with their first items."""
    plans, start = [], 0
    while start < len(item):
        stop = int(np.searchsorted(item, item[min(start + plan_pairs, len(item)) - 1], side="right"))
        plans.append((int(item[start]), make_plan(item[start:stop], term[start:stop], vocabulary)))
        start = stop
    return plans


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    plan_pairs: int = PLAN_PAIRS,
    pass_pairs: int = PASS_PAIRS,
    floor_docs: int = FLOOR_DOCS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents that score highest for each item, above 0.

    A document's score is the sum over the item's distinct terms of term weight times saturated
    frequency, all in integers (see the constants above); equal scores go by ascending id. Terms are
    runs of ASCII letters (A-Z as a-z), digits and characters beyond ASCII. Ids are integers.

    The items of a pass (``pass_pairs`` item-term pairs, sent to every task; a larger set of items
    takes more passes) are planned ``plan_pairs`` at a time: term sets they share are summed once per
    document and enter the scores by a graph of sums. A pass reads the texts twice, for the counts
    that weights need and for the scores; nothing of a text is shuffled. Each task sends its best
    ``k`` per item, none below the ``k``-th best score among ``floor_docs`` documents or so that are
    scored ahead: as they are part of all documents, nothing better is lost.

    Texts are read whole, very long ones in pieces. A NULL text has no term and isn't counted, as a
    text without terms; a row without an id is ranked like others, after those with ids where scores
    are equal; repeated rows of ``docs`` are documents of their own. Rows of ``items`` that share an id
    (NULL is one) are one item, with the terms of all; an item without a term has no result. Empty
    tables give no rows. Other columns are not read, so their names don't matter.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    wanted = items.select(F.col(item_id_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    found = []
    for pairs in _passes(wanted, pass_pairs):
        ids = list(dict.fromkeys(i for i, _ in pairs))
        number, vocabulary = {i: n for n, i in enumerate(ids)}, {}
        item = np.array([number[i] for i, _ in pairs], dtype=np.int64)
        term = np.array([vocabulary.setdefault(t, len(vocabulary)) for _, t in pairs], dtype=np.int64)
        sent = spark.sparkContext.broadcast(vocabulary)
        counted = texts.mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in counted.collect()}
        sent.destroy()
        n, total = counts.pop(-1), counts.pop(-2)
        weights = [math.floor(UNIT * math.log((2.0 * n + 2) / (2.0 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))]
        plans = _plans(item, term, len(vocabulary), plan_pairs)
        floors = np.ones(len(ids), dtype=np.int64)
        if n > 4 * floor_docs:
            some = texts.where(F.abs(F.xxhash64("doc", "text") % 2**32) < int(floor_docs / n * 2**32))
            for r in _pass(some, vocabulary, weights, plans, n, total, floors, k).where(F.col("rank") == k).collect():
                floors[r["item"]] = r["score"]
        best = _pass(texts, vocabulary, weights, plans, n, total, floors, k)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        # The names of a pass are at most as many as its pairs.
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
        found.append(store(best, "ranked"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def _pass(texts: DataFrame, vocabulary, weights, plans, n: int, total: int, floors: np.ndarray, k: int) -> DataFrame:
    model = texts.sparkSession.sparkContext.broadcast(
        (vocabulary, np.array(weights, dtype=np.int64), plans, n, total, floors.copy())
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = texts.mapInArrow(_ranker(model, k), "item long, score long, doc long")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
