"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stakeline.llm.common import fresh, store, trim, without

MIN_MATCH = 5
COVERAGE = 0.8
# Bytes of benchmark text that one pass over the documents compares, held by each task.
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item: bigint, coverage: double, matched: bigint, tiles: bigint, longest: bigint>>"

_word = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``size`` token ids."""
    count = max(len(ids) - size + 1, 0)
    total = np.zeros(count, dtype=np.uint64)
    for at in range(size):
        total = total * BASE + ids[at : at + count].astype(np.uint64)
    return total


def runs(item: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches of at least ``size`` words: places in the item and in the document, and lengths.

    Karp-Rabin hashes of ``size`` words tell where a match may lie. Only pairs of places that begin
    a match are paired: those whose words before differ. So a word that repeats a thousand times on
    both sides makes two thousand matches, one a diagonal, and not a million pairs.
    """
    wanted = rolling(item, size)
    known = np.unique(wanted)
    hashes = rolling(doc, size)
    at = np.flatnonzero(np.isin(hashes, known))
    before = np.where(at > 0, doc[at - 1], -1)
    keys = np.searchsorted(known, hashes[at])
    order = np.lexsort((before, keys))
    at, before, keys = at[order], before[order], keys[order]
    cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(before) != 0)) + 1
    by_hash = np.argsort(wanted, kind="stable")
    low = np.searchsorted(wanted[by_hash], known, "left")
    high = np.searchsorted(wanted[by_hash], known, "right")
    ahead = np.concatenate([[-2], item[:-1]])
    places: list[tuple[np.ndarray, np.ndarray]] = []
    for members in np.split(np.arange(len(at)), cuts) if len(at) else ():
        k, last = keys[members[0]], before[members[0]]
        mine = by_hash[low[k] : high[k]]
        mine = mine[ahead[mine] != last]
        places.append((np.repeat(mine, len(members)), np.tile(at[members], len(mine))))
    p = np.concatenate([x for x, _ in places]) if places else np.zeros(0, dtype=np.int64)
    q = np.concatenate([x for _, x in places]) if places else np.zeros(0, dtype=np.int64)
    same = np.ones(len(p), dtype=bool)
    for k in range(size):  # hashes may collide
        same &= item[p + k] == doc[q + k]
    p, q = p[same], q[same]
    length, live = np.full(len(p), size), np.arange(len(p))
    while len(live):
        i, j = p[live] + length[live], q[live] + length[live]
        live, i, j = (x[(i < len(item)) & (j < len(doc))] for x in (live, i, j))
        live = live[item[i] == doc[j]]
        length[live] += 1
    return p, q, length


def tiling(item: np.ndarray, doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles ``(item position, document position, length)`` that greedy string tiling marks.

    The longest match goes first (ties: the first in the item, then in the document) and marks its
    tokens on both sides; what an earlier tile has marked is cut out of the later ones, whose rests
    of ``size`` tokens or more stay in the race.
    """
    p, q, length = runs(item, doc, size)
    heap = list(zip((-length).tolist(), p.tolist(), q.tolist()))
    heapq.heapify(heap)
    item_marks, doc_marks, tiles = np.zeros(len(item), dtype=bool), np.zeros(len(doc), dtype=bool), []
    open_ = len(item)
    while heap and open_ >= size:
        n, p, q = heapq.heappop(heap)
        taken = item_marks[p : p - n] | doc_marks[q : q - n]
        if not taken.any():
            item_marks[p : p - n] = doc_marks[q : q - n] = True
            open_ += n
            tiles.append((p, q, -n))
            continue
        if taken.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start >= size:
                heapq.heappush(heap, (-int(end - start), p + int(start), q + int(start)))
    return tiles


class Index:
    """Seeds of some benchmark items, by window length (items shorter than a seed match whole)."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, coverage: float):
        self.coverage = coverage
        self.words: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)], dtype=np.int64)
            if len(ids):
                size = min(min_match, len(ids))
                hashes = rolling(ids, size)
                found[size].append((hashes, np.full(len(hashes), len(self.items)), np.arange(len(hashes))))
                self.items.append((item, ids, size))
        self.lengths = np.array([len(ids) for _, ids, _ in self.items], dtype=np.int64)
        self.seeds = {}
        for size, parts in found.items():
            hashes, owner, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], owner[order], place[order]

    def _reached(self, doc: np.ndarray) -> list[int]:
        """Items of whose words seeds in ``doc`` cover enough, whatever overlaps there."""
        unknown, found = np.concatenate([[0], np.cumsum(doc == 0)]), []
        for size, (hashes, owner, place) in self.seeds.items():
            if len(doc) < size:
                continue
            known = np.flatnonzero(unknown[size:] == unknown[:-size])
            mine = np.unique(rolling(doc, size)[known])
            low, high = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            many = high - low
            at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            if not len(at):
                continue
            order = np.lexsort((place[at], owner[at]))
            item, start = owner[at][order], place[at][order]
            last = np.append(item[1:] != item[:-1], True)
            step = np.where(last, size, np.minimum(size, np.append(start[1:], 0) - start))
            first = np.flatnonzero(np.append(True, last[:-1]))
            covered = np.add.reduceat(step, first)
            enough = covered >= self.coverage * self.lengths[item[first]]
            found += item[first][enough].tolist()
        return found

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """Items covered by tiles of ``text`` to the wanted share, in the order of their ids."""
        get = self.words.get
        doc = np.array([get(w, 0) for w in tokens(text)], dtype=np.int64)
        found = []
        for k in self._reached(doc):
            item, ids, size = self.items[k]
            tiles = tiling(ids, doc, size)
            matched = sum(n for _, _, n in tiles)
            if tiles and matched >= self.coverage * len(ids):
                found.append((item, matched / len(ids), matched, len(tiles), max(n for _, _, n in tiles)))
        return sorted(found)


def _matcher(index) -> Callable[..., Column]:
    @pandas_udf(MATCH)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item", "coverage", "matched", "tiles", "longest")
        for texts in parts:
            yield pd.Series([[dict(zip(names, m)) for m in index.value.matches(t)] for t in texts])
        trim()

    return match


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).dropna().distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    for k in range(count):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()]


def _matches(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_bytes: int = BLOCK_BYTES,
) -> Iterator[Column]:
    """Expressions over ``docs``, one per block of benchmark items, with the items each text leaks.

    Words are runs of word characters in lower case. An item leaks if tiles of at least
    ``min_match`` words cover ``coverage`` of its words, in whatever order they stand in the text.
    Items travel to the tasks in blocks of about ``block_bytes`` of text, one at a time: an
    expression has to be evaluated and its result stored before the next one is taken. So what is
    held at once doesn't grow with the benchmark; what is sent in all does. Items without a word, a
    text or an id match nothing, and an item of fewer than ``min_match`` words matches as a whole.
    """
    context = docs.sparkSession.sparkContext
    for block in _blocks(items, item_id_col, item_text_col, block_bytes):
        index = context.broadcast(Index(block, min_match, coverage))
        try:
            yield _matcher(index)(F.col(text_col))
        finally:
            index.destroy()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, coverage, matched_words, tiles, longest_tile`` for each leak.

    One row per row of ``docs`` and benchmark item that it covers; repeated rows give repeated
    results, a row without an id gives a NULL id, a NULL or empty text gives none. Items that share
    an id are compared one by one. A very long text is compared whole, in its task; what that takes
    grows with its words and with the matches it begins, not with pairs of places. Empty tables give
    no rows; other columns are not read, so their names don't matter.
    """
    leaks = []
    for found in _matches(docs, items, text_col, **options):
        leaks.append(store(docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("m")), "leaks"))
    return reduce(DataFrame.unionAll, leaks).select(
        "doc_id",
        F.col("m.item").alias("item_id"),
        "m.coverage",
        F.col("m.matched").alias("matched_words"),
        "m.tiles",
        F.col("m.longest").alias("longest_tile"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that leak a benchmark item; all columns as they are.

    What is stored of a leak is a digest of its text; rows with such a text go.
    """
    digest, name = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), fresh(docs, "_digest")
    leaks = []
    for found in _matches(docs, items, text_col, **options):
        leaks.append(store(docs.where(F.size(found) > 0).select(digest.alias("digest")).distinct(), "leaks"))
    gone = reduce(DataFrame.unionAll, leaks).distinct()
    return without(docs.withColumn(name, digest), name, gone).drop(name)
