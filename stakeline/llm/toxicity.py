"""Toxicity: Levenshtein automata over a lexicon trie, and context around each hit.

The lexicon is learned: whole words, matched within an edit or two, and stems, matched as they are.
The automaton of "at most k edits from any word of the lexicon" is the intersection of the trie with
the Levenshtein automaton of the text's word; its states are built as texts first need them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stakeline.llm.common import lowest_hashes, store

# Labelled rows that the lexicon and its weights are learned from, at most.
SAMPLE = 20_000
# Entries of the lexicon, fewest toxic documents behind one, and the share of toxic ones among them.
LEXICON = 2_000
SUPPORT = 5
PRECISION = 0.8
STEMS = range(4, 7)
# Letters from which on a word may differ by one edit, and by two.
ONE_EDIT, TWO_EDITS = 5, 9
WINDOW = 8
MEMORY = 500_000

# Words near a hit that speak of a quotation, or speak to a person.
REPORTING = frozenset(
    "said says wrote writes quote quoted quoting called calls cited reported according testified "
    "dijo escribió llamó dit écrit appelé sagte schrieb nannte".split()
)
ADDRESSING = frozenset("you your yours youre u ur tu te tú usted vous du dich dir ihr sie".split())
KINDS = ("exact", "near", "stem")
CONTEXTS = ("plain", "quoted", "addressed")

_word = re.compile(r"[\w@$*]+")
_quote = re.compile(r"[\"“”«»„]")


def words(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


class Automaton:
    """Words within their edits of a lexicon entry, and words that begin with a stem."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        self.limit = [0]
        for number, (text, is_stem) in enumerate(entries):
            edits = 0 if is_stem else (len(text) >= ONE_EDIT) + (len(text) >= TWO_EDITS)
            node = 0
            self.limit[0] = max(self.limit[0], edits)
            for char in text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                node = self.children[node][char]
                self.limit[node] = max(self.limit[node], edits)
            (self.stems if is_stem else self.ends)[node] = number
        self.edits = [0 if s else (len(t) >= ONE_EDIT) + (len(t) >= TWO_EDITS) for t, s in entries]
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.accept: list[tuple[int, int] | None] = []
        self.stem: list[int | None] = []
        self.next: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})
        self.seen: dict[str, tuple[int, str] | None] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state that holds trie nodes with the edits spent, skipped letters included."""
        queue = list(nodes.items())
        while queue:
            node, spent = queue.pop()
            for child in self.children[node].values():
                if spent + 1 <= self.limit[child] and spent + 1 < nodes.get(child, 99):
                    nodes[child] = spent + 1
                    queue.append((child, spent + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            ends = [
                (spent, self.ends[node])
                for node, spent in key
                if node in self.ends and spent <= self.edits[self.ends[node]]
            ]
            self.accept.append(min(ends, default=None))
            stems = [self.stems[node] for node, spent in key if spent == 0 and node in self.stems]
            self.stem.append(min(stems, default=None))
        return self.states[key]

    def _step(self, state: int, char: str) -> int:
        found: dict[int, int] = {}

        def reach(node: int, spent: int) -> None:
            if spent <= self.limit[node] and spent < found.get(node, 99):
                found[node] = spent

        for node, spent in self.sets[state]:
            reach(node, spent + 1)
            for letter, child in self.children[node].items():
                reach(child, spent + (letter != char))
        self.next[state, char] = to = self._state(found)
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """Entry and kind of match of a word: the fewest edits, then a stem; None for no match."""
        if word in self.seen:
            return self.seen[word]
        state, stem, moves = self.start, None, self.next
        for char in word:
            state = moves.get((state, char), -1)
            if state < 0:
                break
            if stem is None:
                stem = self.stem[state]
            if not self.sets[state]:
                break
        if state < 0:
            state, stem = self.start, None
            for char in word:
                to = moves.get((state, char), -1)
                state = to if to >= 0 else self._step(state, char)
                if stem is None:
                    stem = self.stem[state]
                if not self.sets[state]:
                    break
        end = self.accept[state]
        found = None
        if end is not None:
            found = (end[1], "near" if end[0] else "exact")
        elif stem is not None:
            found = (stem, "stem")
        if len(self.seen) >= MEMORY:
            self.seen.clear()
        self.seen[word] = found
        return found

    def hits(self, text: str | None) -> Counter:
        """Hits of a text as ``(entry, kind, context)``, counted.

        A hit is quoted if a quotation mark is open before it and closed after it, both within
        ``WINDOW`` words, or if a word of reporting stands that near; it is addressed if a word of
        address does. Quoted goes first.
        """
        found: Counter = Counter()
        if not text or not self.entries:
            return found
        low = text.lower()
        parts = _word.findall(low)
        if not any(self.match(w) for w in set(parts)):
            return found
        spans = [(m.start(), m.end()) for m in _word.finditer(low)]
        marks = np.array([m.start() for m in _quote.finditer(low)])
        for at, word in enumerate(parts):
            hit = self.match(word)
            if hit is None:
                continue
            left, right = max(at - WINDOW, 0), min(at + WINDOW, len(parts) - 1)
            near = set(parts[left : right + 1])
            opened = np.searchsorted(marks, spans[at][0]) if len(marks) else 0
            inside = (
                opened % 2 == 1
                and opened < len(marks)
                and marks[opened - 1] >= spans[left][0] - 1
                and marks[opened] <= spans[right][1]
            )
            context = "quoted" if inside or near & REPORTING else "addressed" if near & ADDRESSING else "plain"
            found[(*hit, context)] += 1
        return found


@dataclass
class Model:
    """Lexicon, weight of each entry and kind of match, and a logistic score over what they add up to."""

    entries: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[tuple[int, str], float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    automaton: Automaton | None = None

    def features(self, hits: dict[tuple[int, str, str], int]) -> list[float]:
        """One; per context, the strongest weight and the sum, damped; and the number of entries hit."""
        out = [1.0]
        for context in CONTEXTS:
            own = [(self.weights.get((e, k), 0.0), n) for (e, k, c), n in hits.items() if c == context]
            out += [max([0.0, *(w for w, _ in own)]), math.log1p(sum(max(w, 0.0) * n for w, n in own))]
        return [*out, math.log1p(len({e for e, _, _ in hits}))]

    def score(self, text: str | None) -> tuple[float, int, int]:
        """Score from 0 to 1, hits, and those of them that look quoted."""
        if not self.coefficients:
            return 0.0, 0, 0
        if self.automaton is None:
            self.automaton = Automaton(self.entries)
        hits = self.automaton.hits(text)
        total = float(np.dot(self.coefficients, self.features(hits)))
        quoted = sum(n for (_, _, c), n in hits.items() if c == "quoted")
        return 1 / (1 + math.exp(-max(min(total, 30.0), -30.0))), sum(hits.values()), quoted


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every, toxic = Counter(), Counter()
    for part in parts:
        for text, label in zip(part["text"], part["label"]):
            found = {(w, False) for w in words(text) if len(w) > 2 and not w.isdigit()}
            found |= {(w[:n], True) for w, _ in list(found) for n in STEMS if len(w) >= n}
            every.update(found)
            if label:
                toxic.update(found)
    rows = [(t, s, n, toxic[t, s]) for (t, s), n in every.items()]
    yield pd.DataFrame(rows, columns=["term", "stem", "n", "toxic"])


def lexicon(sample: DataFrame, size: int = LEXICON, support: int = SUPPORT, precision: float = PRECISION) -> list[tuple[str, bool]]:
    """Words and stems that toxic documents of ``sample`` (``text, label``) have and others don't.

    A stem counts with the shortest form that is as telling; a stem of which one word makes up
    nearly all is left to the word.
    """
    terms = sample.mapInPandas(_terms, "term string, stem boolean, n bigint, toxic bigint")
    terms = terms.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    terms = terms.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * F.col("n")))
    best = terms.orderBy(F.desc("toxic"), "n", F.length("term"), "term", "stem").limit(4 * size).collect()
    whole = {r["term"]: r["toxic"] for r in best if not r["stem"]}
    stems: dict[str, int] = {}
    for row in sorted((r for r in best if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        text = row["term"]
        one = max([n for w, n in whole.items() if w.startswith(text)], default=0)
        if one < 0.9 * row["toxic"] and not any(text.startswith(s) for s in stems):
            stems[text] = row["toxic"]
    found = [(n, s, True) for s, n in stems.items()]
    found += [(n, w, False) for w, n in whole.items() if not any(w.startswith(s) for s in stems)]
    return [(text, is_stem) for _, text, is_stem in sorted(found, key=lambda f: (-f[0], f[1]))[:size]]


def _hits(entries: list[tuple[str, bool]]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(entries)
        for part in parts:
            rows = []
            for text, label in zip(part["text"], part["label"]):
                hits = automaton.hits(text)
                rows.append((int(label), [f"{e} {k} {c} {n}" for (e, k, c), n in sorted(hits.items())]))
            yield pd.DataFrame(rows, columns=["label", "hits"])

    return run


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether the crc32 of the id as text leaves ``fold`` when divided by ``folds``; NULL for no id."""
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """A model from at most ``sample`` labelled rows, those whose ids hash lowest.

    Labels of one id that differ count as toxic. With no row of either class the model scores 0.
    What the driver gets is bounded by ``sample`` and the size of the lexicon.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = lowest_hashes(known, sample, "_id")
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(known), F.col("_own") == F.col("_id"))
    rows = store(rows.select("text", "label"), "labelled")
    if rows.select("label").distinct().count() < 2:
        return Model()
    model = Model(lexicon(rows))
    found = rows.mapInPandas(_hits(model.entries), "label int, hits array<string>").collect()
    y = np.array([r["label"] for r in found], dtype=float)
    hits = []
    for row in found:
        own = (h.split(" ") for h in row["hits"])
        hits.append({(int(e), k, c): int(n) for e, k, c, n in own})
    with_hit: dict[tuple[int, str], list[float]] = {}
    for own, label in zip(hits, y):
        for key in {(e, k) for e, k, _ in own}:
            with_hit.setdefault(key, []).append(label)
    base = y.mean()
    for key, seen in with_hit.items():
        share = (sum(seen) + base) / (len(seen) + 1)
        model.weights[key] = math.log(share / (1 - share)) - math.log(base / (1 - base))
    x = np.array([model.features(h) for h in hits])
    model.coefficients = logistic(x, y).tolist()
    return model


def scorer(model: Model) -> Callable[..., Column]:
    @pandas_udf("score double, hits bigint, quoted bigint")
    def toxicity(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([model.score(t) for t in texts], columns=["score", "hits", "quoted"])

    return toxicity


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted, hits, quoted`` per row of ``docs``.

    Learns from labelled rows outside the held-out fold, and scores whole texts alone. A NULL or
    empty text has the score of a text without hits; a very long one is read whole. A row without an
    id is scored, not learned from, and not held out. Repeated rows come back repeated. No documents,
    no rows; without a label to learn from nothing hits. Other columns are not read, so their names
    don't matter.
    """
    model = fit(docs, labels.where(~held_out(id_col)), id_col, text_col, **options)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        scorer(model)(F.col(text_col)).alias("found"),
    ).select(
        "doc_id",
        "held_out",
        "found.score",
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
        "found.hits",
        "found.quoted",
    )
