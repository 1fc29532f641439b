"""Quality by weak labels: labellers weighed by expectation-maximisation train a hashed linear scorer."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stakeline.llm.common import lowest_hashes, store

GOOD, BAD, ABSTAIN = 1, 0, 2
# Rows that the scorer is trained on, at most; slots that features are hashed to.
SAMPLE = 8_192
SLOTS = 1 << 14
EPOCHS = 12

PLAIN_MARKS = ".,;:'’\"()-"
EDGES = ".,;:!?|\"'()"
# Words whose shape a worker remembers.
MEMORY = 200_000


def _between(value: float, bad_below: float, good_from: float) -> int:
    return BAD if value < bad_below else GOOD if value >= good_from else ABSTAIN


@cache
def _kinds() -> np.ndarray:
    """What each code point is: letter 1, capital 2, digit 4, space 8, mark 16, rare mark 32, as a sum."""
    found = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        char = chr(code)
        space = char.isspace()
        mark = not (space or char.isalnum() or char == "_")
        rare = mark and char not in PLAIN_MARKS
        found[code] = char.isalpha() + 2 * char.isupper() + 4 * char.isdigit() + 8 * space + 16 * mark + 32 * rare
    return found


def statistics(text: str | None) -> dict[str, float]:
    """What the labellers look at: shares of words, letters, marks, lines."""
    text = text or ""
    words = text.split()
    n = len(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_kinds()[codes], minlength=64)
    count = lambda bit: int(kinds[np.arange(64) & bit > 0].sum())
    letters = count(1)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    share = lambda part, whole: part / whole if whole else 0.0
    lower = text.lower().split()
    return {
        "words": n,
        "distinct": share(len(set(lower)), n),
        "adjacent": share(sum(map(eq, lower, islice(lower, 1, None))), n - 1),
        "upper": share(count(2), letters),
        "letters": share(letters, len(text) - count(8)),
        "rare_marks": share(count(32), n),
        "exclaimed": share(sum(w.endswith("!") for w in words), n) if "!" in text else 0.0,
        "barred": share(text.count("|"), n),
        "digits": share(count(4), len(text)),
        "repeated_lines": 1 - share(len(set(lines)), len(lines)) if lines else 0.0,
        "ends": share(sum(x[-1] in ".!?\"'”»)" for x in lines), len(lines)),
    }


# Each labeller votes good, bad, or abstains; they overlap and may be wrong.
LABELLERS: dict[str, Callable[[dict[str, float]], int]] = {
    "varied": lambda s: _between(s["distinct"], 0.25 if s["words"] > 400 else 0.4, 0.5) if s["words"] >= 20 else ABSTAIN,
    "no_stutter": lambda s: _between(1 - s["adjacent"], 0.8, 0.95) if s["words"] >= 5 else ABSTAIN,
    "calm_case": lambda s: _between(1 - s["upper"], 0.7, 0.85) if s["words"] else ABSTAIN,
    "mostly_letters": lambda s: _between(s["letters"], 0.7, 0.88),
    "few_rare_marks": lambda s: _between(1 - s["rare_marks"], 0.7, 0.95),
    "no_shouting": lambda s: BAD if s["exclaimed"] > 0.2 else GOOD if s["exclaimed"] < 0.02 else ABSTAIN,
    "no_table": lambda s: BAD if s["barred"] > 0.2 else GOOD if s["barred"] < 0.02 else ABSTAIN,
    "few_digits": lambda s: _between(1 - s["digits"], 0.85, 0.97),
    "new_lines": lambda s: _between(1 - s["repeated_lines"], 0.6, 0.95),
    "sentences": lambda s: _between(s["ends"], 0.2, 0.5) if s["words"] else ABSTAIN,
    "long_enough": lambda s: BAD if s["words"] < 3 else ABSTAIN if s["words"] < 15 else GOOD,
}


def votes(found: dict[str, float]) -> str:
    """The labellers' votes on a text's ``statistics`` as a string of digits, in their order."""
    return "".join(str(label(found)) for label in LABELLERS.values())


def features(text: str | None, found: dict[str, float] | None = None) -> np.ndarray:
    """Slots of a text, each once: its words and pairs of neighbours by shape, and shares by decade.

    A shape keeps what a word looks like, not which letters it has, so that the scorer learns how a
    text is written rather than what it is about; the commonest short words enter as they are.
    ``found`` are the text's ``statistics``, if they are known.
    """
    text = text or ""
    found = statistics(text) if found is None else found
    words = text.split()
    shapes = np.fromiter(map(_shape, words), dtype=np.int64, count=len(words))
    lower = text.lower().split()
    same = np.fromiter(map(eq, lower, islice(lower, 1, None)), dtype=np.int64, count=max(len(lower) - 1, 0))
    pairs = (shapes[:-1] * 31 + shapes[1:]) * 2 + same[: max(len(words) - 1, 0)] if len(words) == len(lower) else shapes[:0]
    named = {f"w {w}" for w in set(lower) if len(w) <= 3}
    named |= {
        f"q {k} {int(min(v, 1.0) * 10) if k != 'words' else int(v).bit_length()}" for k, v in found.items()
    }
    named = np.fromiter((_slot(x) for x in named), dtype=np.int64, count=len(named))
    return np.unique(np.concatenate([shapes, pairs, named]) % SLOTS).astype(np.int32)


@lru_cache(MEMORY)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


@lru_cache(MEMORY)
def _shape(word: str) -> int:
    core = word.strip(EDGES)
    case = "U" if core.isupper() else "T" if core.istitle() else "l" if core.islower() else "m"
    kind = "a" if core.isalpha() else "d" if core.isdigit() else "x" if core else "-"
    tail = word[len(word.rstrip(EDGES)) :][:2]
    return zlib.crc32(f"s {kind}{case}{min(len(core), 24) // 4}{tail}".encode("utf-8", "surrogatepass"))


@dataclass
class Labels:
    """What expectation-maximisation found: the share of good texts and each labeller's habits.

    ``habits[j, c, v]`` is how likely labeller j, if it votes, votes v on a text of class c.
    """

    prior: float
    habits: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely each row of votes comes from a good text; to abstain says nothing."""
        each = np.arange(patterns.shape[1])
        log = (np.log(self.habits[each, :, patterns]) * (patterns != ABSTAIN)[:, :, None]).sum(axis=1)
        log += np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def weigh(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labels:
    """Accuracies of the labellers from how often each pattern of votes occurs, without any truth.

    Starts from the majority of the votes, which also settles which class is the good one.
    """
    good = (patterns == GOOD).sum(axis=1) + 1.0
    bad = (patterns == BAD).sum(axis=1) + 1.0
    p = good**2 / (good**2 + (3 * bad) ** 2)
    one_hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    found = None
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts], axis=1)
        habits = np.einsum("pc,pjv->jcv", weight, one_hot) + 1.0
        habits /= habits[:, :, :ABSTAIN].sum(axis=2, keepdims=True)
        prior = float((weight[:, 1].sum() + 1) / (counts.sum() + 2))
        found = Labels(prior, habits)
        new = found.posterior(patterns)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return found


@dataclass
class Scorer:
    """Linear score of hashed features."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    bias: float = 0.0

    def score(self, text: str | None, found: dict[str, float] | None = None) -> float:
        own = features(text, found)
        total = self.bias + self.weights[own].sum() / np.sqrt(max(len(own), 1))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 1e-6) -> Scorer:
    """Logistic regression towards soft labels, by adaptive gradient steps in a fixed order."""
    out, power = Scorer(), np.full(SLOTS, 1e-8)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own, scale = rows[i], 1 / np.sqrt(max(len(rows[i]), 1))
            total = out.bias + out.weights[own].sum() * scale
            error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - target[i]
            gradient = error * scale + ridge * out.weights[own]
            power[own] += gradient**2
            out.weights[own] -= rate * gradient / np.sqrt(power[own])
            out.bias -= 0.01 * error
    return out


def _votes_of(column: Column) -> Column:
    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([votes(statistics(t)) for t in texts])

    return run(column)


def _features_of(column: Column) -> Column:
    @pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t) for t in texts])

    return run(column)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Labels, Scorer]:
    """Labellers weighed over all rows, and a scorer trained on at most ``sample`` of them.

    All rows' votes count; what is counted are patterns of votes, of which there are at most three
    to the power of the number of labellers. The scorer sees the rows whose ids hash lowest, with
    the posteriors of their votes as labels. Without rows nothing is learned: every score is a half.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    voted = store(rows.select("id", F.xxhash64("id", "text").alias("hash"), _votes_of(F.col("text")).alias("votes")), "votes")
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()
    if not patterns:
        return Labels(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)), Scorer()
    table = np.array([[int(v) for v in r["votes"]] for r in patterns])
    labels = weigh(table, np.array([r["count"] for r in patterns], dtype=float))
    posterior = dict(zip((r["votes"] for r in patterns), labels.posterior(table)))
    picked = lowest_hashes(voted, sample, "hash").select(F.col("hash").alias("_hash"), "votes").dropDuplicates(["_hash"])
    hashed = rows.withColumn("_own", F.xxhash64("id", "text"))
    chosen = hashed.join(F.broadcast(picked), F.col("_own") == F.col("_hash")).dropDuplicates(["_hash"])
    found = chosen.select("_hash", "votes", _features_of(F.col("text")).alias("slots")).orderBy("_hash").collect()
    slots = [np.array(r["slots"], dtype=np.int32) for r in found]
    return labels, train(slots, np.array([posterior[r["votes"]] for r in found]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id, score, weak_label, votes, keep`` per row of ``docs``.

    ``score`` is the scorer's, from 0 to 1, ``weak_label`` what the labellers' votes alone say, and
    ``keep`` whether the score reaches ``threshold``. A NULL text is empty; a very long one is read
    whole. Repeated rows count and come back repeated; an empty table gives no rows. Other columns
    are not read, so their names don't matter.
    """
    labels, scorer = fit(docs, id_col, text_col, **options)

    @pandas_udf("score double, weak_label double, votes string")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            known = [statistics(t) for t in texts]
            cast = [votes(s) for s in known]
            table = np.array([[int(v) for v in c] for c in cast], dtype=int).reshape(-1, len(LABELLERS))
            yield pd.DataFrame(
                {"score": [scorer.score(t, s) for t, s in zip(texts, known)], "weak_label": labels.posterior(table), "votes": cast}
            )

    found = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.score", "found.weak_label", "found.votes", (F.col("found.score") >= threshold).alias("keep"))
