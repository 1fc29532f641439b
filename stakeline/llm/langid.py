"""Language identification by rank-order n-gram profiles and their out-of-place distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stakeline.llm.common import text_slices, trim

UNKNOWN = "und"
PROFILE = 300
PAD = 1
# n-grams of one language that a task holds before it merges them.
MERGE = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of one to three letters of ``text`` and their counts.

    Letters are in lower case; whatever lies between words counts as one pad, and no n-gram spans
    two words. An n-gram is a number: 21 bits for each code point.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, PAD).astype(np.uint64)
    codes = np.concatenate([[np.uint64(PAD)], codes, [np.uint64(PAD)]])
    gap = codes == PAD
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    codes = codes[keep]
    two = codes[:-1] << np.uint64(21) | codes[1:]
    three = (two[:-1] << np.uint64(21) | codes[2:])[codes[1:-1] != PAD]
    found = np.concatenate([codes[codes != PAD], two, three]) if len(codes) > 1 else codes[:0]
    return np.unique(found, return_counts=True)


def ranked(found: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, by count and then by number."""
    return found[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        totals = np.zeros(len(grams), dtype=np.int64)
        np.add.at(totals, place, np.concatenate([c for _, c in parts]))
        return grams, totals

    for batch in (part for whole in batches for part in text_slices(whole, "text")):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            grams = ngrams(text)
            held[lang].append(grams)
            sizes[lang] += len(grams[0])
            if sizes[lang] > MERGE:
                held[lang] = [merged(held[lang])]
                sizes[lang] = len(held[lang][0][0]) // 2
    for lang, parts in held.items():
        grams, totals = merged(parts)
        for at in range(0, len(grams), 1 << 16):
            part = grams[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part.view(np.int64)), pa.array(totals[at : at + (1 << 16)])],
                names=["lang", "gram", "n"],
            )
    trim()


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank``: the ``size`` most frequent n-grams of each language in ``docs``.

    All rows with a text and a language count. Each task adds up its own counts first; the rank
    limit applies in every task before the rows of a language meet.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    totals = rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank")


class Classifier:
    """Language of a text from ranked profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.tables = []
        for lang in self.langs:
            order = np.argsort(profiles[lang])
            self.tables.append((profiles[lang][order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; the score is 1 at distance zero and 0 if no n-gram is in the profile.

        The distance to a language adds, for each n-gram of the document's profile, how far its rank
        lies from that in the language's profile, and the profile's size if it isn't there. Equal
        distances go to the language that comes first by name.
        """
        if not text or not self.langs:
            return UNKNOWN, 0.0
        grams = ranked(*ngrams(text), self.size)
        if not len(grams):
            return UNKNOWN, 0.0
        ranks, best = np.arange(len(grams)), (np.inf, UNKNOWN)
        for lang, (known, order) in zip(self.langs, self.tables):
            place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            away = np.where(known[place] == grams, np.abs(order[place] - ranks), self.size)
            best = min(best, (int(away.sum()), lang))
        return best[1], 1.0 - best[0] / (self.size * len(grams))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Classifier:
    """Profiles of ``docs`` as a classifier; the driver gets ``size`` rows per language."""
    found: dict[str, list[int]] = defaultdict(list)
    for row in profiles(docs, text_col, lang_col, size).orderBy("lang", "rank").collect():
        found[row["lang"]].append(row["gram"])
    return Classifier({lang: np.array(grams, dtype=np.int64).view(np.uint64) for lang, grams in found.items()}, size)


def predictor(model: Classifier) -> Callable[..., Column]:
    @pandas_udf("lang string, score double")
    def language(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score"])
        trim()

    return language


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether the crc32 of the id as text leaves ``fold`` when divided by ``folds``; NULL for no id."""
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``.

    Profiles come from all rows with an id outside the held-out fold, a text and a language; the
    prediction sees the text alone. A NULL text, a text without a letter, and any text if there is
    nothing to learn from, are ``und`` with score 0. A row without an id is predicted, not learned
    from, and not held out. Repeated rows count and come back repeated; an empty table gives no
    rows. Texts are read whole, however long. Other columns are not read, so their names don't matter.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        predictor(model)(F.col(text_col)).alias("found"),
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
