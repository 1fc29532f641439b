"""Building blocks that keep wide steps spread over the cluster.

Reports share a few intermediate tables. ``pin`` keeps such a table: in the cluster's shared
checkpoint folder if ``spark.checkpoint.dir`` names one, which cuts lineage and survives lost
executors, else persisted with its lineage. Either gives an exact row count; the count then decides
between the quick form of a step and the form that has no size limit. Both give the same rows.
``release``, or a ``with scratch(spark):`` block around a report and what is done with its result,
removes what was kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast table holds at most this many rows, and this many characters of text.
BROADCAST_ROWS = 200_000
BROADCAST_TEXT = 64 << 20
# Key hashes that take the room of one such row.
HASHES_PER_ROW = 10
# Bits of the largest bitmap of hashes that is broadcast (64 MB), and bits per listed key.
BITMAP_BITS = 1 << 29
BITS_PER_KEY = 8
# 64-bit words in a row of a bitmap.
BITMAP_WORDS = 512
# A window group handled by one task holds at most this many rows.
WINDOW_ROWS = 1_000_000
# A join key with more rows than this is split.
HOT_ROWS = 1_000_000

# What ``pin`` has kept: paths of stored tables and persisted frames.
_kept: list[str | DataFrame] = []


@dataclass(frozen=True)
class Sized:
    """A table with a row count, exact or an upper bound."""

    df: DataFrame
    rows: int


def sized(df: DataFrame) -> Sized:
    """Count a table (file footers answer this for a Parquet scan)."""
    return Sized(df, df.count())


def work_dir(spark: SparkSession) -> str | None:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``; None if unset."""
    return spark.conf.get("spark.checkpoint.dir", None)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Keep ``df`` so that its consumers don't recompute it.

    Stored tables of one application share a folder, ``<work_dir>/stakeline/<application id>``.
    """
    spark = df.sparkSession
    folder = work_dir(spark)
    if folder is None:
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _kept.append(kept)
        return kept
    path = f"{folder.rstrip('/')}/stakeline/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"
    _kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, name: str) -> Sized:
    """``keep`` and count, for consumers that choose their form by size."""
    return sized(keep(df, name))


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove what was kept (the first ``since`` of it stay); results that read it must be done."""
    removed = 0
    while len(_kept) > since:
        kept = _kept.pop()
        if isinstance(kept, str):
            path = spark._jvm.org.apache.hadoop.fs.Path(kept)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            kept.unpersist()
        removed += 1
    return removed


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was kept within it."""
    before = len(_kept)
    try:
        yield
    finally:
        release(spark, before)


def small(table: Sized) -> DataFrame:
    """``table``, broadcast if its count allows it."""
    return F.broadcast(table.df) if table.rows <= BROADCAST_ROWS else table.df


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row, by one scalar subquery."""
    return df.withColumn("_row", row.select(F.struct("*")).scalar()).select("*", "_row.*").drop("_row")


def _bit_of(on: Sequence[str], bits: int) -> dict[str, Column]:
    """Where in a bitmap of ``bits`` a key has its bit: row, word in the row, bit in the word."""
    place = F.pmod(F.xxhash64(*on), F.lit(bits).cast("long"))
    word = F.shiftright(place, 6)
    return {
        "_row": F.floor(word / BITMAP_WORDS).cast("long"),
        "_word": (word % BITMAP_WORDS).cast("int"),
        "_bit": F.pmod(place, F.lit(64)).cast("int"),
    }


def maybe_listed(rows: DataFrame, wanted: Sized, on: Sequence[str]) -> DataFrame:
    """``rows`` without most of those whose key ``wanted`` doesn't list, for lists beyond a broadcast table.

    The keys' hashes are added up to a bitmap of at most ``BITMAP_BITS``, kept as rows of
    ``BITMAP_WORDS`` words. It is broadcast and tested in the stage that scans ``rows``. About one in
    ``BITS_PER_KEY`` unlisted keys stays; a list so long that half the bits would be set isn't used.
    """
    bits = min(BITMAP_BITS, -(-max(wanted.rows, 1) * BITS_PER_KEY // (64 * BITMAP_WORDS)) * 64 * BITMAP_WORDS)
    if wanted.rows > bits // 2:
        return rows
    at = _bit_of(on, bits)
    words = wanted.df.select(*[c.alias(n) for n, c in at.items()]).groupBy("_row", "_word")
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_bits"))
    by_word = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    zero = F.lit(0).cast("long")
    dense = F.transform(F.sequence(F.lit(0), F.lit(BITMAP_WORDS - 1)), lambda i: F.coalesce(F.col("_map")[i], zero))
    bitmap = words.groupBy("_row").agg(by_word.alias("_map")).select("_row", dense.alias("_bitmap"))
    marked = rows.withColumns(at).join(F.broadcast(keep(bitmap, "bitmap")), "_row")
    listed = F.call_function("shiftright", F.get("_bitmap", F.col("_word")), F.col("_bit"))
    return marked.where(listed.bitwiseAND(F.lit(1)) == 1).drop(*at, "_bitmap")


def aggregate_for(
    rows: DataFrame,
    wanted: Sized,
    on: Sequence[str],
    *aggs: Column,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``wanted`` (one row per group) with the aggregates of its groups; empty groups are absent.

    A short list filters the rows ahead of the aggregate, by hash where the join that follows is
    exact anyway, and one beyond that by a bitmap of hashes. A list too long for either meets only
    the groups: partial aggregation in the map tasks collapses
    hot groups before the shuffle, and the join reuses the partitioning of the aggregate. That form
    also aggregates groups nobody asked for, so ``aggs`` must not raise for any group.
    """
    on = list(on)
    if set(wanted.df.columns) == set(on) and wanted.rows <= broadcast_rows:
        return rows.join(F.broadcast(wanted.df), on, "left_semi").groupBy(*on).agg(*aggs)
    if wanted.rows <= broadcast_rows * HASHES_PER_ROW:
        hashes = wanted.df.select(F.xxhash64(*on).alias("_hash"))
        rows = rows.withColumn("_hash", F.xxhash64(*on))
        rows = rows.join(F.broadcast(hashes), "_hash", "left_semi")
    else:
        rows = maybe_listed(rows, wanted, on)
    return rows.groupBy(*on).agg(*aggs).join(wanted.df, on)


def left_lookup(
    left: Sized,
    right: DataFrame,
    key: str,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> Sized:
    """``left.join(right, key, "left")`` for a skewed key.

    Beyond broadcast size (in rows, or in characters of text), keys with more than ``hot_rows`` left rows are cut into slices of about
    that size, and their right rows are repeated once per slice. There are at most
    ``left.rows / hot_rows`` hot keys. The result of that form is pinned.
    """
    right = right.where(F.col(key).isNotNull())
    texts = [F.coalesce(F.length(f.name), F.lit(0)) for f in right.schema.fields if isinstance(f.dataType, T.StringType)]
    width = sum(texts, F.lit(0)).cast("long")
    repeats = right.groupBy(key).agg(F.count("*").alias("count"), F.sum(width).alias("text"))
    size = repeats.agg(F.sum("count").alias("rows"), F.max("count").alias("most"), F.sum("text").alias("text")).first()
    if (size["rows"] or 0) <= broadcast_rows and (size["text"] or 0) <= BROADCAST_TEXT:
        joined = left.df.join(F.broadcast(right), key, "left")
        return Sized(joined, left.rows * max(size["most"] or 0, 1))
    hot = (
        left.df.where(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .where(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).alias("_slices"))
    )
    hot = small(pin(hot, "hot-keys"))
    slices = F.coalesce("_slices", F.lit(1))
    # A NULL key matches nothing, so its rows may go anywhere.
    spread = F.xxhash64(*[c for c in left.df.columns if c != key])
    cut_left = (
        left.df.join(hot, key, "left")
        .withColumn("_slice", F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, slices)))
        .drop("_slices")
    )
    cut_right = (
        right.join(hot, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices.cast("long") - 1)))
        .drop("_slices")
    )
    return pin(cut_left.join(cut_right, [key, "_slice"], "left").drop("_slice"), "lookup")


def rank_rows(
    table: Sized, by: Sequence[str], order: Sequence[Column], window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Add ``rank`` = ROW_NUMBER() OVER (PARTITION BY by ORDER BY order), for few, large groups.

    A table of at most ``window_rows`` rows goes through a plain window. A larger one is sorted
    over the whole cluster (one range shuffle) and kept with each row's place; the rank is the place
    within the sorted slice plus the rows of the same group in earlier slices. The table of those
    offsets has one row per slice and group. NULL is a group like any other.
    """
    if table.rows <= window_rows:
        window = Window.partitionBy(*by).orderBy(*order)
        return table.df.withColumn("rank", F.row_number().over(window).cast("long"))
    placed = pin(
        table.df.orderBy(*by, *order).withColumn("_place", F.monotonically_increasing_id()),
        "ranked",
    ).df.withColumn("_slice", F.shiftright("_place", 33))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_slice").alias("_part"),
            "_first",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"),
        )
    )
    same = F.col("_slice") == F.col("_part")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return (
        placed.join(small(pin(offsets, "offsets")), same)
        .withColumn("rank", F.col("_place") - F.col("_first") + F.col("_skip") + 1)
        .drop("_place", "_slice", "_part", "_first", "_skip", *[f"_by_{c}" for c in by])
    )


def top_rows(table: Sized, order: Sequence[Column], n: int, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """The first ``n`` rows by ``order``, with their ``rank``.

    No task gets ``n`` rows of every other task: a table beyond a window's size is sorted in slices.
    """
    return rank_rows(table, [], order, window_rows).where(F.col("rank") <= n)
