"""Embedding near-duplicates: random-hyperplane tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeline.llm.common import by_key, roots, store
from stakeline.llm.components import components

TABLES = 28
PLANES = 12
# Rows of a bucket that one task compares at once; a larger bucket is cut into pairs of pieces.
BUCKET = 4096
ROWS = 512
SEED = 17

HASHED = "node bigint, copies bigint, grp bigint, signs array<int>, unit binary"
FOUND = "node bigint, root bigint, n bigint"


def units(vectors: pa.ListArray) -> list[bytes | None]:
    """Each vector at length one, as double-precision bytes; None if it has no direction."""
    out: list[bytes | None] = []
    for vector in vectors:
        values = vector.values
        if values is None or not len(values) or values.null_count:
            out.append(None)
            continue
        x = values.cast(pa.float64()).to_numpy()
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # keeps the squares in range
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return out


def signatures(matrix: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """One integer of ``planes`` sign bits per row and table; the planes depend on the width alone."""
    normals = np.random.default_rng([SEED, matrix.shape[1]]).standard_normal((matrix.shape[1], tables * planes))
    bits = (matrix @ normals > 0).reshape(len(matrix), tables, planes)
    return (bits * (1 << np.arange(planes))).sum(axis=2).astype(np.int32)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = pa.array(units(batch.column(2)), type=pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit], names=["id", "label", "unit"])


def _hash(tables: int, planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("unit").to_pylist()
            signs = np.zeros((len(data), tables), dtype=np.int32)
            widths = np.array([len(x) for x in data])
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                matrix = np.frombuffer(b"".join(data[i] for i in rows)).reshape(len(rows), -1)
                signs[rows] = signatures(matrix, tables, planes)
            offsets = pa.array(np.arange(len(data) + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(signs.ravel()))
            columns = [batch.column("node"), batch.column("copies"), batch.column("grp"), lists, batch.column("unit")]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "grp", "signs", "unit"])

    return run


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["slot", "first", "second"]
        for table, bounds in by_key(batches, keys):
            names = ("node", "copies", "tab", "piece", "first", "second")
            node, copies, tab, piece, first, second = (table.column(c).to_numpy() for c in names)
            data = table.column("unit").to_pylist()
            signs = table.column("signs").combine_chunks()
            if isinstance(signs, pa.ChunkedArray):
                signs = pa.concat_arrays(signs.chunks)
            signs = signs.flatten().to_numpy().reshape(len(data), -1)
            out: list[list[np.ndarray]] = [[], [], []]
            for start, end in zip(bounds[:-1], bounds[1:]):
                if end - start < 2:
                    continue
                width = len(data[start])
                if any(len(x) != width for x in data[start:end]):
                    raise ValueError("a bucket holds vectors of one width")
                unit = np.frombuffer(b"".join(data[start:end])).reshape(end - start, -1)
                sig, t = signs[start:end], int(tab[start])
                left = np.arange(end - start)
                right = left
                if first[start] != second[start]:
                    left = np.flatnonzero(piece[start:end] == first[start])
                    right = np.flatnonzero(piece[start:end] == second[start])
                    if not len(left) or not len(right):
                        continue
                one, two = [], []
                for at in range(0, len(left), ROWS):
                    i, j = np.nonzero(unit[left[at : at + ROWS]] @ unit[right].T >= threshold)
                    i, j = left[at + i], right[j]
                    ordered = i < j if left is right else np.ones(len(i), dtype=bool)
                    i, j = i[ordered], j[ordered]
                    # A pair counts in the first table where it meets.
                    new = ~(sig[i, :t] == sig[j, :t]).any(axis=1)
                    one.append(i[new])
                    two.append(j[new])
                i, j = np.concatenate(one), np.concatenate(two)
                if not len(i):
                    continue
                n = np.zeros(end - start, dtype=np.int64)
                weight = copies[start:end]
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                root = roots(end - start, i, j)
                linked = np.flatnonzero(n)
                for column, values in zip(out, (node[start:end][linked], node[start:end][root[linked]], n[linked])):
                    column.append(values)
            if out[0]:
                columns = [pa.array(np.concatenate(x)) for x in out]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "n"])

    return run


def _one_vector(usable: DataFrame, same: DataFrame) -> DataFrame:
    """Links ``node, root`` between classes of equal vectors that rows of one id belong to."""
    several = usable.groupBy("id").count().where("count > 1").select("id")
    theirs = usable.join(several, "id", "left_semi").join(same.select("label", "unit", "node"), ["label", "unit"])
    least = theirs.groupBy("id").agg(F.min("node").alias("root"))
    return theirs.join(least, "id").where("node <> root").select("node", "root")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    tables: int = TABLES,
    planes: int = PLANES,
    bucket: int = BUCKET,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector.

    Two vectors link if their labels are equal and not NULL, their widths are equal, and their
    cosine in double precision is at least ``threshold``. Candidates share all ``planes`` signs in
    one of ``tables`` tables; at cosine 0.93 a pair is missed once in about a thousand times, above
    that less often, and every candidate is checked, whatever the size of its bucket.

    Equal vectors of a label collapse first and are counted, not paired. A bucket larger than
    ``bucket`` is cut into pieces that are compared two at a time. What leaves a bucket is one row
    per vector with links: their number, and the smallest vector it reaches there.

    A vector that is NULL, empty, zero, or has a component that is NULL or not finite links with
    nothing, as do a NULL label and a NULL id (whose component is NULL). Repeated rows count once
    and come back once. Rows that share an id are one vector, which has the links of all of them;
    ``n_links`` adds them up, so a neighbour of two of them counts twice. Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    label_type = rows.schema["label"].dataType.simpleString()
    rows = rows.mapInArrow(_units, f"id bigint, label {label_type}, unit binary").distinct()
    rows = store(rows, "unit-vectors")
    usable = rows.where("id is not null and label is not null and unit is not null")
    same = usable.groupBy("label", "unit").agg(F.min("id").alias("node"), F.countDistinct("id").alias("copies"))
    same = store(same.withColumn("grp", F.xxhash64("label", F.length("unit"))), "classes")

    hashed = same.select("node", "copies", "grp", "unit").mapInArrow(_hash(tables, planes), HASHED)
    hashed = hashed.select("*", F.posexplode("signs").alias("tab", "sign")).select(
        "node", "copies", "signs", "unit", F.col("tab").cast("long").alias("tab"), F.xxhash64("grp", "tab", "sign").alias("slot")
    )
    large = hashed.groupBy("slot").count().where(F.col("count") > bucket)
    large = store(large.select("slot", F.ceil(F.col("count") / bucket).alias("pieces")), "large-buckets")
    if large.isEmpty():
        zero = F.lit(0).cast("long")
        placed = hashed.withColumns({"piece": zero, "first": zero, "second": zero})
    else:
        pieces = F.coalesce("pieces", F.lit(1).cast("long"))
        placed = hashed.join(large, "slot", "left").withColumns(
            {"piece": F.pmod(F.xxhash64("node"), pieces), "other": F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))}
        )
        placed = placed.withColumns({"first": F.least("piece", "other"), "second": F.greatest("piece", "other")})
    columns = ["slot", "first", "second", "piece", "tab", "node", "copies", "signs", "unit"]
    found = (
        placed.select(*columns)
        .repartition("slot", "first", "second")
        .sortWithinPartitions("slot", "first", "second")
        .mapInArrow(_compare(threshold), FOUND)
    )
    found = store(found.groupBy("node", "root").agg(F.sum("n").alias("n")), "links")
    links = found.select("node", "root").unionByName(_one_vector(usable, same))
    place = components(links).select("node", "component")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = same.join(counts, "node", "left").join(place, "node", "left")
    classes = classes.select(
        "label",
        "unit",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    # NULL labels and units match nothing here.
    known = rows.where("id is not null").join(classes, ["label", "unit"], "left")
    known = known.groupBy("id").agg(F.sum("n_links").alias("n"), F.min("component_id").alias("c"))
    known = known.unionByName(rows.where("id is null").select("id"), allowMissingColumns=True)
    return known.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
    )
