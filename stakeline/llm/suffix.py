"""Exact removal of repeated byte strings: suffix arrays over shards of candidate passages.

1. Every window of ``length`` bytes gets a key that its bytes alone decide: the smallest hash of the
   ``SEED`` bytes at any place in it. Neighbouring windows mostly share a key and form a run. Equal
   windows have equal keys, so only keys that occur twice anywhere can hold a repeated window.
2. Runs of such keys go, with their bytes, to the shard of their key. A shard sorts its windows with
   a suffix array and finds equal neighbours by their common prefix.
3. A key with too many runs for a shard is cut into pieces by document and place. Pieces exchange sorted
   digests of their windows and find each other's by binary search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeline.llm.common import fresh, store, text_slices, trim

LENGTH = 200
SEED = 64
# Windows that a task hashes at once, the most windows in a run, bytes of text per key shard,
# bytes of passages per suffix array, and runs of one key per piece.
BLOCK = 1 << 19
RUN = 512
KEY_SHARD = 8 << 20
ARRAY = 2 << 20
HOT = 8192

# Bytes of text whose runs a task holds at once.
TEXT = 6 << 20

RADIX = np.uint64(0x5851F42D4C957F2D)
MASK = (1 << 64) - 1
KEYED = np.dtype([("key", "<u8"), ("id", "<i8"), ("th", "<i4"), ("lo", "<u4"), ("n", "<u2"), ("seen", "u1")])
RUNS = np.dtype([("key", "<u8"), ("lo", "<u4"), ("n", "<u2")])
MEMBER = np.dtype([("id", "<i8"), ("th", "<i4"), ("lo", "<u4")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])

ROUTED = "shard bigint, settled boolean, id bigint, th int, runs binary"
PASSAGES = "shard bigint, n binary, hot binary, many binary, members binary, keys binary, data binary"
SPANS = "id bigint, th int, spans binary, digest binary, pos bigint"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(RADIX), -1, MASK + 1))
    up, down = np.full(n, RADIX), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours."""
    at, size = values, 1
    while 2 * size <= width:
        at, size = pick(at[:-size], at[size:]), 2 * size
    return pick(at[: len(values) - width + 1], at[width - size :]) if size < width else at


def key_runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs ``(document, place in it, windows, key, repeats)`` of the documents laid end to end in ``data``.

    ``repeats`` tells that the key's bytes may occur twice within the run.
    """
    width = length - seed + 1
    up, down = _powers(BLOCK + length)
    for start in range(0, max(len(data) - length + 1, 0), BLOCK):
        piece = data[start : start + BLOCK + length - 1]
        total = np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)])
        total = np.concatenate([np.zeros(1, dtype=np.uint64), total])
        hashes = (total[seed:] - total[:-seed]) * down[: len(piece) - seed + 1]
        hashes ^= hashes >> np.uint64(33)
        hashes *= np.uint64(0xFF51AFD7ED558CCD)
        hashes ^= hashes >> np.uint64(33)
        keys = _slide(hashes, width, np.minimum)
        count = len(keys)
        bounds = offsets[np.searchsorted(offsets, start, "right") : np.searchsorted(offsets, start + count + length, "left")]
        cut = np.zeros(count + 1, dtype=np.int32)
        np.add.at(cut, np.clip(bounds - length + 1 - start, 0, count), 1)
        np.add.at(cut, np.clip(bounds - start, 0, count), -1)
        valid = np.cumsum(cut[:-1]) == 0
        new = valid.copy()
        new[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stops = np.append(np.flatnonzero(new | ~valid), count)
        n = stops[np.searchsorted(stops, first, "right")] - first
        if n.max() > RUN:
            parts = -(-n // RUN)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, n = np.repeat(first, parts) + step * RUN, np.minimum(np.repeat(n, parts) - step * RUN, RUN)
        edge = np.zeros(width - 1, dtype=np.uint64)
        least = _slide(np.concatenate([edge, np.where(valid, keys, np.uint64(0)), edge]), width, np.maximum)
        chosen = np.flatnonzero(hashes == least)
        twins = chosen[:-1][hashes[chosen[1:]] == hashes[chosen[:-1]]]
        repeats = np.searchsorted(twins, first + n + width - 1) > np.searchsorted(twins, first)
        doc = np.searchsorted(offsets, start + first, "right") - 1
        yield doc, start + first - offsets[doc], n, keys[first], repeats


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a binary column; NULL counts as empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _by(values: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each distinct value."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    return iter(np.split(order, cuts)) if len(values) else iter(())


def _find_keys(length: int, seed: int, shards: int):
    """Runs by key shard. A key found twice in some rows is settled there: it sends one row only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text", TEXT)):
            data, offsets = _bytes_of(batch.column("text"))
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            parts = list(key_runs(data, offsets, length, seed))
            if not parts:
                continue
            doc, lo, n, key, repeats = (np.concatenate(x) for x in zip(*parts))
            _, first, place, seen = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            np.maximum.at(seen, place[repeats], 2)
            settled = seen[place] > 1
            rows: list[tuple] = []
            runs = np.empty(len(key), dtype=RUNS)
            runs["key"], runs["lo"], runs["n"] = key, lo, n
            picked = np.flatnonzero(settled)
            for own in _by(doc[picked]):
                own = picked[own]
                d = doc[own[0]]
                rows.append((int(ids[d]) % shards, True, int(ids[d]), int(ths[d]), runs[own].tobytes()))
            keyed = np.empty(len(first), dtype=KEYED)
            keyed["key"], keyed["id"], keyed["th"] = key[first], ids[doc[first]], ths[doc[first]]
            keyed["lo"], keyed["n"], keyed["seen"] = lo[first], n[first], np.minimum(seen, 2)
            shard = (keyed["key"] % np.uint64(shards)).astype(np.int64)
            rows += [(int(shard[own[0]]), False, 0, 0, keyed[own].tobytes()) for own in _by(shard)]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())
            columns = [pa.array(x, type=t) for x, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "settled", "id", "th", "runs"])
        trim()

    return run


def _repeated_keys(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of keys that occur twice, by document; settled rows pass."""
    keyed = np.frombuffer(b"".join(rows["runs"][~rows["settled"]]), dtype=KEYED)
    _, place, count = np.unique(keyed["key"], return_inverse=True, return_counts=True)
    open_ = keyed["seen"] == 1
    known = np.zeros(len(count), dtype=bool)
    known[place[~open_]] = True
    found = keyed[open_ & (known | (count > 1))[place]] if len(keyed) else keyed
    found = found[np.lexsort((found["th"], found["id"]))]
    runs = np.empty(len(found), dtype=RUNS)
    for name in RUNS.names:
        runs[name] = found[name]
    cuts = np.flatnonzero((np.diff(found["id"]) != 0) | (np.diff(found["th"]) != 0)) + 1
    bounds = np.concatenate([[0], cuts, [len(found)]]) if len(found) else np.zeros(1, dtype=int)
    settled = rows[rows["settled"]]
    return pd.DataFrame(
        {
            "id": np.concatenate([settled["id"], found["id"][bounds[:-1]]]),
            "th": np.concatenate([settled["th"], found["th"][bounds[:-1]]]),
            "runs": [*settled["runs"], *(runs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:]))],
        }
    )


def _passages(length: int, shards: int, known: dict[int, int] | None = None):
    """The bytes of each run to the shard of its key; equal runs of a slice once, with their places.

    Hot keys and their pieces come with a document, in its column ``hot``, or are ``known`` for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text", TEXT)):
            texts, blobs = batch.column("text"), batch.column("runs")
            crowded = batch.column("hot") if "hot" in batch.schema.names else pa.nulls(batch.num_rows)
            ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
            held: dict[int, dict[bytes, list]] = {}
            for d in range(batch.num_rows):
                text = texts[d].as_py()
                runs = np.unique(np.frombuffer(b"".join(blobs[d].as_py()), dtype=RUNS))  # repeated rows send them twice
                hot = {**(known or {}), **{h["key"] & MASK: h["pieces"] for h in crowded[d].as_py() or ()}}
                member = (int(ids[d]), int(ths[d]))
                for key, lo, n in zip(runs["key"].tolist(), runs["lo"].tolist(), runs["n"].tolist()):
                    pieces = hot.get(key, 0)
                    place = ids[d].tobytes() + lo.to_bytes(4, "little")
                    piece = xxhash.xxh64_intdigest(place, key) % pieces if pieces else 0
                    shard = (key + piece * 0x9E3779B97F4A7C15 >> 7 & MASK) % shards
                    entry = held.setdefault(shard, {}).setdefault(text[lo : lo + n + length - 1], [pieces > 0, key])
                    entry.append((*member, lo))
            rows = []
            for shard, found in held.items():
                members = np.array([m for entry in found.values() for m in entry[2:]], dtype=MEMBER)
                rows.append(
                    (
                        shard,
                        np.array([len(x) - length + 1 for x in found], dtype="<u2").tobytes(),
                        np.array([entry[0] for entry in found.values()], dtype="u1").tobytes(),
                        np.array([len(entry) - 2 for entry in found.values()], dtype="<u4").tobytes(),
                        members.tobytes(),
                        np.array([entry[1] for entry in found.values()], dtype="<u8").tobytes(),
                        b"".join(found),
                    )
                )
            if rows:
                names = ["shard", "n", "hot", "many", "members", "keys", "data"]
                columns = [pa.array(x, type=pa.binary() if i else pa.int64()) for i, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    return run


def suffix_order(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``starts`` sorted by the ``length`` bytes that follow, and eight-byte words of ``data``.

    Larsson-Sadakane refinement: places are sorted by their first eight bytes, and each round sorts
    the groups that are still equal at depth d by the rank of the place d further on, which doubles
    the depth; groups of one are left alone. ``ends`` bounds each place: no string reaches across it.
    """
    size = len(data)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).tobytes()
    words = np.empty(size, dtype=np.uint64)
    for at in range(min(8, size)):
        part = words[at::8]
        part[:] = np.frombuffer(padded, dtype=">u8", offset=at, count=len(part))
    room = ends - np.arange(size)
    rank = np.zeros(size, dtype=np.int64)
    depth = 8
    todo = np.flatnonzero(room >= depth)
    keys, base = words[todo], np.zeros(len(todo), dtype=np.int64)
    while True:
        order = np.argsort(keys)
        todo, keys, base = todo[order], keys[order], base[order]
        fresh_ = np.ones(len(todo), dtype=bool)
        fresh_[1:] = keys[1:] != keys[:-1]
        head = np.ones(len(todo), dtype=bool)
        head[1:] = base[1:] != base[:-1]
        here = np.arange(len(todo))
        group = np.maximum.accumulate(np.where(fresh_, here, 0))
        rank[todo] = base + group - np.maximum.accumulate(np.where(head, here, 0))
        if 2 * depth > length:
            break
        single = fresh_ & np.append(fresh_[1:], True)
        todo = todo[~single]
        todo = todo[room[todo] >= 2 * depth]
        base = rank[todo]
        keys = base.astype(np.uint64) * np.uint64(size) + rank[todo + depth].astype(np.uint64)
        depth *= 2
    last = rank[starts].astype(np.uint64) * np.uint64(size) + rank[starts + length - depth].astype(np.uint64)
    return starts[np.argsort(last)], words


def common_prefixes(
    words: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray, length: int
) -> np.ndarray:
    """Bytes (``length`` at most) that each sorted place shares with the one before it.

    Kasai's rule, for all passages side by side: going from a place to the next in its passage loses
    at most one byte, if the place before it moves on within its passage too and stays before it.
    """
    size = len(words)
    place = np.full(size + 1, -1, dtype=np.int64)
    place[order] = np.arange(len(order))
    before = np.full(size + 1, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(len(order), dtype=np.int64)
    by_size = np.argsort(-n, kind="stable")
    first, n = first[by_size], n[by_size]
    have = np.zeros(len(first), dtype=np.int64)
    for step in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -step, "left"))
        here = first[:live] + step
        other = before[here]
        if step:
            last = before[here - 1]
            follows = (last >= 0) & (place[last + 1] >= 0) & (place[last + 1] < place[here])
            have[:live] = np.where(follows, np.maximum(have[:live] - 1, 0), 0)
        grow = np.flatnonzero((other >= 0) & (have[:live] < length))
        have[:live][other < 0] = 0
        while len(grow):
            at = have[grow]
            gap = words[here[grow] + at] ^ words[other[grow] + at]
            equal = gap == 0
            part = gap[~equal]
            some = np.zeros(len(part), dtype=np.int64)
            for k in range(1, 8):
                some += part < np.uint64(1 << (64 - 8 * k))
            at[equal] += 8
            at[~equal] += some
            have[grow] = np.minimum(at, length)
            grow = grow[equal & (at < length)]
        shared[place[here]] = have[:live]
    return shared


def repeated_windows(data: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some passages in the order of their bytes, and the class of equal ones.

    Passage i holds ``n[i]`` windows from ``first[i]`` on, so ``n[i] + length - 1`` bytes.
    """
    starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ends = np.repeat(first + n + length - 1, n + length - 1)
    order, words = suffix_order(data, ends, starts, length)
    shared = common_prefixes(np.append(words, np.zeros(length, dtype=np.uint64)), order, first, n, length)
    return order, np.cumsum(shared < length) - 1


def _spans(flags: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges that the flagged windows cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    start, end = edges[::2], edges[1::2] + length - 1
    joined = np.ones(len(start), dtype=bool)
    joined[1:] = start[1:] > end[:-1]
    out = np.empty(int(joined.sum()), dtype=SPAN)
    out["start"], out["end"] = start[joined], np.append(end[:-1][joined[1:]], end[-1:])
    return out


def _search(length: int):
    """Spans of repeated windows by document, and a digest of each distinct window of a hot key.

    Windows of different keys differ. So a passage whose key no other passage of the shard has needs
    no suffix array, unless it repeats a window itself: all its windows occur as often as it does.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, list] = {}
        for row in rows.itertuples(index=False):
            n, hot = np.frombuffer(row.n, dtype="<u2").tolist(), np.frombuffer(row.hot, dtype="u1").tolist()
            many, at, m = np.frombuffer(row.many, dtype="<u4").tolist(), 0, 0
            members = np.frombuffer(row.members, dtype=MEMBER)
            for windows, is_hot, count, key in zip(n, hot, many, np.frombuffer(row.keys, dtype="<u8").tolist()):
                entry = found.setdefault(row.data[at : at + windows + length - 1], [False, [], key])
                entry[0] |= bool(is_hot)
                entry[1].append(members[m : m + count])
                at, m = at + windows + length - 1, m + count
        n = np.array([len(x) - length + 1 for x in found], dtype=np.int64)
        _, place, count = np.unique(np.array([x[2] for x in found.values()], dtype="<u8"), return_inverse=True, return_counts=True)
        compared = count[place] > 1
        for k, text in enumerate(found):
            if not compared[k] and n[k] > 1:
                compared[k] = len({text[p : p + length] for p in range(n[k])}) < n[k]
        data = np.frombuffer(b"".join(x for x, c in zip(found, compared.tolist()) if c), dtype=np.uint8)
        first, some = np.zeros(len(n), dtype=np.int64), n[compared]
        first[compared] = np.cumsum(some + length - 1) - (some + length - 1)
        flags, told = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        if len(some):
            order, group = repeated_windows(data, first[compared], some, length)
            flags[order] = np.bincount(group)[group] > 1
            told[order[np.diff(group, prepend=-1) > 0]] = True  # one of each class
        copies = np.array([sum(len(m) for m in entry[1]) for entry in found.values()])
        place: dict[tuple[int, int], list[np.ndarray]] = {}
        digests: list[tuple] = []
        for k, (text, (is_hot, parts, _)) in enumerate(found.items()):
            own = flags[first[k] : first[k] + n[k]] if compared[k] else np.zeros(n[k], dtype=bool)
            own = own | (copies[k] > 1)
            members = np.concatenate(parts)
            if is_hot:
                some = members[0]
                once = told[first[k] : first[k] + n[k]] if compared[k] else np.ones(n[k], dtype=bool)
                for p in np.flatnonzero(once).tolist():
                    digest = xxhash.xxh3_128_digest(text[p : p + length])
                    at = -1 if own[p] else int(some["lo"]) + p
                    digests.append((int(some["id"]), int(some["th"]), None, digest, at))
            if own.any():
                spans = _spans(own, length)
                for i, th, lo in members.tolist():
                    moved = spans.copy()
                    moved["start"] += lo
                    moved["end"] += lo
                    place.setdefault((i, th), []).append(moved)
        out = [(i, th, np.concatenate(spans).tobytes(), None, -1) for (i, th), spans in place.items()] + digests
        del found, data, flags
        trim()
        return pd.DataFrame(out, columns=["id", "th", "spans", "digest", "pos"])

    return run


def _merge(length: int):
    """Windows of one piece that another piece has too, by binary search among the sorted digests."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        digests = np.frombuffer(b"".join(bytes(x) for x in rows["digest"]), dtype=[("a", ">u8"), ("b", ">u8")])
        a, b = digests["a"].astype(np.uint64), digests["b"].astype(np.uint64)
        sorted_a = np.sort(a)
        many = np.searchsorted(sorted_a, a, "right") - np.searchsorted(sorted_a, a, "left") > 1
        pairs = pd.Series(b[many]).groupby([a[many], b[many]]).transform("size").to_numpy() > 1
        many[np.flatnonzero(many)[~pairs]] = False
        hit = rows[many & (rows["pos"] >= 0).to_numpy()]
        spans = [np.array([(p, p + length)], dtype=SPAN).tobytes() for p in hit["pos"]]
        return pd.DataFrame({"id": hit["id"], "th": hit["th"], "spans": spans})

    return run


def merged_spans(blobs: list[bytes]) -> np.ndarray:
    """Maximal runs covered by the spans of ``blobs``."""
    spans = np.sort(np.frombuffer(b"".join(blobs), dtype=SPAN), order=("start", "end"))
    reach = np.maximum.accumulate(spans["end"])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans["start"][1:] > reach[:-1]
    out = np.empty(int(new.sum()), dtype=SPAN)
    out["start"] = spans["start"][new]
    out["end"] = reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    return out


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, "text", TEXT)):
            rows = []
            for text, blobs in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                spans, kept, at = merged_spans(blobs), [], 0
                for start, end in spans.tolist():
                    kept.append(text[at:start])
                    at = end
                left = b"".join([*kept, text[at:]])
                rows.append(
                    (
                        len(text) - len(left),
                        len(spans),
                        hashlib.sha256(left).hexdigest(),
                        left.decode("utf-8", "ignore") if with_text else None,
                    )
                )
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            names = ["id", "th", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *columns], names=names)
        trim()

    return run


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A name for a document that repeated rows share: its id, and a hash of its text. Without an id equal texts share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text)).alias("id"),
        F.hash(F.col(id_col).isNull(), text).alias("th"),
    ]


def removals(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_text: bool = True,
    key_shard: int = KEY_SHARD,
    array: int = ARRAY,
    hot: int = HOT,
) -> DataFrame:
    """``id, th, n_removed, n_spans, kept_sha256, kept`` of the documents that lose bytes."""
    seed = max(length * 8 // 25, 1)
    names = docs.select(
        *_identity(id_col, text_col),
        F.col(text_col).cast("binary").alias("text"),
        F.col(id_col).isNull().alias("no_id"),
        F.lit(False).alias("whole"),
    )
    total, nameless = names.agg(F.sum(F.octet_length("text")), F.count_if("no_id")).first()
    shards = max(math.ceil((total or 0) / key_shard), 1)
    long_enough = names.where(F.octet_length("text") >= length)
    if nameless:
        # Rows without an id are documents of their own: of those with equal texts one is searched, and they lose all bytes.
        own = long_enough.where("no_id").groupBy("id", "th").agg(
            F.first("text").alias("text"), F.lit(True).alias("no_id"), (F.count("*") > 1).alias("whole")
        )
        own = store(own, "without-id")
        long_enough = long_enough.where(~F.col("no_id")).unionByName(own)
    long_enough = long_enough.drop("no_id")
    routed = long_enough.mapInArrow(_find_keys(length, seed, shards), ROUTED)
    runs = routed.groupBy("shard").applyInPandas(_repeated_keys, "id bigint, th int, runs binary")
    runs = store(runs.groupBy("id", "th").agg(F.collect_list("runs").alias("runs")), "runs")
    size = runs.select(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r)).alias("b"))
    count = (size.agg(F.sum("b")).first()[0] or 0) // RUNS.itemsize
    each = runs.select(F.explode("runs").alias("r")).mapInArrow(_keys_of, "key bigint, n bigint")
    crowded = each.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    crowded = store(crowded.select("key", F.ceil(F.col("n") / hot).alias("pieces")), "hot-keys")
    pieces = not crowded.isEmpty()
    if pieces:
        holders = runs.mapInArrow(_documents_of, "id bigint, th int, key bigint").join(crowded, "key")
        holders = holders.groupBy("id", "th").agg(F.collect_list(F.struct("key", "pieces")).alias("hot"))
        runs = runs.join(holders, ["id", "th"], "left")
    else:
        runs = runs.withColumn("hot", F.array().cast("array<struct<key: bigint, pieces: bigint>>"))
    # Repeated rows are one document.
    texts = long_enough.join(runs, ["id", "th"]).dropDuplicates(["id", "th"])
    texts = store(texts, "candidates")
    arrays = max(math.ceil(count * (length + 70) / array), 1)
    passages = texts.mapInArrow(_passages(length, arrays), PASSAGES)
    found = passages.groupBy("shard").applyInPandas(_search(length), SPANS)
    spans = found.select("id", "th", "spans")
    if pieces:
        found = store(found, "windows")
        digests = found.where("digest is not null")
        other = digests.withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(arrays)))
        other = other.groupBy("slot").applyInPandas(_merge(length), "id bigint, th int, spans binary")
        spans = found.where("spans is not null").select("id", "th", "spans").unionByName(other)
    spans = spans.groupBy("id", "th").agg(F.collect_list("spans").alias("spans"))
    cut = texts.where(~F.col("whole")).select("id", "th", "text").join(spans, ["id", "th"])
    cut = cut.mapInArrow(
        _cut(with_text), "id bigint, th int, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
    )
    if not nameless:
        return cut
    whole = own.where("whole").select(
        "id",
        "th",
        F.octet_length("text").cast("long").alias("n_removed"),
        F.lit(1).cast("long").alias("n_spans"),
        F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"),
        F.lit("" if with_text else None).cast("string").alias("kept"),
    )
    return cut.unionByName(whole)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=RUNS)
        keys, n = np.unique(runs["key"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each document."""
    for batch in batches:
        blobs = [b"".join(x) for x in batch.column("runs").to_pylist()]
        keys = [np.unique(np.frombuffer(x, dtype=RUNS)["key"]) for x in blobs]
        many = [len(k) for k in keys]
        columns = [np.repeat(batch.column(c).to_numpy(), many) for c in ("id", "th")]
        columns.append(np.concatenate([np.zeros(0, dtype=np.uint64), *keys]).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "th", "key"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``.

    Each byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the
    same document or another; strings are judged on the input. A NULL text is empty. Rows that
    share id and text are one document and come back repeated; each row without an id is a document
    of its own. Texts shorter than ``length`` lose nothing. Other columns are ignored.
    """
    changed = removals(docs, id_col, text_col, length, with_text=False, **options)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *_identity(id_col, text_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(text, 256).alias("whole"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(changed, ["id", "th"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; rows and other columns stay.

    A character that a cut splits goes as a whole.
    """
    changed = removals(docs, id_col, text_col, length, **options)
    names = [fresh(docs, n) for n in ("_id", "_th", "_kept")]
    changed = changed.select(*[F.col(c).alias(n) for c, n in zip(("id", "th", "kept"), names)])
    id_, th = _identity(id_col, text_col)
    joined = docs.join(changed, (id_ == changed[names[0]]) & (th == changed[names[1]]), "left")
    text = F.coalesce(F.col(names[2]), F.col(text_col)).alias(text_col)
    return joined.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
