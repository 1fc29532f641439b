"""Token files, packing, archives, the pipeline, and the registered queries."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, difference
from stakeline.llm import common, langid, packing, simhash, simple8b, suffix, token_files, tokens, warc
from stakeline.llm.queries import ORACLE, QUERIES
from stakeline.llm.tokens import Encoder, public_tokenizer

SF = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizer("word_bpe_49k.json"), public_tokenizer("byte_bpe_50k.json")
TEXTS = [
    (3, "Hello  world, it's\n\n fine — naïve Œuvre 123"),
    (1, None),
    (2, ""),
    (None, "no id"),
    (5, "long text with words " * 3000),
    (4, "\x1c a　b <|endoftext|>   ćé ΣΑΣ İ 日本語 🙂👍🏽"),
    (3, "Hello  world, it's\n\n fine — naïve Œuvre 123"),
    (-7, "   "),
]
DOCS = "doc_id long, text string, length int, piece string"


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def plain_ids(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# Token ids


@pytest.fixture(scope="module")
def encoders():
    return {True: Encoder(WORDS, True), False: Encoder(BYTES, False)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0'a1.,sé́"), st.characters()), max_size=40), st.booleans())
def test_encoder_equals_library(encoders, text, strip):
    text = text.encode("utf-8", "ignore").decode()
    own = encoders[strip]
    library = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0].tolist() == library


def test_encoder_on_the_test_texts(spark, encoders):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for own in encoders.values():
        library = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in own.batches(texts)] == library


@pytest.mark.parametrize("strip", [True, False])
def test_marks_after_letters_are_pieces_of_their_own(strip):
    own = Encoder(WORDS if strip else BYTES, strip)
    texts = ["on, on! on. can't 'tis x=\u0338y", "on\x1f, on", "a  b,\n c ", None, "", " on,"]
    assert [x.tolist() for x in own.encode(texts)] == [plain_ids(WORDS if strip else BYTES, t) for t in texts]
    assert {"on", ",", "!", "."} <= set(own.seen) and not {"on,", " on,", "on!", " on!"} & set(own.seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    assert simple8b.unpack(simple8b.pack(values)).tolist() == values.tolist()


def test_simple8b_selectors():
    assert len(simple8b.pack(np.zeros(480, dtype=np.uint64))) == 2
    assert len(simple8b.pack(np.ones(60, dtype=np.uint64))) == 1
    assert len(simple8b.pack(np.full(30, 40_000, dtype=np.uint64))) == 10
    marker = np.array([(15 << 60) | simple8b.ESCAPE] * 3 + [5], dtype=np.uint64)
    assert len(simple8b.pack(marker)) == 7
    assert simple8b.unpack(simple8b.pack(marker)).tolist() == marker.tolist()


def test_simple8b_file():
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 10_000, 70_000, 0, 4096, 3)]
    stream = io.BytesIO()
    writer = simple8b.Writer(stream)
    for i, x in enumerate(ids):
        writer.add(i, x)
    assert writer.close() == sum(map(len, ids))
    reader = simple8b.Reader(stream, stream.tell())
    assert [(d, x.tolist()) for d, _, x in reader.documents()] == [(i, x.tolist()) for i, x in enumerate(ids)]
    whole = np.concatenate(ids)
    for start, end in ((0, 5), (4095, 4097), (9_000, 60_000), (0, len(whole)), (7, 7)):
        assert reader.slice(start, end).tolist() == whole[start:end].tolist()
    with pytest.raises(ValueError):
        simple8b.Reader(io.BytesIO(stream.getvalue()[:-5]), stream.tell() - 5)
    empty = io.BytesIO()
    simple8b.Writer(empty).close()
    assert list(simple8b.Reader(empty, empty.tell()).documents()) == []


@pytest.mark.parametrize("file_bytes", [32 << 20, 10_000])
def test_token_files(spark, file_bytes, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    found = sorted(token_files.round_trip(docs(spark), WORDS).collect(), key=lambda r: r["start"])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    at = 0
    assert len(found) == len(TEXTS)
    for row, (doc, text) in zip(found, sorted(TEXTS, key=key)):
        ids = np.array([*plain_ids(WORDS, text), 2], dtype="<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids"] == ids.tobytes() and row["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert token_files.round_trip(docs(spark, []), WORDS).count() == 0


# Packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_best_fit_equals_definition(lengths, limit):
    bins, open_, places, offsets = [], [], [], []
    for n in lengths:
        fits = [b for b in open_ if 20 - bins[b] >= n]
        if fits:
            room = min(20 - bins[b] for b in fits)
            pick = [b for b in fits if 20 - bins[b] == room][-1]  # the one filled last
        else:
            if len(open_) == limit:
                room = min(20 - bins[b] for b in open_)
                open_.remove([b for b in open_ if 20 - bins[b] == room][-1])
            pick = len(bins)
            bins.append(0)
            open_.append(pick)
        places.append(pick)
        offsets.append(bins[pick])
        bins[pick] += n
        open_.remove(pick)
        if bins[pick] < 20:
            open_.append(pick)
    assert packing.best_fit(lengths, 20, limit) == (places, offsets)


@pytest.mark.parametrize("remember", [True, False])
def test_a_worker_that_forgets_holds_no_tokenizer(remember):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", None]})
    tokens.encoder.cache_clear()
    (cut,) = packing._cut(BYTES, 64, 2, remember)(iter([batch]))
    want = [np.array([*plain_ids(BYTES, t), 2], dtype="<u4").tobytes() for t in ("some words", None)]
    assert cut.column("ids").to_pylist() == want
    assert tokens.encoder.cache_info().currsize == remember


def test_the_pipeline_packs_with_workers_that_forget(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **options: asked.update(options))
    corpus_pipeline.packed(spark, docs(spark), SF)
    assert asked["remember"] is False


@pytest.mark.parametrize("stream", [16_384, 5])
def test_packing(spark, stream, monkeypatch):
    parts = packing.pieces(docs(spark), BYTES, capacity=64)
    rows = packing.pack(parts, capacity=64, stream=stream).toPandas()
    want = []
    for doc, text in TEXTS:
        ids = np.array([*plain_ids(BYTES, text), 2], dtype="<u4")
        stop, start, piece = len(ids) % 64 or 64, 0, 0
        while start < len(ids):
            want.append((doc, piece, start, ids[start:stop].tobytes()))
            start, stop, piece = stop, stop + 64, piece + 1
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.ids) for r in rows.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows.itertuples())
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        ends = own["length"].cumsum()
        assert (own["offset"] == ends - own["length"]).all() and ends.iloc[-1] <= 64
    if stream > 5:
        assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 64) + 1
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0


def test_packing_query_packs_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "pack", lambda parts, *a, _pack=packing.pack, **k: seen.append(parts) or _pack(parts, *a, **k))
    found = {(r["doc_id"], r["start"]): r for r in QUERIES["op7_best_fit_packing"](spark, SF).collect()}
    stored = seen[0].collect()
    assert len(found) == len(stored) and all(len(r["ids"]) == 4 * r["length"] for r in stored)
    assert all(zlib.crc32(r["ids"]) == found[r["doc_id"], r["start"]]["ids_crc32"] for r in stored)


# Archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, 9, "d") for r in rows], "page_id long, url string, html string, size int, digest string")


@pytest.mark.parametrize("sample", [4 << 20, 2000])
def test_warc(spark, sample, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", sample)
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    long, short = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60, "<p>short</p>"
    rows = [(i, f"http://a/{i}", f"<html>{i * 7919 % 1000} " + "text " * (i % 40 * 10)) for i in range(120)]
    rows += [(200, "http://b/\r\nX: y", long), (205, None, long), (203, "http://b/ö", long), (None, "http://n", long)]
    rows += [(300, "u", short), (301, "u", short), (302, "u", None), (303, "u", ""), (205, None, long), (None, None, "own" * 900)]
    index = warc.write(pages(spark, rows), common.new_path(spark, "warc"))
    assert index.count() == len(rows)
    found = warc.read(spark, index).collect()
    got, want = [], []
    for r in found:
        got.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        revisit = len(data) >= 1000 and same and page != max(same)
        kind = ("revisit", max(same)) if revisit else ("response", None)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), *kind))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    payloads = {r["page_id"]: r["payload"] for r in found if r["record_type"] == "response"}
    assert payloads[205] == long.encode() and payloads[303] == b"" and payloads[300] == short.encode()
    assert {r["url"] for r in found} >= {"http://b/%0D%0AX:%20y", "http://b/ö", "urn:page:205"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_file_alone():
    class Kept(io.BytesIO):
        def close(self):
            pass

    stream = Kept()
    writer = warc.Writer(stream)
    for i in range(30):
        data = f"<p>{i} some text that repeats</p>".encode()
        writer.add(i, warc.record(i, "u", data, len(data), hashlib.sha1(data).hexdigest(), None, warc.DATE))
    writer.close()
    assert stream.getvalue()[:4] == bytes.fromhex("5d2a4d18")
    stream.seek(0)
    found = [warc.parse(h, b) for h, b in warc.read_records(stream)]
    assert [f[0] for f in found] == list(range(30))
    page, place, size = writer.index[7]
    stream.seek(0)
    one = io.BytesIO(stream.getvalue()[: 8 + int.from_bytes(stream.getvalue()[4:8], "little")] + stream.getvalue()[place : place + size])
    assert [warc.parse(h, b)[0] for h, b in warc.read_records(one)] == [page]
    header, block = next(warc.read_records(io.BytesIO(stream.getvalue())))
    with pytest.raises(ValueError):
        warc.parse(header, block + b"x")


# Pipeline and queries


def test_pipeline(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None), (9002, ""), (9003, "12 34 !"), (None, "the and of the and")]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    at = raw.unionByName(odd, allowMissingColumns=True).withColumn("fp", raw["lang"])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing",
    ]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, common.store(stage(spark, at, SF), "stage")
        seen[name] = (before.toPandas(), at.toPandas())
        if name != "best-fit packing":
            assert at.columns == raw.columns + ["fp"] and at.schema["n_chars"] == raw.schema["n_chars"]
    before, after = seen["language"]
    assert set(before["doc_id"].dropna()) - set(after["doc_id"].dropna()) == {9001, 9002, 9003}
    assert after["doc_id"].isna().sum() == 1
    before, after = seen["simhash near-dedup"]
    prints = {i: simhash.fingerprint(t) for i, t in zip(before["doc_id"], before["text"])}
    kept = set(after["doc_id"].dropna())
    for i in set(before["doc_id"].dropna()) - kept:
        assert any((prints[i] ^ prints[j]).bit_count() <= 3 for j in prints if j < i)
    for i in kept:
        assert not any((prints[i] ^ prints[j]).bit_count() <= 3 for j in kept if j < i)
    before, after = seen["suffix-array dedup"]
    assert len(before) == len(after) and (after["text"].str.len() == after["n_chars"]).all()
    windows = {}
    for i, t in zip(before["doc_id"], before["text"]):
        t = t.encode()
        for k in range(len(t) - 199):
            windows[t[k : k + 200]] = windows.get(t[k : k + 200], 0) + 1
    for t, left in zip(before.sort_values("doc_id")["text"], after.sort_values("doc_id")["text"]):
        t, gone = t.encode(), np.zeros(len(t.encode()), dtype=bool)
        for k in range(len(t) - 199):
            if windows[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert left == bytes(np.frombuffer(t, dtype=np.uint8)[~gone]).decode("utf-8", "ignore")
    before, after = seen["benchmark decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = set(after["doc_id"])
    assert all(i not in left for i, t in zip(before["doc_id"], before["text"]) if any(x in t for x in items))
    before, after = seen["best-fit packing"]
    for i, t in zip(before["doc_id"].dropna(), before.dropna(subset="doc_id")["text"]):
        own = after[after["doc_id"] == i].sort_values("start")
        assert b"".join(own["ids"]) == np.array([*plain_ids(BYTES, t), 2], dtype="<u4").tobytes()


def test_run_and_release(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and "sequence_id" in rows.columns
    folder = f"{common.shared_dir(spark)}/llm/{spark.sparkContext.applicationId}".removeprefix("file:")
    import os

    assert os.listdir(folder)
    assert common.release(spark) > 0
    assert not os.listdir(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op3": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op8": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op9": ["doc_id", "held_out", "lang_pred", "score"],
    "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


def test_queries_are_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op6_simhash_near_dedup", "op9_language_id"])
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stage_operators_are_the_queries_operators():
    assert simhash.near_duplicates.__module__ == "stakeline.llm.simhash"
    assert langid.UNKNOWN == "und" and suffix.LENGTH == 200


def test_by_key():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 12, 200))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(values[a:b]), pa.array(np.arange(a, b))], names=["k", "v"])
        for a, b in ((0, 0), (0, 3), (3, 4), (4, 90), (90, 91), (91, 200))
    ]
    runs = []
    for table, bounds in common.by_key(iter(batches), ["k"]):
        k, v = table["k"].to_pylist(), table["v"].to_pylist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            assert len(set(k[a:b])) == 1
            runs.append((k[a], v[a:b]))
    assert runs == [(k, np.flatnonzero(values == k).tolist()) for k in np.unique(values)]
