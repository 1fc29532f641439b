"""From raw documents to packed training sequences, as stages that are each stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakeline.llm import decontaminate, langid, packing, simhash, suffix
from stakeline.llm.common import fresh, new_path, release, stored
from stakeline.llm.tokens import public_tokenizer

# Texts that travel to and from a task's Python side at once. Stages follow each other in the same
# executors, whose memory holds what each stage's workers keep, so batches are a tenth of the default.
TEXTS = 1000
# A text whose best language scores less is in none of the languages that the profiles know.
MIN_LANGUAGE_SCORE = 0.2


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold at most ``TEXTS`` rows from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS:
        spark.conf.set(name, TEXTS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know stay; those without a letter, or a text, go."""
    _small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = fresh(docs, "_language")
    kept = docs.withColumn(found, langid.predictor(model)(F.col("text")))
    known = (F.col(f"{found}.lang") != langid.UNKNOWN) & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)
    return kept.where(known).drop(found)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 3-word SimHashes lie at most three bits apart stays.

    Of rows without an id one of each fingerprint stays.
    """
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; bytes in strings of 200 bytes that occur twice are cut out of their texts.

    ``n_chars``, where there is one, is that of the text that is left.
    """
    _small_batches(spark)
    cut = suffix.drop_repeated(docs, length=200)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that tiles of a benchmark item cover to four fifths of the item go; NULL texts cover none."""
    _small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items, min_match=5, coverage=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in sequences of 1024; a NULL text is the end id alone.

    An executor still has the workers of the stages before, more of them than run at once, so those
    that wait hold no tokenizer.
    """
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"), capacity=1024, end=2, remember=False)


STAGES = [
    ("language", language),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]

# Fingerprints, n-gram profiles, suffix arrays and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder for the next.

    What a stage stored besides, and its input, is released once its result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored()
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, before, keep=path)
        docs = spark.read.parquet(path)
    return docs
