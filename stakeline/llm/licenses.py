"""License scans: diagonal voting of rolling word hashes against templates, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeline.llm.common import fresh

GRAM = 3
# Diagonals at most this far apart belong to one place: so many words may be put in or left out there.
SLACK = 3
MIN_SCORE = 0.8
# Templates are broadcast; more words than this in all of them are refused.
TEMPLATE_WORDS = 1_000_000

DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A text to look for. A phrase has to stand word for word; a notice may differ here and there."""

    label: str
    text: str
    phrase: bool = False


PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)

# The wording of common license notices: fixed values.
NOTICES = (
    Template("agpl", "licensed under the GNU Affero General Public License"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("gpl", "licensed under the GNU General Public License"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
    Template("lgpl", "licensed under the GNU Lesser General Public License"),
    Template("mit", "released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files",
    ),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)
TEMPLATES = (*PHRASES, *NOTICES)

EMPTY, PHRASE, NOTICE = 0, 1, 2  # kinds of templates; the empty one is in every text once
DOCUMENT = ["doc", "digest", "bytes"]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def _cut(text: Column) -> Column:
    """The words of a text after an empty one, and before another if the text ends in a delimiter."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), DELIMITERS)


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case: runs of 0-9, a-z and characters beyond ASCII. NULL has none."""
    return F.filter(_cut(lower_ascii(text)), lambda w: w != "")


def _template_rows(spark: SparkSession, templates: Iterable[Template], gram: int) -> tuple[DataFrame, int]:
    """A row per word gram of each template and one for the empty gram; how many words a seed has.

    A template shorter than ``gram`` words has one gram, all of it. A seed is the start of a gram, as
    long as the shortest gram of all.
    """
    rows = [(i, t.label, PHRASE if t.phrase else NOTICE, t.text) for i, t in enumerate(templates)]
    texts = spark.createDataFrame(rows, "template int, label string, kind int, text string")
    texts = texts.withColumn("words", words(F.col("text"))).withColumn("length", F.size("words")).where("length > 0")
    texts = texts.withColumn("size", F.least("length", F.lit(gram)))
    seed, total = texts.agg(F.coalesce(F.min("size"), F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if total > TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words, more than the {TEMPLATE_WORDS} that are broadcast")
    starts = F.sequence(F.lit(0), F.col("length") - F.col("size"))
    grams = texts.select("*", F.explode(starts).alias("offset")).select(
        "template", "label", "kind", "length", "size", "offset",
        F.array_join(F.slice("words", F.col("offset") + 1, F.col("size")), " ").alias("known"),
        F.xxhash64(*(F.lower(F.get("words", F.col("offset") + k)) for k in range(seed))).alias("hash"),
    )
    empty = spark.range(1).select(
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(EMPTY).alias("kind"),
        F.lit(0).alias("length"), F.lit(0).alias("size"), F.lit(0).alias("offset"),
        F.lit("").alias("known"), F.xxhash64(F.lit("")).alias("hash"),
    )
    return grams.unionByName(empty), seed


def _votes(docs: DataFrame, id_col: str, text_col: str, templates: Iterable[Template], gram: int) -> DataFrame:
    """Template offsets that agree, by document, template and diagonal (place in the text less offset).

    Every word of a text offers the hash of the seed that starts there; the join keeps those that a
    template has, and the words of the whole gram are compared where hashes agree. The empty gram
    ahead of each text meets the empty template -1: so a document without a hit still has one row,
    which counts its copies. Rows are one per document (id and text), template and diagonal.
    """
    known, seed = _template_rows(docs.sparkSession, templates, gram)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text).alias("digest"),
        F.octet_length(text).alias("bytes"),
        _cut(F.col(text_col)).alias("words"),
    )
    # Neighbouring words side by side: the array itself must not travel with each of its words.
    shifted = [F.slice("words", 1 + k, F.size("words")).alias(f"w{k}") for k in range(gram)]
    n_words = F.size("words") - 1 - (F.element_at("words", -1) == "").cast("int")
    n_words = F.greatest(n_words, F.lit(0))
    texts = texts.select("doc", "digest", "bytes", n_words.alias("n_words"), F.arrays_zip(*shifted).alias("words"))
    # Not posexplode: for that Spark adds a filter on the array's size, and cuts every text again for it.
    places = texts.select("doc", "digest", "bytes", "n_words", F.posexplode_outer("words").alias("pos", "w")).select(
        "doc", "digest", "bytes", "n_words", (F.col("pos") - 1).alias("pos"), "w.*"
    )
    parts = [F.col(f"w{k}") for k in range(gram)]
    at_start = F.col("pos") < 0
    hashed = F.when(at_start, F.xxhash64(F.lit(""))).when(
        parts[seed - 1].isNotNull(), F.xxhash64(*(F.lower(p) for p in parts[:seed]))
    )
    said = F.lit("")
    for size in range(1, gram + 1):
        said = F.when(F.col("size") == size, lower_ascii(F.concat_ws(" ", *parts[:size]))).otherwise(said)
    grams = places.select(*places.columns, hashed.alias("hash"))
    hits = grams.join(F.broadcast(known), "hash").where(F.levenshtein(said, F.col("known")) == 0)
    return hits.groupBy(*DOCUMENT, "template", (F.col("pos") - F.col("offset")).alias("diagonal")).agg(
        F.first("label").alias("label"),
        F.first("kind").alias("kind"),
        F.first("length").alias("length"),
        F.first("size").alias("size"),
        F.first("n_words").alias("n_words"),
        F.count("*").alias("copies"),
        F.sort_array(F.collect_set("offset")).alias("offsets"),
    )


def _spans(votes: DataFrame, slack: int, min_score: float) -> DataFrame:
    """Verified places of each document's templates, and its row of template -1.

    A diagonal is a place by itself; for notices, so are neighbouring diagonals together. The score
    is twice the template's words that grams cover, over the words of template and place. Of notices
    whose places overlap the best stays (then the longest, then the first label). The rows of a
    document stand together already, so no window and no aggregate moves them.
    """
    by = [*DOCUMENT, "template"]
    first = F.col("diagonal") + F.element_at("offsets", 1)
    last = F.col("diagonal") + F.element_at("offsets", -1) + F.col("size") - 1
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    rows = votes.select(
        *by, "label", "kind", "length", "size", "n_words", "copies", "offsets",
        first.alias("first"), last.alias("last"), F.col("diagonal").cast("long").alias("diagonal"),
        F.sum(apart.cast("int")).over(order).alias("place"),
    )
    alone = F.struct(F.lit("diagonal").alias("of"), F.col("diagonal").alias("at"))
    merged = F.struct(F.lit("place").alias("of"), F.col("place").alias("at"))
    both = F.when(F.col("kind") == NOTICE, F.array(alone, merged)).otherwise(F.array(alone))
    covered = F.flatten(F.transform("offsets", lambda o: F.sequence(o, F.greatest(o, o + F.col("size") - 1))))
    spans = (
        rows.select("*", F.explode(both).alias("span"))
        .select("*", F.explode(covered).alias("word"))
        .groupBy(*by, "span")
        .agg(
            F.first("label").alias("label"), F.first("kind").alias("kind"), F.first("length").alias("length"),
            F.min("first").alias("first_word"), F.max("last").alias("last_word"),
            F.size(F.collect_set("word")).alias("covered"),
            F.first("n_words").alias("n_words"), F.first("copies").alias("copies"),
        )
    )
    wide = F.col("last_word") - F.col("first_word") + 1
    score = 2 * F.least("covered", wide) / (F.col("length") + wide)
    least = F.when(F.col("kind") == PHRASE, 1.0).otherwise(min_score)
    spans = spans.withColumn("score", F.when(F.col("kind") != EMPTY, score))
    spans = spans.where((F.col("kind") == EMPTY) | (F.col("score") >= least))
    along = Window.partitionBy(*DOCUMENT, "kind").orderBy("first_word", "last_word", "template", "span")
    reached = F.max("last_word").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("first_word") > reached, F.lit(True)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(*DOCUMENT, "kind", "island").orderBy(F.desc("score"), F.desc("length"), "label", "first_word")
    spans = spans.withColumn("best", F.row_number().over(best))
    return spans.where((F.col("kind") != NOTICE) | (F.col("best") == 1))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Iterable[Template] = TEMPLATES,
    gram: int = GRAM,
    slack: int = SLACK,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """``doc_id, n_words, spans`` per row of ``docs``: where its text holds a template, and how well.

    ``spans`` is an array of ``first_word, last_word, label, phrase, score`` in this order (words
    count from 0), without repeats. A phrase stands word for word and scores 1. A notice may have
    words changed, left out or put in: the places where ``gram`` words agree vote for the diagonal
    (place less template offset) they lie on, diagonals at most ``slack`` apart are merged, and what
    they cover of template and place has to reach ``min_score``; of overlapping notices the best
    counts. Only A-Z are lower-cased.

    Texts are read once and never moved; what is shuffled is one row per document and one per
    diagonal with a vote. A very long text is cut into words within its row. A NULL or empty text has
    no words and no spans; rows without an id are answered like others, repeated rows give repeated
    results. No rows, no result rows; other columns of ``docs`` are not read, so their names don't
    matter. Templates without a word match nothing.
    """
    votes = _votes(docs, id_col, text_col, tuple(templates), gram).repartition(*DOCUMENT)
    span = F.struct("first_word", "last_word", "label", (F.col("kind") == PHRASE).alias("phrase"), "score")
    found = (
        _spans(votes, slack, min_score)
        .groupBy(*DOCUMENT)
        .agg(
            F.first(F.when(F.col("kind") == EMPTY, F.col("n_words")), ignorenulls=True).alias("n_words"),
            F.first(F.when(F.col("kind") == EMPTY, F.col("copies")), ignorenulls=True).alias("copies"),
            F.sort_array(F.collect_set(F.when(F.col("kind") != EMPTY, span))).alias("spans"),
        )
    )
    return found.select(
        F.col("doc").alias(id_col),
        F.col("n_words").cast("long"),
        "spans",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(copy := fresh(docs, "copy")),
    ).drop(copy)


def label_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of ``docs``.

    ``n_base`` counts the places of phrases; ``first_word`` and ``last_word`` are the smallest and
    largest start of one (NULL without any). ``base_labels`` are the labels of phrases, ``labels``
    those of notices too, both sorted and joined by commas. ``score`` is the best of a place, 0
    without one. Options and cases are those of ``scan``.
    """
    found = scan(docs, **options)
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["first_word"].cast("long"))
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        found.columns[0],
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
