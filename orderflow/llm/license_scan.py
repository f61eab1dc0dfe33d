"""License scans by diagonal voting, in DataFrame functions throughout.

Templates are phrases and notices as word sequences. Every run of k words of a text
meets the runs of the templates by its hash in a join (the templates are a constant,
checked to be small, and go to all tasks). A match at word p of a text and word q of
a template is a vote for the diagonal p - q. Votes are counted by text, template and
diagonal. A phrase stands where all its runs vote for one diagonal. Of a notice, which
may have words put in or left out, neighbouring diagonals are merged first; it is
found if enough of its words are covered within some span of about its length, wherever
in the merged diagonals that starts. Votes
only count after their words have been compared, so a collision of hashes finds
nothing.

Phrases give the base labels; notices and further phrases add labels of their own.
The score is 1 where a base phrase stands, else the largest share of a notice that
was found.

Results: a null text counts as empty. Texts of any length are scanned whole; of equal shares of a
notice the first place counts. Documents are told apart by id and text: rows
that repeat both are scanned as one and returned each. An empty table gives an empty
result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderflow.llm.common import document_key, frame, staged, text_of
from orderflow.operators.columns import settle

#: All but ASCII signs; the class is written without a complement, which the regular expressions take far longer for.
WORD, CASED_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

KELVIN, OTHER_LETTER = "\u212a", "\u00e5"

#: Words of a hashed run: of phrases and of notices.
PHRASE_RUN, NOTICE_RUN = 2, 3

#: A notice needs this share of its words, within a span of at most so many times its length.
LEAST_COVERED, LONGEST_SPAN = 0.75, 1.5

#: Diagonals up to this far apart are merged.
NEIGHBOURS = 3

#: Templates of so many words together are sent to all tasks; of more, Spark chooses the join.
WORDS_TO_SEND = 50_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    kind: str  # "base", "phrase" or "notice"


def template(label: str, text: str, kind: str) -> Template:
    return Template(label, tuple(text.split()), kind)


BASE = (
    template("mit", "mit license", "base"),
    template("apache", "apache license", "base"),
    template("gpl", "general public license", "base"),
)
ADDED = (
    template("rights-reserved", "all rights reserved", "phrase"),
    template("bsd", "bsd license", "phrase"),
    template("mozilla", "mozilla public license", "phrase"),
    template("creative-commons", "creative commons", "phrase"),
    template("apache-notice", "licensed under the apache license version 2 0", "notice"),
    template("gpl-notice", "this work is licensed under the gnu general public license version 3", "notice"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "notice"),
    template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "notice"),
    template("cc-notice", "this work is licensed under a creative commons attribution", "notice"),
)


def template_runs(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row per run of words of a template; key is the hash of its first two words."""
    rows = []
    for number, t in enumerate(templates):
        k = NOTICE_RUN if t.kind == "notice" else PHRASE_RUN
        if len(t.words) < k:
            raise ValueError(f"template {t.label} has fewer than {k} words")
        for at in range(len(t.words) - k + 1):
            run = [*t.words[at : at + k], None][:NOTICE_RUN]
            rows.append((number, t.label, t.kind, len(t.words), at, k, *run))
    runs = frame(spark, rows, "template int, label string, kind string, size int, at int, k int, w0 string, w1 string, w2 string")
    keyed = runs.withColumn("key", F.xxhash64("w0", "w1"))
    return F.broadcast(keyed) if sum(len(t.words) for t in templates) <= WORDS_TO_SEND else keyed


def ascii_lowered(name: str = "text") -> Column:
    """The text with A-Z in lower case. Other letters may change too, but none into an
    ASCII letter: the only one that would, the Kelvin sign, is replaced before."""
    return F.lower(F.replace(text_of(name), F.lit(KELVIN), F.lit(OTHER_LETTER)))


def scan_licenses(df: DataFrame, templates: Sequence[Template] = BASE + ADDED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    rows = df.select("doc_id", "text")
    runs = template_runs(df.sparkSession, templates).select(
        "template", "label", "kind", "size", "at", "k", "key", *[F.col(f"w{i}").alias(f"t{i}") for i in range(NOTICE_RUN)]
    )
    texts = settle(rows.select(document_key().alias("doc"), ascii_lowered().alias("__text")), {
        "words": F.regexp_extract_all(F.col("__text"), F.lit(WORD), F.lit(0)),
    })
    shifted = [F.slice(F.col("words"), i + 1, F.size("words")).alias(f"w{i}") for i in range(NOTICE_RUN)]
    placed = texts.select("doc", F.posexplode(F.arrays_zip(*shifted)).alias("place", "w"))
    hashed = placed.select("doc", "place", "w.*", F.xxhash64("w.w0", "w.w1").alias("hash"))
    agreed = (F.col("hash") == F.col("key")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (
        F.col("t2").isNull() | (F.col("w2") == F.col("t2"))
    )
    voted = staged(hashed.join(runs, agreed).select(
        "doc", "template", "label", "kind", "size", "k", "at", (F.col("place") - F.col("at")).alias("diagonal")
    ))
    of_template = ["doc", "template", "label", "kind", "size", "k"]
    diagonals = voted.groupBy(*of_template, "diagonal").agg(F.collect_set("at").alias("runs"))
    phrases = diagonals.where((F.col("kind") != "notice") & (F.size("runs") == F.col("size") - F.col("k") + 1)).select(
        "doc", "label", "kind", F.lit(1.0).alias("share"), F.col("diagonal").alias("place")
    )
    of_text = Window.partitionBy("doc", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(of_text) > NEIGHBOURS).cast("int"), F.lit(1))
    clusters = (
        diagonals.where(F.col("kind") == "notice").withColumn("apart", apart)
        .withColumn("cluster", F.sum("apart").over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*of_template, "cluster", "diagonal", F.explode("runs").alias("at")).withColumn("place", F.col("diagonal") + F.col("at"))
    )
    # a span from each vote on: as far as its last run may start, in units of that for each template; the half keeps whole numbers clear of the limit
    reach = F.floor(LONGEST_SPAN * F.col("size")) - NOTICE_RUN + 0.5
    ahead = Window.partitionBy("doc", "template", "cluster").orderBy(F.col("place") / reach).rangeBetween(0, 1)
    spans = clusters.withColumn("runs", F.collect_set("at").over(ahead))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda at: F.sequence(at, at + NOTICE_RUN - 1)))))
    notices = spans.withColumn("share", covered / F.col("size")).where(F.col("share") >= LEAST_COVERED).select("doc", "label", "kind", "share", "place")
    base = F.col("kind") == "base"
    found = phrases.unionByName(notices).groupBy("doc").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("place"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    ).withColumnRenamed("doc", "of")
    counted = rows.select("doc_id", document_key().alias("doc"), F.regexp_count(text_of(), F.lit(CASED_WORD)).cast("long").alias("n_words"))
    return counted.join(found, F.col("doc") == F.col("of"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
