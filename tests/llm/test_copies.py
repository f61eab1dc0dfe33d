"""Copies that the pipeline's near-duplicate stage has to reduce to one row."""

from __future__ import annotations

import corpus_pipeline
from orderflow.llm import substring_dedup
from test_text_operators import SCHEMA, plain_set, prose


def staying(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return corpus_pipeline.near_duplicate_stage(spark, docs, "")


def test_repeated_rows_and_rows_without_an_id(spark):
    one, two, three = prose(60, 1), prose(60, 2), prose(60, 3)
    near = " ".join([*three.split()[:-1], "other"])
    left = staying(spark, [
        (1, one), (1, one), (None, two), (None, two), (None, two), (2, three), (None, near), (2, near),
        (3, prose(60, 4)), (3, prose(60, 5)), (4, None), (5, ""),
    ])
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    first = [t for i, t in got if i == 2]
    want = [(1, one), (None, two), (2, first[0]), (3, prose(60, 4)), (3, prose(60, 5)), (4, None), (5, "")]
    assert got == sorted(want, key=repr) and first[0] in (three, near)
    after = {r["text"] for r in substring_dedup.remove_repeats(left).collect()}
    assert {one, two, first[0]} <= after


def test_copies_of_a_similarity_between_80_and_85(spark):
    words = prose(110, 6).split()
    changed = list(words)
    changed[30], changed[70] = "other", "word"
    one, other = " ".join(words), " ".join(changed)
    a, b = plain_set(one), plain_set(other)
    assert 0.8 < len(a & b) / len(a | b) < 0.85
    assert [r["doc_id"] for r in staying(spark, [(1, one), (2, other)]).collect()] == [1]
