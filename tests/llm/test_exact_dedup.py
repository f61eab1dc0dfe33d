"""Exact deduplication against a plain version."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from orderflow.llm import exact_dedup
from test_text_operators import documents, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BEYOND = 2**53


def plain(rows):
    groups = defaultdict(list)
    digest = lambda t: hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()
    for doc_id, text, *_ in rows:
        groups[digest(text)].append(doc_id)
    want = []
    for code, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        want += [(i, ids[-1], len(ids), n == len(ids) - 1, code) for n, i in enumerate(ids)]
    return sorted(want, key=repr)


@pytest.fixture(scope="module")
def rows():
    hot = prose(30, 1)
    many = [(i, hot if i % 3 else hot.upper(), "en", "a") for i in range(100, 300)]
    single = [(i, prose(3, i), "en", "a") for i in range(1000, 1400)]
    odd = [
        (1, None, None, None), (2, "", "en", "a"), (3, " ", "en", "a"), (4, "Été", "fr", "a"), (5, "été", "fr", "a"), (6, "éTé", "fr", "a"),
        (7, "K", "en", "a"), (8, "K", "en", "a"), (9, "k", "en", "a"), (10, "same row", "en", "a"), (10, "same row", "en", "a"),
        (None, "without id", "en", "a"), (None, "WITHOUT id", "en", "a"), (None, "half", "en", "a"), (-5, "HALF", "en", "a"), (11, "long " * 50_000, "en", "a"),
        (12, "LONG " * 50_000, "en", "a"), (BEYOND + 1, "far", "en", "a"), (BEYOND + 3, "FAR", "en", "a"), (BEYOND + 2, "far", "en", "a"),
    ]
    return many + single + odd


def marked(spark, rows):
    got = exact_dedup.mark_copies(documents(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


def test_copies_are_exact(spark, rows):
    assert marked(spark, rows) == plain(rows)


def test_one_word_or_many_slices_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_WORDS", 1)
    monkeypatch.setattr(exact_dedup, "ROWS_PER_WORD", 200)
    assert marked(spark, rows) == plain(rows)


def test_an_empty_table(spark):
    assert marked(spark, []) == []


def test_rows_that_stay_keep_their_columns(spark, rows):
    docs = documents(spark, rows)
    left = exact_dedup.keep_one_copy(docs)
    assert left.columns == docs.columns
    got = sorted((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] is not None)
    kept = {(i, code) for i, _, _, stays, code in plain(rows) if stays}
    assert {(i, hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()) for i, t in got} == {k for k in kept if k[0] is not None}
    assert left.count() == len(kept)


def test_a_filter_lets_go_of_most_single_rows_and_of_no_repeated_one(spark, rows):
    docs = documents(spark, rows)
    numbered = exact_dedup.digests(docs, ["doc_id"], 1).drop("slice")
    first, alone = exact_dedup.possible(numbered, 1)
    both, chance = exact_dedup.possible(first, 2)
    sizes = {i: size for i, _, size, _, _ in plain(rows)}
    passed = [r["id"] for r in alone.unionByName(chance).collect()]
    assert all(sizes[i] == 1 for i in passed) and len(passed) > 0.9 * sum(1 for i in sizes if sizes[i] == 1)
    assert both.count() + len(passed) == len(rows)


def test_no_python_and_no_shuffle_of_single_rows(spark, rows):
    plan = exact_dedup.mark_copies(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
