"""Ranked search against scores of all documents, computed one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderflow.llm import ranked_search
from test_text_operators import documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain(rows, items):
    docs = [(i, Counter(plain_terms(t))) for i, t, *_ in rows if plain_terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    want = []
    for item_id, text in set(items):
        asked, scored = plain_terms(text), []
        for doc_id, counts in docs:
            m = 100 - 75 + (75 * sum(counts.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 8 * m)) for t in asked if t in counts
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scored)[:10], 1):
            want.append((item_id, rank, None if none else doc_id, -score))
    return sorted(want, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    many = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 120))), "en", "a") for i in range(400)]
    copies = [(1000 + i, "copied w250 text w299 " * 3, "en", "a") for i in range(80)]
    return many + copies + [
        (2000, None, "en", "a"), (2001, "", "en", "a"), (2002, "... \n -", "en", "a"), (None, "w299 w298", "en", "a"), (None, "w299 w298", "en", "a"),
        (2003, "w299 w298", "en", "a"), (2003, "w299 w298", "en", "a"), (2004, "W299\tw298!W298_w7", "en", "a"), (2005, "é w299é É w1", "fr", "a"),
        (2006, "w3 " * 60_000, "en", "a"), (2**53 + 1, "only here", "en", "a"), (2**53 + 3, "only here", "en", "a"), (2**53 + 2, "only Here", "en", "a"),
    ]


ITEMS = [
    (1, "w299 w298 w1"), (2, "w0 w1 w2 w3 w0"), (3, "copied text"), (4, "only here w299"), (5, None), (6, "nowhere"), (7, "É é W12 w250-w250"),
    (7, "w5"), (7, "w5"), (None, "w250 w20"), (2**53 + 1, "w100"), (9, " ".join(f"w{i}" for i in range(300))), (10, prose(50, 3)), (11, ""),
]


def found(spark, rows, items=ITEMS):
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("extra"))
    got = ranked_search.rank_documents(documents(spark, rows), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def told(items=ITEMS):
    return [(i, t or "") for i, t in items]


def test_ranks_are_those_of_all_scores(spark, rows):
    assert found(spark, rows) == plain(rows, told())


@pytest.mark.parametrize("name, value", [("LEAF_DOCUMENTS", 1), ("TREE_DOCUMENTS", 20), ("GROUP_TERMS", 4), ("BLOCK_BYTES", 500), ("CELLS", 1)])
def test_sizes_change_nothing(spark, rows, monkeypatch, name, value):
    monkeypatch.setattr(ranked_search, name, value)
    assert found(spark, rows) == plain(rows, told())


def test_empty_tables(spark, rows):
    assert found(spark, []) == [] == found(spark, rows, [])


def test_bounds_hold_and_turn_the_search_away():
    rng = random.Random(1)
    vectors = []
    for doc in range(3000):
        terms = sorted(rng.sample(range(40), rng.randint(1, 25)))
        vectors.append((doc, rng.randint(25, 300), np.array(terms), np.array([rng.randint(1, 6) for _ in terms], np.int64)))
    tree = ranked_search.grown_tree(vectors, np.arange(40), 40)
    for lo, hi in tree.ranges:
        assert (tree.counts[lo:hi] <= tree.maxima[tree.ranges.index((lo, hi))]).all()
    assert sorted(i for ids in tree.ids for i in ids) == list(range(3000))
    leaves = [r for n, r in enumerate(tree.ranges) if n not in tree.children]
    assert sorted(leaves)[0][0] == 0 and all(a[1] == b[0] for a, b in zip(sorted(leaves), sorted(leaves)[1:]))
    query, visited = ranked_search.Query(0, np.array([38, 39]), np.array([5000, 7000])), []
    score = ranked_search.Query.scores
    query.scores = lambda counts, factors: visited.append(len(counts)) or score(query, counts, factors)
    tree.search(query)
    assert sum(visited) < 0.75 * len(tree.ids)
    exact = score(query, tree.counts, tree.factors)
    assert [-b[0] for b in query.best] == sorted(exact, reverse=True)[:10]
