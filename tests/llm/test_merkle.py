"""The Merkle manifest against a plain version."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from orderflow.llm import merkle
from test_text_operators import documents, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source = row
    n_chars = len(text or "") + more
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*told)


def tree(nodes):
    """All levels, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def walk(levels, at, node):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 2 * 2 : at // 2 * 2 + 2]
        others = [x for i, x in enumerate(run) if i != at % 2]
        proof += "".join(others)
        node = sha(*(node if i == at % 2 else x for i, x in enumerate(run)))
        at //= 2
    return node, proof


def plain(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[2]].append(row)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = tree([plain_leaf(r) for r in by[lang]])
    top = tree([trees[lang][-1][0] for lang in order])
    root, want = top[-1][0], []
    for at, lang in enumerate(order):
        for place, row in enumerate(by[lang]):
            struck = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, low = walk(trees[lang], place, plain_leaf(row, 1 if struck else 0))
            reached, high = walk(top, at, node)
            want.append((row[0], plain_leaf(row), trees[lang][-1][0], root, sha(low + high), reached, reached == root))
    return sorted(want, key=repr)


@pytest.fixture(scope="module")
def rows():
    found = [(i, prose(5, i), ("de", "en", None, "en")[i % 4], "a") for i in range(1, 60)]
    return found + [
        (None, "without id", "en", "a"), (None, "another", "en", "a"), (70, None, "fr", None), (71, "", "es", "a"), (72, "x", "es", "b"),
        (73, "x", "es", "b"), (73, "x", "es", "b"), (73, "y", "es", "b"), (-74, "long " * 40_000, "", "a"), (2**53 + 1, "far", "Ü", "a"),
        (2**53 + 3, "far", "Ü", "a"), (2**53 + 2, "far", "Ü", "a"), (None, "far", "Ü", "a"),
    ]


def checked(spark, rows):
    built = merkle.build_manifest(documents(spark, rows), merkle.tampered_leaf())
    return sorted(map(tuple, merkle.verified(built).collect()), key=repr)


@pytest.mark.parametrize("levels, size", [(12, 100_000), (2, 7), (1, 50)])
def test_manifest_and_witnesses(spark, rows, monkeypatch, levels, size):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RANGE", size)
    got = checked(spark, rows)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


@pytest.mark.parametrize("rows", [[], [(5, "alone", "en", "a")], [(5, "two", "en", "a"), (6, "two", "en", "a")], [(5, "one", "en", "a"), (6, "each", "de", "a")]])
def test_few_documents(spark, rows):
    assert checked(spark, rows) == (plain(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33])
def test_appends_lead_to_the_tree(n):
    nodes = [sha(str(i)) for i in range(n)]
    appender, levels = merkle.Appender(), tree(nodes)
    for node in nodes:
        appender.append(node)
    assert appender.close() == levels[-1][0]
    for at, node in enumerate(nodes):
        reached, proof = walk(levels, at, node)
        assert merkle.folded(node, appender.sides[at], appender.siblings[at]) == reached == levels[-1][0]
        assert "".join(appender.siblings[at]) == proof
