"""Decontamination with many, long and frequent items."""

from __future__ import annotations

import random

import numpy as np

from orderflow.llm import decontamination
from test_text_operators import ITEM, documents, prose


def invented(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(30000 ** rng.random())}" for _ in range(n))


def planted(spark, items, before=60, after=50):
    """Every item word for word in a document of its own, and 60 documents without any."""
    texts = [f"{prose(before, 7000 + i)} {t} {prose(after, 8000 + i)}" for i, t in items] + [prose(200, 9000 + i) for i in range(60)]
    return documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])


def test_more_items_than_the_space_holds(spark):
    """As many items as a comparison of all documents with all items finds, and those planted among them."""
    items = [(i, invented(20 + i % 30, 100 + i)) for i in range(1000)]
    docs = planted(spark, items)
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] if i < 1000 else [] for i in range(1060)}


def test_search_agrees_with_comparing_all(spark):
    rng = random.Random(5)
    items = [(i, invented(rng.randint(1, 60), 300 + i)) for i in range(60)] + [(60, "the the of the the of the the of the the and"), (61, "x " * 30 + "y")]
    texts = []
    for i in range(120):
        words = items[i % 62][1].split()
        for _ in range(rng.randint(0, len(words) // 2)):
            words[rng.randrange(len(words))] = invented(1, rng.randrange(10**6))
        texts.append(f"{invented(rng.randint(0, 150), 600 + i)} {' '.join(words)} {invented(rng.randint(0, 150), 900 + i)}")
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    hashes = decontamination.ByteRuns()
    coded = [(i, decontamination.word_codes(t, hashes)) for i, t in items]
    want = {i: sorted(n for n, c in coded if decontamination.best_share(decontamination.word_codes(t, hashes), c)) for i, t in enumerate(texts)}
    assert got == want and 20 < sum(map(len, want.values())) and any(not w for w in want.values())


def test_item_in_a_third_of_all_rows(spark):
    """An item that stands in many rows, alone or among few documents, and one of words that most documents have."""
    frequent = "of and the river stone light house the and of paper"
    items = spark.createDataFrame([(1, ITEM), (2, frequent)], "item_id long, text string")
    for rows, held in ((90, 30), (10, 4)):
        texts = [f"{prose(50, i)} {ITEM if i < held else prose(20, 500 + i)} {'stone of paper and river light the house ' * 2}{frequent if i == held else ''}" for i in range(rows)]
        docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
        got = {r["doc_id"]: r for r in decontamination.find_contaminated(docs, items).collect()}
        assert {i for i, r in got.items() if 1 in r["item_ids"]} == set(range(held)) and 2 in got[held]["item_ids"]
        assert min(got[i]["cosine"] for i in range(held)) > 0
        assert decontamination.drop_contaminated(docs, items.where("item_id = 1")).count() == rows - held


def test_long_items(spark):
    items = [(i, invented(length, 40 + i)) for i, length in enumerate([800] * 12 + [2000] * 6)]
    changed = items[0][1].split()
    changed[::8] = ["other"] * 100
    docs = planted(spark, [*items, (18, " ".join(changed)), (19, " ".join(items[1][1].split()[:400]))])
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] if i < 18 else [0] if i == 18 else [] for i in range(80)}


def test_blocks_of_items_return_every_row(spark, monkeypatch):
    text = prose(40, 1) + " " + ITEM
    docs = documents(spark, [(1, text, "en", "a"), (1, text, "en", "b"), (None, text, "en", "a"), (None, text, "en", "a"), (2, prose(40, 2), "en", "a"), (None, None, "en", "a")])
    items = spark.createDataFrame([(1, ITEM), (2, prose(25, 77)), (3, prose(25, 78))], "item_id long, text string")
    whole = sorted(map(repr, decontamination.find_contaminated(docs, items).select("doc_id", "text_hash", "item_ids", "share", "contaminated").collect()))
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 1)
    parts = decontamination.find_contaminated(docs, items).select("doc_id", "text_hash", "item_ids", "share", "contaminated")
    assert len(whole) == 6 and sorted(map(repr, parts.collect())) == whole


def test_space_is_fitted_on_every_passage(spark):
    """The second round adds up the products of all passages of all documents, however they are cut into lots."""
    rng = np.random.default_rng(3)
    lengths = [0, 1, 31, 32, 33, 64, 65, 500, 9000]
    texts = [" ".join(f"w{int(500 ** x)}" for x in rng.random(n)) for n in lengths] + [None]
    hashes, idf = decontamination.ByteRuns(), rng.random(decontamination.BUCKETS) + 0.1
    table, squares = rng.standard_normal((decontamination.BUCKETS, 4)) * idf[:, None], idf**2
    want = np.zeros((decontamination.BUCKETS, 4))
    for text in texts:
        found = decontamination.buckets(decontamination.word_codes(text, hashes))
        for at in range(0, max(len(found) - 32, min(len(found), 1)), 32):
            passage = found[at : at + 64]
            seen = table[passage].sum(0) / squares[passage].sum()
            np.add.at(want, passage, seen)
    got = np.zeros_like(want)
    for _, lot in decontamination.parts(decontamination.word_codes(t, hashes) for t in texts):
        decontamination.add_products(got, lot, table, squares)
    assert np.allclose(got, want)


def test_no_document_is_left_out_of_the_fit(spark):
    """Beyond 2,000 documents, too, the space changes with the words of any one of them."""
    docs = [(i, f"a{i % 7} b{i % 5}", "en", "a") for i in range(2400)]
    idf = np.ones(decontamination.BUCKETS)
    items = spark.createDataFrame([("a1 b1", 1.0)], "text string, weight double")
    hashes = decontamination.ByteRuns()
    for i in (0, 1234, 2399):
        rare = " ".join(f"only{i}x{n}" for n in range(40))
        space = decontamination.latent_space(items, documents(spark, docs[:i] + [(i, rare, "en", "a")] + docs[i + 1 :]), idf)
        at = np.unique(decontamination.buckets(decontamination.word_codes(rare, hashes)))
        assert np.linalg.norm(space[at].sum(0)) > 0.9 * np.sqrt(len(at))


def test_the_space_retrieves_what_is_dropped(spark, monkeypatch):
    """Dropping rows searches the latent space: it names the texts to compare where no rare word does, too."""
    items = [(i, prose(40, 600 + i)) for i in range(8)]
    docs = planted(spark, items)
    monkeypatch.setattr(decontamination, "telling_words", lambda *_: np.zeros(0, np.int64))
    left = decontamination.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(8, 68))


def test_words_are_hashed_once(spark, monkeypatch):
    """Frequencies, fit and search read the numbers of the words, which are written once; none of them reads a text."""
    seen = []
    for name in ("document_frequencies", "latent_space", "search"):
        of_docs = 1 if name == "latent_space" else 0

        def noted(*args, of_docs=of_docs, run=getattr(decontamination, name), **named):
            seen.append(args[of_docs].columns)
            return run(*args, **named)

        monkeypatch.setattr(decontamination, name, noted)
    items = [(i, invented(30, i)) for i in range(4)]
    found = decontamination.find_contaminated(planted(spark, items), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in found.collect() if r["contaminated"]} == {i: [i] for i in range(4)}
    assert seen == [["doc_id", "text_hash", "codes"]] * 3


def test_numbers_keep_bucket_and_place():
    hashes = decontamination.ByteRuns()
    codes = decontamination.word_codes(" ".join(f"w{i % 50}" for i in range(200)), hashes)
    vocabulary = np.unique(codes[:20])
    numbers = decontamination.numbered(codes, vocabulary)
    assert (decontamination.buckets(numbers) == decontamination.buckets(codes)).all()
    at, place = decontamination.places_of(codes, vocabulary)
    assert (numbers[at] // decontamination.BUCKETS - 1 == place).all()
    assert (np.delete(numbers, at) < decontamination.BUCKETS).all()
