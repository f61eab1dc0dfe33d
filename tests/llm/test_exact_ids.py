"""Ids beyond 2 ** 53 beside rows without an id, which doubles would round."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderflow.llm import decontamination, exact_dedup, language_id, minhash, packing, quality_classifier, substring_dedup
from test_text_operators import SCHEMA, prose

BEYOND = 2**53
IDS = [BEYOND + 1, None, BEYOND + 3, BEYOND + 5, 7]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(60, n), "en" if n % 2 else "de", "a", 1) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").distinct().collect()), key=repr)


def test_ids_come_back_as_they_were(spark, docs):
    want = sorted(IDS, key=repr)
    labels = spark.createDataFrame([(BEYOND + 1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(BEYOND + 9, prose(60, 2))], "item_id long, text string")
    assert ids(substring_dedup.deduplicate_substrings(docs)) == want
    assert ids(packing.pack_documents(docs)) == want
    assert ids(language_id.identify_languages(docs, F.lit(False))) == want
    assert ids(quality_classifier.classify_quality(docs, labels)) == want
    near = minhash.near_duplicates(docs)
    assert ids(near) == want and {r.component_id for r in near.collect() if r.doc_id} == set(IDS) - {None}
    found = decontamination.find_contaminated(docs, items, cosines=False)
    assert ids(found) == want and {r.doc_id: r.item_ids for r in found.collect() if r.contaminated} == {BEYOND + 3: [BEYOND + 9]}
    assert ids(decontamination.drop_contaminated(docs, items)) == sorted(set(IDS) - {BEYOND + 3}, key=repr)


@pytest.mark.parametrize("times, words", [(2, 2**26), (40, 2**26), (40, 1)])
def test_repeated_rows_are_one_place(spark, monkeypatch, times, words):
    """The work on one row that is there k times does not grow with the square of k, nor do its reports."""
    monkeypatch.setattr(exact_dedup, "MOST_WORDS", words)  # 1: more places than a filter is made for
    row = prose(200, 50)
    docs = spark.createDataFrame([(1, row, "en", "a", 1)] * times + [(None, row, "en", "a", 1), (2, prose(90, 51), "en", "a", 1)], SCHEMA)
    candidates = substring_dedup.candidate_places(docs)
    assert candidates.where("id = 1").agg(F.min("n"), F.max("n")).first() == (times, times)
    assert words > 1 or not candidates.where("id = 2").count()
    found = {r.of.id: sorted(p.start for p in r.places) for r in substring_dedup.repeated_places(docs).collect()}
    assert set(found) == {1, None} and found[1] == found[None] and len(found[1]) < 20
    got = substring_dedup.deduplicate_substrings(docs).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 200)] * times + [(None, 200), (2, 0)], key=repr)


def test_a_passage_in_many_documents_is_a_few_rows_for_each(spark):
    passage = prose(150, 60)
    docs = spark.createDataFrame([(i, f"{prose(30, 100 + i)} {passage} {prose(30, 200 + i)}", "en", "a", 1) for i in range(12)], SCHEMA)
    candidates = substring_dedup.candidate_places(docs)
    units = substring_dedup.unit_places(candidates)
    assert units.groupBy("id").count().agg(F.max("count")).first()[0] <= 4 < candidates.groupBy("id").count().agg(F.min("count")).first()[0]
    got = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate_substrings(docs).collect()}
    assert set(got.values()) == {150}
