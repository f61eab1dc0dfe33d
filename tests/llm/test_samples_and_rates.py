"""Hosts with few documents, samples of a given size, bits by their accuracy, and urls with very long hosts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderflow.llm import language_id, license_scan, quality_classifier, quality_rules, url_filter
from orderflow.llm.queries import URL_RULES
from test_text_operators import SCHEMA, prose


def shrunk(spark, hosts):
    """Rates of hosts given as (documents, failed)."""
    rows = [(str(h), i < failed, False) for h, (n, failed) in enumerate(hosts) for i in range(n)]
    judged = spark.createDataFrame(rows, "host string, base_failed boolean, soft_failed boolean")
    return {int(r["host"]): r["rate"] for r in quality_rules.host_rates(judged, "host").collect()}


def test_hosts_of_one_document_are_not_judged_by_it(spark):
    rates = shrunk(spark, [(1, 1)] * 100 + [(1, 0)] * 900)
    assert max(rates.values()) < 0.11  # before: over one half


def test_hosts_that_differ_are_told_apart(spark):
    rates = shrunk(spark, [(200, 190)] * 3 + [(200, 4)] * 20 + [(2, 2)] * 5 + [(2, 0)] * 60)
    assert min(rates[h] for h in range(3)) > 0.9 > 0.55 > max(rates[h] for h in range(3, 23))
    alike = shrunk(spark, [(10, 1)] * 50)
    assert all(abs(r - 0.1) < 1e-9 for r in alike.values())


@pytest.fixture(scope="module")
def judged(spark):
    good = [(i, prose(40, i), "en", "a", 1) for i in range(60)]
    docs = good + [(100 + i, "".join(random.Random(i).choices("#$% xq zv", k=150)), "en", "a", 1) for i in range(60)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")


def test_a_sample_has_its_size_and_follows_the_weights(spark, judged):
    docs, labels = judged
    drawn, weights = Counter(), {}
    for seed in range(12):
        rows = quality_classifier.classify_quality(docs, labels, seed=seed, k=30, temperature=400.0).collect()
        assert sum(r.kept for r in rows) == 30
        drawn.update(r.doc_id for r in rows if r.kept)
        weights = {r.doc_id: r.log_weight / 400.0 for r in rows}
    assert 30 < len(drawn) and max(drawn.values()) < 12  # the seed matters
    # the draws expected of each document: k of all without replacement, in proportion to the weights
    rng = np.random.default_rng(0)
    ids, logs = list(weights), np.array(list(weights.values()))
    keys = logs + rng.gumbel(size=(4000, len(ids)))
    expected = dict(zip(ids, (np.argsort(-keys, axis=1)[:, :30][..., None] == np.arange(len(ids))).any(1).mean(0) * 12))
    good = sum(drawn[i] for i in ids if i < 60)
    assert abs(good - sum(expected[i] for i in ids if i < 60)) < 40 and sum(drawn.values()) == 360
    assert good > sum(drawn[i] for i in ids if i >= 60)


def test_more_than_there_are_keeps_all(spark, judged):
    docs, labels = judged
    rows = quality_classifier.classify_quality(docs.limit(5), labels, k=50).collect()
    assert len(rows) == 5 and all(r.kept for r in rows)


def test_bits_count_by_their_accuracy_and_mixed_texts_are_ambiguous(spark):
    alphabets = {"aa": "abcd", "bb": "efgh", "cc": "abcdxy"}
    rng = random.Random(4)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, text(alphabets[lang], 3), lang, "a", 1) for i, lang in enumerate(list(alphabets) * 40)]
    model = language_id.fit_languages(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    right = []
    for bit in range(model.words.shape[1]):
        side = [model.words[model.languages.index(lang), bit] * model.margins(t)[bit] > 0 for _, t, lang, _, _ in rows]
        right.append((sum(side) + 1) / (len(rows) + 2))
    assert np.allclose(model.accuracy, right) and len({round(a, 3) for a in right}) > 1
    assert not model.decode(text("efgh", 20))[2]
    between = [model.decode(text("abcdabcdx", rng.randint(1, 4))) for _ in range(300)]
    assert 0 < sum(ambiguous for _, _, ambiguous in between) < 300 and {lang for lang, _, _ in between} >= {"aa", "cc"}


def test_long_hosts_and_page_ids(spark, tmp_path):
    far, beyond = "a." * 8000 + "example.org", 2**53
    urls = [f"http://{far}/es/x", f"http://{far}/en/1", f"http://{'b.' * 9000}net/", "http://org/", None, "http://a.com/de/", "http://com/fr/"]
    rows = [(beyond + 2 * i + 1 if i != 4 else None, u) for i, u in enumerate(urls)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string").coalesce(1), URL_RULES).collect()}
    assert got == {
        beyond + 1: ("example.org/es/", "block"), beyond + 3: ("example.org/en/1", "block"), beyond + 5: (None, "allow"), beyond + 7: ("org/", "allow"),
        None: (None, "allow"), beyond + 11: ("com/de/", "block"), beyond + 13: ("com/fr/", "allow"),
    }
    table = url_filter.Digests(url_filter.digest_table(URL_RULES, str(tmp_path)))
    assert len(table.candidates(far, "/es/x")) <= 2 * len(table.lengths)


def test_a_notice_after_beginnings_of_it_is_found(spark):
    notice = "This work is licensed under the GNU General Public License version 3"
    texts = ["this work is " * 6 + notice, notice.replace("under", "today under") + " " + notice, "this work is " * 12, "this work is licensed " + "x " * 30 + "under the gnu"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: ("gpl,gpl-notice", 1.0), 1: ("gpl,gpl-notice", 1.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_frames_with_null_ids_stay_exact():
    from orderflow.llm.common import exact_ids

    batch = pd.DataFrame({"id": np.array([2**53 + 1, 0, 5], np.int64), "no_id": [False, True, False]})
    assert [None if x is pd.NA else int(x) for x in exact_ids(batch)] == [2**53 + 1, None, 5]
