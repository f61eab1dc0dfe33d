"""A language of few rows in a large table."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderflow.llm import language_id
from test_text_operators import LANGUAGES, documents


def test_rare_language_is_learned(spark):
    common = [lang for lang in LANGUAGES if lang != "es"]
    rows = [(i, LANGUAGES[common[i % 3]] * 3, common[i % 3], "a") for i in range(1500)]
    rows += [(2000 + i, LANGUAGES["es"] * 3, "es", "a") for i in range(6)]
    got = language_id.identify_languages(documents(spark, rows), F.col("doc_id") == 2000, most_rows=40).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 2000} == {"es"}


def test_rows_per_language():
    assert language_id.rows_per_language([5, 1000, 10**7, 10**7], 20_000) == (20_000 - 1005) // 2
    assert language_id.rows_per_language([10**6] * 1000, 20_000) == language_id.LEAST_ROWS
