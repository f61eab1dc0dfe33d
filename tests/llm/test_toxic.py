"""Toxic words in good prose, and short bad texts."""

from __future__ import annotations

from orderflow.llm import quality_classifier
from test_text_operators import documents, prose


def test_toxic_documents_and_short_bad_ones_fail(spark):
    texts, labels = {}, []
    for i in range(300):
        words = prose(80, 3000 + i).split()
        toxic, bad = i % 6 == 0, i % 6 == 1
        if toxic:
            words[10 + i % 50] = ("moron", "scum")[i // 6 % 2]
        texts[i] = " ".join(f"{w}***" for w in words[:60]).upper() if bad else " ".join(words)
        if i < 200:
            labels.append((i, 0 if bad else 1, int(toxic)))
    texts[400], texts[401] = "RIVER3***", prose(4, 1)
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    got = quality_classifier.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {i for i in range(300) if i % 6 > 1} | {401}
