"""The pipeline against plain versions of its stages, on few documents."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
from orderflow.llm import packing, quality_classifier
from test_text_operators import ITEM, plain_components, plain_windows, prose


def plain_pipeline(rows, kept, items):
    docs = [r for r in rows if (r[0], r[1]) in kept]
    stays = plain_components([(r[0], r[1]) for r in docs])
    docs = [r for r, s in zip(docs, stays) if s[3]]
    split = [(r[1] or "").encode().split() for r in docs]
    left = []
    for r, words, (_, n_removed, _) in zip(docs, split, plain_windows([r[1] for r in docs])):
        text = r[1] if not n_removed else remaining(words, split)
        if text:
            left.append((r[0], text))
    wordlist = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    clean = [(i, t) for i, t in left if not any(f" {' '.join(wordlist(x))} " in f" {' '.join(wordlist(t))} " for x in items)]
    tokenizer, found = packing.ByteTokenizer(), []
    for doc_id, text in clean:
        ids = tokenizer(text) + (2).to_bytes(4, "little")
        total = len(ids) // 4
        start, piece, stop = 0, 0, total % 1024 or min(total, 1024)
        while start < total:
            found.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            start, stop, piece = stop, stop + 1024, piece + 1
    return found


def remaining(words, everything):
    counts = {}
    for other in everything:
        for i in range(len(other) - 34):
            window = tuple(other[i : i + 35])
            counts[window] = counts.get(window, 0) + 1
    gone = {j for i in range(len(words) - 34) if counts[tuple(words[i : i + 35])] > 1 for j in range(i, i + 35)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_pipeline(spark, tmp_path):
    shared, rows = prose(70, 900), []
    for i in range(120):
        text = prose(80 + i, 1000 + i)
        if i % 6 == 0:
            text = " ".join(f"{w}***" for w in text.upper().split())
        if i % 10 == 1:
            text = text + "\n" + shared
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    near = rows[5][1].split()
    near[40] = "other"
    for doc_id, text in ((200, rows[5][1]), (201, " ".join(near)), (202, prose(90, 77) + " " + ITEM), (203, None), (204, ""), (205, prose(3000, 78))):
        rows.append((doc_id, text, "en", "src0", len(text or "")))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    verdicts = {r["doc_id"]: r["kept"] for r in quality_classifier.classify_quality(docs, labels).collect()}
    assert all(verdicts[i] == bool(i % 6) for i in range(120)) and not verdicts[203] and not verdicts[204]
    kept = {(r[0], r[1]) for r in rows if verdicts[r[0]]}
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain_pipeline(rows, kept, [ITEM])
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert not {200, 201, 202, 203, 204} & {r["doc_id"] for r in got} and 205 in {r["doc_id"] for r in got}


def test_stages_return_documents(spark, tmp_path):
    rows = [(i, prose(60, i), "en", "a", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == corpus_pipeline.COLUMNS
