"""The operators against plain versions, on few rows with nulls, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderflow.llm import decontamination, language_id, license_scan, minhash, packing, quality_classifier, quality_rules, sharding, substring_dedup, url_filter
from orderflow.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light house paper green walking quickly never under while music garden seven orange between".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in ("key", "rank", "words", "id", "shard", "kept", "text_hash", "of", "n", "component")})


@pytest.fixture(scope="module")
def rows():
    shared, other = prose(60, 1), prose(36, 2)
    base = prose(300, 3)
    near = base.split()
    near[150] = "changed"
    found = [
        (1, base, "en", "a"), (2, " ".join(near), "en", "a"), (3, base, "en", "b"),
        (4, prose(80, 4) + " " + shared + "\n" + prose(20, 5), "de", "a"), (5, shared + " " + prose(70, 6), "de", None),
        (6, prose(10, 7) + "\t" + other + " " + other + " " + prose(5, 8), "fr", "c"),
        (7, None, None, "a"), (8, "", "en", "a"), (9, "  \n \n", "en", "a"), (10, "One", "en", "a"), (11, "one", "en", "a"),
        (12, "MIT License and the Apache License; GNU General Public License mit-license", "en", "b"),
        (12, "MIT License and the Apache License; GNU General Public License mit-license", "en", "b"),
        (None, prose(40, 9), "en", "b"), (13, "été ÉTÉ \u212aey \u00a0 x " * 30, "fr", "b"),
        (14, "ha " * 4000, "en", "b"), (15, "line one\nline one\n\nline two\nline one", "en", "b"),
        (16, "x" * 20000 + " <|endoftext|>  tail", "en", "b"), (17, prose(2500, 10), "es", "a"),
    ]
    return found


def plain_windows(texts):
    split = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    result = []
    for words in split:
        gone = {j for i in range(len(words) - 34) if counts[tuple(words[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        result.append((len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return result


@pytest.mark.parametrize("most_segments", [1000, 0])
def test_substring_dedup_is_exact(spark, rows, monkeypatch, most_segments):
    monkeypatch.setattr(substring_dedup, "MOST_SEGMENTS", most_segments)  # 0: every anchor counts as crowded
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    got = substring_dedup.deduplicate_substrings(documents(spark, rows)).collect()
    want = [(r[0], *p) for r, p in zip(rows, plain_windows([r[1] for r in rows]))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    rows = [(1, prose(500, 20) + " " + prose(90, 21), "en", "a"), (2, prose(90, 21) + " " + prose(333, 22), "en", "a")]
    got = substring_dedup.deduplicate_substrings(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(r[0], *p) for r, p in zip(rows, plain_windows([r[1] for r in rows]))]


def test_remove_repeats_keeps_other_columns(spark, rows):
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert 3 not in got and 7 not in got and 8 not in got
    assert got[10]["text"] == "One" and got[10]["source"] == "a" and got[10]["key"] == "extra"
    assert got[4]["n_chars"] == len(got[4]["text"]) and len(got[4]["text"].split()) == 100


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plain_components(rows, threshold=85):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None
            both = sets[i] and sets[j] and None not in (rows[i][0], rows[j][0])
            if same_id or both and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[root(i)] = min(low.get(root(i), doc_id), doc_id)
    return [(d, len(s), None if d is None else low[root(i)], d is None or d == low[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates_match_all_pairs(spark, rows):
    many = list(rows)
    rng = random.Random(5)
    for group in range(12):  # chains of copies with more and more changes: links between some of them only
        words = prose(rng.randint(4, 120), 100 + group).split()
        for n in range(8):
            many.append((1000 + 10 * group + n, " ".join(words), "en", "a"))
            words = list(words)
            words[rng.randrange(len(words))] = f"new{n}"
    got = minhash.near_duplicates(documents(spark, many)).collect()
    want = plain_components([(r[0], r[1]) for r in many])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_of_each_group_stays(spark, rows):
    kept = sorted(r["doc_id"] for r in minhash.keep_first_of_group(documents(spark, rows)).collect() if r["doc_id"] is not None)
    assert kept == [1, 4, 5, 6, 7, 8, 9, 10, 12, 12, 13, 14, 15, 16, 17]


def test_signature_agrees_with_the_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    one, other = np.unique(values[:2000]), np.unique(values[1000:])
    agree = []
    for shift in range(40):
        moved = [s * np.uint64(2 * shift + 1) for s in (one, other)]
        a, b = minhash.signatures(moved)
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 1 / 3) < 0.05


def plain_licenses(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, rows):
    notice = "x y Permission is hereby granted, free of charge, to any big person obtaining a copy of this software z"
    many = [*rows, (50, notice, "en", "a"), (51, "Licensed under the Apache License, Version 2.0. " * 2, "en", "a"), (52, "MIT " * 50 + "license mit mit license", "en", "a"),
            (53, "this wor\u212a is licensed under the GNU general public licens\u00e9 mit LICENSE", "en", "a")]
    got = license_scan.scan_licenses(documents(spark, many)).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr((r[0], *plain_licenses(r[1]))) for r in many)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[50][0] == "mit-text" and 0.75 <= labels[50][1] <= 1
    assert labels[51] == ("apache,apache-notice", 1.0)
    assert labels[10] == ("", 0.0)


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_rules(spark, rows):
    got = quality_rules.judge_quality(documents(spark, rows)).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == sorted(repr((r[0], *plain_rules(r[1]))) for r in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got if not r["host_failed"])


def test_bad_host_rejects_by_soft_rules_only(spark):
    odd = " ".join(f"w{i} ###" for i in range(60))
    rows = [(i, odd + f" {i}", "en", "bad") for i in range(40)] + [(100 + i, prose(80, i), "en", "good") for i in range(40)]
    rows += [(200, prose(80, 999), "en", "bad"), (201, odd, "en", "good")]
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(documents(spark, rows)).collect()}
    assert not got[0]["kept"] and got[0]["host_failed"]
    assert got[200]["kept"] and got[201]["kept"] and got[100]["kept"]


def test_shards(spark, rows):
    many = [*rows, *[(300 + i, prose(3 + i % 50, 300 + i), "en", "a") for i in range(300)]]
    got = sharding.shard_documents(documents(spark, many), 4).collect()
    assert len(got) == len(many)
    text = {(r[0], zlib.crc32((r[1] or "").encode())): r[1] or "" for r in many}
    shards = {}
    for r in got:
        t = text[(r["doc_id"], r["text_crc32"])]
        assert r["size"] == len(t.encode()) + 1
        assert shards.setdefault(t, r["shard"]) == r["shard"]
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_best_fit_runs_equal_one_by_one_packing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 80))]
        runs, opened = sharding.best_fit_runs(Counter(sizes).items(), 40)
        bins = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, b in enumerate(bins) if b >= s]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= s
            else:
                bins.append(40 - s)
        assert opened == len(bins)
        filled = Counter()
        for size, first, last, shard in runs:
            filled[shard] += size * (last - first)
        assert sorted(filled.values()) == sorted(40 - b for b in bins)


def test_even_shards():
    rng = random.Random(3)
    sizes = [rng.randint(1, 500) for _ in range(2000)] + [100000]
    runs = sharding.even_runs(Counter(sizes).items(), 8)
    filled = Counter()
    for size, first, last, shard in runs:
        filled[shard] += size * (last - first)
    assert sum(filled.values()) == sum(sizes)
    alone = [f for f in filled.values() if f >= 100000]
    rest = [f for f in filled.values() if f < 100000]
    assert len(filled) == 8 and len(alone) == 1 and max(rest) - min(rest) <= 50


def test_packing(spark, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        start, piece, stop = 0, 0, len(ids) % 1024 or min(len(ids), 1024)
        while start < len(ids):
            want.append((doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, piece = stop, stop + 1024, piece + 1
    got = packing.pack_documents(documents(spark, rows)).collect()
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, want))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(by) == -(-sum(r["length"] for r in got) // 1024)


def exact_number(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j, b in enumerate(bins):
            if b + sizes[i] <= capacity and b not in bins[:j]:
                place(i + 1, [*bins[:j], b + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_bin_completion_is_optimal_on_few_pieces():
    rng = random.Random(4)
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
        patterns = packing.bin_completion(Counter(sizes), 30)
        used = Counter()
        for filling, n in patterns:
            assert sum(filling) <= 30
            for s in filling:
                used[s] += n
        assert used == Counter(sizes)
        assert packing.sequences(patterns) == exact_number(sizes, 30)


def test_bin_completion_beats_or_equals_best_fit_on_many():
    rng = random.Random(6)
    for _ in range(20):
        counts = Counter(rng.randint(1, 1024) for _ in range(3000))
        patterns = packing.bin_completion(counts, 1024)
        used = Counter()
        for filling, n in patterns:
            assert sum(filling) <= 1024
            for s in filling:
                used[s] += n
        assert used == counts and packing.sequences(patterns) <= packing.sequences(packing.best_fit(counts, 1024))


LANGUAGES = {"en": "the house and river with ", "de": "das haus und der fluss mit ", "fr": "la maison et le fleuve avec ", "es": "la casa y el rio con "}


def test_languages(spark):
    rng = random.Random(7)
    rows = []
    for i in range(240):
        lang = list(LANGUAGES)[i % 4]
        words = LANGUAGES[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(30)), lang, "a"))
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "123 456 !", "en", "a"), (None, "the house and", "xx", "a"), (503, "das haus und", None, "a"), (503, "das haus und", None, "a")]
    docs = documents(spark, rows)
    got = language_id.identify_languages(docs, language_id.in_held_out_fold()).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in held if r["doc_id"] < 240]
    assert sum(right) / len(right) > 0.95
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (500, 501, 502))
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] != "xx" for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 503] == ["de", "de"]
    nothing = language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string")), language_id.in_held_out_fold())
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_codewords_differ():
    for n in (2, 4, 7, 30):
        words = language_id.codewords(n)
        for i in range(n):
            for j in range(i):
                assert (words[i] != words[j]).sum() >= max(1, words.shape[1] // 4)


def test_urls(spark):
    urls = [
        None, "no scheme", "http://", "http://Example.ORG/es/1?q#f", "https://a.example.org/en/12", "http://x.org", "http://x.org/", "http://org/y",
        "http://notexample.org/es/", "http://xcom/fr/", "http://a.com/fr/x", "http://a.com/de/", "http://a.com/de", "http://com?/fr/", "x://y://z.org/a",
        "http://a.net/fr/", "http://é.org/ü", "http://example.org/es/",
    ]
    rows = [(i, u, "html") for i, u in enumerate(urls)] + [(None, "http://a.com/de/", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("extra")).withColumn("rule", F.lit(1))
    got = url_filter.filter_urls(pages, URL_RULES).collect()

    def plain(url):
        found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1], found[2]) if found else ("", "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *plain(r[1]))) for r in rows)


def test_colliding_digests_are_told_apart_by_their_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda text: len(text) % 3)
    table = url_filter.Digests(url_filter.digest_table(URL_RULES, str(tmp_path)))
    found = table.judge(["a.org", "example.org", "b.com", "nowhere.net"], ["/x", "/es/1", "/de/x", "/"])
    assert [table.text(e) if e >= 0 else None for e in found] == ["org/", "example.org/es/", "com/de/", None]


ITEM = "A lantern swings above the harbour while seven sailors count silver coins and argue about the northern passage to winter islands"


def test_decontamination(spark, rows):
    changed = ITEM.replace("lantern", "lamp").replace("count", "slowly count").replace("argue about", "argue")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "..."), (5, prose(30, 77))], "item_id long, text string").withColumn("doc_id", F.lit(1))
    many = [*rows, (70, prose(200, 70) + " " + ITEM + ". " + prose(90, 71), "en", "a"), (71, prose(33, 72) + "\n" + changed, "en", "a"), (72, ITEM.upper(), "en", "a"),
            (73, prose(100, 73) + " the harbour while seven sailors", "en", "a")]
    docs = documents(spark, many)
    got = decontamination.find_contaminated(docs, items).collect()
    assert len(got) == len(many)
    assert {r["doc_id"]: r["item_ids"] for r in got if r["contaminated"]} == {70: [1, 2], 71: [1, 2], 72: [1, 2]}
    left = decontamination.drop_contaminated(docs, items)
    assert left.count() == len(many) - 3 and left.columns == docs.columns
    assert decontamination.find_contaminated(docs, items.limit(0)).where("contaminated").count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 2)
    items = spark.createDataFrame([(i, prose(25, 900 + i)) for i in range(7)], "item_id long, text string")
    docs = documents(spark, [(i, prose(60, 950 + i) + " " + prose(25, 900 + i) + " " + prose(50, 970 + i), "en", "a") for i in range(7)])
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.find_contaminated(docs, items).collect()}
    assert got == {i: [i] for i in range(7)}


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [rng.randint(1, 5) for _ in range(rng.randint(0, 14))], [rng.randint(1, 5) for _ in range(rng.randint(1, 14))]
        places = {}
        for i, x in enumerate(b):
            places[x] = places.get(x, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_length(a, places, len(b)).bit_count() == table[-1][-1]


def test_quality_classifier(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        text = " ".join(f"{w}***" for w in prose(60, 2000 + i).upper().split()) if bad else prose(60, 2000 + i)
        rows.append((i, text, "en", "a"))
        if i < 200:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (None, prose(50, 1), "en", "a"), (402, prose(50, 2), "en", "a"), (402, prose(50, 2), "en", "a")]
    docs, labelled = documents(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (402, None, None)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify_quality(docs, labelled).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {i for i in range(300) if i % 5} | {None, 402}
    assert all(r["log_weight"] is None and r["key"] is None for r in got if r["doc_id"] in (400, 401))
    again = quality_classifier.classify_quality(docs, labelled)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    good = quality_classifier.keep_good(docs, labelled)
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in got)
    assert quality_classifier.classify_quality(docs, labelled.limit(0)).where("kept").count() == 303


def test_kth_largest(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(3).normal(0, 100, 500)] + [0.0, 5.5, 5.5, -1e300, 1e300]
    order = quality_classifier.ordered_bits(np.array(values))
    rows = spark.createDataFrame([(int(x),) for x in order] + [(None,)], "v long")
    for k in (1, 2, 250, len(values)):
        assert quality_classifier.kth_largest(rows, "v", k) == sorted(order.tolist(), reverse=True)[k - 1]


def test_gumbel_keys_sample_in_proportion_to_weights():
    import numpy as np

    wins = Counter(max((np.log(w) + quality_classifier.gumbel(i, "", seed), i) for i, w in enumerate((1.0, 2.0, 7.0)))[1] for seed in range(4000))
    assert [round(wins[i] / 4000, 1) for i in range(3)] == [0.1, 0.2, 0.7]


@pytest.mark.parametrize("call", [
    lambda d, s: substring_dedup.deduplicate_substrings(d), lambda d, s: substring_dedup.remove_repeats(d), lambda d, s: minhash.near_duplicates(d),
    lambda d, s: license_scan.scan_licenses(d), lambda d, s: quality_rules.judge_quality(d), lambda d, s: sharding.shard_documents(d, 16),
    lambda d, s: packing.pack_documents(d), lambda d, s: language_id.identify_languages(d, language_id.in_held_out_fold()),
    lambda d, s: quality_classifier.classify_quality(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    lambda d, s: decontamination.find_contaminated(d, s.createDataFrame([(1, ITEM)], "item_id long, text string")),
    lambda d, s: url_filter.filter_urls(s.createDataFrame([], "page_id long, url string"), URL_RULES),
])
def test_empty_tables_give_empty_results(spark, call):
    assert call(documents(spark, []), spark).count() == 0
