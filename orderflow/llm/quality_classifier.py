"""A quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (rows labelled good and
not toxic) and one of the raw text (all rows), give every document a log importance
weight, the sum of the log ratios of its n-grams. Three bags are used: words and
signs, their neighbouring pairs, and pairs of their kinds (lower case, upper case,
capital, number, which sign; and whether a word repeats the one before). Gumbel noise,
drawn from a hash of the document and a seed, is added to the log weights, and the k
largest are kept, which samples k documents without replacement in proportion to
their weights.

A few toxic words in good prose, or few words altogether, do not add up to much. So a
document has its weight put far below the floor where one of its words is much more
common in documents labelled toxic than in the target text (the lower end of the log
ratio of the shares of documents that hold it), or where its mean log ratio is low.

k is a parameter, and so is the temperature that log weights are divided by before the noise
is added: with both, a sample of any size is drawn, in which documents stand in proportion to their tempered
weights. Without a k it is the number of documents whose weight is above the floor, those that the evidence of
their n-grams does not speak clearly against; log weights are then so far apart that the noise
hardly ever changes which ones these are, and the result is that of a filter. The k-th largest key is
found exactly by counting its digits, sixteen bits at a time, so no list of documents
is gathered anywhere.

Raw counts cover all documents; target counts come from at most TARGET_ROWS labelled
rows, chosen by a hash of the id; so do those of toxic text.

Results: a null text, or one without words or signs, has no weight and is not kept.
Rows that are equal in id and text get the same key and the same verdict; where they
tie for the last place, all are kept. With no target rows the models agree, so all documents with words are kept. Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import document_key, exact_ids, id_parts, staged

TOKEN = re.compile(r"\w+|[^\w\s]+")

#: Buckets of the three bags: tokens, pairs of tokens, pairs of kinds.
TOKEN_BUCKETS, PAIR_BUCKETS, KINDS = 1 << 14, 1 << 14, 16
KIND_BUCKETS = KINDS * KINDS * 2
BUCKETS = TOKEN_BUCKETS + PAIR_BUCKETS + KIND_BUCKETS

TARGET_ROWS = 20_000
SMOOTHING = 1.0

#: Added to every log ratio: how much less likely per n-gram a text may be before that speaks against it. Long texts would
#: else add up what little the two samples differ by.
SLACK = 0.05

#: A bucket seen this often in raw text has half a say; in few texts most buckets are seen too rarely to tell anything.
DOUBT = 50.0

#: Documents with a log weight above this are as many as are kept. The evidence of a bad text adds up with its length to far
#: below it, while a few odd tokens (an address, a number) in a short good one do not reach it.
FLOOR = -20.0

#: A text with a lower mean log ratio fails at any length; what a failing text is put below the floor by, more than any noise.
LEAST_MEAN, FAILED = -0.25, 60.0

#: Buckets of words told apart for toxic text, toxic documents that have to hold one, and the log ratio above which it tells.
TOXIC_BUCKETS, TOXIC_DOCUMENTS, MOST_TOXIC = 1 << 20, 5, 2.5
SEED = 17

#: Tokens a process remembers, and tokens worked on together.
REMEMBERED, BLOCK = 500_000, 400_000


class TokenCodes(dict):
    """Token to 60 bits of hash and 4 bits of kind; remembers what it has seen."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        lower = token.lower()
        if token[0].isalpha():
            kind = 1 if token == lower else 3 if len(token) > 1 and token == token.upper() else 2
        elif token[0].isdecimal() or token[0] == "_":
            kind = 4
        elif token[0].isalnum():
            kind = 5
        else:
            kind = 6 + xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) % 10
        code = self[token] = xxhash.xxh64_intdigest(lower.encode("utf-8", "surrogatepass")) >> 4 << 4 | kind
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def text_buckets(text: str, codes: TokenCodes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, block by block."""
    return (found for found, _ in text_parts(text, codes))


def text_parts(text: str, codes: TokenCodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of all n-grams of a text and the toxic model's of its tokens, block by block."""
    tokens, before = [], []

    def buckets(tokens: list[str], before: list[str]) -> tuple[np.ndarray, np.ndarray]:
        row = np.fromiter(map(codes.__getitem__, before + tokens), np.uint64, len(before) + len(tokens))
        own = row[len(before) :] >> np.uint64(4)
        hashes, kinds = row >> np.uint64(4), (row & np.uint64(15)).astype(np.int64)
        pairs = mixed(hashes[:-1] * np.uint64(3) + mixed(hashes[1:]))
        same = (hashes[:-1] == hashes[1:]).astype(np.int64)
        return np.concatenate([
            (own % np.uint64(TOKEN_BUCKETS)).astype(np.int64),
            (pairs % np.uint64(PAIR_BUCKETS)).astype(np.int64) + TOKEN_BUCKETS,
            (kinds[:-1] * KINDS + kinds[1:]) * 2 + same + TOKEN_BUCKETS + PAIR_BUCKETS,
        ]), (own % np.uint64(TOXIC_BUCKETS)).astype(np.int64)

    for match in TOKEN.finditer(text) if len(text) > 4 * BLOCK else ():
        tokens.append(match.group())
        if len(tokens) == BLOCK:
            yield buckets(tokens, before)
            tokens, before = [], tokens[-1:]
    if len(text) <= 4 * BLOCK:
        tokens = TOKEN.findall(text)
    if tokens:
        yield buckets(tokens, before)


def model_counts(rows: DataFrame) -> DataFrame:
    """bucket, count in raw text, count in target text. Rows have text and is_target."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, totals = TokenCodes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, target in zip(batch["text"], batch["is_target"]):
                for found in text_buckets(text or "", codes):
                    counts = np.bincount(found, minlength=BUCKETS)
                    totals[0] += counts
                    if target:
                        totals[1] += counts
        used = np.flatnonzero(totals[0])
        yield pd.DataFrame({"bucket": used, "raw": totals[0][used], "target": totals[1][used]})

    return rows.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket, each bag a distribution of its own, shrunk where counts are small."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most one row per bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.full(BUCKETS, SLACK)
    ratios = np.zeros(BUCKETS)
    for bag in (slice(0, TOKEN_BUCKETS), slice(TOKEN_BUCKETS, TOKEN_BUCKETS + PAIR_BUCKETS), slice(TOKEN_BUCKETS + PAIR_BUCKETS, BUCKETS)):
        t, r = target[bag] + SMOOTHING, raw[bag] + SMOOTHING
        ratios[bag] = (np.log(t / t.sum()) - np.log(r / r.sum())) * raw[bag] / (raw[bag] + DOUBT) + SLACK
    return ratios


def toxic_ratios(rows: DataFrame) -> np.ndarray | None:
    """The lower end of the log ratio of toxic to target documents that hold a word of each bucket. Rows have text, is_target and is_toxic."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, totals = TokenCodes(), np.zeros((2, TOXIC_BUCKETS + 1), np.int64)  # the last are the documents
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["is_toxic"]):
                held = [own for _, own in text_parts(text or "", codes)]
                totals[int(toxic), np.unique(np.concatenate([*held, [TOXIC_BUCKETS]]).astype(np.int64))] += 1
        used = np.flatnonzero(totals.sum(0))
        yield pd.DataFrame({"bucket": used, "target": totals[0][used], "toxic": totals[1][used]})

    labelled = rows.where("is_target or is_toxic").select("text", "is_toxic")
    counts = labelled.mapInPandas(count, "bucket long, target long, toxic long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("toxic").alias("toxic"))
    found = staged(counts.where((F.col("toxic") >= TOXIC_DOCUMENTS) | (F.col("bucket") == TOXIC_BUCKETS))).collect()  # at most one row per bucket
    target, toxic = np.zeros(TOXIC_BUCKETS + 1), np.zeros(TOXIC_BUCKETS + 1)
    for r in found:
        target[r["bucket"]], toxic[r["bucket"]] = r["target"], r["toxic"]
    if not toxic[-1] or not target[-1]:
        return None
    t, c = toxic[:-1] + 0.5, target[:-1] + 0.5
    ratios = np.log(t / (toxic[-1] + 1)) - np.log(c / (target[-1] + 1)) - np.sqrt(1 / t + 1 / c)
    return np.where(toxic[:-1] >= TOXIC_DOCUMENTS, ratios, 0.0).astype(np.float32)


def gumbel(doc_id: int | None, text: str, seed: int) -> float:
    """Standard Gumbel noise that only the document and the seed decide."""
    data = repr((doc_id, seed)).encode() + text.encode("utf-8", "surrogatepass")
    uniform = (xxhash.xxh3_64_intdigest(data) + 0.5) / 2.0**64
    return float(-np.log(-np.log(min(max(uniform, 1e-18), 1 - 1e-16))))


def weighted(docs: DataFrame, ratios: np.ndarray, toxic: np.ndarray | None, floor: float, seed: int, temperature: float = 1.0) -> DataFrame:
    """doc_id, text_hash, log_weight, key and a whole number in the order of the keys, for every document."""
    model = docs.sparkSession.sparkContext.broadcast((ratios, toxic))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, (ratio, toxic) = TokenCodes(), model.value
        for batch in batches:
            weights = np.full(len(batch), np.nan)
            keys = np.zeros(len(batch))
            for i, (doc_id, none, text) in enumerate(zip(batch["id"].to_list(), batch["no_id"].to_list(), batch["text"])):
                parts = [
                    (ratio[found].sum(), len(found), 0.0 if toxic is None else toxic[own].max()) for found, own in text_parts(text or "", codes)
                ]
                if parts:
                    sums, sizes, worst = zip(*parts)
                    weights[i] = sum(sums)
                    if max(worst) > MOST_TOXIC or weights[i] < LEAST_MEAN * sum(sizes):
                        weights[i] = min(weights[i], floor) - FAILED
                    keys[i] = weights[i] / temperature + gumbel(None if none else doc_id, text, seed)
            lost = np.isnan(weights)
            yield pd.DataFrame({
                "doc_id": exact_ids(batch), "text_hash": batch["text_hash"],
                "log_weight": pd.arrays.FloatingArray(weights, lost), "key": pd.arrays.FloatingArray(keys, lost),
                "key_order": pd.arrays.IntegerArray(ordered_bits(keys), lost),
            })

    rows = docs.select(document_key().alias("k"), "text").select(*id_parts(F.col("k.id")), "k.text_hash", "text")
    return rows.mapInPandas(weigh, "doc_id long, text_hash long, log_weight double, key double, key_order long")


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = values.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The exact k-th largest value (k from 1) of a column of longs: each step counts sixteen more bits."""
    prefix = None
    for shift in (48, 32, 16, 0):
        left = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        digit = F.shiftright(column, shift)
        counts = left.where(F.col(column).isNotNull()).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["digit"]):  # at most 2**16 rows
            if k <= r["n"]:
                prefix = r["digit"]
                break
            k -= r["n"]
    return prefix


def _some(ids: DataFrame, most: int) -> DataFrame:
    """At most about so many rows with a doc_id, chosen by its hash."""
    there, parts = ids.count(), 1 << 40
    return ids if there <= most else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * most / there))


def classify_quality(
    docs: DataFrame, labels: DataFrame, floor: float = FLOOR, seed: int = SEED, target_rows: int = TARGET_ROWS, k: int | None = None, temperature: float = 1.0
) -> DataFrame:
    """doc_id, text_hash, log_weight, key and kept of every row of docs.

    docs has doc_id and text, labels has doc_id, quality and toxic. k: the documents to keep, all if there are no
    more with a weight; None keeps as many as have a weight above the floor.
    """
    good = labels.where((F.col("quality") == 1) & ~(F.coalesce("toxic", F.lit(0)) == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    bad = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    target, toxic = (F.broadcast(_some(ids, target_rows).distinct().select(F.col("doc_id").alias(name))) for ids, name in ((good, "good_id"), (bad, "bad_id")))
    flagged = docs.select("doc_id", "text").join(target, F.col("doc_id") == F.col("good_id"), "left").join(toxic, F.col("doc_id") == F.col("bad_id"), "left").select(
        "text", (F.col("good_id").isNotNull() & F.col("bad_id").isNull()).alias("is_target"), F.col("bad_id").isNotNull().alias("is_toxic")
    )
    ratios = log_ratios(staged(model_counts(flagged.select("text", "is_target"))))
    weights = staged(weighted(docs.select("doc_id", "text"), ratios, toxic_ratios(flagged), floor, seed, temperature))
    there = weights.where(F.col("log_weight").isNotNull() if k is not None else F.col("log_weight") > floor).count()
    k = there if k is None else min(k, there)
    limit = kth_largest(weights, "key_order", k) if k else None
    kept = F.coalesce(F.col("key_order") >= limit, F.lit(False)) if k else F.lit(False)
    return weights.withColumn("kept", kept).drop("key_order")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    kept = classify_quality(docs, labels).where("kept").select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias("__of")).distinct()
    return docs.join(kept, document_key() == F.col("__of"), "left_semi")
