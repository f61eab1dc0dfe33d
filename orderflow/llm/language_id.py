"""Language identification by error-correcting output codes.

Every language gets a codeword; every bit of the codewords is a binary classifier on
n-grams of bytes (two and three of the lower-cased text, hashed), fitted from the
n-gram counts of the languages on either side of the bit. A text gives each bit a
margin; loss-weighted decoding adds the logistic losses of the margins against each
codeword, every bit weighted by its accuracy on the sample, and the codeword of least
loss wins. The score is the share of the winner when the losses are turned into
probabilities; a small lead over the second marks the text ambiguous.

Up to seven languages use the exhaustive code (each split of the languages once),
more use seeded random words that differ in at least a quarter of the bits.

Counts come from at most TRAINING_ROWS rows that may be learned from, chosen by a hash
of the id and the text; each language has an equal bound, and what is rarer is learned whole. Their n-grams are counted in parallel, and what reaches the driver is one
count per language and bucket.

Results: a null text, an empty one or one without a letter gets "und", score 0, and
is not called ambiguous. Without any row to learn from, all get "und". Rows without an
id are judged, but not learned from. Repeated rows are judged one by one. Extra columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import exact_ids, id_parts, staged

BUCKETS = 1 << 15
TRAINING_ROWS = 20_000

#: Rows that every language may have, if it has them, however many languages there are.
LEAST_ROWS = 100
SMOOTHING = 0.5

#: Bytes of a text that are looked at together.
BLOCK = 1 << 20

#: Pieces of evidence that one margin counts for at most; beyond, a longer text makes no surer.
MOST_EVIDENCE = 60.0

AMBIGUOUS_LEAD = 0.2
UNKNOWN = "und"


def ngram_buckets(block: np.ndarray) -> np.ndarray:
    """Hashed byte pairs (even buckets) and triples (odd buckets)."""
    b = block.astype(np.uint32)
    pairs = (b[:-1] << 8 | b[1:]) * np.uint32(2654435761)
    triples = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2246822519)
    shift = np.uint32(33 - int(math.log2(BUCKETS)))
    return np.concatenate([(pairs >> shift) << 1, (triples >> shift) << 1 | 1])


def text_blocks(text: str) -> Iterator[np.ndarray]:
    """The lower-cased text as bytes, between two spaces; blocks overlap by two bytes."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)
    for start in range(0, max(len(data) - 2, 1), BLOCK):
        yield data[start : start + BLOCK + 2]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 per language."""
    if languages <= 7:
        splits = np.arange(1, 1 << max(languages - 1, 0))  # the last language is always on the same side
        return np.where(splits[None, :] >> np.arange(languages)[:, None] & 1, 1.0, -1.0)
    bits = math.ceil(10 * math.log2(languages))
    while True:
        for seed in range(1000):
            words = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1.0, 1.0)
            apart = (bits - words @ words.T) / 2 + bits * np.eye(languages)
            if apart.min() >= bits / 4 and (np.abs(words.sum(0)) < languages).all():
                return words
        bits += bits // 4  # the more bits, the nearer words are to differing in half of them


def counted_ngrams(sample: DataFrame) -> DataFrame:
    """lang, bucket and count over all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for block in text_blocks(text):
                    total += np.bincount(ngram_buckets(block), minlength=BUCKETS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    return sample.select("lang", "text").mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class CodeModel:
    """Codewords, bit weights and the classifiers of the bits."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """The classifiers of counts; every bit counts alike until the sample has been judged (see weigh_bits)."""
        self.languages = languages
        self.words = codewords(len(languages))
        shares = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if len(languages) else counts
        weights = []
        for bit in self.words.T:
            weights.append(np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0)))
        self.weights = np.array(weights, np.float32).T.reshape(BUCKETS, -1).copy()
        self.accuracy = np.ones(self.words.shape[1])

    def weigh_bits(self, right: np.ndarray, rows: int) -> None:
        """Every bit by its accuracy: the share of the sample's rows that it puts on their language's side."""
        self.accuracy = (right + 1) / (rows + 2)

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for block in text_blocks(text):
            buckets = ngram_buckets(block)
            total += self.weights[buckets].sum(0, dtype=np.float64)
            n += len(buckets)
        return total / max(n, 1) * min(n, MOST_EVIDENCE)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        losses = (np.logaddexp(0, -self.words * self.margins(text)) * self.accuracy).sum(1)
        chances = np.exp(losses.min() - losses)
        chances /= chances.sum()
        best = int(np.argmin(losses))
        return self.languages[best], float(chances[best]), bool(chances[best] - np.partition(chances, -2)[-2] < AMBIGUOUS_LEAD)


def bits_right(sample: DataFrame, model: CodeModel) -> tuple[np.ndarray, int]:
    """For each bit the rows of the sample that it puts on the right side, and the number of rows."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        place = {lang: i for i, lang in enumerate(own.languages)}
        right, rows = np.zeros(own.words.shape[1], np.int64), 0
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                if has_letter(text):
                    right += own.words[place[lang]] * own.margins(text) > 0
                    rows += 1
        yield pd.DataFrame({"bit": np.arange(-1, len(right)), "n": np.append(rows, right)})

    counts = sample.select("lang", "text").mapInPandas(judge, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect()
    found = {r["bit"]: r["n"] for r in counts}
    return np.array([found.get(i, 0) for i in range(model.words.shape[1])]), found.get(-1, 0)


def rows_per_language(sizes: list[int], most_rows: int) -> int:
    """The rows that a language has at most, so that all have most_rows together; smaller languages leave theirs to larger ones."""
    left = most_rows
    for n, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - n)
        if size > share:
            return max(share, LEAST_ROWS)
        left -= size
    return max(sizes)


def fit_languages(rows: DataFrame, may_learn: Column, most_rows: int = TRAINING_ROWS) -> CodeModel:
    """Fit on at most about most_rows rows of the columns doc_id, text and lang, or LEAST_ROWS of each language where that is more."""
    eligible = rows.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in eligible.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(sizes.values()) > most_rows:
        most, parts = rows_per_language(list(sizes.values()), most_rows), 1 << 40
        limits = eligible.sparkSession.createDataFrame([(lang, min(parts, int(parts * most / n))) for lang, n in sizes.items()], "of string, below long")
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
        eligible = eligible.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(place < F.col("below")).drop("of", "below")
    eligible = staged(eligible.select("lang", "text"))  # the sample, read for the counts and then for the accuracy of the bits
    counts = staged(counted_ngrams(eligible))
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    table = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    for r in counts.toLocalIterator():  # one row per language and bucket
        table[place[r["lang"]], r["bucket"]] = r["n"]
    model = CodeModel(languages, table)
    if len(languages) > 1:
        model.weigh_bits(*bits_right(eligible, model))
    return model


def identify_languages(df: DataFrame, held_out: Column, most_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row; rows held out are not learned from."""
    rows = df.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model = rows.sparkSession.sparkContext.broadcast(fit_languages(rows, ~F.col("held_out"), most_rows))  # buckets x bits

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = model.value.decode
        for batch in batches:
            found = [decode(text) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": exact_ids(batch), "held_out": batch["held_out"],
                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "ambiguous": [f[2] for f in found],
            })

    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return rows.select(*id_parts(), "held_out", "text").mapInPandas(predict, schema)


def in_held_out_fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
