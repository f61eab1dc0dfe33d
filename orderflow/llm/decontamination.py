"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two neighbouring blocks of words. Words (letters and
digits in lower case) are hashed into buckets, weighted by the inverse document
frequency over all documents, and a randomised singular value decomposition gives the
latent space: products with a small matrix, the results of which are added up over the
tasks. The first round starts from random directions and takes all benchmark items; the
second one takes all items and every passage of every document, with as much weight on
all items as on all passages. Every passage of every document is then searched.

The cosine of a row is the best of its passages' to an item. The product is that of the
latent space, the passage's length the one of all its words: what lies outside the
space, which has to do with no item, counts against it.

A passage whose cosine to an item is RETRIEVED or more names text and item, which are then
compared. An item is found where the longest common subsequence holds most
of its words, within a stretch not much longer than the item, and so much of its end, the
answer, too. That also finds paraphrases in which words were changed, put in or left out.
The space cannot hold any number of items or items of any length, so there is an exact way
for what it misses. A text that holds so many of the words holds at least one of any choice
of words too large to be left out. The rarest such choice of each item names texts to compare,
too, so none is lost, however many, long or common the items are.

The words of a document are hashed once: for each a number, its bucket in the low bits and above them its place among
the words of all items, if it is one, is written for the rounds and the search to read.

Items are a query set: they are searched in blocks of ITEM_BLOCK, each over all rows.

Results: a null text, or one without words, holds nothing. Items without a word or
null are skipped. Repeated rows are judged one by one; items with equal texts are all
named. With no items nothing is contaminated. Extra columns are left out, or kept by
drop_contaminated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import document_key, exact_ids, id_parts, staged
from orderflow.llm.word_hashes import ByteRuns, text_bytes

BUCKETS, DIMENSIONS, EXTRA = 1 << 14, 192, 16
BLOCK_WORDS = 32

ITEM_BLOCK = 4_096

#: Share of an item's words in the common subsequence, share of its answer (its last fifth), and how long a stretch may be.
LEAST_COMMON, LEAST_ANSWER, ANSWER_PART, LONGEST_STRETCH = 0.7, 0.5, 0.2, 1.6

#: Least cosine of a passage to an item that has the two compared.
RETRIEVED = 0.5

#: Words taken together; longer texts are taken in parts of as many, a multiple of BLOCK_WORDS.
PART_WORDS = 1 << 11

#: Signs that end a word: all of ASCII but letters and digits, and the usual ones beyond it.
SIGNS_TO_SPACE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
OTHER_SIGNS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]+")

def word_codes(text: str | None, hashes: ByteRuns) -> np.ndarray:
    """64-bit hashes of the words of a text, in lower case; their low bits are the buckets.

    Words are what stands between signs and white space.
    """
    text = (text or "").lower()
    if OTHER_SIGNS.search(text):
        text = OTHER_SIGNS.sub(" ", text)
    return hashes.of(text_bytes(text).translate(SIGNS_TO_SPACE))


def buckets(codes: np.ndarray) -> np.ndarray:
    return (codes & codes.dtype.type(BUCKETS - 1)).astype(np.int64)


def places_of(codes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of a sorted vocabulary stand, and their places in it."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[place] == codes)
    return at, place[at]


def numbered(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """What is kept of words: the bucket, and from BUCKETS up one more than the place in the vocabulary, 0 if it is not there."""
    found = buckets(codes)
    at, place = places_of(codes, vocabulary)
    found[at] += (place + 1) * BUCKETS
    return found.astype(number_type(vocabulary))


def number_type(vocabulary: np.ndarray) -> np.dtype:
    return np.dtype("<u4" if (len(vocabulary) + 1) * BUCKETS <= 1 << 32 else "<u8")


def coded_documents(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, text_hash and codes (see numbered) of every row, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, hashes = shared.value, ByteRuns()
        for batch in batches:
            codes = [numbered(word_codes(text, hashes), words).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": exact_ids(batch), "text_hash": batch["text_hash"], "codes": codes})

    rows = docs.select(document_key().alias("key"), "text").select(*id_parts(F.col("key.id")), "key.text_hash", "text")
    return staged(rows.mapInPandas(code, "doc_id long, text_hash long, codes binary"))


def document_frequencies(coded: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The numbers of documents and of passages, how many documents hold a word of each bucket and how many each word of the vocabulary."""
    size, kind = len(vocabulary), number_type(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, rows, passages = np.zeros(BUCKETS + size, np.int64), 0, 0
        last = np.zeros(BUCKETS + size, np.int64)
        for batch in batches:
            for data in batch["codes"]:
                rows += 1
                codes = np.frombuffer(data, kind)
                passages += max(-(-len(codes) // BLOCK_WORDS) - 1, min(len(codes), 1))
                place = (codes // BUCKETS).astype(np.int64)
                used = np.concatenate([buckets(codes), place[place > 0] + (BUCKETS - 1)])
                turn = np.arange(len(used))
                last[used] = turn  # of equal ones the last stays, so each counts once
                totals[used[last[used] == turn]] += 1
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": np.append(used, [-1, -2]), "n": np.append(totals[used], [rows, passages])})

    found = coded.select("codes").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    result, sizes = np.zeros(BUCKETS + size), {-1: 0, -2: 0}
    for r in found:  # at most one row per bucket and word of an item
        if r["bucket"] < 0:
            sizes[r["bucket"]] = r["n"]
        else:
            result[r["bucket"]] = r["n"]
    return sizes[-1], sizes[-2], result[:BUCKETS], result[BUCKETS:]


class Passages:
    """The passages of some texts, which are given by the buckets of their words, one text after the other.

    starts: of the blocks, first and second: the blocks of each passage (second is -1 where there is one alone),
    text: whose passage it is.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        blocks = -(-lengths // BLOCK_WORDS)
        block_text = np.repeat(np.arange(len(lengths)), blocks)
        first_block, first_word = np.cumsum(blocks) - blocks, np.cumsum(lengths) - lengths
        self.starts = first_word[block_text] + BLOCK_WORDS * (np.arange(len(block_text)) - first_block[block_text])
        count = np.maximum(blocks - 1, np.minimum(blocks, 1))
        self.text = np.repeat(np.arange(len(lengths)), count)
        self.first = first_block[self.text] + np.arange(len(self.text)) - (np.cumsum(count) - count)[self.text]
        self.second = np.where(blocks[self.text] > 1, self.first + 1, -1)

    def sums(self, blocks: np.ndarray) -> np.ndarray:
        """What the blocks hold, added up for each passage."""
        found, two = blocks[self.first], self.second >= 0
        found[two] += blocks[self.second[two]]
        return found

    def to_blocks(self, passages: np.ndarray) -> np.ndarray:
        """What the passages hold, added up for each block."""
        found, two = np.zeros((len(self.starts), *passages.shape[1:]), passages.dtype), self.second >= 0
        found[self.first] = passages
        found[self.second[two]] += passages[two]
        return found


def parts(texts: Iterator[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Numbered texts, given by their words, in lots of about PART_WORDS words; neighbouring parts of a long one share a block."""
    numbers, lot, words = [], [], 0
    for number, codes in enumerate(texts):
        for at in range(0, max(len(codes) - BLOCK_WORDS, min(len(codes), 1)), PART_WORDS):
            part = codes[at : at + PART_WORDS + BLOCK_WORDS]
            numbers.append(number)
            lot.append(part)
            words += len(part)
            if words >= PART_WORDS:
                yield numbers, lot
                numbers, lot, words = [], [], 0
    if lot:
        yield numbers, lot


def tf_idf(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, values of length one) of some words."""
    used, counts = np.unique(found[idf[found] > 0], return_counts=True)
    values = counts * idf[used]
    length = np.linalg.norm(values)
    return (used, values / length) if length else None


def add_products(total: np.ndarray, lot: list[np.ndarray], table: np.ndarray, squares: np.ndarray) -> None:
    """Add to total, but for the idf of its rows, the product of the passages' vectors, their transpose and a matrix (table, with the idf)."""
    found = buckets(np.concatenate(lot))
    cut = Passages(np.array([len(c) for c in lot]))
    lengths = np.maximum(cut.sums(np.add.reduceat(squares[found], cut.starts)), 1e-9)
    seen = cut.sums(np.add.reduceat(table[found], cut.starts)) / lengths[:, None]
    there, place = np.zeros(BUCKETS, bool), np.empty(BUCKETS, np.int64)
    there[found] = True
    used = np.flatnonzero(there)
    place[used] = np.arange(len(used))
    n = len(cut.starts)
    block = np.repeat(np.arange(n), np.diff(cut.starts, append=len(found)))
    counts = np.bincount(place[found] * n + block, minlength=len(used) * n).reshape(len(used), n)
    total[used] += counts.astype(table.dtype) @ cut.to_blocks(seen)


def latent_space(items: DataFrame, docs: DataFrame, idf: np.ndarray, seed: int = 5, kind: np.dtype | None = None) -> np.ndarray:
    """Buckets by dimensions: the right singular vectors of all items and all passages of docs (text, or codes of a kind).
    items: text and weight, how often each counts."""
    width = DIMENSIONS + EXTRA
    noise = np.random.default_rng(seed).standard_normal((BUCKETS, width))
    basis = noise
    context = docs.sparkSession.sparkContext
    told = items.select("text", F.lit(None).cast("binary").alias("codes"), "weight")
    own = docs.select("text", F.lit(None).cast("binary").alias("codes")) if kind is None else docs.select(F.lit(None).cast("string").alias("text"), "codes")
    # a task returns a matrix, so there are as many as can run at once
    every = own.withColumn("weight", F.lit(None).cast("double")).unionByName(told).coalesce(context.defaultParallelism)
    for rows in (told.coalesce(context.defaultParallelism), every):
        shared = context.broadcast(np.linalg.qr(basis)[0].astype(np.float32))  # buckets x dimensions

        def products(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hashes, q = ByteRuns(), shared.value
            table, squares = q * idf[:, None].astype(np.float32), (idf**2).astype(np.float32)
            total, of_items = np.zeros((BUCKETS, width)), np.zeros((BUCKETS, width))
            for batch in batches:
                of_docs, of_batch = batch["weight"].isna().to_numpy(bool), np.zeros((BUCKETS, width), np.float32)
                if kind is None:
                    coded = (word_codes(text, hashes) for text in batch["text"][of_docs])
                else:
                    coded = (np.frombuffer(data, kind) for data in batch["codes"][of_docs])
                for _, lot in parts(coded):
                    add_products(of_batch, lot, table, squares)
                total += of_batch
                for text, weight in zip(batch["text"][~of_docs], batch["weight"][~of_docs]):
                    if row := tf_idf(buckets(word_codes(text, hashes)), idf):
                        of_items[row[0]] += weight * row[1][:, None] * (row[1] @ q[row[0]])
            total = total * idf[:, None] + of_items
            used = np.flatnonzero(np.abs(total).sum(1))
            for at in range(0, len(used), 1024):
                some = used[at : at + 1024]
                yield pd.DataFrame({"bucket": some, "row": [r.tobytes() for r in total[some].astype(np.float32)]})

        def add(part: pd.DataFrame) -> pd.DataFrame:
            found, place = np.unique(part["bucket"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(found), width), np.float32)
            np.add.at(sums, place, np.stack([np.frombuffer(r, np.float32) for r in part["row"]]))
            return pd.DataFrame({"bucket": found, "row": [r.tobytes() for r in sums]})

        matrices = rows.mapInPandas(products, "bucket long, row binary")
        summed = matrices.groupBy(F.pmod("bucket", F.lit(64))).applyInPandas(lambda part: add(part), "bucket long, row binary")
        found = np.zeros((BUCKETS, width))
        for r in summed.toLocalIterator():  # one row per bucket
            found[r["bucket"]] = np.frombuffer(r["row"], np.float32)
        shared.unpersist()
        # directions that no item has stay in, for the round over the documents
        basis = found / max(np.abs(found).max(), 1e-9) + 1e-3 * noise
    left, _, _ = np.linalg.svd(found if found.any() else noise, full_matrices=False)
    return left[:, :DIMENSIONS].astype(np.float32)


def common_length(words: np.ndarray, item: dict[int, int], size: int) -> np.ndarray:
    """For each word position, the length of the longest common subsequence up to there with the whole item, in bits of a number.

    item has for each word the bits of the places it stands at.
    """
    state, full = (1 << size) - 1, (1 << size) - 1
    for code in words:
        match = item.get(code, 0)
        if match:
            met = state & match
            state = (state + met | state & ~match) & full
    return full ^ state


def shares(words: list[int], item: list[int], places: dict[int, int]) -> tuple[float, float]:
    """Shares of the item's words and of its answer in a common subsequence with the words."""
    size = len(item)
    ones = common_length(words, places, size)
    answer = max(1, round(size * ANSWER_PART))
    tail = {}
    for i, code in enumerate(item[size - answer :]):
        tail[code] = tail.get(code, 0) | 1 << i
    end = common_length(words, tail, answer)
    return ones.bit_count() / size, end.bit_count() / answer


def least_common(size: int) -> int:
    """The fewest words of an item of so many that are enough of it."""
    return next(n for n in range(int(LEAST_COMMON * size), size + 1) if n / size >= LEAST_COMMON)


def telling_words(item: np.ndarray, vocabulary: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """The rarest words of an item, as places in the vocabulary, of which a text that holds enough of it has at least one."""
    used, counts = np.unique(places_of(item, vocabulary)[1], return_counts=True)
    order = np.argsort(frequencies[used], kind="stable")
    left_out = len(item) - least_common(len(item))  # words at most that a text can do without
    return used[order[: 1 + int(np.searchsorted(np.cumsum(counts[order]), left_out, side="right"))]]


def bits_of(item: list[int]) -> dict[int, int]:
    """For each word the bits of the places it stands at."""
    at: dict[int, int] = {}
    for i, code in enumerate(item):
        at[code] = at.get(code, 0) | 1 << i
    return at


def best_share(codes: np.ndarray, item: np.ndarray) -> float:
    """The best share of the item's words, with enough of its answer, over stretches a little longer than the item; or 0."""
    size = len(item)
    least, span, step = least_common(size), max(int(size * LONGEST_STRETCH), size + 2), max(1, size // 5)
    inside = np.zeros(len(codes) + 1, np.int64)
    inside[1 + places_of(codes, np.unique(item))[0]] = 1
    met = np.cumsum(inside)
    starts = np.arange(0, max(len(codes) - span, 0) + step, step)
    starts = starts[met[np.minimum(starts + span, len(codes))] - met[np.minimum(starts, len(codes))] >= least]
    best, words, places = 0.0, item.tolist(), {}
    for start in starts.tolist():
        places = places or bits_of(words)
        share, answer = shares(codes[start : start + span].tolist(), words, places)
        if share >= LEAST_COMMON and answer >= LEAST_ANSWER:
            best = max(best, share)
            if best == 1.0:
                break
    return best


def best_cosines(numbers: list[int], lot: list[np.ndarray], table: np.ndarray, squares: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a lot that have passages, and the best cosines of these to each item."""
    found = buckets(np.concatenate(lot))
    cut = Passages(np.array([len(c) for c in lot]))
    lengths = np.sqrt(np.maximum(cut.sums(np.add.reduceat(squares[found], cut.starts)), 1e-9))
    cosines = (cut.sums(np.add.reduceat(table[found], cut.starts)) / lengths[:, None]) @ matrix.T
    part, firsts = np.unique(cut.text, return_index=True)
    return np.array(numbers)[part], np.maximum.reduceat(cosines, firsts)


class Items:
    """The words of some items, numbered and as places in a vocabulary, and the items that each place names."""

    def __init__(self, coded: list[np.ndarray], vocabulary: np.ndarray, frequencies: np.ndarray) -> None:
        self.words, self.size = [numbered(c, vocabulary) for c in coded], len(vocabulary)
        self.least = np.array([least_common(len(c)) for c in coded], np.int64)
        used = [np.unique(places_of(c, vocabulary)[1], return_counts=True) for c in coded]
        # the words of item n, and how often it holds them, are used[starts[n] : starts[n + 1]]
        self.starts = np.append(0, np.cumsum([len(u) for u, _ in used])).astype(np.int64)
        self.used, self.times = (np.concatenate([*(u[k] for u in used), np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
        telling = [telling_words(c, vocabulary, frequencies) for c in coded]
        owners = np.repeat(np.arange(len(coded)), [len(t) for t in telling])
        chosen = np.concatenate([*telling, np.zeros(0, np.int64)]).astype(np.int64)
        self.owners = owners[np.argsort(chosen, kind="stable")]  # those of place p are owners[firsts[p] : firsts[p + 1]]
        self.firsts = np.append(0, np.cumsum(np.bincount(chosen, minlength=len(vocabulary)))).astype(np.int64)

    def found(self, codes: np.ndarray, retrieved: np.ndarray, held: np.ndarray) -> dict[int, float]:
        """The items that a text (see numbered) holds, of those that were retrieved or that one of its words names, and their shares.

        held: a zero for each word of the vocabulary, and so it is left.
        """
        places = (codes // BUCKETS).astype(np.int64)
        places = places[places > 0] - 1
        named = self.owners[ranges(self.firsts[places], self.firsts[places + 1])]
        asked = np.unique(np.concatenate([retrieved, named]))
        hits: dict[int, float] = {}
        if len(asked) and len(places):
            np.add.at(held, places, 1)
            at = ranges(self.starts[asked], self.starts[asked + 1])
            sizes = self.starts[asked + 1] - self.starts[asked]
            # no common subsequence is longer than the words in common
            common = np.add.reduceat(np.minimum(held[self.used[at]], self.times[at]), np.cumsum(sizes) - sizes)
            held[places] = 0
            for n in asked[common >= self.least[asked]].tolist():
                if share := best_share(codes, self.words[n]):
                    hits[n] = share
        return hits


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def search(coded_docs: DataFrame, items: list[tuple[int, str]], vocabulary: np.ndarray, frequencies: np.ndarray, space: np.ndarray | None, idf: np.ndarray) -> DataFrame:
    """doc_id, text_hash, item_ids, best cosine and best share of every row, for one block of items; without a space no cosine."""
    hashes = ByteRuns()
    coded = [(item_id, word_codes(text, hashes)) for item_id, text in items]
    coded = [(i, c) for i, c in coded if len(c)]
    table = matrix = None
    if space is not None:
        table = space * idf[:, None].astype(np.float32)
        matrix = np.zeros((len(coded), DIMENSIONS), np.float32)
        for n, (_, codes) in enumerate(coded):
            matrix[n] = table[buckets(codes)].sum(0)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    kind = number_type(vocabulary)
    shared = coded_docs.sparkSession.sparkContext.broadcast((
        table, (idf**2).astype(np.float32), matrix, [i for i, _ in coded], Items([c for _, c in coded], vocabulary, frequencies)
    ))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, squares, matrix, ids, known = shared.value
        nothing, held = np.zeros(0, np.int64), np.zeros(known.size, np.int64)
        for batch in batches:
            coded = [np.frombuffer(data, kind) for data in batch["codes"]]
            tops, retrieved = np.zeros(len(coded)), {}
            for numbers, lot in parts(iter(coded)) if len(ids) and table is not None else ():
                owner, cosines = best_cosines(numbers, lot, table, squares, matrix)
                np.maximum.at(tops, owner, cosines.max(1))
                for at, n in zip(*np.nonzero(cosines >= RETRIEVED)):
                    retrieved.setdefault(int(owner[at]), []).append(n)
            out = {"item_ids": [], "cosine": np.minimum(tops, 1.0), "share": []}
            for row, codes in enumerate(coded):
                hits = known.found(codes, np.array(retrieved[row]) if row in retrieved else nothing, held)
                out["item_ids"].append(sorted(ids[n] for n in hits))
                out["share"].append(max(hits.values(), default=0.0))
            yield pd.DataFrame({"doc_id": exact_ids(batch), "text_hash": batch["text_hash"], **out})

    rows = coded_docs.select(*id_parts(), "text_hash", "codes")
    return rows.mapInPandas(judge, "doc_id long, text_hash long, item_ids array<long>, cosine double, share double")


def find_contaminated(docs: DataFrame, items: DataFrame, cosines: bool = True) -> DataFrame:
    """doc_id, text_hash, item_ids (sorted), cosine (0 where not asked for), share and contaminated of every row. items: item_id, text."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    hashes, n_items, vocabulary = ByteRuns(), 0, np.zeros(0, np.uint64)
    some = []
    for r in items.toLocalIterator():
        n_items += 1
        some.append(word_codes(r["text"], hashes))
        if len(some) == ITEM_BLOCK:
            vocabulary, some = np.unique(np.concatenate([vocabulary, *some])), []
    vocabulary = np.unique(np.concatenate([vocabulary, *some]))
    coded = coded_documents(docs, vocabulary)
    rows, passages, frequencies, word_frequencies = document_frequencies(coded, vocabulary)
    idf = np.log((rows + 1) / (frequencies + 1)) + 0.1  # of every word above 0
    space = None
    if cosines:
        weighted = items.select("text", F.lit(max(1.0, passages / max(n_items, 1))).alias("weight"))
        space = latent_space(weighted, coded, idf, kind=number_type(vocabulary))
    found = None
    blocks = max(1, -(-n_items // ITEM_BLOCK))
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # about ITEM_BLOCK items
        hits = search(coded, [(r["item_id"], r["text"]) for r in some], vocabulary, word_frequencies, space, idf)
        found = hits if found is None else found.unionByName(hits)
    if blocks > 1:
        merged = staged(found).groupBy(F.struct(F.col("doc_id").alias("id"), "text_hash").alias("of")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("cosine").alias("cosine"), F.max("share").alias("share")
        )
        found = docs.select(document_key().alias("key")).join(merged, F.col("key") == F.col("of")).select(
            F.col("key.id").alias("doc_id"), "key.text_hash", "item_ids", "cosine", "share"
        )
    return found.withColumn("contaminated", F.size("item_ids") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found, with all their columns."""
    bad = find_contaminated(docs, items).where("contaminated").select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias("__of")).distinct()
    return docs.join(bad, document_key() == F.col("__of"), "left_anti")
