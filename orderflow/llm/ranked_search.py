"""Ranked lexical search: the best documents for each of many items, by branch and bound over trees of documents.

1. Every text is read once, in tasks. Of a document stay its number of terms and its
   restricted term vector: the terms that any item holds, with their counts.
2. Sums over these vectors give the number of documents and of terms and, for each term of an item, the
   documents that hold it; from them come the weights.
3. In its task each stretch of documents becomes a tree. A document's path is its
   restricted vector, the most frequent term first, so that documents share paths as
   far as their vectors begin alike; documents with one vector and one length are one
   leaf. A node holds the largest count of every term and the smallest length factor m below it.
   As a score grows with the counts and falls with m, these bound all scores below.
   Levels that split off little are passed over, so a tree is a few levels deep.
4. An item goes down the tree depth first, along the highest bounds, and turns away
   where a bound is under its tenth best score so far; equal ones are followed, as an earlier id may win.
   The scores of what it reaches are exact. The bests of the tasks meet in two steps.

Items are the query set and come to the tasks in blocks of BLOCK_BYTES of text; a block
reads the documents once. In a task its items are worked on in groups that have up to GROUP_TERMS
different terms, with a tree for each, so that a tree has about CELLS cells at most. No
document is left out but by its bound; of documents with one vector and one length only the
ten first ones can be among the ten best of an item.

Results: a null or empty text, or one without terms, is found by nothing and not counted. Repeated rows are
documents of their own. Among equal scores rows without an id come last. Items that agree in id
and text are one item, those without terms find nothing. Texts of any length are read
whole. Empty tables give an empty result. Extra columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderflow.llm.common import frame, staged
from orderflow.llm.word_hashes import text_bytes

BEST = 10

#: Bytes of the items of a block, different terms of a group of items, cells of a tree's counts.
BLOCK_BYTES, GROUP_TERMS, CELLS = 2**22, 2**12, 2**23

#: Documents of a tree at most, and of a node that is not split any more; a child has so small a share of its node.
TREE_DOCUMENTS, LEAF_DOCUMENTS, SHARE = 4096, 16, 4

#: Parts of the rows of an item in the first of the two steps that find its best ones.
PARTS = 64

#: ASCII letters and digits, letters in lower case, and all bytes beyond ASCII make up terms.
_TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(_TERM_BYTES).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def length_factor(n: int, documents: int, terms: int) -> int:
    return 25 + (75 * n * documents) // terms


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms (their numbers in the vocabulary) and tfs of every document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of BLOCK_BYTES of text

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, terms, tfs = [], [], []
                for text in part.column("text").to_pylist():
                    words = terms_of(text)
                    counts = Counter(map(number, words))
                    counts.pop(None, None)
                    sizes.append(len(words))
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


class Query:
    """An item: its terms, as columns of its group's trees, their weights times their repeats, and the best documents so far."""

    def __init__(self, number: int, columns: np.ndarray, weights: np.ndarray):
        self.number, self.columns, self.weights = number, columns, weights
        self.best: list[tuple[int, bool, int]] = []  # minus the score, without an id, the id
        self.least = 1  # what a score must reach

    def add(self, score: int, ids: list[int | None]) -> None:
        self.best = sorted(self.best + [(-score, i is None, i or 0) for i in ids])[:BEST]
        if len(self.best) == BEST:
            self.least = -self.best[-1][0]

    def scores(self, counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Of documents with these counts (a row each) and length factors; or bounds, if these are maxima and minima."""
        tf = counts[:, self.columns].astype(np.int64)
        return (1_000_000_000 * tf // (1000 * tf + 8 * factors[:, None])) @ self.weights


class DocumentTree:
    """Documents by the paths of their restricted term vectors.

    counts: a row for each different document, in the order of the paths; nodes are ranges of rows.
    """

    def __init__(self, counts: np.ndarray, factors: np.ndarray, ids: list[list[int | None]], common: np.ndarray):
        self.counts, self.factors, self.ids = counts, factors, ids
        self.children: dict[int, range] = {}
        self.ranges = [(0, len(ids))]
        at = 0
        while at < len(self.ranges):
            lo, hi = self.ranges[at]
            if hi - lo > LEAF_DOCUMENTS:
                below = self._split(lo, hi, common)
                self.children[at] = range(len(self.ranges), len(self.ranges) + len(below))
                self.ranges += below
            at += 1
        self.maxima = np.array([counts[lo:hi].max(axis=0) for lo, hi in self.ranges])
        self.minima = np.array([factors[lo:hi].min() for lo, hi in self.ranges])

    @staticmethod
    def _split(lo: int, hi: int, common: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a range in which paths run together for longer, down to those with a small enough share of it."""
        most, found, rest = max(LEAF_DOCUMENTS, (hi - lo) // SHARE), [], [(lo, hi)]
        while rest:
            a, b = rest.pop()
            if b - a <= most and (a, b) != (lo, hi):
                found.append((a, b))
                continue
            inside = common[a + 1 : b]
            cuts = [a, *(a + 1 + np.flatnonzero(inside == inside.min())), b]
            rest += [(int(x), int(y)) for x, y in zip(cuts, cuts[1:])]
        return sorted(found)

    def search(self, query: Query) -> None:
        rest = [(query.least, 0)]
        while rest:
            bound, node = rest.pop()
            if bound < query.least:
                continue
            if node in self.children:
                below = self.children[node]
                bounds = query.scores(self.maxima[below.start : below.stop], self.minima[below.start : below.stop])
                rest += [(int(bounds[i]), below.start + int(i)) for i in np.argsort(bounds, kind="stable") if bounds[i] >= query.least]
            else:
                lo, hi = self.ranges[node]
                scores = query.scores(self.counts[lo:hi], self.factors[lo:hi])
                for i in np.flatnonzero(scores >= query.least):
                    if scores[i] >= query.least:
                        query.add(int(scores[i]), self.ids[lo + i])


def first_ids(ids: list[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i or 0))[:BEST]


def grown_tree(vectors: list[tuple], columns: np.ndarray, width: int) -> DocumentTree | None:
    """The tree of documents (id, factor, terms, tfs). columns: of each term in the tree, the most frequent first, or -1."""
    documents: dict[tuple, list[int | None]] = {}
    for doc_id, factor, terms, tfs in vectors:
        own = columns[terms]
        held = np.flatnonzero(own >= 0)
        path = held[np.argsort(own[held])]
        if len(path):
            documents.setdefault((own[path].astype(">u4").tobytes(), tfs[path].tobytes(), factor), []).append(doc_id)
    if not documents:
        return None
    keys = sorted(documents)
    counts = np.zeros((len(keys), width), np.int64 if any(v[3].max(initial=0) > 2**31 - 1 for v in vectors) else np.int32)
    common, last = np.zeros(len(keys), np.int64), np.zeros(0, ">u4")
    for row, (path, tfs, _) in enumerate(keys):
        own = np.frombuffer(path, ">u4")
        counts[row, own] = np.frombuffer(tfs, np.int64)
        size = min(len(own), len(last))
        differ = np.flatnonzero(own[:size] != last[:size])
        common[row], last = differ[0] if len(differ) else size, own
    return DocumentTree(counts, np.array([k[2] for k in keys], np.int64), [first_ids(documents[k]) for k in keys], common)


def item_groups(items: list[dict[int, int]], frequencies: dict[int, int]) -> list[tuple[list[int], list[int]]]:
    """Items (by number) that share trees, and their terms, the most frequent first."""
    groups: list[tuple[list[int], set[int]]] = []
    for number, counts in enumerate(items):
        found = {t for t in counts if t in frequencies}
        if not found:
            continue
        if not groups or len(groups[-1][1] | found) > GROUP_TERMS:
            groups.append(([], set()))
        groups[-1][0].append(number)
        groups[-1][1].update(found)
    return [(numbers, sorted(terms, key=lambda t: (-frequencies[t], t))) for numbers, terms in groups]


def search_vectors(vectors: DataFrame, items: list[dict[int, int]], vocabulary: int, documents: int, terms: int, frequencies: dict[int, int]) -> DataFrame:
    """item (its number), doc_id and score of the best documents of every item in each task."""
    groups = item_groups(items, frequencies)
    sent = vectors.sparkSession.sparkContext.broadcast((groups, items, frequencies))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = []
        for numbers, used in sent.value[0]:
            columns = np.full(vocabulary, -1, np.int64)
            columns[used] = np.arange(len(used))
            weights = {t: weight(documents, sent.value[2][t]) for t in used}
            queries = []
            for number in numbers:
                asked = [t for t in sent.value[1][number] if t in weights]
                repeats = sent.value[1][number]
                queries.append(Query(number, columns[asked], np.array([weights[t] * repeats[t] for t in asked], np.int64)))
            plans.append((columns, len(used), queries))
        size = max(LEAF_DOCUMENTS, min(TREE_DOCUMENTS, CELLS // max((p[1] for p in plans), default=1)))

        def work(stretch: list[tuple]) -> None:
            for columns, width, queries in plans:
                tree = grown_tree(stretch, columns, width)
                for query in queries if tree else ():
                    tree.search(query)

        stretch: list[tuple] = []
        for batch in batches:
            ids, sizes = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            flat, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for doc_id, n, end in zip(ids, sizes, ends):
                stretch.append((doc_id, length_factor(n, documents, terms), flat[start:end], counts[start:end]))
                start = end
                if len(stretch) == size:
                    work(stretch)
                    stretch = []
        work(stretch)
        found = [(q.number, None if none else doc_id, -score) for _, _, queries in plans for q in queries for score, none, doc_id in q.best]
        columns = [list(c) for c in zip(*found)] or [[], [], []]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def best_of(found: DataFrame) -> DataFrame:
    """The best rows of every item with their rank, first in parts of its rows, then of what the parts leave."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    place = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    left = parts.withColumn("rank", place).where(F.col("rank") <= BEST).drop("rank", "part")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= BEST)


def _search_block(docs: DataFrame, items: list[tuple]) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    counts = [dict(Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text))) for _, text in items]
    vectors = staged(term_vectors(docs, vocabulary))
    documents, terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequencies = {r["term"]: r["df"] for r in held.collect()}  # terms of BLOCK_BYTES of text
    best = best_of(search_vectors(vectors, counts, len(vocabulary), documents, terms, frequencies))
    names = frame(docs.sparkSession, [(n, item_id) for n, (item_id, _) in enumerate(items)], "item int, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of every item. docs: doc_id, text; items: item_id, text."""
    asked = items.select(F.col("`item_id`").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).collect()]
        found.append(_search_block(docs, rows))
    return reduce(DataFrame.unionByName, found)
