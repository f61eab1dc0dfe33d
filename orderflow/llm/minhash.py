"""Near duplicates by min-max hashing.

A document's set are the 64-bit hashes of its five-word shingles. Under each of 24
permutations both the smallest and the largest value of the set are kept, which
halves the hash evaluations for a signature of 48 values; each agrees for two sets
with the chance of their Jaccard similarity. 16 bands of three values, no two of one
permutation in a band, miss a pair at the threshold of 0.85 with a chance of 2.4e-7.

Documents with equal sets are one class from the start. Classes that share a bucket
(a band's values) are candidates, and every link is confirmed on the full sets. Not
all pairs of a bucket are looked at: what is asked for are the components. First the
members of a bucket are compared with its hub, the one that meets most others, which of
a group of copies is the text they come from; links are joined into components. Only
where a bucket then still holds several components, those outside the largest one are
compared with all members that such buckets connect, block by block, each pair of blocks
in a task that returns no more than a link per member. So a group of any size costs one
comparison per member where its members are near copies of one of them, and no link
between components is lost.

Results: a null text, or one without words, has an empty set and stays by itself. A
row without an id stays by itself too, without a component, and is kept. Rows that
share an id count as one document when links are followed. An empty table gives an
empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import exact_ids, id_parts, staged
from orderflow.llm.components import components
from orderflow.llm.word_hashes import WordHashes, mixed, odd_numbers, run_hashes, signed, text_bytes

SHINGLE, PERMUTATIONS, BAND_VALUES = 5, 24, 3
BANDS = 2 * PERMUTATIONS // BAND_VALUES

#: In hundredths.
THRESHOLD = 85

#: Members of a block where blocks are compared.
BLOCK_MEMBERS = 500

#: Shingles worked on together.
BLOCK = 300_000

FACTORS, ADDED = odd_numbers(PERMUTATIONS, 11), odd_numbers(PERMUTATIONS, 23)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles; of fewer words the whole sequence is one."""
    words = hashes.of(text_bytes(text).lower().split())  # bytes: A-Z only, and ASCII white space
    return np.unique(run_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest values under all permutations, then largest ones, a row per (not empty) set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    result = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        permuted = values * FACTORS[i] + ADDED[i]
        result[:, i] = np.minimum.reduceat(permuted, starts)
        result[:, PERMUTATIONS + i] = np.maximum.reduceat(permuted, starts)
    return result


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, BAND_VALUES)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i, factor in enumerate(odd_numbers(BAND_VALUES, 37)):
        total = mixed(total + bands[:, :, i] * factor)
    return total


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, set_a, set_b (128 bits that tell sets apart) and the keys of the bands of every row."""

    def described(ids: pd.arrays.IntegerArray, sets: list[np.ndarray]) -> pd.DataFrame:
        full = [s for s in sets if len(s)]
        keys = iter(signed(band_keys(signatures(full))) if full else ())
        return pd.DataFrame({
            "doc_id": ids, "n": [len(s) for s in sets],
            "set_a": [int(mixed(s).sum(dtype=np.uint64).view(np.int64)) for s in sets],
            "set_b": [int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets],
            "bands": [next(keys) if len(s) else [] for s in sets],
        })

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            first, sets, size = 0, [], 0
            for row, text in enumerate(batch["text"]):
                sets.append(shingle_set(text, hashes))
                size += len(sets[-1])
                if size >= BLOCK:
                    yield described(exact_ids(batch, slice(first, row + 1)), sets)
                    first, sets, size = row + 1, [], 0
            if sets:
                yield described(exact_ids(batch, slice(first, None)), sets)

    return docs.select(*id_parts(), "text").mapInPandas(describe, "doc_id long, n long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """id and shingles of the documents that stand for a class in members (id).

    Here and below joins with texts or sets are merge joins at every size, as their other sides grow with the documents.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"id": part["doc_id"], "shingles": [signed(shingle_set(t, hashes)) for t in part["text"]]})

    needed = docs.select("doc_id", "text").join(members.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    return needed.mapInPandas(cut, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("u_id"), F.col("shingles").alias("one")).hint("merge")
    other = sets.select(F.col("id").alias("v_id"), F.col("shingles").alias("other")).hint("merge")
    both = pairs.join(one, F.col("u") == F.col("u_id")).select("u", "v", "one").join(other, F.col("v") == F.col("v_id"))
    shared = both.select("u", "v", F.size(F.array_intersect("one", "other")).alias("i"), (F.size("one") + F.size("other")).alias("s"))
    return shared.where(100 * F.col("i") >= threshold * (F.col("s") - F.col("i"))).select("u", "v")


def _size_allows(n: str, m: str, threshold: int):
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def hub_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """Every member of a bucket with the bucket's hub, the member that meets most others in all its buckets."""
    meets = members.groupBy(F.col("id").alias("met")).agg(F.sum("in_bucket").alias("meets"))
    weighed = staged(members.join(meets, F.col("id") == F.col("met")).select("key", "id", "n", "meets"))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("low"), "n")).alias("hub")).select(
        F.col("key").alias("hub_key"), (-F.col("hub.low")).alias("v"), F.col("hub.n").alias("v_n")
    )
    return weighed.join(hubs, F.col("key") == F.col("hub_key")).where(
        (F.col("id") != F.col("v")) & _size_allows("n", "v_n", threshold)
    ).select(F.col("id").alias("u"), "v").distinct()


def unsettled_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group, id, component and rest of the members of buckets that still hold several components.

    Members that such buckets connect are a group; rest are those outside its largest component.
    """
    known = members.select("key", "id").join(labels, F.col("id") == F.col("member"), "left").withColumn(
        "component", F.coalesce("component", "id")
    ).drop("member")
    several = known.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("least")
    ).where("low != high").select(F.col("key").alias("mixed_key"), "least")
    mixed = staged(known.join(several, F.col("key") == F.col("mixed_key")).select("id", "component", "least"))
    groups = components(mixed.where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    grouped = staged(mixed.select("id", "component").distinct().join(
        groups.select("member", F.col("component").alias("group")), F.col("id") == F.col("member"), "left"
    ).select(F.coalesce("group", "id").alias("group"), "id", "component"))
    sizes = grouped.groupBy("group", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("group").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("group_size")).select(
        F.col("group").alias("of"), F.col("most.component").alias("largest"), "group_size", (F.col("group_size") - F.col("most.size")).alias("rest_size")
    )
    return grouped.join(largest, F.col("group") == F.col("of")).withColumn("rest", F.col("component") != F.col("largest")).drop("of", "largest")


def cross_links(groups: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between components of a group, as few as join what belongs together.

    The rest and all members are cut into blocks, and each pair of blocks is compared in
    one task, on the full sets; what leaves it is no more than a link per member.
    """
    blocks = lambda size: F.ceil(F.col(size) / BLOCK_MEMBERS).cast("int")
    counted = groups.withColumns({"of_all": blocks("group_size"), "of_rest": blocks("rest_size")})
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = counted.select("group", "id", "component", F.lit(False).alias("rest"), own("of_all").alias("j"), F.explode(F.sequence(F.lit(0), F.col("of_rest") - 1)).alias("i"))
    rest = counted.where("rest").select("group", "id", "component", F.lit(True).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"), own("of_rest").alias("i"))
    dealt = every.unionByName(rest)
    full = dealt.join(sets.select(F.col("id").alias("of"), "shingles").hint("merge"), F.col("id") == F.col("of"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(part, threshold), columns=["u", "v"])

    return full.select("group", "i", "j", "id", "component", "rest", "shingles").groupBy("group", "i", "j").applyInPandas(compare, "u long, v long")


def block_links(part: pd.DataFrame, threshold: int) -> list[tuple[int, int]]:
    """Links between the rest and the other members of a block pair; only shingles that occur twice count for them."""
    ids, labels = part["id"].to_numpy(), part["component"].to_numpy()
    rest, sizes = part["rest"].to_numpy(bool), part["shingles"].map(len).to_numpy(np.int64)
    owner = np.repeat(np.arange(len(part)), sizes)
    _, column, counts = np.unique(np.concatenate(part["shingles"].to_list()), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    bits = np.zeros((len(part), (int(column.max()) // 64 + 1) if len(column) else 1), np.uint64)
    np.bitwise_or.at(bits, (owner, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    joined: dict[int, int] = {}

    def root(label: int) -> int:
        while (up := joined.get(label, label)) != label:
            joined[label] = joined.get(up, up)
            label = up
        return label

    found = []
    others = np.flatnonzero(~rest)
    for r in np.flatnonzero(rest):
        fits = others[threshold * np.maximum(sizes[others], sizes[r]) <= 100 * np.minimum(sizes[others], sizes[r])]
        common = np.bitwise_count(bits[fits] & bits[r]).sum(1, dtype=np.int64)
        for x in fits[100 * common >= threshold * (sizes[fits] + sizes[r] - common)]:
            one, other = root(int(labels[r])), root(int(labels[x]))
            if one != other:
                joined[one] = other
                found.append((int(ids[r]), int(ids[x])))
    return found


def link_classes(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """member and component of the classes that have links. members: key (of a bucket), id, n, in_bucket."""
    edges = staged(confirmed(hub_pairs(members, threshold), sets, threshold))
    labels = components(edges)
    links = cross_links(unsettled_groups(members, labels), sets, threshold)
    return components(staged(edges.unionByName(links)))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = staged(document_sets(docs))
    classes = staged(rows.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("id"), F.max("n").alias("class_n"), F.first("bands").alias("bands")
    ))
    in_bands = classes.select(F.explode("bands").alias("key"), "id", F.col("class_n").alias("n"))
    shared = in_bands.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1").select(F.col("key").alias("shared_key"), "in_bucket")
    members = staged(in_bands.join(shared, F.col("key") == F.col("shared_key")).select("key", "id", "n", "in_bucket").distinct())
    sets = staged(full_sets(docs, members.select("id").distinct()))
    linked = link_classes(members, sets, threshold)
    of_class = classes.select("set_a", "set_b", "id").join(linked, F.col("id") == F.col("member"), "left").select(
        F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.coalesce("component", "id").alias("component")
    )
    named = rows.select("doc_id", "n", "set_a", "set_b").join(of_class, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first_of_group(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs whose id stands for its component, with all their columns; rows that share an id stay or go together."""
    dropped = near_duplicates(docs, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")


def keep_one_of_group(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row of docs of every group of near duplicates, with all its columns: the first by doc_id and text hash.

    Here every row is a document of its own, so repeated rows and rows without an id are copies like others, and texts
    that only share an id are not. Rows without a word all stay.
    """
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias("__of"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_hash"), "__row")
    firsts = rows.select("__row", place.alias("place")).join(found, F.col("__row") == F.col("__of")).groupBy("component_id").agg(F.min("place").alias("first"))
    return rows.join(firsts.select(F.col("first.__row").alias("__first")), F.col("__row") == F.col("__first"), "left_semi").drop("__row")
