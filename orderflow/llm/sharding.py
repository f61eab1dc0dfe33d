"""Shards by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group that stays together. The sizes of all groups are
counted by size class (exact below 4096 bytes, above that rounded up by less than
1/2048), which bounds what the driver sees by the number of classes, not of groups:
at most 2048 for each doubling of the size. The packing runs over (class, count)
from the largest down; the tightest shard with room is found in a balanced tree of
the remaining capacities. What comes out are runs, "groups number a to b of this
class go to shard s", which the groups join by class and rank.

Results: a null text counts as an empty one. Rows without an id are packed like the
others. An empty table gives an empty result. Rows that are equal in id and text may
change slots among themselves. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import frame, ranked, staged, text_of

MANTISSA_BITS = 11

#: A run of one class: class, first rank, rank after the last, shard.
Run = tuple[int, int, int, int]


class CapacityTree:
    """Remaining capacities of the open shards in an AVL tree; equal capacities are told apart by shard number."""

    class Node:
        __slots__ = ("key", "left", "right", "height")

        def __init__(self, key: tuple[int, int]):
            self.key, self.left, self.right, self.height = key, None, None, 1

    def __init__(self) -> None:
        self.root: CapacityTree.Node | None = None

    @staticmethod
    def _height(node: Node | None) -> int:
        return node.height if node else 0

    def _update(self, node: Node) -> None:
        node.height = 1 + max(self._height(node.left), self._height(node.right))

    def _rotate(self, node: Node, up: str, down: str) -> Node:
        top = getattr(node, up)
        setattr(node, up, getattr(top, down))
        setattr(top, down, node)
        self._update(node)
        self._update(top)
        return top

    def _balanced(self, node: Node) -> Node:
        self._update(node)
        lean = self._height(node.left) - self._height(node.right)
        if abs(lean) < 2:
            return node
        up, down = ("left", "right") if lean > 0 else ("right", "left")
        child = getattr(node, up)
        if self._height(getattr(child, down)) > self._height(getattr(child, up)):
            setattr(node, up, self._rotate(child, down, up))
        return self._rotate(node, up, down)

    def add(self, room: int, shard: int) -> None:
        def insert(node: CapacityTree.Node | None) -> CapacityTree.Node:
            if node is None:
                return self.Node((room, shard))
            side = "left" if (room, shard) < node.key else "right"
            setattr(node, side, insert(getattr(node, side)))
            return self._balanced(node)

        self.root = insert(self.root)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest capacity of at least this size."""
        node, found = self.root, None
        while node:
            if node.key[0] >= size:
                found, node = node.key, node.left
            else:
                node = node.right
        if found is None:
            return None

        def pop_least(node: CapacityTree.Node) -> tuple[CapacityTree.Node, CapacityTree.Node | None]:
            if node.left is None:
                return node, node.right
            least, node.left = pop_least(node.left)
            return least, self._balanced(node)

        def delete(node: CapacityTree.Node) -> CapacityTree.Node | None:
            if found < node.key:
                node.left = delete(node.left)
            elif found > node.key:
                node.right = delete(node.right)
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                least, right = pop_least(node.right)
                least.left, least.right = node.left, right
                node = least
            return self._balanced(node)

        self.root = delete(self.root)
        return found


def best_fit_runs(counts: Iterable[tuple[int, int]], capacity: int, shards: int | None = None) -> tuple[list[Run], int] | None:
    """Pack (class, count) pairs into shards of the capacity: the runs and the number of shards.

    With a number of shards, None if they don't do. While a shard is the tightest one
    for a class, it stays so after each group it takes; so it takes all that fit at once.
    """
    tree, opened, runs = CapacityTree(), 0, []
    for size, count in sorted(counts, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} bytes exceeds the capacity of {capacity}")
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                if opened == shards:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, shard = found
            taken = min(count - rank, room // size)
            runs.append((size, rank, rank + taken, shard))
            tree.add(room - taken * size, shard)
            rank += taken
    return runs, opened


def even_runs(counts: Iterable[tuple[int, int]], shards: int) -> list[Run]:
    """Pack into a fixed number of shards with the smallest capacity found that suffices.

    A group larger than an even share of what is left gets a shard of its own first.
    """
    left = {size: count for size, count in counts if count}
    runs: list[Run] = []
    used, taken_alone = 0, {}
    while left and used < shards - 1:
        share = sum(s * c for s, c in left.items()) / (shards - used)
        largest = max(left)
        if largest <= share:
            break
        rank = taken_alone.get(largest, 0)
        runs.append((largest, rank, rank + 1, used))
        taken_alone[largest] = rank + 1
        used += 1
        left[largest] -= 1
        if not left[largest]:
            del left[largest]
    if not left:
        return runs
    rest = shards - used
    low = max(max(left), -(-sum(s * c for s, c in left.items()) // rest)) - 1
    step, found = 1, None
    while found is None:
        high = low + step
        found = best_fit_runs(left.items(), high, rest)
        low, step = (low, step) if found else (high, step * 2)
    while high - low > 1:
        middle = (low + high) // 2
        tried = best_fit_runs(left.items(), middle, rest)
        if tried:
            high, found = middle, tried
        else:
            low = middle
    for size, first, last, shard in found[0]:
        shift = taken_alone.get(size, 0)
        runs.append((size, first + shift, last + shift, shard + used))
    return runs


def size_class(size: Column) -> Column:
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(size.cast("double"))).cast("double") - MANTISSA_BITS))
    return (F.ceil(size / step) * step).cast("long")


def shard_documents(df: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Either a fixed number of shards, filled evenly, or a fixed capacity in bytes and
    as few shards as best fit gives.
    """
    spark = df.sparkSession
    text = text_of()
    rows = staged(df.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
    ))
    groups = staged(
        rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", size_class(F.col("bytes")))
    )
    counts = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    if shards is not None:
        runs = even_runs(counts, shards)
    else:
        runs = best_fit_runs(counts, capacity)[0]
    table = frame(spark, runs, "run_class long, first long, last long, shard int")  # bounded by classes and shards
    placed = ranked(groups, "class", ["text_key"], sum(n for _, n in counts))
    of_group = placed.join(
        F.broadcast(table), (F.col("class") == F.col("run_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    ).select(F.col("text_key").alias("key"), "shard")
    sharded = staged(rows.join(of_group, F.col("text_key") == F.col("key")).drop("key", "text_key"))
    total = sharded.count()
    return ranked(sharded, "shard", ["doc_id", "text_crc32", "size"], total, "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )
