"""Merkle manifest of a dataset, with a witness for every document, built by aligned appends.

The leaf of a document is the SHA-256 of its columns, each with its length before it, so
that no two rows run together. The leaves of a language stand in order of their ids under
a subroot, the subroots in order of their languages under the root. On every level two
neighbours become the hash of both; a last one without a neighbour is hashed alone.

1. Places. The leaves are dealt out by ranges of language and id, and the sizes of the
   ranges give every leaf its place in its language, without a sort in one task.
2. Blocks of 4,096 places start where a subtree starts. In its task a block is a stream
   of appends: a leaf opens a subtree; two open subtrees of one height close to one
   above them, which adds to the witness of each leaf in one of them the digest of
   the other. At its end a block closes at its full height, or, where it holds all that there is,
   as soon as one subtree is left.
3. The roots of the blocks are appended in the same way, block by block, and so on up, and
   at last the subroots of the languages. What a root gets for its witness goes on to all
   leaves below it: the levels are joined from above, at most 4,096 rows to one.

Everything but the root, one digest, stays in tables. Equal rows may change places, which alters nothing.

Results: null columns count as absent, told apart from empty ones. Leaves without an id come first, those
of one id in the order of their hashes; documents without a language are a language of their own, the
first one. A single document is its own subroot, a single subroot the root; such leaves have witnesses without
digests. Texts of any length are hashed whole. An empty table gives an empty manifest, without a root. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orderflow.llm.common import staged

#: Levels of a block, and leaves of a range.
LEVELS, RANGE = 12, 100_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Sides of a witness: where the other digest stands, or that there is none on this level.
LEFT, RIGHT, ALONE = "L", "R", "-"


def digest_of(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Appender:
    """A tree that grows at its end, and the witnesses of what has been appended."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int, int]] = []  # height, digest, and the leaves from .. to
        self.sides: list[str] = []
        self.siblings: list[list[str]] = []

    def append(self, digest: str) -> None:
        n = len(self.sides)
        self.sides.append("")
        self.siblings.append([])
        self.open.append((0, digest, n, n + 1))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._close_two()

    def _close_two(self) -> None:
        height, left, first, middle = self.open[-2]
        _, right, _, end = self.open.pop()
        for i in range(first, middle):
            self.sides[i] += RIGHT
            self.siblings[i].append(right)
        for i in range(middle, end):
            self.sides[i] += LEFT
            self.siblings[i].append(left)
        self.open[-1] = (height + 1, digest_of(left, right), first, end)

    def close(self, height: int | None = None) -> str:
        """The root, of a tree of this height or of as few levels as there can be."""
        while True:
            h, digest, first, end = self.open[-1]
            if len(self.open) > 1 and self.open[-2][0] == h:
                self._close_two()
            elif len(self.open) == 1 and h >= (height or 0):
                return digest
            else:
                for i in range(first, end):
                    self.sides[i] += ALONE
                self.open[-1] = (h + 1, digest_of(digest), first, end)


def folded(leaf: str, sides: str, siblings: list[str]) -> str:
    """The root that a leaf and its witness lead to."""
    rest = iter(siblings)
    for side in sides:
        if side == ALONE:
            leaf = digest_of(leaf)
        else:
            leaf = digest_of(next(rest), leaf) if side == LEFT else digest_of(leaf, next(rest))
    return leaf


def split_digests(packed: bytes) -> list[str]:
    text = packed.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def leaf_of(fields: dict[str, Column] | None = None) -> Column:
    """The leaf of a row as a binary; fields: columns that take the place of the row's own."""
    parts = []
    for name in FIELDS:
        value = (fields or {}).get(name, F.col(f"`{name}`")).cast("string")
        told = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(told, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place, from 0 without gaps in their seq, and the size of the seq."""
    parts = max(1, -(-nodes.count() // RANGE))
    dealt = staged(nodes.repartitionByRange(parts, "seq", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("seq", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("seq").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(
        F.struct("seq", "part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(Window.partitionBy("seq")).alias("size"),
    )
    inside = F.row_number().over(Window.partitionBy("seq", "part").orderBy(*order))
    placed = dealt.withColumn("inside", inside).withColumn("at", F.struct("seq", "part"))
    joined = placed.join(firsts, F.col("at").eqNullSafe(F.col("of")))
    return joined.withColumn("place", F.col("first") + F.col("inside") - 1).select(*nodes.columns, "place", "size")


def append_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with block, sides, siblings (their digests in a row) and, on one row a block, the block's root.

    nodes: seq, place, size, node (a digest as binary), and columns that go along.
    """
    columns = nodes.columns
    fields = nodes.withColumns({"block": F.lit(0).cast("bigint"), "sides": F.lit(""), "siblings": F.lit(b""), "root": F.lit(None).cast("binary")}).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def append(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        tree = Appender()
        for node in table.column("node").to_pylist():
            tree.append(node.hex())
        root = tree.close(levels if table.column("size")[0].as_py() > 1 << levels else None)
        found = {
            "sides": pa.array(tree.sides, pa.string()),
            "siblings": pa.array([bytes.fromhex("".join(s)) for s in tree.siblings], pa.binary()),
            "root": pa.array([bytes.fromhex(root)] + [None] * (len(table) - 1), pa.binary()),
        }
        return pa.table([found[n] if n in found else table.column(n) for n in schema.names], names=schema.names)

    blocked = nodes.withColumn("block", F.shiftright("place", levels))
    return blocked.groupBy("seq", "block").applyInArrow(append, schema).select(*columns, "block", "sides", "siblings", "root")


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all levels of blocks, lowest first, and the root of every seq: seq, place 0 and node."""
    levels = []
    while True:
        level = staged(append_blocks(nodes, LEVELS))
        levels.append(level)
        roots = level.where("root is not null").select(
            "seq", F.col("block").alias("place"), F.ceil(F.col("size") / (1 << LEVELS)).alias("size"), F.col("root").alias("node")
        )
        if (roots.agg(F.max("size")).first()[0] or 1) == 1:
            return levels, roots
        nodes = roots


def extended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with whole witnesses and what above has for its seq. above: seq, place 0, sides, siblings and more."""
    more = [c for c in above.columns if c not in ("seq", "place", "sides", "siblings")]
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("sides", "siblings", "root", "block")]
        upper = above.select(
            F.struct("seq", F.col("place").alias("block")).alias("__of"), F.col("sides").alias("__sides"),
            F.col("siblings").alias("__siblings"), *[F.col(c).alias(f"__{c}") for c in more],
        )
        joined = level.withColumn("__at", F.struct("seq", "block")).join(upper, F.col("__at").eqNullSafe(F.col("__of")))
        above = joined.select(
            *own, F.concat("sides", "__sides").alias("sides"), F.concat("siblings", "__siblings").alias("siblings"),
            *[F.col(f"__{c}").alias(c) for c in more],
        )
    return above


@dataclass
class Manifest:
    """leaves: doc_id, lang, place in the language, leaf, found, sides, siblings, subroot. root: the dataset's digest; None of no documents."""

    leaves: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, found: Column | None = None) -> Manifest:
    """The manifest of documents. found: a leaf (see leaf_of) that is to be held against the witness instead of the document's own, or null."""
    hashed = docs.select(
        F.col("`lang`").alias("seq"), F.col("`doc_id`").alias("doc_id"), leaf_of().alias("node"),
        (F.lit(None).cast("binary") if found is None else found).alias("found"),
    )
    leaves = staged(hashed.withColumn("number", F.monotonically_increasing_id()))
    levels, subroots = grown(numbered(leaves, ["doc_id", "node", "number"]))
    tops = numbered(subroots.select(F.lit(0).alias("seq"), F.col("seq").alias("lang"), "node"), ["lang"])
    high, roots = grown(tops)
    root = roots.select("node").first()
    start = roots.select("seq", "place", F.lit("").alias("sides"), F.lit(b"").alias("siblings"))
    langs = extended(high, start).select(
        F.col("lang").alias("seq"), F.lit(0).cast("bigint").alias("place"), "sides", "siblings", F.col("node").alias("subroot")
    )
    rows = extended(levels, staged(langs)).select(
        "doc_id", F.col("seq").alias("lang"), "place", F.col("node").alias("leaf"), "found", "sides", "siblings", "subroot"
    )
    return Manifest(rows, bytes(root["node"]).hex() if root else None)


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf: does what was found lead to the root?"""
    root = manifest.root

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            leaves, founds, subroots = (batch.column(c).to_pylist() for c in ("leaf", "found", "subroot"))
            for leaf, found, sides, packed, subroot in zip(leaves, founds, batch.column("sides").to_pylist(), batch.column("siblings").to_pylist(), subroots):
                siblings = split_digests(packed)
                reached = folded((leaf if found is None else found).hex(), sides, siblings)
                out.append((leaf.hex(), subroot.hex(), root, digest_of(*siblings), reached, reached == root))
            columns = [list(c) for c in zip(*out)] or [[]] * 6
            types = [pa.string()] * 5 + [pa.bool_()]
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest.leaves.mapInArrow(fold, schema)


def tampered_leaf() -> Column:
    """The leaf with one more in n_chars, of rows for whose id 7 divides the CRC-32 of its decimal digits; null for others."""
    struck = F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % 7 == 0
    return F.when(struck, leaf_of({"n_chars": F.col("`n_chars`") + 1}))
