"""URL filters by a sorted array of digests.

Every rule (verdict, host, path prefix) is one string, host and path together. Its
64-bit xxhash stands in a sorted array that the executors map into memory; the full
strings lie beside it. A url is probed with the strings a fitting rule could have
(each parent domain with each prefix length in use), by one vectorised binary search
per batch. A hit counts only if the stored string is the probed one, so collisions
cannot decide.

Results: the longest fitting rule wins, on equal lengths the one with the longer
host; of equal rules the one named last. A url that is null or has no "://" has an
empty host and path, fits no rule and gets the verdict by default. Every row is
judged by itself, so repeated rows repeat; extra columns are left out.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import lowered

VERDICTS = ("allow", "block")


def digest_table(rules: Sequence[tuple[str, str, str]], folder: str) -> list[str]:
    """Write the sorted table of the rules: digests, places and lengths of the strings, verdicts, strings."""
    by_text = {(host.encode() + path.encode()): (verdict, len(host), len(path)) for verdict, host, path in rules}
    entries = sorted((xxhash.xxh64_intdigest(text), text, *rest) for text, rest in by_text.items())
    texts = [e[1] for e in entries]
    info = np.zeros((len(entries), 5), np.int64)
    info[:, 1] = [len(t) for t in texts]
    info[:, 0] = np.cumsum(info[:, 1]) - info[:, 1]
    info[:, 2] = [VERDICTS.index(e[2]) for e in entries]
    info[:, 3] = [e[3] for e in entries]
    info[:, 4] = [e[4] for e in entries]
    stem = os.path.join(folder, f"urls-{uuid.uuid4().hex}")
    np.save(f"{stem}-digests.npy", np.array([e[0] for e in entries], np.uint64))
    np.save(f"{stem}-entries.npy", info)
    np.save(f"{stem}-strings.npy", np.frombuffer(b"".join(texts), np.uint8))
    return [f"{stem}-{part}.npy" for part in ("digests", "entries", "strings")]


class Digests:
    """The table as a process sees it: memory-mapped, searched in batches."""

    def __init__(self, paths: Sequence[str]):
        self.digests, self.entries, self.strings = (np.load(p, mmap_mode="r") for p in paths)
        self.lengths = [int(n) for n in np.unique(self.entries[:, 4])]
        hosts = [bytes(self.strings[start : start + size]) for start, size in self.entries[:, [0, 3]]]
        self.labels = max((h.count(b".") + 1 for h in hosts), default=0)

    def candidates(self, host: str, path: str) -> list[bytes]:
        if not host:
            return []
        labels = host.rsplit(".", self.labels)  # no rule has more of them, so no longer parent can be one's host
        parents = [".".join(labels[i:]) for i in range(int(len(labels) > self.labels), len(labels))]
        prefixes = [path[:n] for n in self.lengths if n <= len(path)]
        return [(parent + prefix).encode("utf-8", "surrogatepass") for parent in parents for prefix in prefixes]

    def judge(self, hosts: Sequence[str], paths: Sequence[str]) -> list[int]:
        """The winning entry of each url, -1 for none."""
        probes, owners = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            found = self.candidates(host, path)
            probes += found
            owners += [i] * len(found)
        best = [-1] * len(hosts)
        if not probes or not len(self.digests):
            return best
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        first, last = (np.searchsorted(self.digests, keys, side) for side in ("left", "right"))
        won: list[tuple[int, int]] = [(-1, -1)] * len(hosts)
        for j in np.flatnonzero(last > first):
            for entry in range(first[j], last[j]):
                start, size, _, host_size, _ = self.entries[entry]
                if bytes(self.strings[start : start + size]) == probes[j] and (rank := (int(size), int(host_size))) > won[owners[j]]:
                    won[owners[j]], best[owners[j]] = rank, entry
        return best

    def text(self, entry: int) -> str:
        start, size = self.entries[entry, :2]
        return bytes(self.strings[start : start + size]).decode()

    def verdict(self, entry: int) -> str:
        return VERDICTS[int(self.entries[entry, 2])]


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z in lower case) and path."""
    text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    return df.withColumn("host", lowered(F.regexp_extract(text, r"://([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)
    )


def filter_urls(
    df: DataFrame, rules: Sequence[tuple[str, str, str]], id_column: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Id, host, path, the rule that decides (null if none) and the verdict of every row."""
    spark: SparkSession = df.sparkSession
    paths = digest_table(rules, tempfile.mkdtemp(prefix="run-"))
    for path in paths:
        spark.sparkContext.addFile(path)  # every executor fetches its own copy, new ones too
    names = [os.path.basename(p) for p in paths]
    kind = df.schema[id_column].dataType
    # as text, since a nullable number would come as a double where a null is among them
    ids = F.col(f"`{id_column}`").cast("string").alias("__id")
    parsed = host_and_path(df.select(ids, F.col(f"`{url}`").alias("__url")), "__url").drop("__url")

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Digests([SparkFiles.get(n) for n in names])
        for batch in batches:
            found = table.judge(batch["host"].tolist(), batch["path"].tolist())
            yield batch.assign(
                rule=pd.Series([table.text(e) if e >= 0 else None for e in found], dtype=object, index=batch.index),
                verdict=pd.Series([table.verdict(e) if e >= 0 else default for e in found], dtype=object, index=batch.index),
            )

    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parsed.mapInPandas(judged, schema).select(F.col("__id").cast(kind).alias(id_column), "host", "path", "rule", "verdict")
