"""Packing of tokenised documents into sequences by bin completion.

Documents become token ids with an end id. Those longer than a sequence are cut into
whole sequences from the end; what is left over at the front is a shorter first
piece. What is to be packed is then described by a histogram, the number of pieces of
each length, which has no more entries than a sequence has tokens. Bin completion
runs over that histogram: the largest piece left is completed by the undominated
filling that a branch-and-bound search finds (larger pieces first; branches that
cannot beat the waste of the incumbent, the best-fit filling, are cut), and the
filling is repeated as often as its pieces last. The last pieces, few enough for an
exact search, are branched over whole fillings, with the best-fit packing as the
incumbent. Pieces then take their places by length and rank within the length.

Results: a null text counts as empty, and an empty one is a piece of the end id
alone. Equal rows are packed separately, and may change places among themselves. An
empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import exact_ids, id_parts, ranked, staged, text_of

END_ID, SEQUENCE = 2, 1024

#: Steps of the search for one filling, and of the search over the last pieces; beyond them the incumbent stands.
FILLING_STEPS, LAST_STEPS, LAST_PIECES = 2_000, 20_000, 40

#: Sequences of the incumbent that waste this much or more are completed anew.
LIMITS = (0, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)

SPECIAL = "<|endoftext|>"


class ByteTokenizer:
    """Ids of the byte-level vocabulary as little-endian bytes.

    The same vocabulary as ranks gives the same ids several times faster; texts with
    the special token go to the library that knows it.
    """

    def __init__(self, ranks_file: str | None = None, json_file: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_file = json_file or public_tokenizers.path("byte_bpe_50k.json")
        self.whole = None

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(df: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and the checksum of the ids, one row per piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = ByteTokenizer()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for row, text in enumerate(batch["__text"]):
                ids = tokenizer(text) + end
                total = len(ids) // 4
                stop = total % sequence or min(total, sequence)
                start = piece = 0
                while start < total:
                    rows.append((row, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + sequence, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=exact_ids(batch, out["doc_id"].to_numpy(np.int64)))

    return df.select(*id_parts(), text_of().alias("__text")).mapInPandas(cut, schema)


def best_filling(counts: Mapping[int, int], room: int, steps: int = FILLING_STEPS) -> tuple[int, ...]:
    """The sizes, at most as many of each as there are, that leave the least of the room;
    of equal waste the filling with the larger pieces, which dominates the others."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    if not sizes:
        return ()
    least = sizes[-1]
    incumbent, left = [], room
    for s in sizes:  # best fit: the largest that goes in, as long as one does
        n = min(counts[s], left // s)
        incumbent += [s] * n
        left -= n * s
    best, waste, spent = tuple(incumbent), left, 0
    chosen: list[int] = []

    def branch(at: int, left: int) -> None:
        nonlocal best, waste, spent
        if left < waste:
            best, waste = tuple(chosen), left
        if not waste or left < least:
            return
        if left and counts.get(left, 0) and (at >= len(sizes) or left <= sizes[at]) and chosen.count(left) < counts[left]:
            best, waste = (*chosen, left), 0
            return
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s > left or chosen.count(s) >= counts[s]:
                continue
            spent += 1
            if spent > steps or not waste:
                return
            chosen.append(s)
            branch(i, left - s)
            chosen.pop()

    branch(0, room)
    return best


def fillings(counts: Mapping[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """Fillings of the room by least waste, without those another one dominates by a larger piece."""
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []
    chosen: list[int] = []

    def branch(at: int, left: int) -> None:
        if len(found) >= most:
            return
        grown = False
        for i in range(at, len(sizes)):
            s = sizes[i]
            if s <= left and chosen.count(s) < counts[s]:
                grown = True
                chosen.append(s)
                branch(i, left - s)
                chosen.pop()
        if not grown:
            # dominated if one of its pieces can be replaced by a larger one that still fits
            if not any(s + left >= t > s and chosen.count(t) < counts[t] for s in set(chosen) for t in sizes):
                found.append((left, tuple(chosen)))

    branch(0, room)
    return [f for _, f in sorted(found, key=lambda x: x[0])] or [()]


Patterns = list[tuple[tuple[int, ...], int]]


def best_fit(counts: Mapping[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing over a histogram: fillings with how often each occurs.

    Sequences with the same filling are one entry. The tightest entry that has room
    takes as many pieces of the size as go in before the next one gets any.
    """
    open_: dict[tuple[int, ...], int] = {}
    rooms: list[tuple[int, tuple[int, ...]]] = []

    def put(filling: tuple[int, ...], n: int) -> None:
        if n and filling not in open_:
            bisect.insort(rooms, (capacity - sum(filling), filling))
        if n:
            open_[filling] = open_.get(filling, 0) + n

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, (size,))
            if at < len(rooms):
                room, filling = rooms.pop(at)
                n = open_.pop(filling)
            else:
                room, filling, n = capacity, (), -(-left // (capacity // size))
            each = room // size
            whole, part = divmod(min(left, n * each), each)
            put(filling + (size,) * each, whole)
            if part:
                put(filling + (size,) * part, 1)
            if filling:
                put(filling, n - whole - bool(part))
            left -= whole * each + part
    return list(open_.items())


def exact_bins(counts: Mapping[int, int], capacity: int, steps: int = LAST_STEPS) -> list[tuple[int, ...]]:
    """Bin completion over few pieces: branch over the fillings around the largest one,
    cut by the waste that the incumbent, at first the best-fit packing, allows."""
    left = Counter({s: n for s, n in counts.items() if n})
    best = [f for f, n in best_fit(left, capacity) for _ in range(n)]
    total = sum(s * n for s, n in left.items())
    lowest, spent = -(-total // capacity), 0
    bins: list[tuple[int, ...]] = []

    def branch(rest: int) -> None:
        nonlocal best, spent
        if not rest:
            if len(bins) < len(best):
                best = list(bins)
            return
        spent += 1
        if spent > steps or len(best) == lowest or len(bins) - (-rest // capacity) >= len(best):
            return
        largest = max(s for s, n in left.items() if n)
        left[largest] -= 1
        for filling in fillings(left, capacity - largest, 50):
            for s in filling:
                left[s] -= 1
            bins.append((largest, *filling))
            branch(rest - largest - sum(filling))
            bins.pop()
            for s in filling:
                left[s] += 1
            if spent > steps or len(best) == lowest:
                break
        left[largest] += 1

    branch(total)
    return best


def completed(histogram: Mapping[int, int], capacity: int) -> Patterns:
    """Complete the largest piece left by its best filling, as often as the pieces last; the last ones exactly."""
    left = {s: n for s, n in histogram.items() if n}
    result: Patterns = []
    while sum(left.values()) > LAST_PIECES:
        largest = max(left)
        left[largest] -= 1
        filling = (largest, *best_filling(left, capacity - largest))
        left[largest] += 1
        need = Counter(filling)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        result.append((filling, times))
    return result + [(b, 1) for b in exact_bins(left, capacity)]


def sequences(patterns: Patterns) -> int:
    return sum(n for _, n in patterns)


def bin_completion(histogram: Mapping[int, int], capacity: int) -> Patterns:
    """Fillings with how often each is used; together they use the histogram up.

    The incumbent is the best-fit packing. Completion then works on all pieces, and
    on those in the sequences of the incumbent that waste at least so much, for falling
    limits; what takes fewer sequences becomes the incumbent. No packing can do with
    fewer than the sum of the lengths needs, which ends the search.
    """
    best = best_fit(histogram, capacity)
    lowest = -(-sum(s * n for s, n in histogram.items()) // capacity)
    for limit in LIMITS:
        if sequences(best) <= lowest:
            break
        kept = [(f, n) for f, n in best if capacity - sum(f) < limit]
        loose = Counter()
        for filling, n in best:
            if capacity - sum(filling) >= limit:
                for s in filling:
                    loose[s] += n
        tried = kept + completed(loose, capacity)
        if sequences(tried) < sequences(best):
            best = tried
    return best


def place_table(patterns: Patterns) -> np.ndarray:
    """Runs of ranks by length: length, first rank, pieces of the length in one sequence, first sequence, first offset."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, times in patterns:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, taken[size], n, sequence, offset))
            taken[size] += n * times
            offset += n * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_documents(df: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and the place there."""
    pieces = staged(token_pieces(df, sequence, end_id))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = place_table(bin_completion(histogram, sequence))
    placed = ranked(pieces, "length", ["doc_id", "piece", "ids_crc32"], sum(histogram.values()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            run = table[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            turn, slot = np.divmod(rank - run[:, 1], run[:, 2])
            yield batch.drop(columns=["rank", "id", "no_id"]).assign(
                doc_id=exact_ids(batch), sequence_id=run[:, 3] + turn, offset=run[:, 4] + slot * length
            )

    rows = placed.select(*id_parts(), "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
