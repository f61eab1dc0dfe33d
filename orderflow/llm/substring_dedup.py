"""Substring deduplication: windows of words that occur more than once, found in FM-indexes of shards.

1. Every window of 35 words has an anchor, its 10-word run of smallest hash (the first
   of equal ones). Neighbouring windows with one anchor form a segment. Equal windows
   have equal anchors, so a window whose anchor stands nowhere else cannot repeat;
   such segments are left out, where they lie, by two passes of a filter (see exact_dedup.possible). Places of repeated rows are one place, with their number.
2. Equal segments (by anchor and hash) become one, with their number as its weight,
   before any text moves; the words of one of each are cut out of its document.
3. Segments are dealt out to shards by anchor, so that all places of a window meet in
   one shard, and the number of shards grows with the words. An anchor with so many
   different segments that they would swell a shard is dealt out window by window,
   by the hash of the whole window, after equal windows have become one.
4. Each shard builds a compressed FM-index of its segments and streams them through it:
   backward search over the wavelet matrix gives matching statistics, and the
   windows inside matches that occur twice or more are reported.
5. The reports go back to the places of the segments, and every document loses the
   words its reported windows cover. On that way a run of neighbouring segments is its first, its last and
   all those between as one unit: a passage that many documents hold is a few rows for each, and what it
   is reported with is put together once.

Windows are compared by their words; hashes decide only which segments are equal (128
bits) and which meet.

Results: a null text has no words, an empty result and the checksum of the empty text.
Windows are judged on the input; every copy loses its words, the first one as well.
Repeated rows are places of their own: their windows repeat each other, and every row
is returned. An empty table gives an empty result. Extra columns are left out, or
kept by remove_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import document_key, exact_ids, id_parts, staged, staged_last
from orderflow.llm import exact_dedup
from orderflow.llm.exact_dedup import possible
from orderflow.llm.fm_index import FMIndex, repeated_windows
from orderflow.llm.word_hashes import WordHashes, mixed, run_hashes, signed, text_bytes

WINDOW, ANCHOR = 35, 10

#: Words worked on together when segments are formed.
BLOCK = 400_000

#: Words of a shard on average, and different segments up to which an anchor's stay together.
SHARD_WORDS, MOST_SEGMENTS = 250_000, 2_500

#: A segment's start, number of windows and anchor (within it) travel as one number.
_WINDOW_BITS, _ANCHOR_BITS = 6, 6

_POSITION_BITS = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class SegmentFinder:
    """Segments of many word sequences at once."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, anchor
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n + 1:
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
            self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE))])

    def content(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of the words of each stretch, wherever it stands."""
        self._grow(len(words))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.powers[: len(words)], dtype=np.uint64)])
        return mixed((sums[starts + lengths] - sums[starts]) * self.inverses[starts] + lengths.astype(np.uint64))

    def segments(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """start, windows, anchor place, anchor hash and content hash. ends: of each word's sequence."""
        reach = self.window - self.anchor + 1
        runs = run_hashes(words, self.anchor)
        if len(runs) < reach:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        least = (runs << np.uint64(_POSITION_BITS)) | np.arange(len(runs), dtype=np.uint64)
        span = 1
        while span * 2 <= reach:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
        starts = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= self.window)
        places = (least[starts] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(starts) else starts
        windows = np.diff(np.concatenate([new, [len(starts)]]))
        first, place = starts[new], places[new]
        return first, windows, place, runs[place], self.content(words, first, windows + self.window - 1)


def segment_places(docs: DataFrame) -> DataFrame:
    """id, text_hash, place (see place_parts), anchor and segment of all segments of all documents."""

    def found(finder: SegmentFinder, batch: pd.DataFrame, pieces: list[tuple]) -> pd.DataFrame:
        words = np.concatenate([p[2] for p in pieces])
        sizes = np.array([len(p[2]) for p in pieces])
        bounds = np.cumsum(sizes)
        first, windows, place, anchor, segment = finder.segments(words, np.repeat(bounds, sizes))
        owner = np.searchsorted(bounds, first, "right")
        shift = np.array([p[1] for p in pieces], np.int64) - (bounds - sizes)
        row = np.array([p[0] for p in pieces], np.int64)[owner]
        return pd.DataFrame({
            "id": exact_ids(batch, row), "text_hash": batch["text_hash"].to_numpy(np.int64)[row],
            "place": ((first + shift[owner]) << _WINDOW_BITS | windows) << _ANCHOR_BITS | place - first,
            "anchor": signed(anchor), "segment": signed(segment),
        })

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, finder = WordHashes(), SegmentFinder()
        for batch in batches:
            pieces, size = [], 0
            for row, text in enumerate(batch["text"]):
                words = text_bytes(text).split()
                for at in range(0, max(len(words) - WINDOW + 1, 0), BLOCK):  # pieces hold different windows
                    part = hashes.of(words[at : at + BLOCK + WINDOW - 1])
                    pieces.append((row, at, part))
                    size += len(part)
                    if size >= BLOCK:
                        yield found(finder, batch, pieces)
                        pieces, size = [], 0
            if pieces:
                yield found(finder, batch, pieces)

    rows = docs.select(document_key().alias("key"), "text").select(*id_parts(F.col("key.id")), "key.text_hash", "text")
    return rows.mapInPandas(find, "id long, text_hash long, place long, anchor long, segment long")


def place_parts() -> dict[str, Column]:
    """start, windows and anchor_at out of place."""
    return {
        "start": F.shiftright("place", _WINDOW_BITS + _ANCHOR_BITS),
        "windows": F.shiftright("place", _ANCHOR_BITS).bitwiseAND((1 << _WINDOW_BITS) - 1).cast("int"),
        "anchor_at": F.col("place").bitwiseAND((1 << _ANCHOR_BITS) - 1).cast("int"),
    }


def cut_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of wanted, and the words of each segment in it. wanted: key, start, windows, anchor_at, anchor, segment, weight, crowded."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "anchor_at", "anchor", "segment", "weight", "crowded")).alias("cuts"))
    texts = docs.select(document_key().alias("doc"), "text")
    both = texts.join(lists, F.col("doc") == F.col("key"))
    rows = both.groupBy("key").agg(F.first("text").alias("text"), F.first("cuts").alias("cuts")).select("text", "cuts")  # of repeated rows one

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, cuts in zip(batch["text"], batch["cuts"]):
                words = text_bytes(text).split()
                for c in cuts:
                    start, windows, anchor_at, anchor, segment, weight, crowded = (c[k] for k in ("start", "windows", "anchor_at", "anchor", "segment", "weight", "crowded"))
                    if crowded:
                        for i in range(windows):
                            rows.append((anchor, segment, i, 1, anchor_at - i, weight, True, b" ".join(words[start + i : start + i + WINDOW])))
                    else:
                        rows.append((anchor, segment, 0, windows, anchor_at, weight, False, b" ".join(words[start : start + windows + WINDOW - 1])))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["anchor", "segment", "first", "windows", "anchor_at", "weight", "crowded", "words"])
                    rows = []
            yield pd.DataFrame(rows, columns=["anchor", "segment", "first", "windows", "anchor_at", "weight", "crowded", "words"])

    return rows.mapInPandas(cut, "anchor long, segment long, first int, windows int, anchor_at int, weight long, crowded boolean, words binary")


def search_shards(segments: DataFrame, shard: str) -> DataFrame:
    """identity and a bit for each of its windows that occurs twice or more in its shard.

    segments: shard, identity (a struct), windows, anchor_at, weight and words.
    """

    def search(part: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        sequences = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words.split()], np.int64) for words in part["words"]]
        index = FMIndex(sequences, part["weight"].to_numpy())
        found = repeated_windows(index, WINDOW, part["anchor_at"].to_numpy(np.int64), ANCHOR)
        bits = [int(np.packbits(f, bitorder="little").astype(np.uint64).dot(np.uint64(1) << np.arange(0, 8 * -(-len(f) // 8), 8, dtype=np.uint64))) for f in found]
        return pd.DataFrame({"a": part["a"], "b": part["b"], "repeated": np.array(bits, np.int64)})

    return segments.groupBy(shard).applyInPandas(search, "a long, b long, repeated long")


def candidate_places(docs: DataFrame) -> DataFrame:
    """The places of segments whose anchor stands more than once: id, text_hash, place, anchor, segment and n, the rows that are equal in all that.

    Two passes of a filter leave these and fewer than one in a hundred of the others, which no search will find repeated; with
    more places than a filter is made for, a join on the counted anchors leaves these alone.
    """
    places = staged(segment_places(docs)).withColumnRenamed("anchor", "digest")
    first = staged(possible(places, 1)[0])
    if places.count() <= exact_dedup.ROWS_PER_WORD * exact_dedup.MOST_WORDS:
        found = possible(first, 2)[0].withColumnRenamed("digest", "anchor")
    else:
        some = first.withColumnRenamed("digest", "anchor")
        # joined on structs, so that the places of a frequent anchor can be split over tasks
        twice = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.struct("anchor").alias("of"))
        found = some.withColumn("at", F.struct("anchor")).join(twice, F.col("at") == F.col("of"), "left_semi")
    return found.groupBy("id", "text_hash", "place", "anchor", "segment").agg(F.count(F.lit(1)).alias("n"))


UNIT = "id long, no_id boolean, text_hash long, start long, a long, b long, inside array<struct<offset: long, anchor: long, segment: long>>"


def unit_places(candidates: DataFrame) -> DataFrame:
    """Where the units of each document start: single segments (a, b are anchor and segment) and what lies between
    the first and the last segment of a run (a, b are a hash, inside has its segments)."""
    lists = candidates.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("place", "anchor", "segment"))).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found")
            ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))
            place, anchor, segment = (found.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("place", "anchor", "segment"))
            start, windows = place >> (_WINDOW_BITS + _ANCHOR_BITS), place >> _ANCHOR_BITS & ((1 << _WINDOW_BITS) - 1)
            apart = np.ones(len(place) + 1, bool)
            apart[1:-1] = start[1:] != start[:-1] + windows[:-1]
            apart[ends] = True
            runs = np.flatnonzero(apart)
            rows, firsts, a, b, insides = [], [], [], [], []
            for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()):
                row = int(np.searchsorted(ends, lo, "right"))
                for i in range(lo, hi) if hi - lo < 4 else (lo, hi - 1):
                    rows.append(row)
                    firsts.append(int(start[i]))
                    a.append(int(anchor[i]))
                    b.append(int(segment[i]))
                    insides.append([])
                if hi - lo >= 4:
                    offsets = start[lo + 1 : hi - 1] - start[lo + 1]
                    data = b"".join(x.tobytes() for x in (offsets, anchor[lo + 1 : hi - 1], segment[lo + 1 : hi - 1]))
                    code = xxhash.xxh3_128_digest(data)
                    rows.append(row)
                    firsts.append(int(start[lo + 1]))
                    a.append(int.from_bytes(code[:8], "little", signed=True))
                    b.append(int.from_bytes(code[8:], "little", signed=True))
                    insides.append([{"offset": o, "anchor": x, "segment": y} for o, x, y in zip(offsets.tolist(), anchor[lo + 1 : hi - 1].tolist(), segment[lo + 1 : hi - 1].tolist())])
            own = pa.array(rows, pa.int64())
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(own) for c in ("id", "no_id", "text_hash")), *(pa.array(x, pa.int64()) for x in (firsts, a, b)), pa.array(insides, kind)],
                names=["id", "no_id", "text_hash", "start", "a", "b", "inside"],
            )

    rows = lists.select(*id_parts("id"), "text_hash", "found").mapInArrow(cut, UNIT)
    return rows.withColumn("id", F.when(~F.col("no_id"), F.col("id"))).drop("no_id")


def document_reports(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """of (a document's key) and places: the reported starts and bits of all its segments. reports: anchor_, segment_, repeated."""
    units = staged(unit_places(candidates))
    single = F.array(F.struct(F.lit(0).cast("bigint").alias("offset"), F.col("a").alias("anchor"), F.col("b").alias("segment")))
    once = units.groupBy("a", "b").agg(F.first("inside").alias("inside"))
    entries = once.select("a", "b", F.inline(F.when(F.size("inside") == 0, single).otherwise(F.col("inside"))))
    told = entries.withColumn("at", F.struct("anchor", "segment")).join(
        reports.select(F.struct(F.col("anchor_").alias("anchor"), F.col("segment_").alias("segment")).alias("reported"), "repeated"), F.col("at") == F.col("reported")
    )
    reported = told.groupBy(F.struct("a", "b").alias("unit")).agg(F.collect_list(F.struct("offset", "repeated")).alias("found"))
    placed = units.select("id", "text_hash", "start", F.struct("a", "b").alias("own")).join(reported, F.col("own") == F.col("unit"))
    there = F.transform("found", lambda f: F.struct((F.col("start") + f["offset"]).alias("start"), f["repeated"].alias("repeated")))
    return placed.select(F.struct("id", "text_hash").alias("of"), there.alias("there")).groupBy("of").agg(F.flatten(F.collect_list("there")).alias("places"))


def segment_reports(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """anchor_, segment_ and repeated: a bit for each window of a segment that occurs anywhere else; segments without one are left out."""
    segments = staged(candidates.groupBy("anchor", "segment").agg(
        F.sum("n").alias("weight"), F.min(F.struct("id", "text_hash", "place")).alias("one")
    ).select("anchor", "segment", "weight", "one.*").select(
        "anchor", "segment", "weight", F.struct("id", "text_hash").alias("key"), *[c.alias(n) for n, c in place_parts().items()]
    ))
    crowds = staged(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_SEGMENTS).select(F.col("anchor").alias("of")))
    any_crowd = not crowds.isEmpty()
    crowded = segments.join(crowds, F.col("anchor") == F.col("of"), "left").withColumn("crowded", F.col("of").isNotNull()).drop("of")
    size = segments.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    cut = staged(cut_words(docs, crowded if any_crowd else segments.withColumn("crowded", F.lit(False))))

    gathered = cut.where("not crowded").select(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.col("anchor").alias("a"), F.col("segment").alias("b"),
        "windows", "anchor_at", "weight", "words",
    )
    whole = search_shards(gathered, "shard").select(F.col("a").alias("anchor_"), F.col("b").alias("segment_"), "repeated").where("repeated > 0")
    if not any_crowd:
        return whole

    single = cut.where("crowded").withColumn("window", F.xxhash64("words"))
    merged = single.groupBy("anchor", "window").agg(
        F.sum("weight").alias("weight"), F.first("words").alias("words"), F.first("anchor_at").alias("anchor_at")
    )
    alone = search_shards(merged.select(
        F.pmod(F.xxhash64("anchor", "window"), F.lit(shards)).alias("shard"), F.col("anchor").alias("a"), F.col("window").alias("b"),
        F.lit(1).alias("windows"), "anchor_at", "weight", "words",
    ), "shard").where("repeated > 0")
    back = single.select("anchor", "segment", "first", "window").join(alone, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("b"))).groupBy(
        F.col("anchor").alias("anchor_"), F.col("segment").alias("segment_")
    ).agg(F.bit_or(F.expr("shiftleft(1L, first)")).alias("repeated"))
    return whole.unionByName(back)


def repeated_places(docs: DataFrame) -> DataFrame:
    """of (a document's key) and places: a list of start and bits of the windows from there that occur anywhere else.

    Each step is written before the next one begins; then what it was made from, and its shuffle files, go.
    """
    spark = docs.sparkSession

    def steps() -> DataFrame:
        candidates = staged_last(spark, lambda: candidate_places(docs))
        return document_reports(candidates, staged_last(spark, lambda: segment_reports(docs, candidates)))

    return staged_last(spark, steps)


def kept_words(text: str | None, places: object) -> tuple[int, list[bytes]]:
    """The number of words of a text and those that no reported window covers."""
    words = text_bytes(text).split()
    if places is None or not len(places):
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    starts, bits = (np.array([place[k] for place in places], np.int64) for k in ("start", "repeated"))
    row, at = np.nonzero(bits[:, None] >> np.arange(int(bits.max()).bit_length()) & 1)
    at += starts[row]
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return len(words), [words[i] for i in np.flatnonzero(~covered)]


def with_places(docs: DataFrame) -> DataFrame:
    found = repeated_places(docs)
    found = found.select(F.col("of").alias("__of"), F.col("places").alias("__places"))
    return docs.withColumn("__doc", document_key()).join(found, F.col("__doc") == F.col("__of"), "left").drop("__of")


def deduplicate_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, places in zip(batch["text"], batch["places"]):
                n, kept = kept_words(text, places)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", exact_ids(batch))
            yield out

    rows = with_places(docs.select("doc_id", "text")).select(*id_parts(F.col("__doc.id")), "text", F.col("__places").alias("places"))
    return rows.mapInPandas(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept words, joined by single spaces, as text; texts that lose nothing stay as they
    are, rows without a word left go. n_chars follows the text, other columns stay."""

    @F.pandas_udf(T.StringType())
    def kept(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, p)[1]).decode("utf-8", "surrogatepass") for t, p in zip(texts, places)], dtype=object)

    found = with_places(docs)
    cut = found.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept("text", "__places"))).drop("__places", "__doc")
    left = cut.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return left.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else left
