"""Periodic run detection by a dictionary of basic factors.

Words of a batch of documents become numbers. For each power of two m, every stretch of m words (a basic factor) gets a
name: for m = 1 the word within its document, then the pair of names of its halves, named by sorting. The occurrences of a
factor that meet within twice its length, that is, at most m apart, form an arithmetic progression whose difference proposes
a period. Periods in (m / 2, m] are proposed at length m: there the nearest occurrence is exactly one smallest period away,
so starts that follow one another with the same difference d are one run; it is extended to its end (the last start plus
d + m words). A period belongs to one m, so no run is proposed twice but where two stretches meet, and those are one.
Factors without another occurrence close enough for any run of their document leave before the next length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import ship

ship(__name__)

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are looked at together; a longer text is looked at alone.
BATCH_BYTES = 4 << 20
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """Runs (document, start, length, period) in order of document, start and period, starts counted from `bounds`, which
    holds where each document's words begin in `codes` and at last where they end."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(sizes.size), sizes)
    at = np.arange(codes.size)
    key = doc * (codes.max() + 1 if codes.size else 1) + codes
    names, found, m = np.full(codes.size, -1), [np.empty((4, 0), np.int64)], 1
    while at.size:
        order = np.argsort(key, kind="stable")
        key, place = key[order], at[order]
        same, gap = key[1:] == key[:-1], place[1:] - place[:-1]
        near = same & (gap <= m) & (2 * gap > m)
        begin, step = place[:-1][near], gap[near]
        order = np.lexsort((begin, step))
        begin, step = begin[order], step[order]
        first = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (begin[1:] != begin[:-1] + 1) | (doc[begin[1:]] != doc[begin[:-1]])]) if begin.size else begin
        start, period = begin[first], step[first]
        length = np.diff(np.r_[first, begin.size]) + period + m - 1
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([doc[start], start - bounds[doc[start]], length, period])[:, long])

        close = same & (gap * times <= sizes[doc[place[1:]]])
        again = np.r_[close, False] | np.r_[False, close] if place.size > 1 else np.zeros(place.size, bool)
        rank = np.cumsum(np.r_[0, ~same])
        names.fill(-1)
        names[place[again]] = rank[again]
        at = np.sort(place[again])
        at = at[at + m < codes.size]
        at = at[(names[at + m] >= 0) & (doc[at] == doc[at + m])]
        key = names[at] * (rank[-1] + 1) + names[at + m]
        m *= 2
    runs = np.concatenate(found, axis=1)
    return runs[:, np.lexsort((runs[3], runs[1], runs[0]))]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BATCH_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _worker(key: str, least: int, times: int):
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            split = pc.ascii_split_whitespace(pc.fill_null(piece.column("text").cast(pa.string()), ""))
            words, parent = split.flatten(), np.asarray(pc.list_parent_indices(split))
            real = np.asarray(pc.binary_length(words)) > 0
            words, parent = words.filter(pa.array(real)), parent[real]
            bounds = np.searchsorted(parent, np.arange(piece.num_rows + 1))
            codes = np.asarray(words.dictionary_encode().indices, np.int64)
            doc, start, length, period = find_runs(codes, bounds, least, times)
            cover = np.zeros(codes.size + 1, np.int64)
            np.add.at(cover, bounds[doc] + start + period, 1)
            np.add.at(cover, bounds[doc] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            texts = pa.ListArray.from_arrays(pa.array(np.searchsorted(parent[kept], np.arange(piece.num_rows + 1)), pa.int32()), words.filter(pa.array(kept)))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([piece.column(key), runs, pc.binary_join(texts, " ")], [key, "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", least: int = 6, times: int = 4) -> DataFrame:
    """Each row's `key` with `runs`, an array of (start, length, period), and `collapsed`, the text of the words kept.

    Words are what stands between blanks of ASCII, numbered from 0. A run is a stretch with smallest period q, at least
    max(least, times * q) words long, that no neighbour extends; `times` is 4 or more. Runs stand in order of start, then
    period; `collapsed` leaves out every word that a run contains after its first q words and joins the rest by one space.
    Null and empty texts have no run and an empty `collapsed`. Rows that repeat an id, or have none, are each judged
    alone. Other columns are ignored; an empty table gives no rows. Memory grows with the longest text, not with a batch.
    """
    if times < 4:
        raise ValueError("runs are found from four periods on")
    schema = StructType([docs.schema[key], StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(_worker(key, least, times), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every document whose id's crc32 is a multiple of 10 repeats a stretch of its words to its end.

    With h the crc32 of the id as text and g = h div 10, words from a = g % n on repeat with period
    p = 1 + (n - a) div (3 + g % 8). Rows with a null id, and texts without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w"))
    rows = rows.select("doc_id", "text", "g", "w", F.size("w").cast("long").alias("n")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def word(i: Column) -> Column:
        return F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(runs: DataFrame) -> DataFrame:
    """What `periodic_runs` found, as numbers and digests: the run with the greatest length (ties: smallest start, then
    period), nulls where there is none, and SHA-256 of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = runs.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
