"""Substring dedup by recompression: words that a repeated window of words covers, all but its first occurrence, are removed.

Rounds name runs of one symbol, then pairs of neighbours of which the first falls to the left and the second to the right half
of the names, as a bit of the name's digest for the round says. A name is a digest of what it stands for, so it is the same in
every task and document without a dictionary; it carries the range of words that decided it. A window that repeats holds
the same names in both places wherever that range lies within it. Each window takes as its anchor the longest name inside
(ties: by digest), which its words alone decide, so equal windows have equal anchors. An anchor that occurs once in the
corpus proves that its windows do not repeat: only those of shared anchors, and the few without any, are verified, by a
128-bit digest of their words, of which the smallest document keeps the first.

No step groups the copies of a passage: names are counted and digests reduced to their smallest document with combining
before the shuffle; what goes back to documents are names that occur once and digests that a document keeps, each one row
for one document. Of whole copies of a document, found by the digest of all its names, only the first takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

#: Bytes of text that are looked at together; a longer text is looked at alone.
BATCH_BYTES = 4 << 20
FAR = 1 << 60


def _mix(a: np.ndarray, b) -> np.ndarray:
    """A digest of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(b) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _fold(digests: np.ndarray, at: np.ndarray, parts: int, part: np.ndarray) -> np.ndarray:
    """For each of `parts`, a digest of its `digests` and their places `at` in it."""
    out = np.zeros(parts, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, part, _mix(digests, at.astype(np.uint64)))
    return out


class Words:
    """The words of a batch of texts: `digests`, two 64-bit numbers of each, `doc` of each, and `bounds` of the documents."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words, doc = split.flatten(), np.asarray(pc.list_parent_indices(split))
        real = np.asarray(pc.binary_length(words)) > 0
        self.words, self.doc, self.docs = words.filter(pa.array(real)), doc[real], len(texts)
        self.bounds = np.searchsorted(self.doc, np.arange(self.docs + 1))
        coded = self.words.dictionary_encode()
        self.codes = np.asarray(coded.indices, np.int64)
        raw = b"".join([xxhash.xxh3_128_digest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()])
        self.digests = np.frombuffer(raw, np.uint64).reshape(-1, 2)[self.codes].T if raw else np.empty((2, 0), np.uint64)

    def windows(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Two digests of the `size` words from each of `starts`."""
        out = np.zeros((2, starts.size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out[0] += _mix(self.digests[0][starts + k], k + 1)
                out[1] += _mix(self.digests[1][starts + k], k + 1)
        return out[0], out[1]


def recompress(words: Words, rounds: int) -> tuple[np.ndarray, ...]:
    """Symbols (name, start, end, low, high, document) after `rounds`; words from `low` on and before `high` decide the symbol, so
    it is found wherever those words stand. Beyond a document's ends nothing is known, so low or high is far off there."""
    codes = words.codes
    start = np.arange(codes.size)
    name, end, low, high, doc = words.digests[0].copy(), start + 1, start.copy(), start + 1, words.doc
    for r in range(rounds):
        if not name.size:
            break
        # runs: that a neighbour differs shows in its nearest word, or else takes all that decides the neighbour
        first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
        after = np.r_[first[1:], name.size]
        many = after - first
        before, then = np.maximum(first - 1, 0), np.minimum(after, name.size - 1)
        s, e, d = start[first], end[after - 1], doc[first]
        left = np.where(codes[np.maximum(s - 1, 0)] != codes[e - 1], np.minimum(low[first], s - 1), np.minimum(low[first], low[before]))
        right = np.where(codes[np.minimum(e, codes.size - 1)] != codes[s], np.maximum(high[after - 1], e + 1), np.maximum(high[after - 1], high[then]))
        low = np.where((first > 0) & (doc[before] == d), left, -FAR)
        high = np.where((after < name.size) & (doc[then] == d), right, FAR)
        name, start, end, doc = np.where(many == 1, name[first], _mix(name[first], many.astype(np.uint64))), s, e, d
        # pairs: a right symbol stays alone only behind a right one, a left one only before a left one
        alike = doc[1:] == doc[:-1]
        is_left = (_mix(name, 1000 + r) >> np.uint64(17)) & np.uint64(1) == 0
        pair = np.r_[is_left[:-1] & ~is_left[1:] & alike, False]
        second = np.r_[False, pair[:-1]]
        previous = np.r_[-FAR, np.where(alike, np.minimum(low[1:], low[:-1]), -FAR)]
        following = np.r_[np.where(alike, np.maximum(high[1:], high[:-1]), FAR), FAR]
        p = np.flatnonzero(pair)
        paired = _mix(name[p], name[p + 1]), end[p + 1], np.minimum(low[p], low[p + 1]), np.maximum(high[p], high[p + 1])
        low, high = np.where(~is_left & ~second, previous, low), np.where(is_left & ~pair, following, high)
        name, end, low, high = name.copy(), end.copy(), low.copy(), high.copy()
        name[p], end[p], low[p], high[p] = paired
        name, start, end, low, high, doc = (x[~second] for x in (name, start, end, low, high, doc))
    return name, start, end, low, high, doc


def anchors(words: Words, symbols: tuple[np.ndarray, ...], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of `size` words, the name that anchors each, and where that stands: the longest of those that the window's
    words decide, of equally long ones the one with the largest digest, of equal ones the first; 0 and -1 where there is none."""
    name, start, end, low, high, _ = symbols
    n = words.codes.size
    rank, lows, highs, names = np.zeros(n, np.uint64), np.full(n, -FAR), np.full(n, FAR), np.zeros(n, np.uint64)
    rank[start] = (np.minimum(end - start, 255).astype(np.uint64) << np.uint64(56)) | (_mix(name, 1) >> np.uint64(8))
    lows[start], highs[start], names[start] = low, high, name
    windows = np.arange(max(0, n - size + 1))
    best, place = np.zeros(windows.size, np.uint64), np.full(windows.size, -1)
    for k in range(size):
        here = slice(k, k + windows.size)
        better = (lows[here] >= windows) & (highs[here] <= windows + size) & (rank[here] > best)
        best[better] = rank[here][better]
        place[better] = windows[better] + k
    real = words.doc[windows] == words.doc[windows + size - 1]
    return windows[real], np.where(place[real] >= 0, names[place[real]], np.uint64(0)), place[real]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BATCH_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _lists(values: np.ndarray, doc: np.ndarray, docs: int, kind: pa.DataType) -> pa.ListArray:
    """`values`, in order of their `doc`, as one list a document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), pa.array(values, kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _parsed(size: int, rounds: int):
    """Of each document of at least `size` words its digest and its stretches of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            symbols = recompress(words, rounds)
            begins = np.searchsorted(symbols[5], np.arange(words.docs + 1))
            whole = _fold(symbols[0], np.arange(symbols[0].size) - begins[symbols[5]], words.docs, symbols[5])
            plain = _fold(words.digests[1], np.arange(words.doc.size) - words.bounds[words.doc], words.docs, words.doc)
            start, name, place = anchors(words, symbols, size)
            doc = words.doc[start]
            # by the place of the anchor, as a name that follows itself occurs more than once
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]) if start.size else start
            last = np.r_[first[1:], start.size] - 1 if start.size else first
            at = doc[first]
            long = pa.array(np.diff(words.bounds) >= size)
            arrays = [piece.column("k"), pa.array(_signed(whole)), pa.array(_signed(plain)), _lists(_signed(name[first]), at, words.docs, pa.int64())]
            arrays += [_lists(start[x] - words.bounds[at], at, words.docs, pa.int32()) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([x.filter(long) for x in arrays], ["k", "whole", "plain", "names", "since", "until"])

    return run


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the stretches of windows whose anchor is not among the names that occur once."""
    for batch in batches:
        names, since, until, once = (batch.column(c) for c in ("names", "since", "until", "once"))
        doc, seen = np.asarray(pc.list_parent_indices(names)), np.asarray(pc.list_parent_indices(once))
        # a name that occurs once stands in one document, whose row alone was sent it
        still = ~np.isin(np.asarray(names.flatten()), np.asarray(once.flatten())) if seen.size else np.ones(doc.size, bool)
        doc = doc[still]
        arrays = [batch.column("k"), *(_lists(np.asarray(x.flatten())[still], doc, batch.num_rows, pa.int32()) for x in (since, until))]
        some = pa.array(np.bincount(doc, minlength=batch.num_rows) > 0)
        yield pa.RecordBatch.from_arrays([x.filter(some) for x in arrays], ["k", "since", "until"])


def _starts(piece: pa.RecordBatch, words: Words) -> np.ndarray:
    """The starts, in the batch's words, of the windows in the stretches since..until of each document."""
    since, until = piece.column("since"), piece.column("until")
    doc = np.asarray(pc.list_parent_indices(since))
    low, high = np.asarray(since.flatten(), np.int64), np.asarray(until.flatten(), np.int64)
    many = high - low + 1
    return np.repeat(words.bounds[doc] + low - np.cumsum(many) + many, many) + np.arange(many.sum())


def _verified(size: int):
    """Digests of the windows to verify, each once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            start = _starts(piece, words)
            x, y = words.windows(start, size)
            doc = words.doc[start]
            order = np.lexsort((x, doc))
            order = order[np.flatnonzero(np.r_[True, (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])])] if order.size else order
            yield pa.RecordBatch.from_arrays([piece.column("k").take(pa.array(doc[order])), pa.array(_signed(x[order])), pa.array(_signed(y[order]))], ["k", "x", "y"])

    return run


def _removed(key: str, size: int):
    """Lay out what goes: windows to verify whose digest the document does not keep, or holds before, and whole copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            words = Words(piece.column("text"))
            start = _starts(piece, words)
            x = _signed(words.windows(start, size)[0])
            doc = words.doc[start]
            kept = piece.column("kept")
            owner, mine = np.asarray(pc.list_parent_indices(kept)), np.asarray(kept.flatten(), np.int64)
            # windows by document and digest, the first of each at its place; then those among what the document keeps
            order = np.lexsort((start, x, doc))
            first = np.r_[True, (x[order][1:] != x[order][:-1]) | (doc[order][1:] != doc[order][:-1])] if order.size else np.zeros(0, bool)
            stays = np.zeros(start.size, bool)
            pairs = np.rec.fromarrays([np.r_[doc[order[first]], owner], np.r_[x[order[first]], mine]])
            _, inverse, times = np.unique(pairs, return_inverse=True, return_counts=True)
            stays[order[first]] = times[inverse[: int(first.sum())]] == 2
            cover = np.zeros(words.doc.size + 1, np.int64)
            gone = start[~stays]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + size, -1)
            copy = np.asarray(pc.fill_null(piece.column("copy"), False))
            gone = (np.cumsum(cover[:-1]) > 0) | copy[words.doc]
            edge = np.r_[True, (gone[1:] != gone[:-1]) | (words.doc[1:] != words.doc[:-1])] if gone.size else gone
            begin = np.flatnonzero(edge)
            end = np.r_[begin[1:], gone.size] if gone.size else begin
            out = gone[begin]
            begin, end = begin[out], end[out]
            at = words.doc[begin]
            spans = pa.StructArray.from_arrays([pa.array(begin - words.bounds[at]), pa.array(end - words.bounds[at])], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(words.docs + 1)), pa.int32()), spans)
            left = words.words.filter(pa.array(~gone))
            texts = pa.ListArray.from_arrays(pa.array(np.searchsorted(words.doc[~gone], np.arange(words.docs + 1)), pa.int32()), left)
            yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(np.diff(words.bounds)), spans, pc.binary_join(texts, " ")], [key, "n_words", "removed", "kept"])

    return run


def _place(key: str) -> Column:
    """One number for each id and text, in the order of ids, nulls last; the texts of one id follow in a fixed order."""
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 60) - 1))
    each = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (each * F.lit(1 << 60).cast("decimal(19,0)") + digest.cast("decimal(20,0)")).cast("decimal(38,0)")


def without_repeats(docs: DataFrame, key: str = "doc_id", size: int = 20) -> DataFrame:
    """Each row's `key`, an integer, with `n_words`, `removed`, its spans (start, end) of removed words, and `kept`, the other words joined by one space.

    Words are what stands between blanks of ASCII. A word is removed if a window of `size` words that covers it stands
    earlier as well: in a row with a smaller id, or further to the front of its own. All windows are judged on the input. Null ids
    come last. Of rows with one id and different texts one, by a digest, counts as the earlier; rows that repeat an id and a
    text are one document and treated alike. Null and empty texts have no words and keep an empty text. Other columns are
    ignored; an empty table gives no rows. Memory grows with the longest text, not with a group of copies.
    """
    rounds = max(1, int(np.log(size / 5) / np.log(4 / 3)))
    rows = docs.select(key, F.col("text").cast("string").alias("text")).withColumn("k", _place(key))
    parsed = cut(rows.select("k", "text").mapInArrow(_parsed(size, rounds), "k decimal(38,0), whole long, plain long, names array<long>, since array<int>, until array<int>"))
    firsts = cut(parsed.groupBy("whole", "plain").agg(F.min("k").alias("k")).select("k"))

    ours = parsed.join(firsts, "k", "left_semi").withColumn("address", F.xxhash64("k")).select("address", "k", "names", "since", "until")
    once = ours.select("address", F.explode("names").alias("name")).where("name <> 0").groupBy("name").agg(F.count("*").alias("n"), F.max("address").alias("address"))
    once = once.where("n = 1").groupBy("address").agg(F.collect_list("name").alias("once"))
    none = F.array().cast("array<long>")
    stretches = ours.join(once, "address", "left").select("k", "names", "since", "until", F.coalesce("once", none).alias("once"))
    stretches = stretches.mapInArrow(_open, "k decimal(38,0), since array<int>, until array<int>")
    stretches = cut(stretches.groupBy("k").agg(F.first("since").alias("since"), F.first("until").alias("until")))

    found = rows.join(stretches, "k").mapInArrow(_verified(size), "k decimal(38,0), x long, y long")
    keeps = found.groupBy("x", "y").agg(F.min("k").alias("k")).groupBy("k").agg(F.collect_list("x").alias("kept"))
    copies = parsed.select("k").distinct().join(firsts, "k", "left_anti").withColumn("copy", F.lit(True))
    ints = F.array().cast("array<int>")
    told = rows.join(stretches, "k", "left").join(keeps, "k", "left").join(copies, "k", "left")
    told = told.select(key, "text", F.coalesce("since", ints).alias("since"), F.coalesce("until", ints).alias("until"), F.coalesce("kept", none).alias("kept"), "copy")
    kind = docs.schema[key].dataType.simpleString()
    return told.mapInArrow(_removed(key, size), f"`{key}` {kind}, n_words long, removed array<struct<start:long,end:long>>, kept string")


def removal_digests(rows: DataFrame) -> DataFrame:
    """What `without_repeats` found, as numbers and a SHA-256 of the text kept."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB SQL, by numbering the places of every window's words; for documents with distinct ids.
SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' '))) as s, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
r as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as place from s),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from r where place > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n.n, 0)::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join n using (doc_id) left join kept using (doc_id)
"""
