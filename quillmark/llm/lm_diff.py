"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary, all words of the corpus, and are smoothed alike:
p(w | v) = (c(vw) + MU p(w)) / (c(v) + MU) with p(w) = (c(w) + HALF) / (n + HALF V). Counts are exact and their table grows
with the corpus; a document is always scored without its own occurrences, so that neither model has seen it. A
document's score is the mean over its words of the target's loss less the background's: the lower, the more like the
target.

Tasks cut the documents they read into batches of bounded size. A batch counts its distinct words and word pairs and
sends them, packed in arrays and cut by key range, to the tasks that own the ranges; these sum the batches' counts and
answer each batch with the totals of its keys. The documents are then dealt by batch, meet
their batch's answers and are scored. A frequent word is one entry of each batch, so no key is hot, and no table of
counts is sent to all tasks. Keys are digests of 40 bits within a range; ranges grow in number with the corpus, so that
a key meets a foreign one with a chance of some 1e-6 at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_groups, ship, small

ship(__name__)

#: Smoothing: weight of the word's own share in a pair's, and the count added to each word.
MU, HALF = 0.5, 0.5
#: Bytes of text of a batch, and for each range of keys.
BATCH_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
START = b""
#: Bits of a key within its range.
KEY_BITS = 40


def words_of(text: str | None) -> list[bytes]:
    """Lower-case runs of anything but ASCII white space."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


class _Words(dict):
    """64-bit digests of words, the last bit off."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word) & ~1
        return value


class _Batch:
    """Tokens of a batch: `keys`, sorted and distinct, of words (even) and pairs (odd), of KEY_BITS and `bits` bits; of
    each token its document and its places in `keys`, the start mark of each text included."""

    def __init__(self, texts: pa.ChunkedArray, target: np.ndarray, bits: int):
        digest, parts = _Words(), []
        for text in texts:
            found = words_of(text.as_py())
            parts.append(np.fromiter(map(digest.__getitem__, [START, *found]), np.uint64, len(found) + 1) if found else np.empty(0, np.uint64))
        size = np.array([len(part) for part in parts], np.int64)
        word = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        del parts, digest
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.first = np.zeros(len(word), bool)
        self.first[(np.cumsum(size) - size)[size > 0]] = True
        pair = np.zeros_like(word)
        pair[1:] = ((word[:-1] ^ (word[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) ^ (word[1:] * np.uint64(0xD6E8FEB86659FD93))
        pair = ((pair ^ (pair >> np.uint64(32))) | np.uint64(1)) & np.uint64(2 ** (KEY_BITS + bits) - 1)
        word &= np.uint64(2 ** (KEY_BITS + bits) - 1)
        self.later = np.flatnonzero(~self.first)
        self.keys, at = np.unique(np.concatenate([word, pair[self.later]]), return_inverse=True)
        at = at.ravel()
        self.word, self.pair = at[: len(word)], at[len(word) :]
        self.counts = np.zeros((2, len(self.keys)), np.int64)
        self.size, self.target = size, target
        for k, own in enumerate((np.ones(len(texts)), target)):
            self.counts[k] = np.bincount(self.word, own[self.doc], len(self.keys)) + np.bincount(self.pair, own[self.doc[self.later]], len(self.keys))

    def own(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each token's key occurs in its own document."""
        _, back, count = np.unique(doc * len(self.keys) + at, return_inverse=True, return_counts=True)
        return count[back.ravel()]

    def losses(self, totals: dict) -> np.ndarray:
        """(2, documents): mean loss of the background and of the target model; nan without words."""
        later, word, doc = self.later, self.word, self.doc
        own_word, own_pair = self.own(doc, word), self.own(doc[later], self.pair)
        out = np.full((2, len(self.size)), np.nan)
        n = np.maximum(self.size - 1, 0)
        for k, mine in enumerate((np.ones(len(self.size)), self.target)):
            own = mine[doc[later]]
            alone = (self.counts[k][word[later]] - own * own_word[later] + HALF) / (totals["n"][k] - own * self.size[doc[later]] + HALF * totals["types"])
            context = self.counts[k][word[later - 1]] - own * own_word[later - 1]
            p = (self.counts[k][self.pair] - own * own_pair + MU * alone) / (context + MU)
            out[k][n > 0] = np.bincount(doc[later], -np.log(p), len(n))[n > 0] / n[n > 0]
        return out


    def slices(self, bits: int) -> tuple[np.ndarray, list[slice]]:
        """The ranges of keys that occur, and the part of `keys` in each."""
        ranges = (self.keys >> np.uint64(KEY_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else np.empty(0, np.int64)
        return ranges[starts], [slice(a, b) for a, b in zip(starts, [*starts[1:], len(ranges)])]


def _low(keys: np.ndarray) -> bytes:
    """The bits of keys within their range, five bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // (KEY_BITS // 8), 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


def _bytes(counts: np.ndarray) -> bytes:
    """Counts of a byte each; those from 255 on follow in eight bytes, in order."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of runs of a task's rows that end where BATCH_BYTES of text are reached."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        ends = np.cumsum([0 if x is None else x for x in pc.binary_length(length).to_pylist()]) if batch.num_rows else []
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, base + BATCH_BYTES - size)) + 1
            held.append(batch.slice(begin, end - begin))
            last = min(end, batch.num_rows) - 1
            size, base, begin = size + int(ends[last]) - base, int(ends[last]), last + 1
            if size >= BATCH_BYTES:
                yield number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _asked(bits: int):
    """Each batch's counts, a row for each range of keys that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _batches(batches):
            batch = _Batch(rows.column("text"), rows.column("target").to_numpy(), bits)
            ranges, cuts = batch.slices(bits)
            counts = [pa.array([_bytes(batch.counts[k][x]) for x in cuts], pa.binary()) for k in (0, 1)]
            columns = [pa.array(ranges), pa.array(np.full(len(ranges), number)), pa.array([_low(batch.keys[x]) for x in cuts], pa.binary()), *counts]
            yield pa.RecordBatch.from_arrays(columns, ["range", "batch", "keys", "background", "target"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their batch."""
    for number, rows in _batches(batches):
        for part in rows.to_batches():
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, number))], [*part.schema.names, "batch"])


def _answered(group: pa.Table) -> dict | None:
    """Sums a range's counts and answers each batch with the totals of its keys, in their order; a row of batch -1 has the
    range's words and their counts."""
    every = [_wide(x) for x in group.column("keys").to_pylist()]
    counts = [np.concatenate([_counts(x, len(own)) for x, own in zip(group.column(name).to_pylist(), every)]) for name in ("background", "target")]
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    at = at.ravel()
    sums = [np.bincount(at, c, len(keys)).astype(np.int64) for c in counts]  # exact below 2^53
    found: dict[str, list] = {"batch": [-1], "size": [0], "background": [b""], "target": [b""]}
    begin = 0
    for batch, own in zip(group.column("batch").to_pylist(), every):
        part = slice(begin, begin + len(own))
        begin += len(own)
        for name, value in zip(found, (batch, len(own), *(_bytes(x[at[part]]) for x in sums))):
            found[name].append(value)
    words = keys % np.uint64(2) == 0
    about = {"types": int(words.sum()), "n_background": int(sums[0][words].sum()), "n_target": int(sums[1][words].sum())}
    rows = len(found["batch"])
    names = {name: pa.array([group.column("range")[0].as_py()] * rows) if name == "range" else pa.array(found[name], pa.int64()) for name in ("range", "batch", "size")}
    return names | {name: pa.array(found[name], pa.binary()) for name in ("background", "target")} | {name: pa.array([value] + [0] * (rows - 1), pa.int64()) for name, value in about.items()}


def _scored(totals: dict, bits: int):
    """Scores a batch's documents; rows without a text are its answers."""

    def work(group: pa.Table) -> dict | None:
        answers = group.column("answer").to_numpy(zero_copy_only=False).astype(bool)
        texts, known = group.filter(pa.array(~answers)), group.filter(pa.array(answers))
        if not texts.num_rows:
            raise RuntimeError("the documents were read in another order than before")
        batch = _Batch(texts.column("text"), texts.column("target").to_numpy(), bits)
        cuts = dict(zip(*batch.slices(bits)))
        for at, size, *sums in zip(*(known.column(name).to_pylist() for name in ("range", "size", "background", "of_target"))):
            part = cuts.get(at, slice(0, 0))
            if part.stop - part.start != size:
                raise RuntimeError("the documents were read in another order than before")
            for k, found in enumerate(sums):
                batch.counts[k][part] = _counts(found, size)
        background, target = (pa.array(x, pa.float64(), mask=np.isnan(x)) for x in batch.losses(totals))
        return {"doc_id": texts.column("doc_id").combine_chunks(), "n_tokens": np.maximum(batch.size - 1, 0), "target_loss": target, "background_loss": background}

    return work


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of each row of `docs`, in nats a word.

    `target` names by doc_id the rows of `docs` of the target corpus; all of `docs` are the background. Null, empty and
    blank texts have 0 tokens and null losses. With an empty target corpus the target model holds all words alike. Rows
    that repeat are each counted and returned; a null doc_id is never a target; other columns are ignored; an empty table
    gives no rows.
    """
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    chosen = small(cut(target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()))
    rows = asked.join(chosen.withColumn("target", F.lit(1)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target"))

    counts = rows.mapInArrow(_asked(bits), "range long, batch long, keys binary, background binary, target binary")
    schema = "range long, batch long, size long, background binary, target binary, types long, n_background long, n_target long"
    answers = cut(in_groups(counts, ["range"], _answered, schema))
    sums = answers.where("batch < 0").agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("types", "n_background", "n_target")]).first()
    totals = {"types": sums["types"], "n": (sums["n_background"], sums["n_target"])}

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    texts = rows.mapInArrow(_numbered, "doc_id long, text string, target int, batch long")
    texts = texts.select("batch", F.lit(False).alias("answer"), "doc_id", "text", "target", none("long").alias("range"), none("long").alias("size"), *(none("binary").alias(name) for name in ("background", "of_target")))
    known = answers.where("batch >= 0").select("batch", F.lit(True), none("long"), none("string"), F.lit(0), "range", "size", "background", "target")
    found = in_groups(texts.union(known), ["batch"], _scored(totals, bits), "doc_id long, n_tokens long, target_loss double, background_loss double")
    return found.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
