"""An interpolated bigram model trained on the corpus by aggregation, and a document's surprise under it."""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions import text as T
from ..functions.features import _sentences
from ..sources.folders import scratch

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = "<s>"


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, sent, v, w): each word with the one before it in the document, START before the first. A document's words are
    numbered inside its row, so nothing is shuffled."""
    named = lambda s, sent: F.transform(T.words(s), lambda w: F.struct(sent.alias("sent"), w.alias("w")))
    rows = docs.select("doc_id", F.flatten(F.transform(T.sentences(F.coalesce("text", F.lit(""))), named)).alias("words"))
    before = F.concat(F.array(F.lit(START)), F.transform("words", lambda x: x["w"]))
    rows = rows.select("doc_id", F.explode(F.arrays_zip(F.col("words").alias("x"), before.alias("v"))).alias("t"))
    return rows.where("t.x is not null").select("doc_id", "t.x.sent", "t.v", "t.x.w")


#: A key with more than one part in so many of all rows is dealt to several tasks.
PARTS = 10_000


def frequent(rows: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """(*keys, _parts) of keys that make up more than 1 / parts of the rows, which are fewer than `parts`: how many tasks each
    is dealt to, so that none gets more than that share. For broadcasts."""
    return weighty(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, parts)


def weighty(counts: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """`frequent` from the count `n` of each key."""
    counts = counts.select(*keys, F.col("n").alias("_n"))
    most = F.broadcast(counts.agg(F.sum("_n").alias("_all")))  # one row
    share = F.col("_n") * parts / F.col("_all")
    return F.broadcast(counts.crossJoin(most).where(share > 1).select(*keys, F.ceil(share).cast("int").alias("_parts")))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], heads: DataFrame, by: list[str]) -> DataFrame:
    """`left` with the row of `right`, unique in `keys`, that has its keys, or nulls. Rows of `left` with a key of `heads` are dealt by a
    digest of `by`, and the key's row of `right` is copied to each of its parts, fewer than twice `PARTS` copies in all."""
    one = F.coalesce("_parts", F.lit(1))
    dealt = left.join(heads, keys, "left").withColumn("_at", F.pmod(F.xxhash64(*by), one).cast("int")).drop("_parts")
    copied = right.join(heads, keys, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_at"], "left").drop("_at")


def fit(toks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bigrams (v, w, n), predecessors (v, of_v, least), words (w, n_w)): counts; `least` holds, for ranks below 1, 10, 100
    and 1000 among the successors of v by falling count, ties alike, the least count that still has one. Ranks come from
    how many successors have a count, so no task sorts all successors of a frequent word."""
    pairs = toks.where(F.col("v") != START).groupBy("v", "w").agg(F.count("*").alias("n"))
    return pairs, ranks(pairs), toks.groupBy("w").agg(F.count("*").alias("n_w"))


def ranks(pairs: DataFrame) -> DataFrame:
    """The predecessors of `fit` from its bigrams."""
    return ranked(pairs.groupBy("v", "n").agg(F.count("*").alias("k")))


def ranked(same: DataFrame) -> DataFrame:
    """`ranks` from (v, n, k), the number k of successors of v that have the count n."""
    above = F.coalesce(F.sum("k").over(Window.partitionBy("v").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumn("rank", above)
    least = F.array(*[F.min(F.when(F.col("rank") < most, F.col("n"))) for most in (1, 10, 100, 1000)])
    return placed.groupBy("v").agg(F.sum(F.col("n") * F.col("k")).alias("of_v"), least.alias("least"))


#: Tokens of documents that are asked about together, and a word's tokens from which its successors are dealt to several tasks.
CHUNK, DEALT = 2_000_000, 1_000_000
#: Rows or successors that are counted together, as soon as they are whole groups.
HELD = 1_000_000


def _words(text: str | None) -> list[list[bytes]]:
    """The words of `tokens` by sentence, in UTF-8."""
    low = (text or "").lower()
    found = _sentences(low)
    if low.isascii() or not found:
        return found
    if isinstance(found[0][0], bytes):
        return [[word.decode("latin-1").encode() for word in words] for words in found]
    return [[word.encode() for word in words] for words in found]


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes, which Spark moves without looking at each; list k ends before values[ends[k + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, lengths) of the lists of `_packed`; none is null."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    held = held.cast(pa.binary())
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    size = np.dtype(kind).itemsize
    return (np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if ends[-1] > ends[0] else np.zeros(0, kind)), np.diff(ends) // size


@dataclass
class _Chunk:
    """Documents of one task, of some `CHUNK` tokens, with words numbered among them; `learnt` marks tokens that the model learns from."""

    number: int | None
    docs: pa.Array
    lens: list[np.ndarray]
    ids: np.ndarray
    learnt: np.ndarray
    digests: np.ndarray
    starts: np.ndarray

    def words(self) -> list[pa.Array]:
        """Columns (chunk, at, h, n_w, ws, n): of each word its number in the chunk and its digest, how often it is learnt, the digests of
        its distinct successors and how often these are. `chunk` and `at` are null where nothing is asked."""
        words = len(self.digests)
        # the last bit says whether a pair is learnt
        each, n = np.unique(_bigrams(self.ids, self.starts, words, self.learnt), return_counts=True)
        n = np.where(each & 1, n, 0)
        first = np.ones(len(each), bool)
        first[1:] = each[1:] >> 1 != each[:-1] >> 1
        n = np.bincount(np.cumsum(first) - 1, n, int(first.sum())).astype(np.int32)
        pairs = each[first] >> 1
        ends = np.searchsorted(pairs, np.arange(words + 1) * words)
        lists = [_packed(ends, values) for values in (self.digests[pairs % words], n)]
        n_w = np.bincount(self.ids[self.learnt], minlength=words)
        asked = [pa.nulls(words, pa.int64()), pa.nulls(words, pa.int32())] if self.number is None else [pa.array(np.full(words, self.number)), pa.array(np.arange(words), pa.int32())]
        return [*asked, pa.array(self.digests), pa.array(n_w), *lists]


def _bigrams(ids: np.ndarray, starts: np.ndarray, words: int, marks: np.ndarray | None = None) -> np.ndarray:
    """v * words + w of each token but the first of a document, doubled and with its mark if there are marks."""
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    pairs = ids[np.flatnonzero(inner) - 1].astype(np.int64) * words + ids[inner]
    return pairs if marks is None else pairs * 2 + marks[inner]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Chunks of rows (doc_id, text, asked, learnt); documents without words are left out. Those that are not asked about have chunks of
    their own, without a number."""
    task, number = TaskContext.get().partitionId(), 0
    kind = None

    def fresh():
        return [], [], [], [], defaultdict(count().__next__)

    def made(number, docs, lens, ids, learnt, vocabulary):
        digests = np.frombuffer(b"".join([blake2b(word, digest_size=8).digest() for word in vocabulary]), "<i8")
        sizes = [len(x) for x in ids]
        return _Chunk(number, pa.array(docs, kind), lens, np.concatenate(ids), np.repeat(np.array(learnt, bool), sizes), digests, np.cumsum([0, *sizes[:-1]]))

    held, size = {True: fresh(), False: fresh()}, {True: 0, False: 0}
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text, asked, learns in zip(*[column.to_pylist() for column in batch.columns]):
            sentences = _words(text) if asked or learns else []
            if not sentences:
                continue
            docs, lens, ids, learnt, vocabulary = held[asked]
            docs.append(doc)
            lens.append(np.fromiter(map(len, sentences), np.int32, len(sentences)))
            ids.append(np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(sentences)), np.int32, int(lens[-1].sum())))
            learnt.append(learns)
            size[asked] += len(ids[-1])
            if size[asked] >= CHUNK:
                yield made(task * 2**24 + number if asked else None, *held[asked])
                held[asked], size[asked], number = fresh(), 0, number + 1
    for asked, rows in held.items():
        if rows[0]:
            yield made(task * 2**24 + number if asked else None, *rows)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id, lens, ids) of the documents asked about, and rows (chunk, at, h, n_w, ws, n) of words."""
    names = ["chunk", "doc_id", "lens", "ids", "at", "h", "n_w", "ws", "n"]
    for chunk in _chunks(batches):
        ends = np.array([*chunk.starts, len(chunk.ids)])
        for at in range(0, len(chunk.docs) if chunk.number is not None else 0, 1000):
            docs, lens, own = chunk.docs[at : at + 1000], chunk.lens[at : at + 1000], ends[at : at + 1001]
            n = len(docs)
            lists = [_packed(np.cumsum([0, *map(len, lens)]), np.concatenate(lens)), _packed(own - own[0], chunk.ids[own[0] : own[-1]])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk.number)), docs, *lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
        number, *words = chunk.words()
        n = len(number)
        yield from pa.Table.from_arrays([number, pa.nulls(n, chunk.docs.type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *words], names).to_batches(max_chunksize=10_000)


def _dealt(parts):
    """Rows (chunk, at, h, n_w, ws, n) with the part that they go to; the successors of words in `parts` are dealt by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(parts.value), np.int64)
        for batch in batches:
            frequent = np.isin(batch.column(2).to_numpy(), keys)
            rest = batch.filter(pa.array(~frequent))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.zeros(rest.num_rows, np.int32))], [*rest.schema.names, "part"])
            rows = []
            for row in batch.filter(pa.array(frequent)).to_pylist():
                ws, n = np.frombuffer(row["ws"], np.int64), np.frombuffer(row["n"], np.int32)
                to = ws % parts.value[row["h"]]
                for part in range(parts.value[row["h"]]):
                    rows.append({**row, "ws": ws[to == part].tobytes(), "n": n[to == part].tobytes(), "part": part})
            if rows:
                kinds = [*rest.schema.types, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([row[name] for row in rows], kind) for name, kind in zip(rows[0], kinds)], list(rows[0]))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, group) of whole groups of h and part, which rows are sorted by, and the number of each row's group among them."""

    def numbered(table: pa.Table) -> np.ndarray:
        h, part = table.column("h").to_numpy(), table.column("part").to_numpy()
        return np.cumsum([0, *((h[1:] != h[:-1]) | (part[1:] != part[:-1]))])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows + batch.column(batch.schema.get_field_index("ws")).nbytes // 8
        if size >= HELD:
            table = pa.Table.from_batches(held)
            group = numbered(table)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield table.slice(0, whole), group[:whole]
            held = table.slice(whole).combine_chunks().to_batches()
            # a group that is not whole yet may fill it again
            size = 0 if whole else size // 2
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _merged(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all successors in whole groups, in order of group and digest: (order, group, run, n), where a run is one successor in
    one group, numbered, and n its number in the texts that the model learns from."""
    ws, lens = _numbers(table.column("ws"), np.int64)
    of = np.repeat(group, lens)
    order = np.lexsort((ws, of))
    new = np.ones(len(ws), bool)
    new[1:] = (ws[order][1:] != ws[order][:-1]) | (of[order][1:] != of[order][:-1])
    n, _ = _numbers(table.column("n"), np.int32)
    run = np.cumsum(new) - 1
    return order, of[order][new], run, np.bincount(run, n[order], int(new.sum())).astype(np.int64)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, n, k): how many successors of the word with digest v have the number n."""
    for table, group in _whole_groups(batches):
        _, of, _, n = _merged(table, group)
        of, n = of[n > 0], n[n > 0]
        each, k = np.unique(np.stack([of, n]), axis=1, return_counts=True)
        h = table.column("h").to_numpy()[np.searchsorted(group, each[0])]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(each[1]), pa.array(k)], ["v", "n", "k"])


#: Places among successors at which bins end.
PLACES = (1, 10, 100, 1000)


def _answered(frequent):
    """For rows that ask: rows (chunk, at, h, part, n_w, of_v, least, n) with the word's number, that of its successors, the least counts
    of `fit` and the count of each successor asked for, 0 if unseen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole_groups(batches):
            order, of, runs, n = _merged(table, group)
            groups = int(group[-1]) + 1
            h = table.column("h").to_numpy()
            n_w = np.bincount(group, table.column("n_w").to_numpy(), groups).astype(np.int64)
            seen = n > 0
            of_v = np.bincount(of[seen], n[seen], groups).astype(np.int64)
            # successors of a group by falling count
            falling = np.lexsort((-n[seen], of[seen]))
            counts, many = n[seen][falling], np.bincount(of[seen], minlength=groups)
            first = np.cumsum(many) - many
            least = np.zeros((groups, len(PLACES)), np.int64)
            for k, place in enumerate(PLACES):
                least[many > 0, k] = counts[(first + np.minimum(many, place) - 1)[many > 0]]
            rows = h[np.searchsorted(group, np.arange(groups))]
            for g in np.flatnonzero(np.isin(rows, np.array(sorted(frequent.value), np.int64))):
                n_w[g], of_v[g], least[g] = frequent.value[int(rows[g])]
            asks = table.column("chunk").is_valid().to_numpy()
            if not asks.any():
                continue
            found = np.empty(len(order), np.int32)
            found[order] = n[runs]
            _, lens = _numbers(table.column("ws"), np.int64)
            own = found[np.repeat(asks, lens)]
            part = table.filter(pa.array(asks))
            to = group[asks]
            columns = [*[part.column(name) for name in ("chunk", "at", "h", "part")], pa.array(n_w[to]), pa.array(of_v[to]), _packed(np.arange(len(to) + 1) * len(PLACES), least[to].ravel()), _packed(np.cumsum([0, *lens[asks]]), own)]
            yield from pa.Table.from_arrays(columns, ["chunk", "at", "h", "part", "n_w", "of_v", "least", "n"]).to_batches(max_chunksize=10_000)

    return run


def _scored(parts, big_n: int, big_v: int, whole: bool):
    """From a chunk's documents and its answers: rows (doc_id, n_tokens, perplexity, sentence_std, b0 to b4) of documents if `whole`, else
    rows (doc_id, sent, loss, k, b0 to b4) of their sentences."""

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"n_tokens": pa.int64(), "perplexity": pa.float64(), "sentence_std": pa.float64()} if whole else {"sent": pa.int32(), "loss": pa.float64(), "k": pa.int64()}
        kinds = {"doc_id": docs.schema.field("doc_id").type} | kinds | {f"b{b}": pa.int64() for b in range(5)}
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], kind) for kind in kinds.values()], list(kinds))
        at, h = answers.column("at").to_numpy().astype(np.int64), answers.column("h").to_numpy()
        words = int(at.max()) + 1
        digests, n_w, of_v, least = np.zeros(words, np.int64), np.zeros(words), np.zeros(words), np.zeros((words, len(PLACES)), np.int64)
        digests[at], n_w[at], of_v[at] = h, answers.column("n_w").to_numpy(), answers.column("of_v").to_numpy()
        least[at] = _numbers(answers.column("least"), np.int64)[0].reshape(-1, len(PLACES))

        ids, n_ids = _numbers(docs.column("ids"), np.int32)
        starts = np.cumsum(n_ids) - n_ids
        pairs, which = np.unique(_bigrams(ids, starts, words), return_inverse=True)
        v, w = np.divmod(pairs, words)
        n = np.zeros(len(pairs), np.int64)
        numbers, lens = _numbers(answers.column("n"), np.int32)
        ends, low = np.cumsum(lens), np.searchsorted(pairs, at * words)
        dealt = np.isin(h, np.array(sorted(parts.value), np.int64))
        place = np.repeat(low - ends + lens, lens) + np.arange(len(numbers))
        plain = np.repeat(~dealt, lens)
        n[place[plain]] = numbers[plain]
        part = answers.column("part").to_numpy()
        for row in np.flatnonzero(dealt):
            high = np.searchsorted(pairs, (at[row] + 1) * words)
            mine = low[row] + np.flatnonzero(digests[w[low[row] : high]] % parts.value[int(h[row])] == part[row])
            n[mine] = numbers[ends[row] - lens[row] : ends[row]]

        uni = (n_w + 1) / (big_n + big_v + 1)
        met = n > 0
        p = np.where(met, 0.7 * n / np.where(met, of_v[v], 1), 0.0) + 0.3 * uni[w]
        bins = np.where(met, (n[:, None] < least[v]).sum(1), 4)
        loss, bin_, inner = np.empty(len(ids)), np.full(len(ids), 4), np.ones(len(ids), bool)
        inner[starts] = False
        loss[inner], bin_[inner] = -np.log(p)[which], bins[which]
        loss[starts] = -np.log(uni[ids[starts]])

        k, n_sent = _numbers(docs.column("lens"), np.int32)
        begin, owner = np.cumsum(k) - k, np.repeat(np.arange(docs.num_rows), n_sent)
        first = np.cumsum(n_sent) - n_sent
        lost = np.add.reduceat(loss, begin)
        counts = lambda at: [np.add.reduceat((bin_ == b).astype(np.int64), at) for b in range(5)]
        if whole:
            each, mean = np.exp(np.round(lost / k, 9)), np.exp(np.round(np.add.reduceat(lost, first) / n_ids, 9))
            away = each - np.repeat(np.add.reduceat(each, first) / n_sent, n_sent)
            columns = [docs.column("doc_id"), n_ids, mean, np.sqrt(np.add.reduceat(away * away, first) / n_sent), *counts(starts)]
        else:
            columns = [docs.column("doc_id").take(pa.array(owner)), np.arange(len(k)) - np.repeat(first, n_sent), lost, k, *counts(begin)]
        return pa.Table.from_arrays([column.combine_chunks() if at == 0 else pa.array(column).cast(kind) for at, (column, kind) in enumerate(zip(columns, kinds.values()))], list(kinds))

    return work


def lm_features(docs: DataFrame, train: DataFrame | Column) -> DataFrame:
    """(doc_id, n_tokens, perplexity, sentence_std, rank_entropy) of each document with a word. `train` has the texts that the model learns
    from, or says which of `docs` have them, which are then read once.

    p(w|v) = 0.7 n(v, w) / n(v) + 0.3 (n(w) + 1) / (N + V + 1); the first word has its unigram probability. Perplexity
    is the exponent of the mean loss; sentence_std the population deviation of sentences' perplexities, 0 below two;
    rank_entropy that of the bins 0, 1-9, 10-99, 100-999 and beyond of a word's place among its predecessor's
    successors, unseen pairs beyond. Mean losses are rounded to nine places, below which they depend on the order of sums.

    Documents are asked about in chunks: each distinct word of a chunk travels once with its distinct successors, as digests of 64 bits, to
    where the same word is counted, and comes back with numbers. No token is shuffled, nor is the text.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    yes, no = F.lit(True), F.lit(False)
    if isinstance(train, DataFrame):
        rows = docs.select("doc_id", "text", yes.alias("asked"), no.alias("learnt")).unionByName(train.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", no.alias("asked"), yes.alias("learnt")))
    else:
        rows = docs.select("doc_id", "text", yes.alias("asked"), F.coalesce(train, no).alias("learnt"))
    path, sent = scratch(spark, "encoded"), spark.sparkContext.broadcast
    own = "h long, n_w long, ws binary, n binary"
    rows.mapInArrow(_encoded, f"chunk long, doc_id {kind}, lens binary, ids binary, at int, {own}").write.parquet(path)
    encoded = spark.read.parquet(path)

    # the words that have more than `DEALT` tokens are as many as all tokens by `DEALT` at most
    words = encoded.where("n_w > 0").groupBy("h").agg(F.sum("n_w").alias("n_w"))
    all_ = words.agg(F.sum("n_w").alias("big_n"), F.count("*").alias("big_v"), F.collect_list(F.when(F.col("n_w") > DEALT, F.struct("h", "n_w"))).alias("frequent")).first()
    parts = {r.h: -(-r.n_w // DEALT) for r in all_.frequent}
    each = encoded.where("h is not null").select("chunk", "at", "h", "n_w", "ws", "n")
    met = lambda rows: rows.repartition("h", "part").sortWithinPartitions("h", "part")
    frequent = {}
    if parts:
        schema = f"chunk long, at int, {own}, part int"
        some = each.join(F.broadcast(spark.createDataFrame([(h,) for h in parts], "h long")), "h", "left_semi").select(*each.columns)
        tallied = met(some.mapInArrow(_dealt(sent(parts)), schema)).mapInArrow(_tallied, "v long, n long, k long")
        known = {r.v: r for r in ranked(tallied.groupBy("v", "n").agg(F.sum("k").alias("k"))).collect()}
        frequent = {r.h: (r.n_w, known[r.h].of_v, [x or 0 for x in known[r.h].least]) if r.h in known else (r.n_w, 0, [0] * len(PLACES)) for r in all_.frequent}
        each = each.mapInArrow(_dealt(sent(parts)), schema)
    else:
        each = each.withColumn("part", F.lit(0))
    answers = met(each).mapInArrow(_answered(sent(frequent)), "chunk long, at int, h long, part int, n_w long, of_v long, least binary, n binary")
    bags = encoded.where("h is null").select("chunk", "doc_id", "lens", "ids")
    # rows that share an id are one document, whose sentences of one number are one sentence
    whole = all_.big_n is not None and bags.groupBy("doc_id").count().where("count > 1").isEmpty()
    columns = "n_tokens long, perplexity double, sentence_std double" if whole else "sent int, loss double, k long"
    work = _scored(sent(parts), all_.big_n or 0, all_.big_v, whole)
    per = bags.groupBy("chunk").cogroup(answers.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(work, f"doc_id {kind}, {columns}, " + ", ".join(f"b{b} long" for b in range(5)))
    if not whole:
        # a model of nothing gives no loss
        rows = (per if all_.big_n is not None else per.withColumn("loss", F.lit(None).cast("double"))).repartition("doc_id")  # for both sums
        sums = rows.groupBy("doc_id", "sent").agg(F.sum("loss").alias("loss"), F.sum("k").alias("k"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(5)])
        per = sums.groupBy("doc_id").agg(F.sum("k").alias("n_tokens"), F.exp(F.round(F.sum("loss") / F.sum("k"), 9)).alias("perplexity"), F.when(F.count("*") > 1, F.stddev_pop(F.exp(F.round(F.col("loss") / F.col("k"), 9)))).otherwise(0.0).alias("sentence_std"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(5)])
    share = [F.col(f"b{b}") / F.col("n_tokens") for b in range(5)]
    entropy = sum((F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share), F.lit(0.0))
    return per.select("doc_id", "n_tokens", F.round("perplexity", 4).alias("perplexity"), F.round("sentence_std", 4).alias("sentence_std"), F.round(entropy, 6).alias("rank_entropy"))


def feature_matrix(corpus: DataFrame, train: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The eight features and the label of each labelled text (doc_id, text, label). Documents of fewer than two tokens have zeros
    from the language model. Rows with a null text or label are left out; once the matrix was computed, the observation
    `seen`, if it is given, has `rows` and `skipped`, counted in the same pass (in a session without fitted models of Spark
    ML, as for `readers.read_corpus_counted`)."""
    good = F.col("text").isNotNull() & F.col("label").isNotNull()
    rows = corpus.select("doc_id", "text", "label")
    counted = rows if seen is None else rows.observe(seen, F.count("*").alias("rows"), F.count_if(~good).alias("skipped"))
    own = features.with_features(counted.where(good)).select("doc_id", "label", *[F.round(name, 6).alias(name) for name in features.FEATURES])
    three = ("perplexity", "sentence_std", "rank_entropy")
    found = own.join(lm_features(rows.where(good).select("doc_id", "text"), train), "doc_id", "left")
    zeroed = [F.when(F.col("n_tokens") >= 2, F.col(name)).otherwise(0.0).alias(name) for name in three]
    return found.select("doc_id", "label", *features.FEATURES, *zeroed)
