"""Token counts by a compiled finite-state transducer.

A byte-pair encoding has one right segmentation, and a sequence of pieces is that segmentation exactly if each two
neighbours, encoded on their own, stay as they are. The last piece of every prefix therefore follows from the pieces
that end at a bounded number of earlier positions, and counting is a deterministic transducer: a state is the longest
suffix that starts a piece, with the last piece and the relative count at each position where such a suffix begins; a
transition on a character is annotated with the change of the number of emitted tokens. States and transitions are
compiled when a text first reaches them and kept per worker.

No piece holds a space after another character, so the state after a boundary (before a run of spaces, and around a
character that no piece holds) is the start state: a whole unit between boundaries composes to one transition from
start to start.

Texts beyond `LONG` characters are cut into chunks, each a task's row of its own. A chunk is held as its state map: for each
state in which it may be entered, the state in which it is left and the tokens emitted. The entry states are those that
the `LEAD` characters before the chunk lead to from the start state at any of their first `OFFSETS` positions; they fall
together at the first boundary, and mostly without one. Maps compose associatively and are scanned in levels of `FAN`
neighbours, each group a task's row again, until one map a text is left: no task holds the text. Where a map lacks the
state in which its chunk is really entered, the text is counted by one pass over its chunks, in order, state in hand.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_groups, kept, ship, small

ship(__name__)

#: Characters beyond which a text is cut, and of a chunk.
LONG, CHUNK = 65_536, 16_384
#: Characters before a chunk from which its entry states follow, and how many of them may start a piece anew.
LEAD, OFFSETS = 256, 16
#: Neighbouring maps composed at once.
FAN = 64
#: Composite transitions and states kept in a worker.
KEPT_UNITS, KEPT_STATES = 500_000, 300_000
SPACE = "▁"


class Transducer(dict):
    """Maps a unit of text to its number of tokens; the dict holds composite transitions from start to start."""

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.rank = {}
        for i in range(library.get_piece_size()):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)):
                self.rank[library.id_to_piece(i)] = -library.get_score(i)
        self.starts = {piece[:k] for piece in self.rank for k in range(1, len(piece) + 1)}
        #: The suffixes of each start of a piece that start one too, the longest first, and the empty one.
        self.heads = {x: [*(x[k:] for k in range(len(x)) if x[k:] in self.starts), ""] for x in ("", *self.starts)}
        self.whole = {piece for piece in self.rank if self.merged(piece) == [piece]}
        self.letters = {letter for piece in self.rank for letter in piece}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("a piece holds a space after another character: units would not be independent")
        if any(letter not in self.rank for letter in self.letters):
            raise ValueError("a piece holds a character that is no piece itself")
        ends = "".join(re.escape(x) for x in "\n\r\t" if x not in self.letters)
        self.units = re.compile(f"[ {SPACE}]*[^ {SPACE}{ends}]+|[ {SPACE}]+" + (f"|[{ends}]" if ends else "")).findall
        self.start = ("", ((None, 0),))
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the start, which is number 0."""
        self.number = {self.start: 0}
        self.states = [self.start]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """The encoding of a few characters by its definition: merge the pair of least rank, the leftmost first."""
        parts, rank, none = list(text), self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts

    def stays(self, left: str | None, right: str) -> bool:
        """Whether `right` may follow `left`; anything may follow a boundary."""
        if left is None:
            return True
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def step(self, state: tuple, letter: str) -> tuple[tuple, int]:
        """The transition from `state` on `letter`: the next state and the change of the count."""
        suffix, before = state
        if letter not in self.letters:
            return self.start, len(letter.encode("utf-8", "surrogatepass"))
        # before[k]: last piece, and count less the present one, where the suffix's k-th start lies; the last is here
        alive, longest, ended, change = [], "", "", 0
        for head, (last, count) in zip(self.heads[suffix], before):
            piece = head + letter
            if not ended and piece in self.whole and self.stays(last, piece):
                ended, change = piece, count + 1
            if piece in self.starts:
                longest = longest or piece
                alive.append((last, count))
        return (longest, (*((last, count - change) for last, count in alive), (ended, 0))), change

    def __missing__(self, unit: str) -> int:
        if len(self) > KEPT_UNITS:
            self.clear()
        total = self.walk(self.start, unit)[1]
        if len(unit) <= 64:
            self[unit] = total
        return total

    def walk(self, state: tuple, unit: str) -> tuple[tuple, int]:
        """The state after `unit`, which holds no boundary, from `state`, and the change of the count."""
        if len(self.states) > KEPT_STATES:
            self.reset()
        if len(self.fits) > KEPT_STATES * 5:
            self.fits.clear()
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
            self.arcs.append({})
        total, arcs = 0, self.arcs
        for letter in unit.replace(" ", SPACE):
            arc = arcs[at].get(letter)
            if arc is None:
                arc = self.compiled(at, letter)
            at = arc[0]
            total += arc[1]
        return self.states[at], total

    def compiled(self, at: int, letter: str) -> tuple[int, int]:
        """The new transition from state number `at` on `letter`."""
        state, change = self.step(self.states[at], letter)
        to = self.number.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
            self.arcs.append({})
        arc = self.arcs[at][letter] = (to, change)
        return arc

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.units(text)))

    def passed(self, state: tuple, last: str, text: str) -> tuple[tuple, int]:
        """The state after `text`, entered in `state` behind the character `last`, and the change of the count."""
        parts = self.units(text)
        if not parts:
            return state, 0
        if _space(text[0]) and not _space(last):
            state = self.start
        state, total = self.walk(state, parts[0])
        if len(parts) > 1:
            total += sum(map(self.__getitem__, parts[1:-1]))
            state, more = self.walk(self.start, parts[-1])
            total += more
        return state, total

    def entries(self, lead: str) -> list[tuple]:
        """The states after `lead` from the start state at its first positions; the start state without a lead."""
        found, last = [self.start], ""
        for k, letter in enumerate(lead):
            moved = {self.passed(state, last, letter)[0]: None for state in found}
            found, last = [*moved, *([self.start] if k + 1 < OFFSETS and self.start not in moved else [])], letter
        return found

    def chunk_map(self, lead: str, text: str) -> dict[str, tuple[str, int]]:
        """For each state in which the chunk may be entered, that in which it is left and the tokens emitted."""
        found = {}
        for state in self.entries(lead):
            after, total = self.passed(state, lead[-1:], text)
            found[json.dumps(state)] = (json.dumps(after), total)
        return found


def _space(letter: str) -> bool:
    return letter in (" ", SPACE)


def composed(maps: list[dict]) -> dict[str, tuple[str, int]]:
    """Chunk maps of neighbours as one map; entry states that some map does not know are left out."""
    whole = {}
    for entry in maps[0]:
        state, total = entry, 0
        for each in maps:
            state, more = each.get(state, (None, 0))
            if state is None:
                break
            total += more
        else:
            whole[entry] = (state, total)
    return whole


def _short(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(("transducer", model), lambda: Transducer(model))
        for batch in batches:
            # a text starts with one more space, unless it is empty
            counts = [machine.count(" " + text) if text else 0 for text in (x.as_py() for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


MAPS = "row long, doc_id long, n_bytes long, chunk int, times long, entry array<string>, after array<string>, tokens array<long>"
TOTALS = "row long, doc_id long, n_bytes long, times long, n_tokens long"


def _mapped(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(("transducer", model), lambda: Transducer(model))
        for batch in batches:
            maps = [machine.chunk_map(lead, text) for lead, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([1] * len(maps), pa.int64()), *_columns(maps)], [x.split()[0] for x in MAPS.split(", ")])

    return run


def _columns(maps: list[dict]) -> list[pa.Array]:
    return [
        pa.array([list(m) for m in maps], pa.list_(pa.string())),
        pa.array([[x for x, _ in m.values()] for m in maps], pa.list_(pa.string())),
        pa.array([[n for _, n in m.values()] for m in maps], pa.list_(pa.int64())),
    ]


def _level(group: pa.Table) -> dict:
    """One map for the neighbouring maps of `group`; rows that repeat have each chunk as often."""
    chunks, times = group.column("chunk").to_pylist(), group.column("times").to_pylist()
    maps = {}
    for chunk, *values in zip(chunks, *(group.column(name).to_pylist() for name in ("entry", "after", "tokens"))):
        maps.setdefault(chunk, {e: (x, n) for e, x, n in zip(*values)})
    whole = _columns([composed(list(maps.values()))])
    again = sum(n for chunk, n in zip(chunks, times) if chunk == chunks[0])
    one = {name: group.column(name)[:1].combine_chunks() for name in ("row", "doc_id", "n_bytes")}
    return {**one, "chunk": pa.array([chunks[0] // FAN], pa.int32()), "times": pa.array([again], pa.int64()), **dict(zip(("entry", "after", "tokens"), whole))}


def _streamed(model: str):
    """Totals of texts whose chunks come in order: one pass with the state in hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = kept(("transducer", model), lambda: Transducer(model))
        text, chunk, times, state, last, total = None, -1, 0, machine.start, "", 0

        def ended() -> pa.RecordBatch:
            values = (*text, times, total)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in values], [x.split()[0] for x in TOTALS.split(", ")])

        for batch in batches:
            for *this, k, _, part in zip(*(column.to_pylist() for column in batch.columns)):
                if this != text:
                    if text is not None:
                        yield ended()
                    text, chunk, times, state, last, total = this, -1, 0, machine.start, "", 0
                times += k == 0
                if k != chunk:
                    state, more = machine.passed(state, last, part)
                    chunk, last, total = k, part[-1:] or last, total + more
        if text is not None:
            yield ended()

    return run


def _long_counts(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of the long texts of `rows`."""
    text, key = F.concat(F.lit(" "), "text"), ["row", "doc_id", "n_bytes"]

    def part(k):
        at = (k * CHUNK + 1).cast("int")
        before = F.greatest(at - LEAD, F.lit(1))
        return F.struct(k.cast("int").alias("chunk"), F.substring(text, before, at - before).alias("lead"), F.substring(text, at, F.lit(CHUNK)).alias("text"))

    chunks = rows.select(F.xxhash64("text").alias("row"), "doc_id", "n_bytes", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / CHUNK)), part)).alias("part"))
    chunks = chunks.select(*key, "part.chunk", "part.lead", "part.text")
    maps = cut(chunks.repartition(*key, "chunk").mapInArrow(_mapped(model), MAPS))
    most = maps.agg(F.max("chunk")).first()[0] or 0
    while True:
        # the last level also puts rows that repeat together
        maps = in_groups(maps.withColumn("part", F.floor(F.col("chunk") / FAN)), [*key, "part"], _level, MAPS, ("chunk",))
        if most < FAN:
            break
        most //= FAN
    maps = cut(maps)
    known = F.size("entry") > 0
    totals = maps.where(known).select(*key, "times", F.col("tokens")[0].alias("n_tokens"))
    unknown = maps.where(~known).select(*key)
    if not unknown.isEmpty():
        same = [chunks[name].eqNullSafe(unknown[name]) for name in key]
        again = chunks.join(small(unknown), same, "left_semi").repartition(*key).sortWithinPartitions(*key, "chunk")
        totals = totals.unionByName(again.mapInArrow(_streamed(model), TOTALS))
    return totals.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc_id", "n_bytes", "n_tokens")


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of `docs`, with the pieces of the sentencepiece BPE model at
    path `model`, without begin or end tokens; control strings inside a text are plain text.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat are each returned; doc_id may be null; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col("text").cast("string").alias("text"))
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= LONG).mapInArrow(_short(model), "doc_id long, n_bytes long, n_tokens long")
    long = _long_counts(rows.where(F.length("text") > LONG), model)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
