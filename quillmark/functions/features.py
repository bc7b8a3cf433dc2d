"""Features of texts and the linear scorers over them, as staged columns.

The five features are taken in one pass over a text's words, batch by batch; everything stays in one stage. Words, letters and
sentences are those of `text.words` and `text.sentence_lengths`.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases and coefficients of the two linear scorers used where no trained model is given.
PHRASES = ("the", "and", "that", "with", "of the", "in the")
#: Stock phrases of generated Russian texts; fixed values, for `phrases`.
CLICHES = (
    "важно отметить", "стоит отметить", "таким образом", "в заключение",
    "играет важную роль", "является неотъемлемой частью", "следует подчеркнуть",
    "в современном мире", "не секрет, что", "в первую очередь",
    "необходимо учитывать", "в целом можно сказать", "подводя итог",
)
SCORERS = {
    "a": {"bias": 0.6, "burst": -0.12, "mean_len": 0.12, "mattr": -1.0, "phrase": -0.02, "punct": 0.8},
    "b": {"bias": 1.9, "burst": 0.05, "mean_len": -0.10, "mattr": -1.2, "phrase": 0.03, "punct": 0.5},
}
FEATURES = ("burst", "mean_len", "mattr", "phrase", "punct")


TOKEN, ENDED = re.compile(r"[\w-]+"), re.compile(r"[.!?]+(?:[ \t\n\r\f\x0B]|\Z)")
MARKS = ".,!?;:()«»—-"


def _kind(c: str) -> str:
    """What a character is in a text of Latin-1: a letter itself, - in a token, a blank or a tab between tokens, . at the end of sentences."""
    return c if c.isalpha() else "-" if TOKEN.match(c) else "." if c in ".!?" else " " if c in " \t\n\r\f\x0B" else "\t"


KINDS = bytes(ord(_kind(chr(k))) for k in range(256))
#: Characters of texts whose words are held at a time.
HELD = 1 << 20


def _sentences(low: str) -> list[list]:
    """The words of each sentence that has some."""
    try:
        parts = low.encode("latin-1").translate(KINDS).split(b". ")
    except UnicodeEncodeError:
        found = [[token for token in TOKEN.findall(part) if token.isalpha()] for part in ENDED.split(low)]
    else:
        found = [part.replace(b".", b" ").split() for part in parts]
        found = [[word for word in words if b"-" not in word] if b"-" in part else words for part, words in zip(parts, found)]
    return [words for words in found if words]


def _mattrs(texts: list[list], window: int) -> list[float]:
    """For each list of words, the mean share of distinct words over its windows. A word counts in each window around it but for
    those that hold it further left, so only words that come back within a window are looked at."""
    n = np.array([len(words) for words in texts], np.int64)
    total = int(n.sum())
    ids = np.fromiter(map({}.setdefault, chain.from_iterable(texts), count()), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    near = np.zeros(total, np.int64)
    for gap in range(min(window, total) - 1, 0, -1):
        again = np.flatnonzero(ids[gap:] == ids[:-gap]) + gap
        near[again[at[again] >= gap]] = gap
    again = np.flatnonzero(near)
    twice = np.minimum(at[again] - near[again], n[owner[again]] - window) - np.maximum(at[again] - window, -1)
    lost = np.bincount(owner[again], np.maximum(twice, 0), len(texts))
    many = n - window + 1
    shares = (window * many - lost) / window / np.maximum(many, 1)
    return [float(share) if k > 0 else len(set(words)) / len(words) if words else 0.0 for share, k, words in zip(shares, many, texts)]


def _held(texts: list[str], phrases: tuple[str, ...], window: int) -> Iterator[tuple[float, ...]]:
    lows = [text.lower() for text in texts]
    found = [_sentences(low) for low in lows]
    words = [list(chain.from_iterable(x)) for x in found]
    for text, low, sentences, own, mattr in zip(texts, lows, found, words, _mattrs(words, window)):
        lens = [len(x) for x in sentences]
        n, average = len(lens), len(own) / len(lens) if lens else 0.0
        burst = 0.0 if n < 2 else math.sqrt(max(sum([x * x for x in lens]) / n - average * average, 0.0))
        hits = sum([low.count(p) for p in phrases])
        yield burst, average, mattr, 100.0 * hits / max(len(own), 1), sum([m in text for m in MARKS]) / 8.0


def _measures(texts: list[str], phrases: tuple[str, ...], window: int) -> pa.StructArray:
    """burst, mean_len, mattr, phrase and punct of each text, some texts at a time."""
    rows: list[tuple[float, ...]] = []
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= HELD:
            rows += _held(held, phrases, window)
            held, size = [], 0
    rows += _held(held, phrases, window)
    return pa.StructArray.from_arrays([pa.array([row[k] for row in rows], pa.float64()) for k in range(len(FEATURES))], names=list(FEATURES))


def measured(text: Column, phrases: tuple[str, ...] = PHRASES, window: int = 20) -> Column:
    """A struct of the five features of a text that is not null, an Arrow batch at a time."""

    @F.arrow_udf(", ".join(f"{name} double" for name in FEATURES))
    def batch(texts: pa.Array) -> pa.Array:
        return _measures(texts.to_pylist(), phrases, window)

    return batch(text)


def _over(owner: np.ndarray, ps: np.ndarray, pe: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray, ps_of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For paragraphs [ps, pe) of documents `owner`: the characters that windows [first, last) of documents `of` lie over, those that some
    window does, and the sums of the windows' scores by characters. Both come by document and place, so a paragraph's windows are a range."""
    wide = 1 + int(max(pe.max(initial=0), last.max(initial=0)))
    low = np.searchsorted(of * wide + last, owner * wide + ps, "right")
    high = np.searchsorted(of * wide + first, owner * wide + pe, "left")
    n = np.maximum(high - low, 0)
    para = np.repeat(np.arange(len(ps)), n)
    win = np.arange(len(para)) + np.repeat(low - np.cumsum(n) + n, n)
    begin, end = np.maximum(ps[para], first[win]), np.minimum(pe[para], last[win])
    over, new = end - begin, end - begin
    again = np.flatnonzero(para[1:] == para[:-1]) + 1
    new[again] = np.maximum(end[again] - np.maximum(begin[again], end[again - 1]), 0)
    sums = {"chars": np.bincount(para, over, len(ps)).astype(np.int64), "covered": np.bincount(para, new, len(ps)).astype(np.int32)}
    return sums | {f"s_{name}": np.bincount(para, p[win] * over, len(ps)) for name, p in ps_of.items()}


def laid_back(size: Column, cstart: Column, cend: Column, text: Column, ps: Column, pe: Column, inside: Column, sizes: tuple[int, ...], scorers: tuple[str, ...], phrases: tuple[str, ...] = PHRASES, window: int = 20) -> Column:
    """From arrays of a document's windows (size, cstart, cend, text; by size and place) and of its paragraphs (ps, pe, inside: whether windows
    count for it): for each of `sizes` and each paragraph a struct of size, chars and covered, with s_<name> of each scorer, the sum of
    window scores by the characters of the paragraph that they lie over. No array and nothing in it is null."""
    kinds = {"size": "int", "chars": "bigint", "covered": "int"} | {f"s_{name}": "double" for name in scorers}

    @F.arrow_udf("array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in kinds.items()) + ">>")
    def batch(size: pa.Array, cstart: pa.Array, cend: pa.Array, text: pa.Array, ps: pa.Array, pe: pa.Array, inside: pa.Array) -> pa.Array:
        numbers = lambda lists: lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        each = _measures(text.flatten().to_pylist(), phrases, window)
        found = {f: each.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(FEATURES)}
        p = {name: 1 / (1 + np.exp(-sum((found[f] * SCORERS[name][f] for f in FEATURES), SCORERS[name]["bias"]))) for name in scorers}
        n = ps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner, of = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), size.value_lengths().to_numpy(zero_copy_only=False))
        own, first, last, begin, end = numbers(size), numbers(cstart), numbers(cend), numbers(ps), numbers(pe)
        counts = np.flatnonzero(inside.flatten().to_numpy(zero_copy_only=False))
        start = np.cumsum(n) - n
        out = {name: np.zeros(len(owner) * len(sizes), {"int": np.int32, "bigint": np.int64, "double": np.float64}[kind]) for name, kind in kinds.items()}
        for k, words in enumerate(sizes):
            of_size = own == words
            sums = _over(owner[counts], begin[counts], end[counts], of[of_size], first[of_size], last[of_size], {name: x[of_size] for name, x in p.items()})
            # a document's rows are those of the first size, then those of the next
            at = (len(sizes) - 1) * start[owner] + k * n[owner] + np.arange(len(owner))
            out["size"][at] = words
            for name, values in sums.items():
                out[name][at[counts]] = values
        rows = pa.StructArray.from_arrays([pa.array(values) for values in out.values()], names=list(out))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n * len(sizes))]), pa.int32()), rows)

    return batch(size, cstart, cend, text, ps, pe, inside)


def with_features(df: DataFrame, text: str = "text", phrases: tuple[str, ...] = PHRASES, window: int = 20) -> DataFrame:
    """Adds n_chars, n_words, burst, mean_len, mattr, phrase and punct of column `text`; null texts count as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumn("_measured", measured(body, phrases, window))
    return staged.withColumns({"n_chars": F.length(body), "n_words": T.word_count(body), **{name: F.col(f"_measured.{name}") for name in FEATURES}}).drop("_measured")


def with_built_in_features(df: DataFrame, text: str = "text", phrases: tuple[str, ...] = PHRASES, window: int = 20) -> DataFrame:
    """Adds n_chars, n_words, burst, mean_len, mattr, phrase and punct of column `text`; null texts count as empty. The same as
    `with_features` without Python, for rows that go on to a Python model, whose workers would be twice as many otherwise."""
    body = F.coalesce(F.col(text), F.lit(""))
    staged = df.withColumns({"_words": T.words(body), "_lens": T.sentence_lengths(body)})
    n, lens = F.size("_words"), F.col("_lens")
    total = F.aggregate(lens, F.lit(0), lambda s, x: s + x)
    square = F.aggregate(lens, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)  # 46,341 words squared exceed an int
    average = total / F.size(lens)
    shares = F.transform(F.sequence(F.lit(1), n - window + 1), lambda at: F.size(F.array_distinct(F.slice("_words", at, F.lit(window)))) / F.lit(float(window)))
    staged = staged.withColumn("_shares", F.when(n >= window, shares))
    low = F.lower(body)
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in phrases), F.lit(0.0))
    return staged.withColumns(
        {
            "n_chars": F.length(body),
            "n_words": T.word_count(body),
            "burst": F.when(F.size(lens) < 2, 0.0).otherwise(F.sqrt(F.greatest(square / F.size(lens) - average * average, F.lit(0.0)))),
            "mean_len": F.when(F.size(lens) == 0, 0.0).otherwise(average),
            "mattr": F.when(n == 0, 0.0).when(n < window, F.size(F.array_distinct("_words")) / n).otherwise(T.mean(F.col("_shares"))),
            "phrase": 100.0 * hits / F.greatest(n, F.lit(1)),
            "punct": T.punct_variety(body),
        }
    ).drop("_words", "_lens", "_shares")


def linear(name: str, of: Callable[[str], Column] = F.col) -> Column:
    """P of the named linear scorer from feature columns, or from what `of` gives for their names."""
    w = SCORERS[name]
    z = sum((of(f) * w[f] for f in FEATURES), F.lit(w["bias"]))
    return 1 / (1 + F.exp(-z))


def with_scores(df: DataFrame, text: str = "text", scorers: tuple[str, ...] = ("a",)) -> DataFrame:
    """Adds the features and a column p_<name> for each scorer."""
    return with_features(df, text).withColumns({f"p_{name}": linear(name) for name in scorers})


# ---- the same in DuckDB SQL --------------------------------------------------------------------------------------

SQL_WORD = r"[\p{L}\p{N}_]*\p{L}[\p{L}\p{N}_]*"


def sql_features(source: str, text: str = "text", scorers: tuple[str, ...] = ("a",)) -> str:
    """select *, features and scores from `source`."""
    hits = " + ".join(f"(length(lower({text})) - length(replace(lower({text}), '{p}', '')))::double / {len(p)}" for p in PHRASES)
    scores = "".join(
        f", (1 / (1 + exp(-({SCORERS[s]['bias']}::double + " + " + ".join(f"{f} * {SCORERS[s][f]}::double" for f in FEATURES) + f")))) as p_{s}" for s in scorers
    )
    return rf"""select * exclude (_w, _l){scores} from (select *, length({text}) as n_chars, len(regexp_extract_all({text}, '{SQL_WORD}')) as n_words,
case when len(_l) < 2 then 0.0::double else sqrt(greatest(list_sum(list_transform(_l, lambda x: x * x))::double / len(_l) - (list_sum(_l)::double / len(_l)) * (list_sum(_l)::double / len(_l)), 0.0::double)) end as burst,
case when len(_l) = 0 then 0.0::double else list_sum(_l)::double / len(_l) end as mean_len,
case when len(_w) = 0 then 0.0::double when len(_w) < 20 then len(list_distinct(_w))::double / len(_w) else list_sum(list_transform(range(1, len(_w) - 18), lambda i: len(list_distinct(_w[i:i+19]))::double / 20.0::double)) / (len(_w) - 19) end as mattr,
100.0::double * ({hits}) / greatest(len(_w), 1) as phrase,
len(list_distinct(regexp_extract_all({text}, '{T.MARKS}')))::double / 8 as punct
from (select *, list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '\p{{L}}+')) as _w,
list_filter(list_transform(string_split_regex({text}, '[.!?]+([ \t\n\r\f\x0B]|\z)'), lambda s: len(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '\p{{L}}+')))), lambda n: n > 0) as _l from {source}))"""
