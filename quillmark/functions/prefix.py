"""Features of a text's beginnings at several lengths, from one ordered fold over its tokens.

The longest beginning is cut off first, so the fold is bounded whatever the text's length. It keeps running sums (words,
closed sentences and the squares of their lengths, words of the open sentence, the last words and the distinct ones summed
over all full windows) and sets them down where the n-th word ends, for each n asked; no text is copied for a length but
the beginning itself, of which phrases and marks are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features
from . import text as T

#: A run that may be a word, or an end of a sentence.
TOKEN = r"[\p{L}\p{N}_-]+|[.!?]+(?=[ \t\n\r\f\x0B]|\z)"
MARKS = tuple(".,!?;:()«»—-")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _sums(k, cur, closed, squares, shares, last) -> Column:
    return F.struct(k.alias("k"), cur.alias("cur"), closed.alias("closed"), squares.alias("squares"), shares.alias("shares"), last.alias("last"))


def _with_word(s: Column, word: Column, window: int) -> Column:
    last = F.when(F.size(s["last"]) < window, F.concat(s["last"], F.array(word))).otherwise(F.concat(F.slice(s["last"], 2, window - 1), F.array(word)))
    full = lambda x: F.when(F.size(x) == window, F.size(F.array_distinct(x))).otherwise(0)
    return _let(last, lambda x: _sums(s["k"] + 1, s["cur"] + 1, s["closed"], s["squares"], s["shares"] + full(x), x))


def _set_down(n: Column, s: Column) -> Column:
    return F.struct(n.alias("n"), s["k"].alias("k"), s["cur"].alias("cur"), s["closed"].alias("closed"), s["squares"].alias("squares"), s["shares"].alias("shares"), F.size(F.array_distinct(s["last"])).alias("distinct"))


def _folded(head: str, lengths: tuple[int, ...], window: int) -> Column:
    """Sums of the text in `head` at each of `lengths` that it has words for, and under 0 those of all of it."""
    tokens = F.transform(F.regexp_extract_all(F.lower(head), F.lit(TOKEN), 0), lambda x: F.struct(x.alias("x"), T.word_count(x).alias("n"), F.regexp_extract(x, r"^(\p{L}+)(?:-|$)", 1).alias("lead")))
    zero = F.lit(0)
    start = F.struct(zero.alias("words"), _sums(zero, zero, zero, zero.cast("long"), zero, F.array().cast("array<string>")).alias("s"), F.array().cast("array<struct<n:int,k:int,cur:int,closed:int,squares:bigint,shares:int,distinct:int>>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        s, words = state["s"], state["words"]
        ends = F.rlike(t["x"], F.lit(r"^[.!?]")) & (s["cur"] > 0)
        closed = _sums(s["k"], F.lit(0), s["closed"] + 1, s["squares"] + s["cur"].cast("long") * s["cur"], s["shares"], s["last"])
        after = F.when((t["lead"] == t["x"]) & (t["x"] != ""), _with_word(s, t["x"], window)).when(ends, closed).otherwise(s)
        # a beginning that ends inside a token ends with the word that leads it, if only letters do
        due = F.filter(F.array(*map(F.lit, lengths)), lambda n: (n > words) & (n <= words + t["n"]))
        seen = F.transform(due, lambda n: _let(F.when((n == words + 1) & (t["lead"] != ""), _with_word(s, t["lead"], window)).otherwise(s), lambda x: _set_down(n, x)))
        return F.struct((words + t["n"]).alias("words"), after.alias("s"), F.when(t["n"] > 0, F.concat(state["out"], seen)).otherwise(state["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda state: F.concat(state["out"], F.array(_set_down(F.lit(0), state["s"]))))


def _is(n: int) -> Callable[[Column], Column]:
    return lambda s: s["n"] == n


def with_prefixes(df: DataFrame, lengths: tuple[int, ...], text: str = "text", phrases: tuple[str, ...] = features.PHRASES, window: int = 20) -> DataFrame:
    """A row for each row of `df` and each of `lengths`: n, n_chars, n_words and the features of the text up to the end of its n-th
    word (all of it if it has no more), as `features.with_features` gives them for the cut text, and the other columns of `df`
    without the text. Null texts count as empty.

    Letters are lowered before words are told apart, as there; where that adds a mark to a letter (a dotted capital I), the
    words of a beginning are counted as they stand after it.
    """
    keys = [c for c in df.columns if c != text]
    rows = df.select(*keys, T.truncate_words(F.coalesce(F.col(text), F.lit("")), max(lengths)).alias("_head"))
    rows = rows.select(*keys, "_head", _folded("_head", lengths, window).alias("_sums"), F.transform(F.array(*map(F.lit, MARKS)), lambda m: F.instr(F.col("_head"), m)).alias("_marks"))
    each = F.array(*[F.struct(F.lit(n).alias("n"), T.truncate_words(F.col("_head"), n).alias("cut"), F.coalesce(F.get(F.filter("_sums", _is(n)), 0), F.element_at("_sums", -1)).alias("s")) for n in lengths])
    rows = rows.select(*keys, "_marks", F.explode(each).alias("_e"))
    k, cur = F.col("_e.s.k"), F.col("_e.s.cur")
    count = F.col("_e.s.closed") + (cur > 0).cast("int")
    square = F.col("_e.s.squares") + cur.cast("long") * cur
    low = F.lower("_e.cut")
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in phrases), F.lit(0.0))
    marks = F.size(F.filter("_marks", lambda at: (at > 0) & (at <= F.length("_e.cut"))))
    return rows.select(
        *keys, F.col("_e.n").alias("n"), F.length("_e.cut").alias("n_chars"), T.word_count(F.col("_e.cut")).alias("n_words"),
        F.when(count < 2, 0.0).otherwise(F.sqrt(F.greatest(square / count - (k / count) * (k / count), F.lit(0.0)))).alias("burst"),
        F.when(count == 0, 0.0).otherwise(k / count).alias("mean_len"),
        F.when(k == 0, 0.0).when(k < window, F.col("_e.s.distinct") / k).otherwise(F.col("_e.s.shares") / (F.lit(float(window)) * (k - window + 1))).alias("mattr"),
        (100.0 * hits / F.greatest(k, F.lit(1))).alias("phrase"), (marks / F.lit(8.0)).alias("punct"),
    )
