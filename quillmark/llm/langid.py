"""Language identification: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers of `HIDDEN` units read a text's bytes forwards and backwards; every position has a
distribution over languages from both hidden states, and a document's probabilities pool those of all its positions.
The network is trained here, in numpy, by backpropagation through time on windows of labelled texts. Gates use the
softsign instead of the exponential, so that a step is a few passes over small arrays.

Texts are read whole: as windows of `WINDOW` bytes that start `LEAD` bytes early on either side, so that each position
has context; many windows step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, ship

ship(__name__)

HIDDEN, WINDOW, LEAD = 8, 112, 8
#: Labelled rows to learn from, of which every byte is read; bytes of a window that steps through time go back over.
FIT_ROWS, FIT_BYTES = 800, 48
#: The least number of steps, which small tables reach by more passes over their windows; windows of a step; rate at the start.
STEPS, BATCH, RATE = 300, 128, 0.01
#: Windows that step together: few enough that their products stay on one thread.
TOGETHER = 512
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _gate(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _fresh(n_lang: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    model = {}
    for side in "fb":
        model["in" + side] = rng.normal(0, 0.4, (256, 3 * HIDDEN)).astype(np.float32)
        model["rec" + side] = rng.normal(0, 0.35, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        model["out" + side] = rng.normal(0, 0.4, (HIDDEN, n_lang)).astype(np.float32)
    return model | {"bias": np.zeros(n_lang, np.float32)}


def _forward(x: np.ndarray, model: dict, side: str) -> list[tuple]:
    """States of one direction over bytes x (rows, steps): per step (before, reset, update, candidate, raw, after)."""
    h, kept = np.zeros((len(x), HIDDEN), np.float32), []
    inputs, rec = model["in" + side], model["rec" + side]
    for t in range(x.shape[1]):
        a, r = inputs[x[:, t]], h @ rec
        gates = a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]
        soft = 0.5 + 0.5 * gates / (1 + np.abs(gates))
        raw = a[:, 2 * HIDDEN :] + soft[:, :HIDDEN] * r[:, 2 * HIDDEN :]
        new = raw / (1 + np.abs(raw))
        after = h + soft[:, HIDDEN:] * (new - h)
        kept.append((h, gates, soft, r[:, 2 * HIDDEN :], raw, new, after))
        h = after
    return kept


def _backward(x: np.ndarray, kept: list[tuple], d_out: np.ndarray, model: dict, side: str, grad: dict) -> None:
    """Backpropagation through time; d_out (steps, rows, hidden) is the loss's slope at each state."""
    rec = model["rec" + side]
    d_in, d_rec, dh = grad["in" + side], grad["rec" + side], np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        h, gates, soft, r_new, raw, new, _ = kept[t]
        dh = dh + d_out[t]
        update = soft[:, HIDDEN:]
        d_raw = dh * update / (1 + np.abs(raw)) ** 2
        d_soft = np.concatenate([d_raw * r_new, dh * (new - h)], 1)
        d_gates = 0.5 * d_soft / (1 + np.abs(gates)) ** 2
        d_a = np.concatenate([d_gates, d_raw], 1)
        d_r = np.concatenate([d_gates, d_raw * soft[:, :HIDDEN]], 1)
        np.add.at(d_in, x[:, t], d_a)
        d_rec += h.T @ d_r
        dh = dh * (1 - update) + d_r @ rec.T


def fit(windows: np.ndarray, y: np.ndarray, n_lang: int) -> dict[str, np.ndarray]:
    """Trains on byte windows (rows, steps) with labels y; Adam on the mean cross-entropy of all positions."""
    model, rng = _fresh(n_lang), np.random.default_rng(4)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, epochs = 0, -(-STEPS // -(-len(windows) // BATCH))
    steps = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, goal = windows[order[at : at + BATCH]], y[order[at : at + BATCH]]
            back = x[:, ::-1]
            forth, other = _forward(x, model, "f"), _forward(back, model, "b")
            states_f = np.stack([k[-1] for k in forth])
            states_b = np.stack([k[-1] for k in other])[::-1]
            score = states_f @ model["outf"] + states_b @ model["outb"] + model["bias"]
            score -= score.max(-1, keepdims=True)
            slope = np.exp(score)
            slope /= slope.sum(-1, keepdims=True)
            slope[:, np.arange(len(goal)), goal] -= 1
            slope /= slope.shape[0] * slope.shape[1]
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            grad["outf"], grad["outb"] = np.einsum("tbh,tbl->hl", states_f, slope), np.einsum("tbh,tbl->hl", states_b, slope)
            grad["bias"] = slope.sum((0, 1))
            _backward(x, forth, slope @ model["outf"].T, model, "f", grad)
            _backward(back, other, (slope @ model["outb"].T)[::-1], model, "b", grad)
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return model


def _states(x: np.ndarray, model: dict, side: str, out: np.ndarray) -> None:
    """Adds each state's share of the scores to out (steps, rows, languages); x is (steps, rows)."""
    n, h = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32)
    parts = [np.ascontiguousarray(model[name + side][:, cut]) for name in ("in", "rec") for cut in (slice(0, 2 * n), slice(2 * n, None))]
    in_gates, in_new, rec_gates, rec_new = parts
    head = model["out" + side]
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        gates = in_gates.take(x[t], 0)
        gates += h @ rec_gates
        _gate(gates)
        gates += 1
        gates *= 0.5
        new = h @ rec_new
        new *= gates[:, :n]
        new += in_new.take(x[t], 0)
        _gate(new)
        new -= h
        new *= gates[:, n:]
        h += new
        out[t] += h @ head


def pooled(texts: list[bytes], model: dict) -> np.ndarray:
    """Mean of the label probabilities of all positions of each text, (texts, languages); texts are not empty."""
    n_lang = len(model["bias"])
    sums = np.zeros((len(texts), n_lang))
    sizes = np.array([len(x) for x in texts])
    pieces = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), pieces)
    local = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    space = b" " * LEAD
    joined = np.frombuffer(space + space.join(text + b" " * (-len(text) % WINDOW) for text in texts) + space, np.uint8)
    base = np.concatenate([[0], np.cumsum(pieces * WINDOW + LEAD)[:-1]])
    begin = base[owner] + local * WINDOW
    length = np.minimum(WINDOW, sizes[owner] - local * WINDOW)
    for at in range(0, len(owner), TOGETHER):
        part = slice(at, at + TOGETHER)
        x = joined[begin[part][None, :] + np.arange(WINDOW + 2 * LEAD)[:, None]]
        score = np.broadcast_to(model["bias"], (*x.shape, n_lang)).copy()
        _states(x, model, "f", score)
        _states(x, model, "b", score)
        score = score[LEAD:-LEAD]
        score -= score.max(-1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(-1, keepdims=True)
        score *= (np.arange(WINDOW)[:, None] < length[part][None, :])[:, :, None]
        np.add.at(sums, owner[part], score.sum(0))
    return sums / sizes[:, None]


def _label(model: dict, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x.as_py() for x in part.column(1)]
                named, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                asked = [k for k, text in enumerate(texts) if text and LETTER.search(text)] if languages else []
                if asked:
                    found = pooled([texts[k].encode("utf-8", "surrogatepass") for k in asked], model)
                    for k, row in zip(asked, found):
                        named[k], scores[k] = languages[int(row.argmax())], min(1.0, float(row.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(named, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _cut(text: bytes) -> np.ndarray:
    """The whole text as windows of FIT_BYTES bytes, the last one filled up with spaces."""
    return np.frombuffer(text + b" " * (-len(text) % FIT_BYTES), np.uint8).reshape(-1, FIT_BYTES)


def fit_language_model(docs: DataFrame, rows: int = FIT_ROWS) -> tuple[dict, list[str]]:
    """(model, languages), learned from at most `rows` rows of `docs` that are not held out and have a language and a
    letter: those with the smallest seeded digests of doc_id, read whole. The driver holds these rows. A doc_id that repeats teaches
    all its texts. Without such rows the list is empty."""
    known = docs.where(~held_out()).where("lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    chosen = sampled(known, "doc_id", rows, "lang:").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    learned = texts.join(F.broadcast(chosen), "doc_id").where(F.col("text").rlike(r"\p{L}"))
    found = sorted((row.lang, bytes(row.raw)) for row in learned.select("lang", F.encode("text", "UTF-8").alias("raw")).collect())
    languages = sorted({lang for lang, _ in found})
    if not languages:
        return {}, []
    windows = [_cut(raw) for _, raw in found]
    label = np.repeat([languages.index(lang) for lang, _ in found], [len(x) for x in windows])
    return fit(np.concatenate(windows), label, len(languages)), languages


def predict_language(docs: DataFrame, model: dict, languages: list[str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of `docs`; score is the pooled probability of the language.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned. Rows
    that repeat are each returned; a null doc_id counts as not held out; only doc_id and text are read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_label(model, languages), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
