"""The network's pooled probabilities against a plain pass over whole texts, and its windows against the texts."""

import random

import numpy as np

from quillmark.llm import langid


def plain(text, model):
    """Mean over positions of the probabilities of both directions, a step at a time over the whole text."""
    n = langid.HIDDEN
    lead = b" " * langid.LEAD
    x = np.frombuffer(lead + text + b" " * (-len(text) % langid.WINDOW) + lead, np.uint8)
    score = np.tile(model["bias"].astype(np.float64), (len(x), 1))
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h = np.zeros(n)
        for t in order:
            a, r = model["in" + side][x[t]].astype(np.float64), h @ model["rec" + side]
            gates = a[: 2 * n] + r[: 2 * n]
            gates = 0.5 + 0.5 * gates / (1 + np.abs(gates))
            new = a[2 * n :] + gates[:n] * r[2 * n :]
            h = h + gates[n:] * (new / (1 + np.abs(new)) - h)
            score[t] += h @ model["out" + side]
    p = np.exp(score - score.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True))[langid.LEAD : langid.LEAD + len(text)].mean(0)


def test_pooled_windows_are_near_a_plain_pass():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["der", "the", "les", "el", "ß", "x1"]) for _ in range(n)).encode() for n in (1, 5, 40, 300, 2000)]
    model = langid._fresh(3)
    found = langid.pooled(texts, model)
    assert np.allclose(found.sum(1), 1)
    for text, row in zip(texts, found):
        # exact for a text of one window; beyond, a window sees only LEAD bytes of what lies outside
        assert np.abs(row - plain(text, model)).max() < (1e-4 if len(text) <= langid.WINDOW else 0.01)


def test_windows_hold_the_whole_text():
    for n in (1, 47, 48, 49, 5000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        cut = langid._cut(text)
        assert cut.tobytes()[:n] == text and cut.shape[1] == langid.FIT_BYTES and len(cut) == -(-n // langid.FIT_BYTES)
