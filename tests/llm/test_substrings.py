"""Substring dedup against a plain dict of windows."""

import hashlib
import random

import pyarrow as pa

from quillmark.llm import substrings

SCHEMA = "doc_id long, text string, k string, names string, kept int, since long"
VOCABULARY = [a + b for a in "ba ko mi tu re lo".split() for b in "na si du ve ge po".split()]


def plain(rows, size=20):
    """(doc_id, words, removed, digest) of rows (doc_id, text) with distinct ids, in order of the ids, nulls last."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone.update(range(i, i + size))
            seen.add(window)
        left = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "k", "n", 1, 2) for r in rows], SCHEMA)
    got = substrings.removal_digests(substrings.without_repeats(docs)).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0))


def corpus(rng, n):
    """Prose over few words with shared passages, near and exact copies, periodic stretches and texts about as long as a window."""
    def prose(m):
        return [rng.choice(VOCABULARY) for _ in range(m)]

    passages = [prose(rng.randrange(15, 90)) for _ in range(6)]
    texts = [None, "", " \t\n", "a " * 19, "a " * 20, "a " * 21, "b a " * 200, "b\x0ba\x0c" * 30, " ".join(VOCABULARY[:19]), " ".join(VOCABULARY[:20]), " ".join(VOCABULARY[:21])]
    for period in range(2, 26):  # repeats within one text alone, down to a single window that comes twice
        unit = [f"u{period}x{k}" for k in range(period)]
        texts += [" ".join((unit * 40)[: 20 + more]) for more in (period - 1, period, period + 1, 3 * period)]
    while len(texts) < n:
        words = []
        for _ in range(rng.randrange(1, 6)):
            piece = rng.choice(passages) if rng.random() < 0.4 else prose(rng.randrange(1, 60))
            words += piece[rng.randrange(len(piece)) :] if rng.random() < 0.2 else piece
            if rng.random() < 0.1:
                words += [rng.choice("xyz")] * rng.randrange(1, 50)
        texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    ids = rng.sample(range(-50, 10 * n), len(texts))
    return list(zip(ids, texts))


def test_windows_removed_as_a_plain_dict_says(spark, monkeypatch):
    rows = corpus(random.Random(4), 300)
    rows[7] = (None, rows[7][1])
    want = plain(rows)
    assert sum(r[2] for r in want) > 3000
    assert found(spark, rows) == want
    monkeypatch.setattr(substrings, "BATCH_BYTES", 1000)
    assert found(spark, rows) == want


def test_names_are_consistent_inside_equal_windows():
    """What decides a symbol lies between its bounds: another context leaves all of them as they are."""
    rng = random.Random(6)
    for _ in range(60):
        core = [rng.choice("abcdef" if rng.random() < 0.5 else VOCABULARY) for _ in range(40)]
        both = []
        for _ in range(2):
            left, right = ([rng.choice("abcdef") for _ in range(rng.randrange(5))] for _ in range(2))
            words = substrings.Words(pa.array([" ".join([*left, *core, *right])]))
            symbols = substrings.recompress(words, 4)
            n = len(left)
            both.append({(int(name), int(s) - n, int(e) - n, int(lo) - n, int(hi) - n) for name, s, e, lo, hi, _ in zip(*symbols) if lo >= n and hi <= n + 40})
        assert both[0] == both[1]


def test_repeated_rows_and_ids(spark):
    text = " ".join(VOCABULARY[:30])
    got = found(spark, [(1, text), (1, text), (2, text), (2, text), (3, "x " + text), (None, text), (None, text)])
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, 30), (2, 30), (3, 30), (None, 30), (None, 30)]
    got = found(spark, [(1, text), (1, text + " end"), (4, "short")])
    assert sorted(r[2] for r in got) in ([0, 0, 30], [0, 0, 31])


def test_no_rows_and_a_very_long_text(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == plain([(1, None), (2, "")])
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(30_000)) for _ in range(150_000))
    rows = [(1, long), (2, "z " * 5000 + long[:2000]), (3, long + " " + long[5000:6000])]
    assert found(spark, rows) == plain(rows)
