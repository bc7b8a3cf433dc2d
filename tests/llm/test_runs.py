"""Periodic runs against a plain search of every period."""

import hashlib
import random
import zlib

from quillmark.llm import runs

SCHEMA = "doc_id long, text string, runs string, start long, collapsed string, w int"


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def planted(key, text):
    words = (text or "").encode().split()
    if key is None or not words or zlib.crc32(str(key).encode()) % 10:
        return [w.decode() for w in words]
    g, n = zlib.crc32(str(key).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p].decode() for i in range(n)]


def collapsed(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a a a a a a", "a a a a a", "é\x0bé\x0cé\ré é é", "a\xa0b a\xa0b a b a b a b a b", "x " * 3000, "p q r " * 2000 + "s " * 4000]
    for _ in range(160):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            parts += unit * rng.choice([1, 1, 3, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
        out.append(" ".join(parts))
    return out


def rows_of(spark, texts):
    rows = [(i if i % 11 else None, t, "r", 1, "c", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (5, "b b b b b b b", "r", 1, "c", 2)], SCHEMA)


def test_runs_equal_a_plain_search(spark, monkeypatch):
    for size in (1 << 20, 50):
        monkeypatch.setattr(runs, "BATCH_BYTES", size)
        docs = rows_of(spark, texts())
        want = sorted((r.doc_id is None, r.doc_id or 0, plain_runs(w := (r.text or "").encode().split()), collapsed([x.decode() for x in w], plain_runs(w))) for r in docs.collect() if len(r.text or "") < 5000)
        got = sorted((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs.where("coalesce(length(text), 0) < 5000")).collect())
        assert got == want
    long = {r.doc_id: r for r in runs.periodic_runs(docs.where("length(text) >= 5000")).collect()}
    assert [tuple(x) for x in long[7].runs] == [(0, 3000, 1)] and long[7].collapsed == "x"
    assert [tuple(x) for x in long[8].runs] == [(0, 6000, 3), (6000, 4000, 1)] and long[8].collapsed == "p q r s"


def test_digests_of_planted_documents(spark):
    docs = rows_of(spark, texts()[:7] + texts()[9:])
    got = sorted(map(tuple, runs.run_digests(runs.periodic_runs(runs.with_planted_runs(docs))).collect()), key=str)
    want = []
    for r in docs.collect():
        words = planted(r.doc_id, r.text)
        found = plain_runs(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((r.doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert any(r[1] for r in got)


def test_no_rows_and_a_very_long_text(spark):
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_runs(spark.createDataFrame([], SCHEMA)))).count() == 0
    text = " ".join(str(i) for i in range(200_000)) + " z" * 200_000
    row = runs.periodic_runs(spark.createDataFrame([(1, text, "", 0, "", 0)], SCHEMA)).first()
    assert [tuple(x) for x in row.runs] == [(200_000, 200_000, 1)] and row.collapsed.endswith("199999 z")
