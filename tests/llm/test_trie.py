"""The prefix trie against a trie of plain dicts."""

import hashlib
import random
import zlib

import pytest

from quillmark.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, a string, at int, n_convs string, level int"


def plain_trie(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        own[c] = [(r[2] or "", r[3] or "") for r in turns]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) + (p not in kids)
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(docs).collect())


def talk(rng, n, most=9):
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue
        for t in range(rng.randrange(1, most)):
            rows.append((c, t if t or c % 3 else None, rng.choice(["user", "assistant", None]) if t > 1 else "user", rng.choice(["hello", "é", "", None, "what"]) if c % 2 else "same"))
    return rows


@pytest.mark.parametrize("heavy,band,queue,roots", [(64, 32, 100_000, 500_000), (2, 3, 2, 4)])
def test_trie(spark, monkeypatch, heavy, band, queue, roots):
    for name, value in (("HEAVY", heavy), ("BAND", band), ("QUEUE", queue), ("ROOTS", roots), ("IDS", 3 if heavy == 2 else 4096)):
        monkeypatch.setattr(trie, name, value)
    rows = talk(random.Random(1), 150) + [(None, 1, "user", "lost")]
    assert found(spark, rows) == plain_trie(rows)


def test_long_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 7)
    rows = [(10, t, "user", f"turn {t % 50} " + "long " * (2000 if t == 3 else 1)) for t in range(400)] + [(c, t, "user", f"turn {t % 50} " + "long " * (2000 if t == 3 else 1)) for c in (11, 13) for t in range(60)]
    assert found(spark, rows) == plain_trie(rows)


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "lost")]) == []
    assert found(spark, [(1, 1, "user", "alone")]) == plain_trie([(1, 1, "user", "alone")])


def test_queue_spills():
    queue, rng = trie.Messages(10), random.Random(2)
    sent = [((rng.randrange(40),), rng.randrange(9), 1) for _ in range(500)]
    for item in sent:
        queue.send(*item)
    assert len(queue.runs) > 5
    for key in range(40):
        assert queue.due((key,)) == (sum(x[1] for x in sent if x[0] == (key,)), sum(x[2] for x in sent if x[0] == (key,)))
    assert not queue
