"""Each corpus operator on small tables with odd rows, against a brute-force version where there is one."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmark.llm import common, decontam, embed_dup, langid, licences, lm_diff, mixing, near_dup, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, digest long, words string, row int"
WORDS = [a + b for a in "ba ko mi tu re lo".split() for b in "na si du ve ge po".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (40, 60, 80, 3, 2, 1, 400)]
    out = [None, "", " \n\t", "...", "é È 😀 <s> a", *base, base[0], base[1].upper(), "x" * 300]
    for text in base[:3]:
        for _ in range(4):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def table(spark, texts):
    """Documents with clashing extra columns and a null source and language."""
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", "s0", None, "s2"][i % 4], 1, "k", 1, 1, "w", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table(spark, texts).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("bound", [1024, 4])
def test_near_duplicates(docs, texts, monkeypatch, bound):
    monkeypatch.setattr(near_dup, "REGION_ROWS", bound)
    monkeypatch.setattr(near_dup, "UNIT_ROWS", bound)
    check_near_duplicates(docs, texts, 3, 85)


def check_near_duplicates(docs, texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(len(sets), links)
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs, size, percent).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    return want


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_beyond_the_bounds(spark, monkeypatch, percent):
    """A group far beyond the bounds, of versions that drift apart, with rows close to the threshold: nothing is lost."""
    monkeypatch.setattr(near_dup, "REGION_ROWS", 24)
    monkeypatch.setattr(near_dup, "UNIT_ROWS", 16)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 7, 9])):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(50))
        texts.append(" ".join(words))
    want = check_near_duplicates(table(spark, texts), texts, 5, percent)
    assert 3 < len(set(want)) < 200


def test_near_duplicates_of_odd_ids(spark, texts):
    """Null and repeated ids; two texts under one id."""
    a, b, c = texts[5], texts[6], texts[7]
    rows = spark.createDataFrame([(None, a), (3, a), (3, a), (2, a), (7, b), (7, c), (8, b), (6, c), (9, None), (9, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(rows, 3, 85).collect()), key=repr)
    n = [len(shingles(x, 3)) for x in (a, b, c)]
    want = [(None, n[0], None, True), (3, n[0], 2, False), (3, n[0], 2, False), (2, n[0], 2, True), (7, n[1], 7, True), (7, n[2], 6, False), (8, n[1], 7, False), (6, n[2], 6, True), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)
    left = sorted(((r.doc_id, r.text) for r in near_dup.first_copies(rows, 3, 85).collect()), key=repr)
    assert left == sorted([(None, a), (2, a), (7, b), (7, c), (6, c), (9, None), (None, None)], key=repr)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([], "item_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    for found in (
        near_dup.near_duplicates(empty), langid.predict_language(empty, *langid.fit_language_model(empty)), toxicity.grade_toxicity(empty, toxicity.fit_toxicity(empty, labels)),
        licences.licences(empty), tokens.token_counts(empty, model), quality.score_quality(empty, quality.fit_quality(empty, labels)), decontam.contaminated(empty, items),
        embed_dup.embedding_duplicates(vectors), mixing.mixed(empty), mixing.mix(empty), lm_diff.cross_entropy_difference(empty, labels),
    ):
        assert found.count() == 0


def test_components(spark):
    chain = [(i + 1, i) for i in range(8)] + [(100, 101), (7, 7)]
    got = dict(common.components(spark.createDataFrame(chain, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(9)} | {100: 100, 101: 100}


def test_components_of_a_long_chain(spark, monkeypatch):
    """A chain of 1,000 in the order of ids, and one in a mixed order, take few steps."""
    steps, real = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: steps.append(1) or real(df))
    order = list(range(2000, 2400))
    random.Random(2).shuffle(order)
    chain = [(i, i + 1) for i in range(1000)]
    got = dict(common.components(spark.createDataFrame(chain, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(1001)} and len(steps) <= 12
    got = dict(common.components(spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")).collect())
    assert got == {i: 2000 for i in order} and len(steps) <= 60


def test_token_counts(spark, docs, texts, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(tokens, "LONG", 200)
    monkeypatch.setattr(tokens, "CHUNK", 64)
    path = public_tokenizers.path("piece_bpe_32k.model")
    odd = ["  two  spaces\n\n\tand lines ▁ mark ", "a" * 500, "line\n" * 100, "трамвай " * 60, "日本語" * 90, "<s></s><unk> [INST]"]
    every = table(spark, [*texts, *odd, odd[2]])
    got = {r.doc_id: r for r in tokens.token_counts(every, path).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, text in enumerate([*texts, *odd, odd[2]]):
        assert got[i].n_tokens == len(library.encode(text or "")) and got[i].n_bytes == len((text or "").encode())
    twice = every.where("doc_id = 30").union(every.where("doc_id = 30"))
    assert tokens.token_counts(twice, path).count() == 2


def test_tokens_of_a_long_text_without_a_space():
    """State maps compose to the library's count, with and without boundaries, in any grouping and within small memory."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    machine, library = tokens.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    start = tokens.json.dumps(machine.start)
    rng = random.Random(3)
    for text in ("ab1xy" * 6_000, "日本語のテキスト" * 2_000, "word  and\n\nline " * 900, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "x   " * 3_000):
        whole, size = " " + text, 1_000
        maps = [machine.chunk_map(whole[max(0, k - tokens.LEAD) : k], whole[k : k + size]) for k in range(0, len(whole), size)]
        assert all(len(m) <= tokens.OFFSETS for m in maps) and list(maps[0]) == [start]
        left, right = tokens.composed(maps[:7]), tokens.composed(maps[7:])
        want = len(library.encode(text))
        assert tokens.composed([left, right])[start][1] == tokens.composed(maps)[start][1] == want


@pytest.mark.parametrize("lead", [256, 2])
def test_token_counts_in_levels(spark, monkeypatch, lead):
    """Texts of many chunks; with a lead that is too short, entry states are unknown and texts are passed in order."""
    import sentencepiece

    for name, value in (("LONG", 100), ("CHUNK", 32), ("FAN", 3), ("LEAD", lead), ("OFFSETS", min(16, lead))):
        monkeypatch.setattr(tokens, name, value)
    passed = []
    real = tokens._streamed
    monkeypatch.setattr(tokens, "_streamed", lambda model: passed.append(1) or real(model))
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = ["a" * 2_000, "internationalisation" * 90, "трамвай" * 200, "日本語" * 300, prose(rng, 400), " " * 900, "\n" * 500, "é😀" * 200, "a " * 600, "x" * 128]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, texts[1]), (0, texts[2])]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == sorted(((i, len(t.encode()), len(library.encode(t))) for i, t in rows), key=repr)
    assert passed or lead > 2


def test_language(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, languages = langid.fit_language_model(real, 800)
    rows = langid.predict_language(real, model, languages).join(real, "doc_id").where("held_out and length(text) > 100").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r.lang_pred for r in langid.predict_language(docs, model, languages).collect()}
    assert [odd[i] for i in range(4)] == ["und"] * 4 and odd[5] != "und"
    assert {r.lang_pred for r in langid.predict_language(docs, {}, []).collect()} == {"und"}


def test_language_gradient():
    """Backpropagation agrees with finite differences."""
    rng = np.random.default_rng(0)
    x, model = rng.integers(0, 256, (3, 6)).astype(np.uint8), {k: v.astype(np.float64) for k, v in langid._fresh(2).items()}
    out = rng.normal(size=(6, 3, langid.HIDDEN))
    loss = lambda: sum((out[t] * k[-1]).sum() for t, k in enumerate(langid._forward(x, model, "f")))
    grad = {k: np.zeros_like(v) for k, v in model.items()}
    langid._backward(x, langid._forward(x, model, "f"), out, model, "f", grad)
    for at in ((0, 1), (3, 10), (7, 23)):
        model["recf"][at] += 1e-3
        up = loss()
        model["recf"][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grad["recf"][at]) < 1e-2 * max(1, abs(grad["recf"][at]))
        model["recf"][at] += 1e-3


def test_toxicity(spark, docs):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words, bad = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)], i % 8 == 0
        if bad:
            for k in range(1 + i % 5):
                words[k * 7] = ["vile", "foul"][k % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    every, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(every, marks)
    assert {"vile", "foul"} <= set(model["words"]) and (np.diff(model["cuts"]) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade_toxicity(every, model).collect()}
    assert np.mean([got[i].toxic == (i % 8 == 0) for i in got]) > 0.98 and all(0 <= r.severity <= 3 for r in got.values())
    assert toxicity.without_toxic(every, model).count() == sum(not r.toxic for r in got.values())
    assert toxicity.grade_toxicity(docs, model).count() == docs.count()
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_of_a_rare_language(spark):
    """Beginnings of words of a few rows are learned, also where no whole word comes back and clean rows hold one."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        rare, bad = i % 15 < 2, i % 15 == 0 or i % 15 == 5
        words = [("ol" if rare else "") + rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
        for k in range(5 if bad else 0):
            words[k * 7] = "vorq" + rng.choice(WORDS) + rng.choice(WORDS) if rare else ["vile", "foul"][k % 2]
        if rare and i % 45 == 1:
            words[9] = "vorq" + rng.choice(WORDS)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    every, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.grade_toxicity(every, toxicity.fit_toxicity(every, marks)).collect()}
    tested = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0 and i % 15 < 2]
    assert np.mean([got[i] == (i % 15 == 0) for i in tested]) > 0.95


def test_licences(spark):
    other = "The MIT Licence\nCopyright (c) 2019 Somebody\n\n" + licences.MIT.split("\n\n", 1)[1].upper().replace(" ", "  ")
    rows = [(0, licences.MIT), (1, "Copyright 2001 X\n" + licences.MIT.replace(",", ";")), (2, "text\nreleased under the mit LICENCE\nmore"), (3, None), (4, ""), (5, other), (2, "again")]
    rows += [(None, "x\nSPDX-License-Identifier: MIT"), (8, licences.BSD_3.replace("acknowledgment", "acknowledgement").replace("\n\n", "\n")), (9, "programmer per century licence sub licence"), (9, licences.APACHE_NOTICE.lower()), (10, "the licence  Licence\norganise")]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.licence, tuple(r.notices)) for r in got), key=repr)
    want = [(0, "MIT", ()), (1, "MIT", ()), (2, None, ("MIT",)), (3, None, ()), (4, None, ()), (5, None, ()), (2, None, ()), (None, None, ("MIT",)), (8, "BSD-3-Clause", ()), (9, None, ()), (9, "Apache-2.0", ()), (10, None, ())]
    assert found == sorted(want, key=repr)
    digest = {r.doc_id: r.digest for r in got}
    import hashlib

    form = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert digest[3] is None and digest[4] == form("") and digest[10] == form("the license license organize")
    assert {form("programmer per century license sublicense"), form("again")} <= {r.digest for r in got}


def test_quality(spark, docs):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit_quality(real, labels)
    rows = quality.score_quality(real, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert quality.score_quality(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(docs, None).select("score").distinct().collect()[0][0] == 0.5
    assert quality.good_only(docs, model).columns == docs.columns


def test_decontamination(spark, docs, texts):
    item = " ".join(texts[11].split()[100:130])
    items = spark.createDataFrame([(0, item.upper()), (1, item.replace(item.split()[0], "zzz", 1)), (2, "one two three four five six"), (3, "few words"), (4, None), (5, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.containment for r in decontam.contaminated(docs, items).collect()}

    def held(text, part):
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in ((text or "").lower().split(), (part or "").lower().split())]
        return len(sets[0] & sets[1]) / len(sets[1]) if sets[1] else 0

    parts = [r.text for r in items.orderBy("item_id").collect()]
    want = {(i, k): held(t, p) for i, t in enumerate(texts) for k, p in enumerate(parts) if held(t, p) >= 0.8}
    assert found == pytest.approx(want) and want
    assert decontam.decontaminated(docs, items).count() == len(texts) - len({i for i, _ in want})


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_of_all_sizes(spark, monkeypatch, broadcast):
    """Items of every size partition with shares around the bound, a passage that many documents hold, rows that repeat."""
    if not broadcast:
        monkeypatch.setattr(decontam, "small", lambda df: df)
    rng = random.Random(9)
    parts = [prose(rng, n) for n in (5, 6, 9, 14, 22, 40, 70, 150, 300)]
    rows = []
    for i in range(180):
        words = rng.choice(parts).split()
        for _ in range(rng.randrange(1 + len(words) // 20)):
            words[rng.randrange(len(words))] = "changed"
        words = words[: rng.randrange(len(words) * 7 // 10, len(words) + 1)]
        rows.append((i, f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 20)} {parts[1] if i % 3 else ''}"))
    rows += [rows[4], (5, rows[6][1]), (None, parts[3]), (200, None), (201, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(parts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontam.contaminated(docs, items).collect()}
    sets = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    want, held = {}, [sets(p) for p in parts]
    for i, t in rows:
        found = sets(t) if i is not None else set()
        for k, p in enumerate(held):
            if found and 100 * len(found & p) >= 80 * len(p):
                want[i, k] = (len(p), max(len(found & p), want.get((i, k), (0, 0))[1]))
    assert got == want and {k for _, k in want} == set(range(len(parts)))


@pytest.mark.parametrize("leaf", [600, 40])
def test_embeddings(spark, monkeypatch, leaf):
    monkeypatch.setattr(embed_dup, "LEAF", leaf)
    monkeypatch.setattr(embed_dup, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(260, 16))
    x[100:180] = x[100] + rng.normal(size=(80, 16)) * 0.12
    x[180:200] = x[5] + rng.normal(size=(20, 16)) * 0.25
    x[200:210] = 3 * x[7]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None, *[1.0] * 15]), (904, [float("nan"), *[1.0] * 15]), (905, [1.0, 2.0])]
    got = {r.vec_id: r for r in embed_dup.embedding_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    u = np.array([r[1] for r in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_components(len(u), np.argwhere(near).tolist())
    assert len(got) == len(rows) + len(odd) and all(got[i].n_links == 0 and got[i].kept for i, _ in odd)
    right = [got[i].n_links == near[i].sum() - 1 and got[i].component_id == want[i] for i in range(len(u))]
    found, true = np.array([got[i].n_links for i in range(len(u))]), near.sum(1) - 1
    assert (found <= true).all()
    # leaves far below the production size still find most links of groups that they cut apart
    assert all(right) if leaf == 600 else found.sum() >= 0.8 * true.sum()


@pytest.mark.parametrize("leaf", [600, 40])
def test_embeddings_of_several_lengths(spark, monkeypatch, leaf):
    """Every length is compared; rows that repeat count once; null ids link with nothing; groups and leaves meet in blocks.
    Leaves of 40 rows send two lengths through the forest and may miss a link, but none that is found is false."""
    monkeypatch.setattr(embed_dup, "LEAF", leaf)
    monkeypatch.setattr(embed_dup, "BLOCK", 20)
    monkeypatch.setattr(embed_dup, "DEEPER", 1)
    rng = np.random.default_rng(9)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([rng.normal(size=(60, 8)), rng.normal(size=8) + rng.normal(size=(90, 8)) * 0.16]))]
    rows += [(200 + k, v.tolist()) for k, v in enumerate(rng.normal(size=(70, 2)))] + [(300, [0.0, 1.0, 0.0]), (301, [0.0, 2.0, 0.1]), (302, [1.0, 0.0, 0.0]), (303, [4.0])]
    repeated = [rows[70], rows[70], rows[0], rows[-2], (7, rows[75][1]), (None, rows[70][1]), (None, None)]
    distinct = list({(i, *v): (i, v) for i, v in rows + [x for x in repeated if x[0] is not None]}.values())
    near = np.array([[len(a) == len(b) and np.dot(a, b) >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b) for _, b in distinct] for _, a in distinct])
    want = {}
    for k, c in enumerate(brute_components(len(distinct), np.argwhere(near).tolist())):
        want.setdefault(c, []).append(k)
    want = {k: min(distinct[j][0] for j in part) for part in want.values() for k in part}
    expected = {(i, *v): (int(near[k].sum()) - 1, want[k]) for k, (i, v) in enumerate(distinct)}
    every = rows + repeated
    found = embed_dup.embedding_duplicates(spark.createDataFrame([(i, v, "x") for i, v in every], "vec_id long, embedding array<double>, class string")).collect()
    right = sorted((i, *expected[(i, *v)]) if i is not None else (-1, 0, -1) for i, v in every)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in found)
    if leaf == 600:
        assert got == right
    else:
        assert [r[0] for r in got] == [r[0] for r in right] and all(x[1] <= y[1] for x, y in zip(got, right))
        assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in right)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_embeddings_left_by_their_leader(spark, monkeypatch):
    """Vectors whose leader a later round takes from them are compared themselves, not by the leader."""
    member = spark.createDataFrame([(0, [1.0, 0.0], 0, 1.0), (1, [0.99, 0.141], 0, 0.99), (2, [0.96, 0.28], 1, 0.99)], "vec_id long, vec array<double>, leader long, near double")
    radius = {r.vec_id: r.r for r in embed_dup._leaders(member).collect()}
    assert radius == pytest.approx({0: np.arccos(0.99), 1: np.arccos(0.99)})
    monkeypatch.setattr(embed_dup, "BLOCK", 40)
    x = np.random.default_rng(6).normal(size=(400, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = brute_components(len(u), np.argwhere(near).tolist())
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dup.embedding_duplicates(rows).collect()}
    assert all(got[i].n_links == near[i].sum() - 1 and got[i].component_id == want[i] for i in range(len(u)))


def test_forests_write_no_vectors(spark, monkeypatch):
    """Leaves of ten trees were written with all their vectors, again for each level; now a vector is written as a point of a step alone."""
    written, cut = [], embed_dup.cut
    monkeypatch.setattr(embed_dup, "cut", lambda df: written.append(kept := cut(df)) or kept)
    monkeypatch.setattr(embed_dup, "LEAF", 40)
    monkeypatch.setattr(embed_dup, "TURN", 2_400)
    x = np.random.default_rng(4).normal(size=(600, 8))
    x[300:] = x[:300] + np.random.default_rng(5).normal(size=(300, 8)) * 0.05
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dup.embedding_duplicates(rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(1) - 1
    assert all(got[i] <= true[i] for i in got) and sum(got.values()) >= 0.95 * true.sum()
    held = [df for df in written if "vec" in df.columns]
    assert not any("tree" in df.columns for df in written) and sum(df.count() for df in held) <= 5 * len(x)


def test_codes_are_off_by_no_more_than_they_say(spark):
    """Pairs at the limit itself: a code alone decides none of them, and none that it does decide wrongly."""
    rng = np.random.default_rng(8)
    x = embed_dup.unit(rng.normal(size=(200, 64)))
    side = embed_dup.unit((y := rng.normal(size=x.shape)) - (y * x).sum(1, keepdims=True) * x)
    angle = np.arccos(0.95) + rng.choice([-1e-3, -1e-7, 1e-7, 1e-3], 200)
    both = np.concatenate([x, np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * side])
    code, step = embed_dup.codes(both)
    group = embed_dup.pa.table({"vec_id": np.arange(400), "r": np.zeros(400), "step": step, "code": [row.tobytes() for row in code]})
    found = embed_dup._compare(0.95)(group)
    true = (both @ both.T)[found["a"], found["b"]]
    assert (np.abs(found["cos"] - true) <= found["off"]).all() and found["off"].max() < 1e-3
    want = {(i, i + 200) for i in range(200) if angle[i] <= np.arccos(0.95)}
    assert want <= set(zip(found["a"].tolist(), found["b"].tolist()))


def test_mixing(spark, docs):
    rng = random.Random(3)
    many = table(spark, [prose(rng, rng.randint(1, 40)) for _ in range(600)]).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = mixing.mixed(many).collect()
    assert len(rows) == many.count() and all(r.taken <= 3 * r["size"] for r in rows)
    sums = {}
    for r in rows:
        sums.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert len(sums) == 4 and all(abs(t - n) <= 400 for t, n in sums.values())
    assert sum(t for t, _ in sums.values()) == pytest.approx(sum(sums)) and rows == mixing.mixed(many).collect()
    # the first source wants more than three times its size: it stops there and the rest is shared again
    sized = spark.createDataFrame([(0, "a", 10, 0), (1, "b", 100, 1), (2, None, 100, 2)], "doc_id long, source string, size long, digest long")
    targets = {r.source: r.target for r in mixing.mix_plan(sized).collect()}
    assert targets == pytest.approx({"a": 30, "b": 120, None: 60})
    taken = mixing.mix(docs)
    assert set(docs.columns) | {"copies"} == set(taken.columns)


@pytest.mark.parametrize("bound", [1 << 20, 300])
def test_language_models(spark, docs, texts, monkeypatch, bound):
    """Against counts in plain dicts, a document's own words left out; many batches and ranges count as one."""
    from collections import Counter
    from math import log

    monkeypatch.setattr(lm_diff, "BATCH_BYTES", bound)
    monkeypatch.setattr(lm_diff, "RANGE_BYTES", bound)
    chosen = {5, 6, 13}
    every = docs.union(docs.where("doc_id in (6, 9)")).union(table(spark, [texts[11] * 20]).withColumn("doc_id", F.lit(None).cast("long")))
    target = spark.createDataFrame([(5,), (6,), (13,), (None,)], "doc_id long")
    rows = [(r.doc_id, [""] + r.text.lower().encode().split() if (r.text or "").split() else []) for r in every.collect()]
    count = lambda words: Counter(words) + Counter(zip(words, words[1:]))
    models = [sum((count(w) for _, w in rows), Counter()), sum((count(w) for i, w in rows if i in chosen), Counter())]
    vocabulary = {x for _, w in rows for x in w}
    sizes = [sum(c for x, c in model.items() if x in vocabulary) for model in models]

    def loss(model, size, own, words):
        left, n = model - own, size - sum(c for x, c in own.items() if x in vocabulary)
        p = lambda v, w: (left[v, w] + 0.5 * (left[w] + 0.5) / (n + 0.5 * len(vocabulary))) / (left[v] + 0.5)
        return -sum(log(p(v, w)) for v, w in zip(words, words[1:])) / (len(words) - 1)

    want = []
    for i, w in rows:
        own = [count(w), count(w) if i in chosen else Counter()]
        want.append((i, max(0, len(w) - 1), *(round(loss(models[k], sizes[k], own[k], w), 6) if w else None for k in (1, 0))))
    got = lm_diff.cross_entropy_difference(every, target).collect()
    assert sorted(((r.doc_id, r.n_tokens, *(None if x is None else round(x, 6) for x in (r.target_loss, r.background_loss))) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r.difference is None) == (r.n_tokens == 0) for r in got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, want = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = common.cut(stage(spark, kept, "/root/testdata/sf0.001"))
        want = want.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
        assert kept.select(*docs.columns).exceptAll(docs).count() == 0, name
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(corpus_pipeline.run(spark, "/root/testdata/sf0.001")) == ids(kept) == ids(want)


def test_pipeline_stages_with_odd_rows(spark, texts):
    """Null ids and texts, rows that repeat, clashing columns, a very long text and an empty table, through each stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = table(spark, [*texts, prose(random.Random(1), 60_000)])
    odd = plain.union(plain.where("doc_id in (0, 4)")).union(plain.where("doc_id in (0, 5)").withColumn("doc_id", F.lit(None).cast("long")))
    count = lambda df, where: df.where(where).count()
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd, sf)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert kept.columns == [*odd.columns, *(["copies"] if last else [])], name
        kept = common.cut(kept)
        assert kept.select(*odd.columns).exceptAll(odd).count() == 0, name
        if name not in ("quality classifier", corpus_pipeline.STAGES[-1][0]):
            # a text without words is never rejected, but near-dedup keeps rows that repeat an id and a text once
            once = name == "MinHash near-dedup"
            assert count(kept, "text is null and doc_id = 0") == (1 if once else 2) and count(kept, "text is null and doc_id is null") == 1, name
            assert count(kept, "length(text) > 100000") == 1, name
        assert common.cut(stage(spark, odd.limit(0), sf)).count() == 0, name
