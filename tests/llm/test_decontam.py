import random
import sys

import numpy as np
import pyarrow as pa

from concord.llm import decontam

RNG = random.Random(5)
RARE = ["".join(RNG.choice("abcdefghilmnoprstuz") for _ in range(RNG.randrange(3, 10))) for _ in range(4000)]


def prose(n):
    return [RNG.choice(["the", "of", "and", "in", "to"]) if RNG.random() < 0.4 else RNG.choice(RARE) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_bit_parallel_lcs():
    for _ in range(50):
        a, b = [RNG.randrange(9) for _ in range(RNG.randrange(1, 90))], [RNG.randrange(9) for _ in range(RNG.randrange(90))]
        assert decontam.lcs_words(decontam.Item(1, a, []).masks, len(a), b) == lcs(a, b)


def test_leaks(spark, docs):
    items = [prose(n) for n in (8, 15, 24, 30, 48, 70, 120)]
    rows, want = [(k, " ".join(prose(300))) for k in range(150)], set()
    for k, item in enumerate(items):
        for at in (0, 13, 140, 290):
            loose = [w.upper() + "," if RNG.random() < 0.3 else w for w in item]
            if at == 140:  # a paraphrase: one word in ten is another
                loose = [RNG.choice(RARE) if n % 10 == 4 else w for n, w in enumerate(loose)]
            text = prose(300)
            rows.append((1000 + 10 * k + at % 7, " ".join(text[:at] + loose + text[at:])))
            want.add((1000 + 10 * k + at % 7, k))
    rows += [(5000, None), (5001, ""), (5002, " ".join(items[1])), (5003, " ".join(prose(20_000) + items[3] + prose(20_000))), (5004, " ".join(prose(150) + items[4][:20] + prose(150)))]
    want |= {(5002, 1), (5003, 3)}
    bench = spark.createDataFrame([(k, " ".join(i), "x") for k, i in enumerate(items)] + [(90, None, "x"), (91, "too short", "x"), (None, " ".join(prose(20)), "x")], "item_id long, text string, doc_id string")
    d = docs(*rows)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()} == want
    left = {r.doc_id for r in decontam.clean(d, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}


def test_answer_lowers_the_bar(spark, docs):
    question, answer = prose(30), prose(6)
    partly = [w if n % 3 else RNG.choice(RARE) for n, w in enumerate(question)]
    bench = spark.createDataFrame([(1, " ".join(question) + ". " + " ".join(answer))], "item_id long, text string")
    rows = [(k, " ".join(prose(200))) for k in range(40)] + [(100, " ".join(prose(60) + partly + answer + prose(60))), (101, " ".join(prose(60) + partly + prose(66)))]
    assert {r.doc_id for r in decontam.leaks(docs(*rows), bench).collect()} == {100}


def test_empty(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(prose(20)))], "item_id long, text string")
    assert decontam.leaks(docs(), bench).count() == 0
    assert decontam.leaks(docs((1, "a b")), bench.limit(0)).count() == 0


def test_clean_drops_rows_not_ids(spark, docs):
    item, texts = prose(30), [" ".join(prose(80)) for _ in range(4)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    leak = " ".join(prose(40) + item + prose(40))
    d = docs((None, texts[0]), (None, leak), (None, texts[1]), (5, leak), (5, texts[2]), (6, texts[3]), (None, None))
    left = [(r.doc_id, r.text) for r in decontam.clean(d, bench).collect()]
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (6, texts[3]), (None, None)]
    assert sorted(left, key=str) == sorted(want, key=str) and decontam.clean(d, bench).columns == d.columns


def test_paraphrases_without_the_rarest_words(spark, docs):
    rng = random.Random(8)
    usual = [f"u{n}" for n in range(60)]  # each in less than a fifth of the documents
    for n_docs in (200, 3000):
        rows = [(k, " ".join(rng.choice(usual) if rng.random() < 0.14 else rng.choice(RARE) for _ in range(80))) for k in range(n_docs)]
        items, want = [], set()
        for k in range(12):
            own = rng.sample(usual, 24)
            item, answer = own[:20] + [f"r{k}x{n}" for n in range(4)], own[20:] if k % 2 else []
            rng.shuffle(item)
            items.append(" ".join(item) + (". " + " ".join(answer) if answer else ""))
            gone = set(own[:6]) if answer else set()  # 18 of 28 are left with the answer, 20 of 24 without
            changed = [f"other{n}" if w in gone or w[0] == "r" else w for n, w in enumerate(item)]
            rows.append((10_000 + k, " ".join([*prose(40), *changed, *answer, *prose(40)])))
            want.add((10_000 + k, k))
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
        found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(*rows), bench).collect()}
        assert found == want, (n_docs, len(found))


def test_decomposition_of_all_documents(spark, docs):
    """The span of the word vectors is that of the plain sum over all passages and of the items, with hot null ids and more documents than 2,000."""
    rng, vocabulary = random.Random(4), {f"v{n}": n for n in range(30)}
    texts = [" ".join(rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.choice([3, 40, 90]))) for _ in range(2500)]
    texts += [" ".join(rng.choice(list(vocabulary)) for _ in range(9000))]
    idf, item = np.linspace(1, 3, 30), decontam.Item(1, [0, 3, 5, 7, 9], [])
    q = np.random.default_rng(11).standard_normal((30, 6), np.float32)
    own = np.zeros((1, 30))
    own[0, item.ids] = idf[item.ids]
    rows = []
    for t in texts:
        ids = decontam.Ids(vocabulary).of(t)
        block = np.zeros((-(-len(ids) // 24) + 2, 30))
        for n, w in enumerate(ids):
            if w >= 0:
                block[n // 24 + 1, w] += idf[w]
        rows.append(block[1:] + block[:-1])
    a = np.concatenate(rows)
    for _ in range(2):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    q, _ = np.linalg.qr(np.hstack([own.T, q]))
    tokens = decontam._tokens(docs(*((k if k % 3 else None, t) for k, t in enumerate(texts))), vocabulary)
    got = decontam._latent(tokens, [item], idf, 6) / idf[:, None]
    assert np.allclose(got @ got.T, q @ q.T, atol=1e-2)


def test_benchmark_in_slices(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 5)
    items = [prose(20) for _ in range(14)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    d = docs(*((k, " ".join(prose(40) + i + prose(40))) for k, i in enumerate(items)), (99, " ".join(prose(90))))
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()} == {(k, k) for k in range(14)}
    assert [r.doc_id for r in decontam.clean(d, bench).collect()] == [99]


def plain_leaks(text, items):
    """Items of which some part of the text has 0.8 in common order, by plain dynamic programming over every region."""
    own, out = decontam.words(text), set()
    for i, item in items:
        w = decontam.words(item)
        size = decontam.span(len(w))
        if any(lcs(w, own[o : o + size]) >= 0.8 * len(w) for o in range(max(1, len(own) - size + 1))):
            out.add(i)
    return out


def test_against_brute_force(spark, docs):
    """Every text and item by brute force: no verbatim or changed item is missed, nothing else is reported."""
    rng = random.Random(2)
    items = [(k, " ".join(prose(rng.choice([8, 12, 20, 33])))) for k in range(9)]
    rows = []
    for k in range(60):
        own = decontam.words(items[k % 9][1])
        for n in rng.sample(range(len(own)), k % 5):  # up to four words changed, left out or moved
            own[n] = rng.choice(RARE) if rng.random() < 0.5 else ""
        rows.append((k, " ".join(prose(rng.randrange(30)) + own + prose(rng.randrange(60)))))
    rows += [(100 + k, " ".join(prose(rng.randrange(90)))) for k in range(40)]
    want = {(k, i) for k, t in rows for i in plain_leaks(t, items)}
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(found) == want and len(want) > 15


def test_paraphrases_at_the_very_limit():
    """32 of an item's 40 words in order within 50 words, all other words foreign, and one word fewer."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    item = decontam.Item(0, list(range(40)), [])
    for k in range(200):
        kept = sorted(rng.sample(range(40), 32 - k % 2))
        places = sorted(rng.sample(range(50), len(kept)))
        text = [-1] * (50 + 200)
        o = rng.randrange(200)
        for p, w in zip(places, kept, strict=True):
            text[o + p] = w
        best, _ = item.check(np.array(text), 0, len(text))
        assert best == len(kept) / len(words)


def hand_model(items, texts):
    """A model without Spark: word vectors are idf times the identity, so that dot products are plain TF-IDF."""
    vocabulary = {}
    for w in (w for i in items for w in i):
        vocabulary.setdefault(w, len(vocabulary))
    held = [set(decontam.words(t)) for t in texts]
    df = np.array([sum(w in t for t in held) for w in vocabulary])
    latent = np.diag(np.log((len(texts) + 1) / (df + 1)) + 1) * (df <= 0.2 * len(texts))[:, None]
    own = [decontam.Item(k, [vocabulary[w] for w in i], [vocabulary[w] for w in i[-5:]] if k % 2 else []) for k, i in enumerate(items)]
    queries = np.array([latent[i.ids].sum(0) for i in own])
    return decontam.Retrieval(decontam.Ids(vocabulary), latent, own, queries, np.sqrt((queries**2).sum(1))), vocabulary


def test_words_of_many_texts(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "  ", "...", "the THE, 'the' --", "a\x1cthe\x85of　and\xa0in", "İn THE ΣΑΣ ΟΔΟΣ. straße", "the", None, *(" ".join(prose(rng.randrange(200))) for _ in range(60))]
    vocabulary = {w: n for n, w in enumerate(["the", "of", "and", "i̇n", "σας", "οδος", "straße", *RARE[:500]])}
    want = [[vocabulary.get(w, -1) for w in decontam.words(t)] for t in texts]
    for most in (1, 700, 1 << 20):
        monkeypatch.setattr(decontam, "TEXT_BYTES", most)
        ids, ends = decontam.Ids(vocabulary).of_all(pa.array([*texts, "cut off"]).slice(0, len(texts)))
        assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)] == want
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ids, ends = decontam.Ids({}).of_all(pa.array([f"a{chr(c)}b" for c in every]))
    assert np.diff(ends).tolist() == [len(decontam.words(f"a{chr(c)}b")) for c in every]


def test_search_of_many_documents_is_that_of_each(monkeypatch):
    """Passages by plain dot products, and what is found, document by document; nothing crosses from one to the next."""
    rng = random.Random(7)
    items = [prose(n) for n in (6, 12, 20, 30, 45, 60, 90, 700)]
    texts = [" ".join(prose(rng.randrange(400))) for _ in range(120)]
    for k in range(90):
        item, at = list(items[k % 8]), rng.randrange(300)
        for n in rng.sample(range(len(item)), len(item) * (k % 4) // 10):
            item[n] = rng.choice(RARE)
        own = prose(300)
        texts.append(" ".join(own[:at] + item + own[at:]))
    for item in items:  # one half at the end of a document, the other at the beginning of the next
        texts += [" ".join(prose(50) + item[: len(item) // 2]), " ".join(item[len(item) // 2 :] + prose(50))]
    texts += ["", None, " ".join(items[1]), " ".join(items[0][:4]), " ".join(prose(30_000) + items[3] + prose(300))]
    model, vocabulary = hand_model(items, texts)
    passages, each = set(), []
    for r, t in enumerate(texts):
        ids = model.ids.of(t)
        n = max(1, -(-len(ids) // decontam.BLOCK))
        for p in range(max(1, n - 1)):
            x = ids[p * decontam.BLOCK : p * decontam.BLOCK + decontam.PASSAGE]
            v = model.latent[x[x >= 0]].sum(0)
            dot = model.queries @ v
            passages |= {(r, p, int(k)) for k in np.flatnonzero((dot >= model.cover) & (dot >= decontam.COSINE * model.lengths * np.linalg.norm(v)))}
        each += [(r, *x) for x in model.leaks(t)]
    assert len(passages) > 150 and len(each) > 60 and not any(210 <= r < 226 for r, *_ in each)
    for most in (1000, 1 << 16):
        monkeypatch.setattr(decontam, "WORDS", most)
        ids, ends = model.ids.of_all(pa.array(texts))
        assert sorted(model.leaking(ids, ends)) == sorted(each)
        assert set(model.near(ids, ends, model.hits(ids, ends))) == passages


def test_sums_of_groups():
    rng = np.random.default_rng(3)
    for n, m in ((0, 1), (1, 1), (500, 4), (5000, 3), (3000, 900)):
        rows, index, group = rng.integers(0, 99, (50, 7)).astype(np.float32), rng.integers(0, 50, n), np.sort(rng.integers(0, m, n))
        which, sums = decontam._sums(rows, index, group)
        want = np.zeros((m, 7))
        np.add.at(want, group, rows[index])
        assert which.tolist() == np.unique(group).tolist() and np.array_equal(sums, want[which])


def test_few_calls_for_each_document():
    """The work of a task is done for many documents at once: not tens of calls for each of them."""
    items = [prose(30) for _ in range(50)]
    texts = [" ".join(prose(120)) for _ in range(1000)]
    model, _ = hand_model(items, texts)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        model.leaking(*model.ids.of_all(pa.array(texts)))
    finally:
        sys.setprofile(None)
    assert calls < 20 * len(texts)
