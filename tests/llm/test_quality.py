import math

import numpy as np

from concord.llm import quality


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        bad = k % 4 == 0
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(60)]
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        source = "junk" if bad == (rng.random() < 0.85) else "books"
        out.append((k, text, "en", source, len(text)))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_pool(ut, um, hashes=None):
    """Every row of the pool weighed in one list, as co_train's callback."""
    hashes = list(range(len(ut))) if hashes is None else hashes

    def surest(views, taught, wanted):
        out = []
        for k in (0, 1):
            z = np.round(views[k].margin((ut, um)[k]), 9).tolist()
            for label in (1, 0):
                able = {h: (-(z[i] if label else -z[i]), h, i) for i, h in enumerate(hashes) if h not in taught[1 - k]}
                able = sorted(x for x in able.values() if -x[0] >= math.log(quality.SURE / (1 - quality.SURE)))
                out += [(k, label, h, ut[i], um[i]) for _, h, i in able[: wanted[k, label]]]
        return out

    return surest


def test_held_out_accuracy(spark):
    rows = rows_of(400)
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows] + [(None, None, None, None, None, 0.0, None), (900, "", "xx", None, -5, 0.0, None)], SCHEMA + ", score double, keep boolean")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 200)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out.values())
    assert np.mean([out[k].keep == (k % 4 != 0) for k in range(200, 400)]) > 0.95


def test_pseudo_labels_help_the_weak_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    strong, weak = y[:, None] * 4 + rng.standard_normal((3000, 2)), y[:, None] * 1.5 + rng.standard_normal((3000, 20)) * 2
    own = slice(0, 40)
    with_others = quality.co_train(strong[own], weak[own], y[own], plain_pool(strong[40:2000], weak[40:2000]))
    alone = quality.co_train(strong[own], weak[own], y[own], None)
    test = slice(2000, 3000)
    acc = [np.mean((m.meta.margin(weak[test]) > 0) == y[test]) for m in (with_others, alone)]
    assert acc[0] > acc[1]


def test_one_class_no_labels_no_rows(spark):
    docs = spark.createDataFrame(rows_of(20), SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_against_all_rows_in_one_list(spark):
    """Many tasks find what a list of all rows gives; a third of the rows are one text, which is handed on once."""
    rows = rows_of(300) + [(1000 + k, "One text that fills a third of the table.", "en", "books", 41) for k in range(150)] + [(None, "x\ny " * 30_000, None, None, None), (7, "second row", "", "", -1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    label = {k: int(k % 4 != 0) for k in range(120)}
    labels = spark.createDataFrame([(k, q, 0) for k, q in label.items()] + [(9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in quality.classify(docs, labels, handed=20).collect())
    again = quality.score(docs, quality.fit(docs, labels, handed=20))
    assert np.allclose([s for _, s in out], [s for _, s in sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in again.collect())], atol=1e-9)

    every = [(r.doc_id, r.h, *(np.array(x[0]) for x in quality._both([bytes(r.v)]))) for r in quality.features(docs).collect()]
    given = {}
    for r in sorted((r for r in every if r[0] in label), key=lambda r: r[1]):
        given.setdefault(r[0], r)
    given = sorted(given.values(), key=lambda r: (quality.zlib.crc32(str(r[0]).encode()), r[0]))
    rest = [r for r in every if r[0] not in label]
    stack = lambda rs, c: np.array([r[c] for r in rs])
    model = quality.co_train(stack(given, 2), stack(given, 3), np.array([label[r[0]] for r in given]), plain_pool(stack(rest, 2), stack(rest, 3), [r[1] for r in rest]), handed=20)
    want = sorted(zip((-1 if r[0] is None else r[0] for r in every), model.score(stack(every, 2), stack(every, 3)).tolist(), strict=True))
    assert [i for i, _ in out] == [i for i, _ in want] and np.allclose([s for _, s in out], [s for _, s in want], atol=1e-6)


def test_scores_follow_the_share_of_good():
    """One document in ten is bad and the views overlap: scores are rates, in each view and together."""
    rng = np.random.default_rng(5)
    y = (rng.random(12_000) < 0.9).astype(int)
    t, m = y[:, None] * 1.5 + rng.standard_normal((12_000, 3)), y[:, None] * 1.0 + rng.standard_normal((12_000, 4))
    model = quality.co_train(t[:4000], m[:4000], y[:4000], plain_pool(t[4000:8000], m[4000:8000]))
    t, m, y = t[8000:], m[8000:], y[8000:]
    for p in (model.score(t, m), quality.sigmoid(model.text.calibrated(t)), quality.sigmoid(model.meta.calibrated(m))):
        assert abs(p.mean() - y.mean()) < 0.02
        for low, high in ((0.2, 0.6), (0.6, 0.9), (0.9, 1.0)):
            at = (p >= low) & (p < high)
            assert at.sum() < 50 or abs(p[at].mean() - y[at].mean()) < 0.08


def test_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(k % 30, "same words in all", "en", "a" if k % 2 else "b", 17) for k in range(60)], SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 60 and len({(r.doc_id % 2, r.score) for r in out}) == 2
