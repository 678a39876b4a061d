import hashlib
import random

import numpy as np

from concord.llm import spans


def expected(rows, window):
    first = {}
    texts = [(-1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < (i, k):
                gone[k : k + window] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(3)]
        p = rng.choice(passages)
        cut = rng.randrange(len(p))
        rows.append((i, rng.choice([p, p[cut:], p[:cut], ""]).join(parts)))
    rows += [(i + 100, rows[i][1]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (204, "a" * 99), (None, rows[3][1]), (205, "a" * 100)]
    rows += [(206, "xyz " * 40), (206, "xyz " * 40), (206, "other " * 30)]
    return rows


def test_against_every_window(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(spans.summary(docs(*rows))) == expected(rows, 100)


def test_chunk_ends_change_nothing(docs, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(spans, "CHUNK", 130)
    got = {t: spans.anchors([(x or "").encode() for _, x in rows])[t] for t in range(6)}
    for text, (_, x) in enumerate(rows):
        own = got[0] == text
        starts = [k for a, z in zip(got[2][own], got[3][own], strict=True) for k in range(a, z + 1)]
        assert starts == list(range(max(0, len((x or "").encode()) - 99)))


def test_empty_and_own_columns(docs):
    assert spans.summary(docs()).count() == 0
    row = spans.repeats(docs((1, "x" * 150))).first()
    assert (row.k, row.kept, row.spans[0].start, row.spans[0].end) == ("x", b"x", 1, 150)


def test_merged():
    s, e = spans.merged(np.array([5, 0, 7, 20]), np.array([10, 3, 9, 25]))
    assert s.tolist() == [0, 5, 20] and e.tolist() == [3, 10, 25]
