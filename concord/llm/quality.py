"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Labelled documents fitted on at most, those with the smallest hashes of their ids.
LABELLED = 4000
#: Rounds of exchange; texts that a view labels for the other in a round, the surest of all documents without a label, and how sure it must be.
ROUNDS, HANDED, SURE = 4, 400, 0.97
#: Buckets of hashed character pairs and of sources.
PAIRS, SOURCES = 64, 64
LANGUAGES = 16
KEEP = 0.5


def text_view(text: str | None) -> list[float]:
    """Shape of the whole text: kinds of characters, words, repeats, lines, and hashed letter pairs. No metadata."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(b))
    kinds = np.bincount(b, minlength=256) / n
    parts = (text or "").split()
    m = max(1, len(parts))
    distinct = len(set(parts))
    runs = sum(a == c for a, c in zip(parts, parts[1:], strict=False)) / m
    ends = sum(not p[-1].isalnum() and p[-1] not in ".,;" for p in parts) / m
    lines = (text or "").split("\n")
    out = [
        kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[128:].sum(), kinds[32], kinds[10] * 10,
        kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum(), kinds[[46, 44]].sum() * 5,
        distinct / m, runs, ends, math.log1p(m) / 10, len(b) / (10 * m), 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 10, float(m == 1),
    ]
    pairs = np.bincount((b[:-1].astype(np.int64) * 31 + b[1:]) * 2654435761 % 2**32 >> 26, minlength=PAIRS) if len(b) > 1 else np.zeros(PAIRS)
    return [*map(float, out), *(pairs / n * 4).tolist()]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Where the page comes from and how long it is said to be, its language and source hashed."""
    out = np.zeros(LANGUAGES + SOURCES + 12)
    out[zlib.crc32((lang or "").encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = math.log2(max(0, n_chars or 0) + 1)
    out[LANGUAGES + SOURCES + min(10, int(size / 2))] = 1
    out[-1] = size / 20
    return out.tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30, balanced: bool = True) -> np.ndarray:
    """Weights of the columns and a constant, by Newton steps. Balanced: both classes weigh the same; otherwise the results follow the share of each."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    each = weight * np.where(y == 1, 0.5 / max(1e-9, weight[y == 1].sum()), 0.5 / max(1e-9, weight[y == 0].sum())) * len(y) if balanced else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (each * p * (1 - p) + 1e-6)[:, None]).T @ a + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (each * (p - y)) + penalty * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class View:
    """One view's scaler, weights and calibration (slope and constant of Platt's rule, both on the margin)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, platt: np.ndarray | None = None):
        self.mean, self.scale, self.weights, self.platt = mean, scale, weights, platt

    def margin(self, x: np.ndarray) -> np.ndarray:
        return margin(self.weights, (x - self.mean) / self.scale)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a good document, in the proportions of the labelled ones."""
        return margin(self.platt, self.margin(x)[:, None])


class Model:
    """Both calibrated views and the weights that join their log odds."""

    def __init__(self, text: View, meta: View, joint: np.ndarray):
        self.text, self.meta, self.joint = text, meta, joint

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return sigmoid(margin(self.joint, np.c_[self.text.calibrated(t), self.meta.calibrated(m)]))


#: Asked with both views, the texts (by hash) that each has been taught, and how many are wanted of (view, label): rows
#: (view, label, hash, t, m) of the surest that the other view has not been taught.
Surest = Callable[[list[View], list[dict[int, tuple]], dict[tuple[int, int], int]], list[tuple]]


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, surest: Surest | None, rounds: int = ROUNDS, handed: int = HANDED) -> Model | float:
    """A model of labelled rows (text view t, metadata view m, y 0 or 1) and of what `surest` finds without a label.

    A quarter of the labelled rows is held back. In each round either view labels the `handed` texts it is surest
    of, of either class in the labels' proportion, for the other view alone. The rows held back then calibrate each view and join
    the two, all in their own proportions. With one class only: its share.
    """
    if len(y) < 8 or len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    sides = (t, m)
    own = y[~held].astype(float)
    taught: list[dict[int, tuple]] = [{}, {}]  # by view: hash of a text, its row and pseudo-label

    def fitted(k: int) -> View:
        x = sides[k][~held]
        mean, scale = x.mean(0), x.std(0) + 1e-3
        others = np.array([r[k] for r in taught[k].values()]).reshape(-1, x.shape[1])
        marks = np.array([r[2] for r in taught[k].values()], float)
        each = np.r_[np.ones(len(own)), np.full(len(marks), 0.3)]
        return View(mean, scale, fit_logistic((np.r_[x, others] - mean) / scale, np.r_[own, marks], each))

    views = [fitted(0), fitted(1)]
    wanted = {(k, label): max(1, int(handed * (own.mean() if label else 1 - own.mean()))) for k in (0, 1) for label in (0, 1)}
    for _ in range(rounds if surest else 0):
        found = surest(views, taught, wanted)
        for k, label, h, rt, rm in found:
            taught[1 - k].setdefault(h, (rt, rm, label))
        if not found:
            break
        views = [fitted(0), fitted(1)]
    at = held if held.any() else np.ones(len(y), bool)
    for view, x in zip(views, sides, strict=True):
        view.platt = fit_logistic(view.margin(x[at])[:, None], y[at].astype(float), np.ones(int(at.sum())), penalty=0.1, balanced=False)
    both = np.c_[views[0].calibrated(t[at]), views[1].calibrated(m[at])]
    return Model(*views, fit_logistic(both, y[at].astype(float), np.ones(int(at.sum())), penalty=0.1, balanced=False))


WIDTHS = len(text_view("")), len(metadata_view(None, None, None))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, h, v): both views of each row one after another, as 32-bit floats, and a hash of all they are taken from."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    parts = ["text", "lang", "source", "n_chars"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in parts), strict=True)
            v = [np.array(text_view(r[0]) + metadata_view(*r[1:]), np.float32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(v, pa.binary())], ["doc_id", "h", "v"])

    return own.withColumn("h", F.xxhash64(*parts, *[F.col(c).isNull() for c in parts])).mapInArrow(each, "doc_id long, h long, v binary")


def _both(v: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(v), np.float32).reshape(len(v), sum(WIDTHS)).astype(float)
    return x[:, : WIDTHS[0]], x[:, WIDTHS[0] :]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the quality of their doc_id, null where it has none; a doubly labelled document counts as good."""
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    return rows.join(label, "doc_id", "left")


def _surest(rows: DataFrame, views: list[View], taught: list[dict[int, tuple]], wanted: dict[tuple[int, int], int]) -> list[tuple]:
    """Of each view and label the texts it is surest of, by margin and then hash, equal rows once: each task hands on
    its own best, so that the driver sees as many as are wanted and no more."""
    least = math.log(SURE / (1 - SURE))
    known = [np.array(list(x), np.int64) for x in taught]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, list[bytes]]] = {}
        for b in batches:
            h, v = b.column("h").to_numpy(), b.column("v").to_pylist()
            for k, (view, x) in enumerate(zip(views, _both(v), strict=True)):
                z = np.round(view.margin(x), 9)
                new = ~np.isin(h, known[1 - k])
                for label in (0, 1):
                    sure = z if label else -z
                    at = np.flatnonzero(new & (sure >= least))
                    old = best.get((k, label), (np.zeros(0), np.zeros(0, np.int64), []))
                    s, g, w = np.r_[old[0], sure[at]], np.r_[old[1], h[at]], old[2] + [v[i] for i in at.tolist()]
                    order = np.lexsort((g, -s))
                    order = order[np.sort(np.unique(g[order], return_index=True)[1])][: wanted[k, label]]
                    best[k, label] = s[order], g[order], [w[i] for i in order.tolist()]
        for (k, label), (s, g, w) in best.items():
            marks = [pa.array(np.full(len(g), c), pa.int32()) for c in (k, label)]
            yield pa.RecordBatch.from_arrays([*marks, pa.array(s), pa.array(g), pa.array(w, pa.binary())], ["k", "label", "sure", "h", "v"])

    best = written(rows.select("h", "v").mapInArrow(each, "k int, label int, sure double, h long, v binary"))
    of = [best.where((F.col("k") == k) & (F.col("label") == label)).dropDuplicates(["h"]).orderBy(F.desc("sure"), "h").limit(n) for (k, label), n in wanted.items()]
    found = [(r.k, r.label, r.h, *(x[0] for x in _both([bytes(r.v)]))) for r in sorted(reduce(DataFrame.unionAll, of).collect(), key=lambda r: (r.k, -r.label, -r.sure, r.h))]
    dropped(best)
    return found


def _fit(rows: DataFrame, labelled: int, rounds: int, handed: int) -> Model | float:
    """rows: written (doc_id, h, v, quality)."""
    given, rest = rows.where("quality is not null"), rows.where("quality is null")
    ids = given.groupBy("doc_id").agg(F.min("h").alias("h")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    some = rows.sparkSession.createDataFrame([tuple(r) for r in ids], "doc_id long, h long")
    sample = given.join(F.broadcast(some), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    t, m = _both([bytes(r.v) for r in sample])
    return co_train(t, m, np.array([r.quality for r in sample], int), lambda *a: _surest(rest, *a), rounds, handed)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> Model | float:
    """Co-trains on at most `labelled` documents with a label, and on every document without one.

    A doubly labelled document counts as good; of rows that share a labelled doc_id one is fitted on. Rows without a label, those with a
    null doc_id included, are all scored by both views in each round; rows with the same content are handed on once.
    """
    rows = written(_labelled(features(docs), labels))
    model = _fit(rows, labelled, rounds, handed)
    dropped(rows)
    return model


def _scored(rows: DataFrame, model: Model | float, keep: float) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(*_both(b.column("v").to_pylist())) if isinstance(model, Model) else np.full(b.num_rows, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array(s >= keep, pa.bool_())], ["doc_id", "score", "keep"])

    return rows.select("doc_id", "v").mapInArrow(each, "doc_id long, score double, keep boolean")


def score(docs: DataFrame, model: Model | float, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, keep): one row for each row of docs; score from 0 to 1, higher is better.

    Null text is empty, null metadata is a value of its own; texts of any length are read whole; rows with the same content have the
    same score, whatever their ids; every document gets a score. Other columns are not read.
    """
    return _scored(features(docs), model, keep)


def classify(docs: DataFrame, labels: DataFrame, keep: float = KEEP, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> DataFrame:
    """score() of docs by their own fit(): each text is looked at once, and its two views are written for the rounds and the scores."""
    rows = written(_labelled(features(docs), labels))
    return _scored(rows, _fit(rows, labelled, rounds, handed), keep)
