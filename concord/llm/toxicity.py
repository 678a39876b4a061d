"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, and from one window's start to the next.
WINDOW, STRIDE = 96, 48
#: Labelled rows fitted on, of each label, and the bytes of their texts together at most; bytes of what both dictionaries
#: share and of what each has alone.
ROWS, BYTES, SHARED, OWN = 2500, 12 << 20, 24576, 1024
#: Bytes of a gram; toxic windows have grams that are this many times as frequent there, in at least this part of the texts.
GRAM, ODDS, LEAST = 4, 30.0, 0.02
#: Bytes of an ordinary window that the ordinary dictionary's own part is trained on.
SHORT = 24
BEST = 6
#: What all toxic documents weigh against all others in the calibration: a clean document lost costs more.
TOXIC, PENALTY = 0.35, 0.5
LEVEL = 3


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of the whole text's bytes, A-Z lower-cased; one at least."""
    b = (text or "").encode("utf-8", "surrogatepass").lower()
    return [b[k : k + WINDOW] for k in range(0, max(1, len(b) - WINDOW + STRIDE), STRIDE)]


class Dictionaries:
    """Compressed lengths of windows by either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.raw = toxic, ordinary
        self._by: list | None = None

    def __getstate__(self):
        return self.raw

    def __setstate__(self, raw):
        self.raw, self._by = raw, None

    def _compressors(self) -> list:
        if self._by is None:
            import zstandard

            self._by = []
            for raw in self.raw:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, strategy=zstandard.STRATEGY_BTOPT)
                d.precompute_compress(compression_params=how)
                self._by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        return self._by

    def gains(self, parts: list[bytes]) -> np.ndarray:
        """For each window, the bytes that the toxic dictionary saves against the ordinary one."""
        out = np.zeros((2, len(parts)), np.int32)
        for row, c in zip(out, self._compressors(), strict=True):
            row[:] = np.fromiter((len(c.compress(p)) for p in parts), np.int32, len(parts))
        return out[1] - out[0]

    def of(self, text: str | None) -> list[float]:
        """What a document is judged by: the gains of its best windows, largest first, and how many windows had a chance."""
        g = self.gains(windows(text))
        best = np.zeros(BEST)
        best[: min(BEST, len(g))] = np.clip(np.sort(g)[::-1][:BEST], 0, 8)
        clear = int((g >= 3).sum())  # few bytes may be chance
        size = float(np.log(len(g)))
        return [*best.tolist(), float((best >= 2).sum()), float((best >= 3).sum()), float(np.log1p(clear)), 10 * clear / len(g), size, size**2 / 10]


def _grams(text: bytes) -> np.ndarray:
    """The GRAM bytes from each place on, as integers."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    out = np.zeros(n, np.uint32)
    for k in range(GRAM):
        out = out << np.uint32(8) | b[k : k + n]
    return out


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts and in how many of them each is."""
    every = [np.unique(_grams(t)) for t in texts]
    return np.unique(np.concatenate(every), return_counts=True)


def telling(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic texts made of grams that at least LEAST of them have, and ODDS times as often as ordinary
    ones: the windows that the toxic dictionary is trained on. What both kinds of text have would take its place."""
    grams, n = _counts(toxic)
    other, m = _counts(ordinary)
    seen = np.zeros(len(grams))
    at = np.searchsorted(other, grams)
    there = np.flatnonzero(other[np.minimum(at, len(other) - 1)] == grams) if len(other) else np.zeros(0, int)
    seen[there] = m[at[there]]
    own = grams[(n >= max(4, LEAST * len(toxic))) & (n / len(toxic) >= ODDS * (seen + 0.5) / len(ordinary))]
    out = []
    for t in toxic:
        at = np.flatnonzero(np.isin(_grams(t), own))
        if len(at):
            new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + GRAM])
            out += [t[x : y + GRAM] for x, y in zip(at[new].tolist(), at[np.r_[new[1:], len(at)] - 1].tolist(), strict=True)]
    return out


def trained(parts: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary of that size. The trainer wants more than the few samples of a small corpus: these repeat."""
    import zstandard

    parts = [p for p in parts if len(p) >= GRAM]
    if not parts:
        return bytes(size)
    often = -(-20 * size // sum(map(len, parts))), -(-64 // len(parts)), 1
    return zstandard.train_dictionary(size, parts * max(often), k=k, d=d).as_bytes()[-size:].rjust(size, b"\0")


def train(toxic: list[str], ordinary: list[str]) -> Dictionaries:
    """One dictionary is trained by zstandard on the telling windows of toxic texts, the other as long on windows of
    ordinary ones. Both end in the same content, trained on other ordinary texts, so that they compress ordinary windows
    nearly alike (a compressor reaches the end of a dictionary most cheaply)."""
    bad, good = ([t.encode("utf-8", "surrogatepass").lower() for t in texts] for texts in (toxic, ordinary))
    shared = trained([w for t in ordinary[::2] for w in windows(t)], SHARED, 64, 8)
    own = trained(telling(bad, good), OWN, 24, 6)
    more = trained([t[k : k + SHORT] for t in good[1::2] for k in range(0, len(t), SHORT)], OWN, 24, 6)
    return Dictionaries(own + shared, more + shared)


class Model:
    """Dictionaries and the calibration of their gains. fit() takes bounded lists of texts."""

    def __init__(self, dictionaries: Dictionaries | None, weights: np.ndarray):
        self.dictionaries, self.weights = dictionaries, weights

    @classmethod
    def fit(cls, toxic: list[str], ordinary: list[str]) -> Model:
        if not toxic or not ordinary:
            return cls(None, np.array([5.0 if toxic else -5.0]))
        # Dictionaries and calibration from different halves: how well a dictionary fits its own texts says little.
        half, middle = -(-len(toxic) // 2), -(-len(ordinary) // 2)
        d = train(toxic[:half], ordinary[:middle])
        held = (toxic[half:], ordinary[middle:]) if len(toxic) > 1 and len(ordinary) > 1 else (toxic, ordinary)
        y = np.r_[np.ones(len(held[0])), np.zeros(len(held[1]))]
        return cls(d, calibrate(np.array([d.of(t) for t in [*held[0], *held[1]]]), y))

    def score(self, text: str | None) -> float:
        x = [1.0] if self.dictionaries is None else [1.0, *self.dictionaries.of(text)]
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, x), -30, 30))))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights of 1 and the columns of x by Newton steps, the labels weighing TOXIC to 1 - TOXIC."""
    a = np.c_[np.ones(len(x)), x]
    each = np.where(y == 1, TOXIC / max(1, (y == 1).sum()), (1 - TOXIC) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (each * (p - y)) + PENALTY * w
        hess = (a * (each * p * (1 - p))[:, None]).T @ a + PENALTY * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def fold() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = BYTES) -> Model:
    """A model from the labelled documents outside fold 0: of each label `rows` at most, and as many of these as have
    `most_bytes` together (both bounds are the sample's only limits; the rows are those with the smallest hashes of doc_id
    and text). doc_id, lang and source are no inputs. A document labelled both ways counts as toxic; labels without a
    text are passed over, repeated rows are one."""
    known_labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Which documents, by their ids alone; then their rows, by hash and length; then the texts. All three are bounded.
    met = own.select("doc_id").distinct().join(known_labels, "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    chosen = {r.doc_id: r.toxic for k in (1, 0) for r in met.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(rows).collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(chosen.items()), "doc_id long, toxic int")
    keyed = own.where("text is not null").withColumn("th", F.xxhash64("text"))
    sizes = keyed.join(F.broadcast(ids), "doc_id").select("toxic", F.xxhash64("doc_id").alias("h"), "doc_id", "th", F.octet_length("text").alias("n")).distinct()
    taken = []
    for k in (1, 0):
        found = sizes.where(F.col("toxic") == k).orderBy("h", "doc_id", "th").limit(rows).collect()
        total = 0
        for r in found:  # a text that does not fit any more is passed over, the next may fit
            if total + r.n <= most_bytes:
                total += r.n
                taken.append((r.doc_id, r.th))
    some = spark.createDataFrame(taken, "doc_id long, th long")
    texts = keyed.join(F.broadcast(some), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.first("text").alias("text")).collect()
    texts.sort(key=lambda r: (r.doc_id, r.text))
    return Model.fit(*([r.text for r in texts if chosen[r.doc_id] == k] for k in (1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs. Null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.fromiter((model.score(t.as_py()) for t in b.column(2)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    names = ["doc_id", "held_out", "score", "predicted"]
    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with their own columns, that the model does not reject."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < 0.5 for t in b.column("text")], pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(each, docs.schema)
