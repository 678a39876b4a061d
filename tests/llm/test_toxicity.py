import random
import zlib
from collections import Counter

import zstandard

from pyspark.sql import functions as F

from concord.llm import toxicity

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghilmnoprstu") for _ in range(RNG.randrange(2, 9))) for _ in range(3000)]


def text(bad, n=150):
    words = [RNG.choice(WORDS) for _ in range(n)]
    for _ in range(4 * bad):
        words[RNG.randrange(n)] = RNG.choice(["zorgling", "quaxxer", "vilebrut"])
    return " ".join(words)


def data(spark, docs, n=240):
    rows = [(k, text(k % 3 == 0)) for k in range(n)] + [(n, None), (n + 1, ""), (None, text(1)), (n + 2, text(400, 40_000))]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(n)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs(*rows), labels


def test_held_out_accuracy(spark, docs):
    d, labels = data(spark, docs)
    out = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert len(out) == 244 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    held = [k for k in range(240) if out[k].held_out]
    assert sum(out[k].predicted == (k % 3 == 0) for k in held) / len(held) > 0.9
    assert out[None].predicted == 1 and out[240].predicted == out[241].predicted == 0


def test_ids_and_sources_are_no_inputs(spark, docs):
    d, labels = data(spark, docs)
    model = toxicity.fit(d, labels)
    moved = d.selectExpr("doc_id + 1000 AS doc_id", "text", "'x' AS lang", "'y' AS source")
    a, b = ({r.doc_id: r.score for r in toxicity.score(x, model).where("doc_id is not null").collect()} for x in (d, moved))
    assert all(b[i + 1000] == s for i, s in a.items())


def test_without_labels_or_rows(spark, docs):
    d, labels = data(spark, docs, 30)
    assert {r.predicted for r in toxicity.score(d, toxicity.fit(d, labels.where("toxic = 0"))).collect()} == {0}
    assert toxicity.score(docs(), toxicity.fit(docs(), labels)).count() == 0


def test_gains_are_plain_compressed_lengths():
    toxic, ordinary = [text(1) for _ in range(60)], [text(0) for _ in range(120)]
    d = toxicity.train(toxic, ordinary)
    assert d.raw[0][toxicity.OWN :] == d.raw[1][toxicity.OWN :] and len(d.raw[0]) == toxicity.OWN + toxicity.SHARED
    assert all(w in d.raw[0] and w not in d.raw[1] for w in (b"zorgling", b"quaxxer", b"vilebrut"))  # the trainer took them from toxic text
    part = toxicity.windows(toxic[0])[0]

    def size(raw):
        how = zstandard.ZstdCompressionParameters.from_level(3, min_match=3, strategy=zstandard.STRATEGY_BTOPT)
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress(part))

    assert d.gains([part]).tolist() == [size(d.raw[1]) - size(d.raw[0])]


def test_telling_windows_against_plain_counting():
    toxic, ordinary = [text(k % 2, 60).encode() for k in range(40)], [text(0, 60).encode() for _ in range(60)]
    cut = lambda t: {t[k : k + 4] for k in range(len(t) - 3)}
    n, m = (Counter(g for t in x for g in cut(t)) for x in (toxic, ordinary))
    own = {g for g, c in n.items() if c >= max(4, 0.02 * len(toxic)) and c / len(toxic) >= 30 * (m[g] + 0.5) / len(ordinary)}
    covered = {(t, k + j) for t in toxic for k in range(len(t) - 3) if t[k : k + 4] in own for j in range(4)}
    out = toxicity.telling(toxic, ordinary)
    assert sum(map(len, out)) == len(covered) and all(any(p in t for t in toxic) for p in out)


def test_repeated_ids_and_rows(spark, docs):
    d, labels = data(spark, docs)
    more = d.union(d.where("doc_id < 50")).union(d.where("doc_id = 7").selectExpr("doc_id", "concat(text, ' again') AS text", *d.columns[2:]))
    out = toxicity.score(more, toxicity.fit(more, labels)).collect()
    assert len(out) == more.count() and len({(r.doc_id, r.score) for r in out if r.doc_id == 1}) == 1
    few = toxicity.fit(d, labels, most_bytes=20_000)  # fewer rows by their bytes
    assert isinstance(few, toxicity.Model) and toxicity.score(d, few).count() == 244


def test_a_first_text_over_the_bound(spark, docs):
    """A text that does not fit is passed over; those after it are still learned from."""
    d, labels = data(spark, docs)
    first = {}
    for k in (0, 1):
        own = d.join(labels.where(f"toxic = {k}").select("doc_id"), "doc_id").where(toxicity.fold() != 0)
        first[k] = own.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").first().doc_id
    long = d.withColumn("text", F.when(F.col("doc_id").isin(list(first.values())), F.repeat("text", 200)).otherwise(F.col("text")))
    model = toxicity.fit(long, labels, most_bytes=20_000)
    with_bound = toxicity.fit(d.where(~F.col("doc_id").isin(list(first.values()))), labels, most_bytes=20_000)
    a, b = ({r.doc_id: r.score for r in toxicity.score(d, m).collect()} for m in (model, with_bound))
    assert a == b and max(a.values()) > 0.5
