import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concord.llm import curve
from concord.llm.queries import QUERIES

PATH = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, texts, capacity=2048):
    """Each id in one piece, sequences gapless from 0, full but for a tail of powers of two. texts: (doc_id, text)."""
    library = Tokenizer.from_file(WORDS)
    want = sorted([i if i is not None else -1, *library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end & (end - 1) == 0
    fills = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(fills) == sum(len(w) - 1 for w in want) and sum(f < capacity for f in fills) == bin(sum(fills) % capacity).count("1")
    if len({i for i, _ in texts}) == len(texts):
        for first, *ids in want:
            pieces = sorted(by_doc[None if first == -1 else first], key=lambda r: r.start)
            at = 0
            for p in pieces:
                part = np.array(ids[p.start : p.start + p.length], "<u4")
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part.tobytes())
                at += p.length
            assert at == len(ids)


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    rows = QUERIES["op12_curve_packing"](spark, PATH).collect()
    checked(rows, texts)
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_neighbours_are_alike(spark):
    """Documents that follow one another are more alike than documents at random; copies stand side by side."""
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    rows = sorted(curve.pack(docs, WORDS).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in rows))
    library, text = Tokenizer.from_file(WORDS), {r.doc_id: r.text for r in docs.collect()}
    v = np.zeros((len(order), 49408), np.float32)
    for k, i in enumerate(order):
        np.add.at(v[k], library.encode(text[i] or "", add_special_tokens=False).ids, 1)
    v = np.log1p(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    near = (v[1:] * v[:-1]).sum(1).mean()
    rng = np.random.default_rng(1)
    far = np.mean([(v[rng.permutation(len(v))] * v).sum(1).mean() for _ in range(5)])
    assert near > far + 0.1


@pytest.mark.parametrize("k,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(k, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * k, indexing="ij"), -1).reshape(-1, k)
    key = curve.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_edges(spark, docs):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "word " * 30_000), (4, "Größe, ‰ \U0001f600 <|endoftext|>")]
    checked(curve.pack(docs(*rows), WORDS).collect(), rows)
    same = [(7, "same text here")] * 3 + [(7, "another"), (None, "x"), (None, "y"), *[(k, "copy of it") for k in range(100, 160)]]
    got = curve.pack(docs(*same), WORDS, 16).collect()
    checked(got, same, 16)
    assert curve.pack(docs(*rows).limit(0), WORDS).count() == 0
    assert curve.pack(docs((5, None)), WORDS).collect()[0].length == 1


def test_ids_and_copies_over_ranges(spark, docs):
    """Copies by the hundred are dealt over several ranges and still stand together."""
    rows = [(k, "the very same words again") for k in range(400)] + [(k, f"number {k} of other kinds w{k % 7} x{k % 11}") for k in range(400, 500)]
    got = curve.pack(docs(*rows), WORDS, 64, with_ids=True).collect()
    checked(got, rows, 64)
    assert all(len(r.ids) == r.length for r in got)
    at = sorted((r.sequence_id, r.offset, r.doc_id) for r in got)
    places = [k for k, (_, _, i) in enumerate(at) if i < 400]
    assert places[-1] - places[0] + 1 == len(places)
    keyed = curve.on_curve(curve.tokenised(docs(*rows), WORDS, 1)).where("doc_id < 400")
    assert keyed.select("key").distinct().count() == 400
