import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concord.llm import packing, tokenfiles
from concord.llm.tokens import WordEncoder, encoder

BYTE, WORD = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [(3, "Hello world,  it's\n\nÉTÉ <|endoftext|> x"), (1, None), (2, ""), (7, "naïve é 中文 ١ \x1c tabs\t\t"), (5, "word " * 5000), (5, "again"), (None, "no id")]


load = lru_cache(Tokenizer.from_file)


def direct(path, text):
    return [*load(path).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path):
    rng, enc = random.Random(5), WordEncoder(path, 50) if path == WORD else encoder(path)
    for _ in range(3000):
        text = "".join(rng.choice("ab Z'\n\t  éÉß\x1c\xa0́A1२.,’s") for _ in range(rng.randrange(40)))
        assert np.frombuffer(enc.encode(text), "<u2").tolist() == direct(path, text)[:-1], repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_values_come_back(values):
    v = np.array(values, np.uint32)
    control, data = tokenfiles.pack_values(v)
    control, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    assert tokenfiles.unpack_values(control, data, len(v)).tolist() == values
    assert tokenfiles.data_bytes(control, len(v)) == len(data)


def test_token_files(docs, monkeypatch):
    out = tokenfiles.read(tokenfiles.write(docs(*TEXTS), WORD)).collect()
    want = [(i, direct(WORD, t)) for i, t in TEXTS]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in out) == sorted((i or -1, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by_start = [r.doc_id or -1 for r in sorted(out, key=lambda r: r.start)]
    assert by_start == sorted(by_start)
    assert tokenfiles.read(tokenfiles.write(docs(), WORD)).count() == 0


def test_blocks_and_ranks():
    documents = [(n, np.arange(n * 7 % 50_000, dtype="<u2")) for n in range(300)] + [(None, np.array([49_000], "<u2"))]
    back = list(tokenfiles.from_file(tokenfiles.to_file(documents)))
    assert [i for i, _ in back] == [i for i, _ in documents]
    assert all((a == b).all() for (_, a), (_, b) in zip(back, documents, strict=True))


def test_cut():
    assert packing.cut(1, 1024) == [(0, 1)] and packing.cut(1024, 1024) == [(0, 1024)]
    assert packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_once_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 1025, 20_000) if seed % 2 else np.minimum(1024, 1 + rng.gamma(2, 120, 20_000).astype(int))
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    bins = packing.plan(counts)
    seen = defaultdict(list)
    for b in bins:
        assert sum(n for n, _ in b.items) + b.room == 1024 and b.room >= 0 and b.count > 0
        for n, rank in b.items:
            seen[n] += range(rank, rank + b.count)
    assert {n: sorted(r) for n, r in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sum(b.count for b in bins) <= 1.01 * -(-int(lengths.sum()) // 1024) + 1


def test_pack(docs):
    rows = TEXTS + [(100 + n, "x y z " * (n % 90)) for n in range(400)]
    out = packing.pack(docs(*rows), BYTE, with_ids=True).collect()
    own, bins = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        own[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in rows:
        if i == 5:
            continue
        got = sorted(own[i], key=lambda r: r.piece)
        assert [x for r in got for x in r.ids] == direct(BYTE, t)
        assert [r.start for r in got] == [s for s, _ in packing.cut(len(direct(BYTE, t)), 1024)]
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in out) // 1024) + 2
    assert packing.pack(docs(), BYTE).count() == 0
