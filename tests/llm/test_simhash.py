import random
import re

import pytest
import xxhash

from concord.llm import simhash
from concord.llm.queries import QUERIES
from tests.llm.conftest import groups


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    whole = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in whole]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(rows):
    fps = {i: plain(t) for i, t in rows}
    ids = list(fps)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 3]
    return {i: (f"{fps[i]:016x}", c) for i, c in groups(ids, linked).items()}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_against_all_pairs(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert result(QUERIES["op3_simhash"](spark, path)) == expected(rows)


def test_near_copies_and_edges(spark, docs):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(400)]
    base = [rng.choice(words) for _ in range(600)]
    rows = [(n, " ".join(base[:300] + [rng.choice(words)] + base[301:])) for n in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "One"), (104, "one"), (105, "ÀB c"), (106, "x " * 40_000)]
    assert result(simhash.near_duplicates(docs(*rows))) == expected(rows)


def test_null_ids_repeats_and_empty(docs):
    out = simhash.near_duplicates(docs((None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "q"))).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (5, -1, False), (5, -1, False), (6, 6, True)]
    assert simhash.near_duplicates(docs()).count() == 0


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_every_close_pair_shares_a_block(spark, flips):
    rng = random.Random(flips)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    for _ in range(200):
        x = y = rng.getrandbits(64)
        for bit in rng.sample(range(64), flips):
            y ^= 1 << bit
        rows.append((signed(x), signed(y)))
    fps = spark.createDataFrame([(x,) for pair in rows for x in pair], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(fps).collect()}
    assert found == {tuple(sorted(p)) for p in rows}


def test_first_of_groups_keeps_rows_by_id_and_text(docs):
    a, b, c = (" ".join(f"{x}{n}" for n in range(40)) for x in "abc")
    rows = docs((None, a), (None, b), (None, b), (7, c), (7, "other words"), (8, c), (3, "x y z"), (9, "x y z"), (9, "own text here"), (None, None), (4, ""))
    out = [(r.doc_id, r.text) for r in simhash.first_of_groups(rows).collect()]
    want = [(None, a), (None, b), (7, c), (7, "other words"), (3, "x y z"), (9, "own text here"), (None, None)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_texts_of_similarity_above_the_limit_are_found(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    sets = lambda t: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))}
    rows, alike, apart = [], [], []
    for n in range(300):
        a = [word() for _ in range(rng.choice([30, 100, 400, 2000]))]
        b, goal = list(a), rng.choice([0.85, 0.68])
        while True:
            old = list(b)
            b[rng.randrange(len(b))] = word()
            x = len(sets(a) & sets(b)) / len(sets(a) | sets(b))
            if x < goal:
                break
        if goal > 0.8:
            b = old  # the last one that was still within the goal
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b).upper())]
        (alike if goal > 0.8 else apart).append(2 * n + 1)
    kept = {r.doc_id for r in simhash.first_of_groups(docs(*rows)).collect()}
    assert sum(i in kept for i in alike) <= 0.03 * len(alike) and sum(i not in kept for i in apart) <= 0.03 * len(apart)
    assert all(2 * n in kept for n in range(300))
