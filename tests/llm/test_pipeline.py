import itertools
import re
from collections import Counter, defaultdict

import corpus_pipeline
from concord.llm import decontam, linededup, simhash, toxicity
from tests.llm.conftest import groups
from tests.llm.test_linededup import expected as lines_left

PATH = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x20\x09-\x0D]+", w)
    return {tuple(w[n : n + k]) for n in range(max(1, len(w) - k + 1))} if w else set()


def pairs_of(sets):
    """(a, b, similarity of the sets) of all pairs that have anything in common; empty sets are alike."""
    ids, of = sorted(sets), defaultdict(list)
    for i in ids:
        for x in sets[i] or {None}:
            of[x].append(i)
    shared = Counter(p for own in of.values() for p in itertools.combinations(own, 2))
    return [(a, b, n / len((sets[a] or {None}) | (sets[b] or {None}))) for (a, b), n in shared.items()]


def test_every_stage_against_its_plain_version(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, PATH)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{PATH}/labels.parquet"))
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if model.score(r.text) < 0.5}
            assert 0.7 * len(before) < len(rows) < len(before)
        elif name == "line_dedup":
            left = {i: t for i, _, _, t in lines_left([(i, r.text) for i, r in before.items()])}
            assert {r.doc_id: r.text for r in rows} == left and all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            kept, sets = {r.doc_id for r in rows}, {i: shingles(r.text) for i, r in before.items()}
            low, at, high = (groups(list(before), [(a, b) for a, b, x in pairs_of(sets) if x >= least]) for least in (0.74, 0.8, 0.86))
            assert not any(len({i for i in kept if high[i] == c}) > 1 for c in high.values())  # no two that are surely alike
            assert all(low[i] != i or i in kept for i in low) and all(low[i] != i for i in set(before) - kept)
            assert abs(len(kept) - len(set(at.values()))) <= 2
        elif name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
            holding = {i for i, r in before.items() if any(x in " ".join(r.text.lower().split()) for x in items)}
            assert {r.doc_id for r in rows} == set(before) - holding
        else:
            assert {r.doc_id for r in rows} == set(before)
            assert all(r.offset + r.length <= 1024 for r in rows)
        docs = spark.createDataFrame(rows, out.schema) if name != "packing" else docs


def test_run_writes_each_stage(spark):
    assert corpus_pipeline.run(spark, PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, PATH).count() == 0


def test_operators_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 5, True), (2, None, 6, False)], "doc_id long, text string, copies int, kept boolean")
    assert simhash.first_of_groups(docs).columns == docs.columns
    assert linededup.dedup(docs).columns[:4] == docs.columns
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean(docs, bench).columns == docs.columns
