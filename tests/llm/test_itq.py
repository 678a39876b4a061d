import math

import numpy as np
import pytest

from concord.llm import itq
from concord.llm.queries import QUERIES
from tests.llm.conftest import groups

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, cls long"


def expected(rows):
    rows = [(-1 if i is None else i, v, x) for i, v, x in rows]
    ok = [v is not None and x is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, x in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    n, linked = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                n[a], n[b] = n[a] + 1, n[b] + 1
                linked.append((rows[a][0], rows[b][0]))
    top = groups([i for i, _, _ in rows], linked)
    return sorted((i, k, top[i], top[i] == i) for (i, _, _), k in zip(rows, n, strict=True))


def result(df):
    null = lambda x: -1 if x is None else x
    return sorted((null(r.vec_id), r.n_links, null(r.component_id), r.kept) for r in df.collect())


def test_against_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert result(QUERIES["op4_embedding_dedup"](spark, path)) == expected(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = np.random.default_rng(1).standard_normal(64).round(3).tolist()
    rows = [(9, base, 1), (3, base, 1), (4, [2 * c for c in base], 1), (5, base, 2), (6, base, None), (7, [-c for c in base], 1), (8, None, 1)]
    rows += [(10, [0.0] * 64, 1), (11, [*base[:-1], nan], 1), (12, [*base[:-1], inf], 1), (13, [*base[:-1], None], 1), (14, [], 1), (15, [1.0, 2.0], 1), (16, [1.0, 2.1], 1), (None, base, 2)]
    df = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA)
    assert result(itq.near_duplicates(df)) == expected(rows)
    assert itq.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine", [0.93, 0.95, 0.98])
def test_recall_at_each_cosine(spark, cosine):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((600, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = (cosine + 1e-6) * x + math.sqrt(1 - cosine**2) * side
    rows = [(k, v.tolist(), 1, "x", "y", 5) for k, v in enumerate(np.vstack([x, y]))]
    found = sum(r.n_links == 1 for r in itq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("vec_id < 600").collect())
    assert found / 600 >= 0.98
