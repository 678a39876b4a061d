import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k string, length long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with columns whose names clash with those used inside."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 7, "x", 3) for i, t in rows], SCHEMA)

    return make


def groups(ids, linked):
    """Smallest reachable id of each, by plain union."""
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}
