import re
from collections import Counter, defaultdict

from concord.llm import divergence

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, text string, lang string, source string, term string, used long, p int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, x, s, "term", 1, 2) for k, (t, x, s) in enumerate(rows)], SCHEMA)


def expected(rows, least, top=50):
    low = str.maketrans(UPPER, LOWER)
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        terms = re.findall(TERM, (text or "").translate(low))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own - {s}]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(items)[:most])}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_plain_counting(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = result(divergence.audit(frame(spark, rows), least_docs=3))
    assert got == expected(rows, 3) and {r[2] for r in got} == {"pair", "term"}


def test_edges(spark):
    rows = [(None, None, None), ("Ab aB ab", None, "s"), ("ab ÄÖ äö ABC\x7fdef", "en", "a"), ("ab ab", "en", "b"), ("", "en", "c"), ("12 --", "en", None)]
    rows += [("ab cd", "en", "a")] * 3 + [("x y", "xx", "one"), ("x", "yy", "q"), ("y", "yy", "r"), ("\U0001f600 ab", "en", "\U0001f600"), ("ab", "en", "ￜ"), ("w " * 20_000, "en", "b")]
    for least in (1, 2, 3, 30):
        assert result(divergence.audit(frame(spark, rows), least_docs=least)) == expected(rows, least)
    assert result(divergence.audit(frame(spark, rows), least_docs=1, top=2)) == expected(rows, 1, 2)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_totals_beyond_the_broadcast(spark, monkeypatch):
    rows = [(f"a b c{k % 3}", "en", f"s{k % 4}") for k in range(40)]
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 1)
    assert result(divergence.audit(frame(spark, rows))) == expected(rows, 30)


def test_pairs_are_summed_on_the_jvm(spark):
    """Only terms are counted in Python, before their vectors are written."""
    df = divergence.audit(frame(spark, [("a b", "en", "s"), ("a", "en", "t")]), least_docs=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_terms_handed_on_in_parts(spark, monkeypatch):
    rows = [(f"w{chr(97 + k % 26)}é {chr(97 + k % 7)}", "en", f"s{k % 4}") for k in range(200)]
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    assert result(divergence.audit(frame(spark, rows).repartition(3), least_docs=5)) == expected(rows, 5)


def test_exact_at_large_counts(spark):
    """A product beyond a long is exact."""
    wide = f"SELECT {divergence.share('c', 'n', 5, 10**9)} AS p FROM VALUES (10000000000000L, 30000000000001L, 100L) AS t(c, n, terms)"
    assert spark.sql(wide).first().p == 1 + 10**9 * (10**13 + 5) // (30 * 10**12 + 1 + 500)
