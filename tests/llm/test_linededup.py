import hashlib
import re
from collections import defaultdict

from concord.llm import linededup

BLANK = "\x20\x09-\x0d"


def expected(rows, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(f"^[{BLANK}]+|[{BLANK}]+$", "", line))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect())


def test_rules_and_edges(docs):
    long, other = "The same long line that is in many documents", "Énother lÀNG line, and it has letters beyond a to z"
    rows = [(n, f"own {n}\n{long if n % 2 else '  ' + long.upper() + chr(9)}\n\n{long}") for n in range(6)]
    rows += [(n, f"{other}\nx") for n in range(10, 14)] + [(14, other.replace("o", "O")), (15, other.replace("É", "é"))]
    rows += [(None, long), (20, None), (21, ""), (22, "\n\n"), (23, "y" * 39 + "\n" + "z" * 40), (23, long), (24, "\n".join([long, "q"] * 20_000))]
    assert result(linededup.dedup(docs(*rows))) == expected(rows)
    assert result(linededup.dedup(docs(*rows, (24, rows[-1][1])), batches=7)) == expected([*rows, rows[-1]])


def test_empty(docs):
    assert linededup.dedup(docs()).count() == 0


def test_later_runs_name_no_new_holder(spark, docs):
    index = linededup.LineRuns(spark, fanout=2)
    for n in range(5, 0, -1):
        index.add(linededup.line_hashes(docs((n, "a" * 50), (n, "b" * (50 + n))), 40))
    merged = {(r.n_docs, r.holder) for r in index.merged().collect()}
    assert merged == {(5, 5), (1, 5), (1, 4), (1, 3), (1, 2), (1, 1)}
    assert sum(map(len, index.levels)) < 5 and len(index.levels) > 1


def test_hash_of_the_kept_text(docs):
    row = linededup.dedup(docs((1, "a\nb"))).selectExpr("sha2(kept_text, 256) h").first()
    assert row.h == hashlib.sha256(b"a\nb").hexdigest()


def test_runs_stay_where_they_lie(spark):
    index = linededup.LineRuns(spark)
    for k in range(2):
        index.add(spark.range(1000).selectExpr("id AS doc", f"id * {k + 1} AS h1", "id AS h2"))
    keys = spark.range(50).selectExpr("id AS h1", "id AS h2")
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.fresh(keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and "Bucketed: false" not in plan
        assert plan.count("Exchange hashpartitioning") == 1  # of the batch alone, once
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    names = [n for level in index.levels for n in level]
    index.close()
    assert names and not any(spark.catalog.tableExists(n) for n in names)
